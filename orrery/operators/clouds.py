"""Point clouds: colours, centring and scaling to unit size, bounds, labels; normals of meshes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions import label_colour

_AXES = ("x", "y", "z")


def bounds(points: DataFrame, cloud: str = "cloud_id") -> DataFrame:
    aggs = [f(F.col(a).cast("double")).alias(f"{n}_{a}") for a in _AXES for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    extent = sum((F.pow(F.col(f"max_{a}") - F.col(f"min_{a}"), F.lit(2.0)) for a in _AXES), F.lit(0.0))
    return points.groupBy(cloud).agg(F.count("*").alias("n_points"), *aggs).withColumn("diagonal", F.sqrt(extent))


def normalise(points: DataFrame, cloud: str = "cloud_id") -> DataFrame:
    """Centred on the mean, divided by the diagonal of the bounding box; a cloud without extent gets null coordinates."""
    at = bounds(points, cloud)
    out = points.join(at.select(cloud, "diagonal", *[f"mean_{a}" for a in _AXES]), cloud)
    moved = {a: F.try_divide(F.col(a).cast("double") - F.col(f"mean_{a}"), F.col("diagonal")) for a in _AXES}
    return out.withColumns(moved).withColumn("degenerate", F.col("diagonal") == 0).drop("diagonal", *[f"mean_{a}" for a in _AXES])


def rescale_colours(points: DataFrame, cloud: str = "cloud_id") -> DataFrame:
    """Divide r, g, b by 255 in clouds whose largest value is above 1; a NaN anywhere leaves the cloud as it is."""
    top = points.groupBy(cloud).agg(
        F.max(F.greatest("r", "g", "b")).alias("top"), F.max(F.isnan("r") | F.isnan("g") | F.isnan("b")).alias("any_nan")
    )
    scale = F.when((F.col("top") > 1.0) & ~F.col("any_nan"), F.lit(255.0)).otherwise(F.lit(1.0))
    return points.join(top, cloud).withColumns({c: F.col(c) / scale for c in ("r", "g", "b")}).drop("top", "any_nan")


def colour_labels(points: DataFrame) -> DataFrame:
    """Points without colours get those of their label; equal labels, and all NaN ones, get equal colours."""
    given = F.col("r").isNull() & F.col("label").isNotNull()
    return points.withColumns({c: F.when(given, v).otherwise(F.col(c)) for c, v in zip("rgb", label_colour(F.col("label")))})


def labels(points: DataFrame, cloud: str = "cloud_id") -> DataFrame:
    """The distinct labels of each cloud; ``orderBy`` puts them in order."""
    return points.select(cloud, "label").distinct()


def vertex_normals(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """Unit normals per vertex: area-weighted sums over triangles; null where they cancel out or a vertex has no triangle."""
    corner = {c: vertices.select("mesh_id", F.col("vid").alias(c), F.struct(*_AXES).alias(f"p{c}")) for c in "abc"}
    t = triangles
    for c in "abc":
        t = t.join(corner[c], ["mesh_id", c])
    u = [F.col(f"pb.{a}") - F.col(f"pa.{a}") for a in _AXES]
    v = [F.col(f"pc.{a}") - F.col(f"pa.{a}") for a in _AXES]
    cross = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    spread = t.select("mesh_id", *[n.alias(f"n{a}") for n, a in zip(cross, _AXES)], F.explode(F.array("a", "b", "c")).alias("vid"))
    summed = spread.groupBy("mesh_id", "vid").agg(*[F.sum(f"n{a}").alias(f"n{a}") for a in _AXES])
    size = F.sqrt(sum((F.col(f"n{a}") * F.col(f"n{a}") for a in _AXES), F.lit(0.0)))
    all_ = vertices.select("mesh_id", "vid").join(summed, ["mesh_id", "vid"], "left")
    return all_.select("mesh_id", "vid", *[F.try_divide(F.col(f"n{a}"), size).alias(f"n{a}") for a in _AXES])
