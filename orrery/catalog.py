"""Queries over the driver's tables that exercise the operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery import functions as fn
from orrery.operators import clouds, datasets, pairing


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tasks, customers as index entries, a part of the nations as clouds."""
    tasks = _t(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("i"), F.lit("f").alias("folder"), F.concat(F.lit("/img/"), F.col("o_orderkey").cast("string")).alias("src_path")
    )
    index = _t(spark, sf_dir, "customer").filter("c_acctbal > 0").select(
        F.concat(F.col("c_custkey").cast("string"), F.lit("/f")).alias("key"), F.concat(F.lit("a/b/"), F.col("c_nationkey").cast("string"), F.lit(".glb")).alias("glb_path")
    )
    found = _t(spark, sf_dir, "nation").filter("n_regionkey <> 1").select(
        F.col("n_nationkey").cast("string").alias("object_id"), F.concat(F.lit("/cl/"), F.col("n_name")).alias("path")
    )
    return pairing.build_mapping(tasks, index, found, "/img", "/cl")


def miss_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.miss_report(mapping(spark, sf_dir))


def find_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.find_first(mapping(spark, sf_dir), "A", "src")


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("cloud_id"), F.col("l_orderkey").alias("point_id"), F.col("l_linenumber").alias("line"),
        F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").cast("double").alias("y"), F.col("l_partkey").cast("double").alias("z"),
    )


def cloud_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = clouds.bounds(_points(spark, sf_dir))
    return b.select("cloud_id", "n_points", "min_x", "max_x", "min_y", "max_y", "min_z", "max_z", F.round("diagonal", 4).alias("diagonal"))


def cloud_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clouds.normalise(_points(spark, sf_dir))
    return out.select("cloud_id", "point_id", "line", *[(F.round(a, 6) + 0.0).alias(a) for a in "xyz"], "degenerate")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cloud_id"), F.col("l_linestatus").alias("label"))
    return clouds.labels(rows)


def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.last_wins(_t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").alias("at")), "o_custkey", "o_orderkey", "at")


def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("a/"), F.col("n_name"), F.lit(".b.glb"))
    return _t(spark, sf_dir, "nation").select("n_nationkey", fn.basename(path).alias("base"), fn.stem(path).alias("stem"), fn.preview(path).alias("preview"))


def ordered_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as folders of their source, pages as the index, embeddings as clouds that come twice; rows in order."""
    docs = _t(spark, sf_dir, "documents").select(F.col("source").alias("i"), F.col("doc_id").cast("string").alias("folder"))
    tasks = pairing.with_ordinal(docs.withColumn("src_path", F.concat(F.lit("/data/img/"), "i", F.lit("/"), "folder")))
    pages = _t(spark, sf_dir, "pages").select(F.col("page_id").alias("p"), F.col("url").alias("glb_path"))
    index = _t(spark, sf_dir, "documents").join(pages, F.col("doc_id") == F.col("p")).select(fn.key_of(F.col("source"), F.col("doc_id").cast("string")).alias("key"), "glb_path")
    vectors = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("object_id"), F.explode(F.array(F.lit("part1"), F.lit("part0"))).alias("parent"))
    found = vectors.withColumn("path", F.concat(F.lit("/data/clouds/"), "parent", F.lit("/"), "object_id"))
    return pairing.build_mapping(tasks, index, found, "/data/img", "/data")


def cloud_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as rows of a mapping: some are files, some folders with a cloud, some nothing."""
    nations = _t(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("dst"))
    name = F.when(F.col("n_nationkey") % 3 == 0, F.col("dst")).when(F.col("n_nationkey") % 3 == 1, F.concat("dst", F.lit("/xyzc.npy"))).otherwise(F.concat("dst", F.lit("/other.npy")))
    return pairing.cloud_files(nations, nations.select(name.alias("path"))).drop("dst")


def relative_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/a/"), F.col("n_regionkey").cast("string"), F.lit("//./"), F.col("n_name"))
    return _t(spark, sf_dir, "nation").select("n_nationkey", fn.relative(path, "/a/1").alias("from_one"), fn.relative(path, "/a/").alias("from_root"), fn.relative(path, "/b/c").alias("from_other"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("v"), "label")


def rgb_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    cloud = F.col("vec_id") % 5
    pts = _vectors(spark, sf_dir).select("vec_id", cloud.alias("cloud_id"), *[(F.abs(F.get("v", F.lit(3 + k))) * F.when(cloud < 2, 500.0).otherwise(1.0)).alias(c) for k, c in enumerate("rgb")])
    return clouds.rescale_colours(pts).select("vec_id", "cloud_id", *[F.round(c, 6).alias(c) for c in "rgb"])


def label_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("double")
    pts = _vectors(spark, sf_dir).select("vec_id", "label", none.alias("r"), none.alias("g"), none.alias("b"))
    return clouds.colour_labels(pts).select("vec_id", "label", *[F.round(c, 9).alias(c) for c in "rgb"])


def _sliced(spark: SparkSession, sf_dir: str, last_axis: bool) -> DataFrame:
    points = F.lit(3)
    rows = _vectors(spark, sf_dir).select("vec_id", "v", F.explode(F.sequence(F.lit(0), points - 1)).alias("point"))
    return rows.select("vec_id", "point", *[fn.value_at(F.col("v"), F.col("point"), F.lit(k), 4, 0, points, last_axis).alias(c) for k, c in enumerate(("x", "y", "z", "label"))])


def slice_last_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sliced(spark, sf_dir, True)


def slice_first_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sliced(spark, sf_dir, False)


def json_map_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = F.from_json("props", "map<string,string>", {"mode": "FAILFAST"})
    return _t(spark, sf_dir, "events").select("event_id", F.explode(parsed).alias("key", "value"))


def _chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _t(spark, sf_dir, "conversations")
    one = said.groupBy("conv_id").agg(F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("user"), F.min_by("text", F.when(F.col("role") == "system", F.col("turn"))).alias("system"))
    return one.select("conv_id", fn.messages(F.col("user"), F.col("system")).alias("chat"))


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each turn: the system's, the default one where a conversation has none, then the user's first."""
    return _chats(spark, sf_dir).select("conv_id", F.posexplode("chat").alias("nth", "turn")).select("conv_id", "nth", "turn.role", F.get("turn.content", F.lit(0))["text"].alias("text"))


def chat_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chats(spark, sf_dir).select("conv_id", fn.rendered(F.col("chat")).alias("prompt"))


def reply_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.sequence(F.lit(1), F.col("n_nationkey") + 1)
    return _t(spark, sf_dir, "nation").select("n_nationkey", F.array_join(fn.without_special(fn.reply_tokens(tokens, F.col("n_regionkey")), [7, 9]), ",").alias("tokens"))


def schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, key = F.col("n_nationkey") / 24.0, F.col("n_regionkey").cast("double")
    return _t(spark, sf_dir, "nation").select(
        "n_nationkey", F.round(fn.cosine(5e-6, 5e-7, t), 12).alias("rate"), fn.times(key, t, F.lit(3.0)).alias("product"), F.round(fn.divide(t, key), 9).alias("quotient"),
        F.round(F.get(fn.normalise(F.array(t, key, t), [0.5, 0.25, 0.0], [0.5, 2.0, 0.0]), F.lit(1)), 9).alias("normal"), fn.matches(F.col("n_name"), ["*AN*", "?H*"]).alias("matched"),
    )


def vertex_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A strip of triangles for each label; vectors as vertices."""
    v = _vectors(spark, sf_dir).select(F.col("label").alias("mesh_id"), F.col("vec_id").alias("vid"), *[F.get("v", F.lit(k)).alias(a) for k, a in enumerate("xyz")])
    strip = [F.lead("vid", k).over(W.partitionBy("mesh_id").orderBy("vid")).alias(c) for k, c in ((1, "b"), (2, "c"))]
    triangles = v.select("mesh_id", F.col("vid").alias("tid"), F.col("vid").alias("a"), *strip).filter("c IS NOT NULL")
    return clouds.vertex_normals(v, triangles).select("mesh_id", "vid", *[(F.round(f"n{a}", 6) + 0.0).alias(f"n{a}") for a in "xyz"])


def training_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as frames of their nation's video, twice over with suppliers, sampled, shuffled and batched."""
    a = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("video"), F.col("c_custkey").alias("frame"), F.lit("c").alias("kind"))
    b = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("video"), F.col("s_suppkey").alias("frame"))
    frames = datasets.sampled(datasets.concat(a, b).fillna("s", ["kind"]).filter("frame IS NOT NULL"), "video", "frame", 8, 123)
    return datasets.batched(datasets.repeated(frames, 2), 7, 123, "kind", "frame", "repeat")


QUERIES = {f.__name__: f for f in (
    mapping, miss_report, find_first, cloud_bounds, cloud_normalised, labels, last_wins, path_functions, ordered_mapping, cloud_files, relative_paths, rgb_rescale,
    label_colour, slice_last_axis, slice_first_axis, json_map_entries, chat_messages, chat_text, reply_tokens, schedules, vertex_normals, training_batches,
)}

_CHATS = """WITH c AS (SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'user') AS "user",
        coalesce(arg_min(text, turn) FILTER (WHERE role = 'system'), 'You are a helpful assistant.') AS system FROM conversations GROUP BY 1)"""

_MAPPING = """
    SELECT CAST(o_orderkey AS VARCHAR) AS src, coalesce(CASE WHEN c_custkey IS NOT NULL THEN n_name END, '') AS dst, c_custkey IS NOT NULL AS has_index
    FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey
    LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 1) ON n_nationkey = c_nationkey"""

_BOUNDS = """
    SELECT l_suppkey AS cloud_id, count(*) AS n_points, min(l_quantity::DOUBLE) AS min_x, max(l_quantity::DOUBLE) AS max_x,
           min(l_extendedprice::DOUBLE) AS min_y, max(l_extendedprice::DOUBLE) AS max_y, min(l_partkey::DOUBLE) AS min_z, max(l_partkey::DOUBLE) AS max_z,
           avg(l_quantity::DOUBLE) AS ax, avg(l_extendedprice::DOUBLE) AS ay, avg(l_partkey::DOUBLE) AS az FROM lineitem GROUP BY 1"""
_DIAGONAL = "sqrt((max_x - min_x) ** 2 + (max_y - min_y) ** 2 + (max_z - min_z) ** 2)"

ORACLES = {
    "mapping": _MAPPING,
    "miss_report": f"""SELECT count(*) AS n_out, count(*) FILTER (WHERE NOT has_index) AS missing_index,
        count(*) FILTER (WHERE has_index AND dst = '') AS missing_cloud FROM ({_MAPPING})""",
    "find_first": f"SELECT * FROM ({_MAPPING}) WHERE contains(dst, 'A') ORDER BY src LIMIT 1",
    "cloud_bounds": f"SELECT cloud_id, n_points, min_x, max_x, min_y, max_y, min_z, max_z, round({_DIAGONAL}, 4) AS diagonal FROM ({_BOUNDS})",
    "cloud_normalised": f"""
        SELECT cloud_id, l_orderkey AS point_id, l_linenumber AS line, round((l_quantity::DOUBLE - ax) / d, 6) + 0.0 AS x,
               round((l_extendedprice::DOUBLE - ay) / d, 6) + 0.0 AS y, round((l_partkey::DOUBLE - az) / d, 6) + 0.0 AS z, d = 0 AS degenerate
        FROM lineitem JOIN (SELECT *, {_DIAGONAL} AS d FROM ({_BOUNDS})) ON l_suppkey = cloud_id""",
    "labels": "SELECT DISTINCT l_suppkey AS cloud_id, l_linestatus AS label FROM lineitem",
    "last_wins": "SELECT o_custkey, max(o_orderkey) AS o_orderkey, count(*) AS n_dups FROM orders GROUP BY 1",
    "path_functions": """SELECT n_nationkey, n_name || '.b.glb' AS base, n_name || '.b' AS stem, 'a/' || n_name || '.b.glb/00000/00000.png' AS preview FROM nation""",
    "ordered_mapping": r"""
        WITH t AS (SELECT source AS i, CAST(doc_id AS VARCHAR) AS folder, doc_id, row_number() OVER (ORDER BY source, CAST(doc_id AS VARCHAR)) - 1 AS ordinal FROM documents WHERE source IS NOT NULL),
        x AS (SELECT page_id, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '^(\.*[^.].*)\.[^.]*$', '\1') AS object_id FROM pages)
        SELECT ordinal, i || '/' || folder AS src, CASE WHEN vec_id IS NULL THEN '' ELSE 'clouds/part1/' || vec_id END AS dst, page_id IS NOT NULL AS has_index
        FROM t LEFT JOIN x ON doc_id = page_id LEFT JOIN embeddings ON CAST(vec_id AS VARCHAR) = object_id""",
    "cloud_files": """SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN n_name WHEN 1 THEN n_name || '/xyzc.npy' END AS file,
        CASE WHEN n_nationkey % 3 = 2 THEN 'no file for ' || n_name END AS error FROM nation""",
    "relative_paths": """SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN n_name ELSE '../' || n_regionkey || '/' || n_name END AS from_one,
        n_regionkey || '/' || n_name AS from_root, '../../a/' || n_regionkey || '/' || n_name AS from_other FROM nation""",
    "rgb_rescale": """
        WITH p AS (SELECT vec_id, vec_id % 5 AS cloud_id, CASE WHEN vec_id % 5 < 2 THEN 500.0::DOUBLE ELSE 1.0::DOUBLE END AS k, embedding AS v FROM embeddings),
        c AS (SELECT vec_id, cloud_id, abs(v[4]::DOUBLE) * k AS r, abs(v[5]::DOUBLE) * k AS g, abs(v[6]::DOUBLE) * k AS b FROM p),
        m AS (SELECT *, CASE WHEN max(greatest(r, g, b)) OVER (PARTITION BY cloud_id) > 1 THEN 255.0::DOUBLE ELSE 1.0::DOUBLE END AS d FROM c)
        SELECT vec_id, cloud_id, round(r / d, 6) AS r, round(g / d, 6) AS g, round(b / d, 6) AS b FROM m""",
    "label_colour": """
        WITH h AS (SELECT vec_id, label, md5(CAST(label AS VARCHAR)) AS h FROM embeddings)
        SELECT vec_id, label, round(('0x' || h[1:2])::INT / 255.0::DOUBLE, 9) AS r, round(('0x' || h[3:4])::INT / 255.0::DOUBLE, 9) AS g, round(('0x' || h[5:6])::INT / 255.0::DOUBLE, 9) AS b FROM h""",
    "slice_last_axis": """SELECT vec_id, CAST(n AS INT) AS point, embedding[n * 20 + 1]::DOUBLE AS x, embedding[n * 20 + 6]::DOUBLE AS y, embedding[n * 20 + 11]::DOUBLE AS z,
        embedding[n * 20 + 16]::DOUBLE AS label FROM embeddings, range(3) AS p(n)""",
    "slice_first_axis": """SELECT vec_id, CAST(n AS INT) AS point, embedding[n * 4 + 1]::DOUBLE AS x, embedding[n * 4 + 2]::DOUBLE AS y, embedding[n * 4 + 3]::DOUBLE AS z,
        embedding[n * 4 + 4]::DOUBLE AS label FROM embeddings, range(3) AS p(n)""",
    "json_map_entries": """SELECT event_id, key, json_extract_string(props, '$."' || key || '"') AS value
        FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)""",
    "chat_messages": f"""{_CHATS} SELECT conv_id, 0 AS nth, 'system' AS role, system AS text FROM c UNION ALL SELECT conv_id, 1, 'user', "user" FROM c""",
    "chat_text": f"""{_CHATS} SELECT conv_id, 'system: ' || system || chr(10) || 'user: ' || "user" || chr(10) || 'assistant:' AS prompt FROM c""",
    "reply_tokens": """SELECT n_nationkey, coalesce(array_to_string(list_filter(range(n_regionkey + 1, n_nationkey + 2), lambda x: x NOT IN (7, 9)), ','), '') AS tokens FROM nation""",
    "schedules": """
        WITH n AS (SELECT *, n_nationkey / 24.0::DOUBLE AS t, n_regionkey::DOUBLE AS k FROM nation)
        SELECT n_nationkey, round(5e-7::DOUBLE + 0.5::DOUBLE * (5e-6::DOUBLE - 5e-7::DOUBLE) * (1 + cos(pi() * t)), 12) AS rate, k * t * 3.0::DOUBLE AS product,
               CASE WHEN k <> 0 THEN round(t / k, 9) END AS quotient, round((k - 0.25::DOUBLE) / 2.0::DOUBLE, 9) AS normal, n_name LIKE '%AN%' OR n_name LIKE '_H%' AS matched FROM n""",
    "vertex_normals": """
        WITH v AS (SELECT label AS m, vec_id AS i, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, lead(vec_id) OVER w AS b, lead(vec_id, 2) OVER w AS c
                   FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
        e AS (SELECT p.m, p.i AS a, q.i AS b, r.i AS c, q.x - p.x AS ux, q.y - p.y AS uy, q.z - p.z AS uz, r.x - p.x AS vx, r.y - p.y AS vy, r.z - p.z AS vz
              FROM v p JOIN v q ON q.i = p.b JOIN v r ON r.i = p.c),
        n AS (SELECT m, unnest([a, b, c]) AS i, uy * vz - uz * vy AS x, uz * vx - ux * vz AS y, ux * vy - uy * vx AS z FROM e),
        s AS (SELECT m, i, sum(x) AS x, sum(y) AS y, sum(z) AS z FROM n GROUP BY 1, 2)
        SELECT v.m AS mesh_id, v.i AS vid, round(s.x / nullif(d, 0), 6) + 0.0 AS nx, round(s.y / nullif(d, 0), 6) + 0.0 AS ny, round(s.z / nullif(d, 0), 6) + 0.0 AS nz
        FROM v LEFT JOIN (SELECT *, sqrt(x * x + y * y + z * z) AS d FROM s) s ON s.m = v.m AND s.i = v.i""",
    "training_batches": """
        WITH f AS (SELECT c_nationkey AS video, c_custkey AS frame, 'c' AS kind FROM customer UNION ALL SELECT s_nationkey, s_suppkey, 's' FROM supplier),
        o AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY md5('123' || chr(31) || coalesce(CAST(video AS VARCHAR), chr(0)) || chr(31) || frame), frame) AS nth FROM f),
        r AS (SELECT video, frame, kind, CAST(n AS INT) AS repeat FROM o, range(2) AS p(n) WHERE nth <= 8),
        b AS (SELECT *, row_number() OVER (ORDER BY md5('123' || chr(31) || kind || chr(31) || frame || chr(31) || repeat), kind, frame, repeat) - 1 AS place, count(*) OVER () AS total FROM r)
        SELECT video, frame, kind, repeat, place // 7 AS batch FROM b WHERE place // 7 < total // 7""",
}
