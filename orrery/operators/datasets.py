"""Training sets: concatenate, repeat, sample frames and objects, shuffle, batch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def chance(seed: int, *columns: str) -> Column:
    """A value in hexadecimal digits that depends on the seed and the columns alone; its order is a random one."""
    return F.md5(F.concat_ws("\x1f", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns]))


def concat(*sets: DataFrame) -> DataFrame:
    """All rows of all sets; a column that a set lacks is null in its rows."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sets)


def repeated(rows: DataFrame, factor: int) -> DataFrame:
    """Each row ``factor`` times, numbered by ``repeat`` from 0."""
    return rows.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(factor - 1)))) if factor > 0 else rows.withColumn("repeat", F.lit(0)).limit(0)


def sampled(rows: DataFrame, group: str, item: str, most: int, seed: int) -> DataFrame:
    """Of each group's rows the ``most`` whose item comes first in a random order: frames of a video, objects of a frame."""
    nth = F.row_number().over(W.partitionBy(group).orderBy(chance(seed, group, item), item))
    return rows.withColumn("_nth", nth).filter(F.col("_nth") <= most).drop("_nth")


def shuffled(rows: DataFrame, seed: int, *key: str) -> DataFrame:
    """``rows`` in a random order that the seed and the key fix."""
    return rows.orderBy(chance(seed, *key), *key)


def batched(rows: DataFrame, size: int, seed: int, *key: str, drop_last: bool = True, cells: int = 256) -> DataFrame:
    """``rows`` with the number of their batch, in the order of :func:`shuffled`; a last batch that isn't full goes if ``drop_last``.

    Places are counted in two levels, by the leading digits of the order and within them, so no task orders all rows.
    """
    digits = max(2, len(f"{max(cells, 2) - 1:x}"))
    marked = rows.withColumn("_order", chance(seed, *key)).withColumn("_cell", F.substring("_order", 1, digits))
    totals = marked.groupBy("_cell").agg(F.count("*").alias("_n"))
    before = totals.select(F.col("_cell").alias("_c"), (F.sum("_n").over(W.orderBy("_cell")) - F.col("_n")).alias("_before"), F.sum("_n").over(W.partitionBy(F.lit(0))).alias("_all"))
    nth = F.row_number().over(W.partitionBy("_cell").orderBy("_order", *key)) - 1
    placed = marked.withColumn("_nth", nth).join(F.broadcast(before), F.col("_cell") == F.col("_c"))  # at most 16 ** digits rows
    out = placed.withColumn("batch", F.floor((F.col("_before") + F.col("_nth")) / size))
    if drop_last:
        out = out.filter(F.col("batch") < F.floor(F.col("_all") / size))
    return out.drop("_order", "_cell", "_c", "_n", "_before", "_all", "_nth")
