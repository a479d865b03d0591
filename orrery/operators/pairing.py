"""Pair folders with clouds through an index, count each kind of miss, look rows up, and resolve a row's cloud file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.functions import key_of, relative, stem

#: The file of a cloud's folder.
CLOUD_FILE = "xyzc.npy"


def last_wins(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """One row per key: the value at the highest ``order``, and how many there were."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value), F.count("*").alias("n_dups"))


def with_ordinal(tasks: DataFrame, parent: str = "i", name: str = "folder") -> DataFrame:
    """``tasks`` with ``ordinal`` from 0: parents in string order, and names in string order in each.

    Parents are numbered by their totals and names within a parent, so no task orders all rows.
    """
    totals = tasks.groupBy(parent).agg(F.count("*").alias("n"))
    before = totals.select(F.col(parent).alias("_parent"), (F.sum("n").over(W.orderBy(parent)) - F.col("n")).alias("_before"))
    nth = F.row_number().over(W.partitionBy(parent).orderBy(name, *[c for c in tasks.columns if c not in (parent, name)])) - 1
    return tasks.withColumn("_nth", nth).join(before, F.col(parent) == F.col("_parent")).withColumn("ordinal", F.col("_before") + F.col("_nth")).drop("_nth", "_parent", "_before")


def cloud_index(clouds: DataFrame) -> DataFrame:
    """(object_id, path, n_dups): of an object under several parents, the one under the last parent in string order."""
    order = "parent" if "parent" in clouds.columns else "path"
    return last_wins(clouds, "object_id", "path", order)


def build_mapping(tasks: DataFrame, index: DataFrame, clouds: DataFrame, image_root: str = "", cloud_root: str = "") -> DataFrame:
    """(src, dst, has_index, and ordinal if tasks have it): each task with its cloud, dst empty for a miss.

    tasks: i, folder, src_path. index: key, glb_path, one row per key. clouds: object_id, path, maybe parent; an object may repeat.
    """
    keyed = tasks.withColumn("key", key_of(F.col("i"), F.col("folder")))
    known = index.select("key", stem(F.col("glb_path")).alias("object_id"), F.lit(True).alias("hit"))
    # Rows without an object get a key of their own that no object has, so that they don't meet in one task.
    found = keyed.join(known, "key", "left").withColumn("object_id", F.coalesce("object_id", F.concat(F.lit("\0"), F.col("key"))))
    found = found.join(cloud_index(clouds).select("object_id", "path"), "object_id", "left")
    dst = F.coalesce(F.when(F.col("hit"), relative(F.col("path"), cloud_root)), F.lit(""))
    first = ["ordinal"] if "ordinal" in tasks.columns else []
    return found.select(*first, relative(F.col("src_path"), image_root).alias("src"), dst.alias("dst"), F.coalesce("hit", F.lit(False)).alias("has_index"))


def miss_report(mapping: DataFrame) -> DataFrame:
    return mapping.agg(
        F.count("*").alias("n_out"),
        F.count_if(~F.col("has_index")).alias("missing_index"),
        F.count_if(F.col("has_index") & (F.col("dst") == "")).alias("missing_cloud"),
    )


def find_first(mapping: DataFrame, needle: str, order: str = "ordinal") -> DataFrame:
    """The first row whose dst contains ``needle`` (an empty needle is in every dst)."""
    return mapping.filter(F.col("dst").contains(needle)).orderBy(order).limit(1)


def find_item(mapping: DataFrame, needle: str, order: str = "ordinal") -> Row:
    """The row that :func:`find_first` gives; an error if there is none."""
    row = find_first(mapping, needle, order).first()
    if row is None:
        raise LookupError(f"no row has {needle!r} in its dst")
    return row


def cloud_files(mapping: DataFrame, files: DataFrame, dst: str = "dst") -> DataFrame:
    """``mapping`` with ``file``, the cloud file of its dst, and ``error`` where there is none.

    A dst that is itself in ``files`` (path) is that file, any other is a folder that holds one of the usual name.
    """
    asked = mapping.select(F.col(dst).alias("_dst")).distinct()
    ways = asked.select("_dst", F.posexplode(F.array("_dst", F.concat("_dst", F.lit(f"/{CLOUD_FILE}")))).alias("_way", "_path"))
    there = ways.join(files.select(F.col("path").alias("_path")).distinct(), "_path").groupBy("_dst").agg(F.min_by("_path", "_way").alias("file"))
    out = mapping.join(there, F.col(dst) == F.col("_dst"), "left").drop("_dst")
    return out.withColumn("error", F.when(F.col("file").isNull(), F.concat(F.lit("no file for "), F.col(dst))))
