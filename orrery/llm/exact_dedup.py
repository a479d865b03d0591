"""Exact deduplication with a split for heavy hitters.

A Misra-Gries pass finds the few digests that may hold more than a share ``support`` of all rows. Their true counts and
their smallest ids are taken in a second pass over the digests, and the verified winners (at most 1 / support rows, so a
proven bound) are broadcast: rows of those groups are settled without a shuffle. All other digests are shuffled as usual, summed
up first where they are read; none of those groups can hold more than ``support`` of the rows.

Defined cases: a null text counts as empty, and empty texts equal each other. A null id comes after all others. If several
rows of a group carry the smallest id, exactly one of them is kept. An empty table gives no rows. Other columns are ignored
by ``dedup_groups`` and kept by ``dedup``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, body, forget, fresh, keep

#: Share of all rows from which a digest is settled before the shuffle.
SUPPORT = 0.002
#: Digests that come twice or more which :func:`dedup` broadcasts, some 60 bytes each.
BROADCAST_GROUPS = 1 << 19


def normal_form(text: F.Column) -> F.Column:
    return F.regexp_replace(text, SPACE + "+", " ")


def digest(df: DataFrame, text: str = "text") -> F.Column:
    return F.unhex(F.sha2(normal_form(body(df, text)).cast("binary"), 256))


def _least() -> F.Column:
    return F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "rid")).alias("least")


def _winners(digests: DataFrame, support: float) -> DataFrame:
    """(digest, win_id, win_rid, win_size) of the digests that hold more than ``support`` of the rows."""
    total = digests.count()
    frequent = digests.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    counted = digests.join(F.broadcast(frequent), "digest", "left_semi").groupBy("digest").agg(_least(), F.count("*").alias("win_size"))
    return counted.filter(F.col("win_size") > total * support).select("digest", F.col("least.id").alias("win_id"), F.col("least.rid").alias("win_rid"), "win_size")


def _groups(docs: DataFrame, id_col: str, text: str, support: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(digests, winners, rest): id, digest and rid of all rows; the frequent digests; (digest, keep_id, keep_rid, group_size) of all others."""
    tagged = docs.select(docs[id_col].alias("id"), digest(docs, text).alias("digest"), F.monotonically_increasing_id().alias("rid"))
    digests = keep(tagged, "digests")
    winners = keep(_winners(digests, support), "winners")
    # Copies are summed up where they are read, so a digest just below the share costs a row for each task.
    rest = digests.join(F.broadcast(winners), "digest", "left_anti").groupBy("digest").agg(_least(), F.count("*").alias("group_size"))
    return digests, winners, rest.select("digest", F.col("least.id").alias("keep_id"), F.col("least.rid").alias("keep_rid"), "group_size")


def dedup_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per input row: id, digest, keep_id, group_size and kept."""
    digests, winners, rest = _groups(docs, id_col, text, support)
    settled = digests.join(F.broadcast(winners), "digest", "left")
    hot = settled.filter("win_size IS NOT NULL").select(
        "id", "digest", F.col("win_id").alias("keep_id"), F.col("win_size").alias("group_size"), (F.col("rid") == F.col("win_rid")).alias("kept")
    )
    # A stored table on either side, so that a join on a key with many rows can be split.
    cold = settled.filter("win_size IS NULL").select("id", "digest", "rid").join(keep(rest, "groups"), "digest")
    return hot.unionByName(cold.select("id", "digest", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept")))


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of equal texts, with all their columns.

    Of rows equal in id and text the one stays whose columns have the least hash. Texts move only if more than
    ``BROADCAST_GROUPS`` digests come twice or more, and then without the copies of frequent ones.
    """
    d, k, n, i = fresh(docs, "digest__", "keep__", "none__", "nth__")
    digests, winners, rest = _groups(docs, id_col, text, support)
    twice = keep(rest.filter("group_size > 1").select("digest", "keep_id").unionByName(winners.select("digest", F.col("win_id").alias("keep_id"))), "twice")
    same = digests.join(twice.select(F.col("digest").alias("t_digest"), "keep_id"), (F.col("digest") == F.col("t_digest")) & F.col("id").eqNullSafe(F.col("keep_id")))
    repeated = keep(same.groupBy("digest").count().filter("count > 1").select("digest"), "repeated")
    tagged = docs.withColumn(d, digest(docs, text))
    few = twice.count() <= BROADCAST_GROUPS
    hot = winners.select(F.col("digest").alias(k), F.col("win_id").alias(n))
    left = tagged.join(F.broadcast(hot), F.col(d) == F.col(k), "left").filter(F.col(k).isNull() | F.col(id_col).eqNullSafe(F.col(n))).drop(k, n)
    side = twice.select(F.col("digest").alias(k), F.col("keep_id").alias(n))
    left = (tagged if few else left).join(F.broadcast(side) if few else side, F.col(d) == F.col(k), "left").filter(F.col(k).isNull() | F.col(id_col).eqNullSafe(F.col(n))).drop(n)
    if repeated.isEmpty():
        out = left.drop(d, k)
    else:
        again = repeated.select(F.col("digest").alias(n))
        marked = left.drop(k).join(F.broadcast(again) if few else again, F.col(d) == F.col(n), "left")
        nth = F.row_number().over(W.partitionBy(d).orderBy(F.xxhash64(F.to_json(F.struct(*docs.columns)))))
        one = marked.filter(F.col(n).isNotNull()).withColumn(i, nth).filter(F.col(i) == 1).drop(i)
        out = marked.filter(F.col(n).isNull()).unionByName(one).drop(d, n)
    forget(digests)
    return out
