"""Mixing sources to target weights with a low-discrepancy schedule, in DataFrame functions only.

Each source is a stream of words: its documents in the order of a hash, cut into equal blocks of at most ``block`` words. Sources
with a target below ``block * SLOTS`` words have smaller blocks, by powers of two, so that they too get that many slots. The sources of one
size of block share a sequence of slots. Slot i falls on the point frac(i / golden ratio), in whole numbers modulo 2^45;
the cumulative targets of the sources, in order, tell which source the point hits. The k-th slot of a source takes block k modulo its
number of blocks, at most ``repeat`` times.

Prefix sums are two-level (totals of hash buckets or slot chunks, then rows within one of them), so no task orders a
whole source. A source's interval is cut at fixed cells, so slots find their source by an equi-join.

Defined cases: a null text has no words; the null source comes last; a source without words has target 0; an empty table
gives no rows. A null or repeated id is a row of its own. Rows equal in id, source and text are interchangeable.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import body, keep

WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEAT = 2
BLOCK = 128
CELLS = 4096
CHUNK = 1 << 16
#: Slots that a source gets at least, if its target has as many words.
SLOTS = 64
#: The golden ratio less one, times 2^45.
GOLDEN = int(0.6180339887498949 * (1 << 45)) | 1


def word_count(text: F.Column) -> F.Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeat: int = REPEAT, block: int = BLOCK) -> DataFrame:
    """(source, source_size, weight, target, block, low, high): targets by weight, none above ``repeat`` sizes, the excess reshared.

    That is water filling: with sources by cap / weight, a prefix is at its cap and the rest share what is left by weight.
    ``low`` and ``high`` bound a source's part of the unit interval of its size of block.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    nth = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), nth.cast("int") + 1))
    cap = F.col("source_size") * float(repeat)
    fill = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = fill.rowsBetween(W.unboundedPreceding, 0)
    every = W.partitionBy(F.lit(0))
    filled = (
        weighed.withColumn("cap", cap)
        .withColumn("budget", F.sum("source_size").over(every) * share)
        .withColumn("used", F.sum("cap").over(upto) - F.col("cap"))
        .withColumn("left_weight", F.sum("weight").over(every) - F.sum("weight").over(upto) + F.col("weight"))
        .withColumn("level", (F.col("budget") - F.col("used")) / F.col("left_weight"))
        .withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
        .withColumn("water", F.min(F.when(F.col("open"), F.struct(F.col("used"), F.col("level")))).over(every)["level"])
        .withColumn("target", F.least("cap", F.coalesce(F.col("water") * F.col("weight"), F.col("cap"))))
    )
    size = F.least(F.lit(block), F.greatest(F.lit(1), F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(F.col("target") / SLOTS, F.lit(1.0))))).cast("int")))
    filled = filled.withColumn("block", size)
    total = F.sum("target").over(W.partitionBy("block"))
    high = F.sum("target").over(W.partitionBy("block").orderBy(F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0))
    return filled.select(
        "source", "source_size", "weight", "target", "block",
        F.coalesce(F.try_divide(high - F.col("target"), total), F.lit(0.0)).alias("low"),
        F.coalesce(F.try_divide(high, total), F.lit(0.0)).alias("high"),
    )


def golden_point(i: F.Column) -> F.Column:
    """frac(i / golden ratio) of whole numbers, exact to 45 bits however large they are."""
    low = lambda x, bits: x.bitwiseAND(F.lit((1 << bits) - 1))
    x, parts = low(i, 45), [GOLDEN >> 15 * k & 0x7FFF for k in range(3)]
    # Limbs of 15 bits, so that no product goes beyond 60.
    total = sum((F.shiftleft(low(x * F.lit(g), 45 - 15 * k), 15 * k) for k, g in enumerate(parts[1:], 1)), low(x * F.lit(parts[0]), 45))
    return low(total, 45) / F.lit(float(1 << 45))


def schedule(plan: DataFrame, repeat: int = REPEAT) -> DataFrame:
    """(slot, block, source, blk): the block each slot takes, for each size of block. ``plan`` comes from :func:`targets`."""
    spark = plan.sparkSession
    totals = plan.groupBy("block").agg(F.sum("target").alias("total")).collect()  # a row for each power of two up to the largest block
    ranges = [spark.range(int(-(-r["total"] // r["block"]))).select(F.col("id").alias("slot"), F.lit(r["block"]).alias("block")) for r in totals]
    slots = reduce(DataFrame.unionAll, ranges, spark.range(0).select(F.col("id").alias("slot"), F.lit(1).alias("block")))
    cells = plan.filter("high > low").select(
        "source", "block", "low", "high", F.ceil(F.col("source_size") / F.col("block")).alias("n_blocks"),
        F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1)))).alias("cell"),
    )
    slots = slots.withColumn("u", golden_point(F.col("slot"))).withColumn("cell", F.floor(F.col("u") * CELLS))
    hit = slots.join(cells, ["block", "cell"]).filter("u >= low AND u < high").withColumn("chunk", F.floor(F.col("slot") / CHUNK))
    hit = keep(hit.select("slot", "block", "source", "n_blocks", "chunk"), "slots")
    before = (
        hit.groupBy("source", "chunk").agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(W.partitionBy("source").orderBy("chunk")) - F.col("n"))
        .select(F.col("source").alias("s"), F.col("chunk").alias("c"), "before")
    )
    ranked = hit.join(before, hit.source.eqNullSafe(before.s) & (hit.chunk == before.c)).withColumn(
        "k", F.col("before") + F.row_number().over(W.partitionBy("source", "chunk").orderBy("slot")) - 1
    )
    return ranked.filter(F.col("k") < F.col("n_blocks") * repeat).select("slot", "block", "source", F.pmod("k", "n_blocks").alias("blk"))


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS,
        share: float = SHARE, repeat: int = REPEAT, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, pieces, slots) of the mix.

    documents: id, rid, source, size, h. pieces: rid, source, blk, words: the words of a document in a block of its source's
    stream. slots: slot, block, source, blk. The mix is the join of slots and pieces on (source, blk), in the order of slot * block.
    """
    h = F.xxhash64(docs[id_col].cast("string"), body(docs, source), body(docs, text))
    rows = keep(
        docs.select(docs[id_col].alias("id"), docs[source].alias("source"), word_count(body(docs, text)).alias("size"), h.alias("h"),
                    F.monotonically_increasing_id().alias("rid")).withColumn("bucket", F.shiftrightunsigned("h", 48)),
        "sizes",
    )
    buckets = keep(rows.groupBy("source", "bucket").agg(F.sum("size").alias("size")), "buckets")
    plan = keep(targets(buckets.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, repeat, block), "targets")
    before = buckets.select(
        F.col("source").alias("s"), F.col("bucket").alias("b"),
        (F.sum("size").over(W.partitionBy("source").orderBy("bucket")) - F.col("size")).alias("before"),
    )
    inner = W.partitionBy("source", "bucket").orderBy("h", "id", "rid").rowsBetween(W.unboundedPreceding, 0)
    placed = rows.join(before, rows.source.eqNullSafe(before.s) & (rows.bucket == before.b)).withColumn(
        "start", F.col("before") + F.sum("size").over(inner) - F.col("size")
    )
    cut = plan.select(F.col("source").alias("p"), F.col("block").cast("long").alias("block"))
    placed = placed.join(cut, placed.source.eqNullSafe(F.col("p"))).filter("size > 0")
    last = F.floor((F.col("start") + F.col("size") - 1) / F.col("block"))
    pieces = placed.select("rid", "source", "start", "size", "block", F.explode(F.sequence(F.floor(F.col("start") / F.col("block")), last)).alias("blk")).select(
        "rid", "source", "blk",
        (F.least(F.col("start") + F.col("size"), (F.col("blk") + 1) * F.col("block")) - F.greatest(F.col("start"), F.col("blk") * F.col("block"))).alias("words"),
    )
    documents = rows.join(plan.withColumnRenamed("source", "s"), rows.source.eqNullSafe(F.col("s"))).drop("s")
    return documents, pieces, schedule(plan, repeat)


def taken(docs: DataFrame, **options) -> DataFrame:
    """Per document: id, rid, source, size, source_size, weight, target and taken, the words the mix takes of it."""
    documents, pieces, slots = mix(docs, **options)
    times = slots.groupBy("source", "blk").agg(F.count("*").alias("times")).select(F.col("source").alias("s"), F.col("blk").alias("b"), "times")
    words = (
        pieces.join(times, pieces.source.eqNullSafe(times.s) & (pieces.blk == times.b))
        .groupBy("rid").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    )
    return documents.join(words, "rid", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes its words, rounded to whole documents; columns stay.

    A document whose share rounds to nothing, but of which some words are taken, stays once.
    """
    names = docs.columns
    copies = F.greatest(F.round(F.try_divide("taken", "size")), F.sign(F.col("taken").cast("double"))).cast("int")
    counts = taken(docs, id_col=id_col, text=text, source=source, **options).filter("taken > 0")
    counts = counts.groupBy("id", "source", "h").agg(F.sum(copies).alias("n"), F.count("*").alias("same"))
    left = docs.select(F.struct(*names).alias("row"), docs[id_col].alias("doc"), docs[source].alias("src"),
                       F.xxhash64(docs[id_col].cast("string"), body(docs, source), body(docs, text)).alias("hash"))
    joined = left.join(counts, left.doc.eqNullSafe(counts.id) & left.src.eqNullSafe(counts.source) & (left.hash == counts.h))
    nth = F.row_number().over(W.partitionBy("hash", "doc", "src").orderBy(F.lit(0)))
    per_row = F.floor(F.col("n") / F.col("same")) + F.when(nth <= F.pmod("n", "same"), 1).otherwise(0)
    return joined.withColumn("copies", per_row).filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
