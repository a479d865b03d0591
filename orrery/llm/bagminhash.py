"""Near duplicates by weighted Jaccard similarity of word shingles, with BagMinHash signatures.

A text is the multiset of its five-word shingles. The weights of a shingle are cut into shells [0,1), [1,2), [2,4), [4,8), ...
Each shell of a shingle carries a Poisson process of points, a rate of one per unit of weight, each point with a position in
the shell and a slot of the signature; points beyond the shingle's weight are passed over. A slot keeps its least point, so two slots
agree with the probability of the weighted Jaccard similarity. A text stops drawing when no later point can lower a slot.

Texts with equal words are first collapsed. In a first pass every member of a band bucket is held against the bucket's pivot and
its predecessor, both by one of a few orders that bands take in turn; that settles buckets whose members then are of one class. The
members of all other buckets go through an exact second pass: ranked from rare to common, two similar multisets share an
element among the first few of both, so texts of different classes that share one are pairs. Pairs of both passes are verified on the
whole multisets. So every pair of similar texts that share a bucket ends in one class, whatever the first pass offered.
Classes are the connected components, found by label propagation with pointer jumping.

Defined cases: a null text is empty; texts without words are each a class of their own; a text of one to four words is one
shingle. Null ids come last and are rows of their own. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Words, body, forget, keep, mix, passes, string_buffers

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 32
ROWS = 5
SALTS = 8
#: Orders of members that bands take in turn.
ORDERS = 8
#: Members of a bucket that one task orders.
RUN = 4096
#: Rows to drop that are broadcast, some 16 bytes each.
BROADCAST_COPIES = 1 << 20
#: Counters of shingles by hash, for the ranks of the exact pass; any counts give the same links, good ones give fewer pairs.
COUNTERS = 1 << 18

_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: Words, n_rows: int, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, weight), sorted by row and shingle."""
    count = words.count
    first = np.cumsum(count) - count
    n = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    row = np.repeat(np.arange(n_rows), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[row]
    value = np.zeros(len(row), np.uint64)
    last = first[row] + count[row]
    for j in range(k):
        inside = at + j < last
        word = words.hash[np.minimum(at + j, max(len(words.hash) - 1, 0))] if len(row) else value
        value = mix(value * np.uint64(0xD1342543DE82EF95) + np.where(inside, word, np.uint64(j)))
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    starts = np.flatnonzero(new)
    return row[starts], value[starts], np.diff(np.append(starts, len(row)))


def signatures(row: np.ndarray, value: np.ndarray, weight: np.ndarray, n_rows: int, slots: int) -> np.ndarray:
    """Least points per row and slot (n_rows x slots), infinite for rows without shingles."""
    least = np.full((n_rows, slots), np.inf)
    flat = least.reshape(-1)
    parts = []
    low, high = 0, 1
    while True:
        has = np.flatnonzero(weight > low)
        if not len(has):
            break
        parts.append((row[has], mix(value[has] + np.uint64(high * int(_STEP) % (1 << 64))), weight[has].astype(float), np.full(len(has), float(low)), np.full(len(has), float(high - low))))
        low, high = high, high * 2
    if not parts:
        return least
    owner, seed, limit, start, rate = (np.concatenate(x) for x in zip(*parts))
    point = np.zeros(len(owner))
    draw = 0
    while len(owner):
        draw += 1
        a = mix(seed + np.uint64((2 * draw) * int(_STEP) % (1 << 64)))
        b = mix(a ^ np.uint64(0x5851F42D4C957F2D))
        point = point - np.log(((a >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)) / rate
        place = start + (b >> np.uint64(40)).astype(float) / (1 << 24) * rate
        slot = ((b & np.uint64(0xFFFFFFFF)) % np.uint64(slots)).astype(np.int64)
        ok = place < limit
        np.minimum.at(flat, owner[ok] * slots + slot[ok], point[ok])
        bound = least.max(axis=1) if draw % 4 == 1 or len(owner) > 1000 else bound
        on = point < bound[owner]
        owner, seed, limit, start, rate, point = (x[on] for x in (owner, seed, limit, start, rate, point))
    return least


def band_hashes(least: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = least.view(np.uint64).reshape(len(least), bands, rows)
    out = np.tile(mix(np.arange(1, bands + 1, dtype=np.uint64) * _STEP), (len(least), 1))
    for j in range(rows):
        out = mix(out * np.uint64(0xD1342543DE82EF95) + bits[:, :, j])
    return out.view(np.int64)


def _signed(docs: DataFrame, id_col: str, text: str, bands: int, rows: int, whole: bool) -> DataFrame:
    """Per row: rid, id, row (all columns if ``whole``, else the text alone), n_words, h1, h2 (of the words in order) and the band hashes."""
    columns = docs.columns if whole else [text]
    kept = docs.select(F.monotonically_increasing_id().alias("rid"), docs[id_col].alias("id"), F.struct(*columns).alias("row"), body(docs, text).alias("t"))
    names = ["rid", "id", "row"]
    types = {f.name: f.dataType.simpleString() for f in kept.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw, offsets = string_buffers(batch.column("t"))
            n_words, h1, h2, hashes = [], [], [], []
            for i, j in passes(offsets):
                words = Words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                at, value, weight = shingles(words, j - i)
                hashes.append(band_hashes(signatures(at, value, weight, j - i, bands * rows), bands, rows))
                place = np.arange(len(words.row)) - np.repeat(np.cumsum(words.count) - words.count, words.count)
                for salt, into in ((1, h1), (2, h2)):
                    total = np.zeros(j - i, np.uint64)
                    np.add.at(total, words.row, mix(words.hash ^ mix(place.astype(np.uint64) * np.uint64(4) + np.uint64(salt))))
                    into.append(total.view(np.int64))
                n_words.append(words.count)
            flat = np.concatenate(hashes)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * bands), pa.array(flat.reshape(-1)))
            more = [pa.array(np.concatenate(x)) for x in (n_words, h1, h2)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + more + [lists], names=names + ["n_words", "h1", "h2", "bands"])

    return kept.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in names) + ", n_words bigint, h1 bigint, h2 bigint, bands array<bigint>")


def candidates(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, inside). pairs, stored: distinct (a, b), a < b, of representatives that share a bucket as pivot or predecessor and member. inside,
    stored: (rid, bucket, n) of the members of buckets of n; pairs have all pairs of those of two alone."""
    banded = keep(reps.select("rid", F.posexplode("bands").alias("band", "bucket")).withColumn("turn", F.xxhash64("rid", F.pmod("band", F.lit(ORDERS)))), "banded")
    full = banded.groupBy("bucket").agg(F.min_by("rid", "turn").alias("pivot"), F.count("*").alias("n")).filter("n > 1")
    full = full.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("bucket", "bk")
    members = banded.withColumn("own", F.pmod("turn", F.lit(SALTS)).cast("int"))
    inside = keep(members.join(full, (F.col("bucket") == F.col("bk")) & (F.col("own") == F.col("salt"))).select("rid", "bucket", "turn", "pivot", "n"), "inside")
    runs = inside.withColumn("run", F.pmod(F.xxhash64("turn"), F.ceil(F.col("n") / RUN)))
    runs = runs.withColumn("before", F.lag("rid").over(W.partitionBy("bucket", "run").orderBy("turn")))
    pairs = runs.select("rid", F.explode(F.array("pivot", "before")).alias("other")).filter("other IS NOT NULL AND other <> rid")
    out = keep(pairs.select(F.least("rid", "other").alias("a"), F.greatest("rid", "other").alias("b")).distinct(), "pairs")
    forget(banded)
    return out, inside


def unsettled(crowd: DataFrame, labels: DataFrame) -> DataFrame:
    """(rid, label), stored, of the members of buckets with more than one label; a text without a label is its own."""
    crowd = crowd.withColumnRenamed("rid", "own")
    named = keep(crowd.join(labels, crowd.own == labels.node, "left").select(F.col("own").alias("rid"), "bucket", F.coalesce("label", "own").alias("label")), "named")
    mixed = named.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("bucket")
    out = keep(named.join(mixed, "bucket", "left_semi").select("rid", "label").distinct(), "unsettled")
    forget(named)
    return out


def _elements(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row, shingle, occurrence) of passes over the texts ``t``: multisets as sets of numbered shingles."""
    raw, offsets = string_buffers(batch.column("t"))
    for i, j in passes(offsets):
        row, value, weight = shingles(Words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), j - i)
        nth = np.arange(int(weight.sum())) - np.repeat(np.cumsum(weight) - weight, weight)
        yield i, np.repeat(row, weight), np.repeat(value, weight), nth


def crowded(texts: DataFrame, least: float) -> DataFrame:
    """Distinct (a, b), a < b, stored, with all pairs of similarity ``least`` or more and different labels. ``texts``: rid, label, t.

    With sizes x <= y, similar sets share at least 2 * least / (1 + least) * x and least * y elements. So by any order of
    elements, the least one they share is within the first x - that + 1 of the smaller and y - that + 1 of the larger, and both
    have as many elements from there on as similar sets of these sizes share.
    """
    spark = texts.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for _, _, value, nth in _elements(batch):
                total += np.bincount((value[nth == 0] % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["k", "n"])

    found = texts.select("t").mapInArrow(count, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toArrow()  # at most COUNTERS rows
    table = np.zeros(COUNTERS, np.int64)
    table[found["k"].to_numpy()] = found["n"].to_numpy()
    counts = spark.sparkContext.broadcast(table)

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row, value, nth in _elements(batch):
                rank = counts.value[(value % np.uint64(COUNTERS)).astype(np.int64)]
                token = mix(value + nth.astype(np.uint64) * _STEP)
                order = np.lexsort((token, value, rank, row))
                row, token = row[order], token[order]
                size = np.bincount(row)
                place = np.arange(len(row)) - (np.cumsum(size) - size)[row]
                size = size[row]
                probe = place <= size - np.ceil(least * size - 1e-6)
                index = place <= size - np.ceil(2 * least / (1 + least) * size - 1e-6)
                columns = [batch.column(c).take(pa.array(row[probe] + i)) for c in ("rid", "label")]
                values = [pa.array(size[probe]), pa.array(token[probe].view(np.int64)), pa.array(place[probe]), pa.array(index[probe])]
                yield pa.RecordBatch.from_arrays([*columns, *values], names=["rid", "label", "size", "token", "place", "index"])

    tokens = keep(texts.select("rid", "label", "t").mapInArrow(prefix, "rid bigint, label bigint, size bigint, token bigint, place bigint, index boolean"), "tokens")
    common = tokens.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.mode("label").alias("main")).filter("low <> high")
    shared = keep(tokens.join(common.select("token", "main"), "token").withColumn("is_main", F.col("label") == F.col("main")).drop("main"), "shared")
    # Members of a token's commonest class meet only those of other classes: main ones are sought in part 0, and found in part 1.
    seek = shared.filter("index").withColumn("part", F.explode(F.when(F.col("is_main"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))
    offer = shared.select(F.col("rid").alias("r"), F.col("label").alias("l"), F.col("size").alias("z"), F.col("place").alias("at"), "token", F.col("is_main").cast("int").alias("part"))
    near = (F.col("label") != F.col("l")) & (F.struct("size", "rid") < F.struct(F.col("z").alias("size"), F.col("r").alias("rid"))) & (F.col("z") * least <= F.col("size") + 1e-6)
    # If this is the least element that both have, what follows it in either must be enough for the others they share.
    near &= F.least(F.col("size") - F.col("place"), F.col("z") - F.col("at")) >= (F.col("size") + F.col("z")) * (least / (1 + least)) - 1e-6
    both = seek.hint("merge").join(offer.hint("merge"), ["token", "part"]).filter(near)
    out = keep(both.select(F.least("rid", "r").alias("a"), F.greatest("rid", "r").alias("b")).distinct(), "late")
    forget(tokens, shared)
    return out


def _bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(text.encode(), np.uint8)
    _, value, weight = shingles(Words(raw, np.array([0, len(raw)])), 1)
    return value, weight


def similarity(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets (values ascending)."""
    total = int(x[1].sum() + y[1].sum())
    _, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(x[1][i], y[1][j]).sum())
    return both / (total - both) if total else 0.0


def links(signed: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose similarity is at least ``least``, stored."""
    # The file size of copies tells little about their size in memory, so texts are never broadcast: all these joins sort and merge.
    need = keep(pairs.select(F.explode(F.array("a", "b")).alias("r")).distinct(), "need")
    texts = keep(signed.select("rid", "t").hint("merge").join(need, F.col("rid") == F.col("r"), "left_semi").withColumnRenamed("rid", "r"), "texts")
    busy = keep(pairs.groupBy("a").count().filter("count > 64").select(F.col("a").alias("h"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s")), "busy")
    # Each pair's key is a with a salt if a is busy, else a with salt 0; the text of a busy a comes once for each salt.
    hot = busy.filter("s = 0").select("h")
    dealt = pairs.join(hot, pairs.a == hot.h, "left").select("a", "b", F.when(F.col("h").isNull(), 0).otherwise(F.pmod("b", F.lit(SALTS))).cast("int").alias("salt"))
    owner = texts.join(hot.withColumn("n", F.lit(SALTS)), texts.r == hot.h, "left").select(
        F.col("r").alias("a"), F.col("t").alias("ta"), F.explode(F.sequence(F.lit(0), F.coalesce("n", F.lit(1)) - 1)).alias("salt")
    )
    with_b = dealt.hint("merge").join(texts.select(F.col("r").alias("b"), F.col("t").alias("tb")).hint("merge"), "b")
    both = with_b.hint("merge").join(owner.hint("merge"), ["a", "salt"]).select("a", "b", "ta", "tb")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bag = None, None
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            ok = []
            for i in range(len(a)):
                if a[i] != known:
                    known, bag = a[i], _bag(batch.column("ta")[i].as_py())
                ok.append(similarity(bag, _bag(batch.column("tb")[i].as_py())) >= least)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, y in zip(c, ok) if y], pa.int64()) for c in (a, b)], names=["a", "b"])

    out = keep(both.mapInArrow(verify, "a bigint, b bigint"), "links")
    forget(need, texts, busy)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, label), stored: the least node of each node's component, for nodes with edges."""
    both = keep(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    while True:
        now = labels.select("node", "label")
        near = both.join(now, both.b == now.node).groupBy("a").agg(F.min("label").alias("near"))
        lower = now.join(near, now.node == near.a).select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        jump = now.select(F.col("node").alias("j"), F.col("label").alias("far"))
        new = keep(lower.join(jump, lower.mid == jump.j).select("node", "old", F.least("mid", "far").alias("label")), "labels")
        forget(labels)
        labels = new
        if new.filter("label <> old").isEmpty():
            forget(both)
            return labels


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, signed). rows has one per row of ``docs``: rid, id, class_id (least id of the class), class_size, kept (one row per class)."""
    stored = keep(_signed(docs, id_col, text, bands, rows, whole), "signed")
    signed = stored.withColumn("t", F.coalesce(F.col("row")[text].cast("string"), F.lit("")))
    signed._kept_at = stored._kept_at
    some = signed.filter("n_words > 0")
    copies = keep(some.groupBy("h1", "h2").agg(F.min("rid").alias("rep")), "copies")
    reps = some.select("rid", "bands").join(copies.select(F.col("rep").alias("rid")), "rid", "left_semi")
    pairs, inside = candidates(reps)
    linked = links(signed, pairs, least)
    first = components(linked)
    found = first.select("node", "label")
    open_texts = unsettled(inside.filter("n > 2").select("rid", "bucket"), found)
    done = [copies, pairs, inside, linked, first, open_texts]
    if not open_texts.isEmpty():
        texts = keep(signed.select("rid", "t").hint("merge").join(open_texts.hint("merge"), "rid"), "open")
        own = open_texts.select(F.col("rid").alias("r"), "label")
        met = crowded(texts, least)
        late = links(signed, met, least)
        ends = late.join(own, late.a == own.r).select(F.col("label").alias("a"), "b").join(own, F.col("b") == own.r).select("a", F.col("label").alias("b")).distinct()
        second = components(ends)
        merged = second.select(F.col("node").alias("from"), F.col("label").alias("to"))
        # A label without links is that of a text of its own, which late links may give one.
        nodes = found.unionByName(open_texts.filter("rid = label").select(F.col("rid").alias("node"), "label")).distinct()
        found = nodes.join(merged, F.col("label") == F.col("from"), "left").select("node", F.coalesce("to", "label").alias("label"))
        done += [texts, met, late, second]
    labelled = copies.join(found, copies.rep == found.node, "left").select("h1", "h2", F.coalesce("label", "rep").alias("label"))
    words = F.col("n_words") > 0
    # Texts without words have keys of their own, so that they meet no label and don't gather in one task.
    slim = signed.select("rid", "id", F.when(words, F.col("h1")).otherwise(F.col("rid")).alias("k1"), F.when(words, F.col("h2")).alias("k2"))
    joined = keep(slim.join(labelled, (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2")), "left")
                  .select("rid", "id", F.coalesce("label", "rid").alias("label")), "members")
    forget(*done)
    heads = joined.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid")).alias("top"), F.count("*").alias("class_size"))
    # Stored, so that a large class can be split in the join.
    heads = keep(heads.select("label", F.col("top.id").alias("class_id"), F.col("top.rid").alias("top_rid"), "class_size"), "heads")
    return joined.join(heads, "label").withColumn("kept", F.col("rid") == F.col("top_rid")).drop("top_rid", "label"), signed


def near_classes(docs: DataFrame, **options) -> DataFrame:
    """Per row: id, class_id, class_size, kept."""
    found, signed = classes(docs, **options)
    forget(signed)
    return found.drop("rid")


def near_dedup(docs: DataFrame, **options) -> DataFrame:
    """One row of each class, with all its columns: the one with the least id."""
    found, signed = classes(docs, whole=True, **options)
    found = keep(found.select("rid", "kept"), "kept")
    gone = found.filter("NOT kept").select("rid")
    if gone.count() <= BROADCAST_COPIES:
        return signed.join(F.broadcast(gone), "rid", "left_anti").select("row.*")
    return signed.join(found.filter("kept").select("rid"), "rid", "left_semi").select("row.*")
