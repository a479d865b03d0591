"""Interpolated modified Kneser-Ney model of any order, counted in Spark and kept in sorted hash arrays.

Words are counted first and get ids by falling count. Then each batch of texts is turned into the distinct n-grams of the highest
order with their counts, packed by bucket; a bucket's task merges them, writes them as a sorted hash array, and passes on, packed
again, what the order below needs: of each context its total and how many of its n-grams come once, twice or more, and of
each suffix the number of its n-grams (its continuation count). Each lower order does the same, down to single words.
An n-gram goes to the bucket of its context, so a context's sums are local; n-grams whose context has frequent words alone are spread
over all buckets, and the partial sums of such a context meet in the order below. So no bucket depends on one frequent context.

Workers map the arrays into memory where the shared folder is mounted, else they hold some buckets' arrays at a time. The
driver holds file names and a few sums. All words and n-grams are kept: the model grows with the input.

Tokens are the words of the text, A-Z in lower case, then one end; start marks stand before the first one.
Defined cases: a null text is empty and has the end token alone; without training texts every token has probability 1; a null
id counts as empty text when texts are dealt; an empty table gives no rows. Texts of any length are read whole.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, body, crc_remainder, forget, keep, mix, passes, remove, scratch, string_buffers

FOLDS = 7
HELD_OUT = 2
ORDER = 3
#: Tokens for each bucket of n-grams; a task's memory is some 100 bytes a token.
PER_BUCKET = 1 << 20
#: Bytes of texts that are counted or scored together; a longer text by itself.
SCORED = 1 << 22
#: Mark of the end among word hashes.
END = np.uint64(0x5BE0CD19137E2179)

_STEP = np.uint64(0xD1342543DE82EF95)
_CODEC = pa.Codec("zstd", compression_level=1)
_SUMS = ("total", "n1", "n2", "n3")


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, word hash) of consecutive texts, each with its end."""
    rows = len(offsets) - 1
    words = Words(raw, offsets, lower=True)
    row = np.repeat(np.arange(rows), words.count + 1)
    token = np.full(len(row), END, np.uint64)
    token[np.arange(len(words.row)) + words.row] = words.hash
    return row, token


def _batch_tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, offsets = string_buffers(column)
    found = [(i, *tokens(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])) for i, j in passes(offsets)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate([r + i for i, r, _ in found]), np.concatenate([t for _, _, t in found])


# --- arrays in files ------------------------------------------------------------------------------------------------


def _save(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    at, head = 0, {}
    for k, a in arrays.items():
        head[k] = (a.dtype.str, at, len(a))
        at += -(-a.nbytes // 8) * 8
    front = json.dumps(head).encode()
    front += b" " * (-len(front) % 8)
    with fs.open_output_stream(f"{root}/{name}") as out:
        out.write(struct.pack("<Q", len(front)) + front)
        for a in arrays.values():
            out.write(a.tobytes() + b"\0" * (-a.nbytes % 8))


def _load(folder: str, name: str) -> dict[str, np.ndarray]:
    fs, root = pafs.FileSystem.from_uri(folder)
    if fs.type_name == "local":
        raw = np.memmap(f"{root}/{name}", np.uint8, "r")
    else:
        with fs.open_input_file(f"{root}/{name}") as f:
            raw = np.frombuffer(f.read(), np.uint8)
    size = int(raw[:8].view("<u8")[0])
    return {k: raw[8 + size + at :][: n * np.dtype(t).itemsize].view(t) for k, (t, at, n) in json.loads(bytes(raw[8 : 8 + size])).items()}


#: Mapped files cost no memory of their own; files read over a network are kept in small number.
_mapped = lru_cache(maxsize=1 << 14)(_load)
_held = lru_cache(maxsize=8)(_load)


def _arrays(folder: str, name: str) -> dict[str, np.ndarray]:
    return (_mapped if folder.startswith(("file:", "/")) else _held)(folder, name)


def _narrow(name: str, values: np.ndarray) -> dict[str, np.ndarray]:
    """Counts in one byte each; those of 255 and more are listed beside it."""
    big = np.flatnonzero(values >= 255)
    return {name: np.minimum(values, 255).astype(np.uint8), f"{name}_at": big.astype(np.int64), f"{name}_is": values[big].astype(np.int64)}


def _counts(arrays: dict[str, np.ndarray], name: str, at: np.ndarray) -> np.ndarray:
    """Counts at places; 0 at place -1."""
    if not len(arrays[name]):
        return np.zeros(len(at), np.int64)
    out = np.where(at < 0, 0, arrays[name][at]).astype(np.int64)
    big = np.flatnonzero(out == 255)
    if len(big):
        out[big] = arrays[f"{name}_is"][np.searchsorted(arrays[f"{name}_at"], at[big])]
    return out


def _hashed(key: np.ndarray, counts: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """A sorted hash array: places by the top bits of the hash, then the low 32 bits in order. About 16 keys share their top bits."""
    top = max(0, len(key).bit_length() - 4)
    high = (key >> np.uint64(64 - top) if top else np.zeros(len(key), np.uint64)) << np.uint64(32)
    order = np.argsort(high | key & np.uint64(0xFFFFFFFF))
    high = (high[order] >> np.uint64(32)).astype(np.int64)
    out = {"low": key[order].astype(np.uint32), "start": np.searchsorted(high, np.arange((1 << top) + 1)).astype(np.uint32)}
    for k, v in counts.items():
        out |= _narrow(k, v[order])
    return out


def _find(arrays: dict[str, np.ndarray], key: np.ndarray) -> np.ndarray:
    """Places of keys in a sorted hash array, -1 for absent ones."""
    start, low = arrays["start"], arrays["low"]
    if not len(low):
        return np.full(len(key), -1, np.int64)
    top = (len(start) - 1).bit_length() - 1
    high = (key >> np.uint64(64 - top)).astype(np.int64) if top else np.zeros(len(key), np.int64)
    a, b = start[high].astype(np.int64), start[high + 1].astype(np.int64)
    end, want = b, key.astype(np.uint32)
    for _ in range(int((b - a).max(initial=0)).bit_length()):
        mid = (a + b) >> 1
        less = low[np.minimum(mid, len(low) - 1)] < want
        less &= a < b
        a, b = np.where(less, mid + 1, a), np.where(less, b, mid)
    hit = (a < end) & (low[np.minimum(a, len(low) - 1)] == want)
    return np.where(hit, a, -1)


# --- n-grams as columns of word ids -----------------------------------------------------------------------------------


def gram_hash(columns: list[np.ndarray]) -> np.ndarray:
    h = np.full(len(columns[0]), _STEP, np.uint64)
    for c in columns:
        h = mix(h * _STEP + c.astype(np.uint64) + np.uint64(1))
    return h


def _group(columns: list[np.ndarray], bits: int, weights: list[np.ndarray] | None = None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct n-grams in order, with their sums of weights, or their counts."""
    code, used = columns[0].astype(np.uint64), bits
    for c in columns[1:]:
        if used + bits > 64:
            code = np.unique(code, return_inverse=True)[1].astype(np.uint64)
            used = len(code).bit_length()
        code, used = code << np.uint64(bits) | c.astype(np.uint64), used + bits
    order = np.argsort(code)
    at = _heads([code[order]])
    sums = [np.add.reduceat(w[order], at) for w in weights] if weights is not None else [np.diff(np.append(at, len(order)))]
    first = order[at]
    return [c[first] for c in columns], sums


def _heads(columns: list[np.ndarray]) -> np.ndarray:
    """Where a new combination begins in sorted columns."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _pack(columns: list[np.ndarray]) -> bytes:
    """Columns of unsigned numbers by byte planes, compressed; the first one is in order and is kept as steps."""
    n = len(columns[0])
    parts = [struct.pack("<QQ", n, len(columns))]
    for i, c in enumerate(columns):
        c = np.diff(c, prepend=c.dtype.type(0)) if i == 0 else c
        wide = max(1, -(-int(c.max()).bit_length() // 8))
        data = _CODEC.compress(np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(n, 8)[:, :wide].T).tobytes(), asbytes=True)
        parts.append(struct.pack("<QQ", wide, len(data)) + data)
    return b"".join(parts)


def _unpack(data: bytes) -> list[np.ndarray]:
    n, k = struct.unpack_from("<QQ", data)
    at, out = 16, []
    for i in range(k):
        wide, size = struct.unpack_from("<QQ", data, at)
        planes = np.frombuffer(_CODEC.decompress(data[at + 16 : at + 16 + size], n * wide), np.uint8).reshape(wide, n)
        full = np.zeros((n, 8), np.uint8)
        full[:, :wide] = planes.T
        c = full.view("<u8").reshape(n).astype(np.int64)
        out.append(np.cumsum(c) if i == 0 else c)
        at += 16 + size
    return out


class Shape:
    """Order, number of words, buckets, and how many of the first ids are frequent. START and an unknown word follow the words' ids."""

    def __init__(self, order: int, words: int, buckets: int, frequent: int):
        self.order, self.words, self.buckets, self.frequent = order, words, buckets, frequent
        self.start, self.unknown, self.bits = words, words + 1, (words + 2).bit_length()

    def bucket(self, columns: list[np.ndarray]) -> np.ndarray:
        k = len(columns)
        if k == 1:
            return columns[0] % self.buckets
        if k < self.order:
            by = gram_hash(columns)
        else:
            spread = np.logical_and.reduce([(c < self.frequent) | (c == self.start) for c in columns[:-1]])
            by = gram_hash(columns[:-1])
            by[spread] = gram_hash([c[spread] for c in columns])
        return (mix(by ^ np.uint64(0x1F83D9ABFB41BD6B)) % np.uint64(self.buckets)).astype(np.int64)

    def columns(self, ids: np.ndarray, place: np.ndarray, k: int) -> list[np.ndarray]:
        """The last ``k`` ids up to each place, where start marks stand before a text; ``place`` is an id's number in its text."""
        out = []
        for back in range(k - 1, -1, -1):
            c = np.full(len(ids), self.start, np.int64)
            c[back:] = np.where(place[back:] >= back, ids[: len(ids) - back], self.start)
            out.append(c)
        return out


def _parcels(shape: Shape, kind: int, columns: list[np.ndarray], values: list[np.ndarray]) -> pa.RecordBatch:
    """A row (kind, bucket, packed n-grams) for each bucket; the n-grams come in order."""
    bucket = shape.bucket(columns)
    order = np.argsort(bucket.astype(np.uint16) if shape.buckets <= 1 << 16 else bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(shape.buckets + 1))
    some = np.flatnonzero(np.diff(cut))
    data = [_pack([c[order[cut[b] : cut[b + 1]]] for c in columns + values]) for b in some]
    return _rows(kind, some, data)


def _rows(kind: int, bucket: np.ndarray | list[int], data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(data), pa.int32()), pa.array(bucket, pa.int32()), pa.array(data, pa.binary())], names=["kind", "bucket", "data"])


_PARCEL = "kind int, bucket int, data binary"
_CONTEXT, _GRAM, _FILE = 0, 1, 2


def _merge(shape: Shape, k: int, folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Merges the parcels of order ``k`` by bucket: writes the bucket's arrays, and gives parcels for the order below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parcels: dict[int, dict[int, list[bytes]]] = {}
        for batch in batches:
            for kind, bucket, data in zip(*(batch.column(c).to_pylist() for c in ("kind", "bucket", "data"))):
                parcels.setdefault(bucket, {}).setdefault(kind, []).append(data)
        for bucket, kinds in parcels.items():
            columns, sums = [], []
            for kind, parts in kinds.items():
                got = [np.concatenate(x) for x in zip(*map(_unpack, parts))]
                none = np.zeros(len(got[0]), np.int64)
                columns.append(got[:k])
                sums.append([got[k], none, none, none, none] if kind == _GRAM else [none, *got[k:]])
            columns, sums = ([np.concatenate(x) for x in zip(*y)] for y in (columns, sums))
            columns, sums = _group(columns, shape.bits, sums if k < shape.order else sums[:1])
            name = f"{bucket:06d}-{uuid.uuid4().hex}"
            if k == 1:
                at, full = columns[0] // shape.buckets, [np.zeros((shape.start - bucket) // shape.buckets + 1, np.int64) for _ in sums]
                for f, s in zip(full, sums):
                    f[at] = s
                arrays = {}
                for n, f in zip(("a", *_SUMS), full):
                    arrays |= _narrow(n, f)
            else:
                arrays = _hashed(gram_hash(columns), dict(zip(("a", *_SUMS), sums)))
            _save(folder, name, arrays)
            real = sums[0] > 0
            columns, a = [c[real] for c in columns], sums[0][real]
            yield _rows(_FILE, [bucket], [json.dumps({"name": name, "all": int(a.sum()), "of": [int((a == i).sum()) for i in (1, 2, 3, 4)] + [int((a >= 3).sum())]}).encode()])
            if k > 1 and len(a):
                at = _heads(columns[:-1])
                context = [np.add.reduceat(x, at) for x in (a, *[(y).astype(np.int64) for y in (a == 1, a == 2, a >= 3)])]
                yield _parcels(shape, _CONTEXT, [c[at] for c in columns[:-1]], context)
                yield _parcels(shape, _GRAM, *_group(columns[1:], shape.bits))

    return run


# --- the model --------------------------------------------------------------------------------------------------------


class Vocabulary:
    """Ids and counts by word hash, in files over ranges of the hash."""

    def __init__(self, folder: str, files: list[tuple[int, int, str]], unknown: int):
        self.folder, self.files, self.unknown = folder, files, unknown

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id, count) of each key; the unknown id and 0 for absent ones."""
        some, back = np.unique(keys.view(np.int64), return_inverse=True)
        ids, counts = np.full(len(some), self.unknown, np.int64), np.zeros(len(some), np.int64)
        for low, high, name in self.files:
            i, j = np.searchsorted(some, low), np.searchsorted(some, high, side="right")
            if i < j:
                arrays = _arrays(self.folder, name)
                at = np.minimum(np.searchsorted(arrays["key"], some[i:j]), len(arrays["key"]) - 1)
                hit = arrays["key"][at] == some[i:j]
                ids[i:j][hit] = arrays["id"][at[hit]]
                counts[i:j] = _counts(arrays, "c", np.where(hit, at, -1))
        return ids[back], counts[back]


def _write_words(ranked: DataFrame, folder: str) -> list[tuple[int, int, str]]:
    """Arrays in order of the hash, one file for each partition; (least, greatest, name) of each, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[b.column(c).to_numpy(zero_copy_only=False) for c in ("h", "id", "c")] for b in batches if b.num_rows]
        if parts:
            h, i, c = (np.concatenate(x) for x in zip(*parts))
            name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
            _save(folder, name, {"key": h.astype("<i8"), "id": i.astype("<u4" if i.max() < 1 << 32 else "<i8")} | _narrow("c", c))
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((int(h[0]), pa.int64()), (int(h[-1]), pa.int64()), (name, pa.string()))], names=["low", "high", "name"])

    ranged = ranked.repartitionByRange("h").sortWithinPartitions("h")
    return sorted(tuple(r) for r in ranged.mapInArrow(run, "low bigint, high bigint, name string").collect())  # one row per file


def _words(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, c = np.unique(_batch_tokens(batch.column("t"))[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], names=["h", "c"])

    return texts.mapInArrow(run, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))


def _ranked(words: DataFrame) -> DataFrame:
    """(h, c, id): ids from 0 by falling count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, part = 0, TaskContext.get().partitionId()
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column("h"), b.column("c"), pa.array([part] * b.num_rows, pa.int32()), pa.array(np.arange(n, n + b.num_rows))], names=["h", "c", "part", "nth"]
            )
            n += b.num_rows

    order = (F.desc("c"), F.asc("h"))
    placed = keep(words.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "h bigint, c bigint, part int, nth bigint"), "ranked")
    sizes = dict(placed.groupBy("part").count().collect())  # one row per partition
    before, n = [], 0
    for p in range(max(sizes, default=-1) + 1):
        before.append(n)
        n += sizes.get(p, 0)
    base = F.element_at(F.array(*[F.lit(b).cast("long") for b in before or [0]]), F.col("part") + 1)
    out = placed.select("h", "c", (F.col("nth") + base).alias("id"))
    out._kept_at = placed._kept_at
    return out


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and more, from the counts of counts 1 to 4."""
    n = [0, *n]
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    return tuple(min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.1 * k), 0.9 * k) if n[k] else 0.5 * k for k in (1, 2, 3))  # type: ignore[return-value]


class Model:
    def __init__(self, folder: str, shape: Shape, vocabulary: Vocabulary, n_tokens: int):
        self.folder, self.shape, self.vocabulary, self.n_tokens = folder, shape, vocabulary, n_tokens
        self.n_words = shape.words
        #: By order: folder, file names by bucket, discounts, sum of counts.
        self.orders: dict[int, tuple[str, dict[int, str], tuple[float, float, float], int]] = {}

    def _get(self, k: int, columns: list[np.ndarray]) -> list[np.ndarray]:
        """Count, and for orders below the highest the sums as a context, of each n-gram."""
        folder, names, _, _ = self.orders[k]
        fields = ("a",) if k == self.shape.order else ("a", *_SUMS)
        out = [np.zeros(len(columns[0]), np.int64) for _ in fields]
        bucket = self.shape.bucket(columns)
        order = np.argsort(bucket.astype(np.uint16) if self.shape.buckets <= 1 << 16 else bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(self.shape.buckets + 1))
        key = columns[0] if k == 1 else gram_hash(columns)
        for b in np.flatnonzero(np.diff(cut)):
            if (name := names.get(int(b))) is None:
                continue
            which, arrays = order[cut[b] : cut[b + 1]], _arrays(folder, name)
            if k == 1:
                at = key[which] // self.shape.buckets
                at = np.where(at < len(arrays["a"]), at, -1)
            else:
                at = _find(arrays, key[which])
            hit = at >= 0
            which, at = which[hit], at[hit]
            for o, f in zip(out, fields):
                o[which] = _counts(arrays, f, at)
        return out

    def probabilities(self, row: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probability, count) of each token; ``row`` ascends."""
        if not self.n_tokens:
            return np.ones(len(row)), np.zeros(len(row), np.int64)
        shape = self.shape
        ids, count = self.vocabulary.get(hashes)
        # A start mark before each text's tokens.
        first = np.flatnonzero(np.diff(row, prepend=-1))
        ids = np.insert(ids, first, shape.start)
        head = first + np.arange(len(first))
        place = np.arange(len(ids)) - np.repeat(head, np.diff(np.append(head, len(ids))))
        scored = place > 0
        p = None
        context: list[np.ndarray] = []
        for k in range(1, shape.order + 1):
            d, total = self.orders[k][2:]
            found = self._get(k, shape.columns(ids, place, k))
            a = found[0]
            kept = a - np.select([a >= 3, a == 2, a == 1], [d[2], d[1], d[0]], 0.0)
            if k == 1:
                left = self.spread / total
                p = kept / total + left / (shape.words + 1)
            else:
                all_, n1, n2, n3 = (np.concatenate([[0], x[:-1]]) for x in context)
                seen = all_ > 0
                p = np.where(seen, (kept + (d[0] * n1 + d[1] * n2 + d[2] * n3) * p) / np.where(seen, all_, 1), p)
            context = found[1:]
        return p[scored], count

    #: Weight that the words leave for unknown ones.
    spread = 0.0

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        rows = len(offsets) - 1
        found = [(i, *tokens(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])) for i, j in passes(offsets)]
        row, token = np.concatenate([r + i for i, r, _ in found]), np.concatenate([t for _, _, t in found])
        p, count = self.probabilities(row, token)
        base = np.log10((count + 1) / (self.n_tokens + self.n_words + 1))
        sums = [np.bincount(row, weights=w, minlength=rows) for w in (count > 0, base, np.log10(p))]
        return {"n_tokens": np.bincount(row, minlength=rows), "n_known": sums[0].astype(np.int64), "base_score": sums[1], "score": sums[2]}


def train(texts: DataFrame, order: int = ORDER, per_bucket: int = PER_BUCKET) -> Model:
    """Model of a table with a text column ``t``."""
    spark, folder = texts.sparkSession, scratch(texts.sparkSession, "ngram")
    counted = keep(_words(texts), "words")
    n_tokens, n_words, frequent = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count_if(F.col("c") > per_bucket // 16)).first()
    shape = Shape(order, int(n_words), max(1, -(-int(n_tokens) // per_bucket)), int(frequent))
    ranked = _ranked(counted)
    vocabulary = Vocabulary(f"{folder}/words", _write_words(ranked, f"{folder}/words"), shape.unknown)
    forget(counted, ranked)
    model = Model(folder, shape, vocabulary, int(n_tokens))
    if not n_tokens:
        return model

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("t")
            for i, j in passes(string_buffers(column)[1], 2 * SCORED):
                row, token = _batch_tokens(column.slice(i, j - i))
                first = np.flatnonzero(np.diff(row, prepend=-1))
                place = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
                ids = vocabulary.get(token)[0]
                yield _parcels(shape, _GRAM, *_group(shape.columns(ids, place, order), shape.bits))

    parcels, below = texts.mapInArrow(count, _PARCEL), None
    for k in range(order, 0, -1):
        merged = keep(parcels.repartitionById(shape.buckets, F.col("bucket")).mapInArrow(_merge(shape, k, f"{folder}/{k}"), _PARCEL), f"order-{k}")
        if below is not None:
            forget(below)
        files = {r.bucket: json.loads(bytes(r.data)) for r in merged.filter(F.col("kind") == _FILE).select("bucket", "data").collect()}  # one row per bucket
        of = [sum(f["of"][i] for f in files.values()) for i in range(5)]
        total = sum(f["all"] for f in files.values())
        model.orders[k] = (f"{folder}/{k}", {b: f["name"] for b, f in files.items()}, _discounts(of[:4]), total)
        if k == 1:
            d = model.orders[1][2]
            model.spread = d[0] * of[0] + d[1] * of[1] + d[2] * of[4]
        parcels, below = merged.filter(F.col("kind") != _FILE), merged
    forget(below)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text", **more: F.Column) -> DataFrame:
    """Per row: id, the columns ``more``, n_tokens, n_known, base_score, score, perplexity."""
    source = docs.select(docs[id_col].alias("id"), *[c.alias(k) for k, c in more.items()], body(docs, text).alias("t"))
    kept = ["id", *more]
    types = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    names = ["n_tokens", "n_known", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = string_buffers(batch.column("t"))
            for i, j in passes(offsets, SCORED):
                found = model.score(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(i, j - i) for k in kept] + [pa.array(found[k]) for k in names], names=kept + names)

    schema = ", ".join([f"{k} {types[k]}" for k in kept] + ["n_tokens bigint, n_known bigint, base_score double, score double"])
    return source.mapInArrow(run, schema).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def held_out_scores(docs: DataFrame, id_col: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """Train on the texts whose remainder isn't the held-out one, and score all. The scores are stored; the model goes."""
    held = crc_remainder(docs[id_col], FOLDS) == HELD_OUT
    model = train(docs.filter(~held).select(body(docs, text).alias("t")), order)
    out = keep(score(docs, model, id_col, text, held_out=held).withColumn("train_tokens", F.lit(model.n_tokens).cast("long")), "scores")
    remove(docs.sparkSession, model.folder)
    return out
