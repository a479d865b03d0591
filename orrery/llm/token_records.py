"""Token ids in length-delimited binary records with masked checksums, and an offset index for shuffled reads.

A record is: byte length (unsigned 64 bits), masked crc32 of those 8 bytes, the ids as unsigned integers, masked crc32 of the
ids; all little-endian. Ids take 2 bytes where every id of the vocabulary fits, else 4. Each task writes the records of a range of
ids in ascending order into a file of its own; the index, a table, tells file, byte offset and token offset of each record. A
file counts only if the index names it: the index is committed by Spark, so a repeated task leaves at most an unnamed file.

Rows that a scan already gives in ascending order (each partition by itself, and partitions without overlap) are written where they
are read; others are first dealt out by ranges of ids.

A text is encoded word by word: a space between two characters that aren't white space always begins a new pre-token, and so
does a line end there, so a text's ids are those of its words in turn. Ids of words seen before come from a bounded memo of the worker;
new words go to the tokenizers library. Texts with other white space are encoded whole by the library.

Defined cases: a null text is empty, so its record holds the end id alone; null ids come last; rows with equal ids are in
the order of their texts' hash. An empty table gives an empty index. The string of an added token in a text is that token, as
the library has it; ``special_as_text`` makes it ordinary text. Other columns, whatever their names, don't matter.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BYTE_LEVEL_PATTERN, body, bounded_batches, cut_alone, spaced

END = 0
#: Words after which a worker's memo of ids is set aside; the one set aside before is forgotten then.
REMEMBERED = 1 << 19
#: Words of these characters, whose kinds no version of Unicode changes, are cut by the pattern below; others by the library.
_SETTLED = regex.compile("[\x20-\x7e\xa1-\u024f]+").fullmatch

_PIECES = regex.compile(BYTE_LEVEL_PATTERN).findall


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(ids: bytes) -> bytes:
    size = struct.pack("<Q", len(ids))
    return size + struct.pack("<I", masked(size)) + ids + struct.pack("<I", masked(ids))


def unframe(data: bytes) -> bytes:
    """The ids of a framed record; raises if a length or a checksum is wrong."""
    size, check = struct.unpack_from("<QI", data)
    if masked(data[:8]) != check or len(data) != size + 16:
        raise ValueError("broken record length")
    ids = data[12 : 12 + size]
    if masked(ids) != struct.unpack_from("<I", data, 12 + size)[0]:
        raise ValueError("broken record checksum")
    return ids


def _byte_letters() -> dict[int, int]:
    """The letter of each byte in byte-level vocabularies: printable bytes stand for themselves, others come after U+00FF in turn."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(other)}


class Encoder:
    """Ids of texts as little-endian bytes, by the tokenizers library."""

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads of the library would take others'
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = special_as_text
        self.kind = "<u2" if self.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        added = [t["content"] for t in given["added_tokens"]]
        pre, model = given["pre_tokenizer"] or {}, given["model"]
        self.by_word = (
            pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and model.get("type") == "BPE" and not model.get("dropout")
            and all(given.get(k) is None for k in ("normalizer", "post_processor", "truncation", "padding")) and not any(c.isspace() for t in added for c in t)
            and not any(t[k] for t in given["added_tokens"] for k in ("single_word", "lstrip", "rstrip"))
        )
        self.added, self.model, self.letters = added, self.tok.model, _byte_letters()
        self.memo: dict[str, bytes | None] = {}
        self.older: dict[str, bytes | None] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _word(self, word: str) -> bytes | None:
        """Ids of a word with the space before it, or of a line end; None if a piece of white space may be cut in two here."""
        if not cut_alone(word):
            return None
        if not _SETTLED(word) or any(t in word for t in self.added):
            return self.whole(word)
        pieces = (p.encode().decode("latin-1").translate(self.letters) for p in _PIECES(word))
        return np.array([t.id for p in pieces for t in self.model.tokenize(p)], self.kind).tobytes()

    def encode(self, text: str) -> bytes:
        if not self.by_word or "\0" in text or not text:
            return self.whole(text)
        words = spaced(text)
        get = self.memo.__getitem__
        try:
            return b"".join(map(get, words))
        except KeyError:
            for w in set(words).difference(self.memo):
                self.memo[w] = self.older[w] if w in self.older else self._word(w)
        except TypeError:
            return self.whole(text)
        try:
            out = b"".join(map(get, words))
        except TypeError:
            out = self.whole(text)
        if len(self.memo) > REMEMBERED:
            self.older, self.memo = self.memo, {}
        return out


@lru_cache(maxsize=2)
def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """Built once per worker."""
    return Encoder(path, special_as_text)


def _in_order(source: DataFrame) -> list[int] | None:
    """The partitions in the order of their ids if every one is in strictly ascending order by itself and none overlap, else None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last, good = None, None, True
        for batch in batches:
            if batch.num_rows:
                ids = batch.column("id").to_numpy(zero_copy_only=False) if not batch.column("id").null_count else None
                good = good and ids is not None and bool((ids[1:] > ids[:-1]).all()) and (last is None or ids[0] > last)
                if good:
                    first, last = (int(ids[0]) if first is None else first), int(ids[-1])
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([first], pa.int64()), pa.array([last], pa.int64()), pa.array([good])], names=["part", "first", "last", "good"]
        )

    if source.schema["id"].dataType.typeName() not in ("byte", "short", "integer", "long"):
        return None
    found = source.select("id").mapInArrow(run, "part int, first bigint, last bigint, good boolean").collect()  # one row per partition
    full = sorted((r.first, r.last, r.part) for r in found if r.first is not None)
    if not all(r.good for r in found) or any(a[1] >= b[0] for a, b in zip(full, full[1:])):
        return None
    return [p for _, _, p in full]


def write(docs: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text: str = "text", end: int = END, special_as_text: bool = False) -> None:
    """Encode and write all rows: files in ``folder``/records, the index in ``folder``/index."""
    source = docs.select(docs[id_col].alias("id"), body(docs, text).alias("t"))
    kind = source.schema["id"].dataType.simpleString()
    parts = _in_order(source)
    if parts is None:
        order = [F.col("id").asc_nulls_last(), F.xxhash64("t")]
        source = source.repartitionByRange(*order).sortWithinPartitions(*order)
    place = None if parts is None else {p: i for i, p in enumerate(parts)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, special_as_text)
        stop = np.array([end], enc.kind).tobytes()
        wide = len(stop)
        fs, root = pafs.FileSystem.from_uri(f"{folder}/records")
        fs.create_dir(root, recursive=True)
        own = TaskContext.get().partitionId()
        part = own if place is None else place.get(own, -1)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.bin"
        offset = nth = before = 0
        last = None
        with fs.open_output_stream(f"{root}/{name}") as out:
            for batch in batches:
                n, at, start = [], [], []
                if place is not None and batch.num_rows:
                    ids = batch.column("id").to_numpy()
                    if part < 0 or (last is not None and ids[0] <= last) or (ids[1:] <= ids[:-1]).any():
                        raise ValueError("the rows come in another order than before")
                    last = ids[-1]
                for t in batch.column("t"):
                    record = frame(enc.encode(t.as_py()) + stop)
                    out.write(record)
                    n.append((len(record) - 16) // wide)
                    at.append(offset)
                    start.append(before)
                    offset += len(record)
                    before += n[-1]
                rows = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array([part] * rows, pa.int32()), pa.array(range(nth, nth + rows), pa.int64()), pa.array([name] * rows, pa.string()),
                     pa.array(at, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array([wide] * rows, pa.int32())],
                    names=["id", "part", "nth", "file", "offset", "start_in_file", "n_tokens", "wide"],
                )
                nth += rows

    schema = f"id {kind}, part int, nth bigint, file string, offset bigint, start_in_file bigint, n_tokens bigint, wide int"
    with bounded_batches(docs.sparkSession):
        source.mapInArrow(run, schema).write.parquet(f"{folder}/index")


def index(spark: SparkSession, folder: str) -> DataFrame:
    """The index with ``start``, the ids in all records before: totals of files summed up, one row per file."""
    rows = spark.read.parquet(f"{folder}/index")
    files = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = files.select(F.col("part").alias("p"), (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    return rows.join(F.broadcast(before), rows.part == before.p).withColumn("start", F.col("before") + F.col("start_in_file")).drop("p", "before", "start_in_file")


def read_back(spark: SparkSession, folder: str, shuffled: bool = False) -> DataFrame:
    """Records by the index: id, start, n_tokens, ids (unsigned 32-bit integers as bytes). ``shuffled`` reads them in a hashed order."""
    rows = index(spark, folder)
    if shuffled:
        rows = rows.orderBy(F.xxhash64("file", "nth"))
    source = rows.select("id", "start", "n_tokens", "file", "offset", "wide")
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(f"{folder}/records")
        name, handle = None, None
        for batch in batches:
            for piece in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                got = []
                for file, offset, n, wide in zip(*(piece.column(c).to_pylist() for c in ("file", "offset", "n_tokens", "wide"))):
                    if file != name:
                        if handle is not None:
                            handle.close()
                        name, handle = file, fs.open_input_file(f"{root}/{file}")
                    handle.seek(offset)
                    ids = unframe(handle.read(16 + n * wide))
                    got.append(ids if wide == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [piece.column("id"), piece.column("start"), piece.column("n_tokens"), pa.array(got, pa.binary())], names=["id", "start", "n_tokens", "ids"]
                )
        if handle is not None:
            handle.close()

    return source.mapInArrow(run, f"id {kind}, start bigint, n_tokens bigint, ids binary")
