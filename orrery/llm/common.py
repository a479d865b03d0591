"""Shared pieces: scratch tables in the cluster's shared folder, input columns, word arrays over Arrow buffers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one numpy pass handles; longer texts form a pass of their own.
PASS_BYTES = 1 << 18
#: Bytes of an Arrow batch sent to a Python worker.
BATCH_BYTES = 16 << 20
#: Characters between words, as a Java and a Python character class.
SPACE = r"[\x20\x09-\x0D]"

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


#: Folder of a session on one machine that has no spark.checkpoint.dir, such as in tests.
_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a temporary one on one machine, else an error."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append(f"file://{tempfile.mkdtemp(prefix='orrery-')}")
            atexit.register(shutil.rmtree, _LOCAL[0].removeprefix("file://"), True)
        folder = _LOCAL[0]
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, below one of this application."""
    return f"{shared_folder(spark)}/orrery-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (dots as two underscores) for a while; then they are as before."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def keep(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so a lost executor costs no recomputation; its shuffles are freed."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with bounded_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(nullable(df.schema)).parquet(path)
    out._kept_at = path
    return out


def forget(*kept: DataFrame) -> None:
    """Delete the files of tables from :func:`keep` that have no more readers."""
    for df in kept:
        remove(df.sparkSession, df._kept_at)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def bounded_batches(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """For a while, small Arrow batches, since rows may be long, and shuffles freed when a query ends."""
    return settings(
        spark, spark__sql__execution__arrow__maxBytesPerBatch=str(BATCH_BYTES), spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"
    )


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have (names are compared without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def body(df: DataFrame, text: str = "text") -> F.Column:
    return F.coalesce(df[text].cast("string"), F.lit(""))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# --- memory of workers --------------------------------------------------------------------------------------------

#: By operator, what drops the memory it keeps in this worker from task to task.
_KEPT: dict[str, Callable[[], object]] = {}


def at_work(operator: str, drop: Callable[[], object] | None = None) -> None:
    """To be called when a task begins in a worker: what other operators keep there from task to task goes, since stages are handed the same workers."""
    for other in _KEPT.keys() - {operator}:
        _KEPT.pop(other)()
        give_back()
    if drop is not None:
        _KEPT[operator] = drop


def give_back() -> None:
    """Memory that is free goes back to the system; else it stays with the worker."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


# --- bytes and words in numpy -------------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_GOLDEN = 0x9E3779B97F4A7C15
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_GOLDEN))
#: The same with capital letters A-Z taken for small ones.
_BYTE_LOWER = np.concatenate([_BYTE[:65], _BYTE[97:123], _BYTE[91:]])
_BASE = 0xD1342543DE82EF95
#: Powers of the base and of its inverse, as far as needed so far.
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            row = np.full(n + (n >> 2), base, dtype=np.uint64)
            row[0] = 1
            _POWERS[i] = np.multiply.accumulate(row)
    return _POWERS[0][:n], _POWERS[1]


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of length rows + 1) of an Arrow string or binary column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def passes(offsets: np.ndarray, limit: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges (from, to) of at most ``limit`` bytes, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of consecutive texts: byte starts, lengths, hashes and the row each belongs to.

    The hash of a word is a polynomial of its bytes' codes modulo 2^64, from sums over all bytes before its start and its end.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lower: bool = False):
        n, rows = len(raw), len(offsets) - 1
        solid = np.zeros(n + 1, bool)
        np.logical_not(_IS_SPACE[raw], out=solid[:n])
        edge = np.empty(n + 1, bool)
        edge[0], edge[1:] = solid[0], solid[1:] != solid[:-1]
        at = np.flatnonzero(edge)
        start, stop = at[0::2], at[1::2]
        # A text may end and the next one begin without a space between them.
        cuts = offsets[1:-1]
        cuts = np.unique(cuts[(cuts > 0) & (cuts < n)])
        cuts = cuts[solid[cuts] & solid[cuts - 1]]
        if len(cuts):
            start, stop = np.sort(np.concatenate([start, cuts])), np.sort(np.concatenate([stop, cuts]))
        self.start, self.length = start, stop - start
        self.count = np.diff(np.searchsorted(start, offsets)).astype(np.int64)
        self.row = np.repeat(np.arange(rows), self.count)
        power, inverse = _powers(n)
        code = (_BYTE_LOWER if lower else _BYTE)[raw]
        code *= power
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(code, out=total[1:])
        value = (total[stop] - total[start]) * inverse[start]
        self.hash = mix(value + self.length.astype(np.uint64) * np.uint64(_GOLDEN))


# Fixed value: the pattern by which byte-level vocabularies of this kind cut texts; by it, words can be cut one by one.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def spaced(text: str) -> list[str]:
    """Words with the space before them, and line ends, in turn; together they are the text, unless it has a null character."""
    return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")


def cut_alone(word: str) -> bool:
    """Whether a word from :func:`spaced` is cut by itself as it is within its text; not if white space may go on beside it."""
    return word == "\n" or bool(word) and not word[-1].isspace() and (word[0] == " " or not word[0].isspace())


def crc_remainder(doc_id: F.Column, modulus: int) -> F.Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus
