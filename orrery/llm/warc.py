"""WARC archives written by Spark's text sink and read back through boundary chains.

Writing: a record is its header, an empty line and the payload; the sink's line separator is the two line ends that close a
record. Equal payloads of at least ``least`` bytes are archived once: the row with the largest page id (of several, the one with
the largest url) is the response, the others are revisit records without a payload. Decisions are taken on narrow rows of page id,
url and digest, so nothing depends on the order in which a scan gives its rows; rows equal in all three are told apart by number alone.

Reading: the files are cut into splits. A task finds every place in its split that looks like a record's start, also inside
payloads, and its successor by the stated length; it follows successors within the split to where they leave it. Pointer
jumping over the leaving places, from offset 0 of each file, tells the one true entry of each split, and a second
pass reads from there. So a record's start inside a payload is never reached, and is not returned.

Defined cases: a null payload is empty, a null url too; a null page id ranks below all others; of rows with the largest page id and
equal payloads exactly one is the response; payloads of any length are read whole; an empty table gives no rows. Other columns, whatever
their names, don't matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import body, bounded_batches, forget, keep, scratch

LEAST = 1000
SPLIT = 8 << 20
SALTS = 16
END = "\r\n\r\n"
_MAGIC = b"WARC/1.1\r\n"
_START = re.compile(rb"WARC/1\.1\r\n")
_LENGTH = re.compile(rb"\r\nContent-Length: ([0-9]+)\r\n")
#: Bytes of a header. Ours has fixed fields and a url, which may be longer; then the reader reads on.
_HEADER = 1 << 12


def _decisions(narrow: DataFrame, least: int) -> DataFrame:
    """(page_id, url, sha, refers_to, again): what is a revisit, and what is a response that ``again`` equal rows more revisit."""
    big = keep(narrow.filter(F.col("size") >= least).groupBy("page_id", "url", "sha").agg(F.count("*").alias("rows")), "payloads")
    top = big.groupBy("sha").agg(F.max(F.struct("page_id", "url")).alias("top"), F.sum("rows").alias("n")).filter("n > 1")
    # A group of copies is dealt out over salts, for each of which its winner comes once.
    salted = top.select(F.col("sha").alias("w_sha"), "top", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    own = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
    met = big.withColumn("own", own).join(salted, (F.col("sha") == F.col("w_sha")) & (F.col("own") == F.col("salt")))
    first = F.col("page_id").eqNullSafe(F.col("top.page_id")) & (F.col("url") == F.col("top.url"))
    out = met.select("page_id", "url", "sha", F.col("top.page_id").alias("refers_to"), F.when(first, F.col("rows") - 1).alias("again")).filter("again IS NULL OR again > 0")
    out = keep(out, "decisions")
    forget(big)
    return out


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST) -> None:
    payload = body(pages, html)
    rows = pages.select(
        pages[id_col].alias("page_id"), F.regexp_replace(F.coalesce(pages[url].cast("string"), F.lit("")), r"[\x00-\x20\x7f]+", "%20").alias("url"),
        payload.alias("payload"), F.sha1(payload.cast("binary")).alias("sha"), F.octet_length(payload).cast("long").alias("size"),
    )
    decided = _decisions(rows.select("page_id", "url", "sha", "size"), least)
    d = decided.select(*[F.col(c).alias(f"d_{c}") for c in ("page_id", "url", "sha")], "refers_to", "again", F.lit(True).alias("met"))
    same = F.col("page_id").eqNullSafe(F.col("d_page_id")) & (F.col("url") == F.col("d_url")) & (F.col("sha") == F.col("d_sha"))
    joined = rows.join(d, same, "left").select("page_id", "url", "payload", "sha", "size", "refers_to", "again", (F.col("met").isNotNull() & F.col("again").isNull()).alias("revisit"))
    out = joined
    if not decided.filter("again IS NOT NULL").isEmpty():
        # Responses that equal rows repeat: one of these rows has the payload, the others are revisits.
        nth = F.explode(F.sequence(F.lit(0).cast("long"), F.col("again")))
        alike = joined.filter("again IS NOT NULL").groupBy("page_id", "url", "sha", "size", "again").agg(F.first("payload").alias("payload"))
        alike = alike.withColumn("nth", nth).withColumn("revisit", F.col("nth") > 0).withColumn("refers_to", F.col("page_id"))
        out = joined.filter("again IS NULL").unionByName(alike.drop("nth"))
    revisit = F.col("revisit")
    text_id = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    block = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), text_id,
        F.lit(">\r\nWARC-Target-URI: "), F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("sha"),
        F.lit("\r\nX-Payload-Length: "), F.col("size").cast("string"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: <urn:page:"), F.coalesce(F.col("refers_to").cast("string"), F.lit("null")), F.lit(">"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END),
    )
    with bounded_batches(pages.sparkSession):
        out.select(F.concat(header, block).alias("value")).write.option("lineSep", END).text(folder)
    forget(decided)


class _Window:
    """Bytes of a file, read forward in steps: those of a stretch, and more where they are asked for."""

    def __init__(self, handle, size: int, step: int = 1 << 20):
        self.handle, self.size, self.step, self.at, self.data = handle, size, step, 0, b""
        #: Bytes read from the file so far.
        self.read = 0

    def get(self, start: int, n: int, step: int | None = None) -> bytes:
        """Bytes from ``start``, fewer at the end of the file; what isn't held is read, with what follows up to a step."""
        stop = min(start + n, self.size)
        held = self.at + len(self.data)
        if start < self.at or stop > held:
            more = max(stop - start, self.step if step is None else step)
            keep_from = start if self.at <= start < held else None
            tail = self.data[keep_from - self.at :] if keep_from is not None else b""
            self.handle.seek(start + len(tail))
            new = self.handle.read(max(0, min(more, self.size - start) - len(tail)))
            self.read += len(new)
            self.at, self.data = start, tail + new
        return self.data[start - self.at : stop - self.at]


def _header(get: Callable[[int, int], bytes], start: int, size: int) -> tuple[bytes, int] | None:
    """(header, offset of the block), or None if no header starts there."""
    n = _HEADER
    while True:
        data = get(start, n)
        if not data.startswith(_MAGIC):
            return None
        end = data.find(b"\r\n\r\n")
        if end >= 0:
            return data[: end + 2], start + end + 4
        if start + n >= size or n > SPLIT:
            return None
        n *= 4


def _open(path: str, size: int, step: int = 1 << 20) -> _Window:
    fs, at = pafs.FileSystem.from_uri(path)
    return _Window(fs.open_input_file(at), size, step)


def _exits(view: _Window, low: int, high: int) -> tuple[list[int], list[int]]:
    """Candidates of a split and where their chains leave it (-1: the chain breaks).

    The split is read once; beyond it only headers that cross its end, and the line ends after records that do, are read.
    """
    data = view.get(low, high - low + len(_MAGIC) - 1, 0)
    far = _Window(view.handle, view.size, 0)

    def get(start: int, n: int) -> bytes:
        stop = min(start + n, view.size)
        return data[start - low : stop - low] if stop <= low + len(data) else far.get(start, n)

    def successor(start: int) -> int | None:
        # Most headers end within the split's bytes, even if the bytes asked for don't.
        near = data[start - low : start - low + _HEADER]
        end = near.find(b"\r\n\r\n")
        found = (near[: end + 2], start + end + 4) if end >= 0 else _header(get, start, view.size)
        length = found and _LENGTH.search(found[0])
        if not length:
            return None
        stop = found[1] + int(length.group(1))
        return stop + 4 if stop + 4 <= view.size and get(stop, 4) == b"\r\n\r\n" else None

    starts = [low + m.start() for m in _START.finditer(data) if low + m.start() < high]
    after = [successor(s) for s in starts]
    exits: dict[int, int] = {}
    for s, nxt in zip(reversed(starts), reversed(after)):
        exits[s] = -1 if nxt is None else nxt if nxt >= high else exits.get(nxt, -1)
    view.read += far.read
    return starts, [exits[s] for s in starts]


def _splits(spark: SparkSession, folder: str, split: int) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", F.col("length").alias("size")).filter("size > 0")
    cut = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split).cast("long"))).alias("low")
    return files.select("path", "size", cut).withColumn("high", F.least(F.col("low") + split, F.col("size")))


def entries(spark: SparkSession, folder: str, split: int = SPLIT) -> DataFrame:
    """(path, size, entry, high): the first record of each split that starts one, found by pointer jumping."""
    splits = keep(_splits(spark, folder, split), "splits")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                starts, exits = _exits(_open(row["path"], row["size"]), row["low"], row["high"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["path"]] * len(starts), pa.string()), pa.array(starts, pa.int64()), pa.array(exits, pa.int64())], names=["path", "node", "exit"]
                )

    # Rows are few and each stands for many bytes, so they are dealt out by number, not by size.
    n_splits = splits.count()
    nodes = keep(splits.repartition(max(1, n_splits)).mapInArrow(scan, "path string, node bigint, exit bigint"), "candidates")
    # Only places that a chain leaves to, and file starts, can be entries.
    known = nodes.filter("exit >= 0").select("path", F.col("exit").alias("node")).distinct()
    jump = keep(nodes.join(known, ["path", "node"], "left_semi").unionByName(nodes.filter("node = 0")).distinct(), "jumps")
    reached = splits.select("path").distinct().withColumn("node", F.lit(0).cast("long"))
    most = splits.groupBy("path").count().agg(F.max("count")).first()[0] or 0  # one number
    done = [nodes, jump]
    for _ in range(int(most - 1).bit_length() if most else 0):
        step = reached.join(jump, ["path", "node"]).filter("exit >= 0").select("path", F.col("exit").alias("node"))
        reached = keep(reached.unionByName(step).distinct(), "reached")
        onward = jump.select("path", F.col("node").alias("exit"), F.col("exit").alias("far"))
        jump = keep(jump.join(onward, ["path", "exit"]).select("path", "node", F.col("far").alias("exit")), "jumps")
        done += [jump, reached]
    inside = splits.select(F.col("path").alias("p"), "size", "low", "high")
    slot = (F.floor(F.col("node") / split) * split).alias("low0")
    at = F.col("path") == F.col("p")
    out = keep(reached.select("path", F.col("node").alias("entry"), slot).join(inside, at & (F.col("low0") == F.col("low"))).select("path", "size", "entry", "high"), "entries")
    forget(splits, *done)
    return out


_FIELD = {k: re.compile(rb"\r\n" + v + rb"\r\n") for k, v in {
    "type": rb"WARC-Type: ([a-z]+)", "page": rb"WARC-Record-ID: <urn:page:([^>]*)>", "url": rb"WARC-Target-URI: ([^\r]*)",
    "sha": rb"WARC-Payload-Digest: sha1:([0-9a-f]+)", "size": rb"X-Payload-Length: ([0-9]+)", "refers": rb"WARC-Refers-To: <urn:page:([^>]*)>",
}.items()}


def read(spark: SparkSession, folder: str, split: int = SPLIT, payloads: bool = True) -> DataFrame:
    """One row per record: page_id (text, null if it was), url, record_type, payload_digest, payload_bytes, refers_to, payload.

    A response's payload is held against its stated digest; a revisit has none.
    """

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()),
                            ("payload_bytes", pa.int64()), ("refers_to", pa.string())] + ([("payload", pa.binary())] if payloads else []))
        for batch in batches:
            for row in batch.to_pylist():
                view, at, out, held = _open(row["path"], row["size"]), row["entry"], [], 0
                while at < row["high"]:
                    head, start = _header(view.get, at, row["size"])
                    head = b"\r\n" + head
                    stop = start + int(_LENGTH.search(head).group(1))
                    data = view.get(start, stop - start)
                    get = {k: (m.group(1).decode() if (m := p.search(head)) else None) for k, p in _FIELD.items()}
                    if get["type"] == "response" and (len(data) != int(get["size"]) or hashlib.sha1(data).hexdigest() != get["sha"]):
                        raise ValueError(f"broken record at {at} of {row['path']}")
                    ids = [None if get[k] in (None, "null") else get[k] for k in ("page", "refers")]
                    out.append((ids[0], get["url"], get["type"], get["sha"], int(get["size"]), ids[1]) + ((data,) if payloads else ()))
                    held += len(data) if payloads else 100
                    at = stop + 4
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    fields = "page_id string, url string, record_type string, payload_digest string, payload_bytes bigint, refers_to string" + (", payload binary" if payloads else "")
    found = entries(spark, folder, split)
    return found.repartition(max(1, found.count())).mapInArrow(records, fields)


def archive(pages: DataFrame, folder: str | None = None, **columns) -> DataFrame:
    """Write ``pages`` and read the archives back, without payloads."""
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    write(pages, folder, **columns)
    return read(spark, folder, payloads=False)
