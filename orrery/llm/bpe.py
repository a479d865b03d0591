"""Byte-level BPE with a two-tier lookup.

A pre-token that is a vocabulary entry is found by a minimal perfect hash; any other is merged pair by pair with a heap over
linked bytes. The hash is built in levels: keys that share no slot of a level settle there, the rest go on to the next one;
the rank of a settled slot's bit is its place, where the entry and its id are stored; the entry is compared with the key.

By the usual pattern a space between characters that aren't white space begins a new pre-token, so texts are encoded word by
word, and a worker remembers the ids of the words it has met, up to a number of bytes; texts with other white space are cut by the pattern
as a whole. A batch is worked off and given on in slices, so a worker never holds the ids of a whole batch.

Defined cases: a null text is empty and has no ids. Texts of any length are encoded whole. Every byte sequence can be
encoded, since every single byte is an entry. An empty table gives no rows; other columns, whatever their names, don't matter.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator, Mapping
from functools import lru_cache
from itertools import chain, pairwise
from struct import pack

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_LEVEL_PATTERN, at_work, body, cut_alone, give_back, mix, passes, spaced, string_buffers

#: Bytes after which a worker's memo of ids is set aside; the one set aside before is forgotten then.
REMEMBERED = 48 << 20
#: Bytes of a word in the memo besides its characters and its ids: the heads of both objects and the place in the dictionary.
ENTRY_BYTES = 128
#: Characters of texts that are split and looked up together, and bytes of a slice of a batch; a longer text is a group and a slice of its own.
GROUP_CHARS = 1 << 20


class PerfectHash:
    """Minimal perfect hash from byte strings to 0 .. n-1, by levels of bits."""

    LOAD = 2.0
    #: Levels after which the hashes must be equal; then all begins anew with another seed.
    MOST = 64

    def __init__(self, keys: list[bytes]):
        if len(set(keys)) < len(keys):
            raise ValueError("keys repeat")
        for seed in range(8):
            if self._build(keys, seed):
                return
        raise ValueError("no perfect hash found")

    def _build(self, keys: list[bytes], seed: int) -> bool:
        self.seed = seed
        left = self._hashes(keys)
        self.levels: list[np.ndarray] = []
        self.ranks: list[np.ndarray] = []
        base = 0
        while len(left):
            if len(self.levels) == self.MOST:
                return False
            slots = max(2, int(self.LOAD * len(left)))
            at = self._slot(left, len(self.levels), slots)
            alone = np.bincount(at, minlength=slots) == 1
            self.levels.append(alone)
            self.ranks.append(base + np.cumsum(alone) - 1)
            base += int(alone.sum())
            left = left[~alone[at]]
        self.size = base
        return True

    def _hashes(self, keys: list[bytes]) -> np.ndarray:
        return np.array([xxhash.xxh64_intdigest(k, self.seed) for k in keys], dtype=np.uint64)

    @staticmethod
    def _slot(hashes: np.ndarray, level: int, slots: int) -> np.ndarray:
        return (mix(hashes + np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(slots)).astype(np.int64)

    def places(self, keys: list[bytes]) -> np.ndarray:
        """A place for each key; a key that isn't in the set gets any place, or -1."""
        hashes = self._hashes(keys)
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks)):
            if not len(todo):
                break
            at = self._slot(hashes[todo], level, len(bits))
            hit = bits[at]
            out[todo[hit]] = ranks[at[hit]]
            todo = todo[~hit]
        return out


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern)
        self.bytes_of = {i: t for t, i in ranks.items()}
        entries = list(ranks)
        self.two = [ranks.get(bytes(divmod(p, 256))) for p in range(1 << 16)]
        self.hash = PerfectHash(entries)
        #: By place: the entry, and its id as bytes.
        self.entry: list[bytes] = [b""] * len(entries)
        self.found: list[bytes] = [b""] * len(entries)
        for place, token in zip(self.hash.places(entries).tolist(), entries):
            self.entry[place], self.found[place] = token, pack("<I", ranks[token])
        self.by_word = pattern == BYTE_LEVEL_PATTERN
        #: Ids, as bytes, of words and pre-tokens met before; None for words that can't be cut alone.
        self.memo: dict[str, bytes | None] = {}
        self.older: dict[str, bytes | None] = {}
        #: Bytes of the memo, about.
        self.held = 0

    def merge(self, piece: bytes) -> bytes:
        """Ids of a piece, four bytes each: the pair of lowest rank merges first, the leftmost of equal ones."""
        n = len(piece)
        bits = n.bit_length()
        mask = (1 << bits) - 1
        after = list(range(1, n + 1))  # of a live part, where it ends; of a part merged into another, -1
        before = list(range(-1, n))
        rank, push, pop = self.ranks.get, heapq.heappush, heapq.heappop
        two = self.two
        heap = [(r << bits | i) << bits | i + 2 for i, (a, b) in enumerate(pairwise(piece)) if (r := two[a << 8 | b]) is not None]
        heapq.heapify(heap)
        while heap:
            x = pop(heap)
            i, stop = x >> bits & mask, x & mask
            j = after[i]
            if j < 0 or j >= n or after[j] != stop:
                continue
            after[i], after[j] = stop, -1
            if stop < n:
                before[stop] = i
                end = after[stop]
                if (r := rank(piece[i:end])) is not None:
                    push(heap, (r << bits | i) << bits | end)
            h = before[i]
            if h >= 0 and (r := rank(piece[h:stop])) is not None:
                push(heap, (r << bits | h) << bits | stop)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return pack(f"<{len(out)}I", *out)

    def lookup(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of distinct pre-tokens: whole entries by the perfect hash, the rest by merging."""
        texts = list(pieces)
        keys = [p.encode() for p in texts]
        return {t: self.found[p] if p >= 0 and self.entry[p] == k else self.merge(k) for t, k, p in zip(texts, keys, self.hash.places(keys).tolist())}

    def _know(self, some: set[str]) -> set[str]:
        """What of ``some`` isn't in the memo, once what was set aside is taken back."""
        new = some.difference(self.memo)
        if new and self.older:
            known = new.intersection(self.older)
            self._remember({w: self.older[w] for w in known})
            new -= known
        return new

    def _remember(self, words: Mapping[str, bytes | None]) -> None:
        self.memo.update(words)
        self.held += sum(ENTRY_BYTES + len(w) + len(i or b"") for w, i in words.items())

    def _learn(self, words: set[str]) -> None:
        cut = {w: self.split.findall(w) for w in words if cut_alone(w)}
        self._remember(dict.fromkeys(words - cut.keys()))
        pieces = set(chain.from_iterable(cut.values()))
        get = {p: i for p in pieces if (i := self.memo.get(p) or self.older.get(p)) is not None}
        new = self.lookup(pieces.difference(get))
        # White space within a word is a pre-token, but no word that can be cut alone.
        self._remember({p: i for p, i in new.items() if cut_alone(p) and p not in cut})
        get |= new
        self._remember({w: b"".join(map(get.__getitem__, found)) for w, found in cut.items()})

    def encode_all(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """Ids of each text; texts of together up to ``GROUP_CHARS`` characters are looked up at a time."""
        group, size = [], 0
        for text in texts:
            if group and size + len(text) > GROUP_CHARS:
                yield from self._encode_group(group)
                group, size = [], 0
            group.append(text)
            size += len(text)
        if group:
            yield from self._encode_group(group)

    def _encode_group(self, texts: list[str]) -> Iterator[np.ndarray]:
        split = [spaced(t) if self.by_word and t and "\0" not in t else None for t in texts]
        if self.held > REMEMBERED:
            self.older, self.memo, self.held = self.memo, {}, 0
        if new := self._know(set().union(*filter(None, split))):
            self._learn(new)
        get = self.memo.__getitem__
        for text, words in zip(texts, split):
            parts = list(map(get, words)) if words else [None]
            if None in parts:
                pieces = self.split.findall(text)
                parts = list(map(self.lookup(set(pieces)).__getitem__, pieces))
            yield np.frombuffer(b"".join(parts), "<u4")

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text])).tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """The encoder of a rank file, built once per worker."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
    return Encoder(ranks, pattern)


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of up to ``GROUP_CHARS`` bytes of their texts ``t``, or of one row; what is free after each batch goes back to the system."""
    for batch in batches:
        _, offsets = string_buffers(batch.column("t"))
        for i, j in passes(offsets, GROUP_CHARS):
            yield batch.slice(i, j - i)
        give_back()


def _lists(ids: list[np.ndarray]) -> pa.Array:
    """An array of lists of int; ``ids`` isn't empty."""
    ends = np.cumsum([0, *map(len, ids)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids).view(np.int32)))


def tokenise(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, ids (array of int)."""
    source = docs.select(docs[id_col].alias("id"), body(docs, text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("bpe", encoder.cache_clear)
        enc = encoder(path, pattern)
        for batch in _slices(batches):
            ids = _lists(list(enc.encode_all(x.as_py() for x in batch.column("t"))))
            yield pa.RecordBatch.from_arrays([batch.column("id"), ids], names=["id", "ids"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, ids array<int>")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text: str = "text", with_ids: bool = False, **more: F.Column) -> DataFrame:
    """Per row: id, the columns ``more``, n_tokens, ids_sha256 (of the decimal ids, comma-joined), decoded_sha256 (of the decoded bytes), and the ids if asked for."""
    source = docs.select(docs[id_col].alias("id"), *[c.alias(k) for k, c in more.items()], body(docs, text).alias("t"))
    kept = ["id", *more]
    types = {f.name: f.dataType.simpleString() for f in source.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("bpe", encoder.cache_clear)
        enc = encoder(path, pattern)
        sha, decimal = hashlib.sha256, {i: str(i) for i in enc.bytes_of}.__getitem__
        for batch in _slices(batches):
            n, coded, decoded, all_ids = [], [], [], []
            for found in enc.encode_all(x.as_py() for x in batch.column("t")):
                ids = found.tolist()
                n.append(len(ids))
                coded.append(sha(",".join(map(decimal, ids)).encode()).hexdigest())
                decoded.append(sha(enc.decode(ids)).hexdigest())
                if with_ids:
                    all_ids.append(found)
            columns = {k: batch.column(k) for k in kept} | {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(coded, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
            if with_ids:
                columns["ids"] = _lists(all_ids)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = ", ".join([f"{k} {types[k]}" for k in kept] + ["n_tokens bigint, ids_sha256 string, decoded_sha256 string"] + ["ids array<int>"] * with_ids)
    return source.mapInArrow(run, schema)
