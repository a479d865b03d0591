"""Quality rules over the words of a text, with repetition found in a suffix array.

The suffixes of the words of a batch of texts are sorted by prefix doubling; a symbol is a word of one text, so suffixes of
different texts share no prefix. The common prefix of neighbours bounds each longest-common-prefix interval, whose prefix is
a maximal repeated substring. The base measure is the union of the repeats of at least ``window`` words. The verdict is stricter: it
limits the union of shorter repeats too, and the longest repeat, both by their share of the text's words.

Defined cases: a null text has no words; texts with fewer than ``min_words`` words fail; an empty table gives no rows; other
columns, whatever their names, don't matter. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, at_work, body, fresh, passes, string_buffers

WINDOW = 8
MIN_WORDS = 20
MAX_PERCENT = 30
#: Words of the shortest repeat that counts for the verdict.
PASSAGE = 5
#: Percent of a text's words that repeats may cover, and that the longest one may have.
MAX_COVERED, MAX_LONGEST = 40, 20

_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1


def longest_repeats(row: np.ndarray, word: np.ndarray) -> np.ndarray:
    """For each word, the most words from there that occur elsewhere in its text too."""
    n = len(word)
    if n == 0:
        return np.zeros(0, np.int64)
    ids = np.unique(word, return_inverse=True)[1]
    rank = np.unique(row.astype(np.int64) * (int(ids.max()) + 1) + ids, return_inverse=True)[1].astype(np.int64)
    levels = [rank]
    step = 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - step)] = rank[step:] + 1
        key = rank * (n + 1) + ahead
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh_rank = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = fresh_rank
        if fresh_rank[-1] == n - 1:
            break
        levels.append(rank)
        step *= 2
    # Common prefixes of neighbours in the suffix array, by falling powers of two.
    a, b = order[:-1], order[1:]
    common = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        at, bt = a + common, b + common
        inside = (at < n) & (bt < n)
        level = levels[k]
        same = inside & (level[np.minimum(at, n - 1)] == level[np.minimum(bt, n - 1)])
        common += same * (1 << k)
    best = np.zeros(n, np.int64)
    best[a] = common
    np.maximum.at(best, b, common)
    return best


def covered(best: np.ndarray, least: int) -> np.ndarray:
    """Whether each word lies in a repeat of at least ``least`` words; ``best`` is from :func:`longest_repeats`."""
    edge = np.zeros(len(best) + 1, np.int64)
    hit = np.flatnonzero(best >= least)
    edge[hit] += 1
    np.add.at(edge, hit + best[hit], -1)
    return np.cumsum(edge[:-1]) > 0


def _measure(raw: np.ndarray, offsets: np.ndarray, window: int) -> dict[str, np.ndarray]:
    rows = len(offsets) - 1
    words = Words(raw, offsets)
    best = longest_repeats(words.row, words.hash)
    longest = np.zeros(rows, np.int64)
    np.maximum.at(longest, words.row, best)
    owner = np.repeat(np.arange(rows), np.diff(offsets))
    # Code points before each byte, of which spaces between words don't count.
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return {
        "n_words": words.count,
        "word_chars": np.bincount(words.row, weights=points[words.start + words.length] - points[words.start], minlength=rows).astype(np.int64),
        "n_symbols": np.bincount(owner, weights=_SYMBOL[raw], minlength=rows).astype(np.int64),
        "n_repeat_words": np.bincount(words.row, weights=covered(best, window), minlength=rows).astype(np.int64),
        "n_passage_words": np.bincount(words.row, weights=covered(best, PASSAGE), minlength=rows).astype(np.int64),
        "longest_repeat": longest,
    }


def _dup_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def measures(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, keep_columns: bool = False) -> DataFrame:
    """One row per row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_passage_words, longest_repeat.

    With ``keep_columns`` all columns of ``docs`` stay, in the struct ``row``.
    """
    source = docs.select(docs[id_col].alias("id"), body(docs, text).alias("t"), *([F.struct(*docs.columns).alias("row")] if keep_columns else []))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_passage_words", "longest_repeat"]
    kept = ["id"] + (["row"] if keep_columns else [])
    types = {f.name: f.dataType.simpleString() for f in source.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("quality")
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(batch.schema.get_field_index("t"))
            raw, offsets = string_buffers(column)
            parts = [_measure(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], window) for i, j in passes(offsets)]
            out = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
            out["n_dup_lines"] = np.array([_dup_lines(x.as_py()) for x in column], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(k)) for k in kept] + [pa.array(out[k], pa.int64()) for k in names], names=kept + names
            )

    return source.mapInArrow(run, ", ".join([f"{k} {types[k]}" for k in kept] + [f"{k} bigint" for k in names]))


def base_failed(min_words: int = MIN_WORDS, max_percent: int = MAX_PERCENT) -> F.Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_percent * F.col("n_words"))


def verdict(max_covered: int = MAX_COVERED, max_longest: int = MAX_LONGEST, min_words: int = MIN_WORDS, max_percent: int = MAX_PERCENT) -> F.Column:
    """Whether a text stays: the base rules, repeats cover at most ``max_covered`` percent, and the longest has at most ``max_longest`` percent."""
    within = (100 * F.col("n_passage_words") <= max_covered * F.col("n_words")) & (100 * F.col("longest_repeat") <= max_longest * F.col("n_words"))
    return ~base_failed(min_words, max_percent) & within


def good(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    return measures(docs, id_col, text, keep_columns=True).filter(verdict()).select("row.*")
