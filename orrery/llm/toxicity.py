"""Toxicity by a weighted lexicon, matched with Aho-Corasick after folding.

Folding makes look-alike letters of other scripts, accented letters and digits or signs that stand for letters into plain letters; ``l``
becomes ``i``, since 1 stands for both. Digits and signs of words without any letter stay digits. Everything else separates words, so a
folded text is words between single spaces.
The lexicon holds the folded words that come in clearly more of the toxic than of the clean training texts, weighted by the
logarithm of the ratio of their shares. A hit doesn't count inside an exception phrase: a word pair around a lexicon word
that enough clean training texts have, and no toxic one, to be unlikely by chance given the word. The summed weight, per text and per
word, enters a logistic model.

All words and phrases that pass the tests are kept, as a table in the shared folder from which each worker builds its automaton; none
pass through the driver. Only the two-feature model is bounded, by ``SAMPLE`` labelled texts (those of least hash), of which the driver
gets two numbers and the label each. Word counts cover all labelled training texts.

Defined cases: a null or empty text has no hits and gets the lowest score; a null label is left out; without training
texts of both labels every score is 0; an empty table gives no rows. Texts of any length are read whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from math import log1p

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import body, crc_remainder, forget, keep

SAMPLE = 20000
#: Least texts with a lexicon word, least log ratio of shares, least chi-square.
MIN_TEXTS, MIN_WEIGHT, MIN_CHI = 3, 1.5, 15.0
#: Clean texts that an exception phrase comes in at least, and how likely they may be by chance.
MIN_CLEAN, CHANCE = 3, 0.01
#: Labelled ids that are broadcast, some 60 bytes each.
BROADCAST_LABELS = 1 << 20
#: Files that a worker reads to build its automaton.
LEXICON_FILES = 4
THRESHOLD = 0.7

# Letters of other scripts, digits and signs, and the letters they look like.
_LOOK_ALIKE = "аaвbсcеeнhкkмmоoрpтtуyхxіiјjѕsԁdαaβbεeιiκkνvοoρpτtυuχx"
_STANDS_FOR = "0o1i3e4a5s7t8b9g@a$s!i|i"

_PLAIN = {ord(k): v for pairs in (_LOOK_ALIKE, _STANDS_FOR) for k, v in zip(pairs[::2], pairs[1::2])} | {ord("l"): "i"}
_WORD = re.compile(r"[^\W_]+")


#: Words of digits and signs alone.
_BARE = re.compile(r"(?<![^\W_]|[$@!|])[0-9$@!|]+(?![^\W_]|[$@!|])")
_SIGNS = str.maketrans("$@!|", "    ")


def fold(text: str) -> list[str]:
    """Folded words. Signs and digits stand for letters in words that hold a letter; ``!`` and ``|`` only between letters or digits."""
    text = text.casefold()
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    text = re.sub(r"(?<![^\W_])[!|]|[!|](?![^\W_])", " ", text)
    out, at = [], 0
    for m in _BARE.finditer(text):
        out += [text[at : m.start()].translate(_PLAIN), m.group().translate(_SIGNS)]
        at = m.end()
    return _WORD.findall("".join([*out, text[at:].translate(_PLAIN)]))


def _train_rows(docs: DataFrame, labels: DataFrame, held: F.Column, id_col: str, text: str, label: str) -> DataFrame:
    marks = keep(labels.filter(labels[label].isNotNull()).groupBy(labels[id_col].alias("lid")).agg(F.max(labels[label]).cast("int").alias("y")), "marks")
    # Labels are narrow: as long as they are few enough they go to the texts, else texts and labels are dealt out by id.
    side = F.broadcast(marks) if marks.count() <= BROADCAST_LABELS else marks.hint("merge")
    source = docs.filter(~held).select(docs[id_col].alias("id"), body(docs, text).alias("t"))
    rows = keep(source.join(side, source.id == marks.lid).select("id", "t", "y"), "labelled")
    forget(marks)
    return rows


def _count(rows: DataFrame, units: str, lexicon: Lexicon | None = None) -> DataFrame:
    """(unit, toxic, clean): texts of each label that have a word, or a pair of words with a lexicon word in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = lexicon.weights if lexicon else {}
        for batch in batches:
            n: dict[tuple[str, int], int] = {}
            for t, y in zip(batch.column("t"), batch.column("y").to_pylist()):
                words = fold(t.as_py())
                found = set(words) if units == "words" else {f"{a} {b}" for a, b in zip(words, words[1:]) if a in terms or b in terms}
                for u in found:
                    n[u, y] = n.get((u, y), 0) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in n], pa.string()), pa.array([k[1] for k in n], pa.int32()), pa.array(n.values(), pa.int64())], names=["unit", "y", "n"]
            )

    counted = rows.mapInArrow(run, "unit string, y int, n bigint")
    return counted.groupBy("unit").agg(*[F.coalesce(F.sum(F.when(F.col("y") == v, F.col("n"))), F.lit(0)).alias(c) for c, v in (("toxic", 1), ("clean", 0))])


@lru_cache(maxsize=8)
def _stored(folder: str) -> dict[str, float]:
    """(unit, w) rows of a stored table, in the order of the units."""
    fs, root = pafs.FileSystem.from_uri(folder)
    table = pq.read_table(root, filesystem=fs, columns=["unit", "w"])
    return dict(sorted(zip(table["unit"].to_pylist(), table["w"].to_pylist())))


@lru_cache(maxsize=2)
def _machine(words: str, phrases: str | None) -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for w, v in _stored(words).items():
        machine.add_word(f" {w} ", (v, len(w) + 2))
    for p in _stored(phrases) if phrases else ():
        machine.add_word(f" {p} ", (0.0, len(p) + 2))
    if len(machine):
        machine.make_automaton()
    return machine


class Lexicon:
    """Weighted words and exception phrases in stored tables; none without ``words``."""

    def __init__(self, words: str | None, phrases: str | None = None):
        self.words, self.phrases_at = words, phrases

    @property
    def weights(self) -> dict[str, float]:
        return _stored(self.words) if self.words else {}

    @property
    def phrases(self) -> list[str]:
        return list(_stored(self.phrases_at)) if self.phrases_at else []

    def hits(self, words: list[str]) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the lexicon words outside exception phrases, as places in the folded text with a space at each end."""
        machine = _machine(self.words, self.phrases_at) if self.words else ()
        if not words or not len(machine):
            return []
        hits, spans = [], []
        for end, (weight, length) in machine.iter(f" {' '.join(words)} "):
            (hits if weight else spans).append((end - length + 1, end, weight))
        if spans and hits:
            starts, ends = np.array([s[0] for s in spans]), np.maximum.accumulate(np.array([s[1] for s in sorted(spans)]))
            starts.sort()
            at = np.searchsorted(starts, [h[0] for h in hits], side="right") - 1
            hits = [h for h, i in zip(hits, at) if i < 0 or ends[i] < h[1]]
        return hits

    def features(self, text: str) -> tuple[float, float, int]:
        """(log of the weight per text, weight per 100 words, hits that count)."""
        words = fold(text)
        hits = self.hits(words)
        total = sum(h[2] for h in hits)
        return log1p(total), min(100.0 * total / max(len(words), 1), 100.0), len(hits)


def learn(rows: DataFrame) -> tuple[Lexicon, np.ndarray]:
    """The lexicon and the logistic weights (constant, per text, per 100 words) from rows (id, t, y)."""
    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}  # two rows
    a, b = sizes.get(1, 0), sizes.get(0, 0)
    if not a or not b:
        return Lexicon(None), np.array([-np.inf, 0.0, 0.0])
    tox, cln, n = F.col("toxic").cast("double"), F.col("clean").cast("double"), float(a + b)
    weight = F.log((tox + 0.5) / (a + 1.0)) - F.log((cln + 0.5) / (b + 1.0))
    chi = n * F.pow(tox * (b - cln) - cln * (a - tox), F.lit(2.0)) / ((tox + cln) * (n - tox - cln) * float(a) * float(b))
    good = (tox >= MIN_TEXTS) & (F.col("w") >= MIN_WEIGHT) & ((tox + cln < n) & (F.coalesce(chi, F.lit(0.0)) >= MIN_CHI))
    words = keep(_count(rows, "words").withColumn("w", weight).filter(good).repartition(LEXICON_FILES), "lexicon")
    only_words = Lexicon(words._kept_at)
    pairs = _count(rows, "pairs", only_words).filter((tox == 0) & (cln >= MIN_CLEAN))
    # Of a phrase's lexicon words the likeliest toxic one decides whether so many clean texts and no toxic one are chance.
    share = words.select(F.col("unit").alias("word"), (tox / (tox + cln)).alias("share"))
    halves = pairs.select("unit", "clean", F.explode(F.split("unit", " ")).alias("word")).join(share, "word").groupBy("unit").agg(F.max("clean").alias("clean"), F.max("share").alias("share"))
    sure = F.pow(1.0 - F.col("share"), F.col("clean")) < CHANCE
    phrases = keep(halves.filter(sure).select("unit", F.lit(0.0).alias("w")).repartition(LEXICON_FILES), "phrases")
    lexicon = Lexicon(words._kept_at, phrases._kept_at)
    # Narrow rows alone are put in order: twice the sample by hash, in expectation, then its least ones.
    rank = F.xxhash64("id", "t")
    some = rows.withColumn("rank", rank).filter(F.pmod("rank", F.lit(1 << 53)) < F.lit(min(1.0, 2.0 * SAMPLE / n) * (1 << 53)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = [lexicon.features(t.as_py()) for t in batch.column("t")]
            yield pa.RecordBatch.from_arrays([batch.column("rank"), *[pa.array([x[i] for x in f], pa.float64()) for i in (0, 1)], batch.column("y")], names=["rank", "u", "v", "y"])

    numbers = some.select("rank", "t", "y").mapInArrow(run, "rank bigint, u double, v double, y int")
    sample = numbers.orderBy(F.pmod("rank", F.lit(1 << 53)), "rank", "u", "v", "y").limit(SAMPLE).select("u", "v", "y")
    data = np.array([tuple(r) for r in sample.collect()], dtype=float)  # at most SAMPLE rows
    return lexicon, fit(data[:, :2], data[:, 2])


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps, with a small ridge on the slopes; the labels weigh alike."""
    x = np.column_stack([np.ones(len(x)), x])
    share = max(y.mean(), 1e-9)
    weight = np.where(y == 1, 0.5 / share, 0.5 / max(1 - share, 1e-9))
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (weight * (y - p)) - penalty @ b)
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    return b


def score(docs: DataFrame, lexicon: Lexicon, model: np.ndarray, id_col: str = "doc_id", text: str = "text", **more: F.Column) -> DataFrame:
    """Per row: id, the columns ``more``, n_hits and score (0 to 1)."""
    source = docs.select(docs[id_col].alias("id"), *[c.alias(k) for k, c in more.items()], body(docs, text).alias("t"))
    kept = ["id", *more]
    types = {f.name: f.dataType.simpleString() for f in source.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = [lexicon.features(t.as_py()) for t in batch.column("t")]
            u = np.array([x[:2] for x in f]).reshape(-1, 2)
            p = 1 / (1 + np.exp(-np.clip(model[0] + u @ model[1:], -700, 700)))
            p = np.where(np.isfinite(model[0]), p, 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in kept] + [pa.array([x[2] for x in f], pa.int64()), pa.array(p, pa.float64())], names=[*kept, "n_hits", "score"]
            )

    return source.mapInArrow(run, ", ".join([f"{k} {types[k]}" for k in kept] + ["n_hits bigint, score double"]))


def held_out_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 3, fold_out: int = 1) -> DataFrame:
    """Learn from labelled rows outside the held-out fold, and score all rows."""
    held = crc_remainder(docs[id_col], folds) == fold_out
    rows = _train_rows(docs, labels, held, id_col, text, label)
    lexicon, model = learn(rows)
    forget(rows)
    return score(docs, lexicon, model, id_col, text, held_out=held)
