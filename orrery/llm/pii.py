"""Personal data: fixed patterns, and a linear-chain conditional random field over word-shape features.

The patterns give the base spans. The field labels the words of lines that hold a digit, an ``@`` or an ``at`` (no span can come from
others) with a kind or with none, by the shapes of a word and of telling words around it. It is trained on a small labelled table that a
rule with a fixed seed writes, and decoded by Viterbi in numpy batches. A run of words of one kind gives the items in it, if they
don't touch a base span and have what every item of their kind has (an email a name and a host around one sign, the others
their number of digits; a card that the field finds needn't pass Luhn, since it may be mistyped).

Most words are surely of no kind: their scores say so by more than any neighbours' labels could outweigh. Lines fall into short pieces at
such words, and Viterbi runs over the pieces, which gives the best labels of whole lines.

Defined cases: a null or empty text has no spans; an empty table gives no rows. Texts and lines of any length are decoded whole.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import body

KINDS = ("email", "ip", "card", "phone")
#: Padded words of one batch of the decoder, or one piece of a line.
GROUP = 1 << 15
#: Sentences of the labelled table, its seed, passes of training over it, and how often a word comes in it to be a feature.
SENTENCES, SEED, PASSES, LEAST = 700, 7, 8, 6
#: Words before and after whose telling neighbours count.
REACH = 4
#: Distinct words that a worker remembers.
REMEMBERED = 1 << 18

# The patterns of the base spans.
_PATTERN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_AT = re.compile(r"@")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_DIGIT = re.compile(r"[0-9]")
_HINT = re.compile(r"[0-9@]|\b[aA][tT]\b")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _fits(kind: str, found: str, checked: bool = True) -> bool:
    """Whether a match has what items of its kind have; a card passes Luhn if it is to be ``checked``."""
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in found.split("."))
    digits = "".join(_DIGIT.findall(found))
    return 16 <= len(digits) <= 19 and (not checked or luhn(digits)) if kind == "card" else 8 <= len(digits) <= 15


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the email pattern, sought from each sign rather than from each letter; the result is the same."""
    floor = 0
    for m in _AT.finditer(text):
        at = m.start()
        if at < floor:
            continue
        start = at
        while start > floor and _LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (found := _PATTERN["email"].match(text, start)):
            yield found.span()
            floor = found.end()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    for kind in KINDS:
        if kind == "email":
            out += [(kind, a, b) for a, b in _emails(text)]
        else:
            out += [(kind, *m.span()) for m in _PATTERN[kind].finditer(text) if _fits(kind, m.group())]
    return out


# --- the field ------------------------------------------------------------------------------------------------------


def shape(word: str) -> str:
    return re.sub(r"(.)\1+", r"\1+", re.sub(r"[^\W\d_]", "x", re.sub(r"[0-9]", "9", word)))


def features(word: str) -> list[str]:
    s, n = shape(word), len(_DIGIT.findall(word))
    names = ["bias", f"s={s}", f"head={s[:3]}", f"tail={s[-3:]}", f"n={min(n, 20)}", f"at={'@' in word}", f"dots={min(word.count('.'), 4)}", f"plus={word[:1] == '+'}"]
    return names if n else [*names, f"low={word.lower().strip('.,')}"]


def tells(word: str) -> list[str]:
    """What a word says about its neighbours; nothing for plain words that the field doesn't know."""
    bare = word.strip(".,")
    return [f"low={bare.lower()}"] if bare.isalpha() else [f"s={shape(bare)}", f"low={bare.lower()}"]


def labelled_table(n: int = SENTENCES, seed: int = SEED) -> list[tuple[list[str], list[int]]]:
    """Sentences of made-up words with made-up items: (words, labels), label 0 for none, then KINDS from 1."""
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"

    def word() -> str:
        return "".join(rng.choice(letters) for _ in range(rng.randint(2, 10)))

    def number(k: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(k))

    def card() -> str:
        d = number(15)
        return d + next(c for c in "0123456789" if luhn(d + c))

    def item(kind: int) -> str:
        if kind == 1:
            at = rng.choice(["@", " at ", " at ", " [at] ", " (at) ", " AT "])
            dot = "." if at == "@" else rng.choice([" dot ", " [dot] ", " (dot) ", " DOT ", "."])
            name = rng.choice([word(), word(), f"{word()}.{word()}", f"{word()}_{word()}", f"{word()}{number(2)}"])
            return f"{name}{at}{word()}{dot}{rng.choice(['com', 'org', 'net', 'edu', 'de', 'io'])}"
        if kind == 2:
            return ".".join(str(rng.randint(0, 255)) for _ in range(4))
        if kind == 3:
            d, by = card(), rng.choice(["", " ", "-"])
            return by.join(d[i : i + 4] for i in range(0, 16, 4))
        return rng.choice(["+{0} ({1}) {2}-{3}", "+{0} {1} {2} {3}", "({1}) {2}-{3}", "({1}) {2} {3}", "+{0}-{1}-{2}-{3}", "{1}-{2}-{3}"]).format(rng.randint(1, 9), number(3), number(3), number(4))

    def plain() -> list[str]:
        r = rng.random()
        if r < 0.7:
            return [word() + rng.choice(["", "", "", ",", "."])]
        if r < 0.8:
            # Words that items have, out of place.
            return rng.choice([["at", word()], ["at", number(2)], ["dot"], ["the", "dot", word()], [word(), "at", "the", word()], ["com"], ["net", word()], [f"@{word()}"], ["at", word() + "."]])
        return [rng.choice([number(rng.randint(1, 7)), f"{number(2)}:{number(2)}", f"{number(4)}-{number(2)}-{number(2)}", f"{number(1)}.{number(2)}", f"{number(2)}%", f"{word()}{number(2)}", f"v{number(1)}.{number(1)}.{number(1)}", f"{number(3)},{number(3)}", f"#{number(4)}", f"{number(3)}/{number(3)}"])]

    out = []
    for _ in range(n):
        words, labels = [], []
        for _ in range(rng.randint(4, 20)):
            kind = rng.choice([1, 1, 2, 3, 4]) if rng.random() < 0.2 else 0
            parts = (item(kind) + rng.choice(["", "", "", ",", "."])).split(" ") if kind else plain()
            words += parts
            labels += [kind] * len(parts)
        out.append((words, labels))
    return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis)
    return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis=axis))


class Field:
    """Weights of features (a row of labels for each), and of moves from label to label."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.index, self.weights, self.moves = index, weights, moves
        # By how much a label's neighbours may favour it over none, whatever they are.
        self.swing = (moves - moves[:, :1]).max(axis=0) + (moves - moves[:1]).max(axis=1)
        # What a telling feature adds to the words from REACH before to REACH after it; features of plain words of one and of more letters.
        self.tell: dict[str, np.ndarray] = {}
        for f, i in index.items():
            o, _, name = f.partition(":")
            if name and re.fullmatch("-?[0-9]+", o):
                self.tell.setdefault(name, np.zeros((2 * REACH + 1, len(moves))))[int(o) + REACH] = weights[i]
        self.plain = [self._sum(f for f in features(w) if not f.startswith("low=")) for w in ("x", "xx")]
        self.ids: dict[str, int] = {}
        self.own: list[np.ndarray] = []
        self.about: dict[int, np.ndarray] = {}

    def __reduce__(self):
        return Field, (self.index, self.weights, self.moves)

    def _sum(self, names: Iterable[str]) -> np.ndarray:
        return self.weights[[self.index[f] for f in names if f in self.index]].sum(axis=0)

    def _new(self, word: str) -> int:
        i = self.ids[word] = len(self.own)
        if word.isalpha():
            own, low = self.plain[len(word) > 1], self.index.get(f"low={word.lower()}")
            self.own.append(own if low is None else own + self.weights[low])
        else:
            self.own.append(self._sum(features(word)))
        found = [self.tell[f] for f in tells(word) if f in self.tell]
        if found:
            self.about[i] = sum(found)
        return i

    def scores(self, lines: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(scores of every word's labels, line of each word) of lines one after the other."""
        if len(self.own) > REMEMBERED:
            self.ids, self.own, self.about = {}, [], {}  # they come again as they are met
        known = self.ids
        ids = np.array([known[w] if w in known else self._new(w) for line in lines for w in line], np.int64)
        line = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
        some, back = np.unique(ids, return_inverse=True)
        out = np.array([self.own[i] for i in some.tolist()]).reshape(len(some), -1)[back]
        telling = np.flatnonzero(np.array([i in self.about for i in some.tolist()], bool)[back]) if len(some) else np.zeros(0, np.int64)
        if len(telling):
            table = {i: n for n, i in enumerate(sorted({int(i) for i in ids[telling]}))}
            about = np.array([self.about[i] for i in table])
            which = np.array([table[int(i)] for i in ids[telling]])
            for n, o in enumerate(range(-REACH, REACH + 1)):
                at = telling + o
                ok = (o != 0) & (at >= 0) & (at < len(ids))
                ok &= line[np.clip(at, 0, len(ids) - 1)] == line[telling]
                np.add.at(out, at[ok], about[which[ok], n])
        return out, line

    def labels(self, lines: list[list[str]]) -> list[np.ndarray]:
        """Best labels of whole lines."""
        e, line = self.scores(lines)
        label = np.zeros(len(e), np.int64)
        open_ = (e[:, 1:] + self.swing[None, 1:] >= e[:, :1]).any(axis=1)
        at = np.flatnonzero(open_)
        if len(at):
            cut = np.flatnonzero((np.diff(at) > 1) | (np.diff(line[at]) > 0)) + 1
            pieces = np.split(at, cut)
            pieces.sort(key=len)
            g = 0
            while g < len(pieces):
                to = g + 1
                while to < len(pieces) and (to - g + 1) * len(pieces[to]) <= GROUP:
                    to += 1
                ends = []
                for p in pieces[g:to]:
                    s = e[p].copy()
                    # A word of no kind beside the piece, unless the line begins or ends there.
                    if p[0] and line[p[0] - 1] == line[p[0]]:
                        s[0] += self.moves[0]
                    if p[-1] + 1 < len(e) and line[p[-1] + 1] == line[p[-1]]:
                        s[-1] += self.moves[:, 0]
                    ends.append(s)
                for p, best in zip(pieces[g:to], viterbi(ends, self.moves)):
                    label[p] = best
                g = to
        return np.split(label, np.cumsum([len(x) for x in lines])[:-1])


def _indexed(words: list[str], index: dict[str, int]) -> list[list[int]]:
    """The features of each word of a sentence that are in the index."""
    out = [[index[f] for f in features(w) if f in index] for w in words]
    for i, w in enumerate(words):
        for f in tells(w):
            for o in range(-REACH, REACH + 1):
                if o and 0 <= i + o < len(words) and (k := f"{o}:{f}") in index:
                    out[i + o].append(index[k])
    return out


@lru_cache(maxsize=1)
def field() -> Field:
    """Fitted by stochastic gradients of the conditional likelihood."""
    table = labelled_table()
    seen = Counter(f for words, _ in table for w in words for f in features(w))
    seen.update(f"{o}:{f}" for words, _ in table for w in words for f in tells(w) for o in range(-REACH, REACH + 1) if o)
    index = {f: i for i, f in enumerate(f for f, n in seen.items() if n >= LEAST)}
    k = len(KINDS) + 1
    weights, moves = np.zeros((len(index), k)), np.zeros((k, k))
    ready = [(_indexed(words, index), np.array(labels)) for words, labels in table]
    for p in range(PASSES):
        rate = 0.3 / (1 + p)
        for rows, labels in ready:
            n = len(rows)
            at, of = np.array([r for row in rows for r in row]), np.repeat(np.arange(n), [len(r) for r in rows])
            e = np.zeros((n, k))
            np.add.at(e, of, weights[at])
            fwd, bwd = np.zeros((n, k)), np.zeros((n, k))
            fwd[0] = e[0]
            for i in range(1, n):
                fwd[i] = e[i] + _log_sum(fwd[i - 1][:, None] + moves, 0)
            for i in range(n - 2, -1, -1):
                bwd[i] = _log_sum(moves + (e[i + 1] + bwd[i + 1])[None, :], 1)
            total = _log_sum(fwd[-1], 0)
            grad = -np.exp(fwd + bwd - total)
            grad[np.arange(n), labels] += 1
            pairs = np.exp(fwd[:-1, :, None] + moves[None] + (e[1:] + bwd[1:])[:, None, :] - total)
            moves -= rate * pairs.sum(axis=0)
            np.add.at(moves, (labels[:-1], labels[1:]), rate)
            np.add.at(weights, at, rate * grad[of])
    return Field(index, weights, moves)


def viterbi(scores: list[np.ndarray], moves: np.ndarray) -> list[np.ndarray]:
    """Best label sequences of a batch; sequences are padded to the longest one."""
    k, longest = len(moves), max(map(len, scores))
    e = np.zeros((len(scores), longest, k))
    for i, s in enumerate(scores):
        e[i, : len(s)] = s
    size = np.array([len(s) for s in scores])
    best, back = e[:, 0], np.zeros((longest, len(scores), k), np.int8)
    for t in range(1, longest):
        way = best[:, :, None] + moves[None]
        back[t] = way.argmax(axis=1)
        best = np.where((t < size)[:, None], way.max(axis=1) + e[:, t], best)
    label = best.argmax(axis=1)
    out = np.zeros((len(scores), longest), np.int64)
    rows = np.arange(len(scores))
    for t in range(longest - 1, -1, -1):
        out[rows, t] = label
        label = np.where((t < size) & (t > 0), back[t, rows, label], label)
    return [o[:n] for o, n in zip(out, size)]


_EXTRA = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+\s*(?:@|\[at\]|\(at\)|\bat\b)\s*[A-Za-z0-9-]+\s*(?:\.|\[dot\]|\(dot\)|\bdot\b)\s*[A-Za-z]{2,}(?:\.[A-Za-z]{2,})*", re.IGNORECASE),
    "phone": re.compile(r"\(?[0-9][\x20().0-9-]{6,}[0-9]"),
    "card": _PATTERN["card"],
    "ip": _PATTERN["ip"],
}


_OPENER = re.compile(r"(?<!\S)(?:\+|\()")


def _items(kind: str, text: str, start: int, stop: int) -> list[tuple[int, int]]:
    """All items of ``kind`` in a stretch of text. A match that doesn't fit is taken for several items, from word to word:
    numbers begin anew at an opening sign, and an item is the shortest stretch of words that fits."""
    out = []
    while found := _EXTRA[kind].search(text, start, stop):
        a, start = found.span()
        if _fits(kind, found.group(), False):
            out.append((a, start))
            continue
        words = [m.span() for m in _WORD.finditer(text, a, start)]
        i = 0
        while i < len(words):
            step = 1
            for j in range(i, len(words)):
                if kind == "phone" and j > i and _OPENER.match(text, words[j][0]) and not (j == i + 1 and text[words[i][0]] == "+"):
                    break
                one = _EXTRA[kind].fullmatch(text, words[i][0], words[j][1])
                if one and _fits(kind, one.group(), False):
                    out.append(one.span())
                    step = j - i + 1
                    break
                if len(_DIGIT.findall(text, words[i][0], words[j][1])) > 19:
                    break
            i += step
    return out


def added_spans(texts: list[str], base: list[list[tuple[str, int, int]]], model: Field | None = None) -> list[list[tuple[str, int, int]]]:
    """Spans of the field beside the base spans."""
    model = model or field()
    at, lines, words = [], [], []
    for i, text in enumerate(texts):
        if not _HINT.search(text):
            continue
        start = 0
        for line in text.split("\n"):
            if _HINT.search(line) and (found := _WORD.findall(line)):
                at.append((i, start))
                lines.append(line)
                words.append(found)
            start += len(line) + 1
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if not words:
        return out
    for (i, start), line, labels in zip(at, lines, model.labels(words)):
        if not labels.any():
            continue
        places = [(start + m.start(), start + m.end()) for m in _WORD.finditer(line)]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], labels, [0]])))
        for a, b in zip(edge[:-1], edge[1:]):
            if not labels[a]:
                continue
            kind = KINDS[labels[a] - 1]
            # Stretches of the run's words that touch no base span.
            first = None
            for w, stop in [*places[a:b], (-1, -1)]:
                if w >= 0 and all(stop <= s or w >= e for _, s, e in base[i]):
                    first, last = w if first is None else first, stop
                elif first is not None:
                    out[i] += [(kind, *span) for span in _items(kind, texts[i], first, last)]
                    first = None
    return out


def _digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


def find(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_spans."""
    model = field()
    source = docs.select(docs[id_col].alias("id"), body(docs, text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                texts = part.column("t").to_pylist()
                base = [base_spans(t) for t in texts]
                more = added_spans(texts, base, model)
                counts = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in KINDS]
                sha = [hashlib.sha256(_digest(b).encode()).hexdigest() for b in base]
                spans = [_digest(b + m) for b, m in zip(base, more)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), *counts, pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array([len(b) + len(m) for b, m in zip(base, more)], pa.int64())],
                    names=["id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_spans"],
                )

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string, n_spans bigint")
