"""Column expressions: paths, geometry, colour, chat turns, token arrays, array layouts, name patterns."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the system turn of a chat whose caller gives none.
DEFAULT_SYSTEM = "You are a helpful assistant."


def key_of(*parts: Column) -> Column:
    return F.concat_ws("/", *parts)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def stem(path: Column) -> Column:
    """Base name without its last extension; leading dots don't count as one."""
    return F.regexp_replace(basename(path), r"(?s)\A(\.*[^.].*)\.[^.]*\z", "$1")


def relative(path: Column, root: str) -> Column:
    """``path`` as seen from the folder ``root``, with ``..`` where it lies elsewhere; empty stays empty.

    Both are absolute, or both relative to one place. Empty and ``.`` segments don't count; ``..`` segments aren't resolved.
    """
    if not root.strip("/."):
        return path
    above = [p for p in root.split("/") if p not in ("", ".")]
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    same, common = F.lit(True), F.lit(0)
    for i, a in enumerate(above):
        same = same & F.coalesce(F.get(parts, F.lit(i)) == a, F.lit(False))
        common = common + same.cast("int")
    up = F.array_repeat(F.lit(".."), F.lit(len(above)) - common)
    seen = F.array_join(F.concat(up, F.slice(parts, common + 1, F.greatest(F.size(parts), F.lit(1)))), "/")
    return F.when(path == "", path).when(seen == "", ".").otherwise(seen)


def preview(src: Column) -> Column:
    return F.concat(src, F.lit("/00000/00000.png"))


def label_colour(label: Column) -> list[Column]:
    """Red, green and blue in [0, 1] from a hash of the label: equal labels get equal colours."""
    digest = F.md5(label.cast("string"))
    return [F.conv(F.substring(digest, 1 + 2 * i, 2), 16, 10).cast("double") / 255 for i in range(3)]


def cosine(start: float, end: float, t: Column) -> Column:
    """Cosine schedule from ``start`` to ``end`` over t in [0, 1]."""
    return F.lit(end) + F.lit(0.5 * (start - end)) * (1 + F.cos(F.pi() * t))


def times(*values: Column) -> Column:
    out = values[0]
    for v in values[1:]:
        out = out * v
    return out


def divide(a: Column, b: Column) -> Column:
    """The quotient, null for a divisor of zero."""
    return F.try_divide(a, b)


def normalise(values: Column, mean: list[float], std: list[float]) -> Column:
    """(v - mean[i]) / std[i] over an array."""
    m, s = F.array(*map(F.lit, mean)), F.array(*map(F.lit, std))
    return F.transform(values, lambda v, i: F.try_divide(v - F.get(m, i), F.get(s, i)))


def value_at(flat: Column, point: Column, channel: int, channels: int, rendering: int, points: Column, last_axis: bool, renderings: int = 5) -> Column:
    """A channel of a point in a flat row-major array whose renderings are the last axis (N, C, 5) or the first one (5, N, C)."""
    if last_axis:
        return F.get(flat, ((point * channels + channel) * renderings + rendering).cast("int"))
    return F.get(flat, ((points * rendering + point) * channels + channel).cast("int"))


def messages(user: Column, system: str | Column | None = DEFAULT_SYSTEM, image_url: Column | None = None) -> Column:
    """Chat turns (role, content parts of type, text, url): the system turn, unless it is None, then the user's with any image first.

    A null in a system column stands for the default system text.
    """

    def part(kind: str, text: Column, url: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), text.cast("string").alias("text"), url.cast("string").alias("url"))

    none = F.lit(None)
    parts = ([part("image", none, image_url)] if image_url is not None else []) + [part("text", user, none)]
    turns = [F.struct(F.lit("user").alias("role"), F.array(*parts).alias("content"))]
    if system is not None:
        said = F.coalesce(system, F.lit(DEFAULT_SYSTEM)) if isinstance(system, Column) else F.lit(system)
        turns.insert(0, F.struct(F.lit("system").alias("role"), F.array(part("text", said, none)).alias("content")))
    return F.array(*turns)


def rendered(chat: Column, generation_prompt: bool = True) -> Column:
    """A plain text of chat turns, a line each, with an open assistant turn at the end; models bring templates of their own."""
    turns = F.transform(chat, lambda t: F.concat(t["role"], F.lit(": "), F.array_join(F.transform(t["content"], lambda p: F.coalesce(p["text"], F.concat(F.lit("<"), p["url"], F.lit(">")))), " ")))
    return F.array_join(F.concat(turns, F.array(F.lit("assistant:"))) if generation_prompt else turns, "\n")


def reply_tokens(tokens: Column, prompt_length: Column) -> Column:
    """What a model's output array has after the prompt."""
    return F.slice(tokens, prompt_length + 1, F.greatest(F.size(tokens) - prompt_length, F.lit(0)))


def without_special(tokens: Column, special: list[int]) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(special)) if special else tokens


def matches(name: Column, patterns: list[str]) -> Column:
    """Whether a name fits one of the glob patterns."""
    if not patterns:
        return F.lit(False)
    return F.greatest(*[name.rlike(fnmatch.translate(p).replace(r"\Z", r"\z")) for p in patterns], F.lit(False))
