"""Model calls per row through a batch predictor built once per worker."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Generation:
    """How a predictor generates; the values are handed to it as they are."""

    max_new_tokens: int = 512
    do_sample: bool = False
    temperature: float | None = None
    top_p: float | None = None
    stop: str | None = None


# Sampled chats, greedy chats about images, and chats that end at a stop string.
SAMPLED = Generation(do_sample=True, temperature=0.7, top_p=0.9)
GREEDY = Generation()
STOPPED = Generation(stop="<|endoftext|>")

Predictor = Callable[[list[str]], list[str]]

#: Predictors that this worker has built, by call of :func:`attach_replies`.
_BUILT: dict[str, Predictor] = {}


def attach_replies(rows: DataFrame, messages: str, make_predictor: Callable[[Generation], Predictor], how: Generation = GREEDY, out: str = "reply") -> DataFrame:
    """``rows`` with a reply per row. ``make_predictor`` builds a function from a list of chats, as JSON, to a list of texts.

    A worker builds it on its first batch and keeps it for later tasks.
    """
    call = uuid.uuid4().hex

    @F.pandas_udf("string")
    def reply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from orrery.operators.models import _BUILT as built

        for chats in batches:
            if call not in built:
                built[call] = make_predictor(how)
            yield pd.Series(built[call](chats.tolist()), dtype=object)

    return rows.withColumn(out, reply(F.to_json(messages)))
