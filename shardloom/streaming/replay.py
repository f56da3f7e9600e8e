"""The last rows of each topic, from tables and on streams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.timeseries import last_n


def replay(ticks: DataFrame, n: int, arrival: str, topic: str = "topic", only: str | None = None) -> DataFrame:
    """The last n rows of each topic (or of one) by arrival, numbered from the oldest of them; an unknown topic has none."""
    rows = ticks if only is None else ticks.where(F.col(topic) == only)
    return last_n(rows, [topic], [arrival], n)


def last_rows(old: Iterable[tuple], chunks: Iterable[Iterable[tuple]], n: int) -> list[tuple]:
    """The n different rows (arrival, value) that arrived last, oldest first; no more than n and a chunk are held."""
    kept: list[tuple] = []
    for chunk in chain([old], chunks):
        kept = sorted({*kept, *((int(a), None if v is None else float(v)) for a, v in chunk)}, key=lambda r: r[0])[-n:]
    return kept


def live_replay(ticks: DataFrame, n: int, arrival: str = "event_id", value: str = "value", topic: str = "topic") -> DataFrame:
    """On a stream of (topic, arrival long, value double): with every batch, the last n rows of the topics that had some.

    The rows kept for a topic are its state; they are always kept, whether or not anyone listens.
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

    class LastRows(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.rows = handle.getListState("rows", "arrival bigint, value double")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            old = list(self.rows.get()) if self.rows.exists() else []
            kept = last_rows(old, (zip(pdf[arrival], pdf[value], strict=True) for pdf in rows), n)
            self.rows.put(kept)
            yield pd.DataFrame({"topic": [key[0]] * len(kept), "arrival": [a for a, _ in kept], "value": [v for _, v in kept], "seq": range(1, len(kept) + 1)})

        def close(self) -> None:
            pass

    chosen = ticks.select(F.col(topic).alias("topic"), arrival, value)
    return chosen.groupBy("topic").transformWithStateInPandas(LastRows(), "topic string, arrival bigint, value double, seq int", "Update", "None")
