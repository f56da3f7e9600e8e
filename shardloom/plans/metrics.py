"""Counters, gauges and histograms of an engine's work."""

from __future__ import annotations

import bisect
import time
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Upper bounds of a histogram's cells, in seconds (or in numbers, for counts of shards).
BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


class Metrics:
    """Numbers by name and label; a histogram keeps a count a cell, the sum and the number of observations."""

    def __init__(self) -> None:
        self.counters: Counter[tuple[str, str]] = Counter()
        self.gauges: dict[tuple[str, str], float] = {}
        self.histograms: dict[tuple[str, str], list[float]] = {}

    def count(self, name: str, label: str = "", by: int = 1) -> None:
        self.counters[name, label] += by

    def gauge(self, name: str, value: float, label: str = "") -> None:
        self.gauges[name, label] = value

    def observe(self, name: str, value: float, label: str = "") -> None:
        cells = self.histograms.setdefault((name, label), [0] * (len(BOUNDS) + 1) + [0.0, 0])
        cells[bisect.bisect_left(BOUNDS, value)] += 1
        cells[-2] += value
        cells[-1] += 1

    @contextmanager
    def timed(self, name: str, label: str = "") -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.observe(name, time.perf_counter() - began, label)

    def frame(self, spark: SparkSession) -> DataFrame:
        """(name, kind, label, value): counters and gauges as they are, of histograms how often they were observed."""
        rows = [(n, "counter", k, float(v)) for (n, k), v in self.counters.items()] + [(n, "gauge", k, v) for (n, k), v in self.gauges.items()]
        rows += [(n, "histogram", k, float(v[-1])) for (n, k), v in self.histograms.items()]
        return spark.createDataFrame(sorted(rows), "name string, kind string, label string, value double")
