"""Live bars and other windows over streams; the timestamp must be an instant (TIMESTAMP), as watermarks need it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LATE = "10 minutes"


def instants(df: DataFrame, timestamp: str = "ts") -> DataFrame:
    """A timestamp without zone read as UTC; the session's zone is UTC."""
    return df.withColumn(timestamp, F.col(timestamp).cast("timestamp"))


def live_ohlcv(ticks: DataFrame, step: str, price: str, keys: Sequence[str], timestamp: str = "ts", late: str = LATE, tie: str | None = None) -> DataFrame:
    """Bars of a stream (or a table): tumbling windows with a watermark, later rows are dropped."""
    order = F.struct(timestamp, tie) if tie else F.col(timestamp)
    marked = ticks.withWatermark(timestamp, late) if ticks.isStreaming else ticks
    out = marked.groupBy(*keys, F.window(timestamp, step).alias("w")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.count(F.lit(1)).alias("ticks")
    )
    return out.select(*keys, F.col("w.start").alias(timestamp), "open", "high", "low", "close", "ticks")


def sliding(ticks: DataFrame, size: str, slide: str, value: str, keys: Sequence[str], timestamp: str = "ts", late: str = LATE) -> DataFrame:
    marked = ticks.withWatermark(timestamp, late) if ticks.isStreaming else ticks
    out = marked.groupBy(*keys, F.window(timestamp, size, slide).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    return out.select(*keys, F.col("w.start").alias(timestamp), "n", "mean")


def live_sessions(ticks: DataFrame, gap: str, keys: Sequence[str], timestamp: str = "ts", late: str = LATE) -> DataFrame:
    marked = ticks.withWatermark(timestamp, late) if ticks.isStreaming else ticks
    out = marked.groupBy(*keys, F.session_window(timestamp, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(ticks: DataFrame, ids: Sequence[str], timestamp: str = "ts", late: str = LATE) -> DataFrame:
    """Rows without repetitions that at-least-once ingest leaves, within the watermark."""
    return ticks.withWatermark(timestamp, late).dropDuplicatesWithinWatermark(list(ids)) if ticks.isStreaming else ticks.dropDuplicates(list(ids))


def joined(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, within: str, late: str = LATE) -> DataFrame:
    """Pairs of two streams whose instants lie within a span of each other."""
    a, b = left.withWatermark(left_time, late).alias("a"), right.withWatermark(right_time, late).alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    span = F.expr(f"b.{right_time} BETWEEN a.{left_time} AND a.{left_time} + INTERVAL {within}")
    return a.join(b, [*on, span], "inner")
