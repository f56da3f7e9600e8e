"""Sinks of streams: the sharded layout, and batches to a function."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.scan import DAY_COLUMN
from ..plans.ring import SHARD_COLUMN, Ring
from ..session import scratch


def write_sharded(stream: DataFrame, path: str, checkpoint: str, ring: Ring, key: str, timestamp: str) -> StreamingQuery:
    """Append a stream under `_shard` and `_day`; a batch that is repeated overwrites what it wrote before.

    Every batch has a folder of its own below the day, so that a retry replaces its own files only.
    """

    def save(batch: DataFrame, number: int) -> None:
        placed = batch.withColumns({"_batch": F.lit(number), SHARD_COLUMN: ring.column(F.col(key)), DAY_COLUMN: F.to_date(timestamp)})
        dealt = placed.repartition(SHARD_COLUMN, DAY_COLUMN, F.pmod(F.xxhash64(key), F.lit(8)))
        dealt.sortWithinPartitions(SHARD_COLUMN, DAY_COLUMN, key, timestamp).write.partitionBy("_batch", SHARD_COLUMN, DAY_COLUMN).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deliver(stream: DataFrame, checkpoint: str, to: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Each batch to a function."""
    return stream.writeStream.foreachBatch(to).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_memory(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """All that a bounded stream gives, as a table in memory, once the stream has ended; for tests and small results."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def run_to_table(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """All that a bounded stream gives, once the stream has ended, as a table of files in the shared folder; no row comes to the driver.

    Every batch has a folder of its own, which a retry overwrites.  In complete mode the last one holds the whole result and alone counts.
    """
    spark, path, numbers = stream.sparkSession, scratch(stream.sparkSession, name), []

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{number}")
        numbers.append(number)

    deliver(stream, scratch(spark, f"{name}-mark"), save, mode).awaitTermination()
    kept = numbers[-1:] if mode == "complete" else sorted({*numbers})
    return spark.read.schema(stream.schema).parquet(*(f"{path}/{n}" for n in kept)) if kept else spark.createDataFrame([], stream.schema)
