"""Ingest of tick files into the sharded layout, once for each object."""

from __future__ import annotations

import hashlib
import time
from itertools import batched

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scan import DAY_COLUMN
from ..plans.ring import SHARD_COLUMN, Ring
from . import objects, tick_files

#: Objects that are read in one go; their names are all that comes to the driver.
OBJECTS = 10_000


def ingest(spark: SparkSession, listing: DataFrame, kind: str, target: str, checkpoint: str, ring: Ring, attempts: int = 3) -> int:
    """Read objects that the checkpoint asks for, write their ticks, then mark them; gives how many objects were read.

    Ticks lie in one folder for each object, which a repeated ingest overwrites: a run that broke off between writing and marking
    leaves no duplicates behind.
    """
    wanted = objects.to_process(listing, objects.read_checkpoint(spark, checkpoint)).where(tick_files.kind_of(F.col("key")) == kind)
    done = 0
    for part in batched((tuple(r) for r in wanted.select("bucket", "key", "etag").toLocalIterator()), OBJECTS):
        _write(spark, [key for _, key, _ in part], kind, target, ring, attempts)
        # counted from what was written, without reading the objects or other folders of the layout again
        named = spark.createDataFrame(part, "bucket string, key string, etag string").withColumn("_object", F.md5(F.col("key").cast("binary")))
        folders = [f"{target}/_object={hashlib.md5(key.encode()).hexdigest()}" for _, key, _ in part]
        written = spark.read.option("basePath", target).parquet(*folders).join(F.broadcast(named), "_object").groupBy("bucket", "key", "etag").agg(F.count("*").alias("rows"))
        objects.mark_processed(written, checkpoint)
        done += len(part)
    return done


def _write(spark: SparkSession, keys: list[str], kind: str, target: str, ring: Ring, attempts: int) -> None:
    """Ticks of some objects to the layout; a store that fails is asked again, a file that can't be read is an error at once."""
    for attempt in range(attempts):
        try:
            ticks = tick_files.with_time(tick_files.decode(spark.read.format("binaryFile").load(keys), kind))
            placed = ticks.withColumns({"_object": F.md5(F.col("path").cast("binary")), SHARD_COLUMN: ring.column(F.col("symbol")), DAY_COLUMN: F.to_date("timestamp")})
            placed.sortWithinPartitions("_object", SHARD_COLUMN, DAY_COLUMN, "symbol", "timestamp").write.partitionBy("_object", SHARD_COLUMN, DAY_COLUMN).mode("overwrite").option("partitionOverwriteMode", "dynamic").options(**objects.BY_TASKS).parquet(target)
            return
        except Exception as e:
            if attempt + 1 == attempts or "ParseError" in str(e):
                raise
            time.sleep(0.2 * 2**attempt)
