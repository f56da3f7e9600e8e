"""Scans over shards as one table, and the sharded layout that they read."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.ring import SHARD_COLUMN, Ring

DAY_COLUMN = "_day"


def align(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns by name in any case, in the schema's order and types; NULL where one is missing."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*((F.col(f"`{have[f.name.lower()]}`").cast(f.dataType) if f.name.lower() in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema))


def union_shards(frames: Sequence[DataFrame], schema: T.StructType | None = None) -> DataFrame:
    """Rows of all shards; columns are matched by name and may be missing on some."""
    if schema is not None:
        frames = [align(f, schema) for f in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def scan_shards(spark: SparkSession, paths: Sequence[str], schema: T.StructType) -> DataFrame:
    """Parquet tables of several shards as one; a shard that doesn't have the table contributes no rows."""
    found = []
    for path in paths:
        try:
            found.append(spark.read.parquet(path))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in (e.getCondition() or str(e)):
                raise
    return union_shards(found, schema) if found else spark.createDataFrame([], schema)


def write_sharded(df: DataFrame, path: str, ring: Ring, key: str, timestamp: str, mode: str = "append") -> None:
    """Write rows under `_shard` and `_day` folders, in time order within a file.

    Rows of one key lie on one shard.  Rows are dealt out by shard, day and a few salts of the key, so that a busy shard-day is
    written by several tasks.
    """
    placed = df.withColumns({SHARD_COLUMN: ring.column(F.col(key)), DAY_COLUMN: F.to_date(timestamp)})
    dealt = placed.repartition(SHARD_COLUMN, DAY_COLUMN, F.pmod(F.xxhash64(key), F.lit(8)))
    dealt.sortWithinPartitions(SHARD_COLUMN, DAY_COLUMN, key, timestamp).write.partitionBy(SHARD_COLUMN, DAY_COLUMN).mode(mode).parquet(path)


def write_bucketed(df: DataFrame, table: str, path: str, key: str, buckets: int) -> DataFrame:
    """Write a table in buckets of a key, each in the key's order; tables with the same buckets join on it without an exchange."""
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).mode("overwrite").saveAsTable(table)
    return df.sparkSession.table(table)


def read_sharded(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def latest_rows(df: DataFrame, timestamp: str, n: int, *tie: str) -> DataFrame:
    """The n latest rows, by a bounded top-n on every task."""
    return df.orderBy(F.col(timestamp).desc(), *(F.col(t).desc() for t in tie)).limit(n)
