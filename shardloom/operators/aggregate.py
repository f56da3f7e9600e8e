"""Aggregates that are merged from partial results, and statistics of load tests."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ring import uneven

MERGES = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


def partial(df: DataFrame, keys: Sequence[str], shard: str, value: str) -> DataFrame:
    """count, sum, min and max of a value for each key and shard."""
    return df.groupBy(*keys, shard).agg(F.count(value).alias("count"), F.sum(value).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max"))


def merge(partials: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Partial results of all shards to final ones; the average is the sum over the count, never a mean of means."""
    out = partials.groupBy(*keys).agg(*(f(n).alias(n) for n, f in MERGES.items()))
    return out.withColumn("avg", F.when(F.col("count") > 0, F.col("sum") / F.col("count")))


def salted_sum(df: DataFrame, keys: Sequence[str], value: str, salts: int = 32) -> DataFrame:
    """count and sum for each key over two shuffles, for aggregates that Spark can't combine before the first one."""
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(salts))
    first = df.withColumn("_salt", salt).groupBy(*keys, "_salt").agg(F.count(value).alias("n"), F.sum(value).alias("s"))
    return first.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def skew_statistics(df: DataFrame, key: str) -> DataFrame:
    """How evenly rows are spread over a key's values."""
    return uneven(df.groupBy(key).agg(F.count("*").alias("n")), "n")


def percentiles(df: DataFrame, value: str, *fractions: float) -> DataFrame:
    """Exact percentiles, one row: the smallest value that at least that share of all values doesn't exceed; NULLs don't count.

    Each is closed in between two approximate quantiles, which a sketch of bounded size gives, and the values between them are looked at
    again until they are few different ones; no task ever holds all values.
    """
    spark, kind = df.sparkSession, df.schema[value].dataType.simpleString()
    values = df.where(F.col(value).isNotNull()).select(F.col(value).alias("v"))
    total = values.count()
    found = [_nth(values, max(1, math.ceil(round(p * total, 9)))) if total else None for p in fractions]
    return spark.createDataFrame([tuple(found)], ", ".join(f"p{int(p * 100)} {kind}" for p in fractions))


def approximate_percentiles(df: DataFrame, value: str, *fractions: float, accuracy: int = 10_000) -> DataFrame:
    """Percentiles from a sketch in one pass; a rank is wrong by at most one part in `accuracy` of all rows."""
    return df.agg(*(F.percentile_approx(value, p, accuracy).alias(f"p{int(p * 100)}") for p in fractions))


#: Rows among which a percentile is looked up directly.
FEW = 50_000


def _nth(values: DataFrame, n: int):
    """The n-th smallest of the values (column v, no NULLs)."""
    skipped = 0
    while True:
        here = values.agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).first()
        if here["low"] == here["high"]:
            return here["low"]
        if here["n"] <= FEW:
            counts = values.groupBy("v").agg(F.count("*").alias("c")).orderBy("v").collect()
            for r in counts:
                skipped += r["c"]
                if skipped >= n:
                    return r["v"]
        share = (n - skipped) / here["n"]
        low, high = values.agg(F.percentile_approx("v", [max(0.0, share - 0.002), min(1.0, share + 0.002)], 5_000).alias("q")).first()["q"]
        below = values.agg(F.count_if(F.col("v") < low).alias("a"), F.count_if(F.col("v") <= high).alias("b")).first()
        if not below["a"] < n - skipped <= below["b"]:  # the sketch may be off by its error
            low, high = (here["low"], low) if n - skipped <= below["a"] else (high, here["high"])
            below = values.agg(F.count_if(F.col("v") < low).alias("a")).first()
        elif low == here["low"] and high == here["high"]:  # a few values hold nearly all rows
            at = values.agg(F.count_if(F.col("v") == low).alias("c")).first()["c"]
            if n - skipped <= at:
                return low
            values, skipped = values.where(F.col("v") > F.lit(low)), skipped + at
            continue
        values, skipped = values.where(F.col("v").between(low, high)), skipped + below["a"]


def panel_statistics(panels: DataFrame) -> DataFrame:
    """Summary over panels (name, live, ticks, change_pct): how many, how many live, all ticks, mean change, top gainer."""
    return panels.agg(
        F.count("*").alias("panels"), F.count_if("live").alias("live"), F.sum("ticks").alias("ticks"), F.avg("change_pct").alias("mean_change"),
        F.max_by("name", F.when(F.col("change_pct").isNotNull(), F.struct("change_pct", "name"))).alias("top_gainer"),
    )
