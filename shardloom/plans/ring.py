"""Placement of keys on shards by a consistent-hash ring.

Tokens are md5 hex strings, compared as strings, so the same placement can be written in any SQL.  A shard has
weight x virtual nodes tokens; a key belongs to the first token at or after its own hash, wrapping round.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Shard

SHARD_COLUMN = "_shard"


def _hash(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()


class Ring:
    """An immutable ring over shards."""

    def __init__(self, shards: Sequence[Shard]):
        self.shards = tuple(shards)
        pairs = sorted((_hash(f"{s.id}-{v}"), s.id) for s in shards for v in range(max(s.weight, 1) * max(s.virtual_nodes, 1)))
        self.tokens = [t for t, _ in pairs]
        self.owners = [o for _, o in pairs]

    def __len__(self) -> int:
        return len(self.tokens)

    def shard_of(self, key: str) -> int | None:
        """The shard of a key; None on an empty ring."""
        if not self.tokens:
            return None
        return self.owners[bisect.bisect_left(self.tokens, _hash(key)) % len(self.tokens)]

    def failover(self, key: str, excluded: Collection[int] = ()) -> int | None:
        """The key's shard, or where it is excluded, that of the first salted probe that isn't.

        When no probe finds one, the lowest shard that isn't excluded; None where all are.
        """
        first = self.shard_of(key)
        if first is None or first not in excluded:
            return first
        for salt in range(1, max(s.virtual_nodes for s in self.shards) + 1):
            probe = self.shard_of(f"{key}#{salt}")
            if probe not in excluded:
                return probe
        return min((s.id for s in self.shards if s.id not in excluded), default=None)

    def failover_column(self, key: Column, excluded: Collection[int] = ()) -> Column:
        """`failover` as an expression; only keys whose own shard is excluded are probed."""
        first = self.column(key)
        if not excluded:
            return first
        gone = sorted(excluded)
        salts = F.sequence(F.lit(1), F.lit(max(s.virtual_nodes for s in self.shards)))
        probes = F.transform(salts, lambda n: self.column(F.concat(key.cast("string"), F.lit("#"), n.cast("string"))))
        last = F.lit(min((s.id for s in self.shards if s.id not in excluded), default=None)).cast("int")
        return F.when(first.isin(gone), F.coalesce(F.get(F.filter(probes, lambda o: ~o.isin(gone)), 0), last)).otherwise(first)

    def frame(self, spark: SparkSession) -> DataFrame:
        """The ring as rows (token, shard); its size is the number of virtual nodes."""
        return spark.createDataFrame(list(zip(self.tokens, self.owners, strict=True)), "token string, shard int")

    def column(self, key: Column, buckets: int = 256) -> Column:
        """The shard of a key as an expression, without a join.

        The tokens lie in a literal array, cut into buckets by their first two digits, so a key is compared with the
        few tokens of its own bucket and the first one of the next.
        """
        starts = [f"{b:02x}" for b in range(buckets)]
        rows = []
        for b, start in enumerate(starts):
            low = bisect.bisect_left(self.tokens, start)
            high = bisect.bisect_left(self.tokens, starts[b + 1]) if b + 1 < buckets else len(self.tokens)
            own = list(zip(self.tokens[low:high], self.owners[low:high], strict=True))
            own.append(("g", self.owners[high % len(self.tokens)]))  # sorts after every digit
            rows.append(F.array(*(F.struct(F.lit(t).alias("t"), F.lit(o).alias("o")) for t, o in own)))
        token = F.md5(key.cast("string").cast("binary"))
        mine = F.get(F.array(*rows), F.conv(F.substring(token, 1, 2), 16, 10).cast("int"))
        return F.get(F.filter(mine, lambda x: x["t"] >= token), 0)["o"]


def place(df: DataFrame, ring: Ring, key: str, column: str = SHARD_COLUMN) -> DataFrame:
    """Rows with the shard of their key, found once a distinct key with a join on the ring's successor.

    Keys are made distinct first; the ring and the keys are then put in order together and each key takes the
    next token behind it, which is one pass over each of 256 slices, by two hex digits, rather than a comparison with every token.
    """
    spark = df.sparkSession
    keys = df.select(F.col(key).cast("string").alias("_k")).where("_k is not null").distinct()
    marks = keys.select(F.md5(F.col("_k").cast("binary")).alias("token"), "_k", F.lit(None).cast("int").alias("shard"))
    tokens = ring.frame(spark)
    # every slice of the ring also gets the token that follows it
    digit = [f"{d:02x}" for d in range(256)]
    ends = [(d, "~", ring.owners[bisect.bisect_right(ring.tokens, d + "~") % len(ring)]) for d in digit]
    tail = spark.createDataFrame(ends, "slice string, token string, shard int")
    ring_rows = tokens.select(F.substring("token", 1, 2).alias("slice"), "token", "shard").unionByName(tail).withColumn("_k", F.lit(None).cast("string"))
    both = ring_rows.unionByName(marks.withColumn("slice", F.substring("token", 1, 2)))
    # a token that equals a key's hash is the key's own: keys come first
    order = Window.partitionBy("slice").orderBy(F.col("token"), F.col("_k").asc_nulls_last()).rowsBetween(0, Window.unboundedFollowing)
    found = both.withColumn("shard", F.first("shard", ignorenulls=True).over(order)).where("_k is not null").select("_k", F.col("shard").alias(column))
    return df.join(found, F.col(key).cast("string") == F.col("_k"), "left").drop("_k")


def skew(placed: DataFrame, column: str = SHARD_COLUMN) -> DataFrame:
    """One row about how evenly rows lie on shards: deviation, ratio, chi-square, imbalance."""
    return uneven(placed.groupBy(column).agg(F.count("*").alias("n")), "n")


def uneven(counts: DataFrame, n: str) -> DataFrame:
    """Population deviation over mean, largest over smallest, chi-square against even counts, and the largest count's excess in percent."""
    totals = counts.agg(F.count("*").alias("shards"), F.sum(n).alias("total"), F.avg(n).alias("mean"), F.stddev_pop(n).alias("dev"), F.max(n).alias("high"), F.min(n).alias("low"), F.sum(F.pow(F.col(n).cast("double"), 2)).alias("squares"))
    return totals.select(
        "shards", "total",
        (F.col("dev") / F.col("mean")).alias("cv"),
        (F.col("high") / F.col("low")).alias("max_min_ratio"),
        (F.col("squares") / F.col("mean") - F.col("total")).alias("chi_square"),
        ((F.col("high") / F.col("mean") - 1) * 100).alias("imbalance_pct"),
    )


RING_SQL = """
WITH ring AS (SELECT md5(s || '-' || v) AS token, s AS shard FROM (SELECT unnest([{shards}]) AS s), (SELECT unnest(range({nodes})) AS v)),
keys AS (SELECT DISTINCT CAST({key} AS VARCHAR) AS k FROM {table}),
placed AS (SELECT k, CAST(coalesce((SELECT arg_min(shard, token) FROM ring WHERE token >= md5(k)), (SELECT arg_min(shard, token) FROM ring)) AS INTEGER) AS shard FROM keys)
"""
