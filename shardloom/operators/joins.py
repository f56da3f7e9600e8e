"""Joins beyond those that SQL has."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str, columns: Sequence[str]) -> DataFrame:
    """Each left row with the columns of the latest right row of its key at or before it; NULL where there is none.

    Both sides are put in order together, so a key's rows are read once and never compared pairwise.  Right rows at
    the same instant as a left row count; of several right rows at one instant any may be taken.
    """
    taken = F.struct(*(F.col(c) for c in columns)).alias("_taken")
    lefts = left.select(*by, F.col(left_on).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"))
    rights = right.select(*by, F.col(right_on).alias("_t"), F.lit(0).alias("_side"), taken)
    both = lefts.unionByName(rights, allowMissingColumns=True)
    order = Window.partitionBy(*by).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_found", F.last("_taken", ignorenulls=True).over(order)).where("_side = 1")
    return found.select("_row.*", *(F.col(f"_found.{c}").alias(c) for c in columns))


def asof_sliced(left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str, columns: Sequence[str], slice_: str = "1 day") -> DataFrame:
    """`asof` for keys with very many rows: rows are cut into slices of time, and each slice starts from the last right row before it."""
    cut = lambda c: F.window(F.col(c), slice_)["start"]
    taken = F.struct(F.col(right_on).alias("_t"), *(F.col(c) for c in columns))
    rights = right.select(*by, cut(right_on).alias("_slice"), F.col(right_on).alias("_t"), F.lit(0).alias("_side"), taken.alias("_taken"))
    lefts = left.select(*by, cut(left_on).alias("_slice"), F.col(left_on).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"))
    ends = rights.groupBy(*by, "_slice").agg(F.max("_taken").alias("_end"))
    slices = lefts.select(*by, "_slice").unionByName(rights.select(*by, "_slice")).distinct().join(ends, [*by, "_slice"], "left")
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.withColumn("_taken", F.last("_end", ignorenulls=True).over(before)).where("_taken is not null")
    carried = carried.select(*by, "_slice", F.lit(None).cast(dict(rights.dtypes)["_t"]).alias("_t"), F.lit(0).alias("_side"), "_taken")
    both = lefts.unionByName(rights, allowMissingColumns=True).unionByName(carried, allowMissingColumns=True)
    order = Window.partitionBy(*by, "_slice").orderBy(F.col("_t").asc_nulls_first(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_found", F.last("_taken", ignorenulls=True).over(order)).where("_side = 1")
    return found.select("_row.*", *(F.col(f"_found.{c}").alias(c) for c in columns))


def unmatched(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left rows without a right one."""
    return left.join(right, list(keys), "left_anti")


#: Rows from which on a key of the left side is dealt over salts.
CROWD = 1_000_000


def salted(left: DataFrame, right: DataFrame, keys: Sequence[str], salts: int = 16, how: str = "inner", crowd: int = CROWD) -> DataFrame:
    """An equi-join with a few very frequent keys on the left: their left rows are dealt over salts, their right rows are copied to each.

    Keys with fewer than `crowd` rows stay as they are, so that few right rows are copied, and those are shuffled: Spark takes a
    copied table for as small as the one that it comes from and would send all copies through the driver.  Left rows with a NULL
    key, which meet nothing, are dealt too.  Copies of a right row without a partner would each come out, so right and full joins
    add the right rows that no left key meets in a join of their own.
    """
    if how in ("right", "right_outer", "rightouter", "full", "outer", "full_outer", "fullouter"):
        met = salted(left, right, keys, salts, "inner" if how.startswith("right") else "left", crowd)
        lonely = right.join(left.select(*keys).distinct(), list(keys), "left_anti")
        return met.unionByName(lonely, allowMissingColumns=True).select(*met.columns)
    frequent = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= crowd).select(*keys, F.lit(True).alias("_crowd"))
    frequent = F.broadcast(frequent)
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")
    apart = F.col("_crowd").isNotNull()
    for k in keys:
        apart = apart | F.col(k).isNull()
    dealt = left.join(frequent, list(keys), "left").withColumn("_salt", F.when(apart, salt).otherwise(F.lit(0))).select(*left.columns, "_salt")
    last = F.when(F.col("_crowd"), F.lit(salts - 1)).otherwise(F.lit(0))
    copied = right.join(frequent, list(keys), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), last))).select(*right.columns, "_salt")
    return dealt.join(copied.hint("merge"), [*keys, "_salt"], how).drop("_salt")


#: Points and ranges of a cell that one group of `within` compares, and pairs that one task compares about.
SIDE, PAIRS = 2_000, 20_000_000


def within(points: DataFrame, ranges: DataFrame, by: Sequence[str], at: str, low: str, high: str, step: float, side: int = SIDE) -> DataFrame:
    """Points that fall into ranges [low, high] of their key, over numbers.

    A range is copied to each step-wide cell that it touches, and points meet it in their own cell: an equi-join with
    a filter instead of a comparison of everything.  Cells with many points and ranges are cut into blocks of about `side`
    of each, every block of points meets every block of ranges once, and there are as many tasks as the pairs, which
    are counted before, ask for: the result may grow with the square of the tables, but no task's share of it does.
    """
    cells = F.sequence(F.floor(F.col(low) / step).cast("long"), F.floor(F.col(high) / step).cast("long"))
    spread = ranges.where(F.col(low) <= F.col(high)).withColumn("_cell", F.explode(cells))
    placed = points.withColumn("_cell", F.floor(F.col(at) / step).cast("long"))
    keys = [*by, "_cell"]
    counts = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_p")).join(spread.groupBy(*keys).agg(F.count(F.lit(1)).alias("_r")), keys)
    blocks = lambda c: F.ceil(F.col(c) / side).cast("int")
    pairs = counts.agg(F.sum(F.col("_p").cast("double") * F.col("_r")).alias("n")).first()["n"] or 0
    tasks = math.ceil(pairs / PAIRS)
    if tasks <= 1:
        return placed.join(spread, keys).where(F.col(at).between(F.col(low), F.col(high))).drop("_cell")
    large = F.broadcast(counts.where((F.col("_p") > side) | (F.col("_r") > side)).select(*keys, blocks("_p").alias("_a"), blocks("_r").alias("_b")))
    number = lambda c: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce(c, F.lit(1))).cast("int")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(c), F.lit(1)) - 1))
    left = placed.join(large, keys, "left").withColumn("_i", number(F.col("_a"))).withColumn("_j", each("_b")).drop("_a", "_b")
    right = spread.join(large, keys, "left").withColumn("_j", number(F.col("_b"))).withColumn("_i", each("_a")).drop("_a", "_b")
    on = [*keys, "_i", "_j"]
    tasks = max(tasks, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = left.repartition(tasks, *on).join(right.repartition(tasks, *on).hint("merge"), on)
    return met.where(F.col(at).between(F.col(low), F.col(high))).drop("_cell", "_i", "_j")
