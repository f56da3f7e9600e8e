"""Time-series operators: bars, sampling, latest rows, moving averages, session changes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.dialect import interval


def bucket(timestamp: Column | str, step: str) -> Column:
    """The start of a timestamp's bucket; buckets are aligned to the epoch."""
    return F.window(timestamp, interval(step) if step[0].isdigit() and step[-1].isalpha() and " " not in step else step)["start"]


def sample_by(df: DataFrame, step: str, aggregates: Mapping[str, Column], timestamp: str = "ts", keys: Sequence[str] = ()) -> DataFrame:
    """One row for each non-empty bucket (and key): the bucket's start under the timestamp's name, and the aggregates."""
    grouped = df.groupBy(*keys, bucket(timestamp, step).alias("_bucket")).agg(*(c.alias(n) for n, c in aggregates.items()))
    return grouped.withColumnRenamed("_bucket", timestamp)


def ohlcv(df: DataFrame, step: str, price: str, volume: str | None = None, timestamp: str = "ts", keys: Sequence[str] = (), tie: str | None = None) -> DataFrame:
    """Bars: first, highest, lowest and last price of each bucket, volume and number of ticks; one hash aggregate."""
    order = F.struct(timestamp, tie) if tie else F.col(timestamp)
    return sample_by(
        df, step,
        {
            "open": F.min_by(price, order), "high": F.max(price), "low": F.min(price), "close": F.max_by(price, order),
            "volume": F.sum(volume) if volume else F.count(F.lit(1)).cast("double"), "ticks": F.count(F.lit(1)),
        },
        timestamp, keys,
    )


def fill(sampled: DataFrame, step: str, values: Sequence[str], timestamp: str = "ts", keys: Sequence[str] = (), how: str = "null") -> DataFrame:
    """Empty buckets between a key's first and last one, filled with NULL, the last value (prev), or a straight line (linear)."""
    span = sampled.groupBy(*keys).agg(F.min(timestamp).alias("_a"), F.max(timestamp).alias("_b"))
    grid = span.select(*keys, F.explode(F.sequence("_a", "_b", F.expr(f"INTERVAL {interval(step)}"))).alias(timestamp))
    full = grid.join(sampled, [*keys, timestamp], "left")
    if how == "null":
        return full
    back = Window.partitionBy(*keys).orderBy(timestamp).rowsBetween(Window.unboundedPreceding, 0)
    if how == "prev":
        return full.withColumns({v: F.last(v, ignorenulls=True).over(back) for v in values})
    ahead = Window.partitionBy(*keys).orderBy(timestamp).rowsBetween(0, Window.unboundedFollowing)
    at = F.unix_micros(F.col(timestamp).cast("timestamp")).cast("double")
    out = {}
    for v in values:
        point = F.when(F.col(v).isNotNull(), F.struct(at.alias("t"), F.col(v).cast("double").alias("v")))
        a, b = F.last(point, ignorenulls=True).over(back), F.first(point, ignorenulls=True).over(ahead)
        out[v] = F.when(F.col(v).isNotNull(), F.col(v).cast("double")).otherwise(a["v"] + (b["v"] - a["v"]) * (at - a["t"]) / (b["t"] - a["t"]))
    return full.withColumns(out)


def latest_on(df: DataFrame, keys: Sequence[str], timestamp: str = "ts", *tie: str) -> DataFrame:
    """The latest row of each key, by one aggregate that combines before the shuffle; NULL timestamps come last."""
    order = F.struct(timestamp, *tie)
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*(F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns))


def last_n(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The last n rows of each key with their number from the oldest of them on."""
    w = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order))
    up = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).withColumn("seq", F.row_number().over(up)).drop("_rn")


def moving_average(df: DataFrame, value: str, n: int = 20, timestamp: str = "ts", keys: Sequence[str] = (), name: str = "sma") -> DataFrame:
    """Mean of the last n points of each key; NULL before there are n.  Points of one instant should be upserted first."""
    w = Window.partitionBy(*keys).orderBy(timestamp).rowsBetween(-(n - 1), 0)
    return df.withColumn(name, F.when(F.count(value).over(w) >= n, F.avg(value).over(w)))


def moving_average_sliced(df: DataFrame, value: str, n: int = 20, timestamp: str = "ts", keys: Sequence[str] = (), name: str = "sma", slice_: str = "1 day") -> DataFrame:
    """`moving_average` for keys with very many rows: rows are cut into slices of time, and each slice begins with the n - 1 rows before it.

    Those come from the slices' own last rows: n - 1 slices with rows hold as many rows at least.
    """
    rows = df.withColumn("_slice", F.window(timestamp, slice_)["start"])
    point = F.struct(F.col(timestamp).alias("t"), F.col(value).alias("v"))
    back = Window.partitionBy(*keys, "_slice").orderBy(F.col(timestamp).desc())
    tails = rows.select(*keys, "_slice", point.alias("p"), F.row_number().over(back).alias("_k")).where(F.col("_k") < n)
    tails = tails.groupBy(*keys, "_slice").agg(F.array_sort(F.collect_list("p")).alias("tail"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(-(n - 1), -1)
    carried = tails.withColumn("tail", F.flatten(F.collect_list("tail").over(before)))
    carried = carried.select(*keys, "_slice", F.explode(F.slice("tail", F.greatest(F.size("tail") - (n - 2), F.lit(1)), n - 1)).alias("p")) if n > 1 else carried.limit(0)
    both = rows.withColumn("_own", F.lit(True)).unionByName(carried.select(*keys, "_slice", F.col("p.t").alias(timestamp), F.col("p.v").alias(value)), allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_slice").orderBy(timestamp).rowsBetween(-(n - 1), 0)
    return both.withColumn(name, F.when(F.count(value).over(w) >= n, F.avg(value).over(w))).where("_own").drop("_slice", "_own")


def range_slices(df: DataFrame, micros: str, back: int, slice_: int) -> DataFrame:
    """Rows for frames of `back` microseconds before each row, cut into slices of time: `_slice` to partition by beside the keys, and `_own`.

    A row also stands in later slices whose first rows reach back to it; frames are right for rows that are `_own`.
    """
    cell = lambda c: F.floor(c / slice_).cast("long")
    spread = df.withColumn("_slice", F.explode(F.sequence(cell(F.col(micros)), cell(F.col(micros) + back))))
    return spread.withColumn("_own", F.col("_slice") == cell(F.col(micros)))


def range_counts(df: DataFrame, keys: Sequence[str], micros: str, back: int, slice_: int, name: str = "n") -> DataFrame:
    """Each row with the number of its key's rows from `back` microseconds before it up to its own instant; NULL instants see each other.

    A row adds one from its instant on and takes it away again once it is too old, so the number is a running sum over both: a frame
    is never walked through, however many rows it holds.  Rows are cut into slices of time, and each slice starts with the sum before it.
    """
    moment = F.col(micros)
    cell = lambda t: t.withColumn("_slice", F.col("_t") - F.pmod(F.col("_t"), F.lit(slice_)))
    own = cell(df.select(*keys, moment.alias("_t"), F.lit(1).cast("long").alias("_d"), F.struct(*df.columns).alias("_row")))
    each = df.where(moment.isNotNull()).groupBy(*keys, moment.alias("_t")).agg(F.count(F.lit(1)).alias("_d"))
    old = cell(each.select(*keys, (F.col("_t") + back + 1).alias("_t"), (-F.col("_d")).alias("_d")))
    sums = own.select(*keys, "_slice", "_d").unionByName(old.select(*keys, "_slice", "_d")).where("_slice IS NOT NULL").groupBy(*keys, "_slice").agg(F.sum("_d").alias("_d"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.withColumn("_d", F.sum("_d").over(before)).where("_d IS NOT NULL").select(*keys, F.col("_slice").alias("_t"), "_d", "_slice")
    order = Window.partitionBy(*keys, "_slice").orderBy("_t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = own.unionByName(old, allowMissingColumns=True).unionByName(carried, allowMissingColumns=True)
    return both.withColumn(name, F.sum("_d").over(order)).where("_row IS NOT NULL").select("_row.*", name)


def upsert(df: DataFrame, keys: Sequence[str], timestamp: str, values: Sequence[str], arrival: str, step: str = "1s") -> DataFrame:
    """One row a key and second: the values that arrived last; rows that lack a value are dropped before."""
    sound = df.where(" AND ".join(f"`{v}` IS NOT NULL" for v in values)) if values else df
    grouped = sound.groupBy(*keys, bucket(timestamp, step).alias("_t")).agg(F.max_by(F.struct(*values), F.col(arrival)).alias("_v"))
    return grouped.select(*keys, F.col("_t").alias(timestamp), *(F.col(f"_v.{v}").alias(v) for v in values))


def session_change(df: DataFrame, value: str, timestamp: str = "ts", keys: Sequence[str] = ()) -> DataFrame:
    """First and last value of each key, and the change between them, absolute and in percent."""
    out = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min_by(value, timestamp).alias("open"), F.max_by(value, timestamp).alias("last"), F.count(F.lit(1)).alias("ticks"))
    return out.withColumn("change", F.col("last") - F.col("open")).withColumn("change_pct", F.when(F.col("open") != 0, F.col("change") / F.col("open") * 100))


def top_movers(changes: DataFrame, n: int, *tie: str) -> DataFrame:
    """The n largest changes in percent, keys without one last."""
    return changes.orderBy(F.col("change_pct").desc_nulls_last(), *tie).limit(n)


def direction(bars: DataFrame) -> DataFrame:
    """Bars with the direction of their volume: up where they don't close lower than they open."""
    return bars.withColumn("direction", F.when(F.col("close") >= F.col("open"), F.lit("up")).otherwise(F.lit("down")))


def sessions(df: DataFrame, keys: Sequence[str], timestamp: str, gap: str) -> DataFrame:
    """Activity sessions of each key: start, last instant and rows, where a gap of that length or more ends one."""
    out = df.groupBy(*keys, F.session_window(timestamp, gap).alias("_w")).agg(F.min(timestamp).alias("start"), F.max(timestamp).alias("end"), F.count(F.lit(1)).alias("n"))
    return out.drop("_w")
