"""The registered queries over the test tables, each with the SQL that checks it (None where SQL can't)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Shard, TableSpec
from .functions import cells, scalars
from .operators import aggregate, joins, scan, timeseries
from .plans.ring import RING_SQL, Ring, place, skew
from .registered import ORACLES, QUERIES, query
from .registered import sql as _sql
from .registered import t as _t
from .sources import line_protocol
from .streaming import bars, replay, sinks, topics

# ---------------------------------------------------------------- scans, projections, filters

_sql("scan_projection", "SELECT event_id, event_type, value FROM events", "events")
_sql("scan_wildcard", "SELECT * FROM nation", "nation")
_sql("keyed_filter", "SELECT event_id, ts, value FROM events WHERE event_type = 'click' AND value > 10", "events")
_sql("keyed_count_literal", "SELECT count() AS n FROM events WHERE event_type = 'click'", "events", oracle="SELECT count(*) AS n FROM events WHERE event_type = 'click'")
_sql("keyed_count_param", "SELECT count() AS n FROM events WHERE event_type = $1 AND user_id < $2", "events", params=["click", 100], oracle="SELECT count(*) AS n FROM events WHERE event_type = 'click' AND user_id < 100")
_sql("residual_filters", "SELECT event_id FROM events WHERE value IS NOT NULL AND value <> 0 AND (user_id < 40 OR user_id >= 100) AND event_type IN ('click', 'view')", "events")
_sql("distinct_key", "SELECT DISTINCT event_type FROM events", "events")
_sql("constant_select", "SELECT 1 AS ok")
_sql("global_count", "SELECT count() AS n FROM lineitem", "lineitem", oracle="SELECT count(*) AS n FROM lineitem")
_sql("global_aggregates", "SELECT round(sum(l_quantity), 2) AS s, min(l_quantity) AS low, max(l_extendedprice) AS high, round(avg(l_discount), 6) AS mean FROM lineitem", "lineitem")
_sql("quoted_identifiers", 'SELECT "event_type", "value" FROM events WHERE "user_id" = 7', "events")
_sql("cte_query", "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 100000) SELECT o_custkey, count() AS n FROM big GROUP BY o_custkey", "orders", oracle="WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 100000) SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey")
_sql("derived_table", "SELECT k, n FROM (SELECT event_type AS k, count() AS n FROM events GROUP BY event_type) AS d WHERE n > 0", "events", oracle="SELECT k, n FROM (SELECT event_type AS k, count(*) AS n FROM events GROUP BY event_type) AS d WHERE n > 0")
_sql("scalar_subquery", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)", "orders")
_sql("exists_subquery", "SELECT c_custkey FROM customer AS c WHERE EXISTS (SELECT 1 FROM orders AS o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)", "customer", "orders")
_sql("in_subquery", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)", "supplier", "nation")


@query("SELECT event_id, ts, user_id, event_type, value, props FROM events")
def shard_union_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of all shards as one table, matched by name."""
    events = _t(spark, sf, "events")
    placed = events.withColumn("s", F.pmod(F.xxhash64("event_type"), F.lit(3)))
    shards = [placed.where(F.col("s") == k).drop("s").select(*(events.columns[::-1] if k else events.columns)) for k in range(3)]
    return scan.union_shards(shards, events.schema)


@query("SELECT CAST(o_orderkey AS BIGINT) AS k, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d, o_orderdate AS t, o_totalprice AS p, o_orderkey % 2 = 0 AS b, CAST(NULL AS VARCHAR) AS missing FROM orders")
def text_cell_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Text cells to typed columns; a column that isn't there is NULL."""
    text = _t(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("K"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("t"),
        F.col("o_totalprice").cast("string").alias("p"), F.when(F.col("o_orderkey") % 2 == 0, F.lit("t")).otherwise(F.lit("f")).alias("b"),
    )
    return cells.decode(text, cells.schema_of([("k", "long"), ("d", "date"), ("t", "timestamp"), ("p", "double"), ("b", "bool"), ("missing", "symbol")])).withColumn("d", F.col("d").cast("string"))


# ---------------------------------------------------------------- aggregates

_sql("group_by_key", "SELECT event_type, count() AS n, round(avg(value), 6) AS mean FROM events GROUP BY event_type", "events", oracle="SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
_sql("group_by_multi", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS q, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus", "lineitem")
_sql("count_distinct_key", "SELECT count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS types FROM events", "events")
_sql("having_groups", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 12", "orders")
_sql("rollup_groups", "SELECT coalesce(n_regionkey, -1) AS region, n_name, count(*) AS n FROM nation GROUP BY ROLLUP (n_regionkey, n_name)", "nation")
_sql("cube_groups", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", "lineitem")
_sql("grouping_sets", "SELECT event_type, coalesce(user_id, -1) AS who, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), (user_id), ())", "events")
_sql("filtered_aggregate", "SELECT event_type, count(*) FILTER (WHERE value > 50) AS high, count(*) AS n FROM events GROUP BY event_type", "events")
_sql("first_last_by_time", "SELECT event_type, first(value) AS a, last(value) AS z FROM events GROUP BY event_type", "events", oracle="SELECT event_type, arg_min(value, ts) AS a, arg_max(value, ts) AS z FROM events GROUP BY event_type")


@query("SELECT event_type, count(value) AS \"count\", round(sum(value), 4) AS \"sum\", min(value) AS \"min\", max(value) AS \"max\", round(avg(value), 6) AS \"avg\" FROM events GROUP BY event_type")
def partial_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Partial results of shards merged; the average is the sum over the count."""
    events = _t(spark, sf, "events").withColumn("s", F.pmod("user_id", F.lit(5)))
    out = aggregate.merge(aggregate.partial(events, ["event_type"], "s", "value"), ["event_type"])
    return out.withColumns({"sum": F.round("sum", 4), "avg": F.round("avg", 6)})


@query("SELECT user_id, count(value) AS n, round(sum(value), 4) AS s FROM events GROUP BY user_id")
def salted_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.salted_sum(_t(spark, sf, "events"), ["user_id"], "value").withColumn("s", F.round("s", 4))


@query("SELECT percentile_disc(0.5) WITHIN GROUP (ORDER BY l_extendedprice) AS p50, percentile_disc(0.95) WITHIN GROUP (ORDER BY l_extendedprice) AS p95, percentile_disc(0.99) WITHIN GROUP (ORDER BY l_extendedprice) AS p99 FROM lineitem")
def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.percentiles(_t(spark, sf, "lineitem"), "l_extendedprice", 0.5, 0.95, 0.99)


_SKEW = "SELECT count(*) AS shards, CAST(sum(n) AS BIGINT) AS total, round(stddev_pop(n) / avg(n), 9) AS cv, round(max(n) / min(n), 9) AS max_min_ratio, round(sum(n * CAST(n AS DOUBLE)) / avg(n) - sum(n), 6) AS chi_square, round((max(n) / avg(n) - 1) * 100, 6) AS imbalance_pct"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({"cv": F.round("cv", 9), "max_min_ratio": F.round("max_min_ratio", 9), "chi_square": F.round("chi_square", 6), "imbalance_pct": F.round("imbalance_pct", 6)})


@query(f"{_SKEW} FROM (SELECT count(*) AS n FROM events GROUP BY user_id)")
def skew_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(aggregate.skew_statistics(_t(spark, sf, "events"), "user_id"))


@query("""WITH s AS (SELECT event_type AS name, count(*) AS ticks, arg_min(value, ts) AS o, arg_max(value, ts) AS l FROM events GROUP BY event_type), c AS (SELECT *, CASE WHEN o <> 0 THEN (l - o) / o * 100 END AS p FROM s)
SELECT count(*) AS panels, CAST(count(*) FILTER (ticks > 0) AS BIGINT) AS live, CAST(sum(ticks) AS BIGINT) AS ticks, round(avg(p), 6) AS mean_change, arg_max(name, p) AS top_gainer FROM c""")
def panel_statistics(spark: SparkSession, sf: str) -> DataFrame:
    changes = timeseries.session_change(_t(spark, sf, "events"), "value", "ts", ["event_type"])
    return aggregate.panel_statistics(changes.select(F.col("event_type").alias("name"), (F.col("ticks") > 0).alias("live"), "ticks", "change_pct")).withColumn("mean_change", F.round("mean_change", 6))


# ---------------------------------------------------------------- joins and set operations

_sql("inner_join_two_key", "SELECT a.l_orderkey AS k, a.l_linenumber AS n, a.l_quantity AS q, b.l_tax AS tax FROM lineitem AS a INNER JOIN (SELECT l_orderkey, l_linenumber, l_tax FROM lineitem WHERE l_discount > 0.02) AS b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber", "lineitem")
_sql("inner_join_inequality", "SELECT a.o_orderkey AS k, a.o_custkey AS c, b.l_quantity AS q FROM orders AS a INNER JOIN lineitem AS b ON a.o_orderkey = b.l_orderkey AND a.o_orderdate < b.l_shipdate", "orders", "lineitem")
_sql("inner_join_filtered", "SELECT l.l_orderkey AS k, p.p_name AS p, s.s_name AS s FROM lineitem AS l JOIN part AS p ON l.l_partkey = p.p_partkey JOIN supplier AS s ON l.l_suppkey = s.s_suppkey WHERE p.p_size = 10", "lineitem", "part", "supplier")
_sql("left_join_unmatched", "SELECT o.o_orderkey FROM orders AS o LEFT JOIN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) AS l ON o.o_orderkey = l.l_orderkey WHERE l.l_orderkey IS NULL", "orders", "lineitem")
_sql("right_join", "SELECT n.n_name, coalesce(s.s_suppkey, -1) AS s FROM supplier AS s RIGHT JOIN nation AS n ON s.s_nationkey = n.n_nationkey", "supplier", "nation")
_sql("full_outer_join", "SELECT coalesce(a.n_nationkey, -1) AS x, coalesce(b.r_regionkey, -1) AS y FROM nation AS a FULL OUTER JOIN region AS b ON a.n_nationkey = b.r_regionkey", "nation", "region")
_sql("cross_join_small", "SELECT a.r_name AS x, b.r_name AS y FROM region AS a CROSS JOIN region AS b", "region")
_sql("theta_join", "SELECT a.n_nationkey AS x, b.r_regionkey AS y FROM nation AS a JOIN region AS b ON a.n_nationkey < b.r_regionkey + 3", "nation", "region")
_sql("theta_join_keyed", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation AS a JOIN nation AS b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey", "nation")
_sql("natural_join", "SELECT n_name, r_name FROM nation NATURAL JOIN (SELECT r_regionkey AS n_regionkey, r_name FROM region) AS r", "nation", "region")
_sql("comma_join", "SELECT c.c_custkey, n.n_name FROM customer AS c, nation AS n WHERE c.c_nationkey = n.n_nationkey", "customer", "nation")
_sql("using_join", "SELECT user_id, a.n AS x, b.n AS y FROM (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY user_id) AS a JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY user_id) AS b USING (user_id)", "events")
_sql("semi_join", "SELECT p_partkey FROM part LEFT SEMI JOIN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) AS l ON p_partkey = l.l_partkey", "part", "lineitem", oracle="SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
_sql("union_all_keys", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey AS k FROM supplier", "customer", "supplier")
_sql("union_distinct_keys", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier", "customer", "supplier")
_sql("intersect_keys", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey AS k FROM supplier", "customer", "supplier")
_sql("except_keys", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000", "nation", "supplier")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)")
def anti_join(spark: SparkSession, sf: str) -> DataFrame:
    right = _t(spark, sf, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.unmatched(_t(spark, sf, "orders"), right, ["o_orderkey"]).select("o_orderkey")


_ASOF = "SELECT a.event_id, a.user_id, b.value AS purchase FROM (SELECT * FROM events WHERE event_type = 'click') a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') b ON a.user_id = b.user_id AND a.ts >= b.ts"


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    events = _t(spark, sf, "events")
    return events.where("event_type = 'click'").select("event_id", "user_id", "ts"), events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), F.col("value").alias("purchase"))


@query(_ASOF)
def asof_join(spark: SparkSession, sf: str) -> DataFrame:
    return joins.asof(*_sides(spark, sf), ["user_id"], "ts", "at", ["purchase"]).select("event_id", "user_id", "purchase")


@query(_ASOF)
def asof_join_sliced(spark: SparkSession, sf: str) -> DataFrame:
    return joins.asof_sliced(*_sides(spark, sf), ["user_id"], "ts", "at", ["purchase"]).select("event_id", "user_id", "purchase")


@query("SELECT l_orderkey AS k, l_quantity AS q, o_custkey AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def salted_join(spark: SparkSession, sf: str) -> DataFrame:
    left = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("q"))
    right = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    return joins.salted(left, right, ["k"])


@query("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_acctbal BETWEEN s_acctbal - 500 AND s_acctbal + 500")
def range_join(spark: SparkSession, sf: str) -> DataFrame:
    points = _t(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("k"), "c_acctbal")
    ranges = _t(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k"), (F.col("s_acctbal") - 500).alias("low"), (F.col("s_acctbal") + 500).alias("high"))
    return joins.within(points, ranges, ["k"], "c_acctbal", "low", "high", 1000.0).select("c_custkey", "s_suppkey")


# ---------------------------------------------------------------- time series

_BAR = "arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close"


def _bars_sql(step: str) -> str:
    return f"SELECT event_type, time_bucket(INTERVAL '{step}', ts) AS ts, {_BAR}, round(sum(value), 4) AS volume, count(*) AS ticks FROM events GROUP BY ALL"


def _bars(name: str, step: str, text: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return timeseries.ohlcv(_t(spark, sf, "events"), step, "value", "value", "ts", ["event_type"]).withColumn("volume", F.round("volume", 4))

    run.__name__ = name
    QUERIES[name], ORACLES[name] = run, _bars_sql(text)


for _step, _text in (("1s", "1 second"), ("1m", "1 minute"), ("5m", "5 minutes"), ("15m", "15 minutes"), ("1h", "1 hour"), ("1d", "1 day")):
    _bars(f"ohlcv_{_step}", _step, _text)

_sql("dialect_sample_by_ohlcv", "SELECT ts, first(value) AS open, max(value) AS high, min(value) AS low, last(value) AS close, count() AS ticks FROM events WHERE event_type = 'click' SAMPLE BY 1h ORDER BY ts", "events", oracle=f"SELECT time_bucket(INTERVAL '1 hour', ts) AS ts, {_BAR}, count(*) AS ticks FROM events WHERE event_type = 'click' GROUP BY 1")
_sql("dialect_sample_by_unkeyed", "SELECT ts, event_type, count() AS n, round(avg(value), 6) AS mean FROM events SAMPLE BY 15m", "events", oracle="SELECT time_bucket(INTERVAL '15 minutes', ts) AS ts, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
_sql("dialect_latest_on", "SELECT * FROM events LATEST ON ts PARTITION BY user_id", "events", oracle="SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1")
_sql("dialect_latest_on_keyed", "SELECT event_id, value FROM events WHERE event_type = $1 LATEST ON ts PARTITION BY event_type", "events", params=["view"], oracle="SELECT event_id, value FROM events WHERE event_type = 'view' ORDER BY ts DESC LIMIT 1")
_sql("chart_range", "SELECT ts, value FROM events WHERE event_type = 'click' AND user_id = 5 ORDER BY ts", "events")


@query("SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC) = 1")
def latest_on(spark: SparkSession, sf: str) -> DataFrame:
    return timeseries.latest_on(_t(spark, sf, "events"), ["event_type", "user_id"], "ts")


@query("SELECT event_id, event_type, ts FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 5")
def most_recent(spark: SparkSession, sf: str) -> DataFrame:
    return scan.latest_rows(_t(spark, sf, "events").where("event_type = 'click'").select("event_id", "event_type", "ts"), "ts", 5, "event_id")


@query("""WITH s AS (SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS ts, count(*) AS n FROM events GROUP BY ALL),
g AS (SELECT event_type, unnest(generate_series(min(ts), max(ts), INTERVAL '1 hour')) AS ts FROM s GROUP BY event_type)
SELECT g.event_type, g.ts, CAST(s.n AS DOUBLE) AS n FROM g LEFT JOIN s ON g.event_type = s.event_type AND g.ts = s.ts""")
def sample_by_fill(spark: SparkSession, sf: str) -> DataFrame:
    sampled = timeseries.sample_by(_t(spark, sf, "events"), "1h", {"n": F.count(F.lit(1)).cast("double")}, "ts", ["event_type"])
    return timeseries.fill(sampled, "1h", ["n"], "ts", ["event_type"])


@query("""WITH s AS (SELECT user_id, time_bucket(INTERVAL '1 hour', ts) AS ts, arg_max(value, ts) AS v FROM events GROUP BY ALL),
g AS (SELECT user_id, unnest(generate_series(min(ts), max(ts), INTERVAL '1 hour')) AS ts FROM s GROUP BY user_id)
SELECT g.user_id, g.ts, last_value(s.v IGNORE NULLS) OVER (PARTITION BY g.user_id ORDER BY g.ts) AS v FROM g LEFT JOIN s ON g.user_id = s.user_id AND g.ts = s.ts""")
def sample_by_fill_prev(spark: SparkSession, sf: str) -> DataFrame:
    sampled = timeseries.sample_by(_t(spark, sf, "events"), "1h", {"v": F.max_by("value", "ts")}, "ts", ["user_id"])
    return timeseries.fill(sampled, "1h", ["v"], "ts", ["user_id"], "prev")


@query("SELECT event_id, event_type, CASE WHEN count(value) OVER w >= 20 THEN round(avg(value) OVER w, 6) END AS sma FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)")
def sma_20(spark: SparkSession, sf: str) -> DataFrame:
    return timeseries.moving_average(_t(spark, sf, "events"), "value", 20, "ts", ["event_type"]).select("event_id", "event_type", F.round("sma", 6).alias("sma"))


@query("SELECT event_id, event_type, CASE WHEN count(value) OVER w >= 20 THEN round(avg(value) OVER w, 6) END AS sma FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)")
def sma_20_sliced(spark: SparkSession, sf: str) -> DataFrame:
    return timeseries.moving_average_sliced(_t(spark, sf, "events"), "value", 20, "ts", ["event_type"], slice_="6 hours").select("event_id", "event_type", F.round("sma", 6).alias("sma"))


_CHANGE = "SELECT user_id, arg_min(value, ts) AS open, arg_max(value, ts) AS last, count(*) AS ticks, arg_max(value, ts) - arg_min(value, ts) AS change, (arg_max(value, ts) - arg_min(value, ts)) / nullif(arg_min(value, ts), 0) * 100 AS change_pct FROM events WHERE value IS NOT NULL GROUP BY user_id"


@query(f"SELECT user_id, open, last, ticks, round(change, 6) AS change, round(change_pct, 6) AS change_pct FROM ({_CHANGE})")
def session_change(spark: SparkSession, sf: str) -> DataFrame:
    return timeseries.session_change(_t(spark, sf, "events"), "value", "ts", ["user_id"]).withColumns({"change": F.round("change", 6), "change_pct": F.round("change_pct", 6)})


@query(f"SELECT user_id, round(change_pct, 6) AS change_pct FROM ({_CHANGE}) ORDER BY change_pct DESC NULLS LAST, user_id LIMIT 10")
def top_movers(spark: SparkSession, sf: str) -> DataFrame:
    changes = timeseries.session_change(_t(spark, sf, "events"), "value", "ts", ["user_id"])
    return timeseries.top_movers(changes, 10, "user_id").select("user_id", F.round("change_pct", 6).alias("change_pct"))


@query("SELECT event_type, time_bucket(INTERVAL '1 second', ts) AS ts, arg_max(value, event_id) AS value, arg_max(user_id, event_id) AS user_id FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL GROUP BY ALL")
def candle_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return timeseries.upsert(_t(spark, sf, "events"), ["event_type"], "ts", ["value", "user_id"], "event_id")


@query(f"SELECT event_type, ts, CASE WHEN close >= open THEN 'up' ELSE 'down' END AS direction FROM ({_bars_sql('1 hour')})")
def volume_direction(spark: SparkSession, sf: str) -> DataFrame:
    return timeseries.direction(timeseries.ohlcv(_t(spark, sf, "events"), "1h", "value", None, "ts", ["event_type"])).select("event_type", "ts", "direction")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS b FROM events),
s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS "start", max(ts) AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def sessionize(spark: SparkSession, sf: str) -> DataFrame:
    return timeseries.sessions(_t(spark, sf, "events"), ["user_id"], "ts", "30 minutes")


# ---------------------------------------------------------------- windows, sorts, limits

_sql("rank_suite", "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS dr, ntile(4) OVER w AS q FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)", "orders", oracle="SELECT o_orderkey, CAST(row_number() OVER w AS INTEGER) AS rn, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS INTEGER) AS rk, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS INTEGER) AS dr, CAST(ntile(4) OVER w AS INTEGER) AS q FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
_sql("lag_lead", "SELECT event_id, lag(value) OVER w AS before, lead(value, 2) OVER w AS after, first_value(value) OVER w AS f, nth_value(value, 2) OVER w AS second FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)", "events")
_sql("distribution_ranks", "SELECT o_orderkey, round(percent_rank() OVER w, 9) AS p, round(cume_dist() OVER w, 9) AS c FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey)", "orders")
_sql("running_sum", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS s FROM events", "events")
_sql("order_limit_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", "orders")
_sql("limit_offset", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 20 OFFSET 100", "customer")


@query("SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL '1 hour' PRECEDING AND CURRENT ROW) AS n FROM events")
def range_frame(spark: SparkSession, sf: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    rows = _t(spark, sf, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).select("event_id", "event_type", "us")
    return timeseries.range_counts(rows, ["event_type"], "us", 3_600_000_000, 3_600_000_000).select("event_id", "n")


@query("SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL '1 hour' PRECEDING AND CURRENT ROW) AS n FROM events")
def range_frame_sliced(spark: SparkSession, sf: str) -> DataFrame:
    """The same frames where a key's rows are dealt over slices of a day."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    rows = _t(spark, sf, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).select("event_id", "event_type", "us")
    return timeseries.range_counts(rows, ["event_type"], "us", 3_600_000_000, 86_400_000_000).select("event_id", "n")


@query("SELECT event_id, event_type, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 500")
def ring_buffer(spark: SparkSession, sf: str) -> DataFrame:
    """The last 500 rows of each topic."""
    return timeseries.last_n(_t(spark, sf, "events").select("event_id", "event_type", "ts", "value"), ["event_type"], ["event_id"], 500).drop("seq")


# ---------------------------------------------------------------- scalars

_sql("string_functions", "SELECT c_custkey, lower(c_name) AS a, upper(c_mktsegment) AS b, substring(c_name, 1, 8) AS c, split_part(c_name, '#', 2) AS d, concat(c_mktsegment, '@', c_name) AS e, replace(c_name, '#', '') AS f, length(c_name) AS n FROM customer", "customer", oracle="SELECT c_custkey, lower(c_name) AS a, upper(c_mktsegment) AS b, substring(c_name, 1, 8) AS c, split_part(c_name, '#', 2) AS d, concat(c_mktsegment, '@', c_name) AS e, replace(c_name, '#', '') AS f, CAST(length(c_name) AS INTEGER) AS n FROM customer")
_sql("date_functions", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, CAST(CAST(o_orderdate AS DATE) AS STRING) AS whole FROM orders", "orders", oracle="SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS whole FROM orders")
_sql("math_functions", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * (1 - l_discount), 4) AS net, floor(l_quantity) AS f, abs(l_tax - 0.05) < 0.011 AS near FROM lineitem", "lineitem", oracle="SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * (1 - l_discount), 4) AS net, CAST(floor(l_quantity) AS BIGINT) AS f, abs(l_tax - 0.05) < 0.011 AS near FROM lineitem")
_sql("json_extract", "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM events", "events", oracle="SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
_sql("conditional_functions", "SELECT event_id, coalesce(nullif(event_type, 'click'), 'none') AS t, CASE WHEN value > 50 THEN 'high' WHEN value > 10 THEN 'mid' ELSE 'low' END AS band FROM events", "events")


@query("SELECT event_id, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS s, round((value - 50) / 50.0 * 100, 6) AS pct FROM events")
def epoch_units(spark: SparkSession, sf: str) -> DataFrame:
    """Epoch numbers in ns, us, ms and s, told apart by their size."""
    events = _t(spark, sf, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    any_unit = F.when(F.col("event_id") % 4 == 0, F.col("us") * 1000).when(F.col("event_id") % 4 == 1, F.col("us")).when(F.col("event_id") % 4 == 2, F.expr("us div 1000")).otherwise(F.expr("us div 1000000"))
    return events.select("event_id", scalars.epoch_seconds(any_unit).alias("s"), F.round(scalars.percent_change(F.col("value"), F.lit(50.0)), 6).alias("pct"))


# ---------------------------------------------------------------- placement

_SHARDS = tuple(Shard(k) for k in (1, 2))


def _ring_sql(tail: str, table: str = "events", key: str = "user_id") -> str:
    return RING_SQL.format(shards="1, 2", nodes=128, key=key, table=table) + tail


@query(_ring_sql("SELECT CAST(k AS BIGINT) AS user_id, shard FROM placed"))
def ring_placement(spark: SparkSession, sf: str) -> DataFrame:
    keys = _t(spark, sf, "events").select("user_id").distinct()
    return place(keys, Ring(_SHARDS), "user_id", "shard")


@query(_ring_sql("SELECT CAST(k AS BIGINT) AS user_id, shard FROM placed"))
def ring_expression(spark: SparkSession, sf: str) -> DataFrame:
    keys = _t(spark, sf, "events").select("user_id").distinct()
    return keys.withColumn("shard", Ring(_SHARDS).column(F.col("user_id")))


@query(_ring_sql(f", counted AS (SELECT shard, count(*) AS n FROM events JOIN placed ON CAST(user_id AS VARCHAR) = k GROUP BY shard) {_SKEW} FROM counted"))
def ring_skew(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(skew(_t(spark, sf, "events").withColumn("_shard", Ring(_SHARDS).column(F.col("user_id")))))


_THREE = tuple(Shard(k, virtual_nodes=16) for k in (1, 2, 3))
_FAILOVER = """
WITH RECURSIVE ring AS (SELECT md5(s || '-' || v) AS token, s AS shard FROM (SELECT unnest([1, 2, 3]) AS s), (SELECT unnest(range(16)) AS v)),
keys AS (SELECT DISTINCT user_id, CAST(user_id AS VARCHAR) AS k FROM events),
tries AS (SELECT user_id, 0 AS n, md5(k) AS h FROM keys UNION ALL SELECT user_id, n, md5(k || '#' || n) AS h FROM keys, (SELECT unnest(range(1, 17)) AS n)),
owned AS (SELECT t.user_id, t.n, coalesce(r.shard, (SELECT arg_min(shard, token) FROM ring)) AS shard FROM tries t ASOF LEFT JOIN ring r ON t.h <= r.token)
SELECT user_id, CAST(coalesce(arg_min(shard, n) FILTER (shard <> 2), 1) AS INTEGER) AS shard FROM owned GROUP BY user_id
"""


@query(_FAILOVER)
def ring_failover(spark: SparkSession, sf: str) -> DataFrame:
    """With one of three shards excluded, its keys are probed under salted names; all others stay where they are."""
    keys = _t(spark, sf, "events").select("user_id").distinct()
    return keys.withColumn("shard", Ring(_THREE).failover_column(F.col("user_id"), {2}))


@query("SELECT DISTINCT user_id, 2 AS shard FROM events")
def ring_failover_single(spark: SparkSession, sf: str) -> DataFrame:
    """With one of two shards excluded every key finds the other."""
    keys = _t(spark, sf, "events").select("user_id").distinct()
    return keys.withColumn("shard", Ring(_SHARDS).failover_column(F.col("user_id"), {1}))


# ---------------------------------------------------------------- line protocol and topics


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return line_protocol.render(_t(spark, sf, "events"), "events", ["event_type", "user_id"], ["event_id", "value"], "ts")


_ROUND_TRIP = "SELECT event_id, ts, user_id, event_type, value FROM events"
_EVENTS_SPEC = TableSpec("events", (("event_id", "long"), ("ts", "timestamp"), ("user_id", "string"), ("event_type", "symbol"), ("value", "double")), timestamp="ts")


@query(_ROUND_TRIP)
def line_protocol_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Events as lines, parsed and projected to the table's columns."""
    out = line_protocol.project(line_protocol.parse(_lines(spark, sf)), _EVENTS_SPEC)
    return out.withColumn("user_id", F.col("user_id").cast("long"))


@query(_ROUND_TRIP)
def line_protocol_strict(spark: SparkSession, sf: str) -> DataFrame:
    out = line_protocol.project(line_protocol.parse(_lines(spark, sf), strict=True), _EVENTS_SPEC)
    return out.withColumn("user_id", F.col("user_id").cast("long"))


@query("SELECT 'events' AS m, event_type AS k, count(*) AS n FROM events GROUP BY event_type")
def line_routing_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Measurement and key of lines, without parsing them whole."""
    lines = _lines(spark, sf).select(line_protocol.measurement(F.col("value")).alias("m"), line_protocol.shard_key(F.col("value"), "EVENT_TYPE").alias("k"))
    return lines.groupBy("m", "k").agg(F.count("*").alias("n"))


@query("SELECT event_id, event_type || '@' || coalesce(CAST(nullif(user_id % 7, 0) AS VARCHAR), '*') AS topic FROM events")
def topic_derive(spark: SparkSession, sf: str) -> DataFrame:
    events = _t(spark, sf, "events")
    return events.select("event_id", topics.topic_of([F.col("event_type"), F.nullif(F.col("user_id") % 7, F.lit(0))]).alias("topic"))


@query("SELECT event_type AS topic, event_id, value, CAST(row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS INTEGER) AS seq FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 20)")
def replay_last_n(spark: SparkSession, sf: str) -> DataFrame:
    ticks = _t(spark, sf, "events").select(F.col("event_type").alias("topic"), "event_id", "value")
    return replay.replay(ticks, 20, "event_id")


# ---------------------------------------------------------------- streaming


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    """The events table as a stream of its file or files."""
    schema = _t(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(f"{sf}/")


def _plain_file(spark: SparkSession, sf: str) -> DataFrame:
    return bars.instants(_stream(spark, sf))


@query(f"SELECT event_type, CAST(time_bucket(INTERVAL '1 hour', ts) AS TIMESTAMP) AS ts, {_BAR}, count(*) AS ticks FROM events GROUP BY 1, 2")
def streaming_ohlcv(spark: SparkSession, sf: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    out = bars.live_ohlcv(_plain_file(spark, sf), "1 hour", "value", ["event_type"])
    done = sinks.run_to_table(out, "streaming_ohlcv", "complete")
    return done.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("SELECT event_type AS topic, event_id AS arrival, value, CAST(row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS INTEGER) AS seq FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 5)")
def streaming_replay(spark: SparkSession, sf: str) -> DataFrame:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    ticks = _stream(spark, sf).select(F.col("event_type").alias("topic"), "event_id", "value")
    return sinks.run_to_memory(replay.live_replay(ticks, 5), f"streaming_replay_{abs(hash(sf)) % 10**9}", "update")


def _approximate(spark: SparkSession, sf: str) -> DataFrame:
    """Approximate distinct users and the median, each within a twentieth of the exact one."""
    # repetitions go first: beside count_distinct, Spark would keep a sketch for each pair of type and user
    users = _t(spark, sf, "events").select("event_type", "user_id").distinct()
    out = users.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("a"), F.count("user_id").alias("n"))
    return out.select("event_type", (F.abs(F.col("a") - F.col("n")) <= F.col("n") * 0.1).alias("close"))


QUERIES["approximate_distinct"], ORACLES["approximate_distinct"] = _approximate, "SELECT DISTINCT event_type, true AS close FROM events"


@query("""WITH s AS (SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS ts, avg(value) AS v FROM events WHERE user_id % 9 = 0 GROUP BY ALL),
g AS (SELECT event_type, unnest(generate_series(min(ts), max(ts), INTERVAL '1 hour')) AS ts FROM s GROUP BY event_type),
j AS (SELECT g.event_type, g.ts, epoch(g.ts) AS t, s.v, CASE WHEN s.v IS NOT NULL THEN epoch(g.ts) END AS p FROM g LEFT JOIN s ON g.event_type = s.event_type AND g.ts = s.ts),
b AS (SELECT *, last_value(p IGNORE NULLS) OVER w AS t0, last_value(v IGNORE NULLS) OVER w AS v0, first_value(p IGNORE NULLS) OVER u AS t1, first_value(v IGNORE NULLS) OVER u AS v1 FROM j
      WINDOW w AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), u AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_type, ts, round(CASE WHEN v IS NOT NULL THEN v ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END, 5) AS v FROM b""")
def sample_by_fill_linear(spark: SparkSession, sf: str) -> DataFrame:
    sampled = timeseries.sample_by(_t(spark, sf, "events").where("user_id % 9 = 0"), "1h", {"v": F.avg("value")}, "ts", ["event_type"])
    return timeseries.fill(sampled, "1h", ["v"], "ts", ["event_type"], "linear").withColumn("v", F.round("v", 5))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly bars per event type."""
    return QUERIES["ohlcv_1h"](spark, sf)


from . import cluster_queries, source_queries, stream_queries  # noqa: E402, F401  (they add to the register)
