"""The SQL engine and the operators behind it, on small tables."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shardloom.config import Config, Routing
from shardloom.errors import DisabledError, NotFoundError, RowLimitError, UnsupportedError
from shardloom.operators import aggregate, joins, timeseries
from shardloom.plans.engine import Engine

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture()
def ticks(spark):
    """Four prices an hour for two symbols; the first hour of A is 100, 120, 95, 110."""
    rows = [(s, T0 + dt.timedelta(hours=h, minutes=15 * i), p + 10.0 * h + (0 if s == "A" else 1000), 1.0) for s in "AB" for h in (0, 1, 3) for i, p in enumerate((100, 120, 95, 110))]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, price double, volume double").repartition(5)


def test_bars(ticks):
    first = timeseries.ohlcv(ticks, "1h", "price", "volume", "ts", ["symbol"]).where("symbol = 'A'").orderBy("ts").first()
    assert (first["open"], first["high"], first["low"], first["close"], first["volume"], first["ticks"]) == (100, 120, 95, 110, 4, 4)


def test_no_empty_bucket_and_fills(ticks):
    hours = timeseries.sample_by(ticks, "1h", {"p": F.max_by("price", "ts")}, "ts", ["symbol"])
    assert hours.count() == 6
    get = lambda how: [r["p"] for r in timeseries.fill(hours, "1h", ["p"], "ts", ["symbol"], how).where("symbol = 'A'").orderBy("ts").collect()]
    assert get("null") == [110, 120, None, 140] and get("prev") == [110, 120, 120, 140] and get("linear") == [110, 120, 130, 140]


def test_engine_dialect(spark, ticks):
    e = Engine(spark)
    e.register("ticks", ticks)
    assert e.fetch("SELECT count() FROM ticks WHERE symbol = $1", ["A"])[0][0] == 12
    assert len(e.fetch("SELECT * FROM ticks LATEST ON ts PARTITION BY symbol")) == 2
    assert [r["a"] for r in e.fetch("SELECT ts, first(price) AS a FROM ticks WHERE symbol = 'A' SAMPLE BY 1h ORDER BY ts")] == [100, 110, 130]
    assert e.fetch("WITH x AS (SELECT ts, count() AS n FROM ticks SAMPLE BY 1h) SELECT max(n) AS m FROM x")[0]["m"] == 8
    assert e.sql("BEGIN").count() == 0


def test_guards(spark, ticks):
    e = Engine(spark, Config(routing=Routing(max_federated_rows=5)))
    e.register("ticks", ticks)
    with pytest.raises(NotFoundError):
        e.sql("SELECT * FROM nowhere")
    with pytest.raises(UnsupportedError):
        e.sql("UPDATE ticks SET price = 1")
    with pytest.raises(RowLimitError) as r:
        e.fetch("SELECT * FROM ticks")
    assert r.value.sqlstate == "53400"
    off = Engine(spark, Config(routing=Routing(federated_enabled=False)))
    off.register("ticks", ticks)
    with pytest.raises(DisabledError):
        off.sql("SELECT count() FROM ticks")
    assert off.sql("SELECT count() FROM ticks WHERE symbol = 'A'").first()[0] == 12


def test_average_over_unequal_shards(spark):
    df = spark.createDataFrame([("k", 1, 10.0)] + [("k", 2, 1.0)] * 9, "k string, s int, v double")
    assert aggregate.merge(aggregate.partial(df, ["k"], "s", "v"), ["k"]).first()["avg"] == pytest.approx(1.9)


def test_latest_and_last_n(ticks):
    assert {r["symbol"]: r["price"] for r in timeseries.latest_on(ticks, ["symbol"]).collect()} == {"A": 140, "B": 1140}
    tail = timeseries.last_n(ticks, ["symbol"], ["ts"], 3).where("symbol = 'A'").orderBy("seq").collect()
    assert [(r["seq"], r["price"]) for r in tail] == [(1, 150), (2, 125), (3, 140)]


def test_moving_average_needs_enough_points(spark):
    df = spark.createDataFrame([("k", T0 + dt.timedelta(seconds=i), float(i)) for i in range(25)], "k string, ts timestamp_ntz, v double")
    out = [r["sma"] for r in timeseries.moving_average(df, "v", 20, "ts", ["k"]).orderBy("ts").collect()]
    assert out[18] is None and out[19] == 9.5 and out[24] == 14.5


def test_upsert_and_changes(spark):
    df = spark.createDataFrame([("k", T0, 1, 5.0), ("k", T0, 2, 6.0), ("k", T0 + dt.timedelta(seconds=1), 3, None), ("z", T0, 4, 0.0)], "k string, ts timestamp_ntz, n int, v double")
    assert {(r["k"], r["v"]) for r in timeseries.upsert(df, ["k"], "ts", ["v"], "n").collect()} == {("k", 6.0), ("z", 0.0)}
    top = timeseries.top_movers(timeseries.session_change(df, "v", "ts", ["k"]), 5, "k").collect()
    assert [r["k"] for r in top] == ["k", "z"] and top[1]["change_pct"] is None


def test_asof_forms_agree(spark):
    left = spark.createDataFrame([("a", T0 + dt.timedelta(hours=7 * i), i) for i in range(20)] + [("b", T0, 99)], "k string, ts timestamp_ntz, n int")
    right = spark.createDataFrame([("a", T0 + dt.timedelta(hours=5 * i), 100 + i) for i in range(1, 9)], "k string, at timestamp_ntz, v int")
    one = {r["n"]: r["v"] for r in joins.asof(left, right, ["k"], "ts", "at", ["v"]).collect()}
    two = {r["n"]: r["v"] for r in joins.asof_sliced(left, right, ["k"], "ts", "at", ["v"]).collect()}
    assert one == two and one[0] is None and one[99] is None and one[5] == 107 and one[19] == 108


def test_anti_join_and_range_join(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    assert [r["k"] for r in joins.unmatched(a, a.where("k = 1"), ["k"]).collect()] == [2]
    p = spark.createDataFrame([("x", 1.0), ("x", 250.0)], "k string, at double")
    r = spark.createDataFrame([("x", 0.0, 500.0), ("x", 2.0, 1.0)], "k string, low double, high double")
    assert joins.within(p, r, ["k"], "at", "low", "high", 100.0).count() == 2


@pytest.mark.parametrize("how", ["inner", "left", "right", "full", "left_semi", "left_anti"])
def test_salted_joins_equal_plain_ones(spark, how):
    left = spark.createDataFrame([(1, "a")] * 20 + [(2, "b"), (3, "c"), (None, "d")], "k int, x string").repartition(3)
    right = spark.createDataFrame([(1, 10), (1, 11), (4, 40), (5, 50), (None, 60)], "k int, y int").repartition(2)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(joins.salted(left, right, ["k"], 4, how)) == rows(left.join(right, ["k"], how))


@pytest.mark.parametrize("how", ["inner", "left", "right", "full", "left_semi", "left_anti"])
def test_salted_joins_with_a_crowd_equal_plain_ones(spark, how):
    left = spark.createDataFrame([(1, "a")] * 20 + [(2, "b"), (3, "c"), (None, "d")], "k int, x string").repartition(3)
    right = spark.createDataFrame([(1, 10), (1, 11), (3, 30), (4, 40), (None, 60)], "k int, y int").repartition(2)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(joins.salted(left, right, ["k"], 4, how, crowd=5)) == rows(left.join(right, ["k"], how))


def test_salted_join_copies_crowds_alone_and_shuffles_them(spark):
    left = spark.range(1000).select(F.when(F.col("id") < 900, 7).otherwise(F.col("id")).cast("int").alias("k"))
    right = spark.range(1000).select(F.col("id").cast("int").alias("k"), F.lit(1).alias("y"))
    out = joins.salted(left, right, ["k"], 16, crowd=100)
    plan = out._jdf.queryExecution().executedPlan()
    assert out.count() == 1000 and "SortMergeJoin" in plan.toString()
    generated = out._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" in generated and "_crowd" in generated


@pytest.mark.parametrize("values", [[float(i * 7919 % 10007) for i in range(10007)], [1.0] * 5000 + [2.0] * 5000 + [3.0], [5.0], [None, 2.0, 1.0, None]])
def test_percentiles_are_exact(spark, values, monkeypatch):
    monkeypatch.setattr(aggregate, "FEW", 100)
    df = spark.createDataFrame([(v,) for v in values], "v double")
    want = df.agg(*(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY v)") for p in (0.01, 0.5, 0.95, 0.99))).first()
    assert tuple(aggregate.percentiles(df, "v", 0.01, 0.5, 0.95, 0.99).first()) == tuple(want)
    assert aggregate.percentiles(df.limit(0), "v", 0.5).first()[0] is None


def test_latest_on_keeps_keys_without_a_time(spark):
    e = Engine(spark)
    e.register("q", spark.createDataFrame([("a", None, 1.0), ("b", None, 2.0), ("b", T0, 3.0)], "symbol string, ts timestamp_ntz, p double"))
    assert sorted(tuple(r) for r in e.fetch("SELECT symbol, p FROM q LATEST ON ts PARTITION BY symbol")) == [("a", 1.0), ("b", 3.0)]


def test_colocated_join_has_no_exchange(spark):
    from shardloom.queries import QUERIES

    plan = QUERIES["colocated_join"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_socket_source(spark):
    import socket
    import threading

    from shardloom.sources import line_protocol
    from shardloom.streaming import sinks

    server = socket.create_server(("127.0.0.1", 0))

    def serve():
        client, _ = server.accept()
        client.sendall(b"trades,symbol=A price=1.5 7\nnothing\ntrades,symbol=B price=2i 8\n")
        done.wait(20)
        client.close()

    done = threading.Event()
    threading.Thread(target=serve, daemon=True).start()
    rows = line_protocol.parse(line_protocol.stream_socket(spark, "127.0.0.1", server.getsockname()[1]))
    query = rows.writeStream.format("memory").queryName("socket_lines").start()
    for _ in range(100):
        query.processAllAvailable()
        if spark.table("socket_lines").count() == 2:
            break
    done.set()
    query.stop()
    assert {r["timestamp_ns"] for r in spark.table("socket_lines").collect()} == {7, 8} and sinks


def test_within_cuts_crowded_cells_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(joins, "PAIRS", 5_000)
    p = spark.range(600).select((F.col("id") % 2).cast("int").alias("k"), F.col("id").alias("p"), (F.col("id") % 50 + 0.5).alias("at"))
    r = spark.range(90).select((F.col("id") % 3).cast("int").alias("k"), F.col("id").alias("r"), (F.col("id") % 40 - 10.0).alias("low"), (F.col("id") % 40 + 10.0).alias("high"))
    want = p.join(r, "k").where("at BETWEEN low AND high")
    out = joins.within(p, r, ["k"], "at", "low", "high", 20.0, side=7)
    rows = lambda df: sorted(tuple(x) for x in df.select("k", "p", "r").collect())
    assert rows(out) == rows(want)
    shares = out.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert len(shares) > 2 and max(x["count"] for x in shares) < out.count() / 2


def test_range_counts_equal_frames(spark):
    rows = [("a", i, None if i == 5 else (i * 37) % 211 - 50) for i in range(150)] + [("b", 1000, 3), ("b", 1001, 3), (None, 1002, 10), (None, 1003, 12)]
    df = spark.createDataFrame(rows, "k string, id int, us bigint")
    w = Window.partitionBy("k").orderBy("us").rangeBetween(-20, 0)
    plain = lambda x: sorted(map(tuple, x.select("id", "n").collect()))
    want = plain(df.withColumn("n", F.count(F.lit(1)).over(w)))
    for slice_ in (7, 20, 1000):
        assert plain(timeseries.range_counts(df, ["k"], "us", 20, slice_)) == want


@pytest.mark.parametrize("name", ["range_frame", "range_frame_sliced"])
def test_range_frames_are_running_sums_of_slices(spark, name):
    from shardloom.queries import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "specifiedwindowframe(RangeFrame, -" not in plan and "_slice" in plan


def test_approximate_distinct_keeps_no_sketch_for_each_user(spark):
    from shardloom.queries import QUERIES

    plan = QUERIES["approximate_distinct"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "keys=[event_type" in x and "user_id" in x.split("functions=")[0] and "approx_count_distinct" in x]
