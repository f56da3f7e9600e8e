"""Streams over files: bars, late rows, replay, sharded sink."""

import datetime as dt

import pytest

from shardloom import queries
from shardloom.config import Shard
from shardloom.plans.ring import Ring
from shardloom.streaming import bars, replay, sinks

T0 = dt.datetime(2024, 1, 1)
SHAPE = "symbol string, ts timestamp, price double, n bigint"


def source(spark, path, rows):
    """Each list of rows becomes a file; one file a batch."""
    for k, part in enumerate(rows):
        spark.createDataFrame(part, SHAPE).coalesce(1).write.mode("append").parquet(f"{path}/{k}")
    return lambda: spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(path))


def test_live_bars_match_batch(spark, tmp_path):
    rows = [[("A", T0 + dt.timedelta(minutes=m), float(m), m) for m in range(130)]]
    read = source(spark, tmp_path / "in", rows)
    live = sinks.run_to_memory(bars.live_ohlcv(read(), "1 hour", "price", ["symbol"]), "live_bars", "complete")
    batch = bars.live_ohlcv(spark.createDataFrame(rows[0], SHAPE), "1 hour", "price", ["symbol"])
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, batch.collect())) and batch.count() == 3


def test_late_rows_are_dropped(spark, tmp_path):
    early, late = ("A", T0, 1.0, 1), ("A", T0 + dt.timedelta(hours=5), 2.0, 2)
    read = source(spark, tmp_path / "in", [[early], [late], [late], [("A", T0, 9.0, 3)]])
    out = sinks.run_to_memory(bars.live_ohlcv(read(), "1 hour", "price", ["symbol"]), "late_bars", "append")
    assert [(r["open"], r["ticks"]) for r in out.collect()] == [(1.0, 1)]


def test_replay_keeps_the_last_rows(spark, tmp_path):
    rows = [[("A", T0, float(i), i) for i in range(k * 4, k * 4 + 4)] for k in range(3)]
    read = source(spark, tmp_path / "in", rows)
    ticks = read().selectExpr("symbol AS topic", "n AS event_id", "price AS value")
    out = sinks.run_to_memory(replay.live_replay(ticks, 5), "live_replay", "update")
    last = out.where("arrival >= 7").groupBy("arrival").count()
    assert {r["arrival"] for r in last.collect()} == {7, 8, 9, 10, 11}
    whole = spark.createDataFrame([("A", i, float(i)) for i in range(12)], "topic string, event_id bigint, value double")
    assert [r["event_id"] for r in replay.replay(whole, 3, "event_id", only="A").orderBy("seq").collect()] == [9, 10, 11]
    assert replay.replay(whole, 3, "event_id", only="nope").count() == 0


def test_sharded_sink_is_idempotent(spark, tmp_path):
    rows = [[(f"S{i % 5}", T0 + dt.timedelta(hours=i), float(i), i) for i in range(40)]]
    read = source(spark, tmp_path / "in", rows)
    ring = Ring([Shard(1), Shard(2)])
    for mark in ("a", "b"):  # a lost checkpoint replays the batch onto itself
        sinks.write_sharded(read(), str(tmp_path / "out"), str(tmp_path / mark), ring, "symbol", "ts").awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 40


def test_deduplication_and_windows_on_tables(spark):
    df = spark.createDataFrame([("A", T0, 1.0, 1), ("A", T0, 1.0, 1), ("A", T0 + dt.timedelta(minutes=50), 2.0, 2)], SHAPE)
    assert bars.once(df, ["symbol", "n"]).count() == 2
    assert bars.sliding(df, "1 hour", "30 minutes", "price", ["symbol"]).count() == 3
    assert bars.live_sessions(df, "10 minutes", ["symbol"]).count() == 2


def test_run_to_memory_waits_for_the_end():
    class Slow:
        """A stream that takes longer than any limit; its table is whole once it was waited for without one."""

        done = False
        writeStream = sparkSession = property(lambda self: self)
        format = queryName = outputMode = trigger = lambda self, *_, **__: self
        start = lambda self: self

        def awaitTermination(self, timeout=None):
            self.done = timeout is None
            return self.done

        def stop(self):
            pass

        def table(self, name):
            return "whole" if self.done else "part"

    assert sinks.run_to_memory(Slow(), "slow", "append") == "whole"


def test_tables_of_streams_come_from_files(spark, tmp_path):
    rows = [[("A", T0 + dt.timedelta(minutes=m), float(m), m) for m in range(k * 50, k * 50 + 50)] for k in range(3)]
    read = source(spark, tmp_path / "in", rows)
    want = spark.createDataFrame(sum(rows, []), SHAPE)
    plain = lambda df: sorted(map(tuple, df.collect()))
    once = sinks.run_to_table(bars.once(read(), ["n"]), "once", "append")
    assert plain(once) == plain(want) and len(once.inputFiles()) > 2
    live = sinks.run_to_table(bars.live_ohlcv(read(), "1 hour", "price", ["symbol"]), "bars", "complete")
    assert plain(live) == plain(bars.live_ohlcv(want, "1 hour", "price", ["symbol"]))
    none = sinks.run_to_table(read().where("n < 0"), "none", "append")
    assert none.count() == 0 and none.columns == want.columns


@pytest.mark.parametrize("name", ["streaming_once", "streaming_sessions", "streaming_join", "streaming_sliding", "streaming_ohlcv"])
def test_results_of_streams_are_not_kept_in_the_driver(spark, name):
    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MemoryPlan" not in plan and "LocalRelation" not in plan and "Relation [" in plan


def test_replay_holds_no_more_than_its_rows_and_a_chunk():
    import tracemalloc

    chunks = ([(k * 1000 + i, float(i)) for i in range(1000)] for k in range(200))
    tracemalloc.start()
    assert replay.last_rows([(-1, 0.0)], chunks, 5) == [(199_995 + i, 995.0 + i) for i in range(5)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2_000_000 and replay.last_rows([(3, None)], [[(1, 2.0), (3, None)]], 5) == [(1, 2.0), (3, None)]
