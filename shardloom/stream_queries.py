"""Registered queries about topics, subscriptions and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Shard, TableSpec
from .plans.ring import SHARD_COLUMN, Ring
from .registered import query, t
from .registry import TableRegistry
from .session import scratch
from .sources import line_protocol
from .streaming import bars, sinks, topics


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    """The events table as a stream of its file or files."""
    return spark.readStream.schema(t(spark, sf, "events").schema).option("pathGlobFilter", "events*.parquet").parquet(f"{sf}/")


def _utc(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.session.timeZone", "UTC")


# ---------------------------------------------------------------- topics


def _published(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of a sharded table, of one that isn't, and of an unknown one, as they are published."""
    events = t(spark, sf, "events")
    tables = [("ticks", "event_id % 4 < 2"), ("local", "event_id % 4 = 2"), ("stray", "event_id % 4 = 3")]
    lines = [line_protocol.render(events.where(rule).withColumn("side", F.when(F.col("user_id") % 3 != 0, F.col("user_id") % 3)), name, ["event_type", "side"], ["event_id", "value"], "ts") for name, rule in tables]
    registry = TableRegistry([TableSpec("ticks"), TableSpec("local", sharded=False)])
    out = topics.publish(lines[0].union(lines[1]).union(lines[2]), registry, ["event_type", "side"])
    return out.select("topic", F.get(F.filter("fields", lambda x: x["k"] == "event_id"), 0)["i"].alias("event_id"))


_PUBLISHED = "SELECT event_type || '@' || CASE WHEN user_id % 3 = 0 THEN '*' ELSE CAST(user_id % 3 AS VARCHAR) END AS topic, event_id FROM events WHERE event_id % 4 < 2"


@query(_PUBLISHED)
def publish_topics(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of declared, sharded tables with their topics; others aren't published."""
    return _published(spark, sf)


@query(f"SELECT 'named' AS who, topic, event_id FROM ({_PUBLISHED}) WHERE topic IN ('click@1', 'view@*') UNION ALL SELECT 'both', topic, event_id FROM ({_PUBLISHED}) UNION ALL SELECT 'case', topic, event_id FROM ({_PUBLISHED}) WHERE false")
def subscribed_topics(spark: SparkSession, sf: str) -> DataFrame:
    """Topics are exact; a tick that a topic and the wildcard ask for comes once."""
    ticks = _published(spark, sf)
    asked = {"named": {"click@1", "view@*"}, "both": {"click@1", "*"}, "case": {"CLICK@1"}}
    named, both, case = (topics.subscribed(ticks, wanted).select(F.lit(who).alias("who"), "topic", "event_id") for who, wanted in asked.items())
    return named.union(both).union(case)


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'subscribe' WHEN 1 THEN 'unsubscribe' ELSE 'replay' END AS op, CASE WHEN event_id % 6 < 2 THEN event_type || ',b' END AS topics, CASE WHEN event_id % 6 = 2 THEN event_type END AS topic, CASE WHEN event_id % 6 = 2 THEN CAST(user_id AS INTEGER) ELSE -1 END AS last_n FROM events WHERE event_id % 6 < 3""")
def control_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Control messages; unknown operations, incomplete ones and text that isn't JSON are left out."""
    n = F.col("event_id")
    both = F.to_json(F.struct(F.when(n % 6 == 0, "subscribe").otherwise("unsubscribe").alias("op"), F.array("event_type", F.lit("b")).alias("topics")))
    last = F.to_json(F.struct(F.lit("replay").alias("op"), F.col("event_type").alias("topic"), F.col("user_id").alias("last_n")))
    body = F.when(n % 6 < 2, both).when(n % 6 == 2, last).when(n % 6 == 3, '{"op":"dance","topics":["a"]}').when(n % 6 == 4, '{"op":"subscribe"}').otherwise("no json")
    messages = t(spark, sf, "events").select("event_id", body.alias("value"))
    return topics.controls(messages, kept=["event_id"]).select("event_id", "op", F.array_join("topics", ",").alias("topics"), "topic", F.coalesce("last_n", F.lit(-1)).alias("last_n"))


@query("""WITH m AS (SELECT user_id AS client, event_id, value < 50 AS wanted, unnest([event_type, 'all']) AS topic FROM events)
SELECT client, topic FROM m GROUP BY client, topic HAVING arg_max(wanted, event_id)""")
def subscription_state(spark: SparkSession, sf: str) -> DataFrame:
    """Who is subscribed to what after all control messages."""
    op = F.when(F.col("value") < 50, "subscribe").otherwise("unsubscribe")
    messages = t(spark, sf, "events").select(F.col("user_id").alias("client"), "event_id", op.alias("op"), F.array("event_type", F.lit("all")).alias("topics"))
    return topics.subscriptions(messages, "event_id")


@query("SELECT user_id AS client, count(*) AS received, greatest(count(*) - 40, 0) AS dropped, count(*) - 40 >= 30 AS disconnected FROM events GROUP BY user_id")
def slow_consumers(spark: SparkSession, sf: str) -> DataFrame:
    """What a full queue costs each client, and who lags too far behind to stay connected."""
    return topics.lag(t(spark, sf, "events").select(F.col("user_id").alias("client")), capacity=40, most=30)


# ---------------------------------------------------------------- streams


@query("""SELECT event_type, CAST(w AS TIMESTAMP) AS ts, count(*) AS n, round(avg(value), 6) AS mean
FROM (SELECT event_type, value, unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS w FROM events) GROUP BY event_type, w""")
def streaming_sliding(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of an hour that begin every half hour."""
    _utc(spark)
    out = bars.sliding(bars.instants(_stream(spark, sf)), "1 hour", "30 minutes", "value", ["event_type"])
    done = sinks.run_to_table(out, "streaming_sliding", "complete")
    return done.withColumns({"ts": F.col("ts").cast("timestamp_ntz"), "mean": F.round("mean", 6)})


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS b FROM events),
s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS "start", max(ts) + INTERVAL '30 minutes' AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def streaming_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of a stream that end after half an hour of silence."""
    _utc(spark)
    done = sinks.run_to_table(bars.live_sessions(bars.instants(_stream(spark, sf)), "30 minutes", ["user_id"]), "streaming_sessions", "complete")
    return done.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("SELECT event_id, event_type, value FROM events")
def streaming_once(spark: SparkSession, sf: str) -> DataFrame:
    """A stream that delivers every row twice, without the repetitions."""
    _utc(spark)
    events = bars.instants(_stream(spark, sf))
    twice = events.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return sinks.run_to_table(bars.once(twice, ["event_id"]), "streaming_once", "append").select("event_id", "event_type", "value")


@query("SELECT a.event_id AS click, b.event_id AS purchase FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL '20 minutes' WHERE a.event_type = 'click' AND b.event_type = 'purchase'")
def streaming_join(spark: SparkSession, sf: str) -> DataFrame:
    """Clicks with the same user's purchases within twenty minutes, from two streams."""
    _utc(spark)
    clicks = bars.instants(_stream(spark, sf)).where("event_type = 'click'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("click"))
    buys = bars.instants(_stream(spark, sf)).where("event_type = 'purchase'").select("user_id", F.col("ts").alias("then"), F.col("event_id").alias("purchase"))
    out = bars.joined(clicks, buys, ["user_id"], "at", "then", "20 minutes").select("click", "purchase")
    return sinks.run_to_table(out, "streaming_join", "append")


@query("SELECT event_id, ts, user_id, event_type, value, props FROM events")
def streaming_sharded_sink(spark: SparkSession, sf: str) -> DataFrame:
    """A stream appended to the sharded layout, twice over with a lost checkpoint: a repeated batch replaces itself."""
    path, ring = scratch(spark, "live-events"), Ring((Shard(1), Shard(2)))
    for _ in range(2):
        sinks.write_sharded(_stream(spark, sf), path, scratch(spark, "mark"), ring, "event_type", "ts").awaitTermination()
    return spark.read.parquet(path).drop(SHARD_COLUMN, "_day", "_batch")


@query("SELECT event_id, event_type, value FROM events WHERE value > 20")
def batch_forward(spark: SparkSession, sf: str) -> DataFrame:
    """Each batch of a stream handed on to a function, which appends it to a table."""
    path = scratch(spark, "forwarded")
    rows = _stream(spark, sf).where("value > 20").select("event_id", "event_type", "value")
    sinks.deliver(rows, scratch(spark, "mark"), lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")).awaitTermination()
    return spark.read.parquet(path).drop("batch")
