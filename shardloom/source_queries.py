"""Registered queries about lines, tick files, notifications, checkpoints and ingest."""

from __future__ import annotations

import io

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Shard, TableSpec
from .functions import cells, scalars
from .plans.ring import Ring
from .registered import query, t
from .session import scratch
from .sources import ingest, line_protocol, objects, tick_files

#: Rows of a file that these queries make.
FILE_ROWS = 2000

# ---------------------------------------------------------------- lines

_CASES = (
    "trades,symbol=ETH,exchange=X price=1.5,volume=100i,active=t 999", "trades,symbol=X price=1 abc", "trades,symbol=X price=1 99999999999999999999", "trades,symbol=X price=1",
    ",symbol=X price=1 5", "nocomma price=1 5", "", 'events,kind=alert msg="hello world" 1', "t,a=1,b=2,a=3,bad x=1,y=oops,z=2i,w=1e3 7", "t,a=1 x=F,y=-3i,z=9223372036854775808i,v=inf -5", "t,a=1", "t,=1 =2 3", 't,a=1 s="",q=" +12',
)


@query("""SELECT * FROM (VALUES
(0, 'trades', 'symbol=ETH;exchange=X', 'price=f1.5;volume=i100;active=btrue', 999), (1, 'trades', 'symbol=X', 'price=f1.0', -99), (2, 'trades', 'symbol=X', 'price=f1.0', -99), (3, 'trades', 'symbol=X', 'price=f1.0', -99),
(7, 'events', 'kind=alert', 'msg=shello world', 1), (8, 't', 'a=1;b=2;a=3', 'x=f1.0;z=i2;w=f1000.0', 7), (9, 't', 'a=1', 'x=bfalse;y=i-3;v=fInfinity', -5), (10, 't', 'a=1', '', -99), (11, 't', '=1', '=f2.0', 3), (12, 't', 'a=1', 's=s', 12)) AS l(n, measurement, tags, fields, stamp)""")
def line_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Lines at the edges of the grammar, and those that are refused."""
    parsed = line_protocol.parse(spark.createDataFrame(list(enumerate(_CASES)), "n int, value string"))
    value = lambda x: F.coalesce(F.concat(F.lit("f"), x["f"].cast("string")), F.concat(F.lit("i"), x["i"].cast("string")), F.concat(F.lit("b"), x["b"].cast("string")), F.concat(F.lit("s"), x["s"]))
    return parsed.select(
        "n", "measurement", F.array_join(F.transform("tags", lambda x: F.concat_ws("=", x["k"], x["v"])), ";").alias("tags"),
        F.array_join(F.transform("fields", lambda x: F.concat_ws("=", x["k"], value(x))), ";").alias("fields"), F.coalesce(F.col("timestamp_ns").cast("int"), F.lit(-99)).alias("stamp"),
    )


@query("SELECT event_type AS key, count(*) AS n FROM events WHERE event_id % 3 <> 0 GROUP BY event_type UNION ALL SELECT CAST(user_id AS VARCHAR), count(*) FROM events WHERE event_id % 3 = 0 GROUP BY user_id")
def line_routes(spark: SparkSession, sf: str) -> DataFrame:
    """Each line's key: the tag that its table is sharded by; blank lines are left out."""
    events = t(spark, sf, "events")
    lines = line_protocol.render(events.where("event_id % 3 <> 0"), "ticks", ["event_type", "user_id"], ["value"], "ts").union(line_protocol.render(events.where("event_id % 3 = 0"), "users", ["event_type", "user_id"], ["value"], "ts"))
    lines = lines.union(spark.createDataFrame([("  ",)], "value string"))
    routed = line_protocol.route(lines, Ring((Shard(1), Shard(2))), {"users": "USER_ID"}, "event_type")
    return routed.groupBy("key").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- tick files

_PRICE, _SIZE = 4, 2


def _file(pdf: pd.DataFrame, kind: str, meta: dict[str, str]) -> bytes:
    """An Arrow IPC stream of some events as ticks."""
    fixed = lambda x, digits: [int(round(v * 10**digits)).to_bytes(8, "little", signed=True) for v in x]
    prices = ("price",) if kind == tick_files.TRADES else ("bid_price", "ask_price")
    sizes = ("size",) if kind == tick_files.TRADES else ("bid_size", "ask_size")
    precision = (int(meta.get("price_precision", tick_files.DEFAULT_PRECISION)), int(meta.get("size_precision", tick_files.DEFAULT_PRECISION)))
    columns: dict[str, pa.Array] = {}
    for k, n in enumerate(prices):
        columns[n] = pa.array(fixed(pdf["value"] + k, precision[0]), pa.binary(8))
    for k, n in enumerate(sizes):
        columns[n] = pa.array(fixed(pdf["user_id"] / 4 + k, precision[1]), pa.binary(8))
    if kind == tick_files.TRADES:
        columns["aggressor_side"] = pa.array(pdf["event_id"] % 3, pa.uint8())
        columns["trade_id"] = pa.array(pdf["event_id"].astype(str), pa.string())
    columns["ts_event"] = pa.array(pdf["us"] * 1000 + 7, pa.uint64())
    table = pa.table(columns).replace_schema_metadata(meta)
    out = io.BytesIO()
    with pa.ipc.new_stream(out, table.schema) as w:
        w.write_table(table)
    return out.getvalue()


def _files(spark: SparkSession, sf: str, kind: str, named: bool) -> DataFrame:
    """(path, content): the events as tick files of some rows each; without a name in them, the path names the instrument."""
    events = t(spark, sf, "events").select("event_id", "user_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.expr(f"event_id div {FILE_ROWS}").alias("part"))

    def build(key, pdf: pd.DataFrame) -> pd.DataFrame:  # FILE_ROWS rows at most
        name = f"{key[0].upper()}.SIM"
        meta = {"instrument_id": name, "price_precision": str(_PRICE), "size_precision": str(_SIZE)} if named else {}
        return pd.DataFrame({"path": [f"lake/data/{kind}/{'x' if named else name}/{key[0]}-{key[1]}.feather"], "content": [_file(pdf, kind, meta)]})

    return events.groupBy("event_type", "part").applyInPandas(build, "path string, content binary")


@query("SELECT upper(event_type) AS symbol, 'SIM' AS venue, round(value, 4) AS price, user_id / 4.0::DOUBLE AS size, CASE event_id % 3 WHEN 1 THEN 'BUYER' WHEN 2 THEN 'SELLER' ELSE 'NO_AGGRESSOR' END AS side, CAST(event_id AS VARCHAR) AS trade_id, ts AS \"timestamp\" FROM events")
def tick_trades(spark: SparkSession, sf: str) -> DataFrame:
    """Trades of Arrow files whose metadata name instrument and precision."""
    ticks = tick_files.with_time(tick_files.decode(_files(spark, sf, tick_files.TRADES, True), tick_files.TRADES))
    return ticks.select("symbol", "venue", "price", "size", F.col("aggressor_side").alias("side"), "trade_id", "timestamp")


@query("SELECT upper(event_type) AS symbol, 'SIM' AS venue, round(value, 6) AS bid, round(value + 1, 6) AS ask, user_id / 4.0::DOUBLE AS bid_size, user_id / 4.0::DOUBLE + 1 AS ask_size, epoch_us(ts) * 1000 + 7 AS ts_event FROM events")
def tick_quotes(spark: SparkSession, sf: str) -> DataFrame:
    """Quotes of Arrow files without metadata: the path names the instrument, and prices have the default precision."""
    ticks = tick_files.decode(_files(spark, sf, tick_files.QUOTES, False), tick_files.QUOTES)
    return ticks.select("symbol", "venue", F.round("bid", 6).alias("bid"), F.round("ask", 6).alias("ask"), "bid_size", "ask_size", "ts_event")


@query("SELECT upper(event_type) AS symbol, round(value, 4) AS price, CAST(event_id AS VARCHAR) AS trade_id, ts AS \"timestamp\" FROM events")
def tick_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Decoded ticks as lines, and those read back."""
    lines = tick_files.to_lines(tick_files.decode(_files(spark, sf, tick_files.TRADES, True), tick_files.TRADES), tick_files.TRADES)
    spec = TableSpec("trades", (("symbol", "symbol"), ("price", "double"), ("trade_id", "string"), ("timestamp", "timestamp")), timestamp="timestamp")
    return line_protocol.project(line_protocol.parse(lines), spec)


@query("""SELECT * FROM (VALUES ('empty.arrow', 'no rows'), ('framing.arrow', 'not an Arrow IPC stream'), ('nameless.arrow', 'no instrument'), ('width.arrow', 'a fixed-point number has 8 bytes, not 4'), ('nothing.arrow', 'not an Arrow IPC stream')) AS e(name, error)""")
def tick_guards(spark: SparkSession, sf: str) -> DataFrame:
    """Files that can't be read, and why; readable ones aren't named."""
    one = pd.DataFrame({"event_id": [1], "user_id": [4], "value": [1.5], "us": [10**15]})
    good = _file(one, tick_files.TRADES, {"instrument_id": "A.B"})
    narrow = pa.table({"price": pa.array([b"1234"], pa.binary(4)), "size": pa.array([bytes(8)], pa.binary(8)), "aggressor_side": pa.array([1], pa.uint8()), "trade_id": ["t"], "ts_event": pa.array([1], pa.uint64())}).replace_schema_metadata({"instrument_id": "A.B"})
    out = io.BytesIO()
    with pa.ipc.new_stream(out, narrow.schema) as w:
        w.write_table(narrow)
    files = {
        "lake/data/trades/A.B/good.arrow": good, "lake/data/trades/A.B/empty.arrow": _file(one[:0], tick_files.TRADES, {"instrument_id": "A.B"}), "lake/data/trades/A.B/framing.arrow": b"ARROW1" + good,
        "lake/data/trades/A.B/nothing.arrow": b"", "lake/data/trades/A.B/width.arrow": out.getvalue(), "lake/data/trades//nameless.arrow": _file(one, tick_files.TRADES, {}), "lake/data/quotes/A.B/other.arrow": b"",
    }
    found = tick_files.unreadable(spark.createDataFrame([(p, bytearray(c)) for p, c in files.items()], "path string, content binary"), tick_files.TRADES)
    return found.select(F.substring_index("path", "/", -1).alias("name"), F.substring_index("error", ":", 1).alias("error"))


@query("""WITH p AS (SELECT event_id, (CASE event_id % 4 WHEN 0 THEN 'Lake/Data/Trades/' WHEN 1 THEN 'lake/data/quotes/' WHEN 2 THEN 'lake/data/bars/' ELSE 'other/data/trades/' END) || event_type || '.X/' || event_id || (CASE event_id % 5 WHEN 0 THEN '.feather' WHEN 1 THEN '.ARROW' WHEN 2 THEN '.parquet' WHEN 3 THEN '.arrow.tmp' ELSE '.arrow' END) AS path FROM events)
SELECT event_id, CASE WHEN lower(path) LIKE '%/data/trades/%' THEN 'trades' WHEN lower(path) LIKE '%/data/quotes/%' THEN 'quotes' END AS kind, event_id % 5 IN (0, 1, 4) AS wanted, event_id % 5 IN (0, 1, 4) AND path LIKE 'lake/%' AS below FROM p""")
def tick_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Which kind a path is of, and whether it is a tick file, below a prefix too."""
    n = F.col("event_id")
    folder = F.when(n % 4 == 0, "Lake/Data/Trades/").when(n % 4 == 1, "lake/data/quotes/").when(n % 4 == 2, "lake/data/bars/").otherwise("other/data/trades/")
    suffix = F.when(n % 5 == 0, ".feather").when(n % 5 == 1, ".ARROW").when(n % 5 == 2, ".parquet").when(n % 5 == 3, ".arrow.tmp").otherwise(".arrow")
    paths = t(spark, sf, "events").select("event_id", F.concat(folder, "event_type", F.lit(".X/"), n.cast("string"), suffix).alias("path"))
    return paths.select("event_id", tick_files.kind_of(F.col("path")).alias("kind"), tick_files.should_ingest(F.col("path")).alias("wanted"), tick_files.should_ingest(F.col("path"), "lake/").alias("below"))


# ---------------------------------------------------------------- notices, checkpoint, reconcile, ingest


@query("""SELECT CASE WHEN event_id % 2 = 0 THEN 'bkt' ELSE 'flat' END AS bucket, 'data/trades/' || event_type || ' ' || event_id || '.feather' AS key, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'e' || user_id END AS etag FROM events WHERE event_id % 5 <> 0 AND event_id % 7 <> 0""")
def notices_parsed(spark: SparkSession, sf: str) -> DataFrame:
    """Notification bodies in both forms; removals and other files are left out."""
    n = F.col("event_id")
    event = F.when(n % 5 == 0, "s3:ObjectRemoved:Delete").when(n % 3 == 1, "ObjectCreated:Put").otherwise("s3:ObjectCreated:Copy")
    blank = F.when(n % 4 < 2, "%20").otherwise("+")
    key = F.concat(F.lit("data/trades/"), "event_type", blank, n.cast("string"), F.when(n % 7 == 0, ".csv").otherwise(".feather"))
    etag = F.when(n % 3 == 0, "").otherwise(F.concat(F.lit('"e'), F.col("user_id").cast("string"), F.lit('"')))
    listed = F.to_json(F.struct(F.array(F.struct(event.alias("eventName"), F.struct(F.struct(F.lit("bkt").alias("name")).alias("bucket"), F.struct(key.alias("key"), etag.alias("eTag")).alias("object")).alias("s3"))).alias("Records")))
    flat = F.to_json(F.struct(event.alias("EventName"), F.concat(F.lit("flat/"), key).alias("Key"), etag.alias("ETag")))
    bodies = t(spark, sf, "events").select(F.when(n % 2 == 0, listed).otherwise(flat).alias("value"))
    return objects.parse_notices(bodies.union(spark.createDataFrame([("junk",), ('{"EventName":"s3:ObjectCreated:Put","Key":"dir/"}',)], "value string")))


def _objects(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A listing of orders as objects, and a checkpoint that knows some of them, with other etags for some."""
    k = F.col("o_orderkey")
    name = F.concat(F.lit("data/trades/"), k.cast("string"), F.when(k % 11 == 0, ".csv").otherwise(".arrow"))
    base = t(spark, sf, "orders")
    listing = base.select(F.lit("b").alias("bucket"), name.alias("key"), F.when(k % 6 != 0, F.col("o_custkey").cast("string")).alias("etag"))
    known = base.where(k % 4 != 0).select(F.lit("b").alias("bucket"), name.alias("key"), F.when(k % 5 == 0, F.lit("old")).when(k % 7 != 0, F.col("o_custkey").cast("string")).alias("etag"))
    return listing, known


_KEY = "'data/trades/' || o_orderkey || CASE WHEN o_orderkey % 11 = 0 THEN '.csv' ELSE '.arrow' END AS key"


@query(f"SELECT {_KEY} FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey % 6 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 7 = 0")
def checkpoint_rule(spark: SparkSession, sf: str) -> DataFrame:
    """Objects that are new, changed, or without an etag on either side."""
    return objects.to_process(*_objects(spark, sf)).select("key")


@query(f"SELECT {_KEY} FROM orders WHERE o_orderkey % 4 = 0 AND o_orderkey % 11 <> 0")
def reconcile_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Listed tick files that the checkpoint doesn't know."""
    return objects.reconcile(*_objects(spark, sf), "data/").select("key")


@query(f"SELECT {_KEY}, CASE WHEN o_orderkey % 3 = 0 THEN 'second' ELSE 'first' END AS etag, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS \"rows\" FROM orders")
def checkpoint_store(spark: SparkSession, sf: str) -> DataFrame:
    """Entries appended twice; the later one of an object holds."""
    path = scratch(spark, "checkpoint")
    assert objects.read_checkpoint(spark, path).limit(1).count() == 0
    listing = _objects(spark, sf)[0].select("bucket", "key", F.regexp_extract("key", r"(\d+)", 1).cast("long").alias("k"))
    objects.mark_processed(listing.select("bucket", "key", F.lit("first").alias("etag"), F.lit(1).alias("rows")), path)
    objects.mark_processed(listing.where("k % 3 = 0").select("bucket", "key", F.lit("second").alias("etag"), F.lit(2).alias("rows")), path)
    return objects.read_checkpoint(spark, path).select("key", "etag", "rows")


@query("SELECT upper(event_type) AS symbol, count(*) AS n, min(ts) AS first, max(ts) AS last FROM events GROUP BY event_type")
def ingest_once(spark: SparkSession, sf: str) -> DataFrame:
    """Tick files ingested into the sharded layout; the second run finds nothing to do."""
    lake, target, mark = (scratch(spark, n) for n in ("lake", "ticks", "marks"))
    objects.put_objects(_files(spark, sf, tick_files.TRADES, True), lake)
    ring = Ring((Shard(1), Shard(2)))
    done = [ingest.ingest(spark, objects.list_objects(spark, lake, "b"), tick_files.TRADES, target, mark, ring) for _ in range(2)]
    assert done[0] > 0 and done[1] == 0
    return spark.read.parquet(target).groupBy("symbol").agg(F.count("*").alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


@query("SELECT count(DISTINCT (event_type, event_id // 2000)) AS objects, count(*) AS ticks FROM events WHERE event_type = 'click'")
def object_listing(spark: SparkSession, sf: str) -> DataFrame:
    """Objects below a folder, and the ticks of those under a prefix of their keys."""
    lake = scratch(spark, "lake")
    objects.put_objects(_files(spark, sf, tick_files.TRADES, True), lake)
    ticks = tick_files.read(spark, lake, tick_files.TRADES, "lake/data/trades/x/click")
    named = objects.list_objects(spark, lake, "b").where(F.col("key").contains("/click-"))
    return named.agg(F.count("*").alias("objects")).crossJoin(ticks.agg(F.count("*").alias("ticks")))


# ---------------------------------------------------------------- scalars


@query("""SELECT event_id, lower(trim(' ' || upper(event_type) || '  ')) AS topic, coalesce(CASE WHEN event_id % 3 = 0 THEN value END, value + 1) AS price,
CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'A' || chr(CAST(66 + event_id % 20 AS INTEGER)) END AS raw FROM events""")
def scalar_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Topics made alike, the last price, and binary cells in hexadecimal or as they are."""
    n = F.col("event_id")
    raw = F.when(n % 2 == 0, F.col("event_type")).otherwise(F.concat(F.lit("\\x41"), F.lower(F.hex(66 + n % 20))))
    return t(spark, sf, "events").select(
        "event_id", scalars.normal_topic(F.concat(F.lit(" "), F.upper("event_type"), F.lit("  "))).alias("topic"),
        scalars.last_price(F.when(n % 3 == 0, F.col("value")), F.col("value") + 1).alias("price"), cells.cell_binary(raw).cast("string").alias("raw"),
    )
