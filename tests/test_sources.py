"""Line protocol, tick files, notifications, checkpoints, ingest."""

import datetime as dt
import io
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shardloom.config import Shard, TableSpec
from shardloom.functions.cells import decode, schema_of
from shardloom.operators.scan import read_sharded, scan_shards, write_sharded
from shardloom.plans.ring import Ring
from shardloom.registry import TableRegistry
from shardloom.sources import ingest, line_protocol, objects, tick_files
from shardloom.streaming import topics


def lines(spark, *text):
    return spark.createDataFrame([(t,) for t in text], "value string")


def parsed(spark, text, **how):
    rows = line_protocol.parse(lines(spark, text), **how).collect()
    return rows[0] if rows else None


def test_golden_line(spark):
    r = parsed(spark, "trades,symbol=ETH,exchange=NASDAQ price=1.5,volume=100i,active=t 999")
    assert r["measurement"] == "trades" and [(t["k"], t["v"]) for t in r["tags"]] == [("symbol", "ETH"), ("exchange", "NASDAQ")]
    assert [(f["k"], f["f"], f["i"], f["b"]) for f in r["fields"]] == [("price", 1.5, None, None), ("volume", None, 100, None), ("active", None, None, True)]
    assert r["timestamp_ns"] == 999


def test_string_field_and_missing_timestamp(spark):
    r = parsed(spark, 'events,kind=alert msg="hello world" 1')
    assert r["fields"][0]["s"] == "hello world" and r["timestamp_ns"] == 1
    assert parsed(spark, "trades,symbol=X price=1")["timestamp_ns"] is None


@pytest.mark.parametrize("text", ["", "\n", "nocomma value=1 5"])
def test_rejected_lines(spark, text):
    assert parsed(spark, text) is None


def test_order_and_repeats_of_tags_stay(spark):
    r = parsed(spark, "t,a=1,b=2,a=3,bad x=1,y=oops,z=2i,w=1e3 7")
    assert [(t["k"], t["v"]) for t in r["tags"]] == [("a", "1"), ("b", "2"), ("a", "3")]
    assert [f["k"] for f in r["fields"]] == ["x", "z", "w"]


def test_strict_reads_escapes(spark):
    r = parsed(spark, r't\,x,a\ b=c\=d msg="x, y=1 z",n=2i 5', strict=True)
    assert r["measurement"] == "t,x" and (r["tags"][0]["k"], r["tags"][0]["v"]) == ("a b", "c=d")
    assert r["fields"][0]["s"] == "x, y=1 z" and r["fields"][1]["i"] == 2 and r["timestamp_ns"] == 5


def test_keys_of_lines(spark):
    df = lines(spark, "trades,Symbol=ETH-USD price=100 1", "trades,venue=X price=1", " ", ",x=1")
    out = df.select(line_protocol.measurement(F.col("value")).alias("m"), line_protocol.shard_key(F.col("value"), "symbol").alias("k")).collect()
    assert [(r["m"], r["k"]) for r in out][:2] == [("trades", "ETH-USD"), ("trades", "symbol")]
    assert out[3]["m"] is None
    routed = line_protocol.route(df, Ring([Shard(1)]), {"other": "venue"}, "symbol")
    assert routed.count() == 3


def test_topics(spark):
    registry = TableRegistry([TableSpec("trades"), TableSpec("local", sharded=False)])
    df = lines(spark, "trades,symbol=BTC-OHLCV price=1 1", "local,symbol=Z price=1 1", "unknown,symbol=Z price=1 1")
    out = topics.publish(df, registry, ["symbol", "exchange"])
    assert [r["topic"] for r in out.collect()] == ["BTC-OHLCV@*"]
    assert topics.subscribed(out, {"*"}).count() == 1 and topics.subscribed(out, {"btc-ohlcv@*"}).count() == 0
    c = lines(spark, '{"op":"subscribe","topics":["a","b"]}', '{"op":"replay","topic":"a","last_n":5}', '{"op":"dance"}', "no json")
    assert topics.controls(c).count() == 2
    m = spark.createDataFrame([("c", 1, "subscribe", ["a", "b"]), ("c", 2, "unsubscribe", ["a"])], "client string, n int, op string, topics array<string>")
    assert [r["topic"] for r in topics.subscriptions(m, "n").collect()] == ["b"]


def test_cells(spark):
    df = spark.createDataFrame(
        [("1", "t", "2024-01-02", "2024-01-02T03:04:05.5Z", r"\x4142"), ("x", "yes", "2024-13-01", "soon", "AB"), (None, "FALSE", "02.01.2024", "1704164645500000", None)],
        "N string, b string, d string, at string, raw string",
    )
    a, b, c = decode(df, schema_of([("n", "LONG"), ("b", "bool"), ("d", "date"), ("at", "timestamptz"), ("raw", "bytea"), ("gone", "int")])).collect()
    assert (a["n"], a["b"], a["d"], bytes(a["raw"]), a["gone"]) == (1, True, dt.date(2024, 1, 2), b"AB", None)
    assert (b["n"], b["b"], b["d"], b["at"], bytes(b["raw"])) == (None, None, None, None, b"AB")
    assert (c["n"], c["b"], c["d"]) == (None, False, None) and c["at"] == a["at"]
    with pytest.raises(Exception, match="unknown column type"):
        schema_of([("x", "uuid")])


def trade_file(rows, meta=True, fixed=8):
    fields = [pa.field("price", pa.binary(fixed)), pa.field("size", pa.binary(fixed)), pa.field("aggressor_side", pa.uint8()), pa.field("trade_id", pa.string()), pa.field("ts_event", pa.uint64()), pa.field("ts_init", pa.uint64())]
    schema = pa.schema(fields, metadata={"instrument_id": "BTCUSDT.BITUNIX", "price_precision": "2", "size_precision": "3"} if meta else None)
    raw = lambda x: struct.pack("<q", x)[:fixed]
    table = pa.table([[raw(r[0]) for r in rows], [raw(r[1]) for r in rows], [r[2] for r in rows], [r[3] for r in rows], [r[4] for r in rows], [r[4] for r in rows]], schema=schema)
    out = io.BytesIO()
    with pa.ipc.new_stream(out, schema) as w:
        w.write_table(table)
    return out.getvalue()


def test_tick_files(spark, tmp_path):
    folder = tmp_path / "in" / "data" / "trades" / "A.B.C"
    folder.mkdir(parents=True)
    (folder / "x.feather").write_bytes(trade_file([(5000025, 1500, 1, "t1", 1_700_000_000_000_000_123), (-100, 2000, 9, "t2", 5000)]))
    (folder / "y.arrow").write_bytes(trade_file([(10**8, 10**8, 2, "t3", 7)], meta=False))
    (folder / "notes.txt").write_text("no")
    rows = {r["trade_id"]: r for r in tick_files.with_time(tick_files.read(spark, str(tmp_path / "in"), tick_files.TRADES)).collect()}
    assert rows["t1"]["price"] == 50000.25 and rows["t1"]["size"] == 1.5 and rows["t1"]["aggressor_side"] == "BUYER"
    assert (rows["t1"]["symbol"], rows["t1"]["venue"]) == ("BTCUSDT", "BITUNIX") and rows["t2"]["aggressor_side"] == "NO_AGGRESSOR"
    assert (rows["t3"]["symbol"], rows["t3"]["venue"], rows["t3"]["price"]) == ("A.B", "C", 1.0)
    assert rows["t2"]["timestamp"].microsecond == 5


def test_tick_file_guards():
    with pytest.raises(Exception, match="no rows"):
        tick_files.decode_file("/data/trades/X/a.feather", trade_file([]), "trades")
    with pytest.raises(Exception, match="8 bytes"):
        tick_files.decode_file("/data/trades/X/a.feather", trade_file([(1, 1, 1, "t", 1)], fixed=4), "trades")
    with pytest.raises(Exception, match="IPC stream"):
        tick_files.decode_file("/data/trades/X/a.feather", b"ARROW1 nonsense", "trades")
    assert tick_files.split_instrument("NODOT") == ("NODOT", "UNKNOWN")


def test_notifications(spark):
    listed = '{"Records":[{"eventName":"s3:ObjectCreated:Put","s3":{"bucket":{"name":"b"},"object":{"key":"p/data/trades/X.Y/a%20b+c.feather","eTag":"\\"e1\\""}}},{"eventName":"s3:ObjectRemoved:Delete","s3":{"bucket":{"name":"b"},"object":{"key":"z.feather"}}}]}'
    flat = '{"EventName":"s3:ObjectCreated:Put","Key":"bkt/data/quotes/X.Y/q.ARROW"}'
    out = [tuple(r) for r in objects.parse_notices(lines(spark, listed, flat, "junk", '{"EventName":"s3:ObjectCreated:Put","Key":"dir/"}')).collect()]
    assert out == [("b", "p/data/trades/X.Y/a b c.feather", "e1"), ("bkt", "data/quotes/X.Y/q.ARROW", None)]


def test_checkpoint_rule_and_reconcile(spark):
    shape = "bucket string, key string, etag string"
    seen = spark.createDataFrame([("b", "same.arrow", "e1"), ("b", "new.arrow", "e1"), ("b", "none.arrow", None)], shape)
    now = spark.createDataFrame([("b", "same.arrow", "e1"), ("b", "new.arrow", "e2"), ("b", "none.arrow", "e1"), ("b", "first.arrow", "e1"), ("b", "x/first.txt", "e1")], shape)
    assert {r["key"] for r in objects.to_process(now, seen).collect()} == {"new.arrow", "none.arrow", "first.arrow", "x/first.txt"}
    assert {r["key"] for r in objects.reconcile(now, seen).collect()} == {"first.arrow"}


def test_ingest_once(spark, tmp_path):
    folder = tmp_path / "in" / "data" / "trades" / "A.B"
    folder.mkdir(parents=True)
    (folder / "x.feather").write_bytes(trade_file([(100, 1000, 1, "t1", 10**18), (200, 1000, 2, "t2", 10**18 + 10**9)]))
    target, mark, ring = str(tmp_path / "out"), str(tmp_path / "mark"), Ring([Shard(1), Shard(2)])
    run = lambda: ingest.ingest(spark, objects.list_objects(spark, str(tmp_path / "in"), "b"), "trades", target, mark, ring)
    assert run() == 1 and run() == 0
    assert spark.read.parquet(target).count() == 2
    assert objects.read_checkpoint(spark, mark).first()["rows"] == 2


def test_sharded_layout_prunes(spark, tmp_path):
    ring, path = Ring([Shard(1), Shard(2)]), str(tmp_path / "t")
    rows = [(f"S{i % 9}", float(i), dt.datetime(2024, 1, 1 + i % 3, i % 24)) for i in range(90)]
    write_sharded(spark.createDataFrame(rows, "symbol string, price double, ts timestamp_ntz"), path, ring, "symbol", "ts")
    df = read_sharded(spark, path)
    assert df.count() == 90 and df.groupBy("symbol").agg(F.count_distinct("_shard").alias("n")).where("n > 1").count() == 0

    from shardloom.config import from_mapping
    from shardloom.plans.engine import Engine

    engine = Engine(spark, from_mapping({"shards": [{"id": 1}, {"id": 2}]}, {}))
    engine.register("ticks", df)
    out = engine.sql("SELECT ts, last(price) AS p FROM ticks WHERE symbol = $1 SAMPLE BY 1d", ["S4"])
    assert "PartitionFilters: [isnotnull(_shard" in out._jdf.queryExecution().toString() and engine.counts["pruned"] == 1
    assert out.count() == 1 or out.count() == 3
    assert scan_shards(spark, [path, str(tmp_path / "absent")], spark.read.parquet(path).select("symbol", "price").schema).count() == 90


@pytest.mark.parametrize("mounted", [True, False])
def test_objects_are_computed_once_and_keep_their_bytes(spark, tmp_path, mounted, monkeypatch):
    made = spark.sparkContext.accumulator(0)
    content = {f"data/trades/A {k}.B/x%20{k}ü.feather": trade_file([(100 + k, 1000, 1, "t", 10**18)]) for k in range(40)}

    def build(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    root = (tmp_path / "lake").as_uri()
    files = spark.createDataFrame([(p, bytearray(c)) for p, c in content.items()], "path string, content binary").mapInArrow(build, "path string, content binary")
    if not mounted:
        monkeypatch.setattr(objects, "_put_mounted", lambda files, folder: objects._put_renamed(files, root, place(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place))
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    objects.put_objects(files, root)
    assert made.value == 40
    found = {str(f.relative_to(tmp_path / "lake")): f.read_bytes() for f in (tmp_path / "lake").rglob("*.feather")}
    if mounted:
        assert found == {p: c + b"\n" for p, c in content.items()}
    assert set(found) == set(content) and not (tmp_path / "lake-staged").exists()
    assert tick_files.read(spark, root, tick_files.TRADES).count() == 40


def test_ingest_counts_in_the_folders_of_its_own_objects(spark, tmp_path, monkeypatch):
    folder = tmp_path / "in" / "data" / "trades" / "A.B"
    folder.mkdir(parents=True)
    for k in range(3):
        (folder / f"{k}.feather").write_bytes(trade_file([(100, 1000, 1, "t", 10**18)] * (k + 1)))
    read, mark_processed = [], objects.mark_processed
    monkeypatch.setattr(ingest, "OBJECTS", 1)
    monkeypatch.setattr(objects, "mark_processed", lambda done, path: (read.append(len(done.inputFiles())), mark_processed(done, path)))
    listing = objects.list_objects(spark, str(tmp_path / "in"), "b")
    assert ingest.ingest(spark, listing, "trades", str(tmp_path / "out"), str(tmp_path / "mark"), Ring([Shard(1), Shard(2)])) == 3
    assert read == [1, 1, 1]
    assert sorted(r["rows"] for r in objects.read_checkpoint(spark, str(tmp_path / "mark")).collect()) == [1, 2, 3]
