"""Registered queries about shards, routes, the catalog and the engine's answers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config, Health, Routing, Shard, TableSpec
from .errors import EngineError
from .operators import scan
from .plans import route as routes
from .plans.cluster import READ, WRITE, Cluster
from .plans.engine import Engine
from .plans.ring import RING_SQL, SHARD_COLUMN, Ring
from .registered import query, sql, t
from .session import scratch

_SHARDS = tuple(Shard(k) for k in (1, 2))


def _sharded(spark: SparkSession, sf: str) -> DataFrame:
    """The events in the sharded layout, placed by their type."""
    path = scratch(spark, "events-sharded")
    scan.write_sharded(t(spark, sf, "events"), path, Ring(_SHARDS), "event_type", "ts")
    return scan.read_sharded(spark, path)


# ---------------------------------------------------------------- the sharded layout


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'click'")
def pruned_keyed_read(spark: SparkSession, sf: str) -> DataFrame:
    """A keyed read over the `_shard` layout, which opens the folder of the key's shard alone."""
    engine = Engine(spark, Config(shards=_SHARDS, routing=Routing(shard_key="event_type")))
    engine.register("events", _sharded(spark, sf))
    return engine.sql("SELECT event_id, user_id, value FROM events WHERE event_type = $1", ["click"])


@query(RING_SQL.format(shards="1, 2", nodes=128, key="event_type", table="events") + "SELECT shard, count(*) AS n FROM events JOIN placed ON event_type = k GROUP BY shard")
def key_routed_write(spark: SparkSession, sf: str) -> DataFrame:
    """Rows lie on the shard of their key."""
    return _sharded(spark, sf).groupBy(F.col(SHARD_COLUMN).alias("shard")).agg(F.count("*").alias("n"))


@query("SELECT * FROM nation")
def missing_shard_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A shard without the table contributes no rows."""
    return scan.scan_shards(spark, [f"{sf}/no_such_shard.parquet", f"{sf}/nation.parquet"], t(spark, sf, "nation").schema)


@query("SELECT l_orderkey AS k, l_linenumber AS n, l_quantity AS q, o_custkey AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def colocated_join(spark: SparkSession, sf: str) -> DataFrame:
    """Two tables written into buckets of their key meet bucket by bucket, without an exchange."""
    tag = uuid.uuid4().hex
    left = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("q"))
    right = t(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    sides = [scan.write_bucketed(df, f"colocated_{name}_{tag}", scratch(spark, name), "k", 16) for name, df in (("left", left), ("right", right))]
    return sides[0].hint("merge").join(sides[1], "k")


# ---------------------------------------------------------------- routes and errors

_STATEMENTS = (
    "SELECT * FROM ticks WHERE symbol = 'BTC'", "SELECT price FROM ticks WHERE symbol = $1 AND price > 5", "SELECT count(*) FROM ticks", "SELECT avg(price) FROM ticks WHERE price > 1",
    "SELECT price FROM ticks", "SELECT symbol, max(price) FROM ticks GROUP BY symbol", "SELECT * FROM ticks a JOIN quotes b ON a.symbol = b.symbol", "SELECT * FROM ticks, quotes",
    "SELECT * FROM ticks WHERE symbol = 'A' OR symbol = 'B'", "WITH x AS (SELECT 1 AS a) SELECT * FROM x", "SELECT 1 UNION SELECT 2", "BEGIN", "SET timezone = 'UTC'", "SELECT 1",
    "SELECT table_name FROM information_schema.tables", "SHOW TABLES", "SELECT sum(price) FROM ticks WHERE 'X' = symbol", "SELECT max(price) FROM ticks WHERE symbol = 'it''s'",
)


@query("""SELECT n, kind, key, coalesce(placeholder, -1) AS placeholder, aggregate FROM (VALUES
(0, 'single_shard', 'BTC', NULL, NULL), (1, 'single_shard', NULL, 1, NULL), (2, 'aggregate_scan', NULL, NULL, 'COUNT'), (3, 'aggregate_scan', NULL, NULL, 'AVG'),
(4, 'full_scan', NULL, NULL, NULL), (5, 'group_by', NULL, NULL, NULL), (6, 'join', NULL, NULL, NULL), (7, 'join', NULL, NULL, NULL),
(8, 'full_scan', NULL, NULL, NULL), (9, 'composite', NULL, NULL, NULL), (10, 'composite', NULL, NULL, NULL), (11, 'session', NULL, NULL, NULL), (12, 'session', NULL, NULL, NULL), (13, 'system', NULL, NULL, NULL),
(14, 'system', NULL, NULL, NULL), (15, 'system', NULL, NULL, NULL), (16, 'single_shard', 'X', NULL, NULL), (17, 'single_shard', 'it''s', NULL, NULL)) AS r(n, kind, key, placeholder, aggregate)""")
def route_classes(spark: SparkSession, sf: str) -> DataFrame:
    """How statements of each kind are routed."""
    found = [routes.classify(s) for s in _STATEMENTS]
    return spark.createDataFrame([(n, r.kind, r.key, -1 if r.placeholder is None else r.placeholder, r.aggregate) for n, r in enumerate(found)], "n int, kind string, key string, placeholder int, aggregate string")


def _failure(run) -> tuple[str, str]:
    try:
        run()
    except EngineError as e:
        return e.sqlstate, type(e).__name__
    return "00000", ""


@query("""SELECT * FROM (VALUES ('write', '42501', 'UnsupportedError'), ('several', '42501', 'UnsupportedError'), ('empty', '42601', 'ParseError'), ('unknown_table', 'XX000', 'NotFoundError'),
('no_value', '42601', 'MissingParameterError'), ('row_cap', '53400', 'RowLimitError'), ('disabled', '0A000', 'DisabledError'), ('unhealthy', '08006', 'UnhealthyError'), ('unknown_variable', 'XX000', 'NotFoundError'),
('fine', '00000', ''), ('keyed_when_disabled', '00000', ''), ('unclosed', '42601', 'ParseError')) AS e(name, sqlstate, kind)""")
def statement_errors(spark: SparkSession, sf: str) -> DataFrame:
    """What refused statements answer: the table guard, read-only access, the row cap, and the rest."""
    def engine(**more) -> Engine:
        e = Engine(spark, Config(routing=Routing(shard_key="event_type", **more)))
        e.register("nation", t(spark, sf, "nation"))
        e.register("events", t(spark, sf, "events"))
        return e

    plain, capped, off = engine(), engine(max_federated_rows=5), engine(federated_enabled=False)
    sick = Cluster.of(Config(shards=_SHARDS, health=Health(min_healthy_shards=2))).report(1, read=False)
    cases = {
        "write": lambda: plain.sql("INSERT INTO nation VALUES (1)"), "several": lambda: plain.sql("SELECT 1; SELECT 2"), "empty": lambda: plain.sql(" ; "),
        "unknown_table": lambda: plain.sql("SELECT * FROM nowhere"), "no_value": lambda: plain.sql("SELECT * FROM events WHERE event_type = $2", ["x"]),
        "row_cap": lambda: capped.fetch("SELECT n_name FROM nation"), "disabled": lambda: off.sql("SELECT count(*) FROM nation"), "unhealthy": lambda: sick.healthy(READ),
        "unknown_variable": lambda: plain.sql("SHOW no_such_thing"), "fine": lambda: plain.fetch("SELECT n_name FROM nation"),
        "keyed_when_disabled": lambda: off.sql("SELECT count(*) FROM events WHERE event_type = 'view'"), "unclosed": lambda: plain.sql("SELECT (1 FROM nation"),
    }
    return spark.createDataFrame([(name, *_failure(run)) for name, run in cases.items()], "name string, sqlstate string, kind string")


@query("SELECT * FROM (VALUES (0, 'BTC'), (1, 'ETH'), (2, NULL), (3, NULL), (4, '7')) AS r(n, key)")
def resolved_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The key that a statement and its parameters name; a NULL names none."""
    asked = (("SELECT * FROM x WHERE symbol = 'BTC'", None), ("SELECT * FROM x WHERE symbol = $2", [1, "ETH"]), ("SELECT * FROM x WHERE symbol = $1", [None]), ("SELECT * FROM x", []), ("SELECT * FROM x WHERE (symbol = $1) AND a > 2", [7]))
    return spark.createDataFrame([(n, routes.resolve_key(routes.classify(s), p)) for n, (s, p) in enumerate(asked)], "n int, key string")


# ---------------------------------------------------------------- health


@query("""SELECT * FROM (VALUES ('start', '1,2,3', '1,2,3', true), ('read_lost', '1,3', '1,2,3', true), ('write_lost', '1,3', '1,2', true), ('again', '1,2,3', '1,2', true), ('unchanged', '1,2,3', '1,2', false), ('probed', '2', '2', true)) AS h(step, readable, writable, changed)""")
def health_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Shards that serve reads and writes as reports come in; a report that says nothing new keeps the snapshot."""
    now = Cluster.of(Config(shards=(Shard(1, f"{sf}/no_such_shard"), Shard(2, f"{sf}/events.parquet"), Shard(3, f"{sf}/neither"))))
    steps = [("start", lambda c: c), ("read_lost", lambda c: c.report(2, read=False)), ("write_lost", lambda c: c.report(3, write=False)), ("again", lambda c: c.report(2, read=True)), ("unchanged", lambda c: c.report(2, read=True)), ("probed", lambda c: c.probe(spark=spark))]
    rows = []
    for name, step in steps:
        new = step(now)
        rows.append((name, ",".join(map(str, new.healthy(READ))), ",".join(map(str, new.healthy(WRITE))), name == "start" or new is not now))
        now = new
    return spark.createDataFrame(rows, "step string, readable string, writable string, changed boolean")


@query("SELECT DISTINCT event_type AS key, true AS served FROM events")
def health_exclusion(spark: SparkSession, sf: str) -> DataFrame:
    """A key whose shard can't be read is served by another that can, the same one each time."""
    cluster = Cluster.of(Config(shards=tuple(Shard(k) for k in (1, 2, 3))))
    keys = t(spark, sf, "events").select(F.col("event_type").alias("key")).distinct()
    sick = cluster.report(2, read=False)
    found = keys.withColumns({"first": cluster.ring.column(F.col("key")), "now": cluster.ring.failover_column(F.col("key"), sick.excluded(READ))})
    return found.select("key", ((F.col("now") != 2) & ((F.col("first") == 2) | (F.col("first") == F.col("now")))).alias("served"))


# ---------------------------------------------------------------- the catalog and the session


def _catalog(spark: SparkSession, sf: str) -> Engine:
    engine = Engine(spark)
    for name in ("region", "nation", "events"):
        engine.register(name, t(spark, sf, name))
    return engine


@query("SELECT 'public' AS table_schema, x AS table_name, 'BASE TABLE' AS table_type FROM (SELECT unnest(['events', 'nation', 'region']) AS x)")
def catalog_tables(spark: SparkSession, sf: str) -> DataFrame:
    return _catalog(spark, sf).sql("SELECT table_schema, table_name, table_type FROM information_schema.tables")


@query("SELECT table_name, column_name, CAST(ordinal_position AS INTEGER) AS ordinal_position FROM (SELECT 'region' AS table_name, unnest(['r_regionkey', 'r_name']) AS column_name, unnest([1, 2]) AS ordinal_position)")
def catalog_columns(spark: SparkSession, sf: str) -> DataFrame:
    return _catalog(spark, sf).sql("SELECT c.table_name, c.column_name, c.ordinal_position FROM information_schema.columns c JOIN pg_catalog.pg_tables p ON c.table_name = p.tablename WHERE p.tablename = 'region' AND c.column_name <> 'r_comment'")


@query("SELECT unnest(['n_nationkey', 'n_name', 'n_regionkey']) AS name")
def show_columns(spark: SparkSession, sf: str) -> DataFrame:
    return _catalog(spark, sf).sql("SHOW COLUMNS FROM nation").select(F.col("col_name").alias("name")).where("name LIKE 'n%'")


@query("SELECT unnest(['events', 'nation', 'region']) AS table_name")
def show_tables(spark: SparkSession, sf: str) -> DataFrame:
    return _catalog(spark, sf).sql("SHOW TABLES")


@query("SELECT * FROM (VALUES ('application_name', 'report'), ('search_path', 'public'), ('standard_conforming_strings', 'on'), ('timezone', 'UTC'), ('transaction_isolation', 'read committed'), ('extra', '1'), ('after_reset', '')) AS v(name, value)")
def session_statements(spark: SparkSession, sf: str) -> DataFrame:
    """Transactions, SET, SHOW, RESET and DISCARD, as a client sends them."""
    engine = _catalog(spark, sf)
    for statement in ("BEGIN", "SET application_name = 'report'", "SET SESSION extra TO 1", "SET TIME ZONE 'UTC'", "COMMIT", "DEALLOCATE ALL", "CLOSE ALL"):
        engine.sql(statement)
    show = lambda what: engine.sql(f"SHOW {what}").first()[0]
    rows = [(n, show(n)) for n in ("application_name", "search_path", "standard_conforming_strings", "extra")] + [("timezone", show("TIME ZONE")), ("transaction_isolation", show("TRANSACTION ISOLATION LEVEL"))]
    engine.sql("DISCARD ALL")
    return spark.createDataFrame([*rows, ("after_reset", show("application_name"))], "name string, value string")


@query("""SELECT * FROM (VALUES ('errors', 'counter', 'XX000', 1.0::DOUBLE), ('plan_seconds', 'histogram', '', 5.0::DOUBLE), ('statements', 'counter', 'aggregate_scan', 2.0::DOUBLE), ('statements', 'counter', 'full_scan', 2.0::DOUBLE), ('statements', 'counter', 'system', 1.0::DOUBLE), ('rows_fetched', 'counter', '', 5.0::DOUBLE)) AS m(name, kind, label, value)""")
def engine_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Counters and histograms that some statements leave."""
    engine = _catalog(spark, sf)
    engine.fetch("SELECT r_name FROM region")
    for statement in ("SELECT count(*) FROM nation", "SELECT max(n_name) FROM nation", "SHOW TABLES"):
        engine.sql(statement)
    _failure(lambda: engine.sql("SELECT x FROM nowhere"))
    return engine.metrics.frame(spark)


sql("implicit_default_key", "SELECT n_name FROM nation WHERE n_regionkey = 2 AND n_name LIKE '%A%'", "nation")


@query("SELECT * FROM (VALUES ('trades', true, 'venue'), ('local', false, 'symbol'), ('unknown', true, 'symbol')) AS r(name, sharded, key)")
def table_registry(spark: SparkSession, sf: str) -> DataFrame:
    """Declared tables and those that aren't: whether they are sharded, and by what."""
    from .registry import TableRegistry

    known = TableRegistry([TableSpec("Trades", shard_key="venue"), TableSpec("local", sharded=False)])
    return spark.createDataFrame([(n, known.is_sharded(n), known.shard_key(n)) for n in ("trades", "local", "unknown")], "name string, sharded boolean, key string")
