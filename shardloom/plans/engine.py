"""SQL over registered tables: guard, rewrite, prune, run, cap."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, TableSpec
from ..errors import DisabledError, EngineError, NotFoundError, RowLimitError
from ..registry import is_system
from . import catalog
from . import route as routes
from .cluster import Cluster
from .dialect import bind, rewrite
from .metrics import Metrics
from .ring import SHARD_COLUMN
from .text import Token, render, tokens

#: Variables that a session may change in Spark too, and their names there; all others are remembered only.
OPEN_SETTINGS = {"spark.sql.shuffle.partitions": "spark.sql.shuffle.partitions", "spark.sql.session.timezone": "spark.sql.session.timeZone", "timezone": "spark.sql.session.timeZone"}
#: What SHOW lists rather than a variable.
LISTS = {"COLUMNS", "VIEWS", "DATABASES", "SCHEMAS", "FUNCTIONS", "CREATE", "PARTITIONS", "TBLPROPERTIES", "CATALOGS"}


class Engine:
    """Queries over a set of shards as if they were one.

    Tables come in as DataFrames.  One with a `_shard` column (the layout that `operators.scan.write_sharded` gives) is pruned
    to the key's shard whenever a statement compares the shard key with a value.
    """

    def __init__(self, spark: SparkSession, config: Config | None = None):
        self.spark, self.config = spark, config or Config()
        self.cluster = Cluster.of(self.config)
        self.frames: dict[str, DataFrame] = {}
        self.counts: Counter[str] = Counter()
        self.metrics = Metrics()
        self.variables: dict[str, str] = {}
        self.observers: list[Callable[[routes.Route], None]] = []

    def register(self, name: str, df: DataFrame, spec: TableSpec | None = None) -> None:
        """Make a table known; without a spec its columns come from the DataFrame."""
        kinds = {"timestamp_ntz": "timestamp", "timestamp": "timestamptz"}
        spec = spec or TableSpec(name, tuple((c, kinds.get(k, k)) for c, k in df.dtypes if c != SHARD_COLUMN), timestamp=next((c for c, k in df.dtypes if k.startswith("timestamp")), None))
        self.cluster.registry.add(spec)
        self.frames[name.lower()] = df
        df.createOrReplaceTempView(name)

    def explain_route(self, sql: str) -> routes.Route:
        return routes.classify(sql, self.cluster.registry.default_key)

    def guard(self, route: routes.Route) -> None:
        """Every table that a statement names must be known."""
        for name in route.tables:
            if name and not is_system(name) and name.rpartition(".")[2].lower() not in self.frames:
                raise NotFoundError(f"table not found: {name}")

    def _time_of(self, name: str) -> str | None:
        spec = self.cluster.registry.get(name)
        return spec.time_column if spec else None

    def _prune(self, sql: str, table: str, key: str) -> str:
        """The statement over the table's one shard that can hold the key."""
        df = self.frames[table.lower()]
        if SHARD_COLUMN not in df.columns or not self.cluster.ring.shards:
            return sql
        shard = self.cluster.ring.shard_of(key)
        view = f"_{table.lower()}_{uuid4().hex[:12]}"
        df.where(F.col(SHARD_COLUMN) == shard).createOrReplaceTempView(view)
        self.counts["pruned"] += 1
        self.metrics.observe("shards_read", 1)
        parts, out = tokens(sql), []
        for k, t in enumerate(parts):
            named = t.kind == "name" and t.bare.lower() == table.lower() and k and parts[k - 1].word == "FROM"
            out += [Token("name", view), *([Token("name", "AS"), t] if k + 1 == len(parts) or parts[k + 1].word in ("WHERE", "GROUP", "ORDER", "LIMIT", "SAMPLE", "LATEST", "HAVING", "") else [])] if named else [t]
        return render(out)

    def sql(self, text: str, params: list | tuple | None = None) -> DataFrame:
        """A statement's result; $1, $2, ... take their values from params."""
        try:
            with self.metrics.timed("plan_seconds"):
                return self._planned(text, params)
        except EngineError as e:
            self.metrics.count("errors", e.sqlstate)
            raise

    def _planned(self, text: str, params: list | tuple | None) -> DataFrame:
        route = self.explain_route(text)
        self.counts[route.kind] += 1
        self.metrics.count("statements", route.kind)
        for tell in self.observers:
            tell(route)
        if route.kind == routes.SESSION:
            return self._session(text)
        if route.kind == routes.SYSTEM and tokens(text)[0].word == "SHOW" and tokens(text)[1:2] and tokens(text)[1].word not in LISTS:
            return self._show(text)
        self.guard(route)
        text = self._relations(text)
        if route.kind not in (routes.SINGLE, routes.SYSTEM) and not self.config.routing.federated_enabled:
            raise DisabledError("queries over all shards are switched off")
        now = rewrite(text, self._time_of)
        if route.kind == routes.SINGLE and (key := routes.resolve_key(route, params)) is not None:
            if self.cluster.ring.shards:
                self.cluster.healthy()
            now = rewrite(self._prune(text, route.tables[0], key), lambda n: self._time_of(route.tables[0]))
        now, values = bind(now, params)
        return self._run(now, values)

    def _run(self, text: str, values: list) -> DataFrame:
        """A statement of Spark's, in which double quotes stand around names; the session's own reading of them comes back."""
        name = "spark.sql.ansi.doubleQuotedIdentifiers"
        before = self.spark.conf.get(name)
        self.spark.conf.set(name, "true")
        try:
            return self.spark.sql(text, args=values) if values else self.spark.sql(text)
        finally:
            self.spark.conf.set(name, before)

    def _relations(self, text: str) -> str:
        """The statement over views of the catalog's relations where it names them."""
        parts, out, k = tokens(text), [], 0
        while k < len(parts):
            t, name, step = parts[k], None, 1
            if t.kind == "name" and k and (parts[k - 1].word in ("FROM", "JOIN") or parts[k - 1].text == ","):
                dotted = k + 2 < len(parts) and parts[k + 1].text == "." and parts[k + 2].kind == "name"
                name = catalog.full_name(f"{t.bare}.{parts[k + 2].bare}" if dotted else t.bare)
                step = 3 if dotted and name else 1
            if name:
                view = f"_catalog_{name.replace('.', '_')}_{id(self):x}"
                catalog.relation(self.spark, name, self.frames).createOrReplaceTempView(view)
                out.append(Token("name", view))
            else:
                out.append(t)
            k += step
        return render(out) if out != parts else text

    def _session(self, text: str) -> DataFrame:
        parts = tokens(text)
        word, body = parts[0].word, [t for t in parts[1:] if t.word not in ("SESSION", "LOCAL")]
        if word == "SET" and body:
            if [t.word for t in body[:2]] == ["TIME", "ZONE"]:
                name, value = "timezone", body[2:]
            else:
                at = next((k for k, t in enumerate(body) if t.text == "=" or t.word == "TO"), len(body))
                name, value = "".join(t.bare for t in body[:at]).lower(), body[at + 1 :]
            setting = "".join(t.text for t in value).strip("'\"")
            self.variables[name] = setting
            if name in OPEN_SETTINGS:
                self.spark.conf.set(OPEN_SETTINGS[name], setting)
        elif word in ("RESET", "DISCARD"):
            self.variables.pop("".join(t.bare for t in body).lower(), None) if word == "RESET" and body and body[0].word != "ALL" else self.variables.clear()
        return self.spark.createDataFrame([], "ok boolean")

    def _show(self, text: str) -> DataFrame:
        """A variable as one row, or the names of all tables."""
        words = [t.bare for t in tokens(text)[1:] if t.text != ";"]
        name = "".join(words).lower()
        if name == "tables":
            return self.spark.createDataFrame([(n,) for n in sorted(self.frames)], "table_name string")
        name = {"timezone": "timezone", "transactionisolationlevel": "transaction_isolation"}.get(name, name)
        if name == "all":
            every = catalog.VARIABLES | self.variables
            return self.spark.createDataFrame(sorted(every.items()), "name string, setting string")
        value = self.variables.get(name, catalog.VARIABLES.get(name))
        if value is None:
            raise NotFoundError(f"no such variable: {name}")
        return self.spark.createDataFrame([(value,)], f"`{name}` string")

    def fetch(self, text: str, params: list | tuple | None = None) -> list:
        """All rows of a statement on the driver; more than the configured number are an error."""
        most = self.config.routing.max_federated_rows
        rows = self.sql(text, params).limit(most + 1).collect()
        self.metrics.count("rows_fetched", by=len(rows))
        if len(rows) > most:
            raise RowLimitError(f"more than {most} rows")
        return rows
