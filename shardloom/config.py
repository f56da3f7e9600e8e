"""Configuration: dataclasses, read from TOML with environment overrides."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any

from .errors import ParseError

PREFIX = "SHARDLOOM"


@dataclass(frozen=True)
class Shard:
    id: int
    path: str = ""
    weight: int = 1
    virtual_nodes: int = 128


@dataclass(frozen=True)
class TableSpec:
    """One logical table: its columns, its designated timestamp, and how rows find their shard."""

    name: str
    columns: tuple[tuple[str, str], ...] = ()
    sharded: bool = True
    shard_key: str | None = None
    timestamp: str | None = None

    def schema(self):
        from .functions.cells import schema_of

        return schema_of(self.columns)

    @property
    def time_column(self) -> str | None:
        """The designated timestamp, or else the first column of a timestamp type."""
        return self.timestamp or next((n for n, k in self.columns if k.lower() in ("timestamp", "datetime", "timestamptz")), None)


@dataclass(frozen=True)
class Routing:
    shard_key: str = "symbol"
    federated_enabled: bool = True
    max_federated_rows: int = 1_000_000
    scan_allow_order_by: bool = False


@dataclass(frozen=True)
class Health:
    interval_s: int = 5
    timeout_s: int = 2
    exclude_unhealthy: bool = True
    min_healthy_shards: int = 1


@dataclass(frozen=True)
class Stream:
    replay_window: int = 1000
    topic_tags: tuple[str, ...] = ("symbol",)
    topic_missing: str = "*"


@dataclass(frozen=True)
class Ingest:
    prefix: str = ""
    bucket: str = ""
    checkpoint: str = ""
    trades_table: str = "trade_ticks"
    quotes_table: str = "quote_ticks"
    reconcile_s: int = 300
    attempts: int = 3


@dataclass(frozen=True)
class Config:
    routing: Routing = field(default_factory=Routing)
    health: Health = field(default_factory=Health)
    stream: Stream = field(default_factory=Stream)
    ingest: Ingest = field(default_factory=Ingest)
    shards: tuple[Shard, ...] = ()
    tables: tuple[TableSpec, ...] = ()

    def __post_init__(self):
        ids = [s.id for s in self.shards]
        if len(set(ids)) != len(ids):
            raise ParseError("shard ids must differ")
        if self.shards and self.health.min_healthy_shards > len(self.shards):
            raise ParseError("min_healthy_shards is above the number of shards")


def _convert(value: Any, like: Any) -> Any:
    if isinstance(like, bool):
        return str(value).lower() in ("1", "true", "yes", "on")
    if isinstance(like, int):
        return int(value)
    if isinstance(like, tuple) and isinstance(value, str):
        return tuple(x.strip() for x in value.split(",") if x.strip())
    return tuple(value) if isinstance(value, list) else value


def _section(kind: type, given: Mapping[str, Any], name: str, env: Mapping[str, str]):
    out = {}
    base = kind()
    for f in fields(kind):
        default = getattr(base, f.name)
        override = env.get(f"{PREFIX}__{name.upper()}__{f.name.upper()}")
        if override is not None:
            out[f.name] = _convert(override, default)
        elif f.name in given:
            out[f.name] = _convert(given[f.name], default)
    return kind(**out)


def from_mapping(data: Mapping[str, Any], env: Mapping[str, str] | None = None) -> Config:
    """A configuration from parsed TOML; SHARDLOOM__SECTION__NAME in the environment goes first."""
    env = os.environ if env is None else env
    sections = {f.name: _section(type(getattr(Config(), f.name)), data.get(f.name, {}), f.name, env) for f in fields(Config) if is_dataclass(getattr(Config(), f.name))}
    shards = tuple(Shard(**s) for s in data.get("shards", ()))
    tables = tuple(TableSpec(**(t | {"columns": tuple((c["name"], c["type"]) for c in t.get("columns", ()))})) for t in data.get("tables", ()))
    return Config(**sections, shards=shards, tables=tables)


def from_file(path: str, env: Mapping[str, str] | None = None) -> Config:
    with open(path, "rb") as f:
        return from_mapping(tomllib.load(f), env)
