"""The register of queries, each with the SQL that checks it (none where SQL can't)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .config import Config, Routing
from .plans.engine import Engine

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def sql(name: str, text: str, *tables: str, oracle: str | None = None, params: list | None = None) -> None:
    """A query in the engine's SQL; the oracle is the same text unless it is given."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        engine = Engine(spark, Config(routing=Routing(shard_key="event_type")))
        for n in tables:
            engine.register(n, t(spark, sf, n))
        return engine.sql(text, params)

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = oracle or text
