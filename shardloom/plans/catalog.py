"""The catalog's own relations and a session's variables, as SQL clients ask for them when they connect."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from .ring import SHARD_COLUMN

# What a client sees of variables that nobody has set.
VARIABLES = {
    "application_name": "", "client_encoding": "UTF8", "datestyle": "ISO, MDY", "extra_float_digits": "1", "integer_datetimes": "on", "intervalstyle": "postgres",
    "search_path": "public", "server_encoding": "UTF8", "server_version": "14.0", "standard_conforming_strings": "on", "timezone": "UTC",
    "transaction_isolation": "read committed", "default_transaction_read_only": "on", "transaction_read_only": "on",
}
CATALOG, SCHEMA = "shardloom", "public"
#: Relations by their full names; a name that begins with pg_ may come without its schema.
RELATIONS = {
    "information_schema.tables": "table_catalog string, table_schema string, table_name string, table_type string",
    "information_schema.columns": "table_catalog string, table_schema string, table_name string, column_name string, ordinal_position int, is_nullable string, data_type string",
    "information_schema.schemata": "catalog_name string, schema_name string",
    "pg_catalog.pg_tables": "schemaname string, tablename string",
    "pg_catalog.pg_namespace": "oid int, nspname string",
}


def full_name(name: str) -> str | None:
    """The relation that a name in a statement stands for."""
    low = name.lower()
    found = low if "." in low else f"pg_catalog.{low}"
    return found if found in RELATIONS else None


def relation(spark: SparkSession, name: str, frames: Mapping[str, DataFrame]) -> DataFrame:
    """One of the relations over the tables that are known; a row a table or column."""
    kind = name.partition(".")[2]
    names = sorted(frames)
    if kind == "tables":
        rows = [(CATALOG, SCHEMA, n, "BASE TABLE") for n in names]
    elif kind == "columns":
        rows = [(CATALOG, SCHEMA, n, c, k, "YES", t) for n in names for k, (c, t) in enumerate((x for x in frames[n].dtypes if x[0] != SHARD_COLUMN), 1)]
    elif kind == "pg_tables":
        rows = [(SCHEMA, n) for n in names]
    elif kind == "pg_namespace":
        rows = [(1, SCHEMA), (2, "information_schema"), (3, "pg_catalog")]
    else:
        rows = [(CATALOG, n) for n in (SCHEMA, "information_schema", "pg_catalog")]
    return spark.createDataFrame(rows, RELATIONS[name])
