"""Column types by their configured names, and casts of text cells that give NULL where a cell can't be read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ParseError

# Configured type names and their types.
TYPE_NAMES: dict[str, T.DataType] = {
    "symbol": T.StringType(), "string": T.StringType(), "varchar": T.StringType(), "text": T.StringType(), "char": T.StringType(),
    "double": T.DoubleType(), "float8": T.DoubleType(),
    "float": T.FloatType(), "float4": T.FloatType(), "real": T.FloatType(),
    "long": T.LongType(), "int8": T.LongType(), "bigint": T.LongType(),
    "int": T.IntegerType(), "int4": T.IntegerType(), "integer": T.IntegerType(),
    "short": T.ShortType(), "int2": T.ShortType(), "smallint": T.ShortType(),
    "boolean": T.BooleanType(), "bool": T.BooleanType(),
    "timestamp": T.TimestampNTZType(), "datetime": T.TimestampNTZType(), "timestamptz": T.TimestampType(),
    "date": T.DateType(), "binary": T.BinaryType(), "bytea": T.BinaryType(),
}


def spark_type(name: str) -> T.DataType:
    """The type that a configured name stands for, in any case of letters."""
    try:
        return TYPE_NAMES[name.strip().lower()]
    except KeyError:
        raise ParseError(f"unknown column type: {name}") from None


def schema_of(columns: Sequence[tuple[str, str]]) -> T.StructType:
    """(name, type name) pairs to a schema; all columns take NULL, and there must be one at least."""
    if not columns:
        raise ParseError("a table needs a column")
    return T.StructType([T.StructField(n, spark_type(k), True) for n, k in columns])


def cell_boolean(x: Column) -> Column:
    return F.when(x.isin("t", "true", "TRUE", "1"), F.lit(True)).when(x.isin("f", "false", "FALSE", "0"), F.lit(False))


def cell_date(x: Column) -> Column:
    return F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}$"), x.try_cast("date"))


def cell_instant(x: Column) -> Column:
    """RFC 3339, date and time with a blank or T between, or whole microseconds since the epoch; a session in UTC is assumed."""
    dated = x.rlike(r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}")
    return F.when(dated, x.try_cast("timestamp")).when(x.rlike(r"^-?\d+$"), F.timestamp_micros(x.try_cast("long")))


def cell_binary(x: Column) -> Column:
    return F.when(x.startswith("\\x"), F.try_to_binary(F.substring(x, 3, 2**30), F.lit("hex"))).otherwise(x.cast("binary"))


def cell(x: Column, kind: T.DataType) -> Column:
    """A text cell as the given type; NULL where it can't be read."""
    if isinstance(kind, T.BooleanType):
        return cell_boolean(x)
    if isinstance(kind, T.DateType):
        return cell_date(x)
    if isinstance(kind, T.TimestampType):
        return cell_instant(x)
    if isinstance(kind, T.TimestampNTZType):
        return cell_instant(x).cast("timestamp_ntz")
    if isinstance(kind, T.BinaryType):
        return cell_binary(x)
    if isinstance(kind, T.StringType):
        return x
    return F.trim(x).try_cast(kind)


def decode(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Text columns to the schema: matched by name in any case, in the schema's order, NULL where one is missing."""
    have = {c.lower(): c for c in rows.columns}
    return rows.select(*((cell(F.col(f"`{have[f.name.lower()]}`"), f.dataType) if f.name.lower() in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema))
