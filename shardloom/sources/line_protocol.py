"""Line protocol: `measurement,tag=v,... field=v,... [timestamp_ns]`.

The default grammar is the plain one: no escapes; a comma is required after the measurement, which must not be empty; what follows the
last blank behind the tags is the timestamp, and where it isn't a whole number of 64 bits there is none.  A string is what stands between its
opening quote and its last character.  It is read in Arrow batches by string kernels, some passes over a whole batch instead of
an expression tree a line.  `strict=True` reads backslash escapes and quoted strings too, with column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import TableSpec
from ..functions.cells import cell
from ..functions.scalars import tag
from ..plans.ring import SHARD_COLUMN, Ring

FIELD = "struct<k:string,f:double,i:bigint,b:boolean,s:string>"
WHOLE = r"^[+-]?\d+$"

# How booleans and numbers are written.
TRUE, FALSE = ("t", "T", "true", "TRUE"), ("f", "F", "false", "FALSE")
REAL = r"(?i)^[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity|nan)$"

# Control characters stand for escaped marks while a line is cut up.
_ESCAPES = (("\\\\", "\x01"), ("\\,", "\x02"), ("\\ ", "\x03"), ("\\=", "\x04"), ('\\"', "\x05"))


def _cover(line: Column) -> Column:
    for mark, stand_in in _ESCAPES:
        line = F.replace(line, F.lit(mark), F.lit(stand_in))
    # blanks, commas and equals signs in quoted strings: every second piece between quotes
    pieces = F.split(line, '"', -1)
    inner = F.transform(pieces, lambda p, k: F.when(k % 2 == 1, F.translate(p, ", =", "\x02\x03\x04")).otherwise(p))
    return F.array_join(inner, '"')


def _uncover(text: Column) -> Column:
    return F.translate(text, "\x01\x02\x03\x04\x05", '\\, ="')


def _pairs(items: Column) -> Column:
    """(k, v) of the items with an equals sign, cut at the first one."""
    kept = F.filter(items, lambda x: F.instr(x, "=") > 0)
    return F.transform(kept, lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.regexp_replace(x, r"^[^=]*=", "").alias("v")))


def _typed(k: Column, v: Column) -> Column:
    """A field with the one of its values that it has."""
    quoted = (F.length(v) >= 2) & v.startswith('"') & v.endswith('"')
    truth = F.when(v.isin(*TRUE), F.lit(True)).when(v.isin(*FALSE), F.lit(False))
    whole = F.when(~quoted & v.rlike(r"^[+-]?\d+i$"), F.regexp_replace(v, "i$", "").try_cast("bigint"))
    real = F.when(~quoted & truth.isNull() & v.rlike(REAL), v.try_cast("double"))
    return F.struct(k.alias("k"), real.alias("f"), whole.alias("i"), truth.alias("b"), F.when(quoted, F.regexp_replace(v, '^"|"$', "")).alias("s"))


TAGS, FIELDS = "array<struct<k:string,v:string>>", f"array<{FIELD}>"


def _wholes(text: pa.Array) -> pa.Array:
    """Whole numbers of 64 bits; NULL for other texts."""
    short = pc.match_substring_regex(text, r"^-?\d{1,18}$")
    out = pc.cast(pc.if_else(short, text, None), pa.int64())
    rest = pc.and_kleene(pc.invert(short), pc.match_substring_regex(text, r"^[+-]?\d+$"))
    if not pc.any(rest).as_py():
        return out
    odd = [int(x) if r and -(2**63) <= int(x) < 2**63 else None for x, r in zip(text.to_pylist(), rest.to_pylist(), strict=True)]
    return pc.coalesce(out, pa.array(odd, pa.int64()))


def _items(text: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """k and v of a text's items between commas that have an equals sign, cut at the first one, and where each text's begin."""
    lists = pc.split_pattern(pc.fill_null(text, ""), ",")
    pairs = pc.extract_regex(lists.flatten(), r"(?s)^(?P<k>[^=]*)=(?P<v>.*)$")
    ok = pc.is_valid(pairs)
    before = np.concatenate(([0], np.cumsum(ok.to_numpy(zero_copy_only=False))))
    offsets = lists.offsets.to_numpy()
    pairs = pairs.filter(ok)
    return pc.struct_field(pairs, "k"), pc.struct_field(pairs, "v"), before[offsets - offsets[0]].astype(np.int32)


def _lists(offsets: np.ndarray, columns: dict[str, pa.Array]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(list(columns.values()), list(columns)))


def _values(text: pa.Array) -> pa.Array:
    """The fields of each text, those with a value that can be read."""
    k, v, offsets = _items(text)
    quoted = pc.starts_with(v, '"')
    truth = pc.if_else(pc.is_in(v, pa.array(TRUE)), True, pc.if_else(pc.is_in(v, pa.array(FALSE)), False, None))
    whole = _wholes(pc.if_else(pc.and_(pc.ends_with(v, "i"), pc.invert(quoted)), pc.utf8_slice_codeunits(v, 0, -1), None))
    real = pc.cast(pc.if_else(pc.match_substring_regex(v, REAL), v, None), pa.float64())
    string = pc.if_else(pc.and_(quoted, pc.greater(pc.utf8_length(v), 1)), pc.utf8_slice_codeunits(v, 1, -1), None)
    columns = {"k": k, "f": real, "i": whole, "b": truth, "s": string}
    read = pc.or_(pc.or_(pc.is_valid(real), pc.is_valid(whole)), pc.or_(pc.is_valid(truth), pc.is_valid(string)))
    before = np.concatenate(([0], np.cumsum(read.to_numpy(zero_copy_only=False))))
    return _lists(before[offsets].astype(np.int32), {n: c.filter(read) for n, c in columns.items()})


def _parsed(lines: pa.Array) -> tuple[pa.Array, list[pa.Array]]:
    """Which lines can be read, and measurement, tags, fields and timestamp of those."""
    cut = pc.extract_regex(lines, r"(?s)^(?P<m>[^,]+),(?P<head>[^ ]*)(?: (?P<tail>.*?))?\n?$")
    sound = pc.is_valid(cut)
    cut = cut.filter(sound)
    tail = pc.struct_field(cut, "tail")
    split = pc.extract_regex(tail, r"(?s)^(?P<body>.*) (?P<stamp>[^ ]*)$")
    body = pc.coalesce(pc.struct_field(split, "body"), tail)
    k, v, offsets = _items(pc.struct_field(cut, "head"))
    return sound, [pc.struct_field(cut, "m"), _lists(offsets, {"k": k, "v": v}), _values(body), _wholes(pc.struct_field(split, "stamp"))]


def parse(lines: DataFrame, line: str = "value", strict: bool = False) -> DataFrame:
    """Lines to (measurement, tags, fields, timestamp_ns), with the other columns kept; lines that can't be read are left out."""
    if strict:
        return _parse_strict(lines, line)
    kept = [c for c in lines.columns if c != line]
    plain = lines.select(F.struct(*kept).alias("kept") if kept else F.lit(0).alias("kept"), F.col(line).alias("line"))
    schema = plain.select("kept", F.lit("").alias("measurement"), F.lit(None).cast(TAGS).alias("tags"), F.lit(None).cast(FIELDS).alias("fields"), F.lit(None).cast("bigint").alias("timestamp_ns")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sound, columns = _parsed(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(sound), *columns], names=schema.names)

    return plain.mapInArrow(run, schema).select(*(["kept.*"] if kept else []), *schema.names[1:])


def _parse_strict(lines: DataFrame, line: str) -> DataFrame:
    raw = F.regexp_replace(F.col(line), r"\n$", "")
    text = _cover(raw)
    named = F.regexp_extract(text, r"^([^, ]+)", 1)
    rest = F.regexp_replace(text, r"^[^, ]+,?", "")
    head, tail = F.substring_index(rest, " ", 1), F.regexp_replace(rest, r"^[^ ]*( |$)", "")
    final = F.element_at(F.split(tail, " ", -1), -1)
    stamp = F.when((F.instr(tail, " ") > 0) & final.rlike(WHOLE), final.try_cast("bigint"))
    fields = F.when(stamp.isNotNull(), F.regexp_replace(tail, r" [^ ]*$", "")).otherwise(tail)
    tags = F.transform(_pairs(F.split(head, ",", -1)), lambda t: F.struct(_uncover(t["k"]).alias("k"), _uncover(t["v"]).alias("v")))
    values = _pairs(F.split(fields, ",", -1))
    typed = F.filter(F.transform(values, lambda p: _typed(p["k"], p["v"])), lambda x: F.coalesce(x["f"].cast("string"), x["i"].cast("string"), x["b"].cast("string"), x["s"]).isNotNull())
    typed = F.transform(typed, lambda x: F.struct(_uncover(x["k"]).alias("k"), x["f"].alias("f"), x["i"].alias("i"), x["b"].alias("b"), _uncover(x["s"]).alias("s")))
    sound = lines.where(F.col(line).isNotNull() & (F.instr(raw, " ") > 0) & (F.length(named) > 0))
    return sound.select(*(c for c in lines.columns if c != line), _uncover(named).alias("measurement"), tags.alias("tags"), typed.alias("fields"), stamp.alias("timestamp_ns"))


def measurement(line: Column) -> Column:
    """The measurement of a line: what stands before the first comma or blank; NULL if nothing does."""
    return F.nullif(F.regexp_extract(line, r"^([^, \n]+)", 1), F.lit(""))


def shard_key(line: Column, name: str) -> Column:
    """The value of a tag in a line, its name in any case of letters; the tag's own name where the line lacks it."""
    head = F.substring_index(line, " ", 1)
    found = F.get(F.filter(F.split(head, ",", -1), lambda x: F.lower(F.substring_index(x, "=", 1)) == name.lower()), 0)
    return F.coalesce(F.nullif(F.regexp_replace(F.when(F.instr(found, "=") > 0, found), r"^[^=]*=", ""), F.lit("")), F.lit(name))


def route(lines: DataFrame, ring: Ring, key_of_table: dict[str, str], default_key: str, line: str = "value") -> DataFrame:
    """Lines with their table, key and shard; blank lines are left out."""
    table = measurement(F.col(line))
    key = F.lit(None).cast("string")
    for name, own in key_of_table.items():
        key = F.coalesce(key, F.when(table == name, shard_key(F.col(line), own)))
    return lines.where(F.length(F.trim(F.col(line))) > 0).withColumns({"table": table, "key": F.coalesce(key, shard_key(F.col(line), default_key))}).withColumn(SHARD_COLUMN, ring.column(F.col("key")))


def _field(name: str) -> Column:
    """The first field of a name, in any case of letters."""
    return F.get(F.filter("fields", lambda x: F.lower(x["k"]) == name.lower()), 0)


def project(parsed: DataFrame, spec: TableSpec) -> DataFrame:
    """Parsed lines of one table to its columns: a tag or field of each name, the designated timestamp from nanoseconds."""
    from pyspark.sql import types as T

    out = []
    for f in spec.schema():
        if f.name == spec.time_column:
            out.append(F.timestamp_micros(F.expr("timestamp_ns div 1000")).cast(f.dataType).alias(f.name))
            continue
        value = _field(f.name)
        if isinstance(f.dataType, T.StringType):
            col = F.coalesce(tag(F.col("tags"), f.name), value["s"])
        elif isinstance(f.dataType, T.BooleanType):
            col = value["b"]
        elif isinstance(f.dataType, T.NumericType):
            col = F.coalesce(value["f"], value["i"].cast("double")).cast(f.dataType) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.coalesce(value["i"], value["f"].cast("bigint")).cast(f.dataType)
        else:
            col = cell(F.coalesce(tag(F.col("tags"), f.name), value["s"]), f.dataType)
        out.append(col.alias(f.name))
    return parsed.where(F.lower("measurement") == spec.name.lower()).select(*out)


def escape_tag(x: Column) -> Column:
    return F.regexp_replace(x, r"([\\ ,=])", r"\\$1")


def escape_string(x: Column) -> Column:
    return F.regexp_replace(x, r'([\\"])', r"\\$1")


def render(df: DataFrame, measurement_: str, tags: list[str], fields: list[str], timestamp: str | None = None, nanoseconds: str | None = None) -> DataFrame:
    """Rows to lines (value); NULL tags and fields are left out, and rows without a field too.  The instant is a timestamp, or a number."""
    kinds = dict(df.dtypes)

    def value(c: str) -> Column:
        if kinds[c] == "string":
            return F.concat(F.lit('"'), escape_string(F.col(c)), F.lit('"'))
        return F.concat(F.col(c).cast("string"), F.lit("i")) if kinds[c] in ("bigint", "int", "smallint", "tinyint") else F.col(c).cast("string")

    head = F.concat_ws(",", F.lit(measurement_), *(F.when(F.col(t).isNotNull(), F.concat(F.lit(f"{t}="), escape_tag(F.col(t).cast("string")))) for t in tags))
    body = F.concat_ws(",", *(F.when(F.col(f).isNotNull(), F.concat(F.lit(f"{f}="), value(f))) for f in fields))
    stamp = [(F.unix_micros(F.col(timestamp).cast("timestamp")) * 1000).cast("string")] if timestamp else [F.col(nanoseconds).cast("string")] if nanoseconds else []
    return df.where(F.length(body) > 0).select(F.concat_ws(" ", head, body, *stamp).alias("value"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def stream_socket(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Lines from a socket, for development."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()
