"""Tick files: Arrow IPC streams of trades or quotes with fixed-point prices, under `.../data/{trades|quotes}/<SYMBOL.VENUE>/`."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ParseError
from .line_protocol import render

TRADES, QUOTES = "trades", "quotes"
DEFAULT_PRECISION = 8
# Sides of the aggressor.
SIDES = {1: "BUYER", 2: "SELLER"}
NO_SIDE = "NO_AGGRESSOR"

TRADE_SCHEMA = "path string, symbol string, venue string, price double, size double, aggressor_side string, trade_id string, ts_event bigint"
QUOTE_SCHEMA = "path string, symbol string, venue string, bid double, ask double, bid_size double, ask_size double, ts_event bigint"


def kind_of(path: Column) -> Column:
    """trades, quotes, or NULL, by the path alone."""
    low = F.lower(path)
    return F.when(low.contains("/data/trades/"), F.lit(TRADES)).when(low.contains("/data/quotes/"), F.lit(QUOTES))


def should_ingest(path: Column, prefix: str = "") -> Column:
    """Whether a path is a tick file under the prefix."""
    return F.lower(path).rlike(r"[^/]\.(feather|arrow)$") & path.startswith(prefix)


def instrument_of_path(path: str, kind: str) -> str | None:
    """The path's segment after the data marker."""
    head, marker, rest = path.lower().partition(f"/data/{kind}/")
    if not marker:
        return None
    name = path[len(head) + len(marker) :].split("/", 1)[0]
    return name or None


def split_instrument(name: str) -> tuple[str, str]:
    """Symbol and venue, cut at the last dot; without one the venue is unknown."""
    symbol, dot, venue = name.rpartition(".")
    return (symbol, venue) if dot else (name, "UNKNOWN")


def _fixed(column: pa.ChunkedArray, precision: int) -> pa.Array:
    """Fixed-point numbers of 8 bytes, little-endian, as doubles."""
    flat = column.combine_chunks()
    widths = pc.unique(pc.binary_length(flat)).drop_null().to_pylist()
    if widths not in ([], [8]):
        raise ParseError(f"a fixed-point number has 8 bytes, not {next(w for w in widths if w != 8)}")
    whole = np.frombuffer(b"".join(pc.fill_null(flat.cast(pa.binary()), bytes(8)).to_pylist()), "<i8")
    return pa.array(whole / 10**precision, mask=flat.is_null().to_numpy(zero_copy_only=False))


def decode_file(path: str, content: bytes, kind: str) -> pa.Table:
    """Rows of one file; an empty one, other framing than an IPC stream or a wrong width is an error."""
    try:
        table = pa.ipc.open_stream(io.BytesIO(content)).read_all()
    except pa.ArrowInvalid as e:
        raise ParseError(f"not an Arrow IPC stream: {path}: {e}") from None
    if table.num_rows == 0:
        raise ParseError(f"no rows: {path}")
    meta = {k.decode(): v.decode() for k, v in (table.schema.metadata or {}).items()}
    name = meta.get("instrument_id") or instrument_of_path(path, kind)
    if not name:
        raise ParseError(f"no instrument: {path}")
    symbol, venue = split_instrument(name)
    price, size = (int(meta[k]) if meta.get(k, "").isdigit() else DEFAULT_PRECISION for k in ("price_precision", "size_precision"))
    n = table.num_rows
    base = {"path": [path] * n, "symbol": [symbol] * n, "venue": [venue] * n}
    stamp = pa.array(table["ts_event"].to_pylist(), pa.int64())
    if kind == TRADES:
        side = [SIDES.get(x, NO_SIDE) for x in table["aggressor_side"].to_pylist()]
        own = {"price": _fixed(table["price"], price), "size": _fixed(table["size"], size), "aggressor_side": side, "trade_id": table["trade_id"].to_pylist()}
    else:
        own = {"bid": _fixed(table["bid_price"], price), "ask": _fixed(table["ask_price"], price), "bid_size": _fixed(table["bid_size"], size), "ask_size": _fixed(table["ask_size"], size)}
    return pa.table({**base, **own, "ts_event": stamp})


def decode(files: DataFrame, kind: str) -> DataFrame:
    """Rows (path, content) to ticks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                yield from decode_file(path, content.as_py(), kind).to_batches()

    return files.where(kind_of(F.col("path")) == kind).select("path", "content").mapInArrow(run, TRADE_SCHEMA if kind == TRADES else QUOTE_SCHEMA)


def read(spark: SparkSession, path: str, kind: str, prefix: str = "") -> DataFrame:
    """All tick files of a kind under a path whose keys, that is their paths below it, begin with the prefix."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = path.split(":", 1)[-1].strip("/")
    key = F.substring(F.col("path"), F.instr("path", root) + len(root) + 1, F.length("path"))
    return decode(files.where(should_ingest(key, prefix)), kind)


def to_lines(ticks: DataFrame, kind: str) -> DataFrame:
    """Decoded ticks as lines of the table of their kind: instrument and side as tags, the instant in nanoseconds."""
    fields = ["price", "size", "trade_id"] if kind == TRADES else ["bid", "ask", "bid_size", "ask_size"]
    tags = ["symbol", "venue", *(["aggressor_side"] if kind == TRADES else [])]
    return render(ticks, kind, tags, fields, nanoseconds="ts_event")


def unreadable(files: DataFrame, kind: str) -> DataFrame:
    """(path, error) of the rows (path, content) that can't be decoded, so that they can be set aside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    decode_file(path, content.as_py(), kind)
                except (ParseError, KeyError, pa.ArrowException) as e:
                    yield pa.RecordBatch.from_pydict({"path": [path], "error": [str(e)]})

    return files.where(kind_of(F.col("path")) == kind).select("path", "content").mapInArrow(run, "path string, error string")


def stream(spark: SparkSession, path: str, kind: str, max_files: int = 100) -> DataFrame:
    """Tick files as they arrive; the stream's checkpoint remembers which were read."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).load(path)
    return decode(files.where(should_ingest(F.col("path"))), kind)


def with_time(ticks: DataFrame, name: str = "timestamp") -> DataFrame:
    """Ticks with their instant, cut to microseconds, as a timestamp without zone."""
    return ticks.withColumn(name, F.timestamp_micros(F.expr("ts_event div 1000")).cast("timestamp_ntz"))
