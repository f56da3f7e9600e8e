"""Helpers that several corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words in the contracts of this package.
BLANK = r"\x20\x09-\x0D"
WORD = rf"[^{BLANK}]+"


def slices(batches: Iterable[pa.RecordBatch], column: int, room: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut where a column of texts or bytes (or of their sizes) reaches `room` bytes, so that lists made of them stay small.

    What one batch holds is bounded by Spark (`maxBytesPerBatch`).  At the end memory that is free goes back to the system, since
    workers live on after their tasks.
    """
    for b in batches:
        x = b.column(column)
        sizes = pc.fill_null(x if pa.types.is_integer(x.type) else pc.binary_length(x), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + room, "right")))
            yield b.slice(at, end - at)
            at = end
    trim()


def trim() -> None:
    """Give free memory of this process back, where its C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def grouped(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Sorted rows as runs of whole groups, with where each group begins and the end; rows of a group share the first `keys` columns (numbers)."""
    held: pa.RecordBatch | None = None
    for b in batches:
        now = b if held is None else pa.concat_batches([held, b])
        if not now.num_rows:
            continue
        edges = _edges(now, keys)
        held = now.slice(edges[-1])
        if edges[-1]:
            yield now.slice(0, edges[-1]), edges
    if held is not None and held.num_rows:
        yield held, np.array([0, held.num_rows])


def _edges(rows: pa.RecordBatch, keys: int) -> np.ndarray:
    change = np.zeros(rows.num_rows, bool)
    change[0] = True
    for k in range(keys):
        x = rows.column(k).to_numpy()
        change[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(change)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir, or a folder of its own on a single machine where that is unset."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="llm-scratch-")
        context.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """Write to a table in the shared folder and read it back; cuts the lineage for good.

    The table's path is added to `paths`, so that the caller can delete tables that nothing reads any more.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with modest_batches(spark):
        df.write.parquet(path)
    if paths is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def modest_batches(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """Arrow batches of some MB for the jobs within; the session has its own settings back afterwards."""
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}
    before = {n: spark.conf.get(n) for n in names}
    for n, value in names.items():
        spark.conf.set(n, value)
    try:
        yield
    finally:
        for n, value in before.items():
            spark.conf.set(n, value)


def forget(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate tables."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Rows of a table that may be broadcast once they have been counted.
FEW = 200_000


def small(df: DataFrame, rows: int = FEW) -> DataFrame:
    """A written table, marked for broadcast where a count of it is at most `rows`; beyond that it is joined by a shuffle.

    The size decides on the plan only, never on the rows.
    """
    return F.broadcast(df) if df.count() <= rows else df


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files that no DataFrame refers to any more; it does so when garbage is collected."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of doc_id as text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def row_key(*columns: Column) -> Column:
    """128 bits that stand for a row's content; rows that are the same in every column share it and its outcome."""
    return F.md5(F.concat_ws("\x1f", *(F.coalesce(c.cast("string"), F.lit("\x00null")) for c in columns)))
