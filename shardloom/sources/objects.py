"""Which objects to ingest: notifications, the checkpoint of what was ingested, and the reconcile scan."""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tick_files import should_ingest

_RECORD = "struct<eventName:string,s3:struct<bucket:struct<name:string>,object:struct<key:string,eTag:string>>>"
NOTICE = f"struct<Records:array<{_RECORD}>,EventName:string,Key:string,ETag:string>"
CHECKPOINT = "bucket string, key string, etag string, processed_at timestamp, rows bigint"


def parse_notices(bodies: DataFrame, body: str = "value", default_bucket: str = "") -> DataFrame:
    """Notification bodies to (bucket, key, etag): lists of records, or one flat event; only created tick files.

    Of percent codes only %20 is decoded, and a plus sign is a blank.  The flat form's key may begin with the bucket, which is taken off.
    """
    n = F.from_json(F.col(body), NOTICE)
    listed = F.transform(n["Records"], lambda r: F.struct(r["eventName"].alias("event"), F.coalesce(F.nullif(r["s3"]["bucket"]["name"], F.lit("")), F.lit(default_bucket)).alias("bucket"), r["s3"]["object"]["key"].alias("key"), r["s3"]["object"]["eTag"].alias("etag")))
    slash = F.instr(n["Key"], "/") > 0
    begins = F.lit(bool(default_bucket)) & n["Key"].startswith(f"{default_bucket}/") if default_bucket else slash
    flat = F.array(F.struct(
        n["EventName"].alias("event"),
        F.when(begins & F.lit(not default_bucket), F.substring_index(n["Key"], "/", 1)).otherwise(F.lit(default_bucket)).alias("bucket"),
        F.when(begins, F.regexp_replace(n["Key"], "^[^/]*/", "")).otherwise(n["Key"]).alias("key"),
        n["ETag"].alias("etag"),
    ))
    rows = bodies.select(F.explode(F.when(n["Records"].isNotNull(), listed).otherwise(flat)).alias("r")).select("r.*")
    key = F.replace(F.replace(F.col("key"), F.lit("%20"), F.lit(" ")), F.lit("+"), F.lit(" "))
    created = F.regexp_replace("event", "^s3:", "").startswith("ObjectCreated:")
    return rows.where(created & F.col("key").isNotNull()).select("bucket", key.alias("key"), F.nullif(F.translate("etag", '"', ""), F.lit("")).alias("etag")).where(should_ingest(F.col("key")))


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """What was ingested, the latest entry of each object; empty before the first."""
    try:
        rows = spark.read.schema(CHECKPOINT).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in (e.getCondition() or str(e)):
            raise
        return spark.createDataFrame([], CHECKPOINT)
    return rows.groupBy("bucket", "key").agg(F.max_by(F.struct("etag", "processed_at", "rows"), "processed_at").alias("r")).select("bucket", "key", "r.*")


def mark_processed(done: DataFrame, path: str) -> None:
    """Append entries (bucket, key, etag, rows)."""
    done.select("bucket", "key", F.col("etag").cast("string"), F.current_timestamp().alias("processed_at"), F.col("rows").cast("bigint")).write.mode("append").parquet(path)


def to_process(objects: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """Objects that are new, whose etag changed, or where either etag is missing."""
    seen = checkpoint.select("bucket", "key", F.col("etag").alias("_etag"), F.lit(True).alias("_seen"))
    joined = objects.join(seen, ["bucket", "key"], "left")
    return joined.where(F.col("_seen").isNull() | F.col("etag").isNull() | F.col("_etag").isNull() | (F.col("etag") != F.col("_etag"))).select(*objects.columns)


def reconcile(listing: DataFrame, checkpoint: DataFrame, prefix: str = "") -> DataFrame:
    """Listed tick files under a prefix that the checkpoint doesn't know at all."""
    wanted = listing.where(should_ingest(F.col("key"), prefix))
    return wanted.join(checkpoint.select("bucket", "key"), ["bucket", "key"], "left_anti")


def list_objects(spark: SparkSession, path: str, bucket: str) -> DataFrame:
    """Files under a path as (bucket, key, etag); the etag is made of length and time of change."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.lit(bucket).alias("bucket"), F.col("path").alias("key"), F.md5(F.concat_ws("-", "length", "modificationTime").cast("binary")).alias("etag"))


#: Threads that give files their names; each waits for the store most of the time.
MOVERS = 16
#: For writers of very many small files: tasks move their own files to the end, the driver doesn't move all of them one by one.
BY_TASKS = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}


def put_objects(files: DataFrame, root: str) -> None:
    """Rows (path, content) to files of their own below a folder, written by the executors and then given their names.

    Behind the content stands a line's end, which readers of framed formats don't see.  The rows are computed once.  A mounted folder
    gets its files from the tasks under their names; in other stores Spark writes them, with their paths beside them, the executors
    list them, and the driver renames them.
    """
    spark = files.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = lambda text: jvm.org.apache.hadoop.fs.Path(text)
    store = place(root).getFileSystem(conf)
    if store.getUri().getScheme() == "file":
        _put_mounted(files, place(root).toUri().getPath())
    else:
        _put_renamed(files, root, store, place)


def _put_mounted(files: DataFrame, folder: str) -> None:
    """`put_objects` for a folder that all machines see; a file appears whole, also where a task runs twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                target = f"{folder}/{path}"
                os.makedirs(os.path.dirname(target), exist_ok=True)
                part = f"{os.path.dirname(target)}/.{uuid.uuid4().hex}"
                with open(part, "wb") as out:
                    out.write(content.as_buffer())
                    out.write(b"\n")
                os.replace(part, target)
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    files.select("path", "content").mapInArrow(run, "n bigint").agg(F.sum("n")).first()


def _put_renamed(files: DataFrame, root: str, store, place: Callable) -> None:
    """`put_objects` for a store that only Spark reaches."""
    spark = files.sparkSession
    staged = f"{root.rstrip('/')}-staged"
    name = F.md5(F.col("path").cast("binary"))
    both = F.array(F.struct(F.col("content").cast("string").alias("value"), name.alias("_name")), F.struct(F.hex(F.encode("path", "UTF-8")).alias("value"), F.lit("paths").alias("_name")))
    files.select(F.explode(both).alias("r")).select("r.*").write.partitionBy("_name").options(**BY_TASKS).text(staged)
    if not store.exists(place(f"{staged}/_name=paths")):
        store.delete(place(staged), True)
        return
    found: dict[str, list[str]] = {}
    for part in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(staged).inputFiles():
        folder, _, file = part.rpartition("/")
        found.setdefault(folder.rpartition("=")[2], []).append(file)
    paths = [bytes.fromhex(r["value"]).decode() for r in spark.read.text(f"{staged}/_name=paths").distinct().toLocalIterator()]
    with ThreadPoolExecutor(MOVERS) as movers:
        list(movers.map(lambda folder: store.mkdirs(place(folder)), {f"{root}/{p}".rpartition("/")[0] for p in paths}))

        def move(path: str) -> None:
            key = hashlib.md5(path.encode()).hexdigest()
            for file in found[key]:
                store.rename(place(f"{staged}/_name={key}/{file}"), place(f"{root}/{path}"))

        list(movers.map(move, paths))
    store.delete(place(staged), True)
