"""Line dedup through sharded minimal perfect hashing.

Lines of at least `min_chars` code points (stripped, lower-cased) are counted by a 128-bit hash, once a
document.  The distinct hashes are dealt into shards; each shard is indexed by a minimal perfect hash
(levels of bit arrays in which every key that is alone in its cell stays) over three plain arrays:
a 16-bit fingerprint of the key, its count clipped to one byte, and its keeper (the largest doc_id that holds it,
for keys at the threshold).  Documents then probe the arrays: their line hashes are dealt to the shards
and stream past the arrays in Arrow batches, so lines are never joined with lines.

A shard that many lines fall on (a very common line) is copied as often as its share of all lines asks,
and its probes are dealt over the copies by document and line.  Only the lines to drop come back.

Defined cases: null and empty texts are one empty line; a row is a document, so repeated rows count each;
rows with a null doc_id count below every id (a key that only such rows hold is dropped from all of them); columns
besides doc_id and text are ignored; very long texts take time in proportion; an empty table gives no rows.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise, parts, slices

MIN_CHARS, MIN_DOCS = 40, 5
#: Distinct lines of a shard, about.
SHARD_KEYS = 200_000
#: Lines that probe one copy of a shard, about.
GROUP_ROWS = 250_000


def key_of(line: bytes) -> bytes:
    """A line's key: blanks stripped at both ends, A-Z lower-cased."""
    return line.strip().lower()


# ---------------------------------------------------------------- minimal perfect hash


def _mix(key: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = key ^ np.uint64((salt * 0x9E3779B97F4A7C15) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Distinct 64-bit keys to 0..n-1, one number each; about 3 bits a key."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, base = [], 0
        for bits in levels:
            self.ranks.append(base + np.concatenate(([0], np.cumsum(bits, dtype=np.int64)))[:-1])
            base += int(bits.sum())
        self.size = base

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            cells = max(8, int(1.5 * len(left)))
            at = (_mix(left, len(levels) + 1) % np.uint64(cells)).astype(np.int64)
            alone = np.bincount(at, minlength=cells) == 1
            levels.append(alone)
            left = left[~alone[at]]
            if len(levels) > 200:
                raise ValueError("keys aren't distinct")
        return cls(levels)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for k, (bits, rank) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = (_mix(keys[todo], k + 1) % np.uint64(len(bits))).astype(np.int64)
            here = bits[at]
            out[todo[here]] = rank[at[here]]
            todo = todo[~here]
            if not len(todo):
                break
        return out

    def dump(self) -> bytes:
        parts = [struct.pack("<I", len(self.levels))]
        for bits in self.levels:
            parts += [struct.pack("<I", len(bits)), np.packbits(bits).tobytes()]
        return b"".join(parts)

    @classmethod
    def load(cls, raw: bytes) -> PerfectHash:
        (n,) = struct.unpack_from("<I", raw)
        at, levels = 4, []
        for _ in range(n):
            (cells,) = struct.unpack_from("<I", raw, at)
            size = -(-cells // 8)
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, size, at + 4), count=cells).astype(bool))
            at += 4 + size
        return cls(levels)


class Index:
    """One shard: the hash and its arrays; keepers, and whether there is one, only for the cells at the threshold, in the cells' order."""

    def __init__(self, hash_: PerfectHash, tags: np.ndarray, counts: np.ndarray, keepers: np.ndarray, owned: np.ndarray):
        self.hash, self.tags, self.counts, self.keepers, self.owned = hash_, tags, counts, keepers, owned

    @classmethod
    def build(cls, h1, h2, count, keeper, min_docs: int, owned=None) -> Index:
        hash_ = PerfectHash.build(h1)
        at = hash_(h1)
        tags, counts = np.zeros(hash_.size, np.uint16), np.zeros(hash_.size, np.uint8)
        tags[at], counts[at] = (h2 & np.uint64(0xFFFF)).astype(np.uint16), np.minimum(count, 255)
        every = np.zeros(hash_.size, np.int64)
        every[at] = keeper
        some = np.ones(hash_.size, bool)
        if owned is not None:
            some[at] = owned
        often = counts >= min(min_docs, 255)
        return cls(hash_, tags, counts, every[often], some[often])

    def dump(self) -> bytes:
        raw = self.hash.dump()
        return struct.pack("<III", len(raw), self.hash.size, len(self.keepers)) + raw + self.tags.tobytes() + self.counts.tobytes() + self.keepers.tobytes() + self.owned.tobytes()

    @classmethod
    def load(cls, raw: bytes) -> Index:
        size, n, k = struct.unpack_from("<III", raw)
        at = 12 + size
        return cls(PerfectHash.load(raw[12:at]), np.frombuffer(raw, "<u2", n, at), np.frombuffer(raw, np.uint8, n, at + 2 * n), np.frombuffer(raw, "<i8", k, at + 3 * n), np.frombuffer(raw, bool, k, at + 3 * n + 8 * k))

    def drop(self, h1: np.ndarray, h2: np.ndarray, ids: np.ndarray, min_docs: int, unnamed: np.ndarray | None = None) -> np.ndarray:
        """Whether each probed line goes; lines of rows without an id (unnamed) never stay as the keeper's."""
        at = self.hash(h1)
        bound = min(min_docs, 255)
        often = self.counts >= bound
        place = np.cumsum(often) - 1
        ok = (at >= 0) & (self.tags[at] == (h2 & np.uint64(0xFFFF)).astype(np.uint16)) & often[at]
        out = np.zeros(len(h1), bool)
        cell = place[at[ok]]
        out[ok] = ~self.owned[cell] | (self.keepers[cell] != ids[ok])
        return out if unnamed is None else out | (ok & unnamed)


# ---------------------------------------------------------------- the operator

LINES = "row string, id long, unnamed boolean, line int, h1 long, h2 long, first boolean"


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Every line that counts: its row, doc_id, number, 128-bit hash, and whether it is the first such line of its document."""

    def run(batches):
        import xxhash

        for b in slices(batches, 2):
            rows, ids, unnamed, numbers, hashes, firsts = [], [], [], [], [], []
            for row, d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if not text or len(text) < min_chars:
                    continue
                seen = set()
                for k, line in enumerate(text.split(b"\n")):
                    if len(line) >= min_chars:
                        key = key_of(line)
                        if len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars):
                            rows.append(row)
                            ids.append(d or 0)
                            unnamed.append(d is None)
                            numbers.append(k)
                            hashes.append(xxhash.xxh3_128_digest(key))
                            firsts.append(hashes[-1] not in seen)
                            seen.add(hashes[-1])
            pair = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string()), pa.array(ids, pa.int64()), pa.array(unnamed, pa.bool_()), pa.array(numbers, pa.int32()), pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy()), pa.array(firsts, pa.bool_())], names=["row", "id", "unnamed", "line", "h1", "h2", "first"])

    return docs.select("row", "doc_id", F.col("text").cast("binary")).mapInArrow(run, LINES)


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(row, line): what goes. docs needs row (a row's own name), doc_id (long) and text."""
    spark = docs.sparkSession
    lines = materialise(line_hashes(docs, min_chars), "lines")
    # once a document: copies of a line within one don't count, copies of a document do
    counted = materialise(lines.groupBy("h1", "h2").agg(F.sum(F.col("first").cast("long")).alias("n"), F.count("*").alias("lines"), F.coalesce(F.max(F.when(~F.col("unnamed"), F.col("id"))), F.lit(0)).alias("keeper"), F.bool_or(~F.col("unnamed")).alias("owned")), "line-counts")
    size = counted.agg(F.count("*").alias("keys"), F.sum("lines").alias("probes")).first()
    if not size["keys"]:
        return spark.createDataFrame([], "row string, line int")
    shards = max(2 * parts(spark), -(-size["keys"] // SHARD_KEYS))
    shard = F.pmod("h1", F.lit(shards)).cast("int")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        # two different lines whose first halves are the same go to further indexes of the shard
        out, left = [], pdf
        while len(left):
            again = left["h1"].duplicated()
            now, left = left[~again], left[again]
            image = Index.build(now["h1"].to_numpy().view(np.uint64), now["h2"].to_numpy().view(np.uint64), now["n"].to_numpy(), now["keeper"].to_numpy(), min_docs, now["owned"].to_numpy()).dump()
            out.append({"shard": int(pdf["shard"].iat[0]), "image": image})
        return pd.DataFrame(out)

    images = counted.withColumn("shard", shard).groupBy("shard").applyInPandas(build, "shard int, image binary")
    # how many copies of each shard the lines that probe it ask for; one number a shard
    fair = min(max(1, size["probes"] // shards), GROUP_ROWS)
    load = counted.groupBy(shard.alias("shard")).agg(F.ceil(F.sum("lines") / (2 * fair)).cast("int").alias("copies"))
    copied = images.join(load, "shard").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    probes = lines.withColumn("shard", shard).join(F.broadcast(load.where("copies > 1")) if shards <= 100_000 else load.where("copies > 1"), "shard", "left")
    probes = probes.withColumn("copy", F.pmod(F.xxhash64("row", "line"), F.coalesce("copies", F.lit(1))).cast("int"))

    def probe(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"row": pd.Series([], dtype=object), "line": pd.Series([], dtype="int32")})
        h1, h2, ids, unnamed = left["h1"].to_numpy().view(np.uint64), left["h2"].to_numpy().view(np.uint64), left["id"].to_numpy(), left["unnamed"].to_numpy()
        gone = np.zeros(len(left), bool)
        for image in right["image"]:
            gone |= Index.load(image).drop(h1, h2, ids, min_docs, unnamed)
        return left.loc[gone, ["row", "line"]]

    return probes.select("shard", "copy", "row", "id", "unnamed", "line", "h1", "h2").groupBy("shard", "copy").cogroup(copied.select("shard", "copy", "image").groupBy("shard", "copy")).applyInPandas(probe, "row string, line int")


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): every text without the lines that go."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    named = plain.withColumn("row", F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.col("text").cast("binary"))).cast("binary")))
    gone = dropped_lines(named, min_chars, min_docs).distinct().groupBy("row").agg(F.collect_list("line").alias("gone"))
    lines = F.split("text", "\n", -1)
    # a mark for each line, laid end to end between the numbers of those that go: linear in the lines of a text
    order = F.array_sort("gone")
    before = F.concat(F.array(F.lit(-1)), F.slice(order, 1, F.size("gone") - 1))
    upto = F.flatten(F.zip_with(before, order, lambda a, b: F.concat(F.array_repeat(F.lit(False), b - a - 1), F.array(F.lit(True)))))
    marks = F.concat(upto, F.array_repeat(F.lit(False), F.size(lines) - 1 - F.array_max("gone")))
    kept = F.transform(F.filter(F.arrays_zip(lines.alias("line"), marks.alias("mark")), lambda x: ~x["mark"]), lambda x: x["line"])
    joined = named.join(gone, "row", "left")
    return joined.select(
        "doc_id", F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.concat_ws("\n", kept)).alias("kept"),
    )


def op3_query(docs: DataFrame) -> DataFrame:
    return dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
l AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM d),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT r) >= 5),
m AS (SELECT k.*, g.key IS NOT NULL AND g.keeper IS DISTINCT FROM k.doc_id AS gone FROM k LEFT JOIN g ON k.key = g.key)
SELECT any_value(doc_id) AS doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""
