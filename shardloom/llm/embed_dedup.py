"""Embedding near-duplicates by Euclidean p-stable hashing.

Vectors are normalised; a table's hash is the quantised projection of a vector onto `K` Gaussian directions, and
vectors of one bucket in any of `L` tables are compared exactly in double precision.  K follows the number of
vectors so that buckets of unrelated vectors stay bounded, and L follows K so that a pair exactly at the
threshold is missed with probability `MISS` at most (closer pairs far less often).

Equal vectors become one class before the hashing.  What travels for each table is not the vector but a sketch of
`SKETCH` signs of projections: rows of a bucket whose sketches are too far from all others of it drop out, and
only the rest fetch their vectors for the exact comparison.  A bucket that very many classes share is cut into square
tiles; which buckets are so is told from a share of the classes, and decides on the layout only.  A tile adds up the
links of each class and emits a spanning forest of them, never pairs; a pair that meets in several tables counts in
the first of them only.

Defined cases: a vector that is null, empty or zero, or holds a null, NaN or infinity, links with nothing and stays its own
component; components of any finite size are taken, however large or small; vectors of another length never link;
repeated rows (the same vec_id) are copies like any others; labels and other columns are never read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import forget, grouped, materialise, parts, small
from ._components import components

THRESHOLD = 0.95
#: Quantisation step, in units of distance on the sphere.
STEP = 1.2
MISS = 0.02
#: Classes that may share a bucket by chance, about; and classes of a tile.
CHANCE, TILE = 512, 1024
#: Signs of a sketch, and how many standard deviations beyond the mean a pair at the threshold may differ.
SKETCH, SIGMA = 128, 5.0


def collision(distance: float, step: float = STEP) -> float:
    """Probability that one quantised projection of two points is the same."""
    t = step / distance
    below = 0.5 * (1 + math.erf(-t / math.sqrt(2)))
    return 1 - 2 * below - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def plan_tables(n: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(projections a table, tables) for n vectors."""
    near, far = collision(math.sqrt(2 - 2 * threshold)), collision(math.sqrt(2))
    k = max(4, math.ceil(math.log(max(1.0, n / CHANCE)) / -math.log(far)))
    return k, math.ceil(math.log(MISS) / math.log(1 - near**k))


def sketch_cut(threshold: float = THRESHOLD) -> int:
    """Signs by which the sketches of a pair at the threshold may differ; all but a few in a million do so less."""
    share = math.acos(threshold) / math.pi
    return math.ceil(SKETCH * share + SIGMA * math.sqrt(SKETCH * share * (1 - share)))


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; they are scaled by a power of two first, so that no square is too large or too small."""
    v = vectors.astype(np.float64)
    _, e = np.frexp(np.abs(v).max(axis=1, keepdims=True, initial=0))
    v = np.ldexp(v, -e)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


class Hasher:
    """Bucket numbers of unit vectors in every table; the directions follow from the seed and the vectors' length."""

    def __init__(self, k: int, tables: int, seed: int = 23):
        self.k, self.tables, self.seed = k, tables, seed
        self.cache: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def buckets(self, unit: np.ndarray) -> np.ndarray:
        dim = unit.shape[1]
        if dim not in self.cache:
            rng = np.random.default_rng([self.seed, dim])
            n = self.k * self.tables
            self.cache[dim] = rng.normal(size=(dim, n)), rng.uniform(0, STEP, n), rng.integers(1, 2**62, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        directions, shift, odd = self.cache[dim]
        cell = np.floor((unit @ directions + shift) / STEP).astype(np.int64).view(np.uint64)
        with np.errstate(over="ignore"):
            mixed = (cell + np.uint64(0x9E3779B9)) * odd
            mixed ^= mixed >> np.uint64(31)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            return mixed.reshape(len(unit), self.tables, self.k).sum(axis=2, dtype=np.uint64).view(np.int64)


    def signs(self, unit: np.ndarray) -> np.ndarray:
        """Sketches, [n, SKETCH / 64] words."""
        directions = np.random.default_rng([self.seed, unit.shape[1], 1]).normal(size=(unit.shape[1], SKETCH))
        return np.packbits(unit @ directions > 0, axis=1).view(np.int64).reshape(len(unit), -1)


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Lists of numbers as matrices of doubles, one a length, with the rows' positions; a null component is NaN."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    offsets = column.offsets.to_numpy()[:-1]
    flat = pc.fill_null(pc.cast(column.values, pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    for n in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == n)
        yield at, flat[offsets[at][:, None] + np.arange(n)]


def spanning(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of a link matrix [left, right] as positions; sides may be the same or different."""
    n, m = near.shape
    label = np.arange(n + m)
    a_out, b_out = [], []
    for i in np.flatnonzero(near.any(axis=1)).tolist():
        columns = np.flatnonzero(near[i])
        there = label[n + columns]
        for k in np.unique(there, return_index=True)[1].tolist():
            if there[k] != label[i]:
                label[label == there[k]] = label[i]
                a_out.append(i)
                b_out.append(int(columns[k]))
    return np.array(a_out, np.int64), np.array(b_out, np.int64)


def partners(sketch: np.ndarray, second: np.ndarray, same: bool, cut: int) -> np.ndarray:
    """Which rows of a tile have another one (of the other side, where there are two) within the cut."""
    some = np.zeros(len(sketch), bool)
    split = len(sketch) if same else int((~second).sum())
    left, right = sketch[:split], sketch if same else sketch[split:]
    shift = 0 if same else split
    step = max(1, (1 << 18) // max(1, len(right)))
    for at in range(0, len(left), step):
        i, j = np.nonzero(np.bitwise_count(left[at : at + step, None, 0] ^ right[None, :, 0]) <= cut)
        i += at
        if same:
            i, j = i[i != j], j[i != j]
        ok = np.bitwise_count(left[i] ^ right[j]).sum(axis=1, dtype=np.int64) <= cut
        some[i[ok]] = True
        some[shift + j[ok]] = True
    return some


class Links:
    """What the tiles of a batch found: links of each node, and a forest."""

    def __init__(self) -> None:
        self.nodes, self.counts, self.u, self.v = ([np.zeros(0, np.int64)] for _ in range(4))

    def tile(self, node: np.ndarray, size: np.ndarray, unit: np.ndarray, buckets: np.ndarray, second: np.ndarray, table: int, same: bool, threshold: float) -> None:
        split = len(node) if same else int((~second).sum())
        x, y = slice(0, split), slice(0, split) if same else slice(split, None)
        near = unit[x] @ unit[y].T >= threshold
        if same:
            np.fill_diagonal(near, False)
        i, j = np.nonzero(near)
        for at in range(0, len(i) if table else 0, 1 << 16):  # a pair that met in an earlier table counted there
            p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            met = (buckets[x][p, :table] == buckets[y][q, :table]).any(axis=1)
            near[p[met], q[met]] = False
        for side, matrix, other in ((x, near, y), (y, near.T, x))[: 1 if same else 2]:
            counts = matrix @ size[other]
            self.nodes.append(node[side][counts > 0])
            self.counts.append(counts[counts > 0])
        p, q = spanning(near)
        self.u.append(node[x][p])
        self.v.append(node[y][q])

    def batch(self) -> pa.RecordBatch:
        node, inverse = np.unique(np.concatenate(self.nodes), return_inverse=True)
        links = np.bincount(inverse, np.concatenate(self.counts), len(node)).astype(np.int64)
        u, v = np.concatenate(self.u), np.concatenate(self.v)
        columns = [np.concatenate([node, u]), np.concatenate([links, np.zeros(len(u), np.int64)])]
        other = pa.array(np.concatenate([np.zeros(len(node), np.int64), v]), mask=np.arange(len(node) + len(u)) < len(node))
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), other], names=["node", "links", "other"])


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row; needs vec_id and embedding."""
    spark = vectors.sparkSession
    kind = vectors.schema["embedding"].dataType.simpleString()

    def keyed(batches):
        import xxhash

        for b in batches:
            high, low = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            sound = np.zeros(b.num_rows, bool)
            for at, rows in matrices(b.column(1)):
                ok = np.isfinite(rows).all(axis=1) & (rows != 0).any(axis=1)
                sound[at] = ok
                pair = np.frombuffer(b"".join(xxhash.xxh3_128_digest(r.tobytes()) for r in rows[ok] + 0.0), "<i8").reshape(-1, 2)
                high[at[ok]], low[at[ok]] = pair[:, 0], pair[:, 1]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(high, mask=~sound), pa.array(low, mask=~sound), pc.if_else(pa.array(sound), b.column(1), None)], names=["vec_id", "high", "low", "embedding"])

    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows = materialise(plain.mapInArrow(keyed, f"vec_id long, high long, low long, embedding {kind}"), "vectors")
    classes = rows.where("high is not null").groupBy("high", "low").agg(F.count("*").alias("size"), F.min("vec_id").alias("smallest"), F.first("embedding").alias("v"))
    classes = materialise(classes.withColumn("node", F.col("high")), "vector-classes")
    # a node is 64 bits of a class's 128; in the rare case that two classes share them, others are taken
    seed = 0
    while classes.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        seed += 1
        classes = materialise(classes.withColumn("node", F.xxhash64(F.lit(seed), "high", "low")), "vector-classes")
    n = classes.count()
    k, tables = plan_tables(n, threshold)
    paths: list[str] = []
    hasher, cut, words = Hasher(k, tables), sketch_cut(threshold), [f"s{w}" for w in range(SKETCH // 64)]

    def hashed(batches):
        for b in batches:
            buckets, signs = np.zeros((b.num_rows, tables), np.int64), np.zeros((b.num_rows, len(words)), np.int64)
            for at, values in matrices(b.column(2)):
                unit = unit_rows(values)
                buckets[at], signs[at] = hasher.buckets(unit), hasher.signs(unit)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * tables, pa.int32()), pa.array(buckets.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists, *(pa.array(signs[:, w].copy()) for w in range(len(words)))], names=["node", "size", "v", "buckets", *words])

    known = materialise(classes.select("node", "size", "v").mapInArrow(hashed, f"node long, size long, v {kind}, buckets array<bigint>, {', '.join(f'{w} long' for w in words)}"), "vector-hashes", paths)

    def spread(rows: DataFrame) -> DataFrame:
        each = rows.select("node", F.size("v").alias("length"), *words, F.posexplode("buckets").alias("table", "bucket"))
        return each.select(F.xxhash64("table", "bucket", "length").alias("name"), "table", "node", *words)

    share = max(1, min(64, TILE // 16))
    crowd = spread(known.where(F.pmod(F.xxhash64("node", F.lit(3)), F.lit(share)) == 0)).groupBy("name").agg((F.count("*") * share).alias("n")).where(F.col("n") > TILE)
    met = spread(known).join(small(materialise(crowd, "vector-crowd", paths)), "name", "left").withColumn("tiles", F.coalesce(F.ceil(F.col("n") / TILE), F.lit(1)).cast("int"))
    met = met.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tile = ["name", "table", "a", "b", "second"]
    met = met.select("name", "table", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), (F.col("mine") > F.col("other")).alias("second"), "node", *words)

    def thinned(batches):
        """The rows of each tile that have a partner by their sketches."""
        for rows, edges in grouped(batches, 4):
            sketch = np.stack([rows.column(6 + w).to_numpy() for w in range(len(words))], axis=1).view(np.uint64)
            same, second = rows.column(2).to_numpy() == rows.column(3).to_numpy(), rows.column(4).to_numpy(zero_copy_only=False)
            some = np.zeros(rows.num_rows, bool)
            for x, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if z - x > 1:
                    some[x:z] = partners(sketch[x:z], second[x:z], bool(same[x]), cut)
            yield rows.select([*tile, "node"]).filter(pa.array(some))

    def compared(batches):
        for rows, edges in grouped(batches, 4):
            table, second, same = rows.column(1).to_numpy(), rows.column(4).to_numpy(zero_copy_only=False), rows.column(2).to_numpy() == rows.column(3).to_numpy()
            node, size, found = rows.column(5).to_numpy(), rows.column(6).to_numpy(), Links()
            buckets = rows.column(8).flatten().to_numpy().reshape(-1, tables)
            for x, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if z - x > 1:
                    [(_, values)] = matrices(rows.column(7).slice(x, z - x))
                    found.tile(node[x:z], size[x:z], unit_rows(values), buckets[x:z], second[x:z], int(table[x]), bool(same[x]), threshold)
            yield found.batch()

    n = max(2 * parts(spark), n * tables // 1_000_000)
    deal = lambda df: df.repartition(n, "name", "a", "b").sortWithinPartitions(*tile)
    busy = materialise(deal(met).mapInArrow(thinned, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in met.select(*tile, "node").schema)), "vector-candidates", paths)
    whole = busy.join(known.select("node", "size", "v", "buckets"), "node").select(*tile, "node", "size", "v", "buckets")
    results = materialise(deal(whole).mapInArrow(compared, "node long, links long, other long"), "vector-links", paths)
    degree = materialise(results.where("other is null").groupBy("node").agg(F.sum("links").alias("links")), "vector-degrees")
    found = components(results.where("other is not null").select(F.col("node").alias("u"), F.col("other").alias("v")))
    forget(spark, *paths)
    named = classes.select("high", "low", "node", "size", "smallest").join(degree, "node", "left").join(found, "node", "left")
    named = named.select("high", "low", "smallest", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "node").alias("c"))
    lowest = named.groupBy("c").agg(F.min("smallest").alias("component_id"))
    named = named.join(lowest, "c").select("high", "low", "n_links", "component_id")
    out = rows.select("vec_id", "high", "low").join(named, ["high", "low"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op9_query(vectors: DataFrame) -> DataFrame:
    return near_duplicates(vectors)


#: Every pair, and what each vector reaches; for small tables.  Pairs right at the threshold may be missed by the hashing, as MISS says.
ORACLE = """
WITH RECURSIVE e AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
n AS (SELECT r, vec_id, v, sqrt(list_dot_product(v, v)) AS size FROM e WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
p AS (SELECT a.r AS a, b.r AS b FROM n a JOIN n b ON a.r <> b.r AND len(a.v) = len(b.v) AND list_dot_product(a.v, b.v) / (a.size * b.size) >= 0.95),
c AS (SELECT r AS a, r AS b FROM e UNION SELECT c.a, p.b FROM c JOIN p ON c.b = p.a),
m AS (SELECT c.a AS r, min(e.vec_id) AS component_id FROM c JOIN e ON c.b = e.r GROUP BY c.a),
l AS (SELECT a AS r, count(*) AS n_links FROM p GROUP BY a)
SELECT e.vec_id, coalesce(l.n_links, 0) AS n_links, m.component_id, e.vec_id IS NOT DISTINCT FROM m.component_id AS kept FROM e JOIN m ON e.r = m.r LEFT JOIN l ON e.r = l.r
"""
