"""SimHash near-duplicates by pigeonhole blocks.

A text's fingerprint is the bitwise majority of the XXH64 values of its word shingles.  Two fingerprints
that differ in at most `max_bits` bits, cut into `max_bits + 2` blocks, agree in two blocks at least; so
every pair of blocks is a join key, and all links are found under one of the keys.  Before the join equal
fingerprints become one row (copies are never paired with each other), and a key that very many different
fingerprints share is cut into square tiles, so that no task holds more than two tiles' rows.  A tile emits
a spanning forest of its links, never all pairs.  Components of the forest are the components of the links.

Defined cases: null and empty texts have fingerprint zero and link like any other; texts with fewer words
than a shingle are one shingle; repeated rows share a component; rows with a null doc_id get the component
of their fingerprint, whose id is the smallest doc_id that isn't null (null if there is none).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import forget, grouped, materialise, parts, row_key, slices, small
from ._components import components

#: Rows of a tile: different fingerprints under one key that are compared in one go.
TILE = 1024


def shingle_hashes(text: bytes | None, width: int, seed: int) -> np.ndarray:
    """XXH64 of every word shingle, repeats included; none for a text without words."""
    import xxhash

    words = (text or b"").lower().split()
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(b" ".join(words), seed)] if words else [], np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    stops = ends[width - 1 :].tolist()
    starts = [0, *(ends[: len(words) - width] + 1).tolist()]
    return np.array([digest(line[a:b], seed) for a, b in zip(starts, stops, strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> np.ndarray:
    """Eight bytes: each bit that more than half of the hashes have, the highest first."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192].astype(">u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(total * 2 > len(hashes))


def fingerprint(text: bytes | None, width: int = 3, seed: int = 42) -> int:
    """The SimHash of one text's word shingles as an unsigned 64-bit number."""
    return int.from_bytes(majority(shingle_hashes(text, width, seed)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long."""

    def run(batches):
        for b in slices(batches, 1):
            values = np.array([fingerprint(t, width, seed) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values.view(np.int64))], names=["doc_id", "fp"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return plain.mapInArrow(run, "doc_id long, fp long")


def block_masks(max_bits: int, agree: int = 2) -> list[tuple[int, ...]]:
    """Masks over 64 bits: with max_bits + agree blocks, fingerprints within max_bits agree under one mask."""
    n = max_bits + agree
    edges = [64 * i // n for i in range(n + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(masks, agree)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(left: np.ndarray, right: np.ndarray, same: bool, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of a spanning forest of the links between two lists of fingerprints; [n] or [n, words] of 64 bits."""
    if not len(left) or not len(right):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    left, right = left.reshape(len(left), -1), right.reshape(len(right), -1)
    n = len(left)
    label = np.arange(n if same else n + len(right))
    shift = 0 if same else n
    out_a, out_b = [], []
    for i in range(n):
        near = np.bitwise_count(right ^ left[i]).sum(axis=1, dtype=np.int64) <= max_bits
        there = label[shift:]
        while (todo := near & (there != label[i])).any():
            j = int(todo.argmax())
            label[label == there[j]] = label[i]
            out_a.append(i)
            out_b.append(j)
    return np.array(out_a, np.int64), np.array(out_b, np.int64)


def links(prints: DataFrame, max_bits: int = 3, tile: int = TILE) -> DataFrame:
    """Different fingerprints (fp, id) to a spanning set of links (u, v) between their ids."""
    masks = block_masks(max_bits)
    keyed = prints.select("fp", "id", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks))).alias("table", "key"))
    sizes = keyed.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1")
    keyed = keyed.join(sizes, ["table", "key"])
    tiles = F.ceil(F.col("n") / tile).cast("int")
    mine = F.pmod(F.xxhash64("fp"), tiles).cast("int")
    keyed = keyed.withColumn("tiles", tiles).withColumn("mine", mine)
    keyed = keyed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    keyed = keyed.select(
        F.xxhash64("table", "key", F.least("mine", "other"), F.greatest("mine", "other")).alias("group"),
        "table", "key", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), (F.col("mine") > F.col("other")).alias("second"), "fp", "id",
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        pdf = pdf.sort_values(["table", "key", "a", "b", "second"], kind="stable")
        fp, ids, second = pdf["fp"].to_numpy().view(np.uint64), pdf["id"].to_numpy(), pdf["second"].to_numpy()
        name = pdf[["table", "key", "a", "b"]].to_numpy(np.int64)
        edges = np.flatnonzero(np.concatenate(([True], (name[1:] != name[:-1]).any(axis=1)))).tolist()
        for x, z in zip(edges, [*edges[1:], len(pdf)], strict=True):
            if name[x, 2] == name[x, 3]:
                i, j = forest(fp[x:z], fp[x:z], True, max_bits)
                us.append(ids[x:z][i])
                vs.append(ids[x:z][j])
            else:
                y = x + int((~second[x:z]).sum())
                i, j = forest(fp[x:y], fp[y:z], False, max_bits)
                us.append(ids[x:y][i])
                vs.append(ids[y:z][j])
        return pd.DataFrame({"u": np.concatenate(us), "v": np.concatenate(vs)})

    # small groups share a lane; tiles of hot keys have lanes of their own.  The number of partitions is given, since
    # the work follows the comparisons and not the bytes by which partitions would be joined up
    n = 4 * parts(prints.sparkSession)
    lanes = F.when(F.col("b") > 0, F.col("group")).otherwise(F.pmod(F.col("group"), F.lit(n)).cast("long"))
    return keyed.withColumn("lane", lanes).repartition(n, "lane").groupBy("lane").applyInPandas(run, "u long, v long")


def near_duplicates(docs: DataFrame, width: int = 3, max_bits: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs."""
    prints = materialise(fingerprints(docs, width, seed), "simhash")
    # a fingerprint stands for itself in the links; ids come back in when components are known
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-distinct")
    found = components(links(distinct.select("fp", F.col("fp").alias("id")), max_bits))
    names = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("component", F.col("fp")).alias("c"))
    ids = names.groupBy("c").agg(F.min("low").alias("component_id"))
    names = names.join(ids, "c").select("fp", "component_id")
    return prints.join(names, "fp").select("doc_id", "fp", "component_id")


def op10_query(docs: DataFrame) -> DataFrame:
    out = near_duplicates(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- texts of a similarity

#: Words of 64 bits that a wide fingerprint has, and the share of pairs right at the similarity that may be missed.
WIDE, MISS = 4, 0.01
#: Fingerprints that may share a key by chance, about: many, since comparing them is cheap beside sending more keys.
CHANCE = 512
#: Words of a fingerprint that travel with a key; pairs a row beyond which a key gives a spanning forest of its
#: candidates; and rows of a partition, about.
CHECK, LINEAR, LANE_ROWS = 2, 2, 1_000_000
#: Rows of a tile whose pairs are never more than that.
SMALL = 2 * LINEAR + 1

def bit_distance(similarity: float) -> float:
    """The share of bits by which texts differ whose shingle sets have a Jaccard similarity; sets of one size are assumed."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def shingle_set(text: bytes | None, width: int = 5, seed: int = 42) -> np.ndarray:
    """XXH64 of a text's different word shingles, sorted."""
    return np.unique(shingle_hashes(text, width, seed))


def similar(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two shingle sets; that of two empty sets is 1."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common) if len(a) or len(b) else 1.0


def wide_fingerprint(text: bytes | None, width: int = 5, seed: int = 42) -> bytes:
    """A SimHash of 64 * WIDE bits over a text's different shingles."""
    return wide_print(shingle_set(text, width, seed))


def wide_print(hashes: np.ndarray) -> bytes:
    """The majority over several mixes of each shingle's XXH64."""
    if not len(hashes):
        return bytes(8 * WIDE)
    out = b""
    for k in range(WIDE):
        with np.errstate(over="ignore"):
            x = hashes ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) % 2**64)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
        out += majority(x).tobytes()
    return out


def missed(similarity: float, bits: int, keys: int, most: int) -> float:
    """The share of pairs right at a similarity that `keys` blocks of `bits` bits and a cut at `most` miss.

    The number of bits by which a pair differs is binomial, and the miss is summed over it, the part beyond the cut included, and
    that beyond the cut of the words that travel.  Sets of one size are assumed; with other sizes fingerprints are closer.
    """
    far, total = bit_distance(similarity), 64 * WIDE
    sent, cut = 64 * CHECK, sent_cut(similarity, most)
    weight = (1 - far) ** total
    out = sum(math.comb(sent, d) * far**d * (1 - far) ** (sent - d) for d in range(cut + 1, sent + 1))
    for d in range(total + 1):
        keep = math.comb(total - d, bits) / math.comb(total, bits)
        out += weight * ((1 - keep) ** keys if d <= most else 1)
        weight *= (total - d) / (d + 1) * far / (1 - far)
    return out


def sent_cut(similarity: float, most: int) -> int:
    """The bits by which the words that travel may differ, as many standard deviations beyond the mean as `most` is for all words."""
    far, total, sent = bit_distance(similarity), 64 * WIDE, 64 * CHECK
    return min(sent, round(sent * far + (most - total * far) * math.sqrt(sent / total)))


def plan_keys(n: int, similarity: float) -> tuple[np.ndarray, int]:
    """Bits of each block, [keys, bits], for n fingerprints, and the bits by which a candidate pair may differ.

    The cut is at four sigma, since links are verified; keys are as many as keep the miss under MISS at every n.
    """
    far = bit_distance(similarity)
    total = 64 * WIDE
    most = round(total * far + 4 * math.sqrt(total * far * (1 - far)))
    bits = max(10, math.ceil(math.log2(max(2.0, n / CHANCE))))
    low, high = 0, 1
    while missed(similarity, bits, high, most) > MISS:
        low, high = high, 2 * high
    while high - low > 1:
        half = (low + high) // 2
        low, high = (half, high) if missed(similarity, bits, half, most) > MISS else (low, half)
    rng = np.random.default_rng(41)
    return np.stack([np.sort(rng.choice(total, bits, replace=False)) for _ in range(high)]), most


PRINT = [f"f{k}" for k in range(WIDE)]


def near_pairs(fp: np.ndarray, most: int, limit: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Positions of all pairs within `most` bits; None where there are more than `limit`.  Words are looked at one after another."""
    out_i, out_j, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    step = max(1, (1 << 18) // max(1, len(fp)))
    for at in range(0, len(fp), step):
        far = np.bitwise_count(fp[at : at + step, None, 0] ^ fp[None, :, 0])
        near = (far <= most) & (np.arange(len(fp)) > np.arange(at, at + len(far))[:, None])
        i, j = np.nonzero(near)
        far = far[i, j].astype(np.int64)
        for k in range(1, fp.shape[1]):
            far += np.bitwise_count(fp[at + i, k] ^ fp[j, k])
        ok = far <= most
        found += int(ok.sum())
        if found > limit:
            return None
        out_i.append(at + i[ok])
        out_j.append(j[ok])
    return np.concatenate(out_i), np.concatenate(out_j)


SENT = PRINT[:CHECK]
MET = ["name", "a", "id", *SENT]


def compare(met: dict[str, np.ndarray], edges: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """Candidates (u, v, name, big) of whole tiles of a key, which begin at the edges; the rows of each are in the order of their ids.

    A tile gives all its candidates where they are LINEAR a row at most, and otherwise (big is true) a spanning forest of them, in which
    rows hang on the smallest ids, so that the tiles of a text's several keys give much the same pairs.
    """
    fp, ids, name = np.stack([met[c] for c in SENT], axis=1).view(np.uint64), met["id"], met["name"]
    size = np.diff(edges)
    group = np.repeat(np.arange(len(size)), size)
    us, vs, names, bigs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]

    def add(u, v, key, big):
        us.append(u)
        vs.append(v)
        names.append(np.full(len(u), key, np.int64))
        bigs.append(np.full(len(u), big))

    tiny = size <= SMALL
    mine = tiny[group]
    for step in range(1, int(size[tiny].max(initial=1))):  # tiny ones all at once: every row with the one so many rows on
        i = np.flatnonzero(mine[:-step] & (group[step:] == group[:-step]))
        i = i[np.bitwise_count(fp[i] ^ fp[i + step]).sum(axis=1, dtype=np.int64) <= most]
        add(ids[i], ids[i + step], 0, False)
    for x, m in zip(edges[:-1][~tiny].tolist(), size[~tiny].tolist(), strict=True):
        own = fp[x : x + m]
        pairs = near_pairs(own, most, LINEAR * m)
        i, j = forest(own, own, True, most) if pairs is None else pairs
        add(ids[x : x + m][i], ids[x : x + m][j], name[x] if pairs is None else 0, pairs is None)
    u, v = np.concatenate(us), np.concatenate(vs)
    return np.minimum(u, v), np.maximum(u, v), np.concatenate(names), np.concatenate(bigs)


def candidates(met: DataFrame, n: int, most: int) -> DataFrame:
    """(u, v, name, big): pairs in a tile of a key (name) within `most` bits of the words that travel; a pair may come under several keys.

    met has the columns MET.  Rows come sorted, so a task holds one tile at a time.
    """

    def run(batches):
        for rows, edges in grouped(batches, 2):
            found = compare({c: rows.column(k).to_numpy(zero_copy_only=False) for k, c in enumerate(MET)}, edges, most)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["u", "v", "name", "big"])

    return met.select(*MET).repartition(n, "name", "a").sortWithinPartitions("name", "a", "id").mapInArrow(run, "u long, v long, name long, big boolean")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose shingle sets, by id in sets, have the similarity; both sets are at hand, so the check is exact."""

    def check(batches):
        for b in slices(batches, 2):
            ok = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= similarity for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.select("u", "v").join(sets.select(F.col("id").alias("u"), F.col("set").alias("x")), "u").join(sets.select(F.col("id").alias("v"), F.col("set").alias("y")), "v")
    return both.select("u", "v", "x", "y").mapInArrow(check, "u long, v long")


class Tile:
    """Rows that share a key: pairs of different labels that may still be links, and the forest of those that are.

    A pair belongs to the first of the keys that its two texts share.  Where that one gave all its candidates, or joined
    them all, the pair is settled, so it is looked at in one tile alone.
    """

    def __init__(self, name: int, fp: np.ndarray, size: np.ndarray, label: np.ndarray, names: np.ndarray, right: slice, similarity: float, most: int):
        self.name, self.fp, self.size, self.label, self.names, self.right = name, fp, size, label.copy(), names, right
        self.similarity, self.most, self.cut = similarity, most, sent_cut(similarity, most)

    def open(self, i: int) -> np.ndarray:
        """Rows of the other side that row i may be linked to and isn't joined with."""
        j = self.right.start + np.flatnonzero(self.label[self.right] != self.label[i])
        far = np.bitwise_count(self.fp[j, :CHECK] ^ self.fp[i, :CHECK]).sum(axis=1, dtype=np.int64)
        j, far = j[far <= self.cut], far[far <= self.cut]
        far = far + np.bitwise_count(self.fp[j, CHECK:] ^ self.fp[i, CHECK:]).sum(axis=1, dtype=np.int64)
        low, high = np.minimum(self.size[j], self.size[i]), np.maximum(self.size[j], self.size[i])
        j = j[(far <= self.most) & (low >= high * self.similarity)]
        first = (self.names[j] == self.names[i]).argmax(axis=1) if len(j) else j
        return j[self.names[i][first] == self.name]

    def links(self, rows: range, sets: list[np.ndarray]) -> list[tuple[int, int]]:
        """A forest of the links, each verified by the whole sets."""
        out = []
        for i in rows:
            j = self.open(i)
            if not len(j):
                continue
            mine, flat = sets[i], np.concatenate([sets[k] for k in j.tolist()])
            place = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
            common = np.add.reduceat(mine[place] == flat, np.cumsum(self.size[j]) - self.size[j], dtype=np.int64)
            for k in j[common >= self.similarity * (len(mine) + self.size[j] - common)].tolist():
                if self.label[k] != self.label[i]:
                    self.label[self.label == self.label[k]] = self.label[i]
                    out.append((i, k))
        return out


def tiles(rows: pa.RecordBatch, edges: np.ndarray, similarity: float, most: int, names_of) -> Iterator[tuple[int, int, Tile]]:
    """The tiles of a run of rows (name, a, b, second, id, label, size and the fingerprint) that hold more than one label, with their places."""
    name, a, b, second, label, size = (rows.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2, 3, 5, 6))
    fp = np.stack([rows.column(7 + k).to_numpy() for k in range(WIDE)], axis=1)
    names, fp = names_of(fp), fp.view(np.uint64)
    for x, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if z - x > 1 and (label[x:z] != label[x]).any():
            split = 0 if a[x] == b[x] else int((~second[x:z]).sum())
            yield x, z, Tile(int(name[x]), fp[x:z], size[x:z].astype(np.int64), label[x:z], names[x:z], slice(split, z - x), similarity, most)


def settled(again: DataFrame, docs: DataFrame, distinct: DataFrame, n: int, similarity: float, most: int, width: int, names_of, paths: list[str]) -> DataFrame:
    """Links (u, v) that join what is still apart in the keys of `again` (columns OPEN): compared by whole sets, tile by tile.

    Only rows with a pair that isn't settled fetch their sets; each tile gives a forest.
    """

    def needed(batches):
        for rows, edges in grouped(batches, 3):
            some = np.zeros(rows.num_rows, bool)
            for x, z, tile in tiles(rows, edges, similarity, most, names_of):
                for i in range(tile.right.start or z - x):
                    j = tile.open(i)
                    some[x + i] |= len(j) > 0
                    some[x + j] = True
            yield rows.filter(pa.array(some))

    def joined(batches):
        for rows, edges in grouped(batches, 3):
            ids, out = rows.column(4).to_numpy(), []
            for x, z, tile in tiles(rows, edges, similarity, most, names_of):
                sets = [np.frombuffer(s, np.uint64) for s in rows.column(7 + WIDE).slice(x, z - x).to_pylist()]
                out += [(ids[x + i], ids[x + j]) for i, j in tile.links(range(tile.right.start or z - x), sets)]
            pairs = np.array(out, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1, initial=2**63 - 1)), pa.array(pairs.max(axis=1, initial=-(2**63)))], names=["u", "v"])

    order = ["name", "a", "b", "second"]
    dealt = again.select(*OPEN).repartition(n, *order[:3]).sortWithinPartitions(*order)
    left = materialise(dealt.mapInArrow(needed, again.select(*OPEN).schema), "wide-open", paths)
    sets = shingle_sets(docs, left.select("id").distinct(), distinct, width, paths)
    whole = left.join(sets, "id").select(*OPEN, "set").repartition(n, *order[:3]).sortWithinPartitions(*order)
    return materialise(whole.mapInArrow(joined, "u long, v long"), "wide-links", paths)


OPEN = ["name", "a", "b", "second", "id", "label", "size", *PRINT]


def plausible(pairs: DataFrame, known: DataFrame, similarity: float, most: int) -> DataFrame:
    """Different pairs (u, v) whose whole fingerprints and numbers of shingles allow the similarity; known has id, size and the fingerprint."""
    side = lambda end: known.select(F.col("id").alias(end), F.col("size").alias(f"_n{end}"), *(F.col(c).alias(f"_{end}{c}") for c in PRINT))
    both = pairs.select("u", "v").distinct().join(side("u"), "u").join(side("v"), "v")
    far = sum((F.bit_count(F.col(f"_u{c}").bitwiseXOR(F.col(f"_v{c}"))) for c in PRINT[1:]), F.bit_count(F.col(f"_u{PRINT[0]}").bitwiseXOR(F.col(f"_v{PRINT[0]}"))))
    return both.where((far <= most) & (F.least("_nu", "_nv") >= F.greatest("_nu", "_nv") * F.lit(similarity))).select("u", "v")


def apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs whose ends the components (node, component) haven't joined."""
    u, v = groups.select(F.col("node").alias("u"), F.col("component").alias("_cu")), groups.select(F.col("node").alias("v"), F.col("component").alias("_cv"))
    return pairs.join(u, "u", "left").join(v, "v", "left").where(F.coalesce("_cu", "u") != F.coalesce("_cv", "v")).drop("_cu", "_cv")


def near_texts(docs: DataFrame, similarity: float = 0.8, width: int = 5, tile: int = 2048) -> DataFrame:
    """(doc_id, component_id, row, component): texts linked at a similarity of their shingle sets, found by wide fingerprints.

    At such a similarity fingerprints differ in a seventh of their bits, and blocks that are sure to hold no difference would
    be too short to tell texts apart.  Here a block is a sample of bits long enough to be rare, and there are so many of them that a
    pair right at the similarity shares one but in MISS of all cases (closer pairs practically always).  Rows that share a block are
    compared by the words of the fingerprint that travel with it (CHECK of WIDE), then by the whole fingerprint and the numbers of
    shingles; pairs that are close enough are candidates, and each link is verified by the Jaccard similarity of the two sets.

    Texts don't travel with the blocks.  Their shingle sets are made again for candidates alone: first one candidate of
    each text is verified, then those whose ends are still apart.  Where a forest's edge isn't a link and its ends stay apart,
    the texts of its block that aren't joined yet are compared by their sets within its tiles.  Blocks that very many texts share are found on a share of the
    ids (by their hash) and cut into tiles, each in its own way, so that tiles alone join most of what is alike; where they haven't, tiles are
    compared with each other by sets too.  The cut decides on the work's layout, never on a result.  No step gives more rows than in
    proportion to those that it reads.

    component_id is the smallest doc_id of a group (null if there is none); row is the name of a row by doc_id and text, and
    component that of a group, which groups without an id have too.  Very long texts are taken whole; an empty table gives no rows.
    """
    spark = docs.sparkSession
    shape = f"doc_id long, row string, id long, size int, {', '.join(f'{c} long' for c in PRINT)}"

    def prints_of(batches):
        import xxhash

        for b in slices(batches, 2):
            sets = [shingle_set(t, width) for t in b.column(2).to_pylist()]
            ids = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            fp = np.frombuffer(b"".join(map(wide_print, sets)), np.int64).reshape(-1, WIDE)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids), pa.array([len(s) for s in sets], pa.int32()), *(pa.array(fp[:, k].copy()) for k in range(WIDE))], names=["doc_id", "row", "id", "size", *PRINT])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("doc_id"), F.col("text")).alias("row"), F.col("text").cast("binary").alias("text"))
    prints, paths = materialise(plain.mapInArrow(prints_of, shape), "wide-simhash"), []
    # texts with the same set are one: id stands for the set, and the fingerprint follows from it
    distinct = materialise(prints.groupBy("id").agg(F.min("doc_id").alias("low"), F.min("row").alias("row"), F.min("size").alias("size"), *(F.min(c).alias(c) for c in PRINT)), "wide-distinct")
    count = distinct.count()
    samples, most = plan_keys(count, similarity)
    weights = 1 << np.arange(samples.shape[1], dtype=np.int64)

    def names_of(fp: np.ndarray) -> np.ndarray:
        """The names of all keys of each fingerprint, [n, keys]."""
        bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8), axis=1)
        key = np.stack([bits[:, s] @ weights for s in samples], axis=1).view(np.uint64)
        with np.errstate(over="ignore"):
            x = key ^ (np.arange(1, len(samples) + 1, dtype=np.uint64) << np.uint64(40))
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            return (x ^ (x >> np.uint64(31))).view(np.int64)

    def keys_of(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                fp = np.stack([part.column(k + 1).to_numpy() for k in range(WIDE)], axis=1)
                again = np.repeat(np.arange(part.num_rows), len(samples))
                columns = [pa.array(names_of(fp).reshape(-1)), pa.array(part.column(0).to_numpy()[again]), *(pa.array(fp[again, k]) for k in range(CHECK))]
                yield pa.RecordBatch.from_arrays(columns, names=["name", "id", *SENT])

    def named(rows: DataFrame) -> DataFrame:
        return rows.select("id", *PRINT).mapInArrow(keys_of, f"name long, id long, {', '.join(f'{c} long' for c in SENT)}")

    share = max(1, min(64, tile // 16))
    crowd = named(distinct.where(F.pmod("id", F.lit(share)) == 0)).groupBy("name").agg((F.count("*") * share).alias("n")).where(F.col("n") > tile)
    crowd = materialise(crowd, "wide-crowd", paths)
    met = named(distinct).join(small(crowd), "name", "left").withColumn("tiles", F.coalesce(F.ceil(F.col("n") / tile), F.lit(1)).cast("int"))
    met = met.withColumn("a", F.pmod(F.xxhash64("id", "name"), F.col("tiles")).cast("int"))

    n = max(2 * parts(spark), count * len(samples) // LANE_ROWS)
    cut = sent_cut(similarity, most)
    found = materialise(candidates(met, n, cut), "wide-candidates", paths)
    pairs = materialise(plausible(found, distinct, similarity, most), "wide-pairs", paths)
    sets = shingle_sets(docs, pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct(), distinct, width, paths)
    good = materialise(verified(pairs.groupBy("v").agg(F.min("u").alias("u")), sets, similarity), "wide-links", paths)
    groups = components(good)
    rest = materialise(apart(pairs, groups), "wide-candidates", paths)
    if rest.limit(1).count():
        good = materialise(good.union(verified(rest, sets, similarity)), "wide-links", paths)
        groups = components(good)
    labels = distinct.select("id", "size", *PRINT).join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
    torn = met.select("name", "id").join(small(crowd.select("name")), "name", "left_semi").join(labels.select("id", "label"), "id")
    torn = torn.groupBy("name").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("name")
    failed = materialise(apart(found.where("big").select("u", "v", "name"), groups).select("name").union(torn).distinct(), "wide-failed", paths)
    if failed.limit(1).count():
        again = met.select("name", "id", "tiles", F.col("a").alias("mine")).join(small(failed), "name", "left_semi").join(labels, "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        again = again.withColumns({"a": F.least("mine", "other"), "b": F.greatest("mine", "other"), "second": F.col("mine") > F.col("other")})
        groups = components(good.union(settled(again, docs, distinct, n, similarity, most, width, names_of, paths)))
    forget(spark, *paths)
    names = distinct.join(groups.withColumnRenamed("node", "id"), "id", "left").select("id", "low", F.coalesce("component", "id").alias("c"))
    lowest = names.groupBy("c").agg(F.min("low").alias("component_id"))
    return prints.select("doc_id", "row", "id").join(names.join(lowest, "c").select("id", "component_id", F.col("c").alias("component")), "id").select("doc_id", "component_id", "row", "component")


def shingle_sets(docs: DataFrame, ids: DataFrame, distinct: DataFrame, width: int, paths: list[str]) -> DataFrame:
    """(id, set) of the texts that the ids name, read again by the names of their rows."""
    wanted = ids.join(distinct.select("id", "row"), "id")
    texts = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("row"), F.col("text").cast("binary").alias("text"))

    def sets_of(batches):
        for b in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t, width).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["id", "set"])

    found = texts.join(small(materialise(wanted, "wide-wanted", paths)), "row").select("id", "text").mapInArrow(sets_of, "id long, set binary")
    return materialise(found.dropDuplicates(["id"]), "wide-sets", paths)


def stage(docs: DataFrame) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest doc_id.

    Five-word shingles and a similarity of 0.8.  Rows are told apart by doc_id and text: repeated rows become one, and different texts
    under one doc_id each stay or go by themselves.  Rows without a doc_id are grouped among themselves, so that one of each group
    of them stays, whatever rows with a doc_id are like it.
    """
    groups = near_texts(docs).withColumn("unnamed", F.col("doc_id").isNull())
    kept = groups.groupBy("component", "unnamed").agg(F.min_by("row", F.struct("doc_id", "row")).alias("_row_key")).select("_row_key")
    named = docs.withColumn("_row_key", row_key(F.col("doc_id"), F.col("text")))
    return named.join(kept, "_row_key", "left_semi").dropDuplicates(["_row_key"]).select(*docs.columns)
