"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Test items give seeds: runs of `GRAM` words whose words are rare together, by word frequencies counted over
all documents (an item without enough of them gives its rarest runs).  Seeds are looked up in every whole text; hits
of one item that lie close together make one passage, and the passage is aligned with the item by
Smith-Waterman over words, which scores paraphrased or edited copies too.  A document is contaminated by an item when
its best alignment reaches `THRESHOLD` of the score of a perfect copy, or when a second, strict alignment, in which every
edit costs `STRICT` words, is worth `PASSAGE` words or more: a passage of an item, however long the item is.  Every
`PASSAGE` words of an item in a row hold a seed, so no such verbatim passage is passed over.

A long stretch of hits is cut into windows that overlap by more than any alignment spans, and windows are aligned some at a
time, so memory doesn't grow with a text.  An item of fewer than `LEAST_WORDS` words is too short to be told from chance inside
a text; it contaminates only a document whose whole text has just its words.

Test items are taken in blocks of `BLOCK_SEEDS` words, one scan of the documents a block, and the words of all items are counted
in one scan for each `BLOCK_WORDS` different ones; so what is sent to the tasks is bounded however many items there are.

Defined cases: null and empty texts match nothing; items without a word are skipped; items with the same text each
report their matches; very long texts and repeated passages are searched whole; a doc_id that several rows share reports its best match an item; rows with a null doc_id report
under null; no item or no document gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise, row_key, slices, small

GRAM = 3
#: Bits of surprise that make a run of words rare, and seeds an item has at least where it has runs.
RARE_BITS, LEAST_SEEDS = 26.0, 6
BLOCK_SEEDS, BLOCK_WORDS = 1_000_000, 1_000_000
#: Words of the shortest item that is looked for inside texts.
LEAST_WORDS = 5
#: Cells of windows that are aligned in one go.
CELLS = 1 << 18
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.5
#: Matching words that a passage of an item is worth at least, and what an edit within it costs in words.
PASSAGE, STRICT = 13, 3
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def align(item: np.ndarray, passages: list[np.ndarray], match: int = MATCH, mismatch: int = MISMATCH, gap: int = GAP) -> np.ndarray:
    """Best local alignment score of an item with each passage (arrays of word numbers)."""
    if not passages:
        return np.zeros(0, np.int32)
    width = max(map(len, passages))
    grid = np.full((len(passages), width), -2, np.int64)
    for k, p in enumerate(passages):
        grid[k, : len(p)] = p
    best = np.zeros(len(passages), np.int32)
    row = np.zeros((len(passages), width + 1), np.int32)
    # a row's dependence on itself, max over k of (value[j-k] + k * gap), is a running maximum once the gap cost is added back
    slope = (-gap * np.arange(width + 1, dtype=np.int32))[None, :]
    for w in item:
        new = np.zeros_like(row)
        new[:, 1:] = np.maximum(row[:, :-1] + np.where(grid == w, match, mismatch), row[:, 1:] + gap)
        np.maximum(new, 0, out=new)
        new = np.maximum.accumulate(new + slope, axis=1) - slope
        np.maximum(best, new.max(axis=1), out=best)
        row = new
    return best


class Seeds:
    """Seeds of one block of items, in sorted arrays."""

    def __init__(self, items: list[tuple[int, list[bytes]]], bits: dict[bytes, float]):
        self.whole: dict[tuple[bytes, ...], list[int]] = {}
        for k, (_, own) in enumerate(items):
            if len(own) < LEAST_WORDS:
                self.whole.setdefault(tuple(own), []).append(k)
        self.ids = [i for i, _ in items]
        self.number: dict[bytes, int] = {}
        for _, own in items:
            for w in own:
                self.number.setdefault(w, len(self.number))
        self.items = [np.array([self.number[w] for w in own], np.int64) for _, own in items]
        keys, which, at = [], [], []
        gram = GRAM
        for k, (_, own) in enumerate(items):
            if len(own) < LEAST_WORDS:
                continue
            runs = [(sum(bits[w] for w in own[p : p + gram]), p) for p in range(len(own) - gram + 1)]
            order = sorted(runs, key=lambda r: (-r[0], r[1]))
            rare = {p for n, (b, p) in enumerate(order) if b >= RARE_BITS or n < LEAST_SEEDS}
            inside = PASSAGE - gram + 1
            for p in range(len(runs) - inside + 1):  # the rarest run of every PASSAGE words that hold no seed yet
                if not any(q in rare for q in range(p, p + inside)):
                    rare.add(max(runs[p : p + inside], key=lambda r: (r[0], r[1]))[1])
            places = np.array(sorted(rare), np.int64)
            keys.append(self.grams(self.items[k])[places])
            which.append(np.full(len(places), k, np.int64))
            at.append(places)
        keys.append(np.zeros(0, np.uint64))
        flat = np.concatenate(keys)
        order = np.argsort(flat, kind="stable")
        self.keys, self.which, self.at = flat[order], *(np.concatenate([*x, np.zeros(0, np.int64)])[order] for x in (which, at))

    @staticmethod
    def grams(numbers: np.ndarray) -> np.ndarray:
        """A 64-bit hash of every GRAM words in a row; what two runs share by chance, the alignment tells apart."""
        n = max(0, len(numbers) - GRAM + 1)
        out = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(GRAM):
                out = (out + numbers[j : j + n].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
                out ^= out >> np.uint64(31)
        return out

    def hits(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item, word of the text and word of the item of every seed that the text holds."""
        n = max(0, len(numbers) - GRAM + 1)
        ok = np.ones(n, bool)
        for j in range(GRAM):
            ok &= numbers[j : j + n] >= 0
        place = np.flatnonzero(ok)
        key = self.grams(numbers)[place]
        low, high = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        many = high - low
        seed = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
        return self.which[seed], np.repeat(place, many), self.at[seed]

    def best(self, k: int, numbers: np.ndarray, spans: list[tuple[int, int]]) -> tuple[float, int] | None:
        """The best share of a perfect score among the passages that contaminate, and which it is; ends at a perfect one."""
        item, found = self.items[k], None
        order = sorted(range(len(spans)), key=lambda j: (spans[j][1] - spans[j][0], j))  # like lengths together
        at = 0
        while at < len(order) and (found is None or found[0] < 1):
            end, wide = at + 1, spans[order[at]][1] - spans[order[at]][0]
            while end < len(order) and (end - at + 1) * max(wide, spans[order[end]][1] - spans[order[end]][0]) <= CELLS:
                wide = max(wide, spans[order[end]][1] - spans[order[end]][0])
                end += 1
            passages = [numbers[x:y] for x, y in (spans[j] for j in order[at:end])]
            scores = align(item, passages) / (MATCH * len(item))
            enough = scores >= THRESHOLD
            # a strict score of PASSAGE needs a loose one of MATCH * PASSAGE
            left = np.flatnonzero(~enough & (scores * len(item) >= PASSAGE - 0.5))
            enough[left] = align(item, [passages[j] for j in left.tolist()], 1, -STRICT, -STRICT) >= PASSAGE
            for j in np.flatnonzero(enough).tolist():
                if found is None or (float(scores[j]), -order[at + j]) > (found[0], -found[1]):
                    found = float(scores[j]), order[at + j]
            at = end
        return found

    def matches(self, text: bytes | None) -> list[tuple[int, float, int, int]]:
        """Items that a text holds a passage of: number, share of a perfect score, first and last word."""
        own = words(text)
        if not own:
            return []
        out = [(k, 1.0, 0, len(own) - 1) for k in self.whole.get(tuple(own), ())] if len(own) < LEAST_WORDS else []
        get = self.number.get
        numbers = np.fromiter((get(w, -1) for w in own), np.int64, len(own))
        item, place, inner = self.hits(numbers)
        if not len(item):
            return out
        by = np.lexsort((place - inner, item))
        item, start = item[by], (place - inner)[by]
        edges = np.flatnonzero(np.diff(item, prepend=-1)).tolist()
        for x, y in zip(edges, [*edges[1:], len(item)], strict=True):
            k = int(item[x])
            size = len(self.items[k])
            slack = size // 2 + 3
            spans = []
            for g in np.split(start[x:y], np.flatnonzero(np.diff(start[x:y]) > slack) + 1):
                first, last = max(0, int(g[0]) - slack), min(len(numbers), int(g[-1]) + size + slack)
                # no alignment spans more words than its matches pay for
                reach = size + MATCH * size // -GAP
                spans += [(p, min(last, p + 2 * reach)) for p in range(first, max(first + 1, last - reach), reach)]
            found = self.best(k, numbers, spans)
            if found is not None:
                out.append((k, found[0], spans[found[1]][0], spans[found[1]][1] - 1))
        return out


def word_bits(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, float]:
    """Bits of surprise of each word, by its count over all documents."""
    index = {w: k for k, w in enumerate(sorted(vocabulary))}

    def run(batches):
        total = np.zeros(len(index) + 1, np.int64)
        get, none = index.get, len(index)
        for b in slices(batches, 0):
            for t in b.column(0).to_pylist():
                own = words(t)
                total += np.bincount(np.fromiter((get(w, none) for w in own), np.int64, len(own)), minlength=none + 1) if own else 0
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total), pa.int64()), pa.array(total[total > 0], pa.int64())], names=["k", "n"])

    rows = docs.select(F.col("text").cast("binary")).mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    seen = {r["k"]: r["n"] for r in rows}
    total = sum(seen.values()) + len(index) + 1
    return {w: math.log2(total / (seen.get(k, 0) + 1)) for w, k in index.items()}


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, first_word, last_word), one row for each document and item that match."""
    return matched(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")), items)


def matched(plain: DataFrame, items: DataFrame) -> DataFrame:
    """The same for plain, which has text in binary beside doc_id, a name of its rows, long or string."""
    spark = plain.sparkSession
    kind = plain.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, score double, first_word int, last_word int"
    named = pa.string() if kind == "string" else pa.int64()
    shape = pa.schema([("doc_id", named), ("item_id", pa.int64()), ("score", pa.float64()), ("first_word", pa.int32()), ("last_word", pa.int32())])
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).where("text is not null").distinct()

    def blocks():
        """Items, read from the executors a partition at a time, until they have BLOCK_SEEDS words."""
        block: list[tuple[int, list[bytes]]] = []
        size = 0
        for r in rows.toLocalIterator():
            own = words(bytes(r["text"]))
            if own:
                block.append((r["item_id"], own))
                size += len(own)
            if size >= BLOCK_SEEDS:
                yield block
                block, size = [], 0
        if block:
            yield block

    def scan(block):
        seeds = Seeds(block, bits)

        def run(batches):
            for b in slices(batches, 1):
                rows = [(d, seeds.ids[k], s, x, y) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for k, s, x, y in seeds.matches(t)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), shape, strict=True)], schema=shape)

        return plain.mapInArrow(run, schema)

    bits: dict[bytes, float] = {}
    waiting: set[bytes] = set()
    for block in blocks():
        waiting.update(w for _, own in block for w in own if w not in bits)
        if len(waiting) >= BLOCK_WORDS:
            bits |= word_bits(plain, waiting)
            waiting = set()
    if waiting:
        bits |= word_bits(plain, waiting)
    found = None
    for block in blocks():
        part = scan(block)
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], schema)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "first_word", "last_word")).alias("b"))
    return best.select("doc_id", "item_id", "b.score", "b.first_word", "b.last_word")


def op5_query(docs: DataFrame, items: DataFrame) -> DataFrame:
    return contaminated(docs, items)


def stage(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents that hold no passage of a test item stay; each row goes or stays by its own doc_id and text, null ids too."""
    named = docs.withColumn("_row_key", row_key(F.col("doc_id"), F.col("text")))
    bad = matched(named.select(F.col("_row_key").alias("doc_id"), F.col("text").cast("binary").alias("text")), items).select(F.col("doc_id").alias("_row_key")).distinct()
    return named.join(small(materialise(bad, "contaminated")), "_row_key", "left_anti").select(*docs.columns)
