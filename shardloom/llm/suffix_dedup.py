"""Removal of byte strings that an earlier document holds, by a distributed merge sort of suffixes.

Of every `LENGTH`-byte string that two documents share, at least one suffix is compared: those at anchors, the
positions whose `SEED`-byte string has the smallest hash of any window of `LENGTH` bytes around it.  Anchors follow from
the bytes alone, so equal strings have the same ones, and the sort sees one suffix in fourteen.

1. Documents are packed into chunks (compressed, with their anchors) in a table.
2. Hashes of the anchors' seed strings, a few bytes each, go to buckets; what comes back to a chunk is one bit for each:
   whether another document has it too.  No other anchor can lie in a shared string.
3. Each chunk sorts the suffixes at its remaining anchors and front-codes them: the length of the prefix that a suffix
   shares with the one before, the rest, and the bytes to its left.  Runs are cut at splitters and exchanged.
4. Each range merges its runs with a loser tree that compares common-prefix lengths first and characters only
   from the known prefix on.  The merge's prefix lengths and the left contexts tell which strings that hold the
   anchor also start in a document with a smaller doc_id.
5. The spans go back to their chunks, where bytes are removed.

Suffixes with the same whole context within a chunk travel once, so a passage that very many documents share is
exchanged once a chunk.

Defined cases: a null text is empty; texts shorter than `LENGTH` lose nothing; rows with one doc_id never remove each
other's bytes, so repeated rows stay unless a smaller id holds their strings; a null doc_id counts as the largest id there can be
(2**63 - 1, and like a row of that id); very long texts are chunks of their own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import forget, materialise, modest_batches, parts, release, scratch_path, slices

LENGTH, SEED = 50, 24
SIDE = LENGTH - SEED
CHUNK = 2 << 20
#: Anchors of a bucket and suffixes of a range, about.
BUCKET_ANCHORS, RANGE_SUFFIXES = 2_000_000, 100_000
#: Sampled suffixes for each splitter between ranges.
SPLIT = 16
LAST_ID = 2**63 - 1


def _pack(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(raw)


def _unpack(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(raw)


# ---------------------------------------------------------------- anchors


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each window of the width; one value a window."""
    now, have = x, 1
    while 2 * have <= width:
        now, have = pick(now[:-have], now[have:]), 2 * have
    return pick(now[: len(now) - (width - have)], now[width - have :]) if have < width else now


_ODD = (np.random.default_rng(9).integers(1, 2**62, 256, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def _ranks(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A rank for each seed string, and the smallest rank in each string of LENGTH bytes (0 where it crosses a text's end)."""
    n = len(data)
    with np.errstate(over="ignore"):
        power, have, now = np.uint64(0x9E3779B97F4A7C15), 1, _ODD[data]
        at8 = None
        while have < 16:
            now = now[:-have] * power + now[have:]
            power, have = power * power, 2 * have
            if have == 8:
                at8, power8 = now, power
        size = n - SEED + 1
        now = now[:size] * power8 + at8[16 : 16 + size]
        now ^= now >> np.uint64(31)
        now *= np.uint64(0xD6E8FEB86659FD93)
        rank = np.maximum((now >> np.uint64(32)).astype(np.uint32), 1)
    low = _slide(rank, SIDE + 1, np.minimum)
    ends = np.cumsum(lengths)
    inside = np.zeros(n + 1, np.int32)
    fits = lengths >= LENGTH
    np.add.at(inside, (ends - lengths)[fits], 1)
    np.add.at(inside, (ends - LENGTH + 1)[fits], -1)
    low[np.cumsum(inside)[: len(low)] == 0] = 0
    return rank, low


def _padded(low: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(SIDE, np.uint32), low, np.zeros(SIDE, np.uint32)])


def anchors(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of the anchors in texts laid end to end."""
    if len(data) < LENGTH:
        return np.zeros(0, np.int64)
    rank, low = _ranks(data, lengths)
    return np.flatnonzero(_slide(_padded(low), SIDE + 1, np.maximum) == rank)


def reach(data: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far the strings whose smallest rank an anchor has go to its left, and beyond its seed string."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rank, low = _ranks(data, lengths)
    mine = np.lib.stride_tricks.sliding_window_view(_padded(low), SIDE + 1)[at] == rank[at][:, None]  # strings from SIDE bytes before on
    return SIDE - mine.argmax(axis=1), SIDE - mine[:, ::-1].argmax(axis=1)


def seed_hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit hashes of the seed strings at the positions."""
    if not len(at):
        return np.zeros(0, np.uint64)
    three = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, SEED)[at]).view(np.uint64)
    with np.errstate(over="ignore"):
        x = np.full(len(at), 0x51ED270B, np.uint64)
        for k in range(SEED // 8):
            x = (x ^ three[:, k]) * np.uint64(0xFF51AFD7ED558CCD)
            x ^= x >> np.uint64(32)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(29))


class Chunk:
    """Some documents: their ids, lengths, bytes end to end, and anchors."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, data: np.ndarray, at: np.ndarray):
        self.ids, self.lengths, self.data, self.at = ids, lengths, data, at
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths

    def row(self, nulls: list[bool]) -> dict:
        gaps = np.diff(self.at, prepend=0).astype("<u4").tobytes()
        few = self.at[:: max(1, len(self.at) // 64)]
        return {
            "n_anchors": len(self.at),
            "ids": self.ids.astype("<i8").tobytes(),
            "nulls": np.packbits(nulls).tobytes(),
            "lengths": self.lengths.astype("<i8").tobytes(),
            "anchors": _pack(gaps),
            "blob": _pack(self.data.tobytes()),
            "sample": [self.data[p : p + LENGTH].tobytes() for p in few.tolist()],
        }

    @classmethod
    def of(cls, ids: bytes, lengths: bytes, anchors_: bytes, blob: bytes) -> Chunk:
        return cls(np.frombuffer(ids, "<i8"), np.frombuffer(lengths, "<i8"), np.frombuffer(_unpack(blob), np.uint8), np.cumsum(np.frombuffer(_unpack(anchors_), "<u4").astype(np.int64)))


CHUNKS = "chunk long, n_anchors long, ids binary, nulls binary, lengths binary, anchors binary, blob binary, sample array<binary>"


def chunks(docs: DataFrame) -> DataFrame:

    def run(batches):
        from pyspark import TaskContext

        part, seq, held = TaskContext.get().partitionId(), 0, 0
        ids: list[int | None] = []
        texts: list[bytes] = []

        def flush():
            data, lengths = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts], np.int64)
            row = Chunk(np.array([LAST_ID if d is None else d for d in ids], np.int64), lengths, data, anchors(data, lengths)).row([d is None for d in ids])
            return pa.RecordBatch.from_pylist([{"chunk": (part << 32) | seq, **row}], schema=shape)

        shape = pa.schema([("chunk", pa.int64()), ("n_anchors", pa.int64()), *((c, pa.binary()) for c in ("ids", "nulls", "lengths", "anchors", "blob")), ("sample", pa.list_(pa.binary()))])
        for b in slices(batches, 1):
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(d)
                texts.append(t or b"")
                held += len(texts[-1])
                if held >= CHUNK:
                    yield flush()
                    ids, texts, held, seq = [], [], 0, seq + 1
        if ids:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, CHUNKS)


# ---------------------------------------------------------------- which anchors are shared


def _deal(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket, and the 31 bits that name a hash within it."""
    return (hashes >> np.uint64(64 - bits)).astype(np.int64), ((hashes >> np.uint64(33 - bits)) & np.uint64(0x7FFFFFFF)).astype(np.uint32)


def _names(chunk: Chunk, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The chunk's different names in order (bucket << 31 | name), whether two of its documents hold one, and each anchor's name."""
    bucket, name = _deal(seed_hashes(chunk.data, chunk.at), bits)
    full = (bucket << 31) | name.astype(np.int64)
    unique, inverse = np.unique(full, return_inverse=True)
    doc = np.searchsorted(chunk.ends, chunk.at, side="right")
    first, last = np.full(len(unique), len(chunk.ids), np.int64), np.full(len(unique), -1, np.int64)
    np.minimum.at(first, inverse, doc)
    np.maximum.at(last, inverse, doc)
    return unique, first != last, inverse, doc


def shared_anchors(base: DataFrame, bits: int) -> DataFrame:
    """(chunk, bucket, n, bits): for the chunk's names in a bucket, in order, whether another document holds each."""

    def send(batches):
        shape = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("names", pa.binary())])
        for b in slices(batches, 4, 1):  # a chunk at a time
            for r in b.to_pylist():
                chunk = Chunk.of(r["ids"], r["lengths"], r["anchors"], r["blob"])
                unique, many, _, _ = _names(chunk, bits)
                if not len(unique):
                    continue
                bucket = unique >> 31
                raw = (((unique & 0x7FFFFFFF) << 1) | many).astype("<u4")
                cut = np.flatnonzero(np.diff(bucket, prepend=-1))
                pieces = [p.tobytes() for p in np.split(raw, cut[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cut], pa.int32()), pa.array([r["chunk"]] * len(cut), pa.int64()), pa.array(pieces, pa.binary())], schema=shape)

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        lists = [np.frombuffer(x, "<u4") for x in pdf["names"]]
        flat = np.concatenate(lists)
        _, inverse, count = np.unique(flat >> 1, return_inverse=True, return_counts=True)
        alive = (count[inverse] > 1) | (flat & 1).astype(bool)
        np.logical_or.at(some := np.zeros(len(count), bool), inverse, alive)
        out, at = [], 0
        for x in lists:
            own = some[inverse[at : at + len(x)]]
            out.append((int(own.sum()), np.packbits(own).tobytes()))
            at += len(x)
        return pd.DataFrame({"chunk": pdf["chunk"], "bucket": pdf["bucket"], "alive": [a for a, _ in out], "n": [len(x) for x in lists], "bits": [b for _, b in out]})

    sent = base.select("chunk", "ids", "lengths", "anchors", "blob").mapInArrow(send, "bucket int, chunk long, names binary")
    return sent.groupBy("bucket").applyInPandas(judge, "chunk long, bucket int, alive long, n long, bits binary")


# ---------------------------------------------------------------- front-coded runs


def front_code(rows: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Sorted strings of one length, [n, length]: common prefix with the one before, and the rest of each."""
    n, width = rows.shape
    same = np.zeros((n, width), bool)
    same[1:] = rows[1:] == rows[:-1]
    common = np.where(same.all(axis=1), width, same.argmin(axis=1)).astype(np.uint8)
    return common, rows[np.arange(width) >= common[:, None]].tobytes()


def front_decode(common: np.ndarray, rest: bytes, width: int) -> np.ndarray:
    """The strings of a front-coded run."""
    n = len(common)
    mine = np.arange(width) >= common[:, None]
    rows = np.zeros((n, width), np.uint8)
    rows[mine] = np.frombuffer(rest, np.uint8)
    # each byte stands in the last row above that holds its column itself
    source = np.maximum.accumulate(np.where(mine, np.arange(n)[:, None], 0), axis=0)
    return rows[source, np.arange(width)]


class Run:
    """Sorted suffixes with what stands to their left, and where they are; an id is kept as its distance from doc."""

    FIELDS = (("left", np.uint8, SIDE), ("n_left", np.uint8, 1), ("n_right", np.uint8, 1), ("shift", np.int64, 1), ("doc", np.uint32, 1), ("pos", np.uint32, 1))

    def __init__(self, rows: np.ndarray, common: np.ndarray, **fields: np.ndarray):
        self.rows, self.common = rows, common
        self.__dict__.update(fields)

    @classmethod
    def dump(cls, rows: np.ndarray, fields: dict[str, np.ndarray]) -> bytes:
        common, rest = front_code(rows)
        body = struct.pack("<II", len(rows), len(rest)) + common.tobytes() + rest
        return _pack(body + b"".join(np.ascontiguousarray(fields[name].astype(kind)).tobytes() for name, kind, _ in cls.FIELDS))

    @classmethod
    def load(cls, raw: bytes) -> Run:
        raw = _unpack(raw)
        n, size = struct.unpack_from("<II", raw)
        common, at = np.frombuffer(raw, np.uint8, n, 8), 8 + n
        rows, at, fields = front_decode(common, raw[at : at + size], LENGTH), at + size, {}
        for name, kind, width in cls.FIELDS:
            fields[name] = np.frombuffer(raw, kind, n * width, at).reshape((n, width) if width > 1 else n)
            at += n * width * np.dtype(kind).itemsize
        run = cls(rows, common, **fields)
        run.ids = run.shift + run.doc
        return run


def suffix_run(chunk: Chunk, alive: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray]:
    """Sorted suffixes at the anchors that are alive, their fields, and spans (doc, start, end) already known to go."""
    at = chunk.at[alive]
    doc = np.searchsorted(chunk.ends, at, side="right")
    padded = np.concatenate([np.zeros(SIDE, np.uint8), chunk.data, np.zeros(LENGTH, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, SIDE + LENGTH)[at]
    n_left, n_right = reach(chunk.data, chunk.lengths, at)
    left = np.where(np.arange(SIDE) < n_left[:, None], view[:, :SIDE][:, ::-1], 0).astype(np.uint8)
    rows = np.where(np.arange(LENGTH) < (n_right + SEED)[:, None], view[:, SIDE:], 0).astype(np.uint8)
    whole = np.ascontiguousarray(np.concatenate([rows, left, n_left[:, None].astype(np.uint8), n_right[:, None].astype(np.uint8)], axis=1))
    ids, pos = chunk.ids[doc], at - chunk.starts[doc]
    order = _order(whole, ids)
    whole, rows, left, ids, pos, doc, n_left, n_right = whole[order], rows[order], left[order], ids[order], pos[order], doc[order], n_left[order], n_right[order]
    # the same context in an earlier document of the chunk: every string around the anchor goes
    fresh = np.ones(len(whole), bool)
    fresh[1:] = (whole[1:] != whole[:-1]).any(axis=1)
    lowest = ids[np.flatnonzero(fresh)][np.cumsum(fresh) - 1] if len(ids) else ids
    known = ids > lowest
    gone = known & (n_left + n_right >= SIDE)
    spans = np.stack([doc[gone], (pos - n_left)[gone], (pos + SEED + n_right)[gone]], axis=1)
    keep = ~known
    fields = {"left": left[keep], "n_left": n_left[keep], "n_right": n_right[keep], "shift": ids[keep] - doc[keep], "doc": doc[keep], "pos": pos[keep]}
    return rows[keep], fields, spans


def _order(whole: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Order by the bytes, then by the ids."""
    width = -(-whole.shape[1] // 8) * 8
    wide = np.zeros((len(whole), width), np.uint8)
    wide[:, : whole.shape[1]] = whole
    numbers = wide.view(">u8").astype(np.uint64)
    return np.lexsort((ids, *numbers.T[::-1]))


# ---------------------------------------------------------------- the merge


def merge(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int]]:
    """Loser-tree merge of sorted runs (strings, common prefix with the one before).

    Gives the run of each string in merged order, and the common prefix of each with the one before.  A node keeps its
    loser with the prefix that it shares with the winner that passed: who shares more with the last output is smaller,
    and only on a tie are characters compared, from that prefix on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    heads: list[bytes] = [r[0][0] if r[0] else b"" for r in runs] + [b""] * (k - len(runs))
    share = [0 if r[0] else -1 for r in runs] + [-1] * (k - len(runs))  # -1: used up
    place = [0] * k
    loser = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """winner, loser; the loser's share becomes what it has in common with the winner."""
        ha, hb = share[a], share[b]
        if ha != hb:
            return (a, b) if ha > hb else (b, a)
        if ha < 0:
            return a, b
        x, y = heads[a], heads[b]
        n = len(x)
        while ha < n and x[ha : ha + 8] == y[ha : ha + 8]:
            ha += 8
        ha = min(ha, n)
        while ha < n and x[ha] == y[ha]:
            ha += 1
        if ha == n or x[ha] < y[ha]:
            share[b] = ha
            return a, b
        share[a] = ha
        return b, a

    def build(node: int) -> int:
        if node >= k:
            return node - k
        win, lose = play(build(2 * node), build(2 * node + 1))
        loser[node] = lose
        return win

    winner = build(1) if k > 1 else 0
    order: list[int] = []
    common: list[int] = []
    while share[winner] >= 0:
        order.append(winner)
        common.append(share[winner])
        strings, prefix = runs[winner]
        at = place[winner] = place[winner] + 1
        if at < len(strings):
            heads[winner], share[winner] = strings[at], prefix[at]
        else:
            share[winner] = -1
        node = (winner + k) >> 1
        while node:
            winner, loser[node] = play(winner, loser[node])
            node >>= 1
    return order, common


def judge_range(runs: list[Run], owners: list[int]) -> list[tuple[int, bytes]]:
    """Per chunk, the spans (doc, start, end) that a smaller doc_id holds too."""
    order, common = merge([([x.tobytes() for x in r.rows], r.common.tolist()) for r in runs])
    order, common = np.array(order, np.int64), np.array(common, np.int64)
    size = np.array([len(r.rows) for r in runs])
    nth = np.empty(len(order), np.int64)
    by_run = np.argsort(order, kind="stable")
    nth[by_run] = np.arange(len(order)) - np.repeat(np.cumsum(size) - size, size)
    flat = (np.cumsum(size) - size)[order] + nth
    take = {name: np.concatenate([getattr(r, name) for r in runs])[flat] for name in ("left", "n_left", "n_right", "ids", "doc", "pos")}
    # strings that share their seed only with their own document are out
    fresh = common < SEED
    group = np.cumsum(fresh) - 1
    start = np.flatnonzero(fresh)
    low, high = np.minimum.reduceat(take["ids"], start), np.maximum.reduceat(take["ids"], start)
    busy = (low != high)[group]
    cover = np.zeros((int(busy.sum()), SIDE + 2), np.int8)
    if not len(cover):
        return []
    take = {k: v[busy] for k, v in take.items()}
    n = len(cover)
    left_hash = np.zeros(n, np.uint64)
    for j in range(SIDE + 1):  # strings that begin j bytes before the anchor
        with np.errstate(over="ignore"):
            if j:
                left_hash = (left_hash + take["left"][:, j - 1].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
                left_hash ^= left_hash >> np.uint64(29)
            kind = np.cumsum(common < LENGTH - j)[busy].astype(np.uint64)
            key = (left_hash ^ kind * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xC4CEB9FE1A85EC53)
            key ^= key >> np.uint64(32)
        ok = np.flatnonzero((take["n_left"] >= j) & (take["n_right"] >= SIDE - j))
        if not len(ok):
            continue
        by = ok[np.argsort(key[ok], kind="stable")]
        same = key[by]
        first = np.flatnonzero(np.concatenate(([True], same[1:] != same[:-1])))
        least = np.repeat(np.minimum.reduceat(take["ids"][by], first), np.diff(np.append(first, len(by))))
        cover[by, j + 1] = take["ids"][by] > least
    # runs of strings in a row: from the anchor's side to the far side
    step = np.diff(np.concatenate([cover[:, 1:], np.zeros((n, 1), np.int8)], axis=1), prepend=0, axis=1)
    item, near = np.nonzero(step == 1)
    _, far = np.nonzero(step == -1)
    pos = take["pos"].astype(np.int64)[item]
    spans = np.stack([take["doc"].astype(np.int64)[item], pos - (far - 1), pos - near + LENGTH], axis=1).astype("<u4")
    chunk_of = np.array(owners)[order[busy]][item]
    out = []
    for c in np.unique(chunk_of).tolist():
        out.append((c, _pack(spans[chunk_of == c].tobytes())))
    return out


# ---------------------------------------------------------------- the operator


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): every text without the strings that a smaller doc_id holds."""
    spark = docs.sparkSession
    base = materialise(chunks(docs), "chunks")
    plan = base.agg(F.sum("n_anchors").alias("n"), F.count("*").alias("c")).first()
    kept = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    if not plan["c"]:
        return spark.createDataFrame([], kept)
    bits = max(4, int(np.ceil(np.log2(max(4 * parts(spark), (plan["n"] or 1) / BUCKET_ANCHORS)))))
    alive_path = scratch_path(spark, "shared-anchors")
    with modest_batches(spark):
        shared_anchors(base, bits).where("alive > 0").write.parquet(alive_path)
    release(spark)
    alive = spark.read.parquet(alive_path)
    n_alive = alive.agg(F.sum("alive")).first()[0] or 0
    n_ranges = int(max(2 * parts(spark), n_alive // RANGE_SUFFIXES))
    # whole suffixes from a share of the sampled anchors, some for each range: a common beginning doesn't make a range crowded
    total = base.agg(F.sum(F.size("sample"))).first()[0] or 1
    drawn = base.select("chunk", F.posexplode("sample").alias("k", "p")).where(F.pmod(F.xxhash64("chunk", "k"), F.lit(total)) < SPLIT * n_ranges)
    draws = sorted(bytes(r["p"]) for r in drawn.select("p").collect())
    splitters = np.unique(np.array([draws[len(draws) * i // n_ranges] for i in range(1, n_ranges)] if draws else [], f"S{LENGTH}"))
    columns = ["chunk", "ids", "lengths", "anchors", "blob"]

    def runs_of(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            r = left.iloc[0]
            chunk = Chunk.of(r["ids"], r["lengths"], r["anchors"], r["blob"])
            unique, _, inverse, _ = _names(chunk, bits)
            some = np.zeros(len(unique), bool)
            edges = np.searchsorted(unique >> 31, np.sort(right["bucket"].to_numpy()))
            for at, (_, x) in zip(edges.tolist(), right.sort_values("bucket").iterrows(), strict=True):
                some[at : at + x["n"]] = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=x["n"]).astype(bool)
            rows, fields, spans = suffix_run(chunk, some[inverse])
            if len(spans):
                out.append((int(r["chunk"]) % n_ranges, r["chunk"], True, _pack(spans.astype("<u4").tobytes())))
            if len(rows):
                piece = np.searchsorted(splitters, np.ascontiguousarray(rows).view(f"S{LENGTH}").ravel(), side="right")
                edge = np.flatnonzero(np.diff(piece, prepend=-1))
                for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(rows)], strict=True):
                    out.append((int(piece[a]), r["chunk"], False, Run.dump(rows[a:b], {k: v[a:b] for k, v in fields.items()})))
        return pd.DataFrame(out, columns=["range", "chunk", "done", "payload"]).astype({"range": "int32", "chunk": "int64", "done": bool})

    both = base.select(*columns).groupBy("chunk").cogroup(alive.groupBy("chunk")).applyInPandas(runs_of, "range int, chunk long, done boolean, payload binary")

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[~pdf["done"]]
        found = judge_range([Run.load(x) for x in own["payload"]], own["chunk"].tolist()) if len(own) else []
        return pd.concat([pdf.loc[pdf["done"], ["chunk", "payload"]], pd.DataFrame(found, columns=["chunk", "payload"]).astype({"chunk": "int64"})], ignore_index=True)

    dealt = both.repartition(n_ranges, "range")
    spans = materialise(dealt.groupBy("range").applyInPandas(merged, "chunk long, payload binary"), "suffix-spans")
    del both, dealt, alive
    forget(spark, alive_path)
    release(spark)

    def cleaned(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, r in left.iterrows():
            chunk = Chunk.of(r["ids"], r["lengths"], r["anchors"], r["blob"])
            s = np.frombuffer(b"".join(map(_unpack, right["payload"])), "<u4").reshape(-1, 3).astype(np.int64)
            size = len(chunk.data) + 1
            change = np.bincount(chunk.starts[s[:, 0]] + s[:, 1], minlength=size) - np.bincount(chunk.starts[s[:, 0]] + s[:, 2], minlength=size)
            gone = np.cumsum(change)[:-1] > 0
            rise = gone.copy()
            rise[1:] &= ~gone[:-1]
            full = chunk.starts[chunk.lengths > 0]
            rise[full] = gone[full]
            removed, begun = np.concatenate(([0], np.cumsum(gone))), np.concatenate(([0], np.cumsum(rise)))
            null = np.unpackbits(np.frombuffer(r["nulls"], np.uint8), count=len(chunk.ids)).astype(bool).tolist()
            for d, z, a, b in zip(chunk.ids.tolist(), null, chunk.starts.tolist(), chunk.ends.tolist(), strict=True):
                out.append((None if z else d, b - a, int(removed[b] - removed[a]), int(begun[b] - begun[a]), chunk.data[a:b][~gone[a:b]].tobytes()))
        return pd.DataFrame({c: pd.Series([x[k] for x in out], dtype="Int64" if k < 4 else object) for k, c in enumerate(("doc_id", "n_bytes", "n_removed", "n_spans", "kept"))})

    return base.select(*columns, "nulls").groupBy("chunk").cogroup(spans.groupBy("chunk")).applyInPandas(cleaned, kept)


def op6_query(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Every window of every text, as hexadecimal digits; for small tables.
ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS k, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, k, p, md5(substr(h, CAST(2 * p + 1 AS BIGINT), 100)) AS s FROM (SELECT r, k, h, unnest(range(0, length(h) // 2 - 49)) AS p FROM d)),
low AS (SELECT s, min(k) AS low FROM w GROUP BY s HAVING min(k) <> max(k)),
g AS (SELECT r, p FROM w JOIN low USING (s) WHERE low < k),
e AS (SELECT r, p, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + 50 THEN 0 ELSE 1 END AS b FROM g),
i AS (SELECT r, p, sum(b) OVER (PARTITION BY r ORDER BY p) AS n FROM e),
s AS (SELECT r, n, min(p) AS a, max(p) + 50 AS z FROM i GROUP BY r, n),
x AS (SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS o FROM s),
t AS (SELECT r, count(*) AS n_spans, sum(z - a) AS n_removed, max(z) AS last, string_agg(substr(h, CAST(2 * o + 1 AS BIGINT), CAST(2 * (a - o) AS BIGINT)), '' ORDER BY a) AS head FROM x JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, CAST(2 * coalesce(last, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM d LEFT JOIN t USING (r)
"""
