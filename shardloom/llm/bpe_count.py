"""Token counts by rank-synchronous array merging.

Pre-tokens of a whole batch are held as one ragged array of symbol ids.  In each round every sequence
finds the lowest-ranked pair it holds and replaces all its occurrences at once; a merged symbol's own
merges always rank below it in the merge list's order, so this gives what merging one pair at a time
gives.  Finished sequences leave the array.  Only pairs next to a merge are looked up again.

Texts are cut at single blanks first: a pre-token never crosses a blank with a non-blank on either side, so the
count of a blank-delimited chunk depends on the chunk alone and is remembered (a bounded memory per
worker).  Texts with irregular blanks are cut by the pattern as a whole.

Defined cases: null counts as empty, with 0 bytes and 0 tokens; the text of an added special token counts as
that one token, as is the library's default; a very long text is counted whole, in a slice of its own; repeated rows give
repeated results; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import slices

#: Remembered chunks per worker.
MEMORY = 1_000_000
NONE = np.int32(2**31 - 1)
IRREGULAR = -(10**15)


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class MergeTable:
    """Ranks of symbol pairs in arrays that are probed for many pairs at once."""

    def __init__(self, path: str, pattern: str):
        import regex

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        vocab = model["vocab"]
        self.size = max(vocab.values()) + 1
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        letters = byte_alphabet()
        self.first = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        pairs = [(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        self.product = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.bits = int(np.ceil(np.log2(len(keys) * 4)))
        self.slot_key = np.full(1 << self.bits, -1, np.int64)
        self.slot_rank = np.full(1 << self.bits, NONE, np.int32)
        mask = (1 << self.bits) - 1
        for rank, (key, at) in enumerate(zip(keys.tolist(), self._home(keys).tolist(), strict=True)):
            while self.slot_key[at] >= 0:
                at = (at + 1) & mask
            self.slot_key[at], self.slot_rank[at] = key, rank
        self.pattern = regex.compile(pattern)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where there is no merge."""
        keys = left.astype(np.int64) * self.size + right
        at = self._home(keys)
        out = np.full(len(keys), NONE, np.int32)
        todo = np.arange(len(keys))
        mask = (1 << self.bits) - 1
        while len(todo):
            found = self.slot_key[at]
            hit = found == keys[todo]
            out[todo[hit]] = self.slot_rank[at[hit]]
            go = ~hit & (found >= 0)
            todo, at = todo[go], (at[go] + 1) & mask
        return out

    def survivors(self, pieces: list[bytes]) -> np.ndarray:
        """How many symbols each pre-token ends with."""
        counts = np.zeros(len(pieces), np.int64)
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        counts[lens == 1] = 1
        seq = np.flatnonzero(lens > 1)
        if not len(seq):
            return counts
        sym = self.first[np.frombuffer(b"".join([pieces[i] for i in seq.tolist()]), np.uint8)]
        lens = lens[seq]
        start = np.concatenate(([0], np.cumsum(lens)[:-1]))
        rank = np.full(len(sym), NONE, np.int32)
        rank[:-1] = self.ranks(sym[:-1], sym[1:])
        rank[start + lens - 1] = NONE
        while len(seq):
            low = np.minimum.reduceat(rank, start)
            done = low == NONE
            if done.any():
                counts[seq[done]] = lens[done]
                stay = np.repeat(~done, lens)
                sym, rank = sym[stay], rank[stay]
                seq, lens, low = seq[~done], lens[~done], low[~done]
                if not len(seq):
                    break
                start = np.concatenate(([0], np.cumsum(lens)[:-1]))
            at = np.flatnonzero(rank == np.repeat(low, lens))
            if len(at) > 1 and (np.diff(at) == 1).any():  # the same symbol in a row: every other pair, from the left
                fresh = np.concatenate(([True], np.diff(at) != 1))
                head = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - head) % 2 == 0]
            sym[at] = self.product[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            stale = np.zeros(len(sym), bool)
            stale[at] = True
            stale[np.maximum(at - 1, 0)] = True  # the symbol before, whether or not it stays
            gone = at[1:][at[1:] - 2 == at[:-1]]  # where that symbol was merged away, the one before it
            stale[gone - 2] = True
            lens = lens - np.add.reduceat(~keep, start, dtype=np.int64)
            sym, rank, stale = sym[keep], rank[keep], stale[keep]
            start = np.concatenate(([0], np.cumsum(lens)[:-1]))
            last = start + lens - 1
            stale[last] = False
            rank[last] = NONE
            again = np.flatnonzero(stale)
            rank[again] = self.ranks(sym[again], sym[again + 1])
        return counts


class Counter:
    """Counts tokens of texts, remembering chunks."""

    def __init__(self, path: str, pattern: str):
        self.table = MergeTable(path, pattern)
        self.after_blank: dict[str, int] = {}
        self.at_start: dict[str, int] = {}

    def _whole(self, texts: list[str]) -> list[int]:
        """Counts by the pattern alone, without a memory."""
        cut = [self.table.pattern.findall(t) for t in texts]
        flat = [p for c in cut for p in c]
        if not flat:
            return [0] * len(texts)
        names = list(dict.fromkeys(flat))
        by = dict(zip(names, self.table.survivors([n.encode() for n in names]).tolist(), strict=True))
        return [sum(map(by.__getitem__, c)) for c in cut]

    def _learn(self, memory: dict[str, int], chunks: set[str], before: str) -> None:
        new = [c for c in chunks if c not in memory]
        odd = [c for c in new if not c or c[0].isspace() or c[-1].isspace()]
        memory.update(dict.fromkeys(odd, IRREGULAR))
        bad = set(odd)
        fine = [c for c in new if c not in bad]
        for at in range(0, len(fine), 50_000):
            part = fine[at : at + 50_000]
            memory.update(zip(part, self._whole([before + c for c in part]), strict=True))

    def _plain(self, texts: list[str]) -> list[int]:
        cut = [t.split(" ") for t in texts]
        if len(self.after_blank) > MEMORY:
            self.after_blank.clear()
        if len(self.at_start) > MEMORY:
            self.at_start.clear()
        self._learn(self.at_start, {c[0] for c in cut}, "")
        self._learn(self.after_blank, set().union(*(c[1:] for c in cut)), " ")
        get = self.after_blank.__getitem__
        out = []
        for t, c in zip(texts, cut, strict=True):
            n = self.at_start[c[0]] + sum(map(get, c[1:]))
            out.append(n if n >= 0 else self._whole([t])[0] if t else 0)
        return out

    def count(self, texts: list[str]) -> list[int]:
        special = self.table.special
        marked = [i for i, t in enumerate(texts) if any(s in t for s in special)]
        out = self._plain(["" if i in set(marked) else t for i, t in enumerate(texts)] if marked else texts)
        for i in marked:
            rest, extra = [texts[i]], 0
            for s in special:
                extra += sum(r.count(s) for r in rest)
                rest = [x for r in rest for x in r.split(s)]
            out[i] = extra + sum(self._plain(rest))
        return out


@lru_cache(maxsize=2)
def counter(path: str, pattern: str) -> Counter:
    return Counter(path, pattern)


def count_tokens(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every text."""

    def run(batches):
        own = counter(path, pattern)
        for b in slices(batches, 1):
            counts = own.count([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    plain = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return plain.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")


def op7_query(docs: DataFrame, limit: int = 1024) -> DataFrame:
    import public_tokenizers

    out = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
