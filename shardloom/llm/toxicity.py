"""Toxicity by maximum-scoring segments of token log-odds.

Token scores are log-odds ratios between toxic and other labelled texts with a Dirichlet prior (a half count a
token plus the corpus's own frequencies).  A token is a word, or its first or last few letters, which stand for a stem
or an ending; a word scores as its best token.  Only tokens whose ratio is significant score above zero, all other
words score a small drift below it.  One linear scan of a text finds all its maximal scoring segments, the
passages.  Passage scores are calibrated by extreme-value statistics: lambda solves the scores' moment equation over
harmless text, K is fitted to the best segments of harmless texts, and a passage's p-value is that of
finding one as good in a harmless text of that length.  A text's score is logistic in the p-values of its best
passage and of all its passages.

Training sees a bounded sample of labelled rows (`SAMPLE`), on the driver; the model is a small dictionary.

Defined cases: null and empty texts have no passage and get the score of such texts; with no usable label of either
kind every text scores 0; a doc_id with several labels counts as toxic if one of them says so, and one with several texts is
learnt from the first of them in byte order; null labels don't count; very long texts are scanned whole; repeated rows give
repeated results; other columns are never read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import crc_fold, slices

#: Labelled documents that training sees at most, and the bytes of the longest text among them.
SAMPLE, SAMPLE_BYTES = 6000, 64 << 10
#: Strength of the corpus part of the prior, in tokens; and the z-values a word and a part of one must reach.
PRIOR, SIGNIFICANT, SIGNIFICANT_PART = 200.0, 3.2, 4.5
#: Lengths in bytes of the parts of words.
PARTS = (4, 5, 6)
#: Words whose scores a worker remembers.
MEMORY = 500_000
#: Score of every word without a significant token, and the least score of one with.
DRIFT, LEAST = -0.1, 1.0
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Words of a text: ASCII letters lower-cased, other ASCII than letters and digits as blanks."""
    return (text or b"").translate(_FOLD).split()


def tokens_of(word: bytes) -> list[bytes]:
    """A word, and its first and last letters (marked by what they lack)."""
    return [word, *(word[:n] + b"-" for n in PARTS if len(word) > n), *(b"-" + word[-n:] for n in PARTS if len(word) > n)]


#: Toxic texts that must hold a token before it is looked at; fewer can't make it significant.
SUPPORT = 4


def log_odds(toxic: Counter, other: Counter, prior: float = PRIOR) -> dict[bytes, tuple[float, float]]:
    """Counts of words to (log-odds ratio, z-value) of their tokens."""
    held: Counter = Counter()
    for w, n in toxic.items():
        for t in tokens_of(w):
            held[t] += n
    n1, n0 = sum(held.values()), 0
    seen = {t: [n, 0] for t, n in held.items() if n >= SUPPORT}
    del held
    for w, n in other.items():
        own = tokens_of(w)
        n0 += n * len(own)
        for t in own:
            if t in seen:
                seen[t][1] += n
    out = {}
    for t, (y1, y0) in seen.items():
        a = 0.5 + prior * (y1 + y0) / (n1 + n0)
        delta = math.log((y1 + a) / (n1 + prior - y1)) - math.log((y0 + a) / (n0 + prior - y0))
        out[t] = delta, delta / math.sqrt(1 / (y1 + a) + 1 / (y0 + a))
    return out


def segments(places: list[int], gains: list[float], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments, in linear time: (first word, last word, score).

    places and gains are the words that score above zero; each word between them scores drift.
    """
    kept: list[tuple[int, int, float, float, int]] = []  # first, last, sum before, sum after, nearest earlier with a smaller sum before
    total, last = 0.0, -1
    for at, gain in zip(places, gains, strict=True):
        before = total + drift * (at - last - 1)
        total, last = before + gain, at
        first, low = at, before
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= low:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= total:
                kept.append((first, at, low, total, j))
                break
            first, low = kept[j][0], kept[j][2]
            del kept[j:]
    return [(a, b, after - before) for a, b, before, after, _ in kept]


@dataclass
class Model:
    gains: dict[bytes, float] = field(default_factory=dict)
    decay: float = 1.0
    scale: float = 1.0
    weights: tuple[float, float, float] = (-30.0, 0.0, 0.0)
    known: dict[bytes, float] = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def gain(self, word: bytes) -> float:
        """A word's score: its best token's, or 0 where none is significant."""
        best = max((self.gains.get(t, 0.0) for t in tokens_of(word)), default=0.0)
        self.known[word] = best
        return best

    def passages(self, text: bytes | None) -> tuple[int, list[tuple[int, int, float, float]]]:
        """Words of the text, and its passages: first word, last word, score, p-value."""
        own = words(text)
        if not self.gains:
            return len(own), []
        known, distinct = self.known, set(own)
        if len(known) + len(distinct) > MEMORY:
            known.clear()
        for w in distinct:
            if w not in known:
                self.gain(w)
        each = list(map(known.__getitem__, own))
        places = [k for k, g in enumerate(each) if g]
        found = segments(places, [each[k] for k in places])
        return len(own), [(a, b, s, self.p_value(s, len(own))) for a, b, s in found]

    def p_value(self, score: float, n: int) -> float:
        return max(1e-12, -math.expm1(-self.scale * max(n, 1) * math.exp(-self.decay * score)))

    def features(self, found: list[tuple[int, int, float, float]]) -> tuple[float, float]:
        """What the calibration sees of a text's passages."""
        each = [-math.log(p) for *_, p in found]
        return max(each, default=0.0), math.log1p(sum(each))

    def score(self, found: list[tuple[int, int, float, float]]) -> float:
        b, w1, w2 = self.weights
        x1, x2 = self.features(found)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, b + w1 * x1 + w2 * x2))))


def train(texts: list[bytes], toxic: list[int]) -> Model:
    """Fit everything on labelled texts."""
    model = Model()
    if not any(toxic) or all(toxic):
        return model
    seen = {0: Counter(), 1: Counter()}
    for t, y in zip(texts, toxic, strict=True):
        seen[y].update(set(words(t)))  # once a text: words come in bursts
    odds = log_odds(seen[1], seen[0])
    model.gains = {t: min(d, 8.0) for t, (d, z) in odds.items() if d > LEAST and z >= (SIGNIFICANT_PART if t[:1] == b"-" or t[-1:] == b"-" else SIGNIFICANT)}
    # lambda: the expected growth of exp(lambda * score) over harmless tokens is 1
    n0 = max(1, sum(seen[0].values()))
    up = [(n, g) for w, n in seen[0].items() if (g := model.gain(w))]
    share = [(n / (n0 + 0.5), g) for n, g in up] or [(0.5 / n0, 1.0)]
    rest = max(0.0, 1 - sum(p for p, _ in share))
    low, high = 1e-6, 30.0
    for _ in range(100):
        mid = (low + high) / 2
        grown = rest * math.exp(mid * DRIFT) + sum(p * math.exp(min(700.0, mid * g)) for p, g in share)
        low, high = (mid, high) if grown < 1 else (low, mid)
    model.decay = low
    best = []
    for t, y in zip(texts, toxic, strict=True):
        if not y:
            n, found = model.passages(t)
            best.append(max(n, 1) * math.exp(-model.decay * max((s for *_, s, _ in found), default=0.0)))
    model.scale = len(best) / max(1e-12, sum(best))
    x = np.array([[1.0, *model.features(model.passages(t)[1])] for t in texts])
    y = np.array(toxic, float)
    w = np.zeros(3)
    for _ in range(40):  # Newton steps of a slightly ridged logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(3)
        w = w + np.clip(np.linalg.solve(hess, x.T @ (y - p) - 1e-3 * w), -5, 5)
    model.weights = tuple(float(v) for v in w)
    return model


def fit(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = SAMPLE) -> Model:
    """A model from at most `sample` labelled rows, chosen by a hash of doc_id."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & usable).groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("_toxic"))
    marks = marks.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample)
    rows = docs.where(F.octet_length("text") <= SAMPLE_BYTES).select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(marks), "doc_id")
    rows = rows.groupBy("doc_id", "_toxic").agg(F.min("text").alias("text")).collect()  # one text an id, however many rows repeat it
    rows.sort(key=lambda r: r["doc_id"])
    return train([bytes(r["text"]) for r in rows], [r["_toxic"] for r in rows])


def score(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """The named columns with score, and passages (first word, last word, score, p-value of each)."""
    plain = docs.select(F.struct(*columns).alias("row"), F.col("text").cast("binary").alias("text"))
    passage = "array<struct<first:int,last:int,score:double,p:double>>"
    schema = plain.select("row", F.lit(0.0).alias("score"), F.lit(None).cast(passage).alias("passages")).schema
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64()), ("p", pa.float64())]))

    def run(batches):
        for b in slices(batches, 1):
            scores, found = [], []
            for t in b.column(1).to_pylist():
                own = model.passages(t)[1]
                scores.append(model.score(own))
                found.append([dict(zip(("first", "last", "score", "p"), x, strict=True)) for x in own])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(found, kind)], names=["row", "score", "passages"])

    return plain.mapInArrow(run, schema).select("row.*", "score", "passages")


def op4_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels, crc_fold(F.col("doc_id"), 5) != 0)
    held = docs.select("doc_id", "text", (crc_fold(F.col("doc_id"), 5) == 0).alias("held_out"))
    out = score(held, model, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
