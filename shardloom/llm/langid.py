"""Language identification by a bidirectional gated recurrent network over bytes.

A text is read as windows of `WINDOW` bytes.  In each window one gated recurrent cell runs forward and one
backward; both states label every position, and a document's probabilities are the mean over all its
positions.  The cells use softsign gates, which keep numpy at a few operations a byte.  Training is plain
backpropagation through time in numpy with Adam, on windows drawn from a bounded sample of labelled
documents, on the driver; the weights (a few thousand numbers) travel in the closure.

Every window begins with a zero state, so a position sees at most `WINDOW` bytes around it.

Defined cases: texts that are null or without a letter are `und` with score 0; where no labelled row can be learnt
from, every text is `und` with score 0; very long texts are read whole, in slices of windows; repeated rows give repeated
results; other columns are never read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import crc_fold, materialise, slices

WINDOW = 64
HIDDEN = 8
#: Labelled documents that training sees at most, and the bytes of the longest text among them.
SAMPLE, SAMPLE_BYTES = 1600, 128 << 10
STEPS, BATCH, RATE = 260, 384, 0.02
#: Below this a document's language is too unsure for the pipeline.
REJECT_BELOW = 0.35


def _soft(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


class Network:
    """Weights of two gated recurrent cells and a linear label for every position."""

    def __init__(self, n_labels: int, hidden: int = HIDDEN, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.h, self.k = hidden, n_labels
        draw = lambda *s, by=1.0: rng.normal(0, by / np.sqrt(s[0]), s).astype(np.float32)
        self.w: dict[str, np.ndarray] = {"out": draw(2 * hidden, n_labels), "bias": np.zeros(n_labels, np.float32)}
        for side in "fb":
            self.w |= {f"in_{side}": rng.normal(0, 0.5, (256, 3 * hidden)).astype(np.float32), f"gate_{side}": draw(hidden, 2 * hidden), f"cand_{side}": draw(hidden, hidden)}

    def run(self, side: str, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """States of one cell, [time, window, hidden]; x is [time, window], read in the side's direction."""
        h, n = self.h, x.shape[1]
        table, gate, cand = self.w[f"in_{side}"], self.w[f"gate_{side}"], self.w[f"cand_{side}"]
        order = range(len(x)) if side == "f" else range(len(x) - 1, -1, -1)
        states = np.empty((len(x), n, h), np.float32)
        state = np.zeros((n, h), np.float32)
        for t in order:
            drive = table.take(x[t], axis=0)
            raw = drive[:, : 2 * h] + state @ gate
            zr = raw / (1 + np.abs(raw))
            zr *= 0.5
            zr += 0.5
            z, r = zr[:, :h], zr[:, h:]
            raw_c = drive[:, 2 * h :] + (r * state) @ cand
            c = raw_c / (1 + np.abs(raw_c))
            if keep is not None:
                keep[t] = (state, raw, z, r, raw_c, c)
            state = state + z * (c - state)
            states[t] = state
        return states

    def position_probabilities(self, x: np.ndarray, keeps: tuple | None = None):
        """Label probabilities of every position, [time, window, label]."""
        forward = self.run("f", x, keeps[0] if keeps else None)
        backward = self.run("b", x, keeps[1] if keeps else None)
        logits = forward @ self.w["out"][: self.h] + backward @ self.w["out"][self.h :] + self.w["bias"]
        logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=2, keepdims=True)
        return logits, forward, backward

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Cross-entropy over all positions that aren't padding, and its gradients through time."""
        keeps: tuple[dict, dict] = ({}, {})
        p, forward, backward = self.position_probabilities(x, keeps)
        total = mask.sum()
        t_, n = x.shape
        rows = np.arange(n)
        loss = float(-(np.log(p[:, rows, y] + 1e-9) * mask).sum() / total)
        d = p.copy()
        d[:, rows, y] -= 1
        d *= (mask / total)[:, :, None]
        h = self.h
        grads = {"out": np.concatenate([np.einsum("tnh,tnk->hk", forward, d), np.einsum("tnh,tnk->hk", backward, d)]), "bias": d.sum(axis=(0, 1))}
        for side, keep, at in (("f", keeps[0], slice(0, h)), ("b", keeps[1], slice(h, None))):
            gate, cand = self.w[f"gate_{side}"], self.w[f"cand_{side}"]
            g_in = np.zeros((256, 3 * h), np.float32)
            g_gate, g_cand = np.zeros_like(gate), np.zeros_like(cand)
            back = np.zeros((n, h), np.float32)
            above = d @ self.w["out"][at].T
            order = range(t_ - 1, -1, -1) if side == "f" else range(t_)
            for t in order:
                state, raw, z, r, raw_c, c = keep[t]
                back = back + above[t]
                d_c = back * z / (1 + np.abs(raw_c)) ** 2
                d_z = back * (c - state)
                rs = d_c @ cand.T
                d_raw = np.concatenate([d_z, rs * state], axis=1) * 0.5 / (1 + np.abs(raw)) ** 2
                g_cand += (r * state).T @ d_c
                g_gate += state.T @ d_raw
                np.add.at(g_in, x[t], np.concatenate([d_raw, d_c], axis=1))
                back = back * (1 - z) + rs * r + d_raw @ gate.T
            grads |= {f"in_{side}": g_in, f"gate_{side}": g_gate, f"cand_{side}": g_cand}
        return loss, grads


def windows_of(data: np.ndarray, lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of texts laid end to end, to windows [n, window], how full each is, and how many each text has; zeros fill a text's last one."""
    per = -(-lengths // window)
    owner_start = np.cumsum(lengths) - lengths
    n = int(per.sum())
    first = np.cumsum(per) - per
    k = np.arange(n) - np.repeat(first, per)
    start = np.repeat(owner_start, per) + k * window
    fill = np.minimum(np.repeat(lengths, per) - k * window, window)
    padded = np.concatenate([data, np.zeros(window, np.uint8)])
    grid = np.lib.stride_tricks.sliding_window_view(padded, window)[start] if n else np.zeros((0, window), np.uint8)
    part = np.flatnonzero(fill < window)
    grid[part] = np.where(np.arange(window) < fill[part][:, None], grid[part], 0)
    return grid, fill, per


class Model:
    def __init__(self, labels: list[str], network: Network):
        self.labels, self.network = labels, network

    def documents(self, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Mean label probabilities of each text, [text, label]; a text without bytes gets zeros."""
        grid, fill, per = windows_of(data, lengths)
        sums = np.empty((len(grid), len(self.labels)), np.float32)
        for at in range(0, len(grid), 2048):
            x, full = np.ascontiguousarray(grid[at : at + 2048].T), fill[at : at + 2048]
            p, _, _ = self.network.position_probabilities(x)
            if full.min() < WINDOW:
                p *= (np.arange(WINDOW)[:, None] < full)[:, :, None]
            sums[at : at + 2048] = p.sum(axis=0)
        total = np.concatenate([np.zeros((1, sums.shape[1])), np.cumsum(sums, axis=0, dtype=np.float64)])
        ends = np.cumsum(per)
        return (total[ends] - total[ends - per]) / np.maximum(lengths, 1)[:, None]


def train(texts: list[bytes], langs: list[str], seed: int = 11, steps: int = STEPS) -> Model | None:
    """Fit on whole texts: windows are drawn from anywhere in them, the same number of each language."""
    pairs = [(t, k) for t, k in zip(texts, langs, strict=True) if t]
    labels = sorted({k for _, k in pairs})
    if not labels:
        return None
    rng = np.random.default_rng(seed)
    grids = []
    for label in labels:
        own = [t for t, k in pairs if k == label]
        grid, fill, _ = windows_of(np.frombuffer(b"".join(own), np.uint8), np.array([len(t) for t in own]))
        grids.append((grid, fill))
    net = Network(len(labels))
    m = {k: np.zeros_like(v) for k, v in net.w.items()}
    v2 = {k: np.zeros_like(v) for k, v in net.w.items()}
    each = max(8, BATCH // len(labels))
    for step in range(1, steps + 1):
        picks = [rng.integers(0, len(g), each) for g, _ in grids]
        x = np.concatenate([g[i] for (g, _), i in zip(grids, picks, strict=True)]).T.copy()
        full = np.concatenate([f[i] for (_, f), i in zip(grids, picks, strict=True)])
        y = np.repeat(np.arange(len(labels)), each)
        _, grads = net.gradients(x, y, (np.arange(WINDOW)[:, None] < full).astype(np.float32))
        rate = RATE * min(1.0, step / 20) * (0.15 if step > steps * 0.75 else 1.0)
        for k, g in grads.items():
            g = np.clip(g, -1, 1)
            m[k] = 0.9 * m[k] + 0.1 * g
            v2[k] = 0.99 * v2[k] + 0.01 * g * g
            net.w[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Model(labels, net)


def fit(docs: DataFrame, usable: Column, sample: int = SAMPLE) -> Model | None:
    """A model from at most `sample` of the rows that may be learnt from, chosen by a hash.

    The rows are counted first, so that only those whose hash lies below a mark, about twice as many as are wanted, leave their
    tasks: what comes to the driver is bounded by `sample` and `SAMPLE_BYTES`, not by the input.
    """
    rows = docs.where(usable & F.col("lang").isNotNull())
    total = rows.count()
    if not total:
        return None
    spread = 1 << 40
    mark = min(spread, int(2 * sample / total * spread) + 1)
    rows = rows.where(F.col("text").isNotNull()).select(F.col("text").cast("binary").alias("text"), "lang", F.xxhash64(F.col("doc_id").cast("string"), F.col("text")).alias("o"))
    rows = rows.where((F.pmod("o", F.lit(spread)) < mark) & (F.octet_length("text") <= SAMPLE_BYTES))
    got = rows.orderBy(F.pmod("o", F.lit(spread)), "lang").limit(sample).collect()
    return train([bytes(r["text"]) for r in got], [r["lang"] for r in got])


def predict(docs: DataFrame, model: Model | None, columns: list[str], added: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The named columns with language and score added, under names that aren't among them."""
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if model is None:
        return docs.select(*columns, F.lit("und").alias(added[0]), F.lit(0.0).alias(added[1]))
    # a text that is among the columns travels once; a size says that it has letters
    within = "text" in columns
    plain = docs.select(F.struct(*columns).alias("row"), F.when(letters, F.octet_length("text")).alias("size"), *([] if within else ["text"]))
    schema = plain.select("row", F.lit("").alias("label"), F.lit(0.0).alias("score")).schema
    names = np.array([*model.labels, "und"], dtype=object)

    def run(batches):
        for b in slices(batches, 1):
            whole = pc.struct_field(b.column(0), "text") if within else b.column(2)
            texts = pc.if_else(pc.is_valid(b.column(1)), whole, "").cast(pa.binary())
            offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset) if len(texts) else np.zeros(1, np.int32)
            raw = texts.buffers()[2]
            data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
            lengths = np.diff(offsets).astype(np.int64)
            p = model.documents(data, lengths)
            best = p.argmax(axis=1)
            score = np.where(lengths > 0, np.clip(p[np.arange(len(p)), best], 0, 1), 0.0)
            pred = names[np.where(lengths > 0, best, len(model.labels))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["row", "label", "score"])

    return plain.mapInArrow(run, schema).select("row.*", F.col("label").alias(added[0]), F.col("score").alias(added[1]))


def op1_query(docs: DataFrame) -> DataFrame:
    held = crc_fold(F.col("doc_id"), 4) == 2
    model = fit(docs, ~held)
    return predict(docs.select("doc_id", "text", held.alias("held_out")), model, ["doc_id", "held_out"])


def stage(docs: DataFrame) -> DataFrame:
    """Documents whose language can be told stay; written at once, so that whole rows pass through Python in modest batches."""
    model = fit(docs, crc_fold(F.col("doc_id"), 4) != 2)
    names = docs.columns
    judged = materialise(predict(docs, model, names, ("_judged_lang", "_judged_score")), "languages")
    return judged.where((F.col("_judged_lang") != "und") & (F.col("_judged_score") >= REJECT_BELOW)).select(*names)
