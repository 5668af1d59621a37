"""A quality classifier by attention-based multiple-instance learning.

A document is a bag of passages. A passage is a bag of hashed byte trigrams
whose embeddings, the gated attention over passages and the document layer are
learnt together, from documents' labels alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import _common as C
from tidewater.llm.crf import training_rows

#: Code points in a passage, buckets of trigrams, and sizes of an embedding and of the gate.
PASSAGE, FEATURES, HIDDEN, GATES = 600, 1024, 12, 8
#: Of so many trigrams a passage's shares count half; of fewer, chance decides most.
FEW = 64
#: The training sample: at most so many labelled rows of each class, of at most so many bytes each.
SAMPLE_ROWS, SAMPLE_BYTES = 1500, 1 << 15
ROUNDS, RATE, RIDGE = 300, 0.01, 1e-3
THRESHOLD, FOLDS, HELD_OUT = 0.3, 5, 0
SCORED = "doc_id long, score double, predicted int, passages int, attention array<float>"
#: Bytes that are encoded at a time, so that a long text needs no more memory than that many counts.
_STEP = 1 << 20


def starts_of(raw: np.ndarray) -> np.ndarray:
    """Where the passages of a text in UTF-8 begin; an empty text is one empty passage."""
    return np.flatnonzero((raw & 0xC0) != 0x80)[::PASSAGE] if len(raw) else np.zeros(1, np.int64)


def encode(text: str | None) -> np.ndarray:
    """A row for each passage of the whole text: square roots of its shares of trigrams, by bucket, and how far they count: fully where there are many."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    starts = starts_of(raw)
    out = np.zeros((len(starts), FEATURES + 1), np.float32)
    some = max(1, _STEP // PASSAGE)
    for k in range(0, len(starts), some):
        own = starts[k : k + some]
        end = starts[k + some] if k + some < len(starts) else len(raw)
        x = np.append(raw[own[0] : end + 2], [0, 0]).astype(np.uint32)[: end - own[0] + 2]  # a trigram belongs where it begins
        codes = (x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA77) ^ x[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F) >> np.uint32(22)
        sizes = np.diff(np.append(own, end))
        counts = np.bincount(np.repeat(np.arange(len(own)) * FEATURES, sizes) + codes[: sizes.sum()], minlength=len(own) * FEATURES).reshape(len(own), FEATURES)
        out[k : k + some, :-1] = np.sqrt(counts / np.maximum(1, sizes)[:, None])
        out[k : k + some, -1] = sizes / (sizes + FEW)
    return out


class Model:
    """Embeddings, gated attention and document layer, with the features' means."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        draw = lambda scale, *shape: rng.normal(0, scale, shape)
        self.mean = np.zeros(FEATURES, np.float32)
        self.p = {"W": draw(0.3, FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "V": draw(0.3, HIDDEN, GATES), "U": draw(0.3, HIDDEN, GATES), "w": draw(0.3, GATES), "c": draw(0.3, HIDDEN), "d": np.zeros(1)}

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x[:, :-1] - self.mean) * x[:, -1:]

    def forward(self, x: np.ndarray, starts: np.ndarray, of: np.ndarray) -> dict:
        p = self.p
        x = self.centred(x)
        h = np.tanh(x @ p["W"].astype(x.dtype) + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, starts)[of])
        a = e / np.add.reduceat(e, starts)[of]
        z = np.add.reduceat(a[:, None] * h, starts)
        score = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -500, 500)))
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "score": score}

    def gradient(self, x: np.ndarray, starts: np.ndarray, of: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        """Of the weighted log loss of the documents' labels, by parameter."""
        p, f = self.p, self.forward(x, starts, of)
        dl = (f["score"] - y) * weight
        dz = dl[:, None] * p["c"]
        da = (dz[of] * f["h"]).sum(1)
        de = f["a"] * (da - np.add.reduceat(f["a"] * da, starts)[of])
        dt, dg = de[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2), de[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["a"][:, None] * dz[of] + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
        dw = self.centred(x).T @ dh.astype(x.dtype)
        return {"W": dw, "b": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": ((f["t"] * f["g"]) * de[:, None]).sum(0), "c": f["z"].T @ dl, "d": np.array([dl.sum()])}

    def score(self, bags: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        x, starts, of = _joined(bags)
        f = self.forward(x, starts, of)
        return f["score"], f["a"]


def _joined(bags: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(b) for b in bags])
    return np.concatenate(bags), np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.repeat(np.arange(len(bags)), sizes)


def train(texts: list[str], labels: list[int], rounds: int = ROUNDS, rate: float = RATE, part: int = 256) -> Model:
    """Adam on parts of the documents in a fixed shuffled order, both classes weighing the same; only document labels are used."""
    model, rng = Model(), np.random.default_rng(1)
    order = rng.permutation(len(texts))
    y = np.array(labels, float)[order]
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    bags = [encode(texts[i]).astype(np.float16) for i in order]  # half the memory
    model.mean = (sum(b[:, :-1].sum(0, dtype=np.float64) for b in bags) / sum(map(len, bags))).astype(np.float32)
    cuts = list(range(0, len(bags), part))
    m, v = ({k: np.zeros_like(q) for k, q in model.p.items()} for _ in range(2))
    for step in range(1, rounds + 1):
        k = cuts[(step - 1) % len(cuts)]
        x, starts, of = _joined(bags[k : k + part])
        own = weight[k : k + part]
        grad = model.gradient(x.astype(np.float32), starts, of, y[k : k + part], own / own.sum())
        for name, q in grad.items():
            p = model.p[name]
            q = q + RIDGE * p
            m[name], v[name] = 0.9 * m[name] + 0.1 * q, 0.999 * v[name] + 0.001 * q * q
            model.p[name] = p - rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)
    model.p["W"] = model.p["W"].astype(np.float32)
    return model


def _scored(model: Model, texts: list[str | None]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Scores and attention of the texts, a run of them at a time that holds few passages."""
    held, size = [], 0
    for i, t in enumerate(texts):
        held.append(encode(t))
        size += len(held[-1])
        if size >= 1024 or i == len(texts) - 1:
            score, attention = model.score(held)
            yield score, [a.astype(np.float32) for a in np.split(attention, np.cumsum([len(b) for b in held])[:-1])]
            held, size = [], 0


def _scorer(model: Model, threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = 0
            for score, attention in _scored(model, pdf["text"].tolist()):
                ids = pdf["doc_id"].iloc[at : at + len(score)].to_numpy()
                yield pd.DataFrame({"doc_id": ids, "score": score, "predicted": (score >= threshold).astype(int), "passages": [len(a) for a in attention], "attention": attention})
                at += len(score)

    return run


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, score, predicted, passages, attention (a weight for each passage).

    Only text is an input of a score. Null and empty texts are one empty
    passage and are scored as such. Repeated rows are scored each. Without
    usable labels the model is untrained. An empty table gives an empty result.
    """
    model = fitted(docs, labels)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(_scorer(model, threshold), SCORED)


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    C.small_batches(docs.sparkSession)
    sample = training_rows(docs, labels, "quality", FOLDS, HELD_OUT, SAMPLE_ROWS, SAMPLE_BYTES)
    return train([t for t, _ in sample], [y for _, y in sample]) if sample else Model()


def score_udf(model: Model):
    """A score of each text, beside the columns of its row."""

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.concatenate([np.zeros(0), *(s for s, _ in _scored(model, texts.tolist()))]))
        C.give_back()

    score.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(score, "double")
