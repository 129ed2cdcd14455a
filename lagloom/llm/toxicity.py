"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams.

Features of a text are the hashes of its words, word beginnings, word pairs and
pairs with one word between; each counts once. FTRL keeps a rate per coordinate, and
its L1 term leaves the weight of a feature at zero until its gradients have summed
up, so that the weights are few and small enough to send to every task. Scale and
bias are set on the training rows in the end, as online updates leave them rough.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagloom.llm.labelled import held_out, sample

_WORD = re.compile(r"[^\W_]+")
_A, _B = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)


def codes(tokens: list[str], known: dict[str, int], begin: int = 5) -> np.ndarray:
    """Two hashes for each word, packed: of the word and of its first ``begin`` letters."""
    if len(known) > 400_000:
        known.clear()
    for t in [t for t in set(tokens) if t not in known]:
        known[t] = xxhash.xxh32_intdigest(t) << 32 | xxhash.xxh32_intdigest(t[:begin], 1)
    return np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))


def features(text: str | None, known: dict[str, int], bits: int) -> np.ndarray:
    """Distinct feature numbers of a text."""
    c = codes(_WORD.findall((text or "").lower()), known)
    w, stem = (c >> np.uint64(32)).astype(np.uint32), c.astype(np.uint32)
    parts = [w, stem]
    if len(w) > 1:
        parts.append(w[:-1] * _A + w[1:] * _B + np.uint32(1))
    if len(w) > 2:
        parts.append(w[:-2] * _B + w[2:] * _A + np.uint32(2))
    return np.unique(np.concatenate(parts) >> np.uint32(32 - bits)).astype(np.int64)


class Ftrl:
    """Per-coordinate FTRL-proximal for 0/1 features; the last coordinate is the bias, free of L1."""

    def __init__(self, size: int, alpha: float = 0.1, beta: float = 1.0, l1: float = 10.0, l2: float = 1.0):
        self.alpha, self.beta, self.l2 = alpha, beta, l2
        self.l1 = np.full(size + 1, l1)
        self.l1[-1] = 0
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        w = (np.sign(z) * self.l1[at] - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1[at], 0.0, w)

    def update(self, at: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y
        step = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - step * w
        self.n[at] += g * g


def calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift that make margins into log odds (Platt), by Newton's method with a slight penalty."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        v = p * (1 - p) + 1e-9
        g = np.array([((p - y) * margin).sum() + 1e-3 * (a - 1), (p - y).sum() + 1e-3 * b])
        h = np.array([[(v * margin * margin).sum() + 1e-3, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def train(texts: list[tuple[str, int]], bits: int = 18, epochs: int = 10, seed: int = 0) -> tuple[np.ndarray, np.ndarray, float]:
    """Numbers and values of the weights that are not zero, and the bias; (nothing, 0) without texts."""
    known: dict[str, int] = {}
    bias = 1 << bits
    rows = [(np.append(features(t, known, bits), bias), y) for t, y in texts]
    model, rng = Ftrl(1 << bits), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            model.update(*rows[i])
    w = model.weights(np.arange(bias + 1))
    on = np.flatnonzero(w[:-1])
    if not rows:
        return on, w[on].astype(np.float32), 0.0
    scale, shift = calibrate(np.array([w[at[:-1]].sum() for at, _ in rows]), np.array([y for _, y in rows]))
    return on, (scale * w[on]).astype(np.float32), shift


def scores(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], bits: int = 18, keep: list[str] | None = None) -> DataFrame:
    """doc_id (or the columns ``keep``, text among them) and score for every document."""
    keep = keep or ["doc_id"]
    given = docs.select(*keep, docs["text"].alias("_text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on, values, bias = sent.value
        w = np.zeros(1 << bits, np.float32)
        w[on] = values
        known: dict[str, int] = {}
        for batch in batches:
            z = np.array([w[features(t, known, bits)].sum(dtype=np.float64) + bias for t in batch.column(len(keep)).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], [*keep, "score"])

    return given.mapInArrow(run, docs.select(*keep).withColumn("score", F.lit(0.0)).schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, per_class: int = 3000) -> DataFrame:
    """doc_id, held_out, score, predicted for every document.

    Learns from at most ``per_class`` labelled rows of each class. Null and empty
    texts score the bias; repeated rows score alike; without any labels every score
    is 0.5. A null doc_id is not held out. Only text is an input of the score.
    """
    s = scores(docs, train(sample(docs, labels, "toxic", per_class)))
    return s.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
