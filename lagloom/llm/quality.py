"""Quality by supervised subword embeddings.

A token (what stands between white space) has the hashed vectors of itself and of
its character n-grams, hashed for many tokens at once; a text is the average of its vectors, and a softmax over two
classes reads it. Vectors and output are learned together by stochastic gradient
descent. A token that repeats the one before it counts as a feature of its own, as
does a pair of tokens by their shapes (upper case, digits, signs).

The model is linear in the average, so a token's part of the difference of the two
outputs is summed once and kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagloom.llm.labelled import held_out, sample


_M = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.concatenate([[np.uint64(1)], np.cumprod(np.full(2 * n, _M, np.uint64), dtype=np.uint64)])
    return _POWERS


def _bucket(h: np.ndarray, kind: int, bits: int) -> np.ndarray:
    h = (h + np.uint64(kind)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _kinds(code: np.ndarray) -> np.ndarray:
    """Marks of code points for shapes: small, capital, digit and other letters, other signs as they are."""
    u, at = np.unique(code, return_inverse=True)
    mark = lambda c: 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4 if c.isalpha() else 16 + ord(c)
    return np.array([mark(chr(int(x))) for x in u], np.uint64)[at]


def buckets(tokens: list[str], bits: int, low: int = 3, high: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of tokens, of their shapes and their character n-grams, and to which token each belongs."""
    if not tokens:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    code = np.frombuffer("".join(f"<{t}>" for t in tokens).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 2
    start = np.cumsum(size) - size
    of = np.repeat(np.arange(len(tokens)), size)
    at = np.arange(len(code)) - start[of]
    power = _powers(int(size.max()) + 1)
    kind = _kinds(code)
    begins = (at == 0) | np.concatenate([[True], kind[1:] != kind[:-1]])
    run = np.cumsum(begins)
    run -= run[start][of]
    found = [
        _bucket(np.add.reduceat(code * power[at], start), 1, bits),
        _bucket(np.add.reduceat(np.where(begins, kind * power[run], np.uint64(0)), start), 2, bits),
    ]
    owner = [np.arange(len(tokens))] * 2
    h = code
    for n in range(2, min(high, len(code)) + 1):
        h = h[:-1] * _M + code[n - 1 :]
        if n >= low:
            ok = np.flatnonzero((at + n <= size[of])[: len(h)])
            found.append(_bucket(h[ok], n, bits))
            owner.append(of[ok])
    return np.concatenate(found), np.concatenate(owner)


def _repeats(tokens: list[str]) -> int:
    return sum(map(str.__eq__, tokens, tokens[1:]))


class Subwords:
    """Vectors of ``2**bits`` buckets and one more for repetition, with a softmax over two classes."""

    def __init__(self, bits: int = 17, dim: int = 8, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.bits = bits
        self.vectors = rng.uniform(-1 / dim, 1 / dim, ((1 << bits) + 1, dim))
        self.output = np.zeros((2, dim))
        self.bias = np.zeros(2)

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of a text and how often each occurs."""
        tokens = text.split()
        flat, _ = buckets(tokens, self.bits)
        again = _repeats(tokens)
        at, n = np.unique(flat, return_counts=True)
        if again:  # as weighty as the tokens' own vectors
            at, n = np.append(at, 1 << self.bits), np.append(n, again * max(1, len(flat) // max(1, len(tokens))))
        return at, n

    def train(self, texts: list[tuple[str, int]], epochs: int = 5, rate: float = 0.5) -> None:
        rows = []
        for t, y in texts:
            at, n = self.counts(t)
            if len(at):
                rows.append((at.astype(np.int32), (n / n.sum()).astype(np.float32), y))
        steps = max(1, epochs * len(rows))
        for k in range(epochs * len(rows)):
            at, share, y = rows[k % len(rows)]
            lr = rate * (1 - k / steps)
            mean = share @ self.vectors[at]
            z = self.output @ mean + self.bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = p @ self.output
            self.output -= lr * np.outer(p, mean)
            self.bias -= lr * p
            # as the average spreads a gradient thin, buckets take it by their share of the largest
            self.vectors[at] -= lr * np.outer(share / share.max(), back)

    def parts(self) -> tuple[np.ndarray, float]:
        """Each bucket's part of output 1 minus output 0, and the bias."""
        d = self.output[1] - self.output[0]
        return self.vectors @ d, float(self.bias[1] - self.bias[0])


def fitted(texts: list[tuple[str, int]]) -> tuple[np.ndarray, float, int]:
    """parts() of a model trained on texts, and its bits."""
    model = Subwords()
    model.train(texts)
    return *model.parts(), model.bits


def scores(docs: DataFrame, parts: np.ndarray, bias: float, bits: int, keep: list[str] | None = None) -> DataFrame:
    """doc_id (or the columns ``keep``, text among them) and score for every document."""
    keep = keep or ["doc_id"]
    given = docs.select(*keep, docs["text"].alias("_text"))
    sent = docs.sparkSession.sparkContext.broadcast(parts.astype(np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        again_w = w[1 << bits]
        known: dict[str, complex] = {}  # sum of parts and number of buckets of a token
        for batch in batches:
            out = []
            for text in batch.column(len(keep)).to_pylist():
                tokens = (text or "").split()
                if len(known) > 400_000:
                    known.clear()
                new = [t for t in set(tokens) if t not in known]
                b, of = buckets(new, bits)
                known.update(zip(new, (np.bincount(of, w[b], len(new)) + 1j * np.bincount(of, minlength=len(new))).tolist(), strict=True))
                both = sum(map(known.__getitem__, tokens))
                s, n = both.real, both.imag
                again = _repeats(tokens)
                if again:
                    more = again * max(1, int(n) // len(tokens))
                    s, n = s + more * again_w, n + more
                z = (s / n if n else 0.0) + bias
                out.append(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(out, pa.float64())], [*keep, "score"])

    return given.mapInArrow(run, docs.select(*keep).withColumn("score", F.lit(0.0)).schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, per_class: int = 1500, bits: int = 17) -> DataFrame:
    """doc_id, held_out, score, predicted for every document.

    Learns from at most ``per_class`` labelled rows of each class. Null and empty
    texts score the bias; repeated rows score alike; without any labels every score
    is 0.5. A null doc_id is not held out. Only text is an input of the score.
    """
    model = Subwords(bits)
    model.train(sample(docs, labels, "quality", per_class))
    s = scores(docs, *model.parts(), bits)
    return s.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
