"""Importance resampling towards a target: hashed word features, then a radix sort.

A first pass counts the features of the corpus by bucket, the same for the target. The
log ratios of the two are one array of ``buckets`` whole numbers; a second pass adds up its
entries over each document's features. To that weight comes noise from a hash of the
document's id (Gumbel noise), so that the highest scores are a sample without replacement.

The order of all documents comes from a radix sort, least digit first: a pass is a stable
counting sort on one digit of the key (score, then id). Rows stand at positions; a block is
a run of positions. Rows are counted by (digit, block); prefix sums of the counts say
where the rows of a block with a digit start, and the order inside of it is that of the
positions. Blocks bound every group, so a digit that all rows share spreads over tasks.
Each pass is a stored table, so a lost executor costs one pass at most.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagloom.llm.common import stage, unstage

_KEPT = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
_TABLE = bytes(c for c in range(256)).lower().translate(bytes(c if c in _KEPT else 0x20 for c in range(256)))
_SIGN = -(1 << 63)


class _Buckets(dict):
    """Bucket of each feature, kept for those seen lately."""

    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, feature: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        b = self[feature] = zlib.crc32(feature) % self.n
        return b


def features(raw: bytes, known: _Buckets, longest: int, piece: int = 1 << 22) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of features) of a text, in pieces of about ``piece`` bytes, so that a long text fits."""
    raw = raw.translate(_TABLE)
    at, tail = 0, []
    while at < len(raw):
        end = raw.find(b" ", at + piece)
        end = len(raw) if end < 0 else end
        ws = raw[at:end].split()
        at = end
        parts = [np.fromiter(map(known.__getitem__, ws), np.int64, len(ws))]
        if longest > 1:
            seq = tail + ws
            for r in range(2, longest + 1):
                runs = [b" ".join(seq[i - r : i]) for i in range(max(r, len(tail) + 1), len(seq) + 1)]
                parts.append(np.fromiter(map(known.__getitem__, runs), np.int64, len(runs)))
            tail = seq[1 - longest :]
        yield len(ws), np.concatenate(parts)


def bucket_counts(docs: DataFrame, buckets: int = 10_000, longest: int = 1) -> DataFrame:
    """bucket, n: features of all texts; a task sends each bucket once at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = _Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                for _, b in features(raw or b"", known, longest):
                    total += np.bincount(b, minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(total[hit])], ["bucket", "n"])

    return docs.select(F.col("text").cast("binary").alias("t")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = 10_000, longest: int = 1) -> np.ndarray:
    """Whole log ratio of each bucket, in thousandths; the driver gets ``buckets`` rows of each side."""
    sides = []
    for side in (target, corpus):
        n = np.zeros(buckets, np.int64)
        for r in bucket_counts(side, buckets, longest).collect():
            n[r.bucket] = r.n
        sides.append(n.tolist())
    t, s = sides
    all_t, all_s = float(sum(t) + buckets), float(sum(s) + buckets)
    return np.array([math.floor(1000 * math.log((a + 1.0) * all_s / ((b + 1.0) * all_t))) for a, b in zip(t, s, strict=True)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, longest: int = 1) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Buckets(len(gain))
        for batch in batches:
            out = np.zeros((3, batch.num_rows), np.int64)
            for i, raw in enumerate(batch.column(1).to_pylist()):
                for n, b in features(raw or b"", known, longest):
                    out[:, i] += n, len(b), gain[b].sum()
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out)], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("t")).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def _unsigned(c: Column, down: bool) -> Column:
    """Bits of a long whose unsigned order is the long's, or its reverse."""
    u = c.bitwiseXOR(F.lit(_SIGN))
    return F.bitwise_not(u) if down else u


def radix_sort(df: DataFrame, keys: list[tuple[str, bool]], bits: int = 12, blocks: int = 1024) -> DataFrame:
    """``df`` with ``position`` (from 0) in the order of ``keys``, (long column, descending) each; ties in the order of ``row``.

    ``df`` is a stored table whose ``row`` is unique and has no nulls in its keys.
    Counts are at most 2 ** bits for each block; a block has at most 2 ** 20 rows.
    """
    r = df.agg(F.count("*").alias("n"), *(f(k).alias(f"{k}_{f.__name__}") for k, _ in keys for f in (F.min, F.max))).first()
    block_bits = min(max(10, (r.n // blocks).bit_length()), 20)
    passes = []
    for k, down in reversed(keys):
        width = ((r[f"{k}_min"] ^ r[f"{k}_max"]) & ((1 << 64) - 1)).bit_length() if r.n else 0
        passes += [(k, down, shift) for shift in range(0, width, bits)]
    cur = df.select("row", *(k for k, _ in keys), F.col("row").alias("position"))
    if not passes:
        passes = [(keys[0][0], False, 63)]  # one key alone: the pass makes positions dense
    last = None
    for k, down, shift in passes:
        digit = F.shiftrightunsigned(_unsigned(F.col(k), down), shift).bitwiseAND(F.lit((1 << bits) - 1))
        x = cur.withColumns({"digit": digit, "block": F.shiftright("position", block_bits)})
        counts = x.groupBy("digit", "block").agg(F.count("*").alias("n"))
        # at most 2 ** bits rows
        totals = counts.groupBy("digit").agg(F.sum("n").alias("all")).withColumn("smaller", F.sum("all").over(Window.orderBy("digit")) - F.col("all"))
        before = F.sum("n").over(Window.partitionBy("digit").orderBy("block")) - F.col("n")
        starts = counts.withColumn("before", before).join(F.broadcast(totals), "digit").select("digit", "block", (F.col("before") + F.col("smaller")).alias("start"))
        inside = F.row_number().over(Window.partitionBy("digit", "block").orderBy("position")) - 1
        moved = (
            x.withColumn("inside", inside).join(starts.hint("shuffle_merge"), ["digit", "block"])
            .select("row", *(k for k, _ in keys), (F.col("start") + F.col("inside")).alias("position"))
        )
        cur = stage(moved, "pass")
        if last is not None:
            unstage(last)
        last = cur
    return cur


def resample(
    docs: DataFrame, target: DataFrame, seed: int = 2024, percent: int = 10, least_words: int = 20, buckets: int = 10_000, longest: int = 1
) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank (null: not drawn).

    The noise is ``floor(-1000 ln(-ln u))`` with u from the first 32 bits of the sha256 of
    ``seed:doc_id``. Drawn are the ``percent`` highest scores, rounded down, of the documents
    with ``least_words`` words, ties to the smaller doc_id. A null or empty text has no
    features, weight 0 and only its noise. Rows that repeat a doc_id are documents of their
    own; a row without doc_id has no score, is not drawn and not counted. Empty tables give
    empty results or, as a target, equal counts. Other columns are not read.
    """
    gain = gains(docs, target, buckets, longest)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weights(docs, gain, longest).withColumn("score", F.col("weight") + noise).withColumn("row", F.monotonically_increasing_id())
    scored = stage(scored, "scored")
    open_to = scored.filter(f"n_words >= {least_words} and doc_id is not null")
    n = open_to.count()
    order = radix_sort(open_to.select("row", "score", "doc_id"), [("score", True), ("doc_id", False)])
    drawn = order.filter(F.col("position") < percent * n // 100).select("row", (F.col("position") + 1).alias("rank"))
    return scored.join(drawn.hint("shuffle_merge"), "row", "left").select("doc_id", "n_features", "weight", "score", "rank")
