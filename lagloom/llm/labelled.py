"""Bounded samples of labelled documents."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest


def held_out() -> Column:
    """Rows whose crc32(doc_id as text) mod 3 is 1; their labels are never learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, most_chars: int = 200_000) -> list[tuple[str, int]]:
    """Texts and labels of at most ``per_class`` rows of each class, those of least id hash.

    Rows that are held out, have no doc_id or no label of 0 or 1 are left out; a doc_id
    with several labels counts with the greatest, one with several texts with the text
    of least hash. Texts of more than ``most_chars`` characters teach nothing. So at
    most 2 * per_class texts of bounded length reach the driver, however often an id
    repeats. Ordered by hash of the text.
    """
    return _ordered([(r.doc_id, r.y, r.text) for r in _sampled(docs, labels, label, per_class, most_chars).collect()])


def trained(docs: DataFrame, labels: DataFrame, label: str, per_class: int, fit: Callable, most_chars: int = 200_000):
    """``fit(sample(...))``, made in a task: the driver gets the model only, never the texts or what is derived from them."""

    def run(batches):
        rows = [tuple(r.values()) for b in batches for r in b.to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(_ordered(rows)))], pa.binary())], ["model"])

    model = _sampled(docs, labels, label, per_class, most_chars).repartition(1).mapInArrow(run, "model binary").first()
    return fit([]) if model is None else pickle.loads(model.model)


def _sampled(docs: DataFrame, labels: DataFrame, label: str, per_class: int, most_chars: int) -> DataFrame:
    known = labels.filter("doc_id is not null").filter(F.col(label).isin(0, 1)).filter(~held_out()).groupBy("doc_id").agg(F.max(label).alias("y"))
    picked = None
    for y in (0, 1):
        part = known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.union(part)
    # 2 * per_class ids at most: small enough to send to every task
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.length("text") <= most_chars).join(F.broadcast(picked), "doc_id")
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")
    return rows.groupBy("doc_id", "y").agg(one).select("doc_id", "y", "t.text")


def _ordered(rows: list[tuple[int, int, str]]) -> list[tuple[str, int]]:
    once = {text: (doc_id, y) for doc_id, y, text in sorted(rows, key=lambda r: -r[0])}  # a text that many rows share teaches once
    return [(t, y) for t, (_, y) in sorted(once.items(), key=lambda x: (xxh32_intdigest(x[0]), x[0]))]
