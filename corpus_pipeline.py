"""Corpus preparation from documents to packed sequences, stage by stage.

Each stage works on all rows that the one before kept; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagloom.llm import minhash, packing, quality, suffixdedup, toxicity
from lagloom.llm.common import stage, table
from lagloom.llm.labelled import trained

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose quality score is 0.5 or more."""
    docs = _documents(docs)
    parts, bias, bits = trained(docs, table(spark, sf_dir, "labels"), "quality", 1500, quality.fitted)
    kept = quality.scores(docs, parts, bias, bits, keep=COLUMNS)
    return kept.filter("score >= 0.5").select(*COLUMNS)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose toxicity score is below 0.7."""
    docs = _documents(docs)
    model = trained(docs, table(spark, sf_dir, "labels"), "toxic", 3000, toxicity.train)
    return toxicity.scores(docs, model, keep=COLUMNS).filter("score < 0.7").select(*COLUMNS)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each near-duplicate group, the one of smallest doc_id.

    Rows have numbers of their own, in the order of doc_id with null at the end, so rows
    that share a doc_id but not their text stay apart, and rows without doc_id are
    compared too.
    """
    ordered = _documents(docs).orderBy(F.asc_nulls_last("doc_id"), F.xxhash64("text"))
    rows = stage(ordered.withColumn("row", F.monotonically_increasing_id()), "numbered")
    kept = minhash.near_duplicates(rows.select(F.col("row").alias("doc_id"), "text")).filter("kept").select(F.col("doc_id").alias("row"))
    return rows.join(kept.hint("shuffle_merge"), "row").select(*COLUMNS)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut every repeated passage of 200 bytes and more out of the texts."""
    cut = suffixdedup.remove_repeats(_documents(docs), with_text=True, keep=["lang", "source"])
    return cut.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the ids of what is left into sequences of 1024."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("toxicity", toxicity_filter),
    ("minhash near-dedup", minhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("packing", pack_sequences),
]

#: Training and token packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
