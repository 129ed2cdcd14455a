"""Licence scan by diagonal voting, in DataFrame functions alone.

A text is its sequence of words. Every word and its successor are one rolling key; a
join with the template table finds the places of the templates where that key stands and
holds the words themselves against the template (so equal hashes decide nothing). A hit
votes for the diagonal ``place in text - place in template``, which is where the template
would start. A phrase is found where one diagonal has all of its grams. A notice may
have lost or gained words: diagonals at most ``slack`` apart are merged, and the share of
the template's grams that they have together decides.

The template table is fixed and small (one row for each gram), so it is broadcast. All
else is one shuffle by document: a document without a hit keeps its first word as a row,
so nothing has to be joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Beginnings of notices, by their words, with labels of the scan's own.
NOTICES = (
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
)

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """A text whose words equal ASCII words exactly where they do after lower-casing A-Z alone.

    ``lower`` is the quick way; of all other letters only the Kelvin sign becomes an ASCII
    word by it, so texts that hold it take the slow way.
    """
    return F.when(F.contains(text, F.lit("K")), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))


def templates(spark: SparkSession, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """One row for each gram of each template: pairs of words for phrases, triples for notices."""
    rows = [F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(p).alias("wording"), F.lit(i < len(phrases)).alias("whole")) for i, (p, label) in enumerate((*phrases, *notices))]
    t = spark.range(1).select(F.inline(F.array(*rows))).withColumn("t", F.split("wording", " "))
    k = F.when(F.col("whole"), 2).otherwise(3)
    t = t.select("template", "label", "whole", "t", (F.size("t") - k + 1).alias("grams"), F.posexplode("t").alias("at", "t0"))
    return t.filter("at < grams").select(
        "template", "label", "whole", "grams", "at", "t0", F.get("t", F.col("at") + 1).alias("t1"),
        F.when(~F.col("whole"), F.get("t", F.col("at") + 2)).alias("t2"), F.xxhash64("t0", F.get("t", F.col("at") + 1)).alias("gram"),
    )


def spans(docs: DataFrame, phrases=PHRASES, notices=NOTICES, slack: int = 3) -> DataFrame:
    """Votes by document, template and place.

    Columns: row (a number of the document), doc_id, n_words, template, label, start (word
    of the text where the template would start), whole (a phrase that stands here word for
    word), share (of the template's grams, of this and neighbouring diagonals). A document
    without any hit has one row whose template is null.
    """
    d = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.regexp_extract_all(lowered(F.coalesce("text", F.lit(""))), F.lit(WORD), F.lit(0)).alias("words"))
    w = d.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), "words", F.posexplode_outer("words").alias("pos", "w0"))
    w = w.withColumn("w1", F.get("words", F.col("pos") + 1))
    t = templates(docs.sparkSession, phrases, notices)
    same = (
        (F.xxhash64("w0", "w1") == F.col("gram")) & (F.col("w0") == F.col("t0")) & (F.col("w1") == F.col("t1"))
        & (F.col("t2").isNull() | (F.get("words", F.col("pos") + 2) == F.col("t2")))
    )
    hits = (
        w.join(F.broadcast(t), same, "left")  # the grams of fixed templates
        .filter("template is not null or coalesce(pos, 0) = 0")
        .select("row", "doc_id", "n_words", "template", "label", "whole", "grams", "at", (F.col("pos") - F.col("at")).cast("long").alias("diagonal"))
        .repartition("row")
    )
    votes = hits.groupBy("row", "doc_id", "n_words", "template", "label", "whole", "grams", F.when(F.col("template").isNotNull(), F.col("diagonal")).alias("start")).agg(F.collect_set("at").alias("at"))
    near = Window.partitionBy("row", "template").orderBy("start").rangeBetween(-slack, slack)
    return votes.withColumn("near", F.collect_list("at").over(near)).select(
        "row", "doc_id", "n_words", "template", "label", "start", F.coalesce(F.col("whole") & (F.size("at") == F.col("grams")), F.lit(False)).alias("whole"),
        F.coalesce(F.size(F.array_distinct(F.flatten("near"))) / F.col("grams"), F.lit(0.0)).alias("share"),
    )


def scan(docs: DataFrame, phrases=PHRASES, notices=NOTICES, slack: int = 3, enough: float = 0.6) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base matches are places where the words of a phrase stand one after another; labels
    has theirs and those of templates of which ``enough`` is found; score is the largest
    share of any template. A null or empty text, or one without words, has no words, no
    labels (empty strings) and score 0. Repeated rows and rows without doc_id are documents
    of their own. An empty table gives an empty one. Other columns are not read. A task
    holds the words of one text at a time, whatever its length.
    """
    s = spans(docs, phrases, notices, slack)
    base = F.col("whole")

    def joined(which: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")

    return (
        s.groupBy("row", "doc_id", "n_words")
        .agg(
            F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
            joined(base).alias("base_labels"), joined(base | (F.col("share") >= enough)).alias("labels"), F.max("share").alias("score"),
        )
        .drop("row")
    )
