"""Ranks inside groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagloom.operators.lineage import written


def rank_by_ranges(df: DataFrame, group: list[str], order: list[Column | str], name: str = "rank") -> DataFrame:
    """``df`` with the row number (from 1) of each row in its group; no task holds a whole group.

    Rows are dealt by ranges of (group, order) and stored; a rank is the row number in the
    part plus the rows of the group in earlier parts, one count for each part and group.
    ``order`` must tell the rows of a group apart, or equal rows share their places by chance.
    """
    keys = [F.struct(*group).alias("_g")]
    d = df.select("*", *keys)
    d = written(d.repartitionByRange("_g", *order).sortWithinPartitions("_g", *order).withColumn("_at", F.monotonically_increasing_id()), "ranks")
    d = d.withColumn("_part", F.shiftright("_at", 33)).withColumn("_key", F.to_json("_g"))
    c = d.groupBy("_part", "_key").agg(F.min("_at").alias("_lo"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_key").orderBy("_part")) - F.col("_n")
    c = c.select("_part", "_key", "_lo", before.alias("_before"))
    return d.join(c.hint("shuffle_merge"), ["_part", "_key"]).withColumn(name, F.col("_at") - F.col("_lo") + F.col("_before") + 1).drop("_g", "_at", "_part", "_key", "_lo", "_before")


def mid_ranks(df: DataFrame, group: list[str], value: str, name: str = "rank") -> DataFrame:
    """group, value and the mean rank of the rows that share it; ``value`` has no nulls. Distinct values are dealt by ranges of (group, value), so no task ranks a whole group."""
    c = df.groupBy(*group, value).agg(F.count("*").alias("_c"))
    c = written(c.repartitionByRange(*group, value).withColumn("_part", F.spark_partition_id()), "values")
    at = [*group, "_part"]
    size = c.groupBy(*at).agg(F.sum("_c").alias("_n"))
    size = size.select(*at, (F.sum("_n").over(Window.partitionBy(*group).orderBy("_part")) - F.col("_n")).alias("_before"))  # a row per range
    up = F.sum("_c").over(Window.partitionBy(*at).orderBy(value)) + F.col("_before")
    return c.join(size.hint("shuffle_merge"), at).select(*group, value, (up - (F.col("_c") - 1) / 2.0).alias(name))
