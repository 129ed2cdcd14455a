"""Benjamini-Hochberg q-values and selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagloom.operators.lineage import written


def bh(df: DataFrame, group: list[str], p: str = "p_value", q: str = "q_value", alpha: float | None = 0.05, invalid: str = "leave") -> DataFrame:
    """q per group, for families that fit a task; see bh_large for others. Null or non-finite p leave the family with q = 1 (``leave``) or stay in it as p = 1 (``keep``)."""
    ok = F.col(p).isNotNull() & ~F.isnan(p)
    pv = F.when(ok, F.col(p)) if invalid == "leave" else F.when(ok, F.col(p)).otherwise(1.0)
    df = df.withColumn("_p", pv).withColumn("_none", F.col("_p").isNull())
    g = [*group, "_none"]  # columns, so that the windows share one shuffle
    up = Window.partitionBy(*g).orderBy("_p")
    n = F.count("*").over(Window.partitionBy(*g))
    df = df.withColumn("_r", F.row_number().over(up)).withColumn("_x", F.col("_p") * n / F.col("_r"))
    down = Window.partitionBy(*g).orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn(q, F.coalesce(F.least(F.min("_x").over(down), F.lit(1.0)), F.lit(1.0))).drop("_p", "_none", "_r", "_x")
    return df if alpha is None else df.withColumn("significant", F.col(q) < alpha)


def bh_large(df: DataFrame, group: list[str] | None = None, p: str = "p_value", q: str = "q_value", alpha: float | None = None, invalid: str = "leave", count: str | None = None) -> DataFrame:
    """``bh`` for families of any size and number; without ``group`` all rows are one family, ``count`` names how many tests a row stands for.

    Equal p of a family have one q, so only distinct values with their counts are ranked: they
    are dealt by ranges of (family, p), ranks and running minima of a range are completed
    by those of the family's other ranges, of which there is one row for each range. Neither a
    large family nor a p that many rows share falls to one task.
    """
    ok = F.col(p).isNotNull() & ~F.isnan(p)
    d = df.withColumn("_p", F.when(ok, F.col(p)) if invalid == "leave" else F.when(ok, F.col(p)).otherwise(1.0))
    d = d.withColumn("_g", F.to_json(F.struct(*group)) if group else F.lit(""))
    c = d.filter("_p is not null").groupBy("_g", "_p").agg((F.sum(count) if count else F.count("*")).alias("_c")).repartitionByRange("_g", "_p").withColumn("_part", F.spark_partition_id())
    c = written(c, "ranges")
    family, at = Window.partitionBy("_g"), ["_g", "_part"]
    size = c.groupBy(*at).agg(F.sum("_c").alias("_n"))
    size = size.select(*at, (F.sum("_n").over(family.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(family).alias("_all"))
    inside = Window.partitionBy(*at)
    r = c.join(size.hint("shuffle_merge"), at).withColumn("_r", F.sum("_c").over(inside.orderBy("_p")) + F.col("_before")).withColumn("_x", F.col("_p") * F.col("_all") / F.col("_r"))
    later = r.groupBy(*at).agg(F.min("_x").alias("_m"))
    later = later.select(*at, F.min("_m").over(family.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)).alias("_later"))
    down = inside.orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, 0)
    r = r.join(later.hint("shuffle_merge"), at).select("_g", "_p", F.least(F.min("_x").over(down), F.coalesce("_later", F.lit(1.0)), F.lit(1.0)).alias("_q"))
    out = d.join(r.hint("shuffle_merge"), ["_g", "_p"], "left").withColumn(q, F.coalesce("_q", F.lit(1.0))).drop("_g", "_p", "_q")
    return out if alpha is None else out.withColumn("significant", F.col(q) < alpha)
