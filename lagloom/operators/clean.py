"""Cleaning and standardising of long series: keys, t, value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """NaN and infinities become null; everything here treats null as missing."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def dense(df: DataFrame, times: DataFrame, keys: DataFrame, t: str = "t") -> DataFrame:
    """One row per time and key, null where nothing was measured. Times are the steps of a calendar and go to every task; keys may be many."""
    grid = keys.crossJoin(F.broadcast(times)).select(t, *keys.columns)  # one row per calendar step
    return grid.join(df.hint("shuffle_merge"), [t, *keys.columns], "left")


def drop_sparse(df: DataFrame, key: str, most_missing: float = 0.2, value: str = "value") -> DataFrame:
    """Keep keys whose share of missing values is at most ``most_missing``."""
    good = df.groupBy(key).agg(F.avg(F.when(F.col(value).isNull(), 1.0).otherwise(0.0)).alias("missing")).filter(F.col("missing") <= most_missing)
    return df.join(good.select(key), key, "left_semi")


def some_left(df: DataFrame) -> DataFrame:
    """``df``, or an error where nothing is left of it."""
    if not df.limit(1).count():
        raise ValueError("no node has enough values")
    return df


def fill_gaps(df: DataFrame, keys: list[str], limit: int = 6, t: str = "t", value: str = "value") -> DataFrame:
    """Linear interpolation up to ``limit`` steps from either end of a gap, then the last and the next value; 0 without any.

    Rows must be dense in t. In the middle of a gap of more than twice the limit the
    value reached ``limit`` steps from the left goes on.
    """
    order = Window.partitionBy(*keys).orderBy(t)
    back, ahead = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(t).alias("t"), F.col(value).alias("v")))
    p, n = F.last(known, True).over(back), F.first(known, True).over(ahead)
    df = df.withColumn("_p", p).withColumn("_n", n)
    since, until = F.col(t) - F.col("_p.t"), F.col("_n.t") - F.col(t)
    steps = F.when((since <= limit) | (until <= limit), since).otherwise(limit)
    filled = (
        F.when(F.col(value).isNotNull(), F.col(value))
        .when(F.col("_p").isNull(), F.coalesce(F.col("_n.v"), F.lit(0.0)))
        .when(F.col("_n").isNull(), F.col("_p.v"))
        .otherwise(F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * steps / (F.col("_n.t") - F.col("_p.t")))
    )
    return df.withColumn(value, filled).drop("_p", "_n")


def anomaly(df: DataFrame, keys: list[str], season: Column, value: str = "value") -> DataFrame:
    """Value minus the mean of its key and season."""
    return df.withColumn(value, F.col(value) - F.avg(value).over(Window.partitionBy(*keys, season)))


def rolling_anomaly(df: DataFrame, keys: list[str], width: int, t: str = "t", value: str = "value") -> DataFrame:
    """Value minus its centred rolling mean of ``width`` rows, of at least one value."""
    ahead = (width - 1) // 2
    w = Window.partitionBy(*keys).orderBy(t).rowsBetween(-(width // 2), ahead)
    return df.withColumn(value, F.col(value) - F.avg(value).over(w))


def difference(df: DataFrame, keys: list[str], t: str = "t", value: str = "value") -> DataFrame:
    """Change since the row before; the first row of each key goes."""
    w = Window.partitionBy(*keys).orderBy(t)
    return df.withColumn("_d", F.col(value) - F.lag(value).over(w)).withColumn("_r", F.row_number().over(w)).filter("_r > 1").withColumn(value, F.col("_d")).drop("_d", "_r")


def standardise(df: DataFrame, keys: list[str], value: str = "value", least: float = 1e-8) -> DataFrame:
    """Z-score per key with the population deviation; a deviation below ``least`` counts as 1, a missing result as 0."""
    w = Window.partitionBy(*keys)
    sd = F.stddev_pop(value).over(w)
    return df.withColumn(value, F.coalesce((F.col(value) - F.avg(value).over(w)) / F.when(sd < least, 1.0).otherwise(sd), F.lit(0.0)))


def fit_transform(df: DataFrame, keys: list[str], season: Column, training: Column, value: str = "value", least: float = 1e-8) -> DataFrame:
    """Seasonal means, mean and deviation from training rows only, applied to all rows."""
    rows = df.withColumn("_s", season).withColumn("_train", training)
    means = rows.filter("_train").groupBy(*keys, "_s").agg(F.avg(value).alias("_m"))
    rows = rows.join(means, [*keys, "_s"], "left").withColumn("_a", F.col(value) - F.col("_m"))
    scale = rows.filter("_train").groupBy(*keys).agg(F.avg("_a").alias("_c"), F.stddev_pop("_a").alias("_sd"))
    rows = rows.join(scale, keys, "left")
    return rows.withColumn(value, (F.col("_a") - F.col("_c")) / F.when(F.col("_sd") < least, 1.0).otherwise(F.col("_sd"))).drop("_s", "_m", "_a", "_c", "_sd", "_train")


def weekly_climate(df: DataFrame, keys: list[str]) -> DataFrame:
    """Anomalies from a 52-week season, standardised: the form that the lag tests read."""
    return standardise(anomaly(df, keys, F.col("t") % 52), keys)
