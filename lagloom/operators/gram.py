"""Least squares from sums of products: one aggregation per hypothesis, small solves afterwards."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_D, _A = T.DoubleType(), T.ArrayType(T.DoubleType())
_SOLVED = T.StructType([T.StructField(n, t) for n, t in (("zss", _D), ("zy", _D), ("rss_r", _D), ("rank", T.IntegerType()), ("gz", _A), ("gy", _A))])


def _solve(g: np.ndarray, tol: float = 1e-12) -> tuple:
    """Residualise the last two columns (z, y) of a Gram matrix by the others, leaving out dependent controls."""
    p = len(g) - 2
    keep: list[int] = []
    left = g[:p, :p].copy()
    scale = np.diag(left).copy()
    for _ in range(p):  # pivoted Cholesky: a control whose rest is nothing adds no rank
        d = np.where(scale > 0, np.diag(left) / np.where(scale > 0, scale, 1), 0)
        d[keep] = 0
        i = int(d.argmax()) if p else 0
        if not p or d[i] <= tol:
            break
        keep.append(i)
        left = left - np.outer(left[:, i], left[i]) / left[i, i]
    gz, gy = np.zeros(p), np.zeros(p)
    if keep:
        a = g[np.ix_(keep, keep)]
        gz[keep], gy[keep] = np.linalg.solve(a, g[keep, p]), np.linalg.solve(a, g[keep, p + 1])
    zss = g[p, p] - g[p, :p] @ gz
    zy = g[p, p + 1] - g[p, :p] @ gy
    rss = g[p + 1, p + 1] - g[p + 1, :p] @ gy
    return float(zss), float(zy), float(rss), len(keep), gz.tolist(), gy.tolist()


@F.pandas_udf(_SOLVED)
def _residualise(flat: pd.Series) -> pd.DataFrame:
    rows = []
    for v in flat:
        k = int(round((math.sqrt(8 * len(v) + 1) - 1) / 2))
        g = np.zeros((k, k))
        g[np.triu_indices(k)] = v
        rows.append(_solve(g + np.triu(g, 1).T))
    return pd.DataFrame(rows, columns=["zss", "zy", "rss_r", "rank", "gz", "gy"])


def fit(rows: DataFrame, keys: list[str], controls: list[str], z: str = "z", y: str = "y") -> DataFrame:
    """Per hypothesis: n, tss, what is left of z and y once the intercept and the controls are taken out, and the tested slope.

    One map-side combined aggregation of (p + 3)(p + 2) / 2 sums; the solve sees one small row per hypothesis.
    """
    cols = [F.lit(1.0), *[F.col(c) for c in controls], F.col(z), F.col(y)]
    sums = [F.sum(cols[i] * cols[j]) for i in range(len(cols)) for j in range(i, len(cols))]
    g = rows.groupBy(*keys).agg(F.count("*").alias("n"), (F.var_pop(y) * F.count("*")).alias("tss"), F.array(*sums).alias("gram"))
    g = g.withColumn("s", _residualise("gram")).select(*keys, "n", "tss", "s.*")
    ok = F.col("zss") > 1e-12
    g = g.withColumn("beta", F.when(ok, F.col("zy") / F.col("zss"))).withColumn("drop", F.when(ok, F.greatest(F.col("zy") * F.col("zy") / F.col("zss"), F.lit(0.0))))
    g = g.withColumn("rss_f", F.greatest(F.col("rss_r") - F.col("drop"), F.lit(1e-18))).withColumn("df", F.col("n") - F.col("rank") - 1)
    return g.withColumn("f", F.col("drop") / (F.col("rss_f") / F.col("df"))).withColumn("se", F.sqrt(F.col("rss_f") / F.col("df") / F.col("zss")))


def scores(rows: DataFrame, fits: DataFrame, keys: list[str], controls: list[str], z: str = "z", y: str = "y") -> DataFrame:
    """Rows with residuals zr and e and the score zr * e of the tested slope."""
    cols = [F.lit(1.0), *[F.col(c) for c in controls]]
    part = lambda name: sum((c * F.col(name)[i] for i, c in enumerate(cols)), F.lit(0.0))
    r = rows.join(fits.select(*keys, "gz", "gy", "beta", "zss", "n", "df").hint("shuffle_merge"), keys)
    r = r.withColumn("zr", F.col(z) - part("gz")).withColumn("e", F.col(y) - part("gy") - F.col("zr") * F.col("beta"))
    return r.withColumn("score", F.col("zr") * F.col("e")).drop("gz", "gy")


def bartlett(series: DataFrame, keys: list[str], bandwidth: int, value: str = "score", t: str = "t") -> DataFrame:
    """Bartlett-weighted sum of autocovariances on the calendar, as a sum of squared moving sums.

    Steps without a row count as zero: moving sums of ``bandwidth`` + 1 steps change
    only where a row enters or leaves, so each row enters at t and leaves at
    t + bandwidth + 1, and the square of the level between two events is weighted by
    their distance.
    """
    enter = series.select(*keys, F.col(t).alias("at"), F.col(value).alias("v"))
    events = enter.unionByName(enter.select(*keys, (F.col("at") + bandwidth + 1).alias("at"), (-F.col("v")).alias("v"))).groupBy(*keys, "at").agg(F.sum("v").alias("v"))
    w = Window.partitionBy(*keys).orderBy("at")
    level = F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0))
    lasting = F.coalesce(F.lead("at").over(w) - F.col("at"), F.lit(0))
    return events.select(*keys, (level * level * lasting).alias("x")).groupBy(*keys).agg((F.sum("x") / (bandwidth + 1)).alias("meat"))


def hac(rows: DataFrame, keys: list[str], controls: list[str], bandwidth: int, z: str = "z", y: str = "y") -> DataFrame:
    """fit() with the HAC standard error se_hac; t is the calendar step of a row."""
    f = fit(rows, keys, controls, z, y)
    meat = bartlett(scores(rows, f, keys, controls, z, y), keys, bandwidth)
    return f.join(meat.hint("shuffle_merge"), keys).withColumn("se_hac", F.sqrt(F.col("meat") * F.col("n") / F.col("df")) / F.col("zss"))


def clusters(scored: DataFrame, keys: list[str], length: int, t: str = "t") -> DataFrame:
    """Calendar-block CR1 standard error from scores: se_cluster and the number of blocks."""
    b = scored.groupBy(*keys, F.floor(F.col(t) / length).alias("b")).agg(F.sum("score").alias("s"), F.first("n").alias("n"), F.first("df").alias("df"), F.first("zss").alias("zss"))
    g = b.groupBy(*keys).agg(F.count("*").alias("blocks"), F.sum(F.col("s") * F.col("s")).alias("ss"), F.first("n").alias("n"), F.first("df").alias("df"), F.first("zss").alias("zss"))
    k = F.col("blocks") / (F.col("blocks") - 1) * (F.col("n") - 1) / F.col("df")
    return g.select(*keys, "blocks", F.when(F.col("blocks") > 1, F.sqrt(k * F.col("ss")) / F.col("zss")).alias("se_cluster"))


def mean_hac(df: DataFrame, keys: list[str], value: str, bandwidth: int, t: str = "t") -> DataFrame:
    """Mean of a series with its HAC standard error (factor n / (n - 1))."""
    w = Window.partitionBy(*keys)
    c = df.withColumn("_c", F.col(value) - F.avg(value).over(w))
    m = df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return m.join(bartlett(c, keys, bandwidth, "_c", t), keys).withColumn("se", F.sqrt(F.col("meat") * F.col("n") / (F.col("n") - 1)) / F.col("n")).drop("meat")


def lag_design(panel: DataFrame, source: str, target: str, lags: int, own: int) -> DataFrame:
    """t, target, source, lag, y, c1..c_own, z: the target's value, its own past and the source's value ``lag`` steps before.

    panel: t, node, variable, value. Rows meet by calendar step, never by position.
    """
    y = panel.filter(F.col("variable") == target).select("t", F.col("node").alias("target"), F.col("value").alias("y"))
    rows = y
    for k in range(1, own + 1):
        rows = rows.join(y.select((F.col("t") + k).alias("t"), "target", F.col("y").alias(f"c{k}")), ["t", "target"])
    x = panel.filter(F.col("variable") == source).select("t", F.col("node").alias("source"), F.col("value").alias("z"))
    x = x.withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(lags)))).withColumn("t", F.col("t") + F.col("lag"))
    return rows.join(x, "t")
