"""Dense vector autoregression: the lags of all series stand in the equation of each one.

The cross products of the design are added up per partition and then by row of the
matrix. That matrix has one row per design column, so its size is set by the number
of series and lags, never by the calendar; it is solved once on the driver, as
normal-equation solvers of Spark's own library do, and ``most`` bounds it. Everything
that needs residuals goes over the calendar in blocks that overlap by the bandwidth.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagloom.operators.lineage import written


def design(series: DataFrame, names: list[str], lags: list[int]) -> DataFrame:
    """t, x (intercept, then all series at the first lag, the second and so on), y (all series), for steps whose lags are all there.

    series: t, name, value. Steps at which a series is missing are left out.
    """
    wide = series.groupBy("t").pivot("name", names).agg(F.first("value")).dropna()
    wide = wide.select(F.col("t").cast("long").alias("t"), F.array(*[F.col(f"`{n}`").cast("double") for n in names]).alias("v"))
    rows = wide.withColumnRenamed("v", "y")
    for k in lags:
        rows = rows.join(wide.select((F.col("t") + k).alias("t"), F.col("v").alias(f"v{k}")).hint("shuffle_merge"), "t")
    return rows.select("t", F.concat(F.array(F.lit(1.0)), *[F.col(f"v{k}") for k in lags]).alias("x"), "y")


@dataclass
class Fit:
    """Coefficients (design columns by outcomes), inverse of the cross products, and what tells whether they can be trusted."""

    names: list[str]
    lags: list[int]
    n: int
    beta: np.ndarray
    inverse: np.ndarray
    rss: np.ndarray
    tss: np.ndarray
    condition: float
    normal_residual: float

    @property
    def p(self) -> int:
        return len(self.inverse)

    def column(self, name: str, lag: int) -> int:
        return 1 + self.lags.index(lag) * len(self.names) + self.names.index(name)

    def regressors(self) -> list[tuple[int, str, int]]:
        """Design column, series and lag of every regressor but the intercept."""
        return [(self.column(n, k), n, k) for k in self.lags for n in self.names]


def gram(rows: DataFrame, size: int) -> tuple[int, np.ndarray]:
    """Number of rows and cross products of x and y joined, ``size`` columns in all."""

    def partial(batches):
        g, n = np.zeros((size, size)), 0
        for b in batches:
            if b.num_rows:
                m = np.concatenate([b.column(i).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for i in (0, 1)], axis=1)
                g += m.T @ m
                n += len(m)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(list(g), pa.list_(pa.float64())), pa.array([n] * size, pa.int64())], ["i", "row", "n"])

    parts = rows.select("x", "y").mapInArrow(partial, "i int, row array<double>, n long")
    parts = written(parts.withColumn("part", F.spark_partition_id()), "gram")
    total = F.aggregate(F.collect_list("row"), F.array_repeat(F.lit(0.0), size), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    most = parts.agg(F.max("part")).first()[0] or 0
    while most:  # eight partial sums at a time, so that a task never holds those of all partitions
        parts = parts.groupBy("i", F.shiftright("part", 3).alias("part")).agg(total.alias("row"), F.sum("n").alias("n"))
        most >>= 3
    got = parts.orderBy("i").collect()  # one row per design column
    return (got[0].n, np.array([r.row for r in got])) if got else (0, np.zeros((size, size)))


def fit(rows: DataFrame, names: list[str], lags: list[int], most: int = 4096, least: float = 1e-12) -> Fit:
    """Least squares of all equations. A design whose columns depend on each other is an error, not a pseudo-inverse."""
    p, k = 1 + len(names) * len(lags), len(names)
    if p + k > most:
        raise ValueError(f"{p + k} columns; the matrix of cross products is bounded to {most}")
    n, g = gram(rows, p + k)
    scale = np.sqrt(np.maximum(np.diag(g)[:p], 0))
    if n <= p or not (scale > 0).all():
        raise ValueError("too few rows, or a design column that is zero")
    values = np.linalg.eigvalsh(g[:p, :p] / np.outer(scale, scale))
    if values[0] <= least * values[-1]:
        raise ValueError(f"the design has not full rank: eigenvalues from {values[0]:.3g} to {values[-1]:.3g}")
    inverse = np.linalg.inv(g[:p, :p] / np.outer(scale, scale)) / np.outer(scale, scale)
    beta = inverse @ g[:p, p:]
    rest = g[:p, p:] - g[:p, :p] @ beta
    rss = np.diag(g[p:, p:]) - (g[:p, p:] * beta).sum(axis=0)
    tss = np.diag(g[p:, p:]) - g[0, p:] ** 2 / n
    relative = float(np.abs(rest / np.outer(scale, np.sqrt(np.diag(g[p:, p:])))).max())
    return Fit(names, lags, n, beta, inverse, rss, tss, float(np.sqrt(values[-1] / values[0])), relative)


_SUMS = "test long, n long, meat double, cluster_ss double, clusters long, gain double, gg double, g2 double, gn double, rss double, rss_less double"


def sums(rows: DataFrame, model: Fit, tests: list[tuple[int, int]], bandwidth: int, cluster: int) -> DataFrame:
    """One row per test (design column, outcome) with all that its statistics need, over the rows given.

    With the training rows that is: the Bartlett sum of its scores and their sums by
    calendar cluster. With later rows: the gain of the frozen model over itself without
    that regressor (which the inverse gives exactly, without a refit) and the sums that
    its HAC error needs.
    """
    spark, block = rows.sparkSession, cluster * max(1, 512 // cluster)
    if bandwidth > block:
        raise ValueError("the bandwidth is longer than a block of the calendar")
    sent = spark.sparkContext.broadcast((model.beta, model.inverse, np.array(tests, np.int64).reshape(-1, 2)))  # size of the matrix, not of the data

    def one(key, df: pd.DataFrame) -> pd.DataFrame:
        beta, inverse, pairs = sent.value
        c, o = pairs[:, 0], pairs[:, 1]
        first = int(key[0]) * block - bandwidth
        size = block + bandwidth
        at = df["t"].to_numpy() - first
        x, y = np.stack(df["x"].to_numpy()), np.stack(df["y"].to_numpy())
        e = np.zeros((size, y.shape[1]))
        z = np.zeros((size, x.shape[1]))
        there = np.zeros(size)
        e[at], z[at], there[at] = y - x @ beta, x @ inverse / np.diag(inverse), 1
        own = slice(bandwidth, size)
        n = int(there[own].sum())
        if not n:
            return pd.DataFrame(columns=[f.split()[0] for f in _SUMS.split(", ")])
        out = []
        for lo in range(0, len(pairs), 512):
            zc, eo, b = z[:, c[lo : lo + 512]], e[:, o[lo : lo + 512]], beta[c[lo : lo + 512], o[lo : lo + 512]]
            s = zc * eo
            g = (zc * b) * (2 * eo + zc * b)
            by = s[own].reshape(block // cluster, cluster, -1).sum(axis=1)
            used = int((there[own].reshape(-1, cluster).sum(axis=1) > 0).sum())
            meat, gg, g2, gn = ((v[own] * v[own]).sum(axis=0) for v in (s, g, g, g))
            g2, gn = 2 * g[own].sum(axis=0), np.full(len(b), float(n))
            for h in range(1, bandwidth + 1):
                w, back = 2 * (1 - h / (bandwidth + 1)), slice(bandwidth - h, size - h)
                both = (there[own] * there[back])[:, None]
                meat += w * (s[own] * s[back]).sum(axis=0)
                gg += w * (g[own] * g[back]).sum(axis=0)
                g2 += w * ((g[own] + g[back]) * both).sum(axis=0)
                gn += w * both.sum()
            less = eo[own] + zc[own] * b
            out.append(pd.DataFrame({
                "test": np.arange(lo, lo + len(b)), "n": n, "meat": meat, "cluster_ss": (by * by).sum(axis=0), "clusters": used, "gain": g[own].sum(axis=0),
                "gg": gg, "g2": g2, "gn": gn, "rss": (eo[own] ** 2).sum(axis=0), "rss_less": (less * less).sum(axis=0),
            }))
        return pd.concat(out) if out else pd.DataFrame(columns=[f.split()[0] for f in _SUMS.split(", ")])

    b = F.floor(F.col("t") / block).cast("long")
    # the last steps of a block stand before the next one too
    at = F.explode(F.when(F.pmod("t", F.lit(block)) >= block - bandwidth, F.array(b, b + 1)).otherwise(F.array(b)))
    parts = rows.withColumn("block", at).groupBy("block").applyInPandas(one, _SUMS)
    names = [f.split()[0] for f in _SUMS.split(", ")][1:]
    return parts.groupBy("test").agg(*[F.sum(c).alias(c) for c in names])


def _named(spark, model: Fit, tests: list[tuple[int, int]]) -> DataFrame:
    at = {c: (n, k) for c, n, k in model.regressors()}
    rows = [(i, *at[c], model.names[o], float(model.beta[c, o]), float(model.inverse[c, c]), float(model.rss[o]), float(model.tss[o])) for i, (c, o) in enumerate(tests)]
    return spark.createDataFrame(rows, "test long, source string, lag int, target string, beta double, icc double, rss_all double, tss double")


def tested(rows: DataFrame, model: Fit, tests: list[tuple[int, int]], bandwidth: int = 4, cluster: int = 16) -> DataFrame:
    """source, lag, target, n, beta, se_ols, se_hac, se_cluster, clusters, delta_r2, partial_r2 of each test on the rows that the model was fitted to."""
    j = _named(rows.sparkSession, model, tests).join(sums(rows, model, tests, bandwidth, cluster).hint("shuffle_merge"), "test")
    df, k = F.lit(float(model.n - model.p)), F.col("clusters")
    drop = F.col("beta") * F.col("beta") / F.col("icc")
    return j.select(
        "source", "lag", "target", F.lit(model.n).cast("long").alias("n"), "beta", F.sqrt(F.col("rss_all") / df * F.col("icc")).alias("se_ols"),
        (F.sqrt(F.greatest("meat", F.lit(0.0)) * model.n / df) * F.col("icc")).alias("se_hac"),
        F.when(k > 1, F.sqrt(k / (k - 1) * (model.n - 1) / df * F.col("cluster_ss")) * F.col("icc")).alias("se_cluster"), "clusters",
        (drop / F.col("tss")).alias("delta_r2"), (drop / (F.col("rss_all") + drop)).alias("partial_r2"),
    )


def frozen_gains(rows: DataFrame, model: Fit, tests: list[tuple[int, int]], bandwidth: int = 4, cluster: int = 16) -> DataFrame:
    """source, lag, target, n, gain, se, relative_gain on rows that the model has not seen: loss without the regressor minus loss with it."""
    j = _named(rows.sparkSession, model, tests).join(sums(rows, model, tests, bandwidth, cluster).hint("shuffle_merge"), "test")
    mean = F.col("gain") / F.col("n")
    meat = F.greatest(F.col("gg") - mean * F.col("g2") + mean * mean * F.col("gn"), F.lit(0.0))
    return j.select(
        "source", "lag", "target", "n", mean.alias("gain"), (F.sqrt(meat * F.col("n") / (F.col("n") - 1)) / F.col("n")).alias("se"),
        (F.col("gain") / F.when(F.col("rss_less") > 0, F.col("rss_less"))).alias("relative_gain"),
    )
