"""Blocks of lagged sources tested together: one row per hypothesis carries its series, numpy does the fit.

Design columns are named by series and lag. All fits are least squares on the steps
that have every lag; a column that adds nothing to those before it makes the test
invalid (nulls), it is never dropped in silence.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagloom.operators.screen import bartlett

Term = tuple[str, int]  # series and lag; a negative lag is a step ahead


def bundle(series: DataFrame, by: str = "node", name: str = "variable") -> DataFrame:
    """One row per ``by``: first step and one array column per variable, from screen.series() rows on one calendar."""
    names = [r[0] for r in series.select(name).distinct().orderBy(name).collect()]  # the variables, a handful
    return series.groupBy(by, "first").pivot(name, names).agg(F.first("values"))


def columns(data: dict[str, np.ndarray], terms: list[Term], at: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(at)), *(data[s][at - k] for s, k in terms)], axis=1)


def steps(size: int, terms: list[Term]) -> np.ndarray:
    lags = [k for _, k in terms] + [0]
    return np.arange(max(lags), size + min(lags))


class Fit:
    """Least squares with what each tested column's statistics need."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.n, self.p = x, len(y), x.shape[1]
        norm = np.sqrt((x * x).sum(axis=0))
        s = np.linalg.svd(x / np.where(norm > 0, norm, 1), compute_uv=False)
        self.condition = float(s[0] / s[-1]) if s[-1] > 0 else math.inf
        if self.n <= self.p or not self.condition < 1e8:
            raise ValueError("the design has not full rank")
        r = np.linalg.qr(x / norm, mode="r")
        inner = np.linalg.inv(r)
        self.inverse = inner @ inner.T / np.outer(norm, norm)
        self.beta = self.inverse @ (x.T @ y)
        self.e = y - x @ self.beta
        self.rss = float(self.e @ self.e)

    def residual(self, c: int) -> np.ndarray:
        """What is left of column c once all others are taken out."""
        return self.x @ self.inverse[:, c] / self.inverse[c, c]

    def influence(self, c: int, at: np.ndarray, size: int) -> np.ndarray:
        """Influence on coefficient c on the whole calendar, zero where no row is."""
        v = np.zeros(size)
        v[at] = self.residual(c) * self.e * self.inverse[c, c] * math.sqrt(self.n / (self.n - self.p))
        return v

    def variance_fraction(self, c: int) -> float:
        """Share of the column's variance that the others don't explain: one over its inflation factor."""
        z = self.x[:, c] - self.x[:, c].mean()
        return float(1 / self.inverse[c, c] / (z @ z))


def covariance(v: np.ndarray, bandwidth: int) -> np.ndarray:
    """HAC covariance of several influence series (columns) on one calendar."""
    out = v.T @ v
    for h in range(1, min(bandwidth, len(v) - 1) + 1):
        g = v[h:].T @ v[:-h]
        out = out + (1 - h / (bandwidth + 1)) * (g + g.T)
    return out


def _mapped(rows: DataFrame, key: str, f, schema: str, names: list[str], types: list) -> DataFrame:
    """f(data by name, first step) gives tuples; the key stands before each of them."""
    series = [c for c in rows.columns if c not in (key, "first")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                data = {s: np.array(batch.column(k + 2)[i].values.to_numpy(zero_copy_only=False), np.float64) for k, s in enumerate(series)}
                out += [(batch.column(0)[i].as_py(), *r) for r in f(data, batch.column(1)[i].as_py())]
            cols = list(zip(*out, strict=True)) or [[]] * (len(names) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [batch.column(0).type, *types], strict=True)], [key, *names])

    return rows.select(key, "first", *series).mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, {schema}")


def block_tests(rows: DataFrame, key: str, target: str, controls: list[Term], block: list[Term], bandwidth: int = 4, mask=None) -> DataFrame:
    """For each column of ``block``: lag, n, beta, se_hac, variance_fraction, partial_r2; and of the whole block: wald, block_r2, condition.

    rows: bundle(). ``mask`` takes calendar steps and says which rows count.
    """
    names = ["series", "lag", "n", "beta", "se_hac", "variance_fraction", "partial_r2", "wald", "block_r2", "condition"]
    types = [pa.string(), pa.int64(), pa.int64(), *[pa.float64()] * 7]

    def one(data, first):
        y = data[target]
        at = steps(len(y), controls + block)
        if mask is not None:
            at = at[mask(first + at)]
        try:
            full, less = Fit(columns(data, controls + block, at), y[at]), Fit(columns(data, controls, at), y[at])
        except ValueError:
            return [(s, k, len(at), *[None] * 7) for s, k in block]
        cs = [1 + len(controls) + i for i in range(len(block))]
        v = np.stack([full.influence(c, at, len(y)) for c in cs], axis=1)
        b = full.beta[cs]
        wald = float(b @ np.linalg.solve(covariance(v, bandwidth), b))
        out = []
        for (s, k), c, w in zip(block, cs, v.T, strict=True):
            drop = full.beta[c] ** 2 / full.inverse[c, c]
            out.append((s, k, full.n, float(full.beta[c]), math.sqrt(max(0.0, bartlett(w, bandwidth))), full.variance_fraction(c), float(drop / (full.rss + drop)), wald, (less.rss - full.rss) / less.rss, full.condition))
        return out

    schema = "series string, lag long, n long, beta double, se_hac double, variance_fraction double, partial_r2 double, wald double, block_r2 double, condition double"
    return _mapped(rows, key, one, schema, names, types)


def frozen_windows(rows: DataFrame, key: str, target: str, controls: list[Term], block: list[Term], train: int, held: int, bandwidth: int = 4, segment: int = 52) -> DataFrame:
    """Gain of the frozen block on later steps, by segment of the calendar and for each column left out: dropped, segment, n, gain, se.

    The model with the block and the one without it are fitted to steps before
    ``train``; both are judged from ``held`` on. Leaving one column out follows from
    the inverse, without a refit. ``dropped`` is 'all' or the lag.
    """
    names, types = ["dropped", "segment", "n", "gain", "se"], [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def one(data, first):
        y = data[target]
        at = steps(len(y), controls + block)
        fit_at, test_at = at[first + at < train], at[first + at >= held]
        try:
            full, less = Fit(columns(data, controls + block, fit_at), y[fit_at]), Fit(columns(data, controls, fit_at), y[fit_at])
        except ValueError:
            return []
        x = columns(data, controls + block, test_at)
        e = y[test_at] - x @ full.beta
        gains = {"all": (y[test_at] - columns(data, controls, test_at) @ less.beta) ** 2 - e * e}
        for i, (_, k) in enumerate(block):
            c = 1 + len(controls) + i
            d = x @ full.inverse[:, c] * (full.beta[c] / full.inverse[c, c])
            gains[str(k)] = (e + d) ** 2 - e * e
        out = []
        part = (first + test_at) // segment
        for name, g in gains.items():
            for s in np.unique(part):
                on = part == s
                v = np.zeros(len(y))
                v[test_at[on]] = g[on] - g[on].mean()
                n = int(on.sum())
                se = math.sqrt(max(0.0, bartlett(v, bandwidth)) * n / (n - 1)) / n if n > 1 else None
                out.append((name, int(s), n, float(g[on].mean()), se))
        return out

    return _mapped(rows, key, one, "dropped string, segment long, n long, gain double, se double", names, types)


def slopes(rows: DataFrame, key: str, fits: dict[str, tuple[str, list[Term], Term]], bandwidth: int = 4, span: tuple[int, int] | None = None) -> DataFrame:
    """Several slopes per row: name, n, beta, se_ols, se_hac, condition. Each fit is (target, controls, tested term); ``span`` keeps steps from its first to before its second."""
    names, types = ["name", "n", "beta", "se_ols", "se_hac", "condition"], [pa.string(), pa.int64(), *[pa.float64()] * 4]

    def one(data, first):
        out = []
        for name, (target, controls, term) in fits.items():
            y = data[target]
            at = steps(len(y), [*controls, term])
            if span is not None:
                at = at[(first + at >= span[0]) & (first + at < span[1])]
            try:
                f = Fit(columns(data, [*controls, term], at), y[at])
            except ValueError:
                out.append((name, len(at), None, None, None, None))
                continue
            c = f.p - 1
            se = math.sqrt(max(0.0, bartlett(f.influence(c, at, len(y)), bandwidth)))
            out.append((name, f.n, float(f.beta[c]), math.sqrt(f.rss / (f.n - f.p) * f.inverse[c, c]), se, f.condition))
        return out

    return _mapped(rows, key, one, "name string, n long, beta double, se_ols double, se_hac double, condition double", names, types)


def group_slopes(rows: DataFrame, key: str, target: str, controls: list[Term], term: Term, groups: dict[str, tuple[int, int, int]], bandwidth: int = 4) -> DataFrame:
    """Slope of each group of the calendar and the difference of the first two: name, n, beta, se_hac, variance_fraction, residual_fraction.

    The difference takes the influences of both groups on one calendar, so that their
    common shocks count.
    """
    names, types = ["name", "n", "beta", "se_hac", "variance_fraction", "residual_fraction"], [pa.string(), pa.int64(), *[pa.float64()] * 4]

    def one(data, first):
        y, out, parts = data[target], [], []
        at = steps(len(y), [*controls, term])
        for name, (period, a, b) in groups.items():
            on = at[((first + at) % period >= a) & ((first + at) % period < b)]
            try:
                f = Fit(columns(data, [*controls, term], on), y[on])
            except ValueError:
                return [(g, None, None, None, None, None) for g in [*groups, "difference"]]
            v = f.influence(f.p - 1, on, len(y))
            parts.append((float(f.beta[-1]), v, f.n))
            tss = float(((y[on] - y[on].mean()) ** 2).sum())
            out.append((name, f.n, float(f.beta[-1]), math.sqrt(max(0.0, bartlett(v, bandwidth))), f.variance_fraction(f.p - 1), f.rss / tss))
        (b1, v1, n1), (b2, v2, n2) = parts[:2]
        out.append(("difference", n1 + n2, b1 - b2, math.sqrt(max(0.0, bartlett(v1 - v2, bandwidth))), None, None))
        return out

    return _mapped(rows, key, one, "name string, n long, beta double, se_hac double, variance_fraction double, residual_fraction double", names, types)


def projection_tests(pairs: DataFrame, rows: DataFrame, key: str, east: str, north: str, target: str, source: str, train: int, held: int, lags: int = 3, own: int = 3, season: int = 52, bandwidth: int = 4) -> DataFrame:
    """A source's vector, turned to the bearing of its edge, beside own history and the source's size: per lag n, beta, se_hac, and what it gains on later steps.

    pairs: source, target, bearing (radians); rows: bundle(). The projection loses its
    seasonal mean and is scaled by the steps before ``train``; the test is made, and the frozen
    model judged, on steps from ``held`` on. Columns: source, target, lag, n, beta, se_hac,
    n_held, gain, gain_se. A pair carries five series of the calendar's length.
    """
    s = rows.select(F.col(key).alias("source"), F.col("first").alias("f1"), F.col(source).alias("x"), F.col(east).alias("e"), F.col(north).alias("n"))
    t = rows.select(F.col(key).alias("target"), F.col("first").alias("f2"), F.col(target).alias("y"))
    j = pairs.select("source", "target", "bearing").join(s.hint("shuffle_merge"), "source").join(t.hint("shuffle_merge"), "target")
    j = j.filter("f1 = f2").select("source", "target", "bearing", F.col("f1").alias("first"), "y", "x", "e", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                a, b, bearing, first = (batch.column(c)[i].as_py() for c in range(4))
                y, x, e, n = (np.array(batch.column(c)[i].values.to_numpy(zero_copy_only=False), np.float64) for c in range(4, 8))
                steps_ = first + np.arange(len(y))
                past, p = steps_ < train, e * math.sin(bearing) + n * math.cos(bearing)
                for s in range(season):
                    at = steps_ % season == s
                    if (at & past).any():
                        p[at] -= p[at & past].mean()
                sd = p[past].std()
                p = (p - p[past].mean()) / (sd if sd > 1e-8 else 1.0)
                data = {"y": y, "x": x, "p": p}
                for lag in range(1, lags + 1):
                    base = [*(("y", k) for k in range(1, own + 1)), ("x", lag)]
                    at = steps(len(y), [*base, ("p", lag)])
                    fit_at, test_at = at[first + at < train], at[first + at >= held]
                    try:
                        later = Fit(columns(data, [*base, ("p", lag)], test_at), y[test_at])
                        full, less = Fit(columns(data, [*base, ("p", lag)], fit_at), y[fit_at]), Fit(columns(data, base, fit_at), y[fit_at])
                    except ValueError:
                        continue
                    c = later.p - 1
                    se = math.sqrt(max(0.0, bartlett(later.influence(c, test_at, len(y)), bandwidth)))
                    g = (y[test_at] - columns(data, base, test_at) @ less.beta) ** 2 - (y[test_at] - columns(data, [*base, ("p", lag)], test_at) @ full.beta) ** 2
                    v, m = np.zeros(len(y)), len(test_at)
                    v[test_at] = g - g.mean()
                    out.append((a, b, lag, later.n, float(later.beta[c]), se, m, float(g.mean()), math.sqrt(max(0.0, bartlett(v, bandwidth)) * m / (m - 1)) / m))
            cols = list(zip(*out, strict=True)) or [[]] * 9
            types = [batch.column(0).type, batch.column(1).type, pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["source", "target", "lag", "n", "beta", "se_hac", "n_held", "gain", "gain_se"])

    kind = lambda c: j.schema[c].dataType.simpleString()
    return j.mapInArrow(run, f"source {kind('source')}, target {kind('target')}, lag long, n long, beta double, se_hac double, n_held long, gain double, gain_se double")
