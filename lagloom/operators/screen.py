"""Lag tests of very many candidates at once: one row per target carries its sources, numpy does the sums.

A series is one row per node and variable with its values in calendar order; its
length is that of the calendar. Candidates meet the series of their source by a join and
are gathered by target region, a bounded number in a row, so what a target's tests share (its
own past and the factors of it) is computed once; Spark deals the target regions out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagloom.functions.tails import t_tail_whole
from lagloom.operators import panels

TESTED = "lag long, regime string, n long, effect double, se_ols double, se_hac double, p_value double, partial_r2 double"
#: Seasons of a year of 52 weeks: period and the steps [from, to) within it.
SEASONS = {"winter": (52, 0, 26), "summer": (52, 26, 52)}


def series(df: DataFrame, keys: tuple[str, ...] = ("node", "variable"), t: str = "t", value: str = "value") -> DataFrame:
    """keys, first (calendar step) and values of every dense series."""
    g = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(t).cast("long").alias("t"), F.col(value).alias("v")))).alias("s"))
    return g.select(*keys, F.col("s")[0]["t"].alias("first"), F.transform("s", lambda x: x["v"]).alias("values"))


def residualised(controls: np.ndarray, *columns: np.ndarray) -> tuple[int, list[np.ndarray]]:
    """Rank of the controls, and what is left of the columns once they are taken out; dependent controls add nothing."""
    u, s, _ = np.linalg.svd(controls, full_matrices=False)
    u = u[:, s > s.max(initial=0) * 1e-10]
    return u.shape[1], [c - u @ (u.T @ c) for c in columns]


def bartlett(score: np.ndarray, bandwidth: int) -> np.ndarray:
    """Weighted sum of autocovariances of scores on the calendar, of each column; steps outside the sample are zeros."""
    out = (score * score).sum(axis=0)
    for h in range(1, min(bandwidth, len(score) - 1) + 1):
        out = out + 2 * (1 - h / (bandwidth + 1)) * (score[h:] * score[:-h]).sum(axis=0)
    return out


def clustered(score: np.ndarray, first: int, on: np.ndarray, length: int) -> tuple[np.ndarray, int]:
    """Sum of squared block sums of scores, and the number of calendar blocks of ``length`` steps that hold rows."""
    block = (first + np.arange(len(score))) // length
    at = np.flatnonzero(np.diff(block, prepend=block[0] - 1))
    return (np.add.reduceat(score, at, axis=0) ** 2).sum(axis=0), len(np.unique(block[on]))


class Tests:
    """Each column of ``z`` alone beside the same controls: the controls are factored once for all of them.

    y, controls (with the intercept) and z hold the rows ``on`` of a calendar of ``size`` steps
    that begins with ``first``. ``valid`` is false for columns that hold nothing the controls don't.
    """

    def __init__(self, y: np.ndarray, controls: np.ndarray, z: np.ndarray, on: np.ndarray, size: int, first: int = 0):
        self.on, self.size, self.first, self.n = on, size, first, len(on)
        self.rank, (yr, zr) = residualised(controls, y, z)
        self.df = self.n - self.rank - 1
        self.zss = (zr * zr).sum(axis=0)
        self.valid = (self.zss > 1e-12) & (self.df > 0)
        self.zss = np.where(self.valid, self.zss, 1.0)
        self.beta = zr.T @ yr / self.zss
        e = yr[:, None] - zr * self.beta
        self.rss = (e * e).sum(axis=0)
        self.score = np.zeros((size, z.shape[1]))
        self.score[on] = zr * e
        drop = self.beta * self.beta * self.zss
        self.partial_r2 = np.divide(drop, self.rss + drop, out=np.zeros_like(drop), where=self.rss + drop > 0)
        self.se_ols = np.sqrt(self.rss / max(self.df, 1) / self.zss)

    def se_hac(self, bandwidth: int) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, bartlett(self.score, bandwidth)) * self.n / max(self.df, 1)) / self.zss

    def se_cluster(self, length: int) -> tuple[np.ndarray, int]:
        """CR1 errors by calendar blocks, and their number."""
        meat, g = clustered(self.score, self.first, self.on, length)
        return np.sqrt(meat * (g / max(g - 1, 1)) * ((self.n - 1) / max(self.df, 1))) / self.zss, g

    def influence(self) -> np.ndarray:
        return self.score / self.zss * math.sqrt(self.n / max(self.df, 1))


def normal_p(beta: np.ndarray, se: np.ndarray) -> list[float]:
    return [math.erfc(abs(b) / s / math.sqrt(2)) if s > 0 else 0.0 if b else 1.0 for b, s in zip(beta.tolist(), se.tolist(), strict=True)]


def lag_design(y: np.ndarray, x: np.ndarray, first: int, lag: int, mask, own: int) -> tuple | None:
    """Tests of every column of x ``lag`` steps back in y, given an intercept and ``own`` steps of y's past.

    Lags are formed on the calendar and the mask is applied afterwards. None where the rows don't suffice.
    """
    start = max(own, lag)
    on = np.flatnonzero(mask(first + np.arange(start, len(y)))) + start
    if len(on) < own + 4:
        return None
    controls = np.stack([np.ones(len(on)), *(y[on - k] for k in range(1, own + 1))], axis=1)
    return Tests(y[on], controls, x[on - lag], on, len(y), first)


_KEY = ["source_region", "target_region", "source_var", "target_var"]


def _by_target(candidates: DataFrame, given: DataFrame, most: int = 64) -> DataFrame:
    """One row per target region: its own series, and its sources with the links wanted and the series that they need.

    Regions of more than ``most`` sources are split. A source's series reach a region once, whatever
    the number of its variables they are tested on; a region's own series are not sent to it again.
    """
    c = candidates.select(*_KEY).distinct()
    link = c.groupBy("target_region", "source_region").agg(F.collect_list(F.struct("source_var", "target_var")).alias("links"))
    size = link.groupBy("target_region").agg(F.ceil(F.count("*") / most).alias("parts"))
    link = link.join(size.hint("shuffle_merge"), "target_region").withColumn("part", F.pmod(F.xxhash64("source_region"), F.col("parts"))).drop("parts")
    held = given.groupBy("node").agg(F.collect_list(F.struct("variable", "first", "values")).alias("held"))  # a row per node, both joins read one exchange
    of = lambda s, name: held.select(F.col("node").alias(f"{s}_region"), F.col("held").alias(name))
    own = F.col("source_region") == F.col("target_region")
    sent = link.filter(~own).join(of("source", "series").hint("shuffle_merge"), "source_region")
    sent = sent.withColumn("series", F.filter("series", lambda v: F.exists("links", lambda w: w["source_var"] == v["variable"])))
    there = link.filter(own).withColumn("series", F.lit(None).cast(sent.schema["series"].dataType))
    s = sent.select(*there.columns).unionByName(there).repartition("target_region")  # serves the gathering and the join after it
    g = s.groupBy("target_region", "part").agg(F.collect_list(F.struct("source_region", "links", "series")).alias("sources"))
    return g.join(of("target", "own").hint("shuffle_merge"), "target_region").select("target_region", "own", "sources")


def _series(col: pa.ListArray) -> list[dict]:
    """Of each row its series by variable: first step and values."""
    at, flat = col.offsets.to_pylist(), col.values
    var, first, held = flat.field("variable").to_pylist(), flat.field("first").to_pylist(), flat.field("values")
    ends, values = held.offsets.to_pylist(), np.array(held.values.to_numpy(zero_copy_only=False), np.float64)
    return [{var[i]: (first[i], values[ends[i] : ends[i + 1]]) for i in range(a, b)} for a, b in zip(at, at[1:])]


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[tuple, list[tuple], int, np.ndarray, np.ndarray]]:
    """Target, sources, first step, y and x (a column per source) on the calendar they share; sources on other calendars come apart."""
    regions, own, sources = batch.column(0).to_pylist(), _series(batch.column(1)), batch.column(2)
    at, flat = sources.offsets.to_pylist(), sources.values
    source, links, series = flat.field("source_region").to_pylist(), flat.field("links").to_pylist(), _series(flat.field("series"))
    for i, region in enumerate(regions):
        spans: dict[tuple[str, int, int], list] = {}
        for j in range(at[i], at[i + 1]):
            held = own[i] if source[j] == region else series[j]
            for link in links[j]:
                sv, tv = link["source_var"], link["target_var"]
                if sv not in held or tv not in own[i]:
                    continue
                (fx, x), (fy, y) = held[sv], own[i][tv]
                first, last = max(fy, fx), min(fy + len(y), fx + len(x))
                spans.setdefault((tv, first, max(first, last)), []).append(((source[j], sv), x[first - fx : max(first, last) - fx]))
        for (tv, first, last), found in spans.items():
            fy, y = own[i][tv]
            yield (region, tv), [k for k, _ in found], first, y[first - fy : last - fy], np.stack([x for _, x in found], axis=1)


def _masks(regimes: dict[str, tuple[int, int, int]]) -> dict:
    return {r: (lambda t, p=p, a=a, b=b: (t % p >= a) & (t % p < b)) for r, (p, a, b) in regimes.items()}


def _kinds(candidates: DataFrame) -> str:
    return ", ".join(f"{c} {candidates.schema[c].dataType.simpleString()}" for c in _KEY)


def _mapped(candidates: DataFrame, given: DataFrame, f, schema: str, names: list[str], types: list) -> DataFrame:
    """``f`` of each group of sources gives (number of the source, *values); the candidate stands before each."""
    rows = _by_target(candidates, given)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for target, found, first, y, x in _groups(batch):
                out += [(found[j][0], target[0], found[j][1], target[1], *r) for j, *r in f(target, found, first, y, x)]
            region = batch.column(0).type
            cols = list(zip(*out, strict=True)) or [[]] * (len(names) + 4)
            kind = [region, region, pa.string(), pa.string(), *types]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kind, strict=True)], [*_KEY, *names])

    return rows.mapInArrow(run, f"{_kinds(candidates)}, {schema}")


def _together(groups: Iterator[tuple], most: int = 256) -> Iterator[list[tuple]]:
    """Groups of one calendar, about ``most`` sources at a time."""
    held: dict[tuple[int, int], list] = {}
    for g in groups:
        on = held.setdefault((g[2], len(g[3])), [])
        on.append(g)
        if sum(len(h[1]) for h in on) >= most:
            yield held.pop((g[2], len(g[3])))
    yield from held.values()


def own_lag_tests(y: np.ndarray, x: np.ndarray, of: np.ndarray, first: int, lag: int, mask, own: int, bandwidth: int) -> tuple | None:
    """lag_design() of many targets of one calendar at once, for the rows of x: valid, n, effect, se_ols, se_hac, partial_r2.

    ``of`` names the row of y that a row of x is tested on. None where the rows don't suffice.
    """
    start, size = max(own, lag), y.shape[1]
    on = np.flatnonzero(mask(first + np.arange(start, size))) + start
    n = len(on)
    if n < own + 4:
        return None
    u, s, _ = np.linalg.svd(np.stack([np.ones((len(y), n)), *(y[:, on - k] for k in range(1, own + 1))], axis=2), full_matrices=False)
    kept = s > s.max(axis=1, keepdims=True) * 1e-10
    u = u * kept[:, None, :]
    left = lambda u, v: v - (u @ (v[:, None, :] @ u).transpose(0, 2, 1))[:, :, 0]
    yr, zr = left(u, y[:, on])[of], left(u[of], x[:, on - lag])
    df = (n - kept.sum(axis=1) - 1)[of]
    zss = (zr * zr).sum(axis=1)
    valid = (zss > 1e-12) & (df > 0)
    zss, some = np.where(valid, zss, 1.0), np.maximum(df, 1)
    beta = (zr * yr).sum(axis=1) / zss
    e = yr - zr * beta[:, None]
    rss, drop = (e * e).sum(axis=1), beta * beta * zss
    score = np.zeros((len(x), size))
    score[:, on] = zr * e
    se_hac = np.sqrt(np.maximum(0.0, bartlett(score.T, bandwidth)) * n / some) / zss
    return valid, n, beta, np.sqrt(rss / some / zss), se_hac, np.divide(drop, rss + drop, out=np.zeros_like(drop), where=rss + drop > 0)


def screen(candidates: DataFrame, given: DataFrame, lags: int = 3, own: int = 1, bandwidth: int = 4, regimes: dict[str, tuple[int, int, int]] | None = None) -> DataFrame:
    """Every candidate (source_region, target_region, source_var, target_var) with one row per lag and regime: n, effect, se_ols, se_hac, p_value, partial_r2.

    given: series() of all regions and variables. Tests that can't be made have nulls.
    A candidate without one of its series has no rows. ``regimes`` names repeated parts of the
    calendar as (period, from, to). The controls of a target are factored once per lag and
    regime for all its sources; numpy takes the targets of one calendar together.
    """
    masks = _masks(regimes or SEASONS)
    names = [*_KEY, "lag", "regime", "n", "effect", "se_ols", "se_hac", "p_value", "partial_r2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for groups in _together(_groups(batch)):
                of, first = np.repeat(np.arange(len(groups)), [len(g[1]) for g in groups]), groups[0][2]
                y, x = np.stack([g[3] for g in groups]), np.concatenate([g[4].T for g in groups])
                key = [(r, target[0], v, target[1]) for target, found, *_ in groups for r, v in found]
                key = [pa.array(c, t) for c, t in zip(zip(*key, strict=True), [batch.column(0).type] * 2 + [pa.string()] * 2, strict=True)]
                for name, mask in masks.items():
                    for lag in range(1, lags + 1):
                        t = own_lag_tests(y, x, of, first, lag, mask, own, bandwidth)
                        valid, n, beta, se_ols, se, r2 = t or [np.zeros(len(x), bool), 0, *[np.zeros(len(x))] * 4]
                        value = lambda v: pa.array(v, mask=~valid)  # noqa: B023, E731
                        p = np.array(normal_p(beta, se))
                        cols = [value(np.full(len(x), n)), *map(value, (beta, se_ols, se, p, r2))]
                        yield pa.RecordBatch.from_arrays([*key, pa.array(np.full(len(x), lag)), pa.array([name] * len(x)), *cols], names)

    return _by_target(candidates, given).mapInArrow(run, f"{_kinds(candidates)}, {TESTED}")


def correlations(candidates: DataFrame, given: DataFrame, lag: int = 1) -> DataFrame:
    """Every candidate with c, the correlation of its target's series with its source's ``lag`` steps before; NaN where one of them is constant.

    given: series() of all regions and variables. Candidates without one of their series, or of no more than ``lag`` steps, have no rows.
    """
    names = [*_KEY, "c"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for groups in _together(g for g in _groups(batch) if len(g[3]) > lag):
                of = np.repeat(np.arange(len(groups)), [len(g[1]) for g in groups])
                y, x = _centred(np.stack([g[3][lag:] for g in groups])), _centred(np.concatenate([g[4][:-lag].T for g in groups]))
                with np.errstate(invalid="ignore"):
                    c = (x * y[of]).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1))[of])
                key = [(r, target[0], v, target[1]) for target, found, *_ in groups for r, v in found]
                key = [pa.array(k, t) for k, t in zip(zip(*key, strict=True), [batch.column(0).type] * 2 + [pa.string()] * 2, strict=True)]
                yield pa.RecordBatch.from_arrays([*key, pa.array(c)], names)

    return _by_target(candidates, given).mapInArrow(run, f"{_kinds(candidates)}, c double")


def _centred(rows: np.ndarray) -> np.ndarray:
    """Rows without their means; those of a constant row are exactly 0."""
    rows = rows - rows[:, :1]
    return rows - rows.mean(axis=1, keepdims=True)


def common_controls(candidates: DataFrame, given: DataFrame, lags: int = 3, bandwidths: tuple[int, ...] = (4, 8), blocks: tuple[int, ...] = (), regimes: dict[str, tuple[int, int, int]] | None = None) -> DataFrame:
    """Every source lag beside all ``lags`` own lags of its target, on the same steps for every lag.

    One factorisation per target and regime serves all sources and lags. Where a tested
    column is itself a control (a region's own variable), that control leaves the fit.
    Columns: lag, regime, n, n_controls, effect, se_ols, then se and p for each HAC bandwidth
    (``se_hac4``) and block length (``se_cluster13``, with t of the number of blocks less one).
    """
    masks = _masks(regimes or SEASONS)

    def one(target, found, first, y, x):
        at = np.arange(lags, len(y))
        past = {k: y[at - k] for k in range(1, lags + 1)}
        for name, mask in masks.items():
            keep = mask(first + at)
            on = at[keep]
            plain = [j for j, s in enumerate(found) if s != target]
            fits = []
            if len(on) > lags + 4:
                control = [np.ones(len(on)), *(past[k][keep] for k in past)]
                if plain:
                    z = np.concatenate([x[on - k][:, plain] for k in past], axis=1)
                    fits.append(([(j, k) for k in past for j in plain], lags, Tests(y[on], np.stack(control, axis=1), z, on, len(y), first)))
                for j in (j for j, s in enumerate(found) if s == target):
                    for k in past:
                        less = np.stack([c for i, c in enumerate(control) if i != k], axis=1)
                        fits.append(([(j, k)], lags - 1, Tests(y[on], less, x[on - k][:, [j]], on, len(y), first)))
            for tested, n_controls, t in fits:
                errors = []
                for b in bandwidths:
                    se = t.se_hac(b)
                    errors += [se.tolist(), normal_p(t.beta, se)]
                for b in blocks:
                    se, g = t.se_cluster(b)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        errors += [se.tolist(), t_tail_whole(t.beta / se, max(g - 1, 1)).tolist()]
                for c, (j, k) in enumerate(tested):
                    if t.valid[c]:
                        yield (j, k, name, t.n, n_controls, float(t.beta[c]), float(t.se_ols[c]), *(e[c] for e in errors))
                    else:
                        yield (j, k, name, t.n, n_controls, *[None] * (2 + len(errors)))

    extra = [f"{s}_{m}{b}" for m, bs in (("hac", bandwidths), ("cluster", blocks)) for b in bs for s in ("se", "p")]
    names = ["lag", "regime", "n", "n_controls", "effect", "se_ols", *extra]
    schema = "lag long, regime string, n long, n_controls long, effect double, se_ols double" + "".join(f", {e} double" for e in extra)
    return _mapped(candidates, given, one, schema, names, [pa.int64(), pa.string(), pa.int64(), pa.int64(), *[pa.float64()] * (2 + len(extra))])


def frozen_sources(candidates: DataFrame, given: DataFrame, train: int, held: int, lag: int = 1, own: int = 1, bandwidth: int = 4) -> DataFrame:
    """Each source beside the controls that all sources of a target share, fitted before step ``train`` and judged from ``held`` on.

    Columns: n_train, effect, se_hac (training), refit_effect, refit_se_hac (the same fit made
    anew on the later steps, as a check in retrospect), n, mse_restricted, mse_full, gain (their
    difference, with frozen coefficients), gain_se (HAC). Steps count on the calendar.
    """

    def one(target, found, first, y, x):
        at = np.arange(max(own, lag), len(y))
        parts = at[first + at < train], at[first + at >= held]
        if min(map(len, parts)) < own + 4:
            return
        control = lambda on: np.stack([np.ones(len(on)), *(y[on - k] for k in range(1, own + 1))], axis=1)
        fit, refit = (Tests(y[on], control(on), x[on - lag], on, len(y), first) for on in parts)
        past, test = parts
        both = np.linalg.lstsq(control(past), np.column_stack([y[past], x[past - lag]]), rcond=None)[0]
        c, z = control(test), x[test - lag]
        er = y[test] - c @ both[:, 0]
        ef = er[:, None] - (z - c @ both[:, 1:]) * fit.beta
        gain = er[:, None] ** 2 - ef**2
        mean, n = gain.mean(axis=0), len(test)
        score = np.zeros((len(y), len(found)))
        score[test] = gain - mean
        se = np.sqrt(np.maximum(0.0, bartlett(score, bandwidth)) * n / (n - 1)) / n
        cols = (fit.beta, fit.se_hac(bandwidth), refit.beta, refit.se_hac(bandwidth), np.full(len(found), (er**2).mean()), (ef**2).mean(axis=0), mean, se)
        for j, v in enumerate(zip(*(a.tolist() for a in cols), strict=True)):
            ok = bool(fit.valid[j] and refit.valid[j])
            yield (j, fit.n, n, *(v if ok else [None] * len(v)))

    names = ["n_train", "n", "effect", "se_hac", "refit_effect", "refit_se_hac", "mse_restricted", "mse_full", "gain", "gain_se"]
    return _mapped(candidates, given, one, "n_train long, n long, " + ", ".join(f"{n} double" for n in names[2:]), names, [pa.int64()] * 2 + [pa.float64()] * 8)


def state_contrasts(candidates: DataFrame, given: DataFrame, states: dict[str, tuple[set[int], set[int]]], periods: dict[str, tuple[int, int]], lags: int = 1, own: int = 1, bandwidth: int = 4) -> DataFrame:
    """What a link gains in one state of the calendar against another: lag, contrast, period, n, reference, delta, se_hac, p_value.

    ``states`` names contrasts by the steps of the reference and of the other state, ``periods``
    spans of steps [from, to). State, its products with the target's own past and with the
    source stand beside them in one fit, so the state may shift level and memory too; delta
    is the coefficient of the product with the source. Both are as long as the calendar at most.
    """

    def one(target, found, first, y, x):
        for lag in range(1, lags + 1):
            at = np.arange(max(own, lag), len(y))
            steps = (first + at).tolist()
            for name, (low, high) in states.items():
                s = np.array([1.0 if t in high else 0.0 if t in low else np.nan for t in steps])
                for period, (a, b) in periods.items():
                    keep = ~np.isnan(s) & (first + at >= a) & (first + at < b)
                    on, d = at[keep], s[keep][:, None]
                    if len(on) < 2 * own + 6 or not 0 < d.sum() < len(on):
                        continue
                    past = np.stack([y[on - k] for k in range(1, own + 1)], axis=1)
                    rank, (yr, xr, vr) = residualised(np.hstack([np.ones((len(on), 1)), past, d, past * d]), y[on], x[on - lag], x[on - lag] * d)
                    df, sxx = len(on) - rank - 2, (xr * xr).sum(axis=0)
                    ok = (sxx > 1e-12) & (df > 0)
                    sxx = np.where(ok, sxx, 1.0)
                    base, ratio = xr.T @ yr / sxx, (xr * vr).sum(axis=0) / sxx
                    z, left = vr - xr * ratio, yr[:, None] - xr * base
                    zz = (z * z).sum(axis=0)
                    ok &= zz > 1e-12
                    zz = np.where(ok, zz, 1.0)
                    delta = (z * left).sum(axis=0) / zz
                    v = np.zeros((len(y), len(found)))
                    v[on] = z * (left - z * delta) / zz * math.sqrt(len(on) / max(df, 1))
                    se = np.sqrt(np.maximum(0.0, bartlett(v, bandwidth)))
                    rows = zip((base - ratio * delta).tolist(), delta.tolist(), se.tolist(), normal_p(delta, se), strict=True)
                    yield from ((j, lag, name, period, len(on), *(r if ok[j] else [None] * 4)) for j, r in enumerate(rows))

    names = ["lag", "contrast", "period", "n", "reference", "delta", "se_hac", "p_value"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.float64()] * 4]
    return _mapped(candidates, given, one, "lag long, contrast string, period string, n long, reference double, delta double, se_hac double, p_value double", names, types)


def influences(candidates: DataFrame, given: DataFrame, lags: int = 1, own: int = 1, regimes: dict[str, tuple[int, int, int]] | None = None) -> DataFrame:
    """key, lag, regime, n, effect, first, influence of every candidate.

    The influence of a step is its part of the slope's error, score / zss *
    sqrt(n / (n - rank)); steps outside the sample are zeros, so that the series of
    several tests can be added, subtracted and averaged step by step.
    """
    masks = _masks(regimes or SEASONS)

    def one(target, found, first, y, x):
        for name, mask in masks.items():
            for lag in range(1, lags + 1):
                t = lag_design(y, x, first, lag, mask, own)
                if t is not None:
                    v = t.influence()
                    yield from ((j, lag, name, t.n, float(t.beta[j]), first, v[:, j]) for j in np.flatnonzero(t.valid).tolist())

    names, types = ["lag", "regime", "n", "effect", "first", "influence"], [pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.float64())]
    return _mapped(candidates, given, one, "lag long, regime string, n long, effect double, first long, influence array<double>", names, types)


def hac_error(values: Column, bandwidth: int) -> Column:
    """HAC standard error of an effect from its influence series."""

    @F.pandas_udf("double")
    def error(series: pd.Series) -> pd.Series:
        return series.map(lambda v: math.sqrt(max(0.0, bartlett(np.asarray(v, np.float64), bandwidth))))

    return error(values)


def block_weights(n: int, block: int, replicate: int) -> np.ndarray:
    """How often a replicate of calendar blocks draws each of ``n`` positions; draws are arithmetic, so runs repeat."""
    w = np.zeros(n)
    for k in range(-(-n // block)):
        start = (replicate * 7919 + k * 104729) % max(1, n - block + 1)
        w[start : start + min(block, n - k * block)] += 1
    return w


def resampled(candidates: DataFrame, given: DataFrame, lag: int, replicates: int, block: int = 16, own: int = 1, regimes: dict[str, tuple[int, int, int]] | None = None) -> DataFrame:
    """Every candidate refitted on each replicate: key, regime, replicate, n, effect, t, df, p_value.

    Blocks are drawn from the rows of the lagged design on the whole calendar, so lags
    and gaps stay what they were; the regime is applied to the rows drawn. The cross products
    of all replicates, regimes and sources of a target are one product of the matrix of weights.
    """
    masks = _masks(regimes or SEASONS)

    def one(target, found, first, y, x):
        at = np.arange(max(own, lag), len(y))
        drawn = np.stack([block_weights(len(at), block, r) for r in range(replicates)])
        seasons = [(name, mask(first + at)) for name, mask in masks.items()]
        fits = [(r, name) for r in range(replicates) for name, _ in seasons]
        w = np.stack([drawn[r] * on for r in range(replicates) for _, on in seasons])
        c = np.stack([np.ones(len(at)), *(y[at - k] for k in range(1, own + 1))], axis=1)
        z, q, m = x[at - lag], own + 1, x.shape[1]
        cross = [c[:, i] * c[:, j] for i in range(q) for j in range(q)]
        cols = np.column_stack([*cross, c * y[at, None], y[at] ** 2, *(c[:, [i]] * z for i in range(q)), y[at, None] * z, z * z])
        g = w @ cols
        at_c, n = np.cumsum([q * q, q, 1, q * m, m]), np.rint(w.sum(axis=1)).astype(int)
        cc, cy, yy, cz, zy, zz = np.split(g, at_c, axis=1)
        cc, cz = cc.reshape(-1, q, q), cz.reshape(-1, q, m)
        inner = np.linalg.pinv(cc, rcond=1e-13, hermitian=True)
        rank = np.linalg.matrix_rank(cc, hermitian=True)
        zss = zz - np.einsum("rqm,rqp,rpm->rm", cz, inner, cz)
        zys = zy - np.einsum("rqm,rqp,rp->rm", cz, inner, cy)
        yss = yy[:, 0] - np.einsum("rq,rqp,rp->r", cy, inner, cy)
        for f, (r, name) in enumerate(fits):
            df = int(n[f] - rank[f] - 1)
            ok = (zss[f] > 1e-12) & (df > 0)
            den = np.where(ok, zss[f], 1.0)
            beta = zys[f] / den
            se = np.sqrt(np.maximum(0.0, yss[f] - beta * zys[f]) / max(df, 1) / den)
            t = np.divide(beta, se, out=np.full(m, math.inf), where=se > 0)
            p = np.zeros(m)
            fin = np.isfinite(t)
            p[fin] = t_tail_whole(t[fin], df) if df > 0 else 1.0
            for j in range(m):
                yield (j, name, r, int(n[f]), *((float(beta[j]), float(t[j]), df, float(p[j])) if ok[j] else [None] * 4))

    names, types = ["regime", "replicate", "n", "effect", "t", "df", "p_value"], [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64()]
    return _mapped(candidates, given, one, "regime string, replicate long, n long, effect double, t double, df long, p_value double", names, types)


def matched_draws(t: np.ndarray, size: int, replicates: int) -> np.ndarray:
    """How often each replicate (from 1) takes each of the steps ``t``: ``size`` of them in an order of its own, again from the first where they are short."""
    out = np.zeros((replicates, len(t)))
    rank = np.arange(1, len(t) + 1)
    for r in range(1, replicates + 1):
        order = np.lexsort((t, np.fmod(t * 7349 + r * 4591, 10007)))
        out[r - 1, order] = np.where(rank <= size, (size - rank) // len(t) + 1, 0)
    return out


def matched_refits(bundles: DataFrame, source: str, target: str, replicates: int = 20) -> DataFrame:
    """Slope of each node's ``target`` on its ``source`` one step before in the steps marked ``high``, against refits on as many others: node, observed, mean, p.

    ``high`` is an array over the calendar, the same in every row, so all nodes share the draws and the
    sums of their refits are products of series and draws. Without marked or without other steps there are no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in panels.few(batches, 4096):
            high, first = np.array(b.column("high")[0].as_py(), bool)[1:], b.column("first")[0].as_py()
            t, low = first + 1 + np.arange(len(high)), ~high
            if not high.any() or not low.any():
                continue
            y, z = panels.matrix(b.column(target))[:, 1:], panels.matrix(b.column(source))[:, :-1]
            w = matched_draws(t[low], int(high.sum()), replicates)
            s = lambda v: v[:, low] @ w.T  # noqa: B023, E731
            yh, zh, n = _centred(y[:, high]), _centred(z[:, high]), w.sum(axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                observed = (yh * zh).sum(axis=1) / (zh * zh).sum(axis=1)
                slope = (s(y * z) - s(y) * s(z) / n) / (s(z * z) - s(z) * s(z) / n)
                mean = slope.mean(axis=1)
                off, seen = np.abs(slope - mean[:, None]), np.abs(observed - mean)
            far = ((off >= seen[:, None]) | np.isnan(off)).sum(axis=1)  # NaN is the largest, as in SQL
            yield pa.RecordBatch.from_arrays([b.column("node"), *map(pa.array, (observed, mean, np.minimum(1.0, (1 + far) / (replicates + 1.0))))], ["node", "observed", "mean", "p"])

    return bundles.select("node", "first", "high", source, target).mapInArrow(run, "node long, observed double, mean double, p double")
