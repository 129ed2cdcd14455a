"""A run of cleaning, regions, candidates and tests under several settings at once, keyed by a setting column.

What settings share is computed once: gaps are filled once, all recipes come out of the same
arrays, candidates are made once for each number of regions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagloom.operators import panels, reports, screen, spatial
from lagloom.operators.fdr import bh_large
from lagloom.operators.lineage import written

#: Recipe of each name; the last one is standardised after averaging over regions, not before.
RECIPES = ("monthly", "monthly_difference", "difference", "rolling", "monthly_by_region")
#: Settings: name, recipe, number of regions.
SETTINGS = (
    ("P1_monthly", "monthly", 66), ("P2_monthly_diff", "monthly_difference", 66), ("P3_diff_only", "difference", 66), ("P4_rolling", "rolling", 66),
    ("P5_monthly_regionstd", "monthly_by_region", 66), ("R32_monthly", "monthly", 32), ("R128_monthly", "monthly", 128),
)


def recipes(x: np.ndarray, season: np.ndarray, width: int = 31, names: tuple[str, ...] = RECIPES) -> Iterator[tuple[str, int, np.ndarray]]:
    """Each recipe, the step its series begin with, and the filled series of ``x`` (node, variable, step) cleaned by it."""
    flat = x.reshape(-1, x.shape[-1])
    monthly = panels.anomalies(flat, season)
    for name in names:
        match name:
            case "monthly":
                out, first = panels.standardised(monthly), 0
            case "monthly_by_region":
                out, first = monthly, 0
            case "monthly_difference":
                out, first = panels.standardised(np.diff(monthly, axis=1)), 1
            case "difference":
                out, first = panels.standardised(np.diff(flat, axis=1)), 1
            case "rolling":
                out, first = panels.standardised(flat - _rolling(flat, width)), 0
        yield name, first, out.reshape(*x.shape[:-1], -1)


def _rolling(x: np.ndarray, width: int) -> np.ndarray:
    """Means of the ``width`` steps about each step, of those that there are."""
    ends = (width // 2, (width - 1) // 2)
    sums = lambda v: np.lib.stride_tricks.sliding_window_view(np.pad(v, [(0, 0)] * (v.ndim - 1) + [ends]), width, axis=-1).sum(axis=-1)
    return sums(x) / sums(np.ones(x.shape[-1]))


def recipe_ranges(wide: DataFrame, variables: tuple[str, ...], span: tuple[int, int], period: int = 52) -> DataFrame:
    """recipe, variable, n, high, low over the series of all nodes: one row per recipe and variable from each batch of nodes, then their sums."""
    names, season = sorted(variables), panels.seasons(*span, period)

    def run(parts):
        for _, x in parts:
            rows = [(r, v, c.shape[0] * c.shape[2], c[:, j].max(), np.fmin.reduce(c[:, j], axis=None)) for r, _, c in recipes(x, season) if c.shape[2] for j, v in enumerate(names)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["recipe", "variable", "n", "high", "low"])

    parts = panels.mapped(wide, names, span, run, "recipe string, variable string, n long, high double, low double")
    return parts.groupBy("recipe", "variable").agg(F.sum("n").alias("n"), F.max("high").alias("high"), F.min("low").alias("low"))


def regional(wide: DataFrame, variables: tuple[str, ...], span: tuple[int, int], nodes: DataFrame, settings=SETTINGS, period: int = 52) -> DataFrame:
    """setting, node (a region), variable, first, values: means over the regions of each setting of the cleaned series of a panel (t, node, variables).

    Regions reach a task as rows without a step among those of their node. A task adds up the
    series of each region, recipe and variable, as many rows as those have, so neither
    steps nor nodes are multiplied by settings in a shuffle.
    """
    names, season = sorted(variables), panels.seasons(*span, period)
    sizes = sorted({n for *_, n in settings})
    wanted = sorted({(r, n) for _, r, n in settings})
    used = tuple(dict.fromkeys(r for r, _ in wanted))
    where = [f"region_{n}" for n in sizes]
    at = nodes.select("node", *[spatial.bins(F.col("lat"), F.col("lon"), n).alias(c) for n, c in zip(sizes, where, strict=True)])
    both = wide.withColumn("_data", F.lit(1)).unionByName(at, allowMissingColumns=True)

    def run(parts):
        sums: dict[tuple, list] = {}
        for (_, x), extra in parts:
            # a node counts as often as it is listed, if it has rows at all
            listed = extra[:, 1] * (extra[:, 0] > 0)
            for recipe, first, c in recipes(x, season, names=used):
                for k, n in enumerate(sizes):
                    if (recipe, n) not in wanted:
                        continue
                    region = extra[:, 2 + k]
                    for r in np.unique(region[listed > 0]):
                        on = np.flatnonzero((region == r) & (listed > 0))
                        held = sums.setdefault((recipe, n, int(r), first), [0.0, 0.0])
                        held[0] += listed[on].sum()
                        held[1] = held[1] + np.tensordot(listed[on], c[on], axes=1)
        for key, (n, total) in sums.items():
            cols = [pa.array([v] * len(names)) for v in key]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(names), pa.array([n] * len(names)), panels.lists(total)], ["recipe", "size", "region", "start", "variable", "n", "total"])

    parts = panels.mapped(both, names, span, run, "recipe string, size long, region long, start long, variable string, n double, total array<double>", extra=["_data", *where])
    key = ["recipe", "size", "region", "start", "variable"]
    parts = parts.groupBy(*key).agg(F.sum("n").alias("n"), F.collect_list("total").alias("total"))  # a row from each task

    def means(batches):
        for b in batches:
            for i in range(b.num_rows):
                m = np.sum([np.asarray(t.values) for t in b.column("total")[i]], axis=0)[None] / b.column("n")[i].as_py()
                if b.column("recipe")[i].as_py() == "monthly_by_region":
                    m = panels.standardised(m)
                row = b.slice(i, 1)
                first = pa.array([span[0] + row.column("start")[0].as_py()])
                yield pa.RecordBatch.from_arrays([*(row.column(c) for c in ("recipe", "size", "region", "variable")), first, panels.lists(m)], ["recipe", "size", "node", "variable", "first", "values"])

    m = parts.mapInArrow(means, "recipe string, size long, node long, variable string, first long, values array<double>")
    uses = F.explode(F.array(*[F.struct(F.lit(s).alias("setting"), F.lit(r).alias("r"), F.lit(n).alias("n")) for s, r, n in settings])).alias("u")
    return m.select("*", uses).filter("u.r = recipe and u.n = size").select("u.setting", "node", "variable", "first", "values")


def candidates(nodes: DataFrame, edge_types, settings=SETTINGS, near: int = 2) -> DataFrame:
    """setting and candidate: each region with itself and with its nearest ones, both ways, for every pair of variables."""
    out = None
    for size in sorted({n for *_, n in settings}):
        r = nodes.withColumn("node", spatial.bins(F.col("lat"), F.col("lon"), size)).groupBy("node").agg(F.avg("lat").alias("lat"), spatial.circular_mean_lon().alias("lon"))
        k = spatial.nearest(r, near).select("source", "target")
        both = k.union(k.select("target", "source")).union(r.select("node", "node")).distinct().toDF("source_region", "target_region")
        names = F.explode(F.array(*[F.lit(s) for s, _, n in settings if n == size])).alias("setting")
        both = both.select("*", names)
        out = both if out is None else out.unionByName(both)
    pair = F.explode(F.array(*[F.struct(F.lit(a).alias("source_var"), F.lit(b).alias("target_var")) for a, b in edge_types]))
    return out.withColumn("v", pair).select("setting", "source_region", "target_region", "v.*")


def run(wide: DataFrame, variables: tuple[str, ...], span: tuple[int, int], nodes: DataFrame, edge_types, settings=SETTINGS, lags: int = 3, alpha: float = 0.05, period: int = 52) -> DataFrame:
    """setting, candidate, lag, regime, n, effect, p_value, q_value (within setting and regime), significant."""
    series = regional(wide, variables, span, nodes, settings, period)
    keyed = lambda df, *cols: df.withColumns({c: F.concat_ws("/", "setting", c) for c in cols})
    cand = keyed(candidates(nodes, edge_types, settings), "source_region", "target_region")
    t = screen.screen(cand, keyed(series, "node"), lags=lags).filter("effect is not null")
    apart = lambda c: F.element_at(F.split(c, "/"), -1).cast("long")
    t = t.withColumn("setting", F.expr("substring_index(target_region, '/', 1)")).withColumns({c: apart(c) for c in ("source_region", "target_region")})
    t = written(t.withColumn("p_value", F.round("p_value", 9)), "setting-runs")  # read for the ranks and again for their join
    return bh_large(t, ["setting", "regime"], alpha=alpha)


def persistent(significant: DataFrame, n_settings: int, key: list[str]) -> DataFrame:
    """Keys that are significant under every setting."""
    return significant.groupBy(*key).agg(F.count_distinct("setting").alias("c")).filter(F.col("c") == n_settings).select(*key)


def summary(tests: DataFrame, names: list[str]) -> DataFrame:
    """One row per setting: tested, significant, ratio, edges of the three types, chains, persistent edges, lags, mean size of the score."""
    sig = F.col("significant")
    kind = F.concat_ws("->", "source_var", "target_var")
    of = lambda a, b: sig & (kind == f"{a}->{b}")
    wh, hc, wc = of("wind", "humidity"), of("humidity", "cloud_cover"), of("wind", "cloud_cover")
    score = F.abs(-F.log10(F.col("q_value") + 1e-12) * F.col("effect"))
    s = tests.groupBy("setting").agg(
        F.count("*").alias("tested"), F.count_if(sig).alias("significant"), F.count_if(wh).alias("wh"), F.count_if(hc).alias("hc"), F.count_if(wc).alias("wc"),
        F.avg(F.when(wh, F.col("lag"))).alias("wh_lag"), F.avg(F.when(hc, F.col("lag"))).alias("hc_lag"), F.avg(F.when(sig, score)).alias("score"),
    )
    hit = tests.filter("significant")
    ch = reports.chains(hit, ["setting", "regime"]).groupBy("setting").agg(F.count("*").alias("chains"))
    key = ["regime", *reports.KEY]
    stay = persistent(hit.filter(F.col("setting").isin(names)), len(names), key)
    kept = lambda a, b: F.count_if((F.col("source_var") == a) & (F.col("target_var") == b))
    stable = stay.agg(kept("wind", "humidity").alias("stable_wh"), kept("humidity", "cloud_cover").alias("stable_hc"))
    return s.join(ch.hint("shuffle_merge"), "setting", "left").crossJoin(F.broadcast(stable)).withColumn("chains", F.coalesce("chains", F.lit(0)))  # one row
