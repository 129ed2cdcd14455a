"""Forecasts of regional humidity from blocks of features: designs, fitted models, scores, and one table of paired comparisons."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagloom.operators import panels, screen, settings, spatial
from lagloom.operators.lineage import stored
from lagloom.plans import section
from lagloom.plans.v_shared import calendar_shares
from lagloom.plans.w_settings import _RUN
from lagloom.plans.y_contrasts import _COLUMNS, _SHIFT, remote_of
from lagloom.sources.fixtures import HAV_SQL, VARIABLES, _station_panel, sources, stations, weeks
from lagloom.sources.sqltext import gram_sql, sweep_sql

QUERIES, query = section()
_TRAINED, _HELD, _PENALTY, _LOW, _HIGH = 0.70, 0.72, 10.0, -0.6, 0.6
_BLOCK, _REPLICATES, _YEAR = 4, 50, 52

#: Features by block. A step is forecast from the one before; ``future`` reads the step itself, as a check that leaks show.
BLOCKS = {
    "local": ["h1", "w1", "c1", "e1", "h2", "year_sin", "year_cos"],
    "flux": ["flux1", "flux2"],
    "other": ["other1", "other2"],
    "grid": ["near1_h", "near1_w", "near2_h", "near2_w"],
    "future": ["flux0"],
}
MODELS = {
    "ridge_local": ["local"], "ridge_flux": ["local", "flux"], "ridge_other": ["local", "other"], "ridge_grid": ["local", "grid"],
    "ridge_grid_flux": ["local", "grid", "flux"], "ridge_future": ["local", "future"],
}
#: Model and what it is held against.
PAIRS = (
    ("ridge_local", "persistence"), ("ridge_local", "climatology"), ("climatology", "persistence"), ("ridge_flux", "ridge_local"), ("ridge_flux", "persistence"), ("ridge_flux", "climatology"),
    ("ridge_grid", "ridge_local"), ("ridge_grid", "persistence"), ("ridge_grid_flux", "ridge_grid"), ("ridge_grid_flux", "ridge_flux"), ("ridge_grid_flux", "ridge_local"), ("ridge_other", "ridge_local"),
    ("ridge_flux", "ridge_other"), ("ridge_future", "ridge_local"), ("ridge_future", "ridge_flux"), ("ridge_future", "persistence"),
)
_FEATURES = [c for b in BLOCKS.values() for c in b]


def region_series(spark, sf_dir) -> DataFrame:
    """node (a region), variable, t, value: standardised anomalies of stations, averaged by region. Stored once."""

    def make():
        one = [s for s in settings.SETTINGS if s[0] == "P1_monthly"]
        return panels.steps(settings.regional(_station_panel(spark, sf_dir), VARIABLES, weeks(spark, sf_dir), stations(spark, sf_dir), one, _YEAR))

    return stored(spark, "region-series", sources(sf_dir, "lineitem", "supplier"), make)


def design(spark, sf_dir) -> DataFrame:
    """region, t, y and the features of all blocks, joined on the calendar; a region without a counterpart has zeros for it."""
    s = region_series(spark, sf_dir)
    wide = s.groupBy("node", "t").pivot("variable", ["cloud_cover", "humidity", "temperature", "wind"]).agg(F.first("value"))
    wide = wide.withColumn("flux", F.col("wind") * F.col("humidity"))
    box = stations(spark, sf_dir).withColumn("node", spatial.bins(F.col("lat"), F.col("lon"), 66)).groupBy("node").agg(F.avg("lat").alias("lat"), spatial.circular_mean_lon().alias("lon"))
    near = spatial.nearest(box, 2).select(F.col("target").alias("region"), F.col("source").alias("near"), "rank")

    def back(k: int, **names: str) -> DataFrame:
        return wide.select(F.col("node").alias("region"), (F.col("t") + k).alias("t"), *[F.col(c).alias(a) for a, c in names.items()])

    d = wide.select(F.col("node").alias("region"), "t", F.col("humidity").alias("y"), F.col("flux").alias("flux0"))
    for k, names in ((1, {"h1": "humidity", "w1": "wind", "c1": "cloud_cover", "e1": "temperature", "flux1": "flux"}), (2, {"h2": "humidity", "flux2": "flux"})):
        d = d.join(back(k, **names).hint("shuffle_merge"), ["region", "t"])
    angle = 2 * math.pi * (F.col("t") % _YEAR) / _YEAR
    d = d.withColumn("year_sin", F.sin(angle)).withColumn("year_cos", F.cos(angle)).withColumn("remote", remote_of(F.col("region")))
    for k in (1, 2):
        other = wide.select(F.col("node").alias("remote"), (F.col("t") + k).alias("t"), F.col("flux").alias(f"other{k}"))
        d = d.join(other.hint("shuffle_merge"), ["remote", "t"], "left")
    for rank in (1, 2):
        n = near.filter(F.col("rank") == rank).select("region", F.col("near").alias("node")).join(wide.select("node", (F.col("t") + 1).alias("t"), F.col("humidity").alias(f"near{rank}_h"), F.col("wind").alias(f"near{rank}_w")).hint("shuffle_merge"), "node")
        d = d.join(n.drop("node").hint("shuffle_merge"), ["region", "t"], "left")
    return d.select("region", "t", "y", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in _FEATURES])


def forecasts(spark, sf_dir) -> DataFrame:
    """region, t, model, actual, prediction on the held-out steps. Stored once.

    Each region's models are fitted in one task to its training steps: at most as many rows as
    the calendar has.
    """
    train, held = calendar_shares(screen.series(region_series(spark, sf_dir)), _TRAINED, _HELD)

    def fit(df):
        import numpy as np
        import pandas as pd

        past, test = (df["t"] < train).to_numpy(), (df["t"] >= held).to_numpy()
        y, out = df["y"].to_numpy(float), {}
        if not past.any() or not test.any():
            return pd.DataFrame({"region": [], "t": [], "model": [], "actual": [], "prediction": []})
        out["persistence"] = df["h1"].to_numpy(float)[test]
        season = (df["t"] % _YEAR).to_numpy()
        mean = pd.Series(y[past]).groupby(season[past]).mean()
        out["climatology"] = pd.Series(season[test]).map(mean).fillna(y[past].mean()).to_numpy(float)
        for name, blocks in MODELS.items():
            x = df[[c for b in blocks for c in BLOCKS[b]]].to_numpy(float)
            m, sd = x[past].mean(axis=0), x[past].std(axis=0)
            z = (x - m) / np.where(sd > 1e-8, sd, 1.0)
            b = np.linalg.solve(z[past].T @ z[past] + _PENALTY * np.eye(z.shape[1]), z[past].T @ (y[past] - y[past].mean()))
            out[name] = y[past].mean() + z[test] @ b
        frames = [pd.DataFrame({"region": df["region"].to_numpy()[test], "t": df["t"].to_numpy()[test], "model": n, "actual": y[test], "prediction": p}) for n, p in out.items()]
        return pd.concat(frames)

    make = lambda: design(spark, sf_dir).groupBy("region").applyInPandas(fit, "region long, t long, model string, actual double, prediction double")
    return stored(spark, "forecasts", sources(sf_dir, "lineitem", "supplier"), make, penalty=_PENALTY, trained=_TRAINED, held=_HELD)


def _design_sql() -> str:
    lagged = lambda alias, node, k: f"LEFT JOIN wd {alias} ON {alias}.node = {node} AND {alias}.t = d.t - {k}"
    head = _RUN[: _RUN.index(",\nct AS MATERIALIZED")].replace("WITH ", "WITH RECURSIVE ", 1)
    return head + f""",
 wd AS MATERIALIZED (SELECT node, t, {", ".join(f"max(v) FILTER (variable = '{v}') AS {v}" for v in ("cloud_cover", "humidity", "temperature", "wind"))}, max(v) FILTER (variable = 'wind') * max(v) FILTER (variable = 'humidity') AS flux FROM zs WHERE setting = 'P1_monthly' GROUP BY 1, 2),
 n2 AS (SELECT b.node, a.node AS near, row_number() OVER (PARTITION BY b.node ORDER BY {HAV_SQL}, a.node) AS r FROM rg a JOIN rg b ON a.size = 66 AND b.size = 66 AND a.node <> b.node),
 ds AS MATERIALIZED (SELECT d.node AS region, d.t, d.humidity AS y, a.humidity AS h1, a.wind AS w1, a.cloud_cover AS c1, a.temperature AS e1, b.humidity AS h2, sin(2 * pi() * (d.t % {_YEAR}) / {_YEAR}) AS year_sin, cos(2 * pi() * (d.t % {_YEAR}) / {_YEAR}) AS year_cos,
  a.flux AS flux1, b.flux AS flux2, coalesce(o1.flux, 0) AS other1, coalesce(o2.flux, 0) AS other2, coalesce(k1.humidity, 0) AS near1_h, coalesce(k1.wind, 0) AS near1_w, coalesce(k2.humidity, 0) AS near2_h, coalesce(k2.wind, 0) AS near2_w, d.flux AS flux0
  FROM wd d JOIN wd a ON a.node = d.node AND a.t = d.t - 1 JOIN wd b ON b.node = d.node AND b.t = d.t - 2 {lagged("o1", f"(d.node // {_COLUMNS}) * {_COLUMNS} + (d.node % {_COLUMNS} + {_SHIFT}) % {_COLUMNS}", 1)} {lagged("o2", f"(d.node // {_COLUMNS}) * {_COLUMNS} + (d.node % {_COLUMNS} + {_SHIFT}) % {_COLUMNS}", 2)}
  LEFT JOIN n2 q1 ON q1.node = d.node AND q1.r = 1 LEFT JOIN n2 q2 ON q2.node = d.node AND q2.r = 2 {lagged("k1", "q1.near", 1)} {lagged("k2", "q2.near", 1)})"""


def _forecast_sql() -> str:
    parts = [f"cu AS (SELECT a + floor((b - a) * {_TRAINED}::DOUBLE)::BIGINT AS train, a + floor((b - a) * {_HELD}::DOUBLE)::BIGINT AS held FROM (SELECT min(t) AS a, max(t) + 1 AS b FROM wd))"]
    scaled = ", ".join(f"({c} - avg({c}) FILTER (t < train) OVER w) / CASE WHEN stddev_pop({c}) FILTER (t < train) OVER w > 1e-8 THEN stddev_pop({c}) FILTER (t < train) OVER w ELSE 1 END AS {c}" for c in _FEATURES)
    parts.append(f"sd AS MATERIALIZED (SELECT region, t, t < train AS past, t >= held AS test, h1 AS before, y AS actual, avg(y) FILTER (t < train) OVER w AS my, avg(y) FILTER (t < train) OVER (PARTITION BY region, t % {_YEAR}) AS clim, y - avg(y) FILTER (t < train) OVER w AS y, {scaled} FROM ds, cu WINDOW w AS (PARTITION BY region))")
    parts.append("tr AS MATERIALIZED (SELECT * FROM sd WHERE past)")
    rows = ["SELECT region, t, 'persistence' AS model, actual, before AS prediction FROM sd WHERE test", "SELECT region, t, 'climatology', actual, coalesce(clim, my) FROM sd WHERE test"]
    for i, (name, blocks) in enumerate(MODELS.items()):
        cols = [c for b in blocks for c in BLOCKS[b]]
        k = len(cols) + 1
        parts += [gram_sql(f"g{i}", "tr", [*cols, "y"], "region"), f"p{i} AS MATERIALIZED (SELECT region, n, list_transform(range(0, {k * k}), lambda q: m[q + 1] + CASE WHEN q // {k} = q % {k} AND q // {k} < {k - 1} THEN {_PENALTY} ELSE 0 END) AS m FROM g{i})", sweep_sql(f"f{i}", f"p{i}", k, k - 1, "region")]
        rows.append(f"SELECT region, t, '{name}', actual, my + {' + '.join(f'{c} * m[{(j + 1) * k}]' for j, c in enumerate(cols))} FROM sd JOIN f{i} USING (region) WHERE test")
    return _design_sql() + ", " + ", ".join(parts) + ", fc AS MATERIALIZED (" + " UNION ALL ".join(rows) + ")"


_FC = _forecast_sql()


@query(_design_sql() + f" SELECT region, t, round(y, 7) AS y, {', '.join(f'round({c}, 7) AS {c}' for c in _FEATURES)} FROM ds")
def forecast_blocks(spark, sf_dir):
    """The design of every region and step: local, flux, other region's flux, neighbours and future flux, each in named columns."""
    return design(spark, sf_dir).select("region", "t", *[F.round(c, 7).alias(c) for c in ("y", *_FEATURES)])


@query(_FC + f""", sl AS (SELECT *, unnest(['all', CASE WHEN t % {_YEAR} < 26 THEN 'winter' ELSE 'summer' END]) AS slice, least(greatest(prediction, {_LOW}), {_HIGH}) AS cp FROM fc), rg2 AS (SELECT model, slice, region, avg(pow(prediction - actual, 2)) AS mse FROM sl GROUP BY 1, 2, 3), po AS (SELECT model, slice, sqrt(avg(mse)) AS pooled FROM rg2 GROUP BY 1, 2)
 SELECT model, slice, count(*) AS n, round(avg(prediction - actual), 8) AS bias, round(avg(abs(prediction - actual)), 8) AS mae, round(sqrt(avg(pow(prediction - actual, 2))), 8) AS rmse, round(sqrt(avg(pow(cp - actual, 2))), 8) AS rmse_clipped, count(*) FILTER (prediction <> cp) AS clipped, round(1 - sum(pow(prediction - actual, 2)) / (var_pop(actual) * count(*)), 7) AS r2, round(any_value(pooled), 8) AS rmse_equal_regions FROM sl JOIN po USING (model, slice) GROUP BY 1, 2""")
def model_scores(spark, sf_dir):
    """Scores of the fitted models and baselines by season, raw and clipped, over all rows and with equal weight for every region."""
    p = forecasts(spark, sf_dir)
    slices = F.explode(F.array(F.lit("all"), F.when(F.col("t") % _YEAR < 26, "winter").otherwise("summer"))).alias("slice")
    s = p.select("*", slices).withColumn("c", F.least(F.greatest("prediction", F.lit(_LOW)), F.lit(_HIGH)))
    e, ce = F.col("prediction") - F.col("actual"), F.col("c") - F.col("actual")
    pooled = s.groupBy("model", "slice", "region").agg(F.avg(e * e).alias("m")).groupBy("model", "slice").agg(F.round(F.sqrt(F.avg("m")), 8).alias("rmse_equal_regions"))
    a = s.groupBy("model", "slice").agg(
        F.count("*").alias("n"), F.round(F.avg(e), 8).alias("bias"), F.round(F.avg(F.abs(e)), 8).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 8).alias("rmse"), F.round(F.sqrt(F.avg(ce * ce)), 8).alias("rmse_clipped"),
        F.count_if(F.col("prediction") != F.col("c")).alias("clipped"), F.round(1 - F.sum(e * e) / (F.var_pop("actual") * F.count("*")), 7).alias("r2"),
    )
    return a.join(pooled.hint("shuffle_merge"), ["model", "slice"])


_PAIR = ", ".join(f"('{a}', '{b}')" for a, b in PAIRS)


@query(_FC + f""", pr(model, baseline) AS (VALUES {_PAIR}), ls AS (SELECT region, t, model, pow(prediction - actual, 2) AS sq, abs(prediction - actual) AS ab FROM fc),
 df AS (SELECT pr.model, pr.baseline, a.t, avg(b.sq - a.sq) AS d_mse, avg(b.ab - a.ab) AS d_mae, count(*) AS regions FROM pr JOIN ls a ON a.model = pr.model JOIN ls b ON b.model = pr.baseline AND b.region = a.region AND b.t = a.t GROUP BY 1, 2, 3),
 st AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT t FROM fc)),
 dr AS (SELECT r, start + o AS pos, count(*) AS w FROM (SELECT r, k, (r * 7919 + k * 104729) % greatest(1, n - {_BLOCK - 1}) AS start, n FROM (SELECT any_value(n) AS n FROM st), range({_REPLICATES}) a(r), LATERAL (SELECT unnest(range((n + {_BLOCK - 1}) // {_BLOCK})) AS k)), range({_BLOCK}) c(o) WHERE k * {_BLOCK} + o < n GROUP BY 1, 2),
 sl AS (SELECT df.*, pos, unnest(['all', CASE WHEN t % {_YEAR} < 26 THEN 'winter' ELSE 'summer' END]) AS slice FROM df JOIN st USING (t)),
 bt AS (SELECT model, baseline, slice, r, sum(w * d_mse) / sum(w) AS m, sum(w * d_mae) / sum(w) AS a FROM sl JOIN dr USING (pos) GROUP BY ALL), qt AS (SELECT model, baseline, slice, quantile_cont(m, 0.025) AS m1, quantile_cont(m, 0.975) AS m2, quantile_cont(a, 0.025) AS a1, quantile_cont(a, 0.975) AS a2 FROM bt GROUP BY ALL)
 SELECT model, baseline, slice, sum(regions)::BIGINT AS n, round(avg(d_mse), 9) AS delta_mse, round(avg(d_mae), 9) AS delta_mae, round(any_value(m1), 8) AS mse_p025, round(any_value(m2), 8) AS mse_p975, round(any_value(a1), 8) AS mae_p025, round(any_value(a2), 8) AS mae_p975 FROM sl JOIN qt USING (model, baseline, slice) GROUP BY 1, 2, 3""")
def model_pairs(spark, sf_dir):
    """Sixteen fixed pairs of models in one plan: baseline minus model, with intervals from blocks of steps that all pairs and regions share."""
    return paired_losses(forecasts(spark, sf_dir), PAIRS)


def paired_losses(p: DataFrame, pairs, block: int = _BLOCK, replicates: int = _REPLICATES) -> DataFrame:
    """model, baseline, slice, n, delta_mse, delta_mae and their percentile intervals.

    Losses are averaged over regions first, so draws of steps serve every pair; draws are
    arithmetic. Steps are those of the calendar that was judged.
    """
    from pyspark.sql import Window

    spark = p.sparkSession
    e = F.col("prediction") - F.col("actual")
    loss = p.select("region", "t", "model", (e * e).alias("sq"), F.abs(e).alias("ab"))
    table = F.broadcast(spark.createDataFrame(list(pairs), "model string, baseline string"))  # the fixed pairs
    one = loss.join(table, "model")
    base = loss.select("region", "t", F.col("model").alias("baseline"), F.col("sq").alias("bs"), F.col("ab").alias("ba"))
    d = one.join(base.hint("shuffle_merge"), ["region", "t", "baseline"]).groupBy("model", "baseline", "t").agg(F.avg(F.col("bs") - F.col("sq")).alias("d_mse"), F.avg(F.col("ba") - F.col("ab")).alias("d_mae"), F.count("*").alias("regions"))
    steps = p.select("t").distinct().withColumn("pos", F.row_number().over(Window.orderBy("t")) - 1)  # one row per step judged
    n = steps.count()
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, -(-n // block) - 1)).cast("long")))
    dr = spark.range(replicates).select(F.col("id").alias("r"), k.alias("k")).withColumn("start", (F.col("r") * 7919 + F.col("k") * 104729) % max(1, n - block + 1))
    dr = dr.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(block - 1)))).filter(F.col("k") * block + F.col("o") < n).groupBy("r", (F.col("start") + F.col("o")).alias("pos")).agg(F.count("*").alias("w"))
    s = d.join(steps.hint("shuffle_merge"), "t").select("*", F.explode(F.array(F.lit("all"), F.when(F.col("t") % _YEAR < 26, "winter").otherwise("summer"))).alias("slice"))
    key = ["model", "baseline", "slice"]
    mean = lambda c: F.sum(F.col("w") * F.col(c)) / F.sum("w")
    b = s.join(dr.hint("shuffle_merge"), "pos").groupBy(*key, "r").agg(mean("d_mse").alias("m"), mean("d_mae").alias("a"))
    q = lambda c: F.percentile(c, F.array(F.lit(0.025), F.lit(0.975)))
    b = b.groupBy(*key).agg(q("m").alias("qm"), q("a").alias("qa"))
    a = s.groupBy(*key).agg(F.sum("regions").alias("n"), F.round(F.avg("d_mse"), 9).alias("delta_mse"), F.round(F.avg("d_mae"), 9).alias("delta_mae"))
    ends = [F.round(F.col(c)[i], 8).alias(f"{x}_{e}") for c, x in (("qm", "mse"), ("qa", "mae")) for i, e in enumerate(("p025", "p975"))]
    return a.join(b.hint("shuffle_merge"), key).select(*key, "n", "delta_mse", "delta_mae", *ends)
