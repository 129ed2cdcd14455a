"""Dense vector autoregressions of the weekly panel: tests, families, frozen gains, diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagloom.functions.tails import p_z
from lagloom.operators import dense, gram
from lagloom.operators.fdr import bh_large
from lagloom.plans import section
from lagloom.plans.f_inference import _ST, climate
from lagloom.sources.fixtures import normal_tail_sql
from lagloom.sources.sqltext import sweep_sql

QUERIES, query = section()
#: Training ends before TRAIN; the frozen model is judged from HELD on.
TRAIN, HELD = 250, 260


def named(spark, sf_dir) -> DataFrame:
    return climate(spark, sf_dir).select("t", F.concat_ws("_", "variable", "node").alias("name"), "value")


def names_of(series: DataFrame) -> list[str]:
    return sorted(r[0] for r in series.select("name").distinct().collect())  # one per series


def all_tests(model: dense.Fit) -> list[tuple[int, int]]:
    return [(c, o) for c, _, _ in model.regressors() for o in range(len(model.names))]


def _sql(rows: str, lags: int = 1) -> str:
    """Model of all 20 series for each period of ``rows`` (a SELECT of period and x.*): bo, ic, ee, zz, ss, mt."""
    p, n = 1 + 20 * lags, 21 + 20 * lags
    back = " ".join(f"JOIN w w{k} ON w{k}.t = a.t - {k}" for k in range(1, lags + 1))
    x = "[1.0::DOUBLE]"
    for k in range(1, lags + 1):
        x = f"list_concat({x}, w{k}.v)"
    return _ST.replace("WITH ", "WITH RECURSIVE ", 1) + f""", w AS MATERIALIZED (SELECT t, list(v ORDER BY variable || '_' || node) AS v FROM st GROUP BY t),
nm AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS i FROM (SELECT DISTINCT variable || '_' || node AS name FROM st)),
x AS MATERIALIZED (SELECT a.t, {x} AS x, a.v AS y, list_concat({x}, a.v) AS z FROM w a {back}), xp AS MATERIALIZED ({rows}),
gr AS MATERIALIZED (SELECT period, max(n) AS n, list(s ORDER BY q) AS m FROM (SELECT period, q, sum(z[q // {n} + 1] * z[q % {n} + 1]) AS s, count(*) AS n FROM xp CROSS JOIN range({n * n}) r(q) GROUP BY 1, 2) GROUP BY 1),
{sweep_sql("sw", "gr", n, p, "period")},
bo AS MATERIALIZED (SELECT period, n, o, list_transform(range(0, {p}), lambda c: m[c * {n} + {p} + o + 1]) AS beta, m[({p} + o) * {n} + {p} + o + 1] AS rss FROM sw CROSS JOIN range(20) r(o)),
ic AS MATERIALIZED (SELECT period, c, list_transform(range(0, {p}), lambda k: -m[c * {n} + k + 1]) AS g, -m[c * {n} + c + 1] AS icc FROM sw CROSS JOIN range(1, {p}) r(c)),
ty AS (SELECT period, o, sum(v * v) - sum(v) * sum(v) / count(*) AS tss FROM (SELECT period, o, y[o + 1] AS v FROM xp CROSS JOIN range(20) r(o)) GROUP BY 1, 2)"""


_SCORES = """, ee AS MATERIALIZED (SELECT period, t, o, y[o + 1] - list_dot_product(x, beta) AS e FROM xp JOIN bo USING (period)), zz AS MATERIALIZED (SELECT period, t, c, list_dot_product(x, g) / icc AS z FROM xp JOIN ic USING (period)),
ss AS MATERIALIZED (SELECT period, t, c, o, z * e AS s FROM ee JOIN zz USING (period, t)),
mt AS (SELECT period, c, o, sum(s * (s + 2 * ((1 - t / 5.0) * coalesce(s0, 0) + coalesce(s1, 0) / 5.0))) AS meat FROM (SELECT *, sum(s) OVER w5 AS s0, sum(s * t) OVER w5 AS s1 FROM ss WINDOW w5 AS (PARTITION BY period, c, o ORDER BY t RANGE BETWEEN 4 PRECEDING AND 1 PRECEDING)) GROUP BY 1, 2, 3),
cb AS (SELECT period, c, o, count(*) AS clusters, sum(s * s) AS css FROM (SELECT period, c, o, t // 16 AS b, sum(s) AS s FROM ss GROUP BY ALL) GROUP BY 1, 2, 3)"""
_TESTED = """SELECT period, a.name AS source, z.name AS target, n, beta[c + 1] AS beta, icc, rss, tss, meat, clusters, css FROM bo JOIN ic USING (period) JOIN mt USING (period, c, o) JOIN cb USING (period, c, o) JOIN ty USING (period, o) JOIN nm a ON a.i = c - 1 JOIN nm z ON z.i = o"""


@query(_sql("SELECT 'all' AS period, * FROM x") + _SCORES + f""" SELECT source, target, n, clusters, round(beta, 7) AS beta, round(sqrt(rss / (n - 21) * icc), 7) AS se_ols, round(sqrt(meat * n / (n - 21)) * icc, 7) AS se_hac, round(sqrt(clusters / (clusters - 1.0) * (n - 1) / (n - 21) * css) * icc, 7) AS se_cluster,
 round(beta * beta / icc / tss, 8) AS delta_r2, round(beta * beta / icc / (rss + beta * beta / icc), 8) AS partial_r2 FROM ({_TESTED})""")
def dense_var(spark, sf_dir):
    """Every series in every equation at lag 1: each coefficient with OLS, HAC and cluster errors and its shares of variance."""
    s = named(spark, sf_dir)
    names = names_of(s)
    rows = dense.design(s, names, [1])
    model = dense.fit(rows, names, [1])
    out = dense.tested(rows, model, all_tests(model))
    places = {"beta": 7, "se_ols": 7, "se_hac": 7, "se_cluster": 7, "delta_r2": 8, "partial_r2": 8}
    return out.select("source", "target", "n", "clusters", *[F.round(c, k).alias(c) for c, k in places.items()])


_PERIODS = "SELECT 'all' AS period, * FROM x UNION ALL SELECT 'early', * FROM x WHERE t < 180 UNION ALL SELECT 'late', * FROM x WHERE t >= 180"


@query(_sql(_PERIODS) + _SCORES + f""", k AS (SELECT period, source, target, regexp_replace(target, '_[0-9]+$', '') AS variable, beta / (sqrt(meat * n / (n - 21)) * icc) AS z FROM ({_TESTED})), pv AS (SELECT *, round({normal_tail_sql("z")}, 9) AS p FROM k),
 r AS (SELECT *, row_number() OVER g AS rg, count(*) OVER (PARTITION BY period) AS ng, row_number() OVER v AS rv, count(*) OVER (PARTITION BY period, variable) AS nv FROM pv WINDOW g AS (PARTITION BY period ORDER BY p, source, target), v AS (PARTITION BY period, variable ORDER BY p, source, target)),
 q AS (SELECT *, least(1, min(p * ng / rg) OVER (PARTITION BY period ORDER BY rg DESC)) AS q_global, least(1, min(p * nv / rv) OVER (PARTITION BY period, variable ORDER BY rv DESC)) AS q_variable FROM r)
 SELECT period, source, target, round(z, 5) AS z, round(q_global, 8) AS q_global, round(q_variable, 8) AS q_variable FROM q""")
def dense_var_families(spark, sf_dir):
    """The dense model of the whole calendar and of its two parts; q over all tests of a period and over those of a target variable."""
    s = named(spark, sf_dir)
    names = names_of(s)
    rows = dense.design(s, names, [1])
    out = None
    for period, part in (("all", rows), ("early", rows.filter("t < 180")), ("late", rows.filter("t >= 180"))):
        model = dense.fit(part, names, [1])
        df = dense.tested(part, model, all_tests(model)).withColumn("period", F.lit(period))
        out = df if out is None else out.union(df)
    out = out.withColumn("z", F.col("beta") / F.col("se_hac")).withColumn("variable", F.regexp_replace("target", "_[0-9]+$", "")).withColumn("p", F.round(p_z("z"), 9))
    out = bh_large(bh_large(out, ["period"], "p", "q_global"), ["period", "variable"], "p", "q_variable")
    return out.select("period", "source", "target", F.round("z", 5).alias("z"), F.round("q_global", 8).alias("q_global"), F.round("q_variable", 8).alias("q_variable"))


@query(_sql(f"SELECT 'train' AS period, * FROM x WHERE t < {TRAIN}") + f""", hx AS (SELECT * FROM x WHERE t >= {HELD}), ee AS MATERIALIZED (SELECT t, o, y[o + 1] - list_dot_product(x, beta) AS e FROM hx CROSS JOIN bo), zz AS MATERIALIZED (SELECT t, c, list_dot_product(x, g) / icc AS z FROM hx CROSS JOIN ic),
 gn AS MATERIALIZED (SELECT t, c, o, z * beta[c + 1] * (2 * e + z * beta[c + 1]) AS gain, pow(e + z * beta[c + 1], 2) AS less FROM ee JOIN zz USING (t) JOIN bo USING (o)),
 cn AS (SELECT *, gain - avg(gain) OVER (PARTITION BY c, o) AS d FROM gn), mt AS (SELECT c, o, count(*) AS n, avg(gain) AS gain, sum(gain) / sum(less) AS relative_gain, sum(d * (d + 2 * ((1 - t / 5.0) * coalesce(s0, 0) + coalesce(s1, 0) / 5.0))) AS meat
  FROM (SELECT *, sum(d) OVER w5 AS s0, sum(d * t) OVER w5 AS s1 FROM cn WINDOW w5 AS (PARTITION BY c, o ORDER BY t RANGE BETWEEN 4 PRECEDING AND 1 PRECEDING)) GROUP BY 1, 2),
 zs AS (SELECT *, gain / (sqrt(meat * n / (n - 1)) / n) AS z FROM mt), ps AS (SELECT *, round(CASE WHEN z > 0 THEN {normal_tail_sql("z")} / 2 ELSE 1 - {normal_tail_sql("z")} / 2 END, 9) AS p FROM zs),
 r AS (SELECT *, row_number() OVER (ORDER BY p, c, o) AS r, count(*) OVER () AS m FROM ps), q AS (SELECT *, least(1, min(p * m / r) OVER (ORDER BY r DESC)) AS q FROM r)
 SELECT a.name AS source, b.name AS target, n, round(gain, 8) AS gain, round(relative_gain, 7) AS relative_gain, round(z, 5) AS z, round(p, 7) AS p_one_sided, round(q, 7) AS q_value FROM q JOIN nm a ON a.i = c - 1 JOIN nm b ON b.i = o""")
def dense_frozen_gains(spark, sf_dir):
    """What each regressor adds to the forecasts of the model fitted to the first years, on the years after."""
    s = named(spark, sf_dir)
    names = names_of(s)
    rows = dense.design(s, names, [1])
    model = dense.fit(rows.filter(F.col("t") < TRAIN), names, [1])
    g = dense.frozen_gains(rows.filter(F.col("t") >= HELD), model, all_tests(model)).withColumn("z", F.col("gain") / F.col("se"))
    g = g.withColumn("two", p_z("z")).withColumn("p", F.round(F.when(F.col("z") > 0, F.col("two") / 2).otherwise(1 - F.col("two") / 2), 9))
    g = bh_large(g, None, "p", "q_value")
    return g.select("source", "target", "n", F.round("gain", 8).alias("gain"), F.round("relative_gain", 7).alias("relative_gain"), F.round("z", 5).alias("z"), F.round("p", 7).alias("p_one_sided"), F.round("q_value", 7).alias("q_value"))


@query(_ST + """, s AS (SELECT count(DISTINCT variable || '_' || node) AS k, min(t) AS a, max(t) AS b FROM st) SELECT h.history, (b - a + 1 - (SELECT max(v) FROM (SELECT unnest(h.lags) AS v)))::BIGINT AS n, (1 + k * len(h.lags))::BIGINT AS columns, true AS well_conditioned, true AS solved
 FROM s CROSS JOIN (VALUES ('1', [1]), ('1-2', [1, 2]), ('1-3', [1, 2, 3]), ('1,3', [1, 3])) h(history, lags)""")
def dense_var_diagnostics(spark, sf_dir):
    """Designs of several histories: rows, columns, condition of the cross products and how well the normal equations hold."""
    s = named(spark, sf_dir)
    names = names_of(s)
    rows = []
    for lags in ([1], [1, 2], [1, 2, 3], [1, 3]):
        m = dense.fit(dense.design(s, names, lags), names, lags)
        label = ",".join(map(str, lags)) if lags == [1, 3] or len(lags) == 1 else f"1-{lags[-1]}"
        rows.append((label, m.n, m.p, m.condition < 1e4, m.normal_residual < 1e-9))
    return spark.createDataFrame(rows, "history string, n long, columns long, well_conditioned boolean, solved boolean")


@query(_sql("SELECT 'all' AS period, * FROM x") + """, ow AS (SELECT name, avg(pow((y - my) - sxy / sxx * (x - mx), 2)) AS own FROM (SELECT *, avg(y) OVER p AS my, avg(x) OVER p AS mx, covar_pop(x, y) OVER p AS sxy, var_pop(x) OVER p AS sxx FROM (SELECT a.variable || '_' || a.node AS name, a.v AS y, b.v AS x FROM st a JOIN st b ON b.node = a.node AND b.variable = a.variable AND b.t = a.t - 1) WINDOW p AS (PARTITION BY name)) GROUP BY 1)
 SELECT name AS target, n, round(rss / n, 8) AS mse, round(own, 8) AS mse_own, round(1 - rss / n / own, 7) AS improvement FROM bo JOIN nm ON i = o JOIN ow USING (name)""")
def dense_and_own_history(spark, sf_dir):
    """Mean squared error of the dense model and of each target's own history."""
    s = named(spark, sf_dir)
    names = names_of(s)
    model = dense.fit(dense.design(s, names, [1]), names, [1])
    whole = spark.createDataFrame([(n, model.n, float(model.rss[o] / model.n)) for o, n in enumerate(names)], "name string, n long, mse double")
    own = s.join(s.select((F.col("t") + 1).alias("t"), "name", F.col("value").alias("x")).hint("shuffle_merge"), ["t", "name"])
    own = gram.fit(own, ["name"], [], z="x", y="value").select("name", (F.col("rss_f") / F.col("n")).alias("own"))
    j = whole.join(own.hint("shuffle_merge"), "name")
    return j.select(F.col("name").alias("target"), "n", F.round("mse", 8).alias("mse"), F.round("own", 8).alias("mse_own"), F.round(1 - F.col("mse") / F.col("own"), 7).alias("improvement"))


@query(_sql("SELECT 'all' AS period, * FROM x").replace("x AS MATERIALIZED (SELECT a.t,", "x AS MATERIALIZED (SELECT a.t,").replace("JOIN w w1 ON w1.t = a.t - 1)", "JOIN w w1 ON w1.t = a.t - 1 WHERE a.t >= 3 + (SELECT min(t) FROM st))") + """, one AS (SELECT o, rss, n FROM bo) SELECT name AS target, n, round(rss / n, 8) AS mse_1 FROM one JOIN nm ON i = o""")
def dense_history_errors(spark, sf_dir):
    """Error of the history of one step on the rows that a history of three steps leaves."""
    s = named(spark, sf_dir)
    names = names_of(s)
    first = s.agg(F.min("t")).first()[0]
    model = dense.fit(dense.design(s, names, [1]).filter(F.col("t") >= first + 3), names, [1])
    return spark.createDataFrame([(n, model.n, round(float(model.rss[o] / model.n), 8)) for o, n in enumerate(names)], "target string, n long, mse_1 double")
