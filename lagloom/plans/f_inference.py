"""Lag designs, nested tests, HAC and cluster errors, held-out gains, contrasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagloom.functions.tails import p_f, p_t, p_z
from lagloom.operators import gram, screen
from lagloom.operators.fdr import bh, bh_large
from lagloom.operators.lineage import stored
from lagloom.plans import section
from lagloom.sources.fixtures import climate_of, climate_sql, ctes, normal_tail_sql, panel, sources, station_series, stations
from lagloom.sources.sqltext import gram_sql, sweep_sql, t_tail_sql

QUERIES, query = section()
_H = ["target", "source", "lag"]


def climate(spark, sf_dir) -> DataFrame:
    """Standardised weekly anomalies of five nodes, gaps filled: t, node, variable, value. Stored once."""
    return stored(spark, "climate", sources(sf_dir, "lineitem"), lambda: climate_of(panel(spark, sf_dir)))


_ST = ctes("panel") + ", " + climate_sql("panel", "st")
_D = """d AS (SELECT y.t, y.node AS target, x.node AS source, l.lag, y.v AS y, o.v AS c, x.v AS z FROM st y JOIN st o ON o.node = y.node AND o.variable = 'humidity' AND o.t = y.t - 1
 CROSS JOIN (SELECT unnest(range(1, 4)) AS lag) l JOIN st x ON x.variable = 'wind' AND x.t = y.t - l.lag WHERE y.variable = 'humidity')"""


def _fit_sql(src: str, keys: str) -> str:
    return f"""m AS (SELECT {keys}, count(*) AS n, covar_pop(y, y) * count(*) AS syy, covar_pop(c, c) * count(*) AS scc, covar_pop(z, z) * count(*) AS szz, covar_pop(y, c) * count(*) AS syc, covar_pop(y, z) * count(*) AS syz, covar_pop(c, z) * count(*) AS scz,
 avg(y) AS my, avg(c) AS mc, avg(z) AS mz FROM {src} GROUP BY {keys}),
fit AS (SELECT *, szz - scz * scz / scc AS zss, syz - scz * syc / scc AS zy, syy - syc * syc / scc AS rss_r, n - 3 AS df FROM m)"""


_FIT = _fit_sql("d", "target, source, lag")
_SC = "sc AS (SELECT d.target, d.source, d.lag, d.t, f.n, f.df, f.zss, ((z - mz) - scz / scc * (c - mc)) AS zr, ((y - my) - syc / scc * (c - mc)) - zy / zss * ((z - mz) - scz / scc * (c - mc)) AS e FROM d JOIN fit f USING (target, source, lag))"


def _design(spark, sf_dir) -> DataFrame:
    return gram.lag_design(climate(spark, sf_dir), "wind", "humidity", 3, 1)


@query(f"""{_ST}, {_D}, {_FIT} SELECT target, source, lag::INT AS lag, n, round(zy / zss, 7) AS beta, round((zy * zy / zss) / ((rss_r - zy * zy / zss) / df), 5) AS f, round(sqrt((rss_r - zy * zy / zss) / df / zss), 7) AS se,
 round(zy * zy / zss / syy, 7) AS delta_r2, round(zy * zy / zss / rss_r, 7) AS partial_r2, round(zy * zy / zss / rss_r / (1 - zy * zy / zss / rss_r), 7) AS cohen_f2, round(zy / zss - 1.959963984540054 * sqrt((rss_r - zy * zy / zss) / df / zss), 6) AS low, round(zy / zss + 1.959963984540054 * sqrt((rss_r - zy * zy / zss) / df / zss), 6) AS high FROM fit""")
def nested_lag_tests(spark, sf_dir):
    f = gram.fit(_design(spark, sf_dir), _H, ["c1"])
    part, half = F.col("drop") / F.col("rss_r"), 1.959963984540054 * F.col("se")
    return f.select(
        *_H, "n", F.round("beta", 7).alias("beta"), F.round("f", 5).alias("f"), F.round("se", 7).alias("se"), F.round(F.col("drop") / F.col("tss"), 7).alias("delta_r2"), F.round(part, 7).alias("partial_r2"),
        F.round(part / (1 - part), 7).alias("cohen_f2"), F.round(F.col("beta") - half, 6).alias("low"), F.round(F.col("beta") + half, 6).alias("high"),
    )


def _links_sql() -> str:
    from lagloom.plans.h_reports import _CAND, _NEAR

    keys = "source_region, target_region, source_var, target_var, lag"
    return ctes("stations", "station_climate").replace("WITH ", "WITH RECURSIVE ", 1) + f""", {_NEAR}, {_CAND}, cd AS (SELECT DISTINCT source_region, target_region, source_var, target_var FROM cand WHERE source_var <> target_var),
yo AS MATERIALIZED (SELECT t, node, variable, v AS y, lag(v, 1) OVER w AS c1, lag(v, 2) OVER w AS c2 FROM sc WINDOW w AS (PARTITION BY node, variable ORDER BY t)), xl AS MATERIALIZED (SELECT node, variable, t + k AS t, k::BIGINT AS lag, v AS z FROM sc, range(1, 4) x(k)),
lr AS MATERIALIZED (SELECT source_region, target_region, source_var, target_var, lag, 1.0::DOUBLE AS one, c1, c2, z, y FROM cd JOIN yo ON yo.node = target_region AND yo.variable = target_var JOIN xl ON xl.node = source_region AND xl.variable = source_var AND xl.t = yo.t WHERE c2 IS NOT NULL),
{gram_sql("g", "lr", ["one", "c1", "c2", "z", "y"], keys)}, {sweep_sql("f", "g", 5, 4, keys)}, b AS (SELECT {keys}, n, m[20] AS beta, m[20] / sqrt(m[25] / (n - 4) * -m[19]) AS t FROM f), p AS (SELECT *, source_var || '->' || target_var AS edge_type, round({t_tail_sql("t", "(n - 4)")}, 9) AS p FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY edge_type ORDER BY p) AS k, count(*) OVER (PARTITION BY edge_type) AS c FROM p), q AS (SELECT *, least(1, min(p * c / k) OVER (PARTITION BY edge_type ORDER BY k DESC)) AS q FROM r)
SELECT {keys}, edge_type, n, round(beta, 7) AS beta, round(t * t, 4) AS f, p AS p_value, round(q, 8) AS q_value, q < 0.05 AS significant, round(sign(beta) * -log10(q + 1e-12) * abs(beta), 7) + 0.0 AS effect_score FROM q"""


@query(_links_sql())
def lag_links(spark, sf_dir):
    """Lagged links of all candidates of all stations: two own lags as controls, F test, q within each variable pair, strongest first."""
    from lagloom.plans.h_reports import candidates

    cand = candidates(stations(spark, sf_dir)).filter("source_var <> target_var")
    s = screen.screen(cand, station_series(spark, sf_dir), lags=3, own=2, regimes={"all": (1, 0, 1)}).filter("effect is not null")
    keys = ["source_region", "target_region", "source_var", "target_var", "lag"]
    t = F.col("effect") / F.col("se_ols")
    f = s.withColumn("f", t * t).withColumn("p_value", F.round(p_t(t, (F.col("n") - 4).cast("double")), 9))
    q = bh_large(f.withColumn("edge_type", F.concat_ws("->", "source_var", "target_var")), ["edge_type"], alpha=0.05)
    score = F.signum("effect") * -F.log10(F.col("q_value") + 1e-12) * F.abs("effect")
    out = q.select(*keys, "edge_type", "n", F.round("effect", 7).alias("beta"), F.round("f", 4).alias("f"), "p_value", F.round("q_value", 8).alias("q_value"), "significant", (F.round(score, 7) + 0.0).alias("effect_score"))
    return out.orderBy("q_value", "p_value", F.desc(F.abs("beta")), *keys)


@query(f"""{_ST}, {_D}, {_FIT}, p AS (SELECT target, source, lag, round({t_tail_sql("(zy / sqrt(zss * (rss_r - zy * zy / zss) / df))", "df")}, 9) AS p FROM fit), r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY p) AS k, count(*) OVER (PARTITION BY target) AS c FROM p), q AS (SELECT *, least(1, min(p * c / k) OVER (PARTITION BY target ORDER BY k DESC)) AS q FROM r)
 SELECT target, source, lag::INT AS lag, p AS p_value, round(q, 12) AS q_value, q < 0.05 AS significant FROM q""")
def lag_tests_p_values(spark, sf_dir):
    f = gram.fit(_design(spark, sf_dir), _H, ["c1"])
    q = bh(f.withColumn("p_value", F.round(p_f("f", F.lit(1.0), F.col("df").cast("double")), 9)), ["target"])
    return q.select(*_H, "p_value", F.round("q_value", 12).alias("q_value"), "significant")


@query(f"""{_ST}, {_D}, {_FIT}, {_SC}, ser AS (SELECT g.target, g.source, g.lag, tt.t, coalesce(zr * e, 0) AS s FROM fit g CROSS JOIN (SELECT unnest(range((SELECT min(t) FROM st), (SELECT max(t) FROM st) + 5)) AS t) tt LEFT JOIN sc ON sc.target = g.target AND sc.source = g.source AND sc.lag = g.lag AND sc.t = tt.t),
 mv AS (SELECT target, source, lag, sum(s) OVER (PARTITION BY target, source, lag ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS m FROM ser), mt AS (SELECT target, source, lag, sum(m * m) / 5 AS meat FROM mv GROUP BY 1, 2, 3)
 SELECT target, source, lag::INT AS lag, round(zy / zss, 7) AS beta, round(sqrt(meat * n / df) / zss, 7) AS se_hac, round(zy / (sqrt(meat * n / df)), 5) AS z_hac FROM fit JOIN mt USING (target, source, lag)""")
def hac_lag_tests(spark, sf_dir):
    f = gram.hac(_design(spark, sf_dir), _H, ["c1"], 4)
    return f.select(*_H, F.round("beta", 7).alias("beta"), F.round("se_hac", 7).alias("se_hac"), F.round(F.col("beta") / F.col("se_hac"), 5).alias("z_hac"))


@query(f"""{_ST}, {_D}, {_FIT}, {_SC}, h AS (SELECT target, source, lag, sum(s * (s + 2 * ((1 - t / 9.0) * coalesce(s0, 0) + coalesce(s1, 0) / 9.0))) AS meat FROM (SELECT *, sum(s) OVER w AS s0, sum(s * t) OVER w AS s1 FROM (SELECT target, source, lag, t, zr * e AS s FROM sc) WINDOW w AS (PARTITION BY target, source, lag ORDER BY t RANGE BETWEEN 8 PRECEDING AND 1 PRECEDING)) GROUP BY 1, 2, 3)
 SELECT target, source, lag::INT AS lag, round({normal_tail_sql("(zy / sqrt(meat * n / df))")}, 7) AS p_hac, round({t_tail_sql("(zy / sqrt(zss * (rss_r - zy * zy / zss) / df))", "df")}, 7) AS p_ols FROM fit JOIN h USING (target, source, lag)""")
def hac_p_values(spark, sf_dir):
    f = gram.hac(_design(spark, sf_dir), _H, ["c1"], 8)
    return f.select(*_H, F.round(p_z(F.col("beta") / F.col("se_hac")), 7).alias("p_hac"), F.round(p_t(F.col("beta") / F.col("se"), F.col("df").cast("double")), 7).alias("p_ols"))


@query(f"""{_ST}, {_D}, {_FIT}, {_SC}, b AS (SELECT target, source, lag, t // 16 AS b, sum(zr * e) AS s, any_value(n) AS n, any_value(df) AS df, any_value(zss) AS zss FROM sc GROUP BY 1, 2, 3, 4)
 SELECT target, source, lag::INT AS lag, count(*) AS blocks, round(sqrt(count(*) / (count(*) - 1)::DOUBLE * (any_value(n) - 1) / any_value(df)::DOUBLE * sum(s * s)) / any_value(zss), 7) AS se_cluster FROM b GROUP BY 1, 2, 3""")
def cluster_lag_tests(spark, sf_dir):
    rows = _design(spark, sf_dir)
    s = gram.scores(rows, gram.fit(rows, _H, ["c1"]), _H, ["c1"])
    return gram.clusters(s, _H, 16).select(*_H, "blocks", F.round("se_cluster", 7).alias("se_cluster"))


@query(f"""{_ST}, {_D}, {_FIT}, {_SC}, k AS (SELECT unnest([1, 4, 12, 28]) AS h), x AS (SELECT a.target, a.source, a.lag, h, sum(a.e * b.e) / sqrt(sum(a.e * a.e) * sum(b.e * b.e)) AS acf FROM sc a CROSS JOIN k JOIN sc b ON a.target = b.target AND a.source = b.source AND a.lag = b.lag AND b.t = a.t - h GROUP BY 1, 2, 3, 4)
 SELECT h, count(*) AS n, round(quantile_cont(abs(acf), 0.5), 6) AS median, round(quantile_cont(abs(acf), 0.9), 6) AS p90, round(avg(CASE WHEN abs(acf) > 0.1 THEN 1.0 ELSE 0.0 END), 6) AS above FROM x GROUP BY 1""")
def residual_autocorrelation(spark, sf_dir):
    rows = _design(spark, sf_dir)
    s = gram.scores(rows, gram.fit(rows, _H, ["c1"]), _H, ["c1"]).select(*_H, "t", "e")
    b = s.withColumn("h", F.explode(F.array(F.lit(1), F.lit(4), F.lit(12), F.lit(28)))).select(*_H, "h", (F.col("t") + F.col("h")).alias("t"), F.col("e").alias("b"))
    x = s.join(b, [*_H, "t"]).groupBy(*_H, "h").agg((F.sum(F.col("e") * F.col("b")) / F.sqrt(F.sum(F.col("e") * F.col("e")) * F.sum(F.col("b") * F.col("b")))).alias("acf"))
    a = F.abs("acf")
    return x.groupBy("h").agg(F.count("*").alias("n"), F.round(F.percentile(a, 0.5), 6).alias("median"), F.round(F.percentile(a, 0.9), 6).alias("p90"), F.round(F.avg(F.when(a > 0.1, 1.0).otherwise(0.0)), 6).alias("above"))


@query(f"""{_ST}, w AS (SELECT t, node, max(CASE WHEN variable = 'wind' THEN v END) AS w, max(CASE WHEN variable = 'humidity' THEN v END) AS h, max(CASE WHEN variable = 'cloud_cover' THEN v END) AS cl FROM st GROUP BY 1, 2),
 x AS (SELECT a.node, a.cl AS y, b.h AS c, b.w AS z FROM w a JOIN w b ON b.node = a.node AND b.t = a.t - 1),
 m AS (SELECT node, covar_pop(y, z) / var_pop(z) AS direct, covar_pop(z, c) AS zc, var_pop(z) AS zz, var_pop(c) AS cc, covar_pop(y, z) AS yz, covar_pop(y, c) AS yc FROM x GROUP BY 1)
 SELECT node, round(direct, 7) AS direct, round((yz - zc * yc / cc) / (zz - zc * zc / cc), 7) AS controlled, round(1 - abs((yz - zc * yc / cc) / (zz - zc * zc / cc)) / abs(direct), 5) AS reduction FROM m""")
def humidity_mediation(spark, sf_dir):
    wide = climate(spark, sf_dir).groupBy("t", "node").pivot("variable", ["wind", "humidity", "cloud_cover"]).agg(F.first("value"))
    x = wide.select((F.col("t") + 1).alias("t"), "node", F.col("humidity").alias("c"), F.col("wind").alias("z")).join(wide.select("t", "node", F.col("cloud_cover").alias("y")), ["t", "node"])
    d = gram.fit(x, ["node"], []).select("node", F.col("beta").alias("direct"))
    c = gram.fit(x, ["node"], ["c"]).select("node", F.col("beta").alias("controlled"))
    red = F.when(F.abs("direct") > 1e-12, 1 - F.abs("controlled") / F.abs("direct"))
    return d.join(c, "node").select("node", F.round("direct", 7).alias("direct"), F.round("controlled", 7).alias("controlled"), F.round(red, 5).alias("reduction"))


_TR = _fit_sql("(SELECT * FROM d WHERE t < 250)", "target, source, lag")


@query(f"""{_ST}, {_D}, {_TR}, l AS (SELECT d.target, d.source, d.lag, d.t, pow((y - my) - syc / scc * (c - mc), 2) - pow((y - my) - syc / scc * (c - mc) - zy / zss * ((z - mz) - scz / scc * (c - mc)), 2) AS gain FROM d JOIN fit USING (target, source, lag) WHERE d.t >= 260)
 SELECT target, source, lag::INT AS lag, count(*) AS n, round(avg(gain), 8) AS gain FROM l GROUP BY 1, 2, 3""")
def frozen_holdout_gains(spark, sf_dir):
    rows = _design(spark, sf_dir)
    f = gram.fit(rows.filter("t < 250"), _H, ["c1"])
    s = gram.scores(rows.filter("t >= 260"), f, _H, ["c1"])
    restricted = F.col("e") + F.col("zr") * F.col("beta")
    return s.groupBy(*_H).agg(F.count("*").alias("n"), F.round(F.avg(restricted * restricted - F.col("e") * F.col("e")), 8).alias("gain"))


def _groups(spark, sf_dir) -> DataFrame:
    return _design(spark, sf_dir).filter("lag = 1").withColumn("s", F.when(F.col("t") % 52 < 26, 1.0).otherwise(0.0))


_GS = _fit_sql("(SELECT *, CASE WHEN t % 52 < 26 THEN 1 ELSE 0 END AS s FROM d WHERE lag = 1)", "target, source, s")


@query(f"{_ST}, {_D}, {_GS} SELECT a.target, a.source, round(b.zy / b.zss, 6) AS reference, round(a.zy / a.zss, 6) AS high, round(a.zy / a.zss - b.zy / b.zss, 6) AS delta FROM fit a JOIN fit b USING (target, source) WHERE a.s = 1 AND b.s = 0")
def regime_contrast(spark, sf_dir):
    """High minus reference slope from one saturated design; equals the difference of two separate fits."""
    s = F.col("s")
    rows = _groups(spark, sf_dir).withColumns({"cs": F.col("c1") * s, "x0": F.col("z") * (1 - s), "x1": F.col("z") * s})
    high = gram.fit(rows, ["target", "source"], ["s", "c1", "cs", "x0"], z="x1").select("target", "source", F.col("beta").alias("high"))
    ref = gram.fit(rows, ["target", "source"], ["s", "c1", "cs", "x1"], z="x0").select("target", "source", F.col("beta").alias("reference"))
    delta = gram.fit(rows, ["target", "source"], ["s", "c1", "cs", "z"], z="x1").select("target", "source", F.col("beta").alias("delta"))
    j = high.join(ref, ["target", "source"]).join(delta, ["target", "source"])
    return j.select("target", "source", *[F.round(c, 6).alias(c) for c in ("reference", "high", "delta")])


@query(f"""{_ST}, {_D}, {_GS}, g AS (SELECT *, CASE WHEN t % 52 < 26 THEN 1 ELSE 0 END AS s FROM d WHERE lag = 1), v AS (SELECT g.target, g.source, g.t, CASE WHEN g.s = 1 THEN 1 ELSE -1 END * ((z - mz) - scz / scc * (c - mc)) / zss * (((y - my) - syc / scc * (c - mc)) - zy / zss * ((z - mz) - scz / scc * (c - mc))) AS v FROM g JOIN fit USING (target, source, s)),
 h AS (SELECT target, source, count(*) AS n, sum(v * (v + 2 * ((1 - t / 9.0) * coalesce(s0, 0) + coalesce(s1, 0) / 9.0))) AS var FROM (SELECT *, sum(v) OVER w AS s0, sum(v * t) OVER w AS s1 FROM v WINDOW w AS (PARTITION BY target, source ORDER BY t RANGE BETWEEN 8 PRECEDING AND 1 PRECEDING)) GROUP BY 1, 2),
 k AS (SELECT target, source, a.zy / a.zss - b.zy / b.zss AS delta, sqrt(h.var * h.n / (h.n - 6)) AS se FROM fit a JOIN fit b USING (target, source) JOIN h USING (target, source) WHERE a.s = 1 AND b.s = 0), p AS (SELECT *, round({normal_tail_sql("(delta / se)")}, 9) AS p FROM k), r AS (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM p), q AS (SELECT *, least(1, min(p * m / k) OVER (ORDER BY k DESC)) AS q FROM r)
 SELECT target, source, round(delta, 6) AS delta, round(se, 7) AS se_hac, p AS p_value, round(q, 12) AS q_value FROM q""")
def regime_contrast_hac(spark, sf_dir):
    s = F.col("s")
    rows = _groups(spark, sf_dir).withColumns({"cs": F.col("c1") * s, "x1": F.col("z") * s})
    f = gram.hac(rows, ["target", "source"], ["s", "c1", "cs", "z"], 8, z="x1").withColumn("p_value", F.round(p_z(F.col("beta") / F.col("se_hac")), 9))
    return bh_large(f).select("target", "source", F.round("beta", 6).alias("delta"), F.round("se_hac", 7).alias("se_hac"), "p_value", F.round("q_value", 12).alias("q_value"))


@query(ctes("panel_ship") + """, l AS (SELECT t, flag, pow(price - avg(price) OVER (PARTITION BY flag), 2) / 1e6 AS x FROM panel_ship), c AS (SELECT t, flag, x, x - avg(x) OVER (PARTITION BY flag) AS c FROM l),
 g AS (SELECT k.flag, tt.t, coalesce(c.c, 0) AS c FROM (SELECT DISTINCT flag FROM panel_ship) k CROSS JOIN (SELECT unnest(range((SELECT min(t) FROM panel_ship), (SELECT max(t) FROM panel_ship) + 9)) AS t) tt LEFT JOIN c ON c.flag = k.flag AND c.t = tt.t),
 mv AS (SELECT flag, sum(c) OVER (PARTITION BY flag ORDER BY t ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS m FROM g), mt AS (SELECT flag, sum(m * m) / 9 AS meat FROM mv GROUP BY 1), a AS (SELECT flag, count(*) AS n, avg(x) AS mean FROM l GROUP BY 1)
 SELECT flag, n, round(mean, 6) AS mean, round(sqrt(meat * n / (n - 1)) / n, 7) AS se FROM a JOIN mt USING (flag)""")
def hac_mean(spark, sf_dir):
    from lagloom.sources.fixtures import panel_ship

    p = panel_ship(spark, sf_dir)
    x = F.pow(F.col("price") - F.avg("price").over(Window.partitionBy("flag")), 2) / 1e6
    return gram.mean_hac(p.select("t", "flag", x.alias("x")), ["flag"], "x", 8).select("flag", "n", F.round("mean", 6).alias("mean"), F.round("se", 7).alias("se"))
