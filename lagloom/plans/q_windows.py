"""Joint lag windows, block tests, conditioning sets, paths and signed lags of the stations' own links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagloom.functions.tails import p_t
from lagloom.operators import joint, reports, screen
from lagloom.plans import section
from lagloom.plans.o_contrasts import _hac_sql
from lagloom.sources.fixtures import ctes, edges, normal_tail_sql, station_bundles, station_climate
from lagloom.sources.sqltext import gram_sql, sweep_sql, t_tail_sql

QUERIES, query = section()
TRAIN, HELD = 250, 260
_V = {"h": "humidity", "w": "wind", "c": "cloud_cover", "e": "temperature"}


def bundled(spark, sf_dir) -> DataFrame:
    """One row per station with the four series. Stored once."""
    return station_bundles(spark, sf_dir)


def _rows_sql(terms: dict[str, tuple[str, int]], where: str = "true") -> str:
    """CTE wr: node, t, one = 1 and a column per term, for steps that have all of them."""
    names = list(terms)
    first = names[0]
    joins = " ".join(f"JOIN sc {n} ON {n}.node = {first}.node AND {n}.variable = '{v}' AND {n}.t = {first}.t - ({k})" for n, (v, k) in list(terms.items())[1:])
    cols = ", ".join(f"{n}.v AS {n}" for n in names)
    return f"wr AS MATERIALIZED (SELECT * FROM (SELECT {first}.node, {first}.t, 1.0::DOUBLE AS one, {cols} FROM sc {first} {joins} WHERE {first}.variable = '{terms[first][0]}') WHERE {where})"


_BASE = ctes("stations", "station_climate").replace("WITH ", "WITH RECURSIVE ", 1)
_JOINT = {"y": ("humidity", 0), "c1": ("humidity", 1), "w1": ("wind", 1), "w2": ("wind", 2), "w3": ("wind", 3)}
_WINDOW = _BASE + f""", {_rows_sql(_JOINT)}, {gram_sql("g", "wr", ["one", "c1", "w1", "w2", "w3", "y"], "node")}, {sweep_sql("f", "g", 6, 5, "node")}, {gram_sql("g0", "wr", ["one", "c1", "y"], "node")}, {sweep_sql("f0", "g0", 3, 2, "node")},
er AS (SELECT r.*, y - (one * m[6] + c1 * m[12] + w1 * m[18] + w2 * m[24] + w3 * m[30]) AS e, m, n FROM wr r JOIN f USING (node)),
zr AS MATERIALIZED (SELECT node, t, lag::BIGINT AS lag, n, m[(lag + 1) * 6 + 6] AS beta, -m[(lag + 1) * 6 + lag + 2] AS icc, m[36] AS rss, -(one * m[(lag + 1) * 6 + 1] + c1 * m[(lag + 1) * 6 + 2] + w1 * m[(lag + 1) * 6 + 3] + w2 * m[(lag + 1) * 6 + 4] + w3 * m[(lag + 1) * 6 + 5]) * e * sqrt(n / (n - 5.0)) AS v, CASE lag WHEN 1 THEN w1 WHEN 2 THEN w2 ELSE w3 END AS w FROM er CROSS JOIN range(1, 4) k(lag)),
{_hac_sql("hv", "zr", "node, lag")}"""


@query(_WINDOW + " SELECT node, lag, any_value(n) AS n, round(any_value(beta), 7) AS beta, round(sqrt(any_value(var)), 7) AS se_hac, round(1 / any_value(icc) / (var_pop(w) * count(*)), 7) AS variance_fraction, round(any_value(beta * beta / icc / (rss + beta * beta / icc)), 8) AS partial_r2 FROM zr JOIN hv USING (node, lag) GROUP BY 1, 2")
def joint_lag_window(spark, sf_dir):
    """Wind at three lags together in each station's humidity: each lag given the others, with the share of its variance that is its own."""
    r = joint.block_tests(bundled(spark, sf_dir), "node", "humidity", [("humidity", 1)], [("wind", k) for k in (1, 2, 3)])
    return r.select("node", "lag", "n", *[F.round(c, 7).alias(c) for c in ("beta", "se_hac", "variance_fraction")], F.round("partial_r2", 8).alias("partial_r2"))


_COV = ", ".join(f"sum(a.v{i} * (a.v{j} + s{j}) + a.v{j} * s{i})" if i != j else f"sum(a.v{i} * (a.v{i} + 2 * s{i}))" for i in (1, 2, 3) for j in (1, 2, 3))


@query(_WINDOW + f""", pv AS (SELECT node, t, max(v) FILTER (lag = 1) AS v1, max(v) FILTER (lag = 2) AS v2, max(v) FILTER (lag = 3) AS v3, max(beta) FILTER (lag = 1) AS b1, max(beta) FILTER (lag = 2) AS b2, max(beta) FILTER (lag = 3) AS b3 FROM zr GROUP BY 1, 2),
 sv AS (SELECT *, {", ".join(f"(1 - t / 5.0) * coalesce(sum(v{i}) OVER w, 0) + coalesce(sum(v{i} * t) OVER w, 0) / 5.0 AS s{i}" for i in (1, 2, 3))} FROM pv WINDOW w AS (PARTITION BY node ORDER BY t RANGE BETWEEN 4 PRECEDING AND 1 PRECEDING)),
 cv AS (SELECT node, [{_COV}] AS v, max(b1) AS b1, max(b2) AS b2, max(b3) AS b3 FROM sv a GROUP BY 1), wm AS MATERIALIZED (SELECT node, 0 AS n, [v[1], v[2], v[3], b1, v[4], v[5], v[6], b2, v[7], v[8], v[9], b3, b1, b2, b3, 0.0] AS m FROM cv), {sweep_sql("wf", "wm", 4, 3, "node")}, x AS (SELECT node, -m[16] AS wald FROM wf)
 SELECT node, round(wald, 5) AS wald, round({normal_tail_sql("sqrt(wald)")} + sqrt(2 * wald / pi()) * exp(-wald / 2), 7) AS p_value, round(1 - f.m[36] / f0.m[9], 8) AS block_r2 FROM x JOIN f USING (node) JOIN f0 USING (node)""")
def block_wald_tests(spark, sf_dir):
    """The three lags as one block: Wald statistic with the HAC covariance of their scores, and the block's share of variance."""
    r = joint.block_tests(bundled(spark, sf_dir), "node", "humidity", [("humidity", 1)], [("wind", k) for k in (1, 2, 3)]).filter("lag = 1")
    return r.select("node", "wald", "block_r2").select("node", F.round("wald", 5).alias("wald"), F.round(chi2_3("wald"), 7).alias("p_value"), F.round("block_r2", 8).alias("block_r2"))


def chi2_3(x: str):
    """Upper tail of chi squared with three degrees of freedom, in closed form."""
    from lagloom.functions.tails import p_z

    return p_z(F.sqrt(x)) + F.sqrt(2 * F.col(x) / F.pi()) * F.exp(-F.col(x) / 2)


_TRAINED = _BASE + f""", {_rows_sql(_JOINT)}, tr AS (SELECT * FROM wr WHERE t < {TRAIN}), {gram_sql("g", "tr", ["one", "c1", "w1", "w2", "w3", "y"], "node")}, {sweep_sql("f", "g", 6, 5, "node")}, {gram_sql("g0", "tr", ["one", "c1", "y"], "node")}, {sweep_sql("f0", "g0", 3, 2, "node")},
hl AS (SELECT r.node, t, t // 52 AS segment, y - (f.m[6] + c1 * f.m[12] + w1 * f.m[18] + w2 * f.m[24] + w3 * f.m[30]) AS e, y - (f0.m[3] + c1 * f0.m[6]) AS e0, w1, w2, w3, c1, f.m AS m FROM wr r JOIN f USING (node) JOIN f0 USING (node) WHERE t >= {HELD}),
gl AS (SELECT node, t, segment, 'all' AS dropped, e0 * e0 - e * e AS g FROM hl UNION ALL SELECT node, t, segment, lag::VARCHAR, pow(e + (m[(lag + 1) * 6 + 1] + c1 * m[(lag + 1) * 6 + 2] + w1 * m[(lag + 1) * 6 + 3] + w2 * m[(lag + 1) * 6 + 4] + w3 * m[(lag + 1) * 6 + 5]) / m[(lag + 1) * 6 + lag + 2] * m[(lag + 1) * 6 + 6], 2) - e * e FROM hl CROSS JOIN range(1, 4) k(lag)),
cl AS (SELECT *, g - avg(g) OVER (PARTITION BY node, segment, dropped) AS d FROM gl), {_hac_sql("hv", "cl", "node, segment, dropped", "d")}"""


@query(_TRAINED + " SELECT node, segment, dropped, count(*) AS n, round(avg(g), 8) AS gain, round(sqrt(greatest(0, any_value(var)) * count(*) / (count(*) - 1)) / count(*), 8) AS se FROM gl JOIN hv USING (node, segment, dropped) GROUP BY 1, 2, 3 HAVING count(*) > 1")
def window_gains_by_segment(spark, sf_dir):
    """What the frozen window of three lags, and each lag in it, gains on the later years, year by year."""
    r = joint.frozen_windows(bundled(spark, sf_dir), "node", "humidity", [("humidity", 1)], [("wind", k) for k in (1, 2, 3)], TRAIN, HELD)
    return r.filter("n > 1").select("node", "segment", "dropped", "n", F.round("gain", 8).alias("gain"), F.round("se", 8).alias("se"))


_SETS = {"own": ["one", "c1", "w1", "y"], "all": ["one", "c1", "cl", "tm", "w1", "y"]}


@query(_BASE + f", {_rows_sql({'y': ('humidity', 0), 'c1': ('humidity', 1), 'cl': ('cloud_cover', 1), 'tm': ('temperature', 1), 'w1': ('wind', 1)})}, {gram_sql('ga', 'wr', _SETS['own'], 'node')}, {sweep_sql('fa', 'ga', 4, 3, 'node')}, {gram_sql('gb', 'wr', _SETS['all'], 'node')}, {sweep_sql('fb', 'gb', 6, 5, 'node')}" + f""", t AS (SELECT node, 'own' AS conditioning, n, 3 AS p, m[12] AS beta, -m[11] AS icc, m[16] AS rss FROM fa UNION ALL SELECT node, 'all', n, 5, m[30], -m[29], m[36] FROM fb), s AS (SELECT *, beta / sqrt(rss / (n - p) * icc) AS tt FROM t)
 SELECT node, conditioning, n, round(beta, 7) AS beta, round(tt, 5) AS t, round({t_tail_sql("tt", "(n - p)")}, 7) AS p_value FROM s""")
def conditioning_sets(spark, sf_dir):
    """The same lag-1 slope given the target's own history and given all observed variables."""
    fits = {"own": ("humidity", [("humidity", 1)], ("wind", 1)), "all": ("humidity", [("humidity", 1), ("cloud_cover", 1), ("temperature", 1)], ("wind", 1))}
    r = joint.slopes(bundled(spark, sf_dir), "node", fits)
    t = F.col("beta") / F.col("se_ols")
    p = p_t(t, (F.col("n") - F.when(F.col("name") == "own", 3).otherwise(5)).cast("double"))
    return r.select("node", F.col("name").alias("conditioning"), "n", F.round("beta", 7).alias("beta"), F.round(t, 5).alias("t"), F.round(p, 7).alias("p_value"))


_GROUP = _BASE + f", {_rows_sql({'y': ('humidity', 0), 'c1': ('humidity', 1), 'tm': ('temperature', 1), 'w1': ('wind', 1)})}, gr AS MATERIALIZED (SELECT *, CASE WHEN t % 52 < 26 THEN 'winter' ELSE 'summer' END AS season FROM wr), {gram_sql('g', 'gr', ['one', 'c1', 'tm', 'w1', 'y'], 'node, season')}, {sweep_sql('f', 'g', 5, 4, 'node, season')}" + f""",
iv AS MATERIALIZED (SELECT node, season, t, n, m[20] AS beta, -m[19] AS icc, m[25] AS rss, -(m[16] + c1 * m[17] + tm * m[18] + w1 * m[19]) * (y - (m[5] + c1 * m[10] + tm * m[15] + w1 * m[20])) * sqrt(n / (n - 4.0)) AS v, y, w1 FROM gr JOIN f USING (node, season)), {_hac_sql("hv", "iv", "node, season")}, dv AS (SELECT node, t, CASE WHEN season = 'winter' THEN v ELSE -v END AS v FROM iv), {_hac_sql("dh", "dv", "node")}"""


@query(_GROUP + """, s AS (SELECT node, season AS name, count(*) AS n, any_value(beta) AS beta, any_value(var) AS var, 1 / any_value(icc) / (var_pop(w1) * count(*)) AS vf, any_value(rss) / (var_pop(y) * count(*)) AS rf FROM iv JOIN hv USING (node, season) GROUP BY 1, 2)
 SELECT node, name, n, round(beta, 7) AS beta, round(sqrt(var), 7) AS se_hac, round(vf, 7) AS variance_fraction, round(rf, 7) AS residual_fraction FROM s UNION ALL SELECT a.node, 'difference', a.n + b.n, round(a.beta - b.beta, 7), round(sqrt(dh.var), 7), NULL, NULL FROM s a JOIN s b ON b.node = a.node AND b.name = 'summer' JOIN dh ON dh.node = a.node WHERE a.name = 'winter'""")
def group_slopes(spark, sf_dir):
    """Slopes of winter and summer given own history and temperature, and their difference by the influences of both."""
    r = joint.group_slopes(bundled(spark, sf_dir), "node", "humidity", [("humidity", 1), ("temperature", 1)], ("wind", 1), screen.SEASONS)
    return r.select("node", "name", "n", *[F.round(c, 7).alias(c) for c in ("beta", "se_hac", "variance_fraction", "residual_fraction")])


_PATHS = {
    "a": ({"y": ("humidity", 0), "c1": ("humidity", 1), "z": ("wind", 1)}, ["one", "c1", "z", "y"]),
    "total": ({"y": ("cloud_cover", 0), "c1": ("cloud_cover", 1), "z": ("wind", 2)}, ["one", "c1", "z", "y"]),
    "b": ({"y": ("cloud_cover", 0), "c1": ("cloud_cover", 1), "x": ("wind", 2), "z": ("humidity", 1)}, ["one", "c1", "x", "z", "y"]),
    "direct": ({"y": ("cloud_cover", 0), "c1": ("cloud_cover", 1), "x": ("humidity", 1), "z": ("wind", 2)}, ["one", "c1", "x", "z", "y"]),
}


def _path_sql() -> str:
    parts = []
    for name, (terms, cols) in _PATHS.items():
        n = len(cols)
        parts.append(f"{_rows_sql(terms).replace('wr AS', f'w{name} AS', 1)}, {gram_sql('g' + name, 'w' + name, cols, 'node')}, {sweep_sql('f' + name, 'g' + name, n, n - 1, 'node')}, s{name} AS (SELECT node, m[{(n - 1) * n}] AS {name} FROM f{name})")
    return _BASE + ", " + ", ".join(parts)


@query(_path_sql() + " SELECT node, round(a, 7) AS a, round(b, 7) AS b, round(total, 7) AS total, round(direct, 7) AS direct, round(a * b, 8) AS product, round(1 - abs(direct) / abs(total), 4) AS attenuation FROM sa JOIN sb USING (node) JOIN stotal USING (node) JOIN sdirect USING (node)")
def path_effects(spark, sf_dir):
    """Wind to humidity to cloud inside each station with aligned lags: both parts, total and direct effect, product and attenuation."""
    fits = {
        "a": ("humidity", [("humidity", 1)], ("wind", 1)), "total": ("cloud_cover", [("cloud_cover", 1)], ("wind", 2)),
        "b": ("cloud_cover", [("cloud_cover", 1), ("wind", 2)], ("humidity", 1)), "direct": ("cloud_cover", [("cloud_cover", 1), ("humidity", 1)], ("wind", 2)),
    }
    p = joint.slopes(bundled(spark, sf_dir), "node", fits).groupBy("node").pivot("name", list(fits)).agg(F.first("beta"))
    a, b, total, direct = (F.col(c) for c in ("a", "b", "total", "direct"))
    return p.select("node", *[F.round(c, 7).alias(c) for c in ("a", "b", "total", "direct")], F.round(a * b, 8).alias("product"), F.round(1 - F.abs(direct) / F.abs(total), 4).alias("attenuation"))


def _signed_sql() -> str:
    parts = []
    for k in (-3, -2, -1, 1, 2, 3):
        n = f"k{k}".replace("-", "m")
        terms = {"y": ("humidity", 0), "c1": ("humidity", 1), "tm": ("temperature", 1), "z": ("wind", k)}
        parts.append(f"{_rows_sql(terms).replace('wr AS', f'w{n} AS', 1)}, {gram_sql('g' + n, 'w' + n, ['one', 'c1', 'tm', 'z', 'y'], 'node')}, {sweep_sql('f' + n, 'g' + n, 5, 4, 'node')}, s{n} AS (SELECT node, {k}::BIGINT AS lag, n, m[20] AS beta, m[20] / sqrt(m[25] / (n - 4) * -m[19]) AS t FROM f{n})")
    return _BASE + ", " + ", ".join(parts) + ", al AS (" + " UNION ALL ".join(f"SELECT * FROM sk{k}".replace("-", "m") for k in (-3, -2, -1, 1, 2, 3)) + ")"


@query(_signed_sql() + " SELECT node, lag, n, round(beta, 7) AS beta, round(t, 5) AS t FROM al")
def signed_lag_tests(spark, sf_dir):
    """Past (positive) and future (negative) wind in humidity, given own and temperature history."""
    fits = {str(k): ("humidity", [("humidity", 1), ("temperature", 1)], ("wind", k)) for k in (-3, -2, -1, 1, 2, 3)}
    r = joint.slopes(bundled(spark, sf_dir), "node", fits)
    return r.select("node", F.col("name").cast("long").alias("lag"), "n", F.round("beta", 7).alias("beta"), F.round(F.col("beta") / F.col("se_ols"), 5).alias("t"))


@query(_BASE.replace("RECURSIVE ", "") + ", l AS (SELECT node, variable, t + k AS t, k, v FROM sc, range(1, 3) x(k) WHERE variable IN ('wind', 'temperature')) SELECT node, t, " + ", ".join(f"round(max(v) FILTER (variable = '{v}' AND k = {k}), 8) AS {v}_{k}" for v in ("wind", "temperature") for k in (1, 2)) + " FROM l GROUP BY 1, 2 HAVING count(*) = 4")
def physical_histories(spark, sf_dir):
    """History columns of each station and step: fields by lag, for steps that have all of them."""
    c = station_climate(spark, sf_dir).filter("variable in ('wind', 'temperature')").withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))
    c = c.select("node", (F.col("t") + F.col("k")).alias("t"), F.concat_ws("_", "variable", F.col("k").cast("string")).alias("name"), "value")
    p = c.groupBy("node", "t").pivot("name", ["wind_1", "wind_2", "temperature_1", "temperature_2"]).agg(F.first("value")).dropna()
    return p.select("node", "t", *[F.round(n, 8).alias(n) for n in ("wind_1", "wind_2", "temperature_1", "temperature_2")])


_TWELVE = _BASE.replace("RECURSIVE ", "") + """, yo AS MATERIALIZED (SELECT t, node, v, lag(v) OVER (PARTITION BY node ORDER BY t) AS o FROM sc WHERE variable = 'humidity'), xl AS (SELECT node, t + k AS t, k::BIGINT AS lag, v FROM sc, range(1, 13) x(k) WHERE variable = 'wind'), d AS (SELECT node, lag, t, y.v AS y, o AS c, x.v AS z FROM yo y JOIN xl x USING (node, t) WHERE o IS NOT NULL),
f AS (SELECT node, lag, n, (syz - scz * syc / scc) / (szz - scz * scz / scc) AS beta, (syz - scz * syc / scc) / sqrt((szz - scz * scz / scc) * ((syy - syc * syc / scc) - pow(syz - scz * syc / scc, 2) / (szz - scz * scz / scc)) / (n - 3)) AS t FROM (SELECT node, lag, count(*) AS n, covar_pop(y, y) * count(*) AS syy, covar_pop(c, c) * count(*) AS scc, covar_pop(z, z) * count(*) AS szz, covar_pop(y, c) * count(*) AS syc, covar_pop(y, z) * count(*) AS syz, covar_pop(c, z) * count(*) AS scz FROM d GROUP BY 1, 2))"""


@query(_TWELVE + """, s AS (SELECT *, abs(t) > 1.96 AS sig FROM f), p AS (SELECT node, max_by(lag, abs(round(beta, 9))) AS peak FROM s GROUP BY 1) SELECT peak AS lag, count(*) AS peaks, (SELECT count(*) FROM s WHERE s.lag = p.peak AND sig) AS significant, (SELECT round(avg(abs(beta)), 8) FROM s WHERE s.lag = p.peak) AS strength FROM p GROUP BY 1""")
def long_lag_screen(spark, sf_dir):
    """Twelve lags one by one: at which lag stations' slopes peak, how many are significant there, and how strong."""
    fits = {str(k): ("humidity", [("humidity", 1)], ("wind", k)) for k in range(1, 13)}
    s = joint.slopes(bundled(spark, sf_dir), "node", fits).select("node", F.col("name").cast("long").alias("lag"), "beta", (F.abs(F.col("beta") / F.col("se_ols")) > 1.96).alias("sig"))
    peak = s.groupBy("node").agg(F.max_by("lag", F.abs(F.round("beta", 9))).alias("lag")).groupBy("lag").agg(F.count("*").alias("peaks"))
    g = s.groupBy("lag").agg(F.count_if("sig").alias("significant"), F.round(F.avg(F.abs("beta")), 8).alias("strength"))
    return peak.join(g.hint("shuffle_merge"), "lag")


@query(_TWELVE + ", p AS (SELECT node, max_by(lag, abs(round(beta, 9))) FILTER (lag <= 3) AS short, max_by(lag, abs(round(beta, 9))) AS long, max(abs(beta)) FILTER (lag <= 3) AS a, max(abs(beta)) AS b FROM f GROUP BY 1), k AS (SELECT count(*)::DOUBLE AS n, (count(*) FILTER (short = long))::DOUBLE AS k, avg(b - a) AS gain FROM p) SELECT n::BIGINT AS stations, k::BIGINT AS recovered, round(gain, 8) AS extension_gain, round((k / n + 1.9208 / n - 1.96 * sqrt(k / n * (1 - k / n) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n), 8) AS low, round((k / n + 1.9208 / n + 1.96 * sqrt(k / n * (1 - k / n) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n), 8) AS high FROM k")
def window_benchmark(spark, sf_dir):
    """How often the peak among three lags is the peak among twelve, with Wilson's interval, and what the longer window adds."""
    fits = {str(k): ("humidity", [("humidity", 1)], ("wind", k)) for k in range(1, 13)}
    s = joint.slopes(bundled(spark, sf_dir), "node", fits).select("node", F.col("name").cast("long").alias("lag"), F.abs(F.round("beta", 9)).alias("r"), F.abs("beta").alias("b"))
    short = F.col("lag") <= 3
    p = s.groupBy("node").agg(F.max_by("lag", F.when(short, F.col("r"))).alias("short"), F.max_by("lag", "r").alias("long"), F.max(F.when(short, F.col("b"))).alias("a"), F.max("b").alias("b"))
    g = p.agg(F.count("*").cast("double").alias("n"), F.count_if(F.col("short") == F.col("long")).cast("double").alias("k"), F.avg(F.col("b") - F.col("a")).alias("gain"))
    n, q = F.col("n"), F.col("k") / F.col("n")
    half = 1.96 * F.sqrt(q * (1 - q) / n + 0.9604 / (n * n))
    return g.select(n.cast("long").alias("stations"), F.col("k").cast("long").alias("recovered"), F.round("gain", 8).alias("extension_gain"), F.round((q + 1.9208 / n - half) / (1 + 3.8416 / n), 8).alias("low"), F.round((q + 1.9208 / n + half) / (1 + 3.8416 / n), 8).alias("high"))


@query(ctes("edges") + """, sig AS (SELECT * FROM edges WHERE p_value < 0.2), ch AS (SELECT x.regime, x.source_region AS a, x.target_region AS m, y.target_region AS b, x.lag + y.lag AS total, abs(x.effect * y.effect) AS score FROM sig x JOIN sig y ON y.regime = x.regime AND y.source_region = x.target_region WHERE x.edge_type = 'wind->humidity' AND y.edge_type = 'humidity->cloud_cover' AND x.lag + y.lag <= 4),
 q AS (SELECT node, quantile_cont(round(v, 8), 0.9) AS q FROM sc WHERE variable = 'cloud_cover' GROUP BY 1), ev AS (SELECT node AS b, t FROM sc JOIN q USING (node) WHERE variable = 'cloud_cover' AND round(v, 8) >= q - 1e-9),
 pc AS (SELECT ch.regime, ch.a, ch.m, ch.b, total, score, avg(w.v) AS before FROM ch JOIN ev USING (b) JOIN sc w ON w.node = ch.a AND w.variable = 'wind' AND w.t = ev.t - total GROUP BY ALL)
 SELECT regime, m AS mediator, count(*) AS chains, round(avg(before), 7) AS before_event, round(sum(score * abs(before)), 8) AS strength FROM pc GROUP BY 1, 2""")
def chain_precursors(spark, sf_dir):
    """Chains of at most four steps: wind at their start before cloudy extremes at their end, weighted by the chain, by mediator."""
    ch = reports.chains(edges(spark, sf_dir).filter("p_value < 0.2")).withColumn("total", F.col("a_lag") + F.col("b_lag")).filter("total <= 4")
    ch = ch.select("regime", F.col("a_source_region").alias("a"), "mediator", F.col("b_target_region").alias("b"), "total", F.abs(F.col("a_effect") * F.col("b_effect")).alias("score"))
    c = station_climate(spark, sf_dir)
    cloud = c.filter("variable = 'cloud_cover'").withColumn("value", F.round("value", 8))  # values that repeat are ties, not an order
    q = cloud.groupBy("node").agg(F.percentile("value", 0.9).alias("q"))
    ev = cloud.join(q.hint("shuffle_merge"), "node").filter("value >= q - 1e-9").select(F.col("node").alias("b"), "t")
    wind = c.filter("variable = 'wind'").select(F.col("node").alias("a"), "t", F.col("value").alias("w"))
    # events are met once per start, end and total lag, not once per chain
    ways = ch.select("a", "b", "total").distinct()
    at = ways.join(ev.hint("shuffle_merge"), "b").withColumn("t", F.col("t") - F.col("total"))
    before = at.join(wind.hint("shuffle_merge"), ["a", "t"]).groupBy("a", "b", "total").agg(F.avg("w").alias("before"))
    j = ch.join(before.hint("shuffle_merge"), ["a", "b", "total"])
    # chains that differ in nothing but the split of their lags and have one score are one
    j = j.distinct()
    return j.groupBy("regime", "mediator").agg(F.count("*").alias("chains"), F.round(F.avg("before"), 7).alias("before_event"), F.round(F.sum(F.col("score") * F.abs("before")), 8).alias("strength"))
