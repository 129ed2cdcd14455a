"""Whole runs under several recipes and numbers of regions, with a setting column."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagloom.operators import settings
from lagloom.operators.lineage import stored
from lagloom.operators.reports import KEY
from lagloom.plans import section
from lagloom.sources.fixtures import EDGE_TYPES, HAV_SQL, VARIABLES, _station_panel, ctes, normal_tail_sql, sources, stations, weeks

QUERIES, query = section()
_K = ", ".join(KEY)
_RECIPE_SETTINGS = [s for s, _, n in settings.SETTINGS if n == 66]
_ALPHA = 0.2


def setting_tests(spark, sf_dir) -> DataFrame:
    """All tests of all settings. Stored once."""
    make = lambda: settings.run(_station_panel(spark, sf_dir), VARIABLES, weeks(spark, sf_dir), stations(spark, sf_dir), EDGE_TYPES, alpha=_ALPHA)
    return stored(spark, "setting-tests", sources(sf_dir, "lineitem", "supplier"), make, settings=settings.SETTINGS, alpha=_ALPHA)


def _bin_sql(n: int) -> str:
    rows = max(1, round(math.sqrt(n / 2)))
    cols = math.ceil(n / rows)
    return f"CAST(least(floor((least(greatest(lat, -90), 90) + 90) / 180 * {rows}), {rows - 1}) * {cols} + least(floor(((lon % 360) + 360) % 360 / 360 * {cols}), {cols - 1}) AS BIGINT)"


def _sql() -> str:
    sizes = sorted({n for *_, n in settings.SETTINGS})
    box = " UNION ALL ".join(f"SELECT node, lat, lon, {n} AS size, {_bin_sql(n)} AS region FROM cells" for n in sizes)
    uses = ", ".join(f"('{s}', '{r}', {n})" for s, r, n in settings.SETTINGS)
    scaled = lambda c, w: f"coalesce(({c} - avg({c}) OVER {w}) / (CASE WHEN stddev_pop({c}) OVER {w} < 1e-8 THEN 1 ELSE stddev_pop({c}) OVER {w} END), 0)"
    plain = [r for r in settings.RECIPES if r != "monthly_by_region"]
    each = " UNION ALL ".join([*(f"SELECT '{r}' AS recipe, t, node, variable, {scaled(r, 'w')} AS value FROM rc WHERE {r} IS NOT NULL WINDOW w AS (PARTITION BY node, variable)" for r in plain), "SELECT 'monthly_by_region', t, node, variable, monthly FROM rc"])
    k = f"setting, {_K}, regime"
    return ctes("stations", "station_climate") + f""",
rm AS (SELECT t, node, variable, value, value - avg(value) OVER (PARTITION BY node, variable, t % 52) AS monthly FROM sc_v),
rc AS MATERIALIZED (SELECT *, monthly - lag(monthly) OVER o AS monthly_difference, value - lag(value) OVER o AS difference, value - avg(value) OVER (PARTITION BY node, variable ORDER BY t ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING) AS rolling FROM rm WINDOW o AS (PARTITION BY node, variable ORDER BY t)),
cl AS MATERIALIZED ({each}), us(setting, recipe, size) AS (VALUES {uses}), bx AS MATERIALIZED ({box}),
rv AS (SELECT setting, us.recipe, region AS node, variable, t, avg(value) AS value FROM us JOIN bx USING (size) JOIN cl ON cl.recipe = us.recipe AND cl.node = bx.node GROUP BY ALL),
zs AS MATERIALIZED (SELECT setting, node, variable, t, CASE WHEN recipe = 'monthly_by_region' THEN {scaled('value', 'w')} ELSE value END AS v FROM rv WINDOW w AS (PARTITION BY setting, node, variable)),
rg AS (SELECT size, region AS node, avg(lat) AS lat, degrees(atan2(avg(sin(radians(lon))), avg(cos(radians(lon))))) AS lon FROM bx GROUP BY 1, 2),
nr AS (SELECT size, source, target FROM (SELECT b.size, a.node AS source, b.node AS target, row_number() OVER (PARTITION BY b.size, b.node ORDER BY {HAV_SQL}, a.node) AS r FROM rg a JOIN rg b ON a.size = b.size AND a.node <> b.node) WHERE r <= 2),
cn AS (SELECT size, source AS s, target AS g FROM nr UNION SELECT size, target, source FROM nr UNION SELECT size, node, node FROM rg),
ct AS MATERIALIZED (SELECT setting, s, g, sv, tv FROM cn JOIN us USING (size) CROSS JOIN (VALUES {", ".join(f"('{a}', '{b}')" for a, b in EDGE_TYPES)}) e(sv, tv)),
yo AS MATERIALIZED (SELECT setting, t, node, variable, v, lag(v) OVER (PARTITION BY setting, node, variable ORDER BY t) AS o FROM zs), xl AS MATERIALIZED (SELECT setting, node, variable, t + lag AS t, lag::BIGINT AS lag, v FROM zs, (VALUES (1), (2), (3)) k(lag)),
td AS MATERIALIZED (SELECT ct.setting, y.t, s AS source_region, g AS target_region, sv AS source_var, tv AS target_var, x.lag, CASE WHEN y.t % 52 < 26 THEN 'winter' ELSE 'summer' END AS regime, y.v AS y, y.o AS c, x.v AS z
 FROM ct JOIN yo y ON y.setting = ct.setting AND y.node = g AND y.variable = tv JOIN xl x ON x.setting = ct.setting AND x.node = s AND x.variable = sv AND x.t = y.t WHERE y.o IS NOT NULL),
tf AS (SELECT *, szz - scz * scz / scc AS zss, syz - scz * syc / scc AS zy, n - 3 AS df FROM (SELECT {k}, count(*) AS n, covar_pop(c, c) * count(*) AS scc, covar_pop(z, z) * count(*) AS szz,
 covar_pop(y, c) * count(*) AS syc, covar_pop(y, z) * count(*) AS syz, covar_pop(c, z) * count(*) AS scz, avg(y) AS my, avg(c) AS mc, avg(z) AS mz FROM td GROUP BY ALL)),
ts AS (SELECT {", ".join("d." + c.strip() for c in k.split(","))}, d.t, ((z - mz) - scz / scc * (c - mc)) * (((y - my) - syc / scc * (c - mc)) - zy / zss * ((z - mz) - scz / scc * (c - mc))) AS s FROM td d JOIN tf f USING ({k})),
tm AS (SELECT {k}, sum(s * (s + 2 * ((1 - t / 5.0) * coalesce(s0, 0) + coalesce(s1, 0) / 5.0))) AS meat FROM (SELECT *, sum(s) OVER w AS s0, sum(s * t) OVER w AS s1 FROM ts WINDOW w AS (PARTITION BY {k} ORDER BY t RANGE BETWEEN 4 PRECEDING AND 1 PRECEDING)) GROUP BY ALL),
pp AS (SELECT {k}, n, zy / zss AS effect, round({normal_tail_sql("(zy / sqrt(meat * n / df))")}, 9) AS p FROM tf JOIN tm USING ({k})),
rr AS (SELECT *, row_number() OVER (PARTITION BY setting, regime ORDER BY p) AS r, count(*) OVER (PARTITION BY setting, regime) AS m FROM pp),
qq AS MATERIALIZED (SELECT *, least(1, min(p * m / r) OVER (PARTITION BY setting, regime ORDER BY r DESC)) AS q FROM rr), sg AS (SELECT *, source_var || '->' || target_var AS edge_type FROM qq WHERE q < {_ALPHA})"""


_RUN = _sql()


@query(_RUN + f" SELECT setting, {_K}, regime, n, round(effect, 7) AS effect, p AS p_value, round(q, 7) AS q_value, q < {_ALPHA} AS significant FROM qq")
def setting_runs(spark, sf_dir):
    """Every lag test of five recipes and three numbers of regions, q within setting and season."""
    t = setting_tests(spark, sf_dir)
    return t.select("setting", *KEY, "regime", "n", F.round("effect", 7).alias("effect"), "p_value", F.round("q_value", 7).alias("q_value"), "significant")


_IN = ", ".join(f"'{s}'" for s in _RECIPE_SETTINGS)


@query(_RUN + f""", pe AS (SELECT regime, {_K}, edge_type FROM sg WHERE setting IN ({_IN}) GROUP BY ALL HAVING count(DISTINCT setting) = {len(_RECIPE_SETTINGS)}), ch AS (SELECT x.setting, count(*) AS chains FROM sg x JOIN sg y ON y.setting = x.setting AND y.regime = x.regime AND y.source_region = x.target_region WHERE x.edge_type = 'wind->humidity' AND y.edge_type = 'humidity->cloud_cover' GROUP BY 1),
 sm AS (SELECT setting, count(*) AS tested, count(*) FILTER (q < {_ALPHA}) AS significant, count(*) FILTER (q < {_ALPHA} AND source_var = 'wind' AND target_var = 'humidity') AS wh, count(*) FILTER (q < {_ALPHA} AND source_var = 'humidity') AS hc, count(*) FILTER (q < {_ALPHA} AND source_var = 'wind' AND target_var = 'cloud_cover') AS wc,
  avg(lag) FILTER (q < {_ALPHA} AND source_var = 'wind' AND target_var = 'humidity') AS wh_lag, avg(lag) FILTER (q < {_ALPHA} AND source_var = 'humidity') AS hc_lag, avg(abs(log10(q + 1e-12) * effect)) FILTER (q < {_ALPHA}) AS score FROM qq GROUP BY 1)
 SELECT setting, tested, significant, round(significant / tested::DOUBLE, 8) AS ratio, wh, hc, wc, coalesce(chains, 0) AS chains, (SELECT count(*) FROM pe WHERE edge_type = 'wind->humidity') AS stable_wh, (SELECT count(*) FROM pe WHERE edge_type = 'humidity->cloud_cover') AS stable_hc, round(wh_lag, 8) AS wh_lag, round(hc_lag, 8) AS hc_lag, round(score, 6) AS score FROM sm LEFT JOIN ch USING (setting)""")
def setting_report(spark, sf_dir):
    """Main figures of every setting, with the edges that all five recipes keep."""
    s = settings.summary(setting_tests(spark, sf_dir), _RECIPE_SETTINGS)
    return s.select("setting", "tested", "significant", F.round(F.col("significant") / F.col("tested"), 8).alias("ratio"), "wh", "hc", "wc", "chains", "stable_wh", "stable_hc", F.round("wh_lag", 8).alias("wh_lag"), F.round("hc_lag", 8).alias("hc_lag"), F.round("score", 6).alias("score"))


@query(_RUN + f" SELECT regime, {_K}, round(avg(effect), 7) AS effect, min(sign(effect)) = max(sign(effect)) AS one_sign FROM qq WHERE setting IN ({_IN}) GROUP BY ALL HAVING count(*) FILTER (p < 0.2) = {len(_RECIPE_SETTINGS)}")
def edges_of_all_recipes(spark, sf_dir):
    """Links with p below 0.2 under each of the five recipes, with their mean effect and whether its sign stays."""
    t = setting_tests(spark, sf_dir).filter(F.col("setting").isin(_RECIPE_SETTINGS))
    g = t.groupBy("regime", *KEY).agg(F.avg("effect").alias("e"), (F.min(F.signum("effect")) == F.max(F.signum("effect"))).alias("one_sign"), F.count_if(F.col("p_value") < 0.2).alias("c"))
    return g.filter(F.col("c") == len(_RECIPE_SETTINGS)).select("regime", *KEY, F.round("e", 7).alias("effect"), "one_sign")


@query(ctes("stations", "station_climate") + _RUN[_RUN.index(",\nrm AS"):_RUN.index(", us(setting")] + " SELECT recipe, variable, count(*) AS n, round(max(value), 6) AS high, round(min(value), 6) AS low FROM cl GROUP BY 1, 2")
def station_recipes(spark, sf_dir):
    """The five recipes on all stations: rows and range by variable."""
    r = settings.recipe_ranges(_station_panel(spark, sf_dir), VARIABLES, weeks(spark, sf_dir))
    return r.select("recipe", "variable", "n", F.round("high", 6).alias("high"), F.round("low", 6).alias("low"))
