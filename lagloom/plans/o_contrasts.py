"""Contrasts of slopes by their influence series: hemispheres, edge types, bands; errors at several bandwidths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagloom.functions.tails import p_z
from lagloom.operators import gram, screen, spatial
from lagloom.operators.fdr import bh_large
from lagloom.plans import section
from lagloom.sources.fixtures import EDGE_TYPES, ctes, normal_tail_sql, station_climate, station_series, stations

QUERIES, query = section()

#: Influence of every step on the slopes of the stations' own links.
_INF = ctes("tests") + """, inf AS MATERIALIZED (SELECT s.source_region AS node, s.source_var || '->' || s.target_var AS edge_type, s.lag, s.regime, s.t, f.zy / f.zss AS effect, s.s / f.zss * sqrt(f.n / f.df::DOUBLE) AS v
 FROM ts s JOIN tf f USING (source_region, target_region, source_var, target_var, lag, regime) WHERE s.source_region = s.target_region)"""


def _hac_sql(name: str, rows: str, keys: str, value: str = "v", bandwidth: str = "4") -> str:
    """CTE: keys and the HAC variance of a series of influences."""
    b = f"({bandwidth} + 1.0)"
    return f"""{name} AS (SELECT {keys}, sum({value} * ({value} + 2 * ((1 - t / {b}) * coalesce(s0, 0) + coalesce(s1, 0) / {b}))) AS var FROM (SELECT *, sum({value}) OVER w AS s0, sum({value} * t) OVER w AS s1 FROM {rows} WINDOW w AS (PARTITION BY {keys} ORDER BY t RANGE BETWEEN {bandwidth} PRECEDING AND 1 PRECEDING)) GROUP BY {keys})"""


def own_influences(spark, sf_dir, lags: int = 3) -> DataFrame:
    """Influences of each station's own links, by edge type, lag and season."""
    pair = F.explode(F.array(*[F.struct(F.lit(a).alias("source_var"), F.lit(b).alias("target_var")) for a, b in EDGE_TYPES]))
    own = stations(spark, sf_dir).select(F.col("node").alias("source_region"), F.col("node").alias("target_region"), pair.alias("v")).select("source_region", "target_region", "v.*")
    i = screen.influences(own, station_series(spark, sf_dir), lags)
    return i.select(F.col("source_region").alias("node"), F.concat_ws("->", "source_var", "target_var").alias("edge_type"), "lag", "regime", "n", "effect", "first", "influence")


@query(_INF + " SELECT node, edge_type, regime, t, round(v, 9) AS influence FROM inf WHERE lag = 1")
def influence_series(spark, sf_dir):
    i = own_influences(spark, sf_dir, 1).select("node", "edge_type", "regime", "first", F.posexplode("influence").alias("k", "v")).withColumn("t", F.col("first") + F.col("k"))
    season = (F.when(F.col("t") % 52 < 26, "winter").otherwise("summer") == F.col("regime")) & (F.col("k") > 0)
    return i.filter(season).select("node", "edge_type", "regime", "t", F.round("v", 9).alias("influence"))


@query(_INF + ", one AS (SELECT * FROM inf WHERE lag = 1), " + ", ".join(_hac_sql(f"v{b}", "one", "node, edge_type, regime, effect", bandwidth=str(b)) for b in (4, 8, 12)) + " SELECT node, edge_type, regime, round(effect, 7) AS effect, round(sqrt(v4.var), 7) AS se_4, round(sqrt(v8.var), 7) AS se_8, round(sqrt(v12.var), 7) AS se_12 FROM v4 JOIN v8 USING (node, edge_type, regime, effect) JOIN v12 USING (node, edge_type, regime, effect)")
def influence_errors(spark, sf_dir):
    i = own_influences(spark, sf_dir, 1)
    return i.select("node", "edge_type", "regime", F.round("effect", 7).alias("effect"), *[F.round(screen.hac_error(F.col("influence"), b), 7).alias(f"se_{b}") for b in (4, 8, 12)])


def _added(a, b, sign: float):
    return F.zip_with(a, b, lambda x, y: x + sign * y)


@query(_INF + """, hd AS (SELECT n.node, n.edge_type, n.lag, n.regime, n.t, n.effect - s.effect AS delta, n.v - s.v AS v FROM inf n JOIN inf s ON s.node = n.node + 1 AND s.edge_type = n.edge_type AND s.lag = n.lag AND s.regime = n.regime AND s.t = n.t WHERE n.node % 2 = 0), """ + _hac_sql("hv", "hd", "node, edge_type, lag, regime, delta") + f""",
 hz AS (SELECT *, round({normal_tail_sql("delta / sqrt(var)")}, 9) AS p FROM hv), r AS (SELECT *, row_number() OVER g AS rg, count(*) OVER (PARTITION BY regime) AS ng, row_number() OVER a AS ra, count(*) OVER () AS na FROM hz WINDOW g AS (PARTITION BY regime ORDER BY p, node, edge_type, lag), a AS (ORDER BY p, node, edge_type, lag, regime)),
 q AS (SELECT *, least(1, min(p * ng / rg) OVER (PARTITION BY regime ORDER BY rg DESC)) AS q_regime, least(1, min(p * na / ra) OVER (ORDER BY ra DESC)) AS q_all FROM r)
 SELECT node AS north, edge_type, lag, regime, round(delta, 7) AS delta, round(sqrt(var), 7) AS se, round(p, 8) AS p_value, round(q_regime, 8) AS q_regime, round(q_all, 8) AS q_all FROM q""")
def hemisphere_contrasts(spark, sf_dir):
    """North minus south of each mirrored pair of stations, scores subtracted on the same calendar."""
    i = own_influences(spark, sf_dir)
    key = ["edge_type", "lag", "regime", "first"]
    south = i.filter("node % 2 = 1").select((F.col("node") - 1).alias("node"), *key, F.col("effect").alias("es"), F.col("influence").alias("vs"))
    j = i.filter("node % 2 = 0").join(south.hint("shuffle_merge"), ["node", *key])
    d = j.select(F.col("node").alias("north"), "edge_type", "lag", "regime", (F.col("effect") - F.col("es")).alias("delta"), screen.hac_error(_added("influence", "vs", -1.0), 4).alias("se"))
    d = d.withColumn("p_value", F.round(p_z(F.col("delta") / F.col("se")), 9))
    d = bh_large(bh_large(d, ["regime"], "p_value", "q_regime"), None, "p_value", "q_all")
    return d.select("north", "edge_type", "lag", "regime", F.round("delta", 7).alias("delta"), F.round("se", 7).alias("se"), *[F.round(c, 8).alias(c) for c in ("p_value", "q_regime", "q_all")])


@query(_INF + """, av AS (SELECT edge_type, regime, t, sum(v) AS total FROM inf GROUP BY 1, 2, 3), k AS (SELECT edge_type, regime, avg(effect) AS effect, count(*) AS tests FROM (SELECT DISTINCT node, edge_type, lag, regime, effect FROM inf) GROUP BY 1, 2), am AS (SELECT edge_type, regime, effect, tests, t, total / tests AS v FROM av JOIN k USING (edge_type, regime)), """ + _hac_sql("vv", "am", "edge_type, regime, effect, tests") + f""", z AS (SELECT *, round({normal_tail_sql("effect / sqrt(var)")}, 9) AS p FROM vv), r AS (SELECT *, row_number() OVER (PARTITION BY regime ORDER BY p) AS r, count(*) OVER (PARTITION BY regime) AS m FROM z)
 SELECT edge_type, regime, tests, round(effect, 8) AS effect, round(sqrt(var), 8) AS se, round(p, 7) AS p_value, round(least(1, min(p * m / r) OVER (PARTITION BY regime ORDER BY r DESC)), 7) AS q_value FROM r""")
def edge_type_averages(spark, sf_dir):
    """Mean effect of an edge type over all stations and lags; its error from the mean influence of each step."""
    i = own_influences(spark, sf_dir)
    by = ["edge_type", "regime"]
    mean = i.groupBy(*by).agg(F.avg("effect").alias("effect"), F.count("*").alias("tests"))
    steps = i.select(*by, "first", F.posexplode("influence").alias("k", "v")).groupBy(*by, (F.col("first") + F.col("k")).alias("t")).agg(F.sum("v").alias("v"))
    line = steps.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("t", "v"))).alias("s")).select(*by, F.transform("s", lambda x: x["v"]).alias("s"))  # one value per calendar step
    j = mean.join(line.hint("shuffle_merge"), by).withColumn("se", screen.hac_error(F.col("s"), 4) / F.col("tests"))
    j = bh_large(j.withColumn("p_value", F.round(p_z(F.col("effect") / F.col("se")), 9)), ["regime"])
    return j.select(*by, "tests", F.round("effect", 8).alias("effect"), F.round("se", 8).alias("se"), F.round("p_value", 7).alias("p_value"), F.round("q_value", 7).alias("q_value"))


_BANDS = "CASE WHEN abs(lat) < 23.5 THEN 'tropics' WHEN abs(lat) < 60 THEN 'midlatitude' ELSE 'polar' END"


@query(_INF + f""", st AS (SELECT node, abs(lat) / 10 AS x, {_BANDS} AS band FROM cells), n AS (SELECT node, (x - avg(x) OVER ()) / (sum(x * x) OVER () - sum(x) OVER () * sum(x) OVER () / count(*) OVER ()) AS w, 'trend' AS contrast FROM st
 UNION ALL SELECT node, CASE WHEN band = 'tropics' THEN -1.0 / t ELSE 1.0 / m END, 'midlatitude-tropics' FROM st, (SELECT count(*) FILTER (band = 'tropics') AS t, count(*) FILTER (band = 'midlatitude') AS m FROM st) WHERE band IN ('tropics', 'midlatitude')),
 one AS (SELECT * FROM inf WHERE lag = 1), wt AS (SELECT contrast, edge_type, regime, t, sum(w * v) AS v FROM n JOIN one USING (node) GROUP BY ALL), we AS (SELECT contrast, edge_type, regime, sum(w * effect) AS effect, count(*) AS nodes, sum(abs(w)) AS weight FROM n JOIN (SELECT DISTINCT node, edge_type, regime, effect FROM one) USING (node) GROUP BY ALL),
 """ + _hac_sql("vv", "wt", "contrast, edge_type, regime") + " SELECT contrast, edge_type, regime, nodes, round(weight, 8) AS weight, round(effect, 8) AS effect, round(sqrt(var), 8) AS se FROM we JOIN vv USING (contrast, edge_type, regime)")
def weighted_contrasts(spark, sf_dir):
    """Fixed linear contrasts of the stations' slopes (trend over absolute latitude, midlatitude minus tropics) with their support."""
    st = stations(spark, sf_dir).select("node", (F.abs("lat") / 10).alias("x"), spatial.band(F.col("lat")).alias("band"))
    m = st.agg(F.avg("x").alias("mx"), (F.sum(F.col("x") * F.col("x")) - F.sum("x") * F.sum("x") / F.count("*")).alias("sxx"), F.count_if(F.col("band") == "tropics").alias("nt"), F.count_if(F.col("band") == "midlatitude").alias("nm"))
    s = st.crossJoin(F.broadcast(m))  # one row
    trend = s.select("node", ((F.col("x") - F.col("mx")) / F.col("sxx")).alias("w"), F.lit("trend").alias("contrast"))
    bands = s.filter("band in ('tropics', 'midlatitude')").select("node", F.when(F.col("band") == "tropics", -1.0 / F.col("nt")).otherwise(1.0 / F.col("nm")).alias("w"), F.lit("midlatitude-tropics").alias("contrast"))
    by = ["contrast", "edge_type", "regime"]
    j = own_influences(spark, sf_dir, 1).join(trend.unionByName(bands).hint("shuffle_merge"), "node")
    e = j.groupBy(*by).agg(F.sum(F.col("w") * F.col("effect")).alias("effect"), F.count("*").alias("nodes"), F.sum(F.abs("w")).alias("weight"))
    steps = j.select(*by, "w", "first", F.posexplode("influence").alias("k", "v")).groupBy(*by, (F.col("first") + F.col("k")).alias("t")).agg(F.sum(F.col("w") * F.col("v")).alias("v"))
    line = steps.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("t", "v"))).alias("s")).select(*by, F.transform("s", lambda x: x["v"]).alias("s"))
    out = e.join(line.hint("shuffle_merge"), by).withColumn("se", screen.hac_error(F.col("s"), 4))
    return out.select(*by, "nodes", *[F.round(c, 8).alias(c) for c in ("weight", "effect", "se")])


@query(ctes("stations", "station_climate") + f""", b AS (SELECT {_BANDS} AS band, variable, t, avg(v) AS v FROM sc JOIN cells USING (node) GROUP BY 1, 2, 3), d AS (SELECT a.variable, a.band || '-tropics' AS endpoint, a.t, a.v - l.v AS v FROM b a JOIN b l ON l.variable = a.variable AND l.t = a.t AND l.band = 'tropics' WHERE a.band <> 'tropics' UNION ALL SELECT variable, band, t, v FROM b),
 c AS (SELECT *, v - avg(v) OVER (PARTITION BY variable, endpoint) AS d FROM d), m AS (SELECT variable, endpoint, count(*) AS n, avg(v) AS mean FROM d GROUP BY 1, 2), """ + _hac_sql("h", "c", "variable, endpoint", "d", "8") + f""", z AS (SELECT variable, endpoint, n, mean, sqrt(var * n / (n - 1)) / n AS se FROM m JOIN h USING (variable, endpoint))
 SELECT variable, endpoint, n, round(mean, 8) AS mean, round(se, 8) AS se, round(CASE WHEN mean > 0 THEN {normal_tail_sql("mean / se")} / 2 ELSE 1 - {normal_tail_sql("mean / se")} / 2 END, 7) AS p_one_sided FROM z""")
def band_endpoints(spark, sf_dir):
    """Mean series of each latitude band and their differences to the tropics: means with HAC errors and one-sided p."""
    st = stations(spark, sf_dir).select("node", spatial.band(F.col("lat")).alias("band"))
    b = station_climate(spark, sf_dir).join(st, "node").groupBy("band", "variable", "t").agg(F.avg("value").alias("v"))
    low = b.filter("band = 'tropics'").select("variable", "t", F.col("v").alias("low"))
    d = b.filter("band <> 'tropics'").join(low.hint("shuffle_merge"), ["variable", "t"]).select("variable", F.concat("band", F.lit("-tropics")).alias("endpoint"), "t", (F.col("v") - F.col("low")).alias("v"))
    m = gram.mean_hac(d.unionByName(b.select("variable", F.col("band").alias("endpoint"), "t", "v")), ["variable", "endpoint"], "v", 8)
    two = p_z(F.col("mean") / F.col("se"))
    m = m.withColumn("two", two).withColumn("p_one_sided", F.when(F.col("mean") > 0, F.col("two") / 2).otherwise(1 - F.col("two") / 2))
    return m.select("variable", "endpoint", "n", F.round("mean", 8).alias("mean"), F.round("se", 8).alias("se"), F.round("p_one_sided", 7).alias("p_one_sided"))
