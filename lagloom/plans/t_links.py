"""Reports over all tests of the stations: HAC batch, intervals, direction, places, signatures, confirmation, differences."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lagloom.functions.tails import p_z
from lagloom.operators import gram, reports, screen, spatial
from lagloom.operators.fdr import bh_large
from lagloom.operators.lineage import written
from lagloom.operators.reports import KEY
from lagloom.plans import section
from lagloom.plans.h_reports import _INTRA
from lagloom.plans.o_contrasts import _BANDS
from lagloom.plans.p_resampling import _STRATA, _located_edges
from lagloom.plans.q_windows import _BASE, _rows_sql, bundled
from lagloom.operators import joint
from lagloom.sources import readers
from lagloom.sources.fixtures import ctes, edges, normal_tail_sql, station_climate, station_series, stations, tests
from lagloom.sources.sqltext import gram_sql, sweep_sql

QUERIES, query = section()
_K = ", ".join(KEY)
_T = ctes("tests")
_E = ctes("edges")
_Z = 1.959963984540054


@query(_T + f" SELECT {_K}, regime, n, round(effect, 7) AS effect, round(se_ols, 7) AS se_ols, round(se_hac, 7) AS se_hac, round({normal_tail_sql('z_hac')}, 7) AS p_value, round(partial_r2, 8) AS partial_r2, true AS valid FROM tests")
def hac_batch(spark, sf_dir):
    """Every candidate, lag and season in one run; tests that can't be made stay, with p = 1."""
    valid = F.col("effect").isNotNull()
    return tests(spark, sf_dir).select(*KEY, "regime", "n", *[F.round(c, 7).alias(c) for c in ("effect", "se_ols", "se_hac")], F.round(F.coalesce("p_value", F.lit(1.0)), 7).alias("p_value"), F.round("partial_r2", 8).alias("partial_r2"), valid.alias("valid"))


@query(_T + f", t AS (SELECT *, source_var || '->' || target_var AS edge_type, abs(effect) > {_Z} * se_hac AS clear FROM tests) SELECT regime, coalesce(edge_type, 'all') AS edge_type, count(*) AS n, count(DISTINCT source_region * 1000003 + target_region) AS region_pairs, round(quantile_cont(effect, 0.25), 7) AS q25, round(quantile_cont(effect, 0.5), 7) AS q50, round(quantile_cont(effect, 0.75), 7) AS q75, round(quantile_cont(partial_r2, 0.5), 8) AS partial_r2, round(avg(CASE WHEN effect > 0 THEN 1.0 ELSE 0.0 END), 8) AS positive, round(avg(CASE WHEN clear THEN 1.0 ELSE 0.0 END), 8) AS interval_excludes_zero FROM t GROUP BY GROUPING SETS ((regime, edge_type), (regime))")
def effect_sizes(spark, sf_dir):
    t = tests(spark, sf_dir).filter("effect is not null").withColumn("edge_type", F.explode(F.array(F.concat_ws("->", "source_var", "target_var"), F.lit("all"))))
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 8)
    q = F.percentile("effect", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = t.groupBy("regime", "edge_type").agg(
        F.count("*").alias("n"), F.count_distinct("source_region", "target_region").alias("region_pairs"), q.alias("q"), F.round(F.percentile("partial_r2", 0.5), 8).alias("partial_r2"),
        share(F.col("effect") > 0).alias("positive"), share(F.abs("effect") > _Z * F.col("se_hac")).alias("interval_excludes_zero"),
    )
    return g.select("*", *[F.round(F.col("q")[i], 7).alias(n) for i, n in enumerate(("q25", "q50", "q75"))]).drop("q")


@query(_E + """, f AS (SELECT regime, source_region AS a, target_region AS b, edge_type, lag, abs(effect) AS x FROM edges WHERE source_region < target_region), r AS (SELECT regime, target_region AS a, source_region AS b, edge_type, lag, abs(effect) AS y FROM edges WHERE source_region > target_region), d AS (SELECT edge_type, round(x - y, 6) AS d FROM f JOIN r USING (regime, a, b, edge_type, lag) WHERE x <> y),
 k AS (SELECT *, rank() OVER (PARTITION BY edge_type ORDER BY abs(d)) + (count(*) OVER (PARTITION BY edge_type, abs(d)) - 1) / 2.0 AS r FROM d), w AS (SELECT edge_type, count(*) AS pairs, coalesce(sum(r) FILTER (d > 0), 0) AS w, count(*)::DOUBLE AS n FROM k GROUP BY 1), z AS (SELECT *, (w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24) AS z FROM w)"""
 + f" SELECT edge_type, pairs, round(w, 4) AS wilcoxon, round(z, 6) AS z, round({normal_tail_sql('z')}, 7) AS p_value FROM z")
def direction_wilcoxon(spark, sf_dir):
    """Signed-rank test of forward against reverse strength over all pairs tested both ways (normal approximation)."""
    e = edges(spark, sf_dir)
    k = ["regime", "a", "b", "edge_type", "lag"]
    f = e.filter("source_region < target_region").select("regime", F.col("source_region").alias("a"), F.col("target_region").alias("b"), "edge_type", "lag", F.abs("effect").alias("x"))
    r = e.filter("source_region > target_region").select("regime", F.col("target_region").alias("a"), F.col("source_region").alias("b"), "edge_type", "lag", F.abs("effect").alias("y"))
    d = f.join(r, k).filter("x <> y").select("edge_type", F.round(F.col("x") - F.col("y"), 6).alias("d"))
    # ranks from counts of equal sizes, so that only distinct sizes meet in a window
    c = d.groupBy("edge_type", F.abs("d").alias("m")).agg(F.count("*").alias("c"), F.count_if(F.col("d") > 0).alias("up"))
    c = c.withColumn("r", F.sum("c").over(Window.partitionBy("edge_type").orderBy("m")) - (F.col("c") - 1) / 2.0)
    w = c.groupBy("edge_type").agg(F.sum("c").alias("pairs"), F.sum(F.col("up") * F.col("r")).alias("w"))
    n = F.col("pairs").cast("double")
    w = w.withColumn("z", (F.col("w") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24))
    return w.select("edge_type", "pairs", F.round("w", 4).alias("wilcoxon"), F.round("z", 6).alias("z"), F.round(p_z("z"), 7).alias("p_value"))


@query(_E + ", s AS (SELECT source_region, target_region, string_agg(DISTINCT lag, ';' ORDER BY lag) AS lags, count(DISTINCT lag) AS n_lags FROM edges WHERE p_value < 0.2 GROUP BY 1, 2) SELECT source_region, target_region, lags, n_lags, source_region = target_region AS local, abs(a.lon - b.lon) > 180 AS crosses_dateline FROM s JOIN cells a ON a.node = source_region JOIN cells b ON b.node = target_region")
def network_map(spark, sf_dir):
    """Pairs of stations with their lags, whether both are one, and whether the shorter way between them crosses the dateline."""
    g = edges(spark, sf_dir).filter("p_value < 0.2").groupBy("source_region", "target_region").agg(F.array_sort(F.collect_set("lag")).alias("l"))
    lon = stations(spark, sf_dir).select("node", "lon")
    j = g.join(lon.toDF("source_region", "la"), "source_region").join(lon.toDF("target_region", "lb"), "target_region")
    return j.select("source_region", "target_region", F.array_join(F.col("l").cast("array<string>"), ";").alias("lags"), F.size("l").alias("n_lags"), (F.col("source_region") == F.col("target_region")).alias("local"), (F.abs(F.col("la") - F.col("lb")) > 180).alias("crosses_dateline"))


@query(_E + f", u AS (SELECT source_region AS node FROM edges WHERE p_value < 0.2 UNION ALL SELECT target_region FROM edges WHERE p_value < 0.2) SELECT node AS region, count(*) AS ends, round(any_value(lat), 6) AS lat, round(any_value(lon), 6) AS lon, any_value({_BANDS}) AS band FROM u JOIN cells USING (node) GROUP BY 1")
def endpoint_places(spark, sf_dir):
    """Regions that occur in significant edges, with their place and band."""
    s = edges(spark, sf_dir).filter("p_value < 0.2")
    u = s.select(F.col("source_region").alias("node")).union(s.select("target_region")).groupBy("node").agg(F.count("*").alias("ends"))
    return u.join(stations(spark, sf_dir), "node").select(F.col("node").alias("region"), "ends", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), spatial.band(F.col("lat")).alias("band"))


@query(_E + f", b AS (SELECT node, {_BANDS} AS band FROM cells) SELECT a.band AS source_band, b.band AS target_band, count(*) FILTER (edge_type = 'wind->humidity') AS wh, count(*) FILTER (edge_type = 'humidity->cloud_cover') AS hc, count(*) FILTER (edge_type = 'wind->cloud_cover') AS wc, round(avg(lag), 8) AS lag, round(avg(abs(effect)), 8) AS strength FROM edges e JOIN b a ON a.node = source_region JOIN b b ON b.node = target_region WHERE p_value < 0.2 GROUP BY 1, 2")
def band_pivot(spark, sf_dir):
    c = stations(spark, sf_dir).select("node", spatial.band(F.col("lat")).alias("band"))
    s = edges(spark, sf_dir).filter("p_value < 0.2").join(c.toDF("source_region", "source_band"), "source_region").join(c.toDF("target_region", "target_band"), "target_region")
    n = lambda t, a: F.count_if(F.col("edge_type") == t).alias(a)
    return s.groupBy("source_band", "target_band").agg(n("wind->humidity", "wh"), n("humidity->cloud_cover", "hc"), n("wind->cloud_cover", "wc"), F.round(F.avg("lag"), 8).alias("lag"), F.round(F.avg(F.abs("effect")), 8).alias("strength"))


@query(_STRATA + ", g AS (SELECT * FROM ed WHERE p_value < 0.2) SELECT edge_type, 'out' AS part, source_region AS key, count(*) AS n FROM g GROUP BY 1, 3 UNION ALL SELECT edge_type, 'in', target_region, count(*) FROM g GROUP BY 1, 3 UNION ALL SELECT edge_type, 'stratum', s, count(*) FROM g GROUP BY 1, 3")
def graph_signature(spark, sf_dir):
    """Out- and in-degrees by type and counts by distance stratum."""
    g = _located_edges(spark, sf_dir).filter("p_value < 0.2")
    part = F.explode(F.array(F.struct(F.lit("out").alias("part"), F.col("source_region").alias("key")), F.struct(F.lit("in").alias("part"), F.col("target_region").alias("key")), F.struct(F.lit("stratum").alias("part"), F.col("s").cast("long").alias("key"))))
    return g.select("edge_type", part.alias("x")).groupBy("edge_type", "x.part", "x.key").agg(F.count("*").alias("n"))


@query(_E + """, sig AS (SELECT * FROM edges WHERE p_value < 0.2), ch AS (SELECT DISTINCT x.regime, x.source_region AS i, x.target_region AS m, y.target_region AS j FROM sig x JOIN sig y ON y.regime = x.regime AND y.source_region = x.target_region WHERE x.edge_type = 'wind->humidity' AND y.edge_type = 'humidity->cloud_cover'), wc AS (SELECT DISTINCT regime, source_region AS i, target_region AS j, true AS closed FROM sig WHERE edge_type = 'wind->cloud_cover'),
 ep AS (SELECT regime, i, j, count(*) AS routes FROM ch GROUP BY 1, 2, 3), a AS (SELECT regime, sum(routes)::BIGINT AS chains, count(*) AS endpoint_pairs, sum(CASE WHEN i <> j THEN routes ELSE 0 END)::BIGINT AS cross_region, count(closed) AS closed, count(*) FILTER (routes > 1) AS multi_route FROM ep LEFT JOIN wc USING (regime, i, j) GROUP BY 1),
 jj AS (SELECT count(*) FILTER (r = 2) / count(*)::DOUBLE AS jaccard FROM (SELECT i, m, j, count(*) AS r FROM ch GROUP BY 1, 2, 3)) SELECT a.*, round(jaccard, 8) AS jaccard FROM a, jj""")
def chain_graph_metrics(spark, sf_dir):
    """Unique chains, endpoint pairs, cross-region chains, pairs with a direct link, pairs with several routes; overlap of both seasons."""
    s = edges(spark, sf_dir).filter("p_value < 0.2")
    ch = reports.chains(s).select("regime", F.col("a_source_region").alias("i"), F.col("mediator").alias("m"), F.col("b_target_region").alias("j")).distinct()
    wc = s.filter("edge_type = 'wind->cloud_cover'").select("regime", F.col("source_region").alias("i"), F.col("target_region").alias("j"), F.lit(True).alias("c")).distinct()
    ep = ch.groupBy("regime", "i", "j").agg(F.count("*").alias("routes")).join(wc.hint("shuffle_merge"), ["regime", "i", "j"], "left")
    a = ep.groupBy("regime").agg(F.sum("routes").alias("chains"), F.count("*").alias("endpoint_pairs"), F.sum(F.when(F.col("i") != F.col("j"), F.col("routes")).otherwise(0)).alias("cross_region"), F.count("c").alias("closed"), F.count_if(F.col("routes") > 1).alias("multi_route"))
    jj = ch.groupBy("i", "m", "j").agg(F.count("*").alias("r")).agg(F.round(F.count_if(F.col("r") == 2) / F.count("*"), 8).alias("jaccard"))
    return a.crossJoin(F.broadcast(jj))  # one row


_CONF = """b AS (SELECT *, row_number() OVER (PARTITION BY regime ORDER BY p_value) AS r_, count(*) OVER (PARTITION BY regime) AS n_ FROM edges), q AS (SELECT * EXCLUDE (r_, n_), least(1, min(p_value * n_ / r_) OVER (PARTITION BY regime ORDER BY r_ DESC)) AS q FROM b)"""


@query(_E + f", {_CONF}, w AS (SELECT {_K}, edge_type, p_value AS p1, q AS q1, effect AS e1 FROM q WHERE regime = 'winter'), s AS (SELECT {_K}, p_value AS p2, q AS q2, effect AS e2 FROM q WHERE regime = 'summer') SELECT edge_type, count(*) AS tested, round(avg(CASE WHEN p1 < 0.2 AND p2 < 0.2 AND sign(e1) = sign(e2) THEN 1.0 ELSE 0.0 END), 8) AS confirmed_ratio, round(avg(p2), 8) AS mean_p, round(avg(q2), 8) AS mean_q FROM w JOIN s USING ({_K}) GROUP BY 1")
def confirmation_by_type(spark, sf_dir):
    return confirmed(edges(spark, sf_dir))


def confirmed(e):
    """Keys tested in both seasons, the share confirmed, mean p and q of summer; all of its tests are the family. Only counts of equal p go on to q."""
    ok = (F.col("p1") < 0.2) & (F.col("p2") < 0.2) & (F.signum("e1") == F.signum("e2"))
    c = reports.both_seasons(e).filter("e2 is not null").groupBy("edge_type", "p2").agg(F.count("*").alias("family"), F.count("e1").alias("n"), F.count_if(F.col("e1").isNotNull() & ok).alias("ok"))
    q = bh_large(written(c, "seasons"), p="p2", q="q2", count="family").filter("n > 0")
    mean = lambda c: F.round(F.sum(F.col(c) * F.col("n")) / F.sum("n"), 8)
    return q.groupBy("edge_type").agg(F.sum("n").alias("tested"), F.round(F.sum("ok") / F.sum("n"), 8).alias("confirmed_ratio"), mean("p2").alias("mean_p"), mean("q2").alias("mean_q"))


@query(_T + f", t AS (SELECT {_K}, regime, source_var || '->' || target_var AS edge_type, round(partial_r2, 9) AS r2, round({normal_tail_sql('z_hac')}, 7) AS p FROM tests), st AS (SELECT {_K} FROM t WHERE p < 0.4 GROUP BY ALL HAVING count(*) = 2), k AS (SELECT t.*, row_number() OVER (PARTITION BY edge_type, regime ORDER BY r2 DESC, {_K}) AS k FROM t JOIN st USING ({_K})) SELECT {_K}, regime, edge_type, round(r2, 8) AS partial_r2, k FROM k WHERE k <= 10")
def stable_edges_by_r2(spark, sf_dir):
    """Ten edges of most partial R2 of each type and season, among those that both seasons have."""
    t = tests(spark, sf_dir).filter("effect is not null").withColumn("edge_type", F.concat_ws("->", "source_var", "target_var")).withColumn("r2", F.round("partial_r2", 9)).withColumn("p", F.round("p_value", 7))
    st = t.filter("p < 0.4").groupBy(*KEY).agg(F.count("*").alias("c")).filter("c = 2").select(*KEY)
    k = t.join(st.hint("shuffle_merge"), KEY, "left_semi").withColumn("k", F.row_number().over(Window.partitionBy("edge_type", "regime").orderBy(F.desc("r2"), *KEY)))
    return k.filter("k <= 10").select(*KEY, "regime", "edge_type", F.round("r2", 8).alias("partial_r2"), "k")


@query(_E + """, ch AS (SELECT x.regime, x.source_region AS s, x.target_region AS m, y.target_region AS t, max(x.p_value) AS p1, max(y.p_value) AS p2, max(abs(x.effect * y.effect)) AS v FROM edges x JOIN edges y ON y.regime = x.regime AND y.source_region = x.target_region WHERE x.edge_type = 'wind->humidity' AND y.edge_type = 'humidity->cloud_cover' AND x.lag = 1 AND y.lag = 1 GROUP BY 1, 2, 3, 4),
 q AS (SELECT regime, quantile_cont(v, 0.75) AS q FROM ch WHERE p1 < 0.3 AND p2 < 0.3 GROUP BY 1), k AS (SELECT ch.*, CASE WHEN p1 >= 0.3 OR p2 >= 0.3 THEN 'unselected' WHEN v >= q THEN 'strong' ELSE 'ordinary' END AS stratum, count(*) OVER (PARTITION BY regime, s, t) - 1 AS alternatives FROM ch JOIN q USING (regime)), r AS (SELECT *, row_number() OVER (PARTITION BY regime, stratum ORDER BY (s * 131 + m * 31 + t * 7) % 1009, s, m, t) AS r FROM k)
 SELECT regime, stratum, s, m, t, alternatives FROM r WHERE r <= 5""")
def path_strata(spark, sf_dir):
    """Five paths of each stratum (strong, ordinary, unselected) with the number of other mediators between their ends."""
    e = edges(spark, sf_dir).filter("lag = 1")
    ch = reports.chains(e).groupBy("regime", F.col("a_source_region").alias("s"), F.col("mediator").alias("m"), F.col("b_target_region").alias("t")).agg(F.max("a_p_value").alias("p1"), F.max("b_p_value").alias("p2"), F.max(F.abs(F.col("a_effect") * F.col("b_effect"))).alias("v"))
    q = ch.filter("p1 < 0.3 and p2 < 0.3").groupBy("regime").agg(F.percentile("v", 0.75).alias("q"))
    k = ch.join(F.broadcast(q), "regime")  # one row per season
    k = k.withColumn("stratum", F.when((F.col("p1") >= 0.3) | (F.col("p2") >= 0.3), "unselected").when(F.col("v") >= F.col("q"), "strong").otherwise("ordinary")).withColumn("alternatives", F.count("*").over(Window.partitionBy("regime", "s", "t")) - 1)
    w = Window.partitionBy("regime", "stratum").orderBy((F.col("s") * 131 + F.col("m") * 31 + F.col("t") * 7) % 1009, "s", "m", "t")
    return k.withColumn("r", F.row_number().over(w)).filter("r <= 5").select("regime", "stratum", "s", "m", "t", "alternatives")


@query(_T + f", a AS (SELECT {_K}, effect, se_hac, n FROM tests WHERE regime = 'winter'), b AS (SELECT {_K}, effect * (1 + 1e-13) AS effect, CASE WHEN lag = 2 THEN se_hac * 1.5 ELSE se_hac END AS se_hac, n FROM tests WHERE regime = 'winter') SELECT x.name, count(*) AS cells, count(*) FILTER (abs(x.a - x.b) > 1e-10 + 1e-7 * abs(x.b)) AS disagreements, round(max(abs(x.a - x.b)), 6) AS largest FROM a JOIN b USING ({_K}), LATERAL (SELECT unnest(['effect', 'n', 'se_hac']) AS name, unnest([a.effect, a.n, a.se_hac]) AS a, unnest([b.effect, b.n, b.se_hac]) AS b) x GROUP BY 1")
def table_differences(spark, sf_dir):
    """Two copies of a result table, column by column: cells, cells beyond the tolerance, largest difference."""
    t = tests(spark, sf_dir).filter("regime = 'winter' and effect is not null").select(*KEY, "effect", "se_hac", F.col("n").cast("double").alias("n"))
    other = t.withColumn("effect", F.col("effect") * (1 + 1e-13)).withColumn("se_hac", F.col("se_hac") * F.when(F.col("lag") == 2, 1.5).otherwise(1.0))
    return column_differences(t, other, KEY)


def column_differences(a, b, key: list[str], rtol: float = 1e-7, atol: float = 1e-10):
    """name, cells, disagreements, largest; both tables must have the same columns in the same order."""
    if a.columns != b.columns:
        raise ValueError(f"columns differ: {a.columns} and {b.columns}")
    names = [c for c in a.columns if c not in key]
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("v")) for n in names]))
    long = lambda df, v: df.select(*key, cells.alias("c")).select(*key, "c.name", F.col("c.v").alias(v))
    d = F.abs(F.col("a") - F.col("b"))
    j = long(a, "a").join(long(b, "b").hint("shuffle_merge"), [*key, "name"], "full")
    return j.groupBy("name").agg(F.count("*").alias("cells"), F.count_if(F.coalesce(d > atol + rtol * F.abs("b"), F.col("a").isNull() != F.col("b").isNull())).alias("disagreements"), F.round(F.max(d), 6).alias("largest"))


def _gain_sql() -> str:
    parts, union = [], []
    for v, u in (("wind", "humidity"), ("humidity", "cloud_cover"), ("wind", "cloud_cover")):
        k = v[0] + u[0]
        rows = _rows_sql({"y": (u, 0), "c1": (u, 1), "z": (v, 1)}).replace("wr AS", f"w{k} AS", 1)
        parts.append(f"{rows}, t{k} AS (SELECT * FROM w{k} WHERE t < 250), {gram_sql('g' + k, 't' + k, ['one', 'c1', 'z', 'y'], 'node')}, {sweep_sql('f' + k, 'g' + k, 4, 3, 'node')}, {gram_sql('h' + k, 't' + k, ['one', 'c1', 'y'], 'node')}, {sweep_sql('r' + k, 'h' + k, 3, 2, 'node')}")
        union.append(f"SELECT w.node, '{v}->{u}' AS edge_type, t, pow(y - r.m[3] - c1 * r.m[6], 2) - pow(y - f.m[4] - c1 * f.m[8] - z * f.m[12], 2) AS g FROM w{k} w JOIN f{k} f USING (node) JOIN r{k} r USING (node) WHERE t >= 260")
    return _BASE + ", " + ", ".join(parts) + ", gl AS MATERIALIZED (" + " UNION ALL ".join(union) + "), cl AS (SELECT *, g - avg(g) OVER (PARTITION BY node, edge_type) AS d FROM gl), hv AS (SELECT node, edge_type, count(*) AS n, avg(g) AS gain, sum(d * (d + 2 * ((1 - t / 5.0) * coalesce(s0, 0) + coalesce(s1, 0) / 5.0))) AS var FROM (SELECT *, sum(d) OVER w AS s0, sum(d * t) OVER w AS s1 FROM cl WINDOW w AS (PARTITION BY node, edge_type ORDER BY t RANGE BETWEEN 4 PRECEDING AND 1 PRECEDING)) GROUP BY 1, 2), z AS (SELECT *, gain / (sqrt(var * n / (n - 1)) / n) AS z FROM hv)"


@query(_gain_sql() + f" SELECT node, edge_type, n, round(gain, 8) AS gain, round(z, 5) AS z, round(CASE WHEN z > 0 THEN {normal_tail_sql('z')} / 2 ELSE 1 - {normal_tail_sql('z')} / 2 END, 7) AS p_one_sided FROM z")
def frozen_source_gains(spark, sf_dir):
    """What each candidate source gains over own history on later years, frozen at the training years: mean, HAC z and one-sided p."""
    out = None
    for v, u in (("wind", "humidity"), ("humidity", "cloud_cover"), ("wind", "cloud_cover")):
        r = joint.frozen_windows(bundled(spark, sf_dir), "node", u, [(u, 1)], [(v, 1)], 250, 260, segment=10**9).filter("dropped = 'all'").withColumn("edge_type", F.lit(f"{v}->{u}"))
        out = r if out is None else out.unionByName(r)
    z = F.col("gain") / F.col("se")
    p = F.when(z > 0, p_z(z) / 2).otherwise(1 - p_z(z) / 2)
    return out.select("node", "edge_type", "n", F.round("gain", 8).alias("gain"), F.round(z, 5).alias("z"), F.round(p, 7).alias("p_one_sided"))


_PRE = ", ".join(f"('{a}', '{b}')" for a, b in _INTRA)


@query(ctes("tests") + f", l AS (SELECT v.sv, v.tv, c.s AS source, c.g AS target, corr(x.v, y.v) AS c FROM (SELECT DISTINCT s, g FROM cand2 WHERE s <> g) c, (VALUES {_PRE}) v(sv, tv) JOIN sc x ON x.node = c.s AND x.variable = v.sv JOIN sc y ON y.node = c.g AND y.variable = v.tv AND y.t = x.t + 1 GROUP BY 1, 2, 3, 4) SELECT sv AS source_var, tv AS target_var, source, target, round(c, 8) AS c FROM (SELECT *, row_number() OVER (PARTITION BY sv, tv, target ORDER BY abs(round(c, 10)) DESC, source) AS r FROM l) WHERE r <= 2")
def correlation_screen(spark, sf_dir):
    """Two neighbours of largest lag-1 correlation for every variable pair and target."""
    near = spatial.nearest(stations(spark, sf_dir), 2).select("source", "target")
    pair = F.explode(F.array(*[F.struct(F.lit(a).alias("source_var"), F.lit(b).alias("target_var")) for a, b in _INTRA]))
    cand = near.union(near.select("target", "source")).distinct().toDF("source_region", "target_region").withColumn("v", pair).select("source_region", "target_region", "v.*")
    r = screen.correlations(cand, station_series(spark, sf_dir))
    w = Window.partitionBy("source_var", "target_var", "target_region").orderBy(F.desc(F.abs(F.round("c", 10))), "source_region")
    r = r.withColumn("r", F.row_number().over(w)).filter("r <= 2")
    return r.select("source_var", "target_var", F.col("source_region").alias("source"), F.col("target_region").alias("target"), F.round("c", 8).alias("c"))


@query(ctes("tests") + f" SELECT s AS source_region, g AS target_region, sv AS source_var, tv AS target_var FROM (SELECT DISTINCT s, g FROM cand2 WHERE s <> g), (SELECT * FROM (VALUES {_PRE}) UNION SELECT column1, column0 FROM (VALUES {_PRE}) x(column0, column1)) v(sv, tv)")
def both_way_candidates(spark, sf_dir):
    """Neighbours both ways with every variable pair and its reverse, each once."""
    near = spatial.nearest(stations(spark, sf_dir), 2).select("source", "target")
    pairs = sorted({*_INTRA, *((b, a) for a, b in _INTRA)})
    v = F.explode(F.array(*[F.struct(F.lit(a).alias("source_var"), F.lit(b).alias("target_var")) for a, b in pairs]))
    return near.union(near.select("target", "source")).distinct().toDF("source_region", "target_region").withColumn("v", v).select("source_region", "target_region", "v.*")


@query(ctes("station_climate") + " SELECT variable, count(*) AS n, round(avg(v), 8) AS mean, round(max(v), 7) AS high FROM sc GROUP BY 1")
def array_source(spark, sf_dir):
    """The stations' series as NPZ archives (one array for all variables, with their names) decoded back to long rows."""
    import pandas as pd

    names = ["cloud_cover", "humidity", "temperature", "wind"]
    wide = station_climate(spark, sf_dir).groupBy("node", "t").pivot("variable", names).agg(F.first("value"))

    def pack(key, df: pd.DataFrame) -> pd.DataFrame:
        import io

        import numpy as np

        buf = io.BytesIO()
        np.savez(buf, data=df.sort_values("t")[names].to_numpy()[:, None, :], variable_names=np.array(names))
        return pd.DataFrame({"path": [f"node-{key[0]}.npz"], "content": [buf.getvalue()]})

    files = wide.groupBy("node").applyInPandas(pack, "path string, content binary")
    long = readers.decode_arrays(files)
    return long.groupBy("variable").agg(F.count("*").alias("n"), F.round(F.avg("value"), 8).alias("mean"), F.round(F.max("value"), 7).alias("high"))


@query(ctes("panel") + ", d AS (SELECT b.node AS target, a.node AS source, b.humidity AS y, o.humidity AS c, a.wind AS z FROM panel b JOIN panel o ON o.node = b.node AND o.t = b.t - 1 JOIN panel a ON a.t = b.t - 1), m AS (SELECT target, source, count(*) AS n, covar_pop(y, y) * count(*) AS syy, covar_pop(c, c) * count(*) AS scc, covar_pop(z, z) * count(*) AS szz, covar_pop(y, c) * count(*) AS syc, covar_pop(y, z) * count(*) AS syz, covar_pop(c, z) * count(*) AS scz FROM d GROUP BY 1, 2), f AS (SELECT *, syy - syc * syc / scc AS r, pow(syz - scz * syc / scc, 2) / (szz - scz * scz / scc) AS drop FROM m) SELECT target, source, n, round(drop / ((r - drop) / (n - 3)), 4) AS f_two_fits, true AS routes_agree FROM f")
def nested_two_fits(spark, sf_dir):
    """The F statistic from two explicit fits, without and with the source, held against the one by residuals."""
    from lagloom.sources.fixtures import panel

    p = panel(spark, sf_dir)
    y = p.select("t", F.col("node").alias("target"), F.col("humidity").alias("y"))
    c = p.select((F.col("t") + 1).alias("t"), F.col("node").alias("target"), F.col("humidity").alias("c"))
    z = p.select((F.col("t") + 1).alias("t"), F.col("node").alias("source"), F.col("wind").alias("z"))
    rows = y.join(c.hint("shuffle_merge"), ["t", "target"]).join(z.hint("shuffle_merge"), "t")  # five nodes
    key = ["target", "source"]
    less = gram.fit(rows, key, [], z="c").select(*key, F.col("rss_f").alias("less"))
    full = gram.fit(rows, key, ["z"], z="c").select(*key, "n", F.col("rss_f").alias("full"))
    one = gram.fit(rows, key, ["c"]).select(*key, "f")
    j = full.join(less.hint("shuffle_merge"), key).join(one.hint("shuffle_merge"), key)
    f = (F.col("less") - F.col("full")) / (F.col("full") / (F.col("n") - 3))
    return j.select(*key, "n", F.round(f, 4).alias("f_two_fits"), (F.abs(f - F.col("f")) <= 1e-6 * F.greatest(F.lit(1.0), F.col("f"))).alias("routes_agree"))
