"""Candidates, multiplicity, staged decisions and edge reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lagloom.operators import reports, spatial
from lagloom.operators.fdr import bh, bh_large
from lagloom.operators.lineage import written
from lagloom.operators.reports import KEY
from lagloom.plans import section
from lagloom.sources.fixtures import HAV_SQL, ctes, edges, stations

QUERIES, query = section()

_W = ctes("edges")
_SIG = "sig AS (SELECT * FROM edges WHERE p_value < 0.2)"
_K = ", ".join(KEY)


def _sig(spark, sf_dir):
    return edges(spark, sf_dir).filter("p_value < 0.2")


def _bh_sql(name: str, src: str, group: str, p: str = "p_value", q: str = "q_value") -> str:
    return f"""{name}_r AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {p}) AS r_, count(*) OVER (PARTITION BY {group}) AS n_ FROM {src}),
{name} AS (SELECT * EXCLUDE (r_, n_), least(min({p} * n_ / r_) OVER (PARTITION BY {group} ORDER BY r_ DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) AS {q} FROM {name}_r)"""


# ---- candidates
_HAV = HAV_SQL
_NEAR = f"nn AS (SELECT source, target, km FROM (SELECT a.node AS source, b.node AS target, {_HAV} AS km, row_number() OVER (PARTITION BY b.node ORDER BY {_HAV}, a.node) AS r FROM cells a, cells b WHERE a.node <> b.node) WHERE r <= 2)"
#: Variable pairs of links inside a region and between regions.
_INTRA = (("wind", "humidity"), ("humidity", "cloud_cover"), ("temperature", "humidity"), ("temperature", "cloud_cover"), ("wind", "cloud_cover"))
_MOVE = (("wind", "humidity"), ("humidity", "humidity"), ("humidity", "cloud_cover"), ("wind", "cloud_cover"))
_vals = lambda p: ", ".join(f"('{a}', '{b}')" for a, b in p)
_CAND = f"""cand AS (SELECT node AS source_region, node AS target_region, sv AS source_var, tv AS target_var, 0.0::DOUBLE AS km FROM cells, (VALUES {_vals(_INTRA)}) v(sv, tv)
 UNION ALL SELECT source, target, sv, tv, km FROM nn, (VALUES {_vals(_MOVE)}) v(sv, tv))"""


def candidates(nodes, k: int = 2):
    """Links inside each node and from its k nearest."""
    pair = lambda p: F.explode(F.array(*[F.struct(F.lit(a).alias("source_var"), F.lit(b).alias("target_var")) for a, b in p]))
    own = nodes.select(F.col("node").alias("source_region"), F.col("node").alias("target_region"), F.lit(0.0).alias("km")).withColumn("v", pair(_INTRA))
    move = spatial.nearest(nodes, k).select(F.col("source").alias("source_region"), F.col("target").alias("target_region"), "km").withColumn("v", pair(_MOVE))
    return own.unionByName(move).select("source_region", "target_region", "v.source_var", "v.target_var", "km").dropDuplicates(["source_region", "target_region", "source_var", "target_var"])


@query(ctes("stations") + f", {_NEAR}, {_CAND} SELECT source_region, target_region, source_var, target_var, round(km, 6) AS km FROM cand")
def candidate_edges(spark, sf_dir):
    return candidates(stations(spark, sf_dir)).withColumn("km", F.round("km", 6))


@query(ctes("stations") + f", {_NEAR}, u AS (SELECT source AS a, target AS b FROM nn UNION SELECT target, source FROM nn) SELECT a AS source_region, b AS target_region, sv AS source_var, tv AS target_var FROM u, (VALUES {_vals(_INTRA[:3])}) v(sv, tv)")
def symmetric_candidates(spark, sf_dir):
    nn = spatial.nearest(stations(spark, sf_dir), 2).select("source", "target")
    u = nn.union(nn.select("target", "source")).distinct()
    v = F.explode(F.array(*[F.struct(F.lit(a).alias("source_var"), F.lit(b).alias("target_var")) for a, b in _INTRA[:3]]))
    return u.select(F.col("source").alias("source_region"), F.col("target").alias("target_region"), v.alias("v")).select("source_region", "target_region", "v.*")


@query(ctes("stations") + f", {_NEAR}, {_CAND} SELECT DISTINCT target_region AS source_region, source_region AS target_region, target_var AS source_var, source_var AS target_var FROM cand")
def reversed_edges(spark, sf_dir):
    c = candidates(stations(spark, sf_dir))
    return c.select(F.col("target_region").alias("source_region"), F.col("source_region").alias("target_region"), F.col("target_var").alias("source_var"), F.col("source_var").alias("target_var")).distinct()


@query(ctes("stations") + f", {_NEAR}, {_CAND} SELECT source_var || '->' || target_var AS edge_type, lag, count(*) AS n, sum(source_region * 12 + lag) AS design_columns FROM cand, range(1, 4) l(lag) GROUP BY 1, 2")
def lag_expansion(spark, sf_dir):
    c = candidates(stations(spark, sf_dir)).withColumn("lag", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long"))))
    return c.groupBy(F.concat_ws("->", "source_var", "target_var").alias("edge_type"), "lag").agg(F.count("*").alias("n"), F.sum(F.col("source_region") * 12 + F.col("lag")).alias("design_columns"))


@query(ctes("stations") + f", {_NEAR}, {_CAND} SELECT source_var || '->' || target_var AS edge_type, (km >= 1e-8)::BIGINT + (km >= 1000)::BIGINT + (km >= 2000)::BIGINT + (km >= 3000)::BIGINT + (km >= 4000)::BIGINT + (km >= 6000)::BIGINT + (km >= 10000)::BIGINT AS stratum, count(*) AS n FROM cand GROUP BY 1, 2")
def candidate_strata(spark, sf_dir):
    return candidates(stations(spark, sf_dir)).groupBy(F.concat_ws("->", "source_var", "target_var").alias("edge_type"), spatial.stratum(F.col("km")).alias("stratum")).agg(F.count("*").alias("n"))


@query(ctes("panel") + """, l AS (SELECT a.node AS source, b.node AS target, corr(a.wind, b.humidity) AS c FROM panel a JOIN panel b ON b.t = a.t + 1 GROUP BY 1, 2)
 SELECT source, target, round(c, 8) AS c FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY abs(c) DESC, source) AS r FROM l WHERE source <> target) WHERE r <= 2""")
def correlation_prescreen(spark, sf_dir):
    from lagloom.sources.fixtures import panel

    p = panel(spark, sf_dir)
    a = p.select((F.col("t") + 1).alias("t"), F.col("node").alias("source"), F.col("wind").alias("x"))
    j = a.join(p.select("t", F.col("node").alias("target"), F.col("humidity").alias("y")), "t").filter("source <> target")
    n, sx, sy = F.count("*"), F.stddev_pop("x"), F.stddev_pop("y")
    c = j.groupBy("source", "target").agg(F.when((sx > 0) & (sy > 0), F.covar_pop("x", "y") / (sx * sy)).alias("c"))
    return c.withColumn("r", F.row_number().over(Window.partitionBy("target").orderBy(F.desc(F.abs("c")), "source"))).filter("r <= 2").select("source", "target", F.round("c", 8).alias("c"))


# ---- multiplicity and staged decisions
@query(f"{_W}, {_bh_sql('bh', 'edges', 'regime')} SELECT regime, {_K}, round(q_value, 10) AS q_value, q_value < 0.05 AS significant FROM bh")
def bh_by_regime(spark, sf_dir):
    return bh_large(edges(spark, sf_dir), ["regime"], alpha=0.05).select("regime", *KEY, F.round("q_value", 10).alias("q_value"), "significant")


@query(f"{_W}, {_bh_sql('g', 'edges', '1', q='q_global')}, {_bh_sql('w', 'g', 'regime, target_region', q='q_within')} SELECT regime, {_K}, round(q_global, 10) AS q_global, round(q_within, 10) AS q_within FROM w")
def two_families(spark, sf_dir):
    e = bh_large(edges(spark, sf_dir), q="q_global")
    return bh(e, ["regime", "target_region"], q="q_within", alpha=None).select("regime", *KEY, F.round("q_global", 10).alias("q_global"), F.round("q_within", 10).alias("q_within"))


@query(f"{_W}, s AS (SELECT * FROM edges WHERE (source_region, target_region) IN (SELECT source_region, target_region FROM edges WHERE lag = 1 AND regime = 'winter' AND p_value < 0.1)), {_bh_sql('bh', 's', 'regime')} SELECT regime, {_K}, round(q_value, 10) AS q_value FROM bh")
def recalibrated_subset(spark, sf_dir):
    return recalibrated(edges(spark, sf_dir))


def recalibrated(e):
    """q of all edges between regions that winter links at lag 1. Edges of two regions are gathered in one shuffle, those left are stored: at no size a join decides how they are sent."""
    tested = F.collect_list(F.struct("source_var", "target_var", "lag", "regime", "p_value")).alias("tested")
    pairs = e.groupBy("source_region", "target_region").agg(tested)
    pairs = pairs.filter(F.exists("tested", lambda x: (x["lag"] == 1) & (x["regime"] == "winter") & (x["p_value"] < 0.1)))
    some = written(pairs.select("source_region", "target_region", F.inline("tested")), "subset")
    return bh_large(some, ["regime"]).select("regime", *KEY, F.round("q_value", 10).alias("q_value"))


@query(f"{_W}, {_SIG} SELECT DISTINCT {_K} FROM sig")
def selected_keys(spark, sf_dir):
    return _sig(spark, sf_dir).select(*KEY).distinct()


_STAGE = f"""w AS (SELECT {_K}, edge_type, p_value AS p1, effect AS e1 FROM edges WHERE regime = 'winter'), s AS (SELECT {_K}, p_value AS p2, effect AS e2 FROM edges WHERE regime = 'summer'),
j AS (SELECT *, p1 < 0.4 AS screened, CASE WHEN sign(e1) = sign(e2) THEN p2 / 2 ELSE 1 - p2 / 2 END AS one_sided FROM w JOIN s USING ({_K})), {_bh_sql('f', 'j', 'screened', 'one_sided', 'q')}"""


def _paired(e):
    """Keys tested in both seasons, whether winter passes the screen, and summer's p in winter's direction."""
    same = F.signum("e1") == F.signum("e2")
    j = reports.both_seasons(e).filter("e1 is not null and e2 is not null").withColumn("screened", F.col("p1") < 0.4)
    return j.withColumn("one_sided", F.when(same, F.col("p2") / 2).otherwise(1 - F.col("p2") / 2))


@query(f"{_W}, {_STAGE} SELECT {_K}, screened, round(one_sided, 10) AS one_sided, round(q, 10) AS q, screened AND q < 0.9 AS replicated FROM f")
def staged_replication(spark, sf_dir):
    return bh_large(_paired(edges(spark, sf_dir)), ["screened"], "one_sided", "q").select(*KEY, "screened", F.round("one_sided", 10).alias("one_sided"), F.round("q", 10).alias("q"), (F.col("screened") & (F.col("q") < 0.9)).alias("replicated"))


@query(f"{_W}, {_STAGE} SELECT coalesce(edge_type, 'ALL') AS edge_type, count(*) AS tested, count(*) FILTER (screened) AS screened, count(*) FILTER (screened AND q < 0.9) AS replicated, count(*) FILTER (NOT screened AND q < 0.9) AS negative_controls, round(quantile_cont(abs(e1), 0.5), 8) AS median_abs FROM f GROUP BY ROLLUP (edge_type)")
def stage_summary(spark, sf_dir):
    return staged(edges(spark, sf_dir))


def staged(e):
    """Counts of each stage and the median effect, by type and in all: pairs are stored without their keys, equal p and equal effects go on as one row with their count."""
    j = written(_paired(e).select("edge_type", "screened", "one_sided", F.abs("e1").alias("size")), "stages")
    n = lambda *by: j.groupBy("edge_type", *by).agg(F.count("*").alias("n"))
    ok, on = F.col("q") < 0.9, F.col("screened")
    some = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    q = bh_large(n("screened", "one_sided"), ["screened"], "one_sided", "q", count="n")
    counts = q.rollup("edge_type").agg(F.sum("n").alias("tested"), some(on).alias("n_screened"), some(on & ok).alias("replicated"), some(~on & ok).alias("negative_controls"))
    median = n("size").rollup("edge_type").agg(F.round(F.percentile("size", 0.5, F.col("n")), 8).alias("median_abs"))
    named = lambda df: df.withColumn("edge_type", F.coalesce("edge_type", F.lit("ALL")))
    return named(counts).join(F.broadcast(named(median)), "edge_type").withColumnRenamed("n_screened", "screened")  # a row per type


@query(f"{_W}, o AS (SELECT *, row_number() OVER (PARTITION BY {_K} ORDER BY abs(effect) DESC, regime) AS r FROM edges), t AS (SELECT *, row_number() OVER (PARTITION BY edge_type ORDER BY abs(effect) DESC, {_K}) AS k FROM o WHERE r = 1) SELECT edge_type, {_K}, regime, k FROM t WHERE k <= 5")
def top_edges(spark, sf_dir):
    e = edges(spark, sf_dir).withColumn("r", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc(F.abs("effect")), "regime"))).filter("r = 1")
    return e.withColumn("k", F.row_number().over(Window.partitionBy("edge_type").orderBy(F.desc(F.abs("effect")), *KEY))).filter("k <= 5").select("edge_type", *KEY, "regime", "k")


@query(f"{_W}, a AS (SELECT {_K}, effect FROM edges WHERE regime = 'winter' AND p_value < 0.5), b AS (SELECT {_K}, effect FROM edges WHERE regime = 'summer' AND p_value < 0.5) SELECT CASE WHEN b.effect IS NULL THEN 'left' WHEN a.effect IS NULL THEN 'right' WHEN abs(a.effect - b.effect) <= 1e-10 + 1e-7 * abs(b.effect) THEN 'same' ELSE 'different' END AS status, count(*) AS n FROM a FULL JOIN b USING ({_K}) GROUP BY 1")
def table_comparison(spark, sf_dir):
    e = edges(spark, sf_dir).filter("p_value < 0.5")
    a = e.filter("regime = 'winter'").select(*KEY, F.col("effect").alias("a"))
    b = e.filter("regime = 'summer'").select(*KEY, F.col("effect").alias("b"))
    status = F.when(F.col("b").isNull(), "left").when(F.col("a").isNull(), "right").when(F.abs(F.col("a") - F.col("b")) <= 1e-10 + 1e-7 * F.abs("b"), "same").otherwise("different")
    return a.join(b, KEY, "full").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


# ---- reports
@query(f"{_W} SELECT regime, count(*) AS tested, count(*) FILTER (p_value < 0.2) AS significant, round(avg(CASE WHEN p_value < 0.2 THEN 1.0 ELSE 0.0 END), 10) AS fraction, count(*) FILTER (p_value < 0.2 AND source_region <> target_region) AS cross_region, round(avg(CASE WHEN p_value < 0.2 THEN lag END), 8) AS mean_lag FROM edges GROUP BY 1")
def summary_metrics(spark, sf_dir):
    s = F.col("p_value") < 0.2
    return edges(spark, sf_dir).groupBy("regime").agg(
        F.count("*").alias("tested"), F.count_if(s).alias("significant"), F.round(F.avg(F.when(s, 1.0).otherwise(0.0)), 10).alias("fraction"),
        F.count_if(s & (F.col("source_region") != F.col("target_region"))).alias("cross_region"), F.round(F.avg(F.when(s, F.col("lag"))), 8).alias("mean_lag"),
    )


@query(f"{_W}, d AS (SELECT DISTINCT regime || lag AS g, source_region, target_region, source_var, target_var FROM edges WHERE p_value < 0.2), n AS (SELECT g, count(*) AS n FROM d GROUP BY 1), b AS (SELECT a.g AS a, b.g AS b, count(*) AS k FROM d a JOIN d b USING (source_region, target_region, source_var, target_var) WHERE a.g < b.g GROUP BY 1, 2) SELECT x.g AS a, y.g AS b, coalesce(k, 0) AS \"both\", x.n + y.n - coalesce(k, 0) AS \"union\", round(1 - coalesce(k, 0) / (x.n + y.n - coalesce(k, 0))::DOUBLE, 10) AS distance FROM n x JOIN n y ON x.g < y.g LEFT JOIN b ON b.a = x.g AND b.b = y.g")
def regime_jaccard(spark, sf_dir):
    e = _sig(spark, sf_dir).withColumn("g", F.concat("regime", F.col("lag").cast("string")))
    return reports.jaccard(e, "g", KEY[:4]).select("a", "b", "both", "union", F.round("distance", 10).alias("distance"))


_CH = f"ch AS (SELECT x.regime, x.source_region AS a_source_region, x.target_region AS mediator, y.target_region AS b_target_region, x.lag AS a_lag, y.lag AS b_lag, x.effect AS a_effect, y.effect AS b_effect FROM sig x JOIN sig y ON x.regime = y.regime AND x.target_region = y.source_region WHERE x.source_var = 'wind' AND x.target_var = 'humidity' AND y.source_var = 'humidity' AND y.target_var = 'cloud_cover')"


@query(f"{_W}, {_SIG}, {_CH} SELECT regime, count(*) AS n, count(DISTINCT mediator) AS mediators, round(avg(a_lag + b_lag), 8) AS total_lag, round(avg(a_effect * b_effect), 8) AS score FROM ch GROUP BY 1")
def causal_chains(spark, sf_dir):
    return reports.chains(_sig(spark, sf_dir)).groupBy("regime").agg(
        F.count("*").alias("n"), F.count_distinct("mediator").alias("mediators"), F.round(F.avg(F.col("a_lag") + F.col("b_lag")), 8).alias("total_lag"), F.round(F.avg(F.col("a_effect") * F.col("b_effect")), 8).alias("score")
    )


@query(f"{_W}, {_SIG}, i AS (SELECT regime, target_region AS m, count(*) AS n FROM sig WHERE source_var = 'wind' AND target_var = 'humidity' GROUP BY 1, 2), o AS (SELECT regime, source_region AS m, count(*) AS n FROM sig WHERE source_var = 'humidity' AND target_var = 'cloud_cover' GROUP BY 1, 2) SELECT regime, m AS mediator, i.n * o.n AS chains FROM i JOIN o USING (regime, m)")
def chain_count_from_degrees(spark, sf_dir):
    s = _sig(spark, sf_dir)
    i = s.filter("source_var = 'wind' and target_var = 'humidity'").groupBy("regime", F.col("target_region").alias("mediator")).agg(F.count("*").alias("i"))
    o = s.filter("source_var = 'humidity' and target_var = 'cloud_cover'").groupBy("regime", F.col("source_region").alias("mediator")).agg(F.count("*").alias("o"))
    return i.join(o, ["regime", "mediator"]).select("regime", "mediator", (F.col("i") * F.col("o")).alias("chains"))


@query(f"{_W}, {_SIG} SELECT regime, edge_type, count(*) AS n FROM sig GROUP BY 1, 2")
def edge_type_counts(spark, sf_dir):
    return _sig(spark, sf_dir).groupBy("regime", "edge_type").agg(F.count("*").alias("n"))


@query(f"{_W}, {_SIG}, {_CH}, c AS (SELECT DISTINCT regime, a_source_region, mediator, b_target_region FROM ch) SELECT (SELECT count(*) FROM c WHERE regime = 'winter') AS n_winter, (SELECT count(*) FROM c WHERE regime = 'summer') AS n_summer, (SELECT count(*) FROM c a JOIN c b USING (a_source_region, mediator, b_target_region) WHERE a.regime = 'winter' AND b.regime = 'summer') AS shared")
def chain_sets(spark, sf_dir):
    c = reports.chains(_sig(spark, sf_dir)).groupBy("a_source_region", "mediator", "b_target_region").agg(F.collect_set("regime").alias("r"))
    has = lambda x: F.array_contains("r", x)
    return c.agg(F.count_if(has("winter")).alias("n_winter"), F.count_if(has("summer")).alias("n_summer"), F.count_if(has("winter") & has("summer")).alias("shared"))


@query(f"{_W}, sig AS (SELECT * FROM edges WHERE p_value < 0.5), k AS (SELECT {_K}, count(DISTINCT regime) AS n, string_agg(DISTINCT regime, ',' ORDER BY regime) AS regimes FROM sig GROUP BY ALL) SELECT {_K}, regimes FROM k WHERE n = 2")
def persistent_edges(spark, sf_dir):
    k = edges(spark, sf_dir).filter("p_value < 0.5").groupBy(*KEY).agg(F.array_sort(F.collect_set("regime")).alias("r"))
    return k.filter(F.size("r") == 2).select(*KEY, F.array_join("r", ",").alias("regimes"))


@query(f"{_W}, {_SIG}, w AS (SELECT {_K} FROM sig WHERE regime = 'winter'), s AS (SELECT {_K} FROM sig WHERE regime = 'summer') SELECT (SELECT count(*) FROM (SELECT * FROM w INTERSECT SELECT * FROM s)) AS recovered, (SELECT count(*) FROM (SELECT * FROM s EXCEPT SELECT * FROM w)) AS fresh, (SELECT count(*) FROM (SELECT * FROM w EXCEPT SELECT * FROM s)) AS lost")
def recovered_and_new(spark, sf_dir):
    k = _sig(spark, sf_dir).groupBy(*KEY).agg(F.count_if(F.col("regime") == "winter").alias("w"), F.count_if(F.col("regime") == "summer").alias("s"))
    return k.agg(F.count_if((F.col("w") > 0) & (F.col("s") > 0)).alias("recovered"), F.count_if((F.col("w") == 0) & (F.col("s") > 0)).alias("fresh"), F.count_if((F.col("w") > 0) & (F.col("s") == 0)).alias("lost"))


@query(f"{_W}, {_SIG}, p AS (SELECT {_K}, edge_type, count(DISTINCT regime) / 2.0 AS stability FROM sig GROUP BY ALL) SELECT edge_type, count(*) AS n, round(avg(stability), 8) AS stability, count(*) FILTER (stability = 1) AS stable FROM p GROUP BY 1")
def stability_by_type(spark, sf_dir):
    p = _sig(spark, sf_dir).groupBy(*KEY, "edge_type").agg((F.count_distinct("regime") / 2.0).alias("stability"))
    return p.groupBy("edge_type").agg(F.count("*").alias("n"), F.round(F.avg("stability"), 8).alias("stability"), F.count_if(F.col("stability") == 1).alias("stable"))


_B = "CASE WHEN abs({0}.lat) < 23.5 THEN 'tropics' WHEN abs({0}.lat) < 60 THEN 'midlatitude' ELSE 'polar' END"


@query(ctes("edges") + f", {_SIG} SELECT {_B.format('a')} AS source_band, {_B.format('b')} AS target_band, edge_type, count(*) AS n, round(avg(lag), 8) AS lag, round(avg(abs(effect)), 8) AS strength FROM sig JOIN cells a ON a.node = source_region JOIN cells b ON b.node = target_region GROUP BY 1, 2, 3")
def band_transfers(spark, sf_dir):
    c = stations(spark, sf_dir).select("node", spatial.band(F.col("lat")).alias("band"))
    s = _sig(spark, sf_dir).join(c.select(F.col("node").alias("source_region"), F.col("band").alias("source_band")), "source_region")
    s = s.join(c.select(F.col("node").alias("target_region"), F.col("band").alias("target_band")), "target_region")
    return s.groupBy("source_band", "target_band", "edge_type").agg(F.count("*").alias("n"), F.round(F.avg("lag"), 8).alias("lag"), F.round(F.avg(F.abs("effect")), 8).alias("strength"))


@query(ctes("edges") + f", {_SIG}, {_CH} SELECT regime, {_B.format('c')} AS band, count(*) AS chains, count(DISTINCT mediator) AS mediators FROM ch JOIN cells c ON c.node = mediator GROUP BY 1, 2")
def chains_by_band(spark, sf_dir):
    c = stations(spark, sf_dir).select(F.col("node").alias("mediator"), spatial.band(F.col("lat")).alias("band"))
    return reports.chains(_sig(spark, sf_dir)).join(c, "mediator").groupBy("regime", "band").agg(F.count("*").alias("chains"), F.count_distinct("mediator").alias("mediators"))


@query(f"{_W}, {_SIG} SELECT regime, coalesce(edge_type, 'all') AS edge_type, count(*) AS n, round(quantile_cont(effect, 0.25), 8) AS q25, round(quantile_cont(effect, 0.5), 8) AS q50, round(quantile_cont(effect, 0.75), 8) AS q75, round(avg(CASE WHEN effect > 0 THEN 1.0 ELSE 0.0 END), 8) AS positive FROM sig GROUP BY GROUPING SETS ((regime, edge_type), (regime))")
def effect_summary(spark, sf_dir):
    s = _sig(spark, sf_dir).withColumn("edge_type", F.explode(F.array("edge_type", F.lit("all"))))
    q = F.percentile("effect", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    s = s.groupBy("regime", "edge_type").agg(F.count("*").alias("n"), q.alias("q"), F.round(F.avg(F.when(F.col("effect") > 0, 1.0).otherwise(0.0)), 8).alias("positive"))
    return s.select("regime", "edge_type", "n", *[F.round(F.col("q")[i], 8).alias(n) for i, n in enumerate(("q25", "q50", "q75"))], "positive")


@query(f"{_W}, a AS (SELECT {_K}, edge_type FROM edges WHERE regime = 'winter' AND p_value < 0.3), b AS (SELECT {_K}, edge_type FROM edges WHERE regime = 'summer' AND p_value < 0.3), j AS (SELECT coalesce(a.edge_type, b.edge_type) AS edge_type, a.edge_type IS NOT NULL AS ia, b.edge_type IS NOT NULL AS ib FROM a FULL JOIN b USING ({_K})) SELECT edge_type, round(count(*) FILTER (ia AND ib) / (count(*) FILTER (ia))::DOUBLE, 8) AS recovery, round(count(*) FILTER (ia AND ib) / (count(*) FILTER (ib))::DOUBLE, 8) AS precision, round(count(*) FILTER (ia AND ib) / count(*)::DOUBLE, 8) AS jaccard FROM j GROUP BY 1")
def graph_comparison(spark, sf_dir):
    e = edges(spark, sf_dir).filter("p_value < 0.3")
    j = e.groupBy(*KEY, "edge_type").agg(F.max(F.col("regime") == "winter").alias("ia"), F.max(F.col("regime") == "summer").alias("ib"))
    both = F.count_if(F.col("ia") & F.col("ib"))
    return j.groupBy("edge_type").agg(F.round(both / F.count_if("ia"), 8).alias("recovery"), F.round(both / F.count_if("ib"), 8).alias("precision"), F.round(both / F.count("*"), 8).alias("jaccard"))


@query(f"{_W}, {_SIG}, l AS (SELECT edge_type, lag, count(*) AS n FROM sig GROUP BY 1, 2) SELECT edge_type, (SELECT min(lag) FROM l x WHERE x.edge_type = s.edge_type AND n = (SELECT max(n) FROM l y WHERE y.edge_type = s.edge_type)) AS peak, round(avg(lag), 8) AS mean, quantile_cont(lag, 0.5) AS median, round(avg(CASE WHEN lag BETWEEN 2 AND 3 THEN 1.0 ELSE 0.0 END), 8) AS late_share FROM sig s GROUP BY 1")
def lag_summary(spark, sf_dir):
    s = _sig(spark, sf_dir)
    peak = s.groupBy("edge_type", "lag").count().groupBy("edge_type").agg(F.max_by("lag", F.struct("count", -F.col("lag"))).alias("peak"))
    m = s.groupBy("edge_type").agg(F.round(F.avg("lag"), 8).alias("mean"), F.percentile("lag", 0.5).alias("median"), F.round(F.avg(F.when(F.col("lag").between(2, 3), 1.0).otherwise(0.0)), 8).alias("late_share"))
    return m.join(peak, "edge_type")


@query(f"{_W}, {_SIG}, c AS (SELECT regime, lag, count(*) AS n FROM sig GROUP BY 1, 2), f AS (SELECT lag, n / (sum(n) OVER (PARTITION BY regime))::DOUBLE AS f FROM c) SELECT lag, round(avg(f), 8) AS share FROM f GROUP BY 1")
def per_lag_shares(spark, sf_dir):
    c = _sig(spark, sf_dir).groupBy("regime", "lag").agg(F.count("*").alias("n"))
    return c.withColumn("f", F.col("n") / F.sum("n").over(Window.partitionBy("regime"))).groupBy("lag").agg(F.round(F.avg("f"), 8).alias("share"))


@query(f"{_W}, {_SIG} SELECT source_region, target_region, count(DISTINCT regime) AS regimes, round(avg(effect), 8) AS effect, round(avg(lag), 8) AS lag FROM sig WHERE edge_type = 'wind->humidity' GROUP BY 1, 2")
def map_edges(spark, sf_dir):
    return _sig(spark, sf_dir).filter("edge_type = 'wind->humidity'").groupBy("source_region", "target_region").agg(F.count_distinct("regime").alias("regimes"), F.round(F.avg("effect"), 8).alias("effect"), F.round(F.avg("lag"), 8).alias("lag"))


@query(f"{_W}, {_SIG} SELECT regime, count(*) FILTER (edge_type = 'wind->humidity') AS wh, count(*) FILTER (edge_type = 'humidity->cloud_cover') AS hc, count(*) FILTER (edge_type = 'wind->cloud_cover') AS wc FROM sig GROUP BY 1")
def edge_count_matrix(spark, sf_dir):
    names = ["wind->humidity", "humidity->cloud_cover", "wind->cloud_cover"]
    p = _sig(spark, sf_dir).groupBy("regime").pivot("edge_type", names).count().na.fill(0)
    return p.toDF("regime", "wh", "hc", "wc")


@query(f"{_W}, {_SIG} SELECT source_region, target_region, string_agg(DISTINCT lag, ';' ORDER BY lag) AS lags, count(DISTINCT lag) AS n_lags, source_region = target_region AS local FROM sig GROUP BY 1, 2, 5")
def network_pairs(spark, sf_dir):
    g = _sig(spark, sf_dir).groupBy("source_region", "target_region").agg(F.array_sort(F.collect_set("lag")).alias("l"))
    return g.select("source_region", "target_region", F.array_join(F.col("l").cast("array<string>"), ";").alias("lags"), F.size("l").alias("n_lags"), (F.col("source_region") == F.col("target_region")).alias("local"))


@query(f"{_W}, k AS (SELECT * FROM edges ORDER BY abs(effect) DESC, regime, {_K} LIMIT 200) SELECT source_region, target_region, round(sum(abs(effect)), 8) AS weight, count(*) AS n FROM k GROUP BY 1, 2")
def region_digraph(spark, sf_dir):
    k = edges(spark, sf_dir).orderBy(F.desc(F.abs("effect")), "regime", *KEY).limit(200)
    return k.groupBy("source_region", "target_region").agg(F.round(F.sum(F.abs("effect")), 8).alias("weight"), F.count("*").alias("n"))


@query(f"{_W}, m AS (SELECT regime, 'p' AS method, p_value < 0.1 AS s FROM edges UNION ALL SELECT regime, 'effect', abs(effect) > 0.5 FROM edges) SELECT method, coalesce(regime, 'TOTAL') AS regime, count(*) AS n, count(*) FILTER (s) AS significant FROM m GROUP BY GROUPING SETS ((method, regime), (method))")
def significance_summary(spark, sf_dir):
    m = F.explode(F.array(F.struct(F.lit("p").alias("method"), (F.col("p_value") < 0.1).alias("s")), F.struct(F.lit("effect").alias("method"), (F.abs("effect") > 0.5).alias("s"))))
    e = edges(spark, sf_dir).select("regime", m.alias("m"))
    e = e.select(F.explode(F.array("regime", F.lit("TOTAL"))).alias("regime"), "m.method", "m.s")
    return e.groupBy("method", "regime").agg(F.count("*").alias("n"), F.count_if("s").alias("significant"))


@query(f"{_W}, u AS (SELECT source_region AS region, lag, regime, source_var AS v FROM edges WHERE p_value < 0.2 UNION ALL SELECT target_region, lag, regime, target_var FROM edges WHERE p_value < 0.2) SELECT region, count(*) AS degree, count(DISTINCT v) AS variables, max(lag) AS longest FROM u GROUP BY 1")
def endpoint_metadata(spark, sf_dir):
    s = _sig(spark, sf_dir)
    u = s.select(F.col("source_region").alias("region"), "lag", F.col("source_var").alias("v")).union(s.select("target_region", "lag", "target_var"))
    return u.groupBy("region").agg(F.count("*").alias("degree"), F.count_distinct("v").alias("variables"), F.max("lag").alias("longest"))


@query(f"{_W}, f AS (SELECT regime, source_region AS a, target_region AS b, edge_type, lag, abs(effect) AS x FROM edges WHERE source_region < target_region), r AS (SELECT regime, target_region AS a, source_region AS b, edge_type, lag, abs(effect) AS y FROM edges WHERE source_region > target_region) SELECT edge_type, count(*) AS pairs, count(*) FILTER (x > y) AS forward, count(*) FILTER (x < y) AS backward, round(quantile_cont(ln((x + 0.01) / (y + 0.01)), 0.5), 8) AS median_log_ratio FROM f JOIN r USING (regime, a, b, edge_type, lag) GROUP BY 1")
def direction_asymmetry(spark, sf_dir):
    e = edges(spark, sf_dir)
    f = e.filter("source_region < target_region").select("regime", F.col("source_region").alias("a"), F.col("target_region").alias("b"), "edge_type", "lag", F.abs("effect").alias("x"))
    r = e.filter("source_region > target_region").select("regime", F.col("target_region").alias("a"), F.col("source_region").alias("b"), "edge_type", "lag", F.abs("effect").alias("y"))
    j = f.join(r, ["regime", "a", "b", "edge_type", "lag"])
    return j.groupBy("edge_type").agg(F.count("*").alias("pairs"), F.count_if(F.col("x") > F.col("y")).alias("forward"), F.count_if(F.col("x") < F.col("y")).alias("backward"), F.round(F.percentile(F.log((F.col("x") + 0.01) / (F.col("y") + 0.01)), 0.5), 8).alias("median_log_ratio"))


@query(f"{_W} SELECT regime, edge_type, round((k / n + 1.9208 / n) / (1 + 3.8416 / n), 10) AS centre, round(1.96 * sqrt(k / n * (1 - k / n) / n + 0.9604 / (n * n)) / (1 + 3.8416 / n), 10) AS half FROM (SELECT regime, edge_type, count(*)::DOUBLE AS n, (count(*) FILTER (p_value < 0.2))::DOUBLE AS k FROM edges GROUP BY 1, 2)")
def wilson_interval(spark, sf_dir):
    g = edges(spark, sf_dir).groupBy("regime", "edge_type").agg(F.count("*").cast("double").alias("n"), F.count_if(F.col("p_value") < 0.2).cast("double").alias("k"))
    p, n, z2 = F.col("k") / F.col("n"), F.col("n"), 1.96 * 1.96
    d = 1 + z2 / n
    return g.select("regime", "edge_type", F.round((p + z2 / 2 / n) / d, 10).alias("centre"), F.round(1.96 * F.sqrt(p * (1 - p) / n + z2 / 4 / (n * n)) / d, 10).alias("half"))


@query(f"{_W}, x AS (SELECT regime, p_value < 0.2 AS s, (source_region + target_region) % 3 = 0 AS truth FROM edges), c AS (SELECT regime, count(*) FILTER (s AND truth) AS tp, count(*) FILTER (s AND NOT truth) AS fp, count(*) FILTER (NOT s AND truth) AS fn, count(*) FILTER (NOT s AND NOT truth) AS tn FROM x GROUP BY 1) SELECT *, fp + fn AS shd, round(tp / (tp + fp)::DOUBLE, 8) AS precision, round(tp / (tp + fn)::DOUBLE, 8) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 8) AS f1 FROM c")
def discovery_scores(spark, sf_dir):
    s, t = F.col("p_value") < 0.2, (F.col("source_region") + F.col("target_region")) % 3 == 0
    c = edges(spark, sf_dir).groupBy("regime").agg(F.count_if(s & t).alias("tp"), F.count_if(s & ~t).alias("fp"), F.count_if(~s & t).alias("fn"), F.count_if(~s & ~t).alias("tn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("*", (fp + fn).alias("shd"), F.round(F.try_divide(tp, tp + fp), 8).alias("precision"), F.round(F.try_divide(tp, tp + fn), 8).alias("recall"), F.round(F.try_divide(2.0 * tp, 2 * tp + fp + fn), 8).alias("f1"))


@query(f"{_W}, {_SIG} SELECT regime, source_region AS i, target_region AS j, count(DISTINCT mediator) AS routes, bool_or(w.closed) AS closed FROM (SELECT x.regime, x.source_region, y.target_region, x.target_region AS mediator, EXISTS (SELECT 1 FROM sig z WHERE z.regime = x.regime AND z.source_region = x.source_region AND z.target_region = y.target_region AND z.edge_type = 'wind->cloud_cover') AS closed FROM sig x JOIN sig y ON x.regime = y.regime AND x.target_region = y.source_region WHERE x.edge_type = 'wind->humidity' AND y.edge_type = 'humidity->cloud_cover') w GROUP BY 1, 2, 3")
def graph_metrics(spark, sf_dir):
    s = _sig(spark, sf_dir)
    ch = reports.chains(s).groupBy("regime", F.col("a_source_region").alias("i"), F.col("b_target_region").alias("j")).agg(F.count_distinct("mediator").alias("routes"))
    direct = s.filter("edge_type = 'wind->cloud_cover'").select("regime", F.col("source_region").alias("i"), F.col("target_region").alias("j"), F.lit(True).alias("d")).distinct()
    return ch.join(direct, ["regime", "i", "j"], "left").select("regime", "i", "j", "routes", F.coalesce("d", F.lit(False)).alias("closed"))


@query(f"{_W}, {_SIG} SELECT edge_type, source_region AS node, count(*) AS out_degree, count(*) FILTER (source_region <> target_region) AS cross_degree FROM sig GROUP BY 1, 2")
def degree_signature(spark, sf_dir):
    return _sig(spark, sf_dir).groupBy("edge_type", F.col("source_region").alias("node")).agg(F.count("*").alias("out_degree"), F.count_if(F.col("source_region") != F.col("target_region")).alias("cross_degree"))
