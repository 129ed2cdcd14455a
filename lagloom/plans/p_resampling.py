"""Bootstraps that refit, paired loss bootstraps, random and matched edges, stratified nulls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagloom.operators import panels, reports, screen, spatial
from lagloom.operators.fdr import bh_large
from lagloom.operators.lineage import cut, stored
from lagloom.operators.ranks import rank_by_ranges
from lagloom.plans import section
from lagloom.plans.c_spatial import _REGIONS, regions
from lagloom.plans.m_verify import predictions
from lagloom.sources.fixtures import HAV_SQL, ctes, day_number, edges, panel, sources, station_bundles, station_candidates, station_series, stations
from lagloom.sources.sqltext import t_tail_sql

QUERIES, query = section()
REPLICATES = 10

#: Positions of the lagged design at lag 1, how often each replicate draws them, and the weighted fit per season.
_BOOT = ctes("tests") + f""", nn AS (SELECT max(t) - min(t) AS n, min(t) + 1 AS t0 FROM sc), dr AS (SELECT r, start + o AS pos, count(*) AS w FROM (SELECT r, k, (r * 7919 + k * 104729) % greatest(1, n - 15) AS start, n FROM nn, range({REPLICATES}) a(r), range((n + 15) // 16) b(k)), range(16) c(o) WHERE k * 16 + o < n GROUP BY 1, 2),
bd AS (SELECT r, d.*, w FROM td d, nn JOIN dr ON true WHERE d.lag = 1 AND d.t = t0 + pos),
bm AS (SELECT *, syy - my * my * n AS cyy, scc - mc * mc * n AS ccc, szz - mz * mz * n AS czz, syc - my * mc * n AS cyc, syz - my * mz * n AS cyz, scz - mc * mz * n AS ccz FROM (SELECT r, source_region, target_region, source_var, target_var, regime, sum(w) AS n, sum(w * y) / sum(w) AS my, sum(w * c) / sum(w) AS mc, sum(w * z) / sum(w) AS mz,
  sum(w * y * y) AS syy, sum(w * c * c) AS scc, sum(w * z * z) AS szz, sum(w * y * c) AS syc, sum(w * y * z) AS syz, sum(w * c * z) AS scz FROM bd GROUP BY ALL)),
bf AS MATERIALIZED (SELECT *, zy / zss AS effect, zy / zss / sqrt((rss - zy * zy / zss) / (n - 3) / zss) AS t FROM (SELECT *, czz - ccz * ccz / ccc AS zss, cyz - ccz * cyc / ccc AS zy, cyy - cyc * cyc / ccc AS rss FROM bm))"""


def refits(spark, sf_dir) -> DataFrame:
    """All candidates refitted on every replicate at lag 1. Stored once."""
    make = lambda: screen.resampled(station_candidates(spark, sf_dir), station_series(spark, sf_dir), 1, REPLICATES)
    return stored(spark, "refits", sources(sf_dir, "lineitem", "supplier"), make, replicates=REPLICATES)


@query(_BOOT + f""", bp AS (SELECT *, round({t_tail_sql("t", "(n - 3)")}, 9) AS p FROM bf), br AS (SELECT *, row_number() OVER (PARTITION BY r, regime ORDER BY p) AS k, count(*) OVER (PARTITION BY r, regime) AS m FROM bp), bq AS (SELECT *, least(1, min(p * m / k) OVER (PARTITION BY r, regime ORDER BY k DESC)) AS q FROM br)
 SELECT source_region, target_region, source_var, target_var, regime, count(*) AS replicates, round(avg(CASE WHEN p < 0.05 THEN 1.0 ELSE 0.0 END), 8) AS stability, round(avg(CASE WHEN q < 0.2 THEN 1.0 ELSE 0.0 END), 8) AS stability_q FROM bq GROUP BY 1, 2, 3, 4, 5""")
def edge_stability(spark, sf_dir):
    """Share of the replicates in which a refitted edge is significant, by its p and by the q of its replicate and season."""
    key = ["source_region", "target_region", "source_var", "target_var", "regime"]
    r = bh_large(refits(spark, sf_dir).withColumn("p", F.round("p_value", 9)), ["replicate", "regime"], "p", "q")
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 8)
    return r.groupBy(*key).agg(F.count("*").alias("replicates"), share(F.col("p") < 0.05).alias("stability"), share(F.col("q") < 0.2).alias("stability_q"))


@query(_BOOT + " SELECT source_region, target_region, source_var, target_var, regime, round(avg(effect), 7) AS mean, round(quantile_cont(effect, 0.025), 7) AS low, round(quantile_cont(effect, 0.975), 7) AS high FROM bf GROUP BY 1, 2, 3, 4, 5")
def bootstrap_intervals(spark, sf_dir):
    """Percentile interval of each slope over blocks of the calendar design, the season applied to the rows drawn."""
    q = F.percentile("effect", F.array(F.lit(0.025), F.lit(0.975)))
    g = refits(spark, sf_dir).groupBy("source_region", "target_region", "source_var", "target_var", "regime").agg(F.round(F.avg("effect"), 7).alias("mean"), q.alias("q"))
    return g.select("*", F.round(F.col("q")[0], 7).alias("low"), F.round(F.col("q")[1], 7).alias("high")).drop("q")


@query(_BOOT + f""", bs AS (SELECT source_region, target_region, source_var || '->' || target_var AS edge_type, regime, avg(CASE WHEN round({t_tail_sql("t", "(n - 3)")}, 9) < 0.05 THEN 1.0 ELSE 0.0 END) AS s FROM bf GROUP BY 1, 2, 3, 4)
 SELECT edge_type, regime, count(*) AS n, round(avg(s), 8) AS mean_stability, count(*) FILTER (s >= 0.5) AS stable FROM bs GROUP BY 1, 2""")
def stability_summary(spark, sf_dir):
    s = refits(spark, sf_dir).groupBy("source_region", "target_region", F.concat_ws("->", "source_var", "target_var").alias("edge_type"), "regime").agg(F.avg(F.when(F.round("p_value", 9) < 0.05, 1.0).otherwise(0.0)).alias("s"))
    return s.groupBy("edge_type", "regime").agg(F.count("*").alias("n"), F.round(F.avg("s"), 8).alias("mean_stability"), F.count_if(F.col("s") >= 0.5).alias("stable"))


# ---- losses of two models
_LOSS = """d AS (SELECT CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS t, avg(pow(26 + 40 * (l_discount - 0.05) - l_quantity, 2) - pow(l_extendedprice / 1600 - l_quantity, 2)) AS x FROM lineitem GROUP BY 1), s AS MATERIALIZED (SELECT t, x, CASE WHEN t < 1200 THEN 'a' ELSE 'b' END AS segment FROM d)"""


def daily_gain(spark, sf_dir) -> DataFrame:
    """t, x: mean gain of the price model over the discount model by day."""
    p = predictions(spark, sf_dir)
    e = F.pow(F.col("prediction") - F.col("actual"), 2)
    return p.groupBy(day_number(F.col("day")).cast("long").alias("t")).agg(F.sum(F.when(F.col("model") == "discount", e).otherwise(-e)).alias("s"), F.count_if(F.col("model") == "price").alias("n")).select("t", (F.col("s") / F.col("n")).alias("x"))


@query("WITH " + _LOSS + """, i AS (SELECT *, t - row_number() OVER (PARTITION BY segment ORDER BY t) AS island FROM s), e AS (SELECT segment, t, row_number() OVER (PARTITION BY segment ORDER BY t) - 1 AS pos FROM (SELECT segment, t, max(t) OVER (PARTITION BY segment, island) AS last FROM i) WHERE t + 29 <= last), c AS (SELECT s.segment, count(*) AS n, (SELECT count(*) FROM e WHERE e.segment = s.segment) AS starts FROM s GROUP BY 1),
 dr AS (SELECT segment, r, (r * 7919 + k * 104729) % starts AS pos FROM c, range(40) a(r), range(1000) b(k) WHERE k < (n + 29) // 30 AND starts > 0), m AS (SELECT dr.segment, r, avg(x) AS m FROM dr JOIN e ON e.segment = dr.segment AND e.pos = dr.pos JOIN s ON s.segment = dr.segment AND s.t BETWEEN e.t AND e.t + 29 GROUP BY 1, 2)
 SELECT segment, count(*) AS replicates, round((SELECT avg(x) FROM s WHERE s.segment = m.segment), 6) AS gain, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m GROUP BY 1""")
def paired_loss_bootstrap(spark, sf_dir):
    """Interval of the gain by blocks of 30 days that lie whole inside one segment, so no block crosses a seam or a gap."""
    s = daily_gain(spark, sf_dir).withColumn("segment", F.when(F.col("t") < 1200, "a").otherwise("b"))
    w = Window.partitionBy("segment").orderBy("t")  # one row per day
    i = s.withColumn("island", F.col("t") - F.row_number().over(w))
    e = i.withColumn("last", F.max("t").over(Window.partitionBy("segment", "island"))).filter("t + 29 <= last").select("segment", "t", (F.row_number().over(w) - 1).alias("pos"))
    c = s.groupBy("segment").agg(F.count("*").alias("n"), F.avg("x").alias("gain")).join(e.groupBy("segment").agg(F.count("*").alias("starts")).hint("shuffle_merge"), "segment")
    dr = c.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(39)))).withColumn("k", F.explode(F.sequence(F.lit(0), (F.floor((F.col("n") + 29) / 30) - 1).cast("int"))))
    dr = dr.select("segment", "r", "gain", ((F.col("r") * 7919 + F.col("k") * 104729) % F.col("starts")).cast("int").alias("pos"))
    days = dr.join(e.hint("shuffle_merge"), ["segment", "pos"]).select("segment", "r", "gain", F.explode(F.sequence(F.col("t"), F.col("t") + 29)).alias("t"))
    m = days.join(s.select("segment", "t", "x").hint("shuffle_merge"), ["segment", "t"]).groupBy("segment", "gain", "r").agg(F.avg("x").alias("m"))
    q = F.percentile("m", F.array(F.lit(0.025), F.lit(0.975)))
    return m.groupBy("segment", "gain").agg(F.count("*").alias("replicates"), q.alias("q")).select("segment", "replicates", F.round("gain", 6).alias("gain"), F.round(F.col("q")[0], 6).alias("low"), F.round(F.col("q")[1], 6).alias("high"))


@query("WITH " + _LOSS + """, o AS (SELECT x, row_number() OVER (ORDER BY t) - 1 AS pos, count(*) OVER () AS n FROM s), dr AS (SELECT r, ((r * 7919 + k * 104729) % n + o) % n AS pos FROM (SELECT max(n) AS n FROM o), range(40) a(r), range(1000) b(k), range(30) c(o) WHERE k * 30 + o < n), m AS (SELECT r, avg(x) AS m FROM dr JOIN o USING (pos) GROUP BY 1)
 SELECT count(*) AS replicates, round((SELECT avg(x) FROM s), 6) AS gain, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, round(least(1, 2 * least((1 + count(*) FILTER (m <= 0)) / 41.0, (1 + count(*) FILTER (m >= 0)) / 41.0)), 8) AS p FROM m""")
def circular_block_bootstrap(spark, sf_dir):
    """Interval of the daily gain by circular blocks of 30 days."""
    s = daily_gain(spark, sf_dir)
    o = s.withColumn("pos", F.row_number().over(Window.orderBy("t")) - 1)  # one row per day of the calendar
    n = s.agg(F.count("*").alias("n"), F.avg("x").alias("gain"))
    dr = n.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(39)))).withColumn("k", F.explode(F.sequence(F.lit(0), (F.floor((F.col("n") + 29) / 30) - 1).cast("int")))).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(29)))).filter("k * 30 + o < n")
    dr = dr.select("r", "gain", (((F.col("r") * 7919 + F.col("k") * 104729) % F.col("n") + F.col("o")) % F.col("n")).cast("int").alias("pos"))
    m = dr.join(o.select("pos", "x").hint("shuffle_merge"), "pos").groupBy("r", "gain").agg(F.avg("x").alias("m"))
    q = F.percentile("m", F.array(F.lit(0.025), F.lit(0.975)))
    low, high = (1 + F.count_if(F.col("m") <= 0)) / 41.0, (1 + F.count_if(F.col("m") >= 0)) / 41.0
    g = m.groupBy("gain").agg(F.count("*").alias("replicates"), q.alias("q"), F.round(F.least(F.lit(1.0), 2 * F.least(low, high)), 8).alias("p"))
    return g.select("replicates", F.round("gain", 6).alias("gain"), F.round(F.col("q")[0], 6).alias("low"), F.round(F.col("q")[1], 6).alias("high"), "p")


@query(ctes("panel") + """, n AS (SELECT max(t) + 1 AS n FROM panel), j AS (SELECT a.node AS source, b.node AS target, r, corr(a.wind, b.humidity) AS c FROM panel b, n, range(4) k(r) JOIN panel a ON a.t = CASE WHEN r = 0 THEN b.t - 1 ELSE ((b.t - 1) * 104729 + r * 7919) % n END GROUP BY 1, 2, 3)
 SELECT r AS shuffle, count(*) AS pairs, round(avg(abs(c)), 8) AS strength, round(max(abs(c)), 8) AS strongest FROM j GROUP BY 1""")
def time_shuffle_control(spark, sf_dir):
    """Lag-1 correlations with the source's calendar as it is (0) and shuffled one step for another (1 to 3)."""
    p = panel(spark, sf_dir)
    n = p.agg((F.max("t") + 1).alias("n"))
    b = p.select("t", F.col("node").alias("target"), F.col("humidity").alias("y")).crossJoin(F.broadcast(n)).withColumn("shuffle", F.explode(F.array(*[F.lit(r).cast("long") for r in range(4)])))  # one row
    b = b.withColumn("t", F.when(F.col("shuffle") == 0, F.col("t") - 1).otherwise(((F.col("t") - 1) * 104729 + F.col("shuffle") * 7919) % F.col("n")))
    j = b.join(p.select("t", F.col("node").alias("source"), F.col("wind").alias("x")).hint("shuffle_merge"), "t")
    c = j.groupBy("shuffle", "source", "target").agg((F.covar_pop("x", "y") / (F.stddev_pop("x") * F.stddev_pop("y"))).alias("c"))
    return c.groupBy("shuffle").agg(F.count("*").alias("pairs"), F.round(F.avg(F.abs("c")), 8).alias("strength"), F.round(F.max(F.abs("c")), 8).alias("strongest"))



@query(ctes("tests") + """, m AS (SELECT t, avg(v) AS v FROM sc WHERE variable = 'humidity' GROUP BY 1), hs AS (SELECT t, v >= (SELECT quantile_cont(v, 0.8) FROM m) AS high FROM m), od AS (SELECT target_region AS node, d.t, y, z, high FROM td d JOIN hs USING (t) WHERE lag = 1 AND source_region = target_region AND source_var = 'wind' AND target_var = 'humidity'),
 ob AS (SELECT node, regr_slope(y, z) AS slope, count(*) AS k FROM od WHERE high GROUP BY 1), rk AS (SELECT node, r, y, z, row_number() OVER (PARTITION BY node, r ORDER BY (t * 7349 + r * 4591) % 10007, t) AS k, count(*) OVER (PARTITION BY node, r) AS n FROM od, range(1, 21) a(r) WHERE NOT high),
 rf AS (SELECT rk.node, r, sum(w * z) AS sz, sum(w) AS sw, sum(w * y) AS sy, sum(w * y * z) AS syz, sum(w * z * z) AS szz FROM (SELECT rk.*, (ob.k - rk.k) // n + 1 AS w FROM rk JOIN ob USING (node) WHERE rk.k <= ob.k) rk GROUP BY 1, 2), sl AS (SELECT node, r, (syz - sy * sz / sw) / (szz - sz * sz / sw) AS slope FROM rf), c AS (SELECT *, avg(slope) OVER (PARTITION BY node) AS m FROM sl)
 SELECT node, round(any_value(ob.slope), 7) AS observed, round(any_value(m), 7) AS mean, round(least(1, (1 + count(*) FILTER (abs(c.slope - m) >= abs(ob.slope - m))) / 21.0), 8) AS p FROM c JOIN ob USING (node) GROUP BY 1""")
def matched_size_refit(spark, sf_dir):
    """Own wind to humidity slope of each station in the humid fifth of the steps, against refits on as many other steps (again from the first where these are short)."""
    b = station_bundles(spark, sf_dir)
    m = panels.step_means(b, "humidity").agg(F.percentile("v", 0.8).alias("q"), F.array_sort(F.collect_list(F.struct("t", "v"))).alias("s"))
    hs = m.select(F.transform("s", lambda x: x["v"] >= F.col("q")).alias("high"))
    fit = screen.matched_refits(b.crossJoin(F.broadcast(hs)), "wind", "humidity")  # one row
    own = stations(spark, sf_dir).select("node")
    return fit.join(own.hint("shuffle_merge"), "node", "left_semi").select("node", F.round("observed", 7).alias("observed"), F.round("mean", 7).alias("mean"), F.round("p", 8).alias("p"))


# ---- random and matched edges
@query(ctes("edges") + """, st AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS i, count(*) OVER () AS n FROM cells), k AS (SELECT count(*) AS k FROM edges WHERE p_value < 0.05), g AS (SELECT (i::HUGEINT * 1000003 + 7919) % (n::HUGEINT * n * 9) AS x, n FROM (SELECT max(n) AS n FROM st), k, range((SELECT k FROM k)) r(i) WHERE i < n * n * 9)
 SELECT a.node AS source_region, b.node AS target_region, (x // 3 % 3)::BIGINT AS pair, (x % 3 + 1)::BIGINT AS lag FROM g JOIN st a ON a.i = x // 9 // g.n JOIN st b ON b.i = x // 9 % g.n""")
def random_edges_all_keys(spark, sf_dir):
    """As many random edges as are significant, out of all ordered pairs of stations, variable pairs and lags, none twice.

    Draw i takes key number (i * prime + shift) modulo the number of keys, which hits
    each key once; the keys themselves are never listed. (A size divisible by the
    prime would repeat; it has more than a million stations.)
    """
    st = stations(spark, sf_dir).select("node").repartitionByRange(8, "node")
    st = number(st, "node")
    n = st.agg(F.count("*").alias("n"))
    k = edges(spark, sf_dir).filter("p_value < 0.05").agg(F.count("*").alias("k"))
    g = n.crossJoin(F.broadcast(k)).select("n", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("k"), F.col("n") * F.col("n") * 9) - 1)).alias("i")).repartition(8, "i")  # one row each
    x = (F.col("i").cast("decimal(38,0)") * 1000003 + 7919) % (F.col("n").cast("decimal(20,0)") * F.col("n") * 9)
    g = g.withColumn("x", x.cast("long"))
    g = g.select((F.floor(F.col("x") / 9 / F.col("n"))).cast("long").alias("ia"), F.expr("x div 9 % n").alias("ib"), F.expr("x div 3 % 3").alias("pair"), F.expr("x % 3 + 1").alias("lag"))
    side = lambda c, name: st.select(F.col("i").alias(c), F.col("node").alias(name))
    return g.join(side("ia", "source_region").hint("shuffle_merge"), "ia").join(side("ib", "target_region").hint("shuffle_merge"), "ib").select("source_region", "target_region", "pair", "lag")


def number(df: DataFrame, by: str) -> DataFrame:
    """Rows numbered from 0 in the order of ``by`` without a window over all: ranges are counted, then numbered inside."""
    parts = cut(df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), by).withColumn("_p", F.spark_partition_id()))
    size = parts.groupBy("_p").agg(F.count("*").alias("_c"))
    base = size.select("_p", (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_b"))  # one row per range
    out = parts.join(F.broadcast(base), "_p").withColumn("i", F.row_number().over(Window.partitionBy("_p").orderBy(by)) - 1 + F.col("_b"))
    return out.drop("_p", "_b")


@query(_REGIONS + " SELECT a.node AS source, b.node AS target, lag FROM cells a, cells b, range(1, 4) l(lag) WHERE a.node <> b.node")
def all_pair_lags(spark, sf_dir):
    """All ordered pairs of regions at lags 1 to 3; the number of regions is bounded."""
    r = regions(spark, sf_dir).select("node")
    pairs = r.select(F.col("node").alias("source")).crossJoin(F.broadcast(r.select(F.col("node").alias("target"))))  # 66 regions at most
    return pairs.filter("source <> target").withColumn("lag", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long"))))


_STRATA = ctes("edges") + f""", ed AS MATERIALIZED (SELECT e.*, (km >= 1e-8)::BIGINT + (km >= 1000)::BIGINT + (km >= 2000)::BIGINT + (km >= 3000)::BIGINT + (km >= 4000)::BIGINT + (km >= 6000)::BIGINT + (km >= 10000)::BIGINT AS s FROM (SELECT e.*, {HAV_SQL} AS km FROM edges e JOIN cells a ON a.node = source_region JOIN cells b ON b.node = target_region WHERE regime = 'winter') e),
ref AS (SELECT edge_type, s, count(*) FILTER (p_value < 0.2) AS k FROM ed GROUP BY 1, 2), dw AS MATERIALIZED (SELECT d.r, d.source_region, d.target_region, d.source_var, d.target_var, d.lag, d.edge_type, d.s, d.effect FROM (SELECT r, ed.*, row_number() OVER (PARTITION BY r, edge_type, s ORDER BY (source_region * 131 + target_region * 37 + lag * 17 + r * 53) % 1009, source_region, target_region, lag) AS k FROM ed, range(1, 21) x(r)) d JOIN ref USING (edge_type, s) WHERE d.k <= ref.k)"""


def _located_edges(spark, sf_dir) -> DataFrame:
    at = lambda c, n: stations(spark, sf_dir).select(F.col("node").alias(c), F.col("lat").alias("y" + n), F.col("lon").alias("x" + n))
    e = edges(spark, sf_dir).filter("regime = 'winter'").join(at("source_region", "a"), "source_region").join(at("target_region", "b"), "target_region")
    return e.withColumn("s", spatial.stratum(spatial.haversine(F.col("ya"), F.col("xa"), F.col("yb"), F.col("xb")))).drop("ya", "xa", "yb", "xb")


def null_draws(spark, sf_dir, replicates: int = 20) -> DataFrame:
    """Edges drawn from all tested ones, in each replicate as many per type and distance stratum as are significant."""
    e = _located_edges(spark, sf_dir)
    ref = e.groupBy("edge_type", "s").agg(F.count_if(F.col("p_value") < 0.2).alias("k"))
    draws = e.withColumn("r", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(replicates).cast("long"))))
    order = (F.col("source_region") * 131 + F.col("target_region") * 37 + F.col("lag") * 17 + F.col("r") * 53) % 1009
    return rank_by_ranges(draws, ["r", "edge_type", "s"], [order, "source_region", "target_region", "lag"]).join(ref.hint("shuffle_merge"), ["edge_type", "s"]).filter("rank <= k").drop("rank", "k")


@query(_STRATA + " SELECT r, edge_type, s AS stratum, count(*) AS n, round(avg(effect), 8) AS effect FROM dw GROUP BY 1, 2, 3")
def stratified_null_draws(spark, sf_dir):
    return null_draws(spark, sf_dir).groupBy("r", "edge_type", F.col("s").alias("stratum")).agg(F.count("*").alias("n"), F.round(F.avg("effect"), 8).alias("effect"))



@query(_STRATA + """, ob AS (SELECT * FROM ed WHERE p_value < 0.2), al AS (SELECT r, source_region, target_region, edge_type, effect FROM dw UNION ALL SELECT 0, source_region, target_region, edge_type, effect FROM ob),
 ch AS (SELECT r, count(*) AS chains FROM (SELECT DISTINCT x.r, x.source_region AS a, x.target_region AS m, y.target_region AS b FROM al x JOIN al y ON y.r = x.r AND y.source_region = x.target_region WHERE x.edge_type = 'wind->humidity' AND y.edge_type = 'humidity->cloud_cover') GROUP BY 1),
 mt AS (SELECT r, 'strength' AS metric, avg(abs(effect)) AS v FROM al GROUP BY 1 UNION ALL SELECT r, 'cross_region', count(*) FILTER (source_region <> target_region)::DOUBLE FROM al GROUP BY 1 UNION ALL SELECT r, 'chains', coalesce(chains, 0)::DOUBLE FROM (SELECT DISTINCT r FROM al) LEFT JOIN ch USING (r))
 SELECT metric, round(max(v) FILTER (r = 0), 8) AS observed, round(avg(v) FILTER (r > 0), 8) AS null_mean, round(quantile_cont(v, 0.05) FILTER (r > 0), 8) AS null_q05, round(quantile_cont(v, 0.95) FILTER (r > 0), 8) AS null_q95, round((1 + count(*) FILTER (r > 0 AND v >= o)) / 21.0, 8) AS upper FROM (SELECT *, max(v) FILTER (r = 0) OVER (PARTITION BY metric) AS o FROM mt) GROUP BY 1""")
def candidate_null_enrichment(spark, sf_dir):
    """Graph metrics of the significant edges against graphs of the same counts by type and distance: mean, quantiles, upper-tail share."""
    cols = ["r", "source_region", "target_region", "source_var", "target_var", "lag", "edge_type", "effect", "p_value"]
    ob = edges(spark, sf_dir).filter("regime = 'winter' and p_value < 0.2").withColumn("r", F.lit(0).cast("long"))
    al = null_draws(spark, sf_dir).select(*cols).unionByName(ob.select(*cols))
    ch = reports.chains(al, ["r"]).select("r", "a_source_region", "mediator", "b_target_region").distinct().groupBy("r").agg(F.count("*").cast("double").alias("chains"))
    m = al.groupBy("r").agg(F.avg(F.abs("effect")).alias("strength"), F.count_if(F.col("source_region") != F.col("target_region")).cast("double").alias("cross_region"))
    m = m.join(ch.hint("shuffle_merge"), "r", "left").na.fill(0.0, ["chains"]).unpivot("r", ["strength", "cross_region", "chains"], "metric", "v")
    o = m.filter("r = 0").select("metric", F.col("v").alias("o"))
    q = F.percentile("v", F.array(F.lit(0.05), F.lit(0.95)))
    g = m.filter("r > 0").join(o.hint("shuffle_merge"), "metric").groupBy("metric", "o").agg(F.avg("v").alias("mean"), q.alias("q"), F.count_if(F.col("v") >= F.col("o")).alias("above"))
    return g.select("metric", F.round("o", 8).alias("observed"), F.round("mean", 8).alias("null_mean"), F.round(F.col("q")[0], 8).alias("null_q05"), F.round(F.col("q")[1], 8).alias("null_q95"), F.round((1 + F.col("above")) / 21.0, 8).alias("upper"))


@query(ctes("edges") + """, c AS (SELECT regime AS chain, lag AS metric, effect AS v, row_number() OVER (PARTITION BY regime, lag ORDER BY source_region, target_region, edge_type) AS d FROM edges), m AS (SELECT *, v - avg(v) OVER (PARTITION BY chain, metric) AS e FROM c), g AS (SELECT a.chain, a.metric, h, sum(a.e * b.e) AS g FROM m a, range(0, 20) k(h) JOIN m b ON b.chain = a.chain AND b.metric = a.metric AND b.d = a.d + h GROUP BY 1, 2, 3),
 r AS (SELECT x.chain, x.metric, x.h, x.g / z.g AS rho FROM g x JOIN g z ON z.chain = x.chain AND z.metric = x.metric AND z.h = 0), p AS (SELECT chain, metric, h // 2 AS k, sum(rho) AS s FROM r GROUP BY 1, 2, 3), f AS (SELECT *, min(s) OVER (PARTITION BY chain, metric ORDER BY k) AS low FROM p), t AS (SELECT chain, metric, sum(greatest(low, 0)) AS total FROM f GROUP BY 1, 2), n AS (SELECT chain, metric, count(*) AS n, avg(CASE WHEN abs(e) > 2 * sd THEN 1.0 ELSE 0.0 END) AS tail FROM (SELECT *, stddev_pop(v) OVER (PARTITION BY chain, metric) AS sd FROM m) GROUP BY 1, 2)
 SELECT chain, metric, n, round(rho, 8) AS autocorrelation, round(least(n, n / (2 * total - 1)), 5) AS ess, round(tail, 8) AS tail FROM n JOIN t USING (chain, metric) JOIN (SELECT chain, metric, rho FROM r WHERE h = 1) USING (chain, metric)""")
def chain_diagnostics(spark, sf_dir):
    """First autocorrelation, effective size by initial monotone positive pairs, and share of far values of each chain."""
    by = ["chain", "metric"]
    c = rank_by_ranges(edges(spark, sf_dir), ["regime", "lag"], ["source_region", "target_region", "edge_type"], "d")
    m = c.select(F.col("regime").alias("chain"), F.col("lag").alias("metric"), "d", F.col("effect").alias("v")).withColumn("e", F.col("v") - F.avg("v").over(Window.partitionBy(*by)))
    a = m.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(19)))).select(*by, "h", (F.col("d") + F.col("h")).alias("d"), F.col("e").alias("x"))
    g = a.join(m.select(*by, "d", "e").hint("shuffle_merge"), [*by, "d"]).groupBy(*by, "h").agg(F.sum(F.col("x") * F.col("e")).alias("g"))
    r = g.withColumn("rho", F.col("g") / F.max(F.when(F.col("h") == 0, F.col("g"))).over(Window.partitionBy(*by)))  # 20 rows per chain
    p = r.groupBy(*by, F.floor(F.col("h") / 2).alias("k")).agg(F.sum("rho").alias("s")).withColumn("low", F.min("s").over(Window.partitionBy(*by).orderBy("k")))
    t = p.groupBy(*by).agg(F.sum(F.greatest("low", F.lit(0.0))).alias("total"))
    n = m.withColumn("sd", F.stddev_pop("v").over(Window.partitionBy(*by))).groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.when(F.abs("e") > 2 * F.col("sd"), 1.0).otherwise(0.0)).alias("tail"))
    j = n.join(t.hint("shuffle_merge"), by).join(r.filter("h = 1").select(*by, "rho").hint("shuffle_merge"), by)
    return j.select(*by, "n", F.round("rho", 8).alias("autocorrelation"), F.round(F.least(F.col("n"), F.col("n") / (2 * F.col("total") - 1)), 5).alias("ess"), F.round("tail", 8).alias("tail"))
