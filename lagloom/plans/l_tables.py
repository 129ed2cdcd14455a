"""Tables of comparisons: robustness, routes, replicates, calibration, consistency, effects."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from lagloom.operators import gram, spatial
from lagloom.operators.reports import KEY
from lagloom.plans import section
from lagloom.plans.m_verify import class_predictions, predictions
from lagloom.sources.fixtures import HAV_SQL, ctes, edges, panel_orders, panel_ship, stations, table

QUERIES, query = section()
_W = ctes("edges")
_K = ", ".join(KEY)
_HAV = HAV_SQL


@query("WITH x AS (SELECT l_returnflag AS g, l_quantity AS z, l_extendedprice / 1000 AS y FROM lineitem), m AS (SELECT g, count(*) AS n, avg(z) AS mz, avg(y) AS my, var_pop(z) * count(*) AS szz, covar_pop(y, z) / var_pop(z) AS b FROM x GROUP BY 1) SELECT g, any_value(n) AS n, round(any_value(b), 8) AS slope, round(sqrt(sum(pow(z - mz, 2) * pow((y - my - b * (z - mz)) / (1 - 1.0 / n - pow(z - mz, 2) / szz), 2))) / any_value(szz), 10) AS se_hc3 FROM x JOIN m USING (g) GROUP BY 1")
def hc3_slopes(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_quantity").alias("z"), (F.col("l_extendedprice") / 1000).alias("y"))
    f = gram.fit(x, ["g"], [])
    c = F.col("z") - F.col("gz")[0]
    e = F.col("y") - F.col("gy")[0] - F.col("beta") * c
    v = F.sum(F.pow(c * e / (1 - 1.0 / F.col("n") - c * c / F.col("zss")), 2))
    j = x.join(F.broadcast(f.select("g", "n", "beta", "zss", "gz", "gy")), "g")  # one row per group
    return j.groupBy("g").agg(F.first("n").alias("n"), F.round(F.first("beta"), 8).alias("slope"), F.round(F.sqrt(v) / F.first("zss"), 10).alias("se_hc3"))


@query(_W + f" SELECT regime, {_K} FROM edges ORDER BY (source_region * 7919 + target_region * 104729 + lag * 1299709 + length(regime) * 15485863) % 1000003, regime, {_K} LIMIT 100")
def random_edges(spark, sf_dir):
    order = (F.col("source_region") * 7919 + F.col("target_region") * 104729 + F.col("lag") * 1299709 + F.length("regime") * 15485863) % 1000003
    return edges(spark, sf_dir).orderBy(order, "regime", *KEY).limit(100).select("regime", *KEY)


@query(_W + f", s AS (SELECT {_K}, edge_type, row_number() OVER (PARTITION BY edge_type ORDER BY {_K}) AS r FROM edges WHERE regime = 'winter' AND p_value < 0.1), p AS (SELECT edge_type, source_region AS rs, target_region AS rt, row_number() OVER (PARTITION BY edge_type ORDER BY (source_region * 31 + target_region * 17) % 101, source_region, target_region) AS r FROM edges WHERE regime = 'winter' AND lag = 1 AND source_region <> target_region) SELECT {_K}, rs, rt FROM s JOIN p USING (edge_type, r) WHERE NOT (source_region = rs AND target_region = rt)")
def variable_preserving_edges(spark, sf_dir):
    e = edges(spark, sf_dir).filter("regime = 'winter'")
    by = Window.partitionBy("edge_type")
    s = e.filter("p_value < 0.1").withColumn("r", F.row_number().over(by.orderBy(*KEY)))
    order = (F.col("source_region") * 31 + F.col("target_region") * 17) % 101
    p = e.filter("lag = 1 and source_region <> target_region").withColumn("r", F.row_number().over(by.orderBy(order, "source_region", "target_region")))
    p = p.select("edge_type", "r", F.col("source_region").alias("rs"), F.col("target_region").alias("rt"))
    return s.join(p, ["edge_type", "r"]).filter("not (source_region = rs and target_region = rt)").select(*KEY, "rs", "rt")


_NN = f"nn AS (SELECT k.k, source, target FROM (SELECT a.node AS source, b.node AS target, row_number() OVER (PARTITION BY b.node ORDER BY {_HAV}, a.node) AS r FROM cells a, cells b WHERE a.node <> b.node), (VALUES (2), (4), (6)) k(k) WHERE r <= k.k)"


@query(ctes("stations") + f", {_NN}, base AS (SELECT source, target FROM nn WHERE k = 2) SELECT k, count(*) AS n, count(*) FILTER ((source, target) IN (SELECT source, target FROM base)) AS recovered, count(*) FILTER ((source, target) NOT IN (SELECT source, target FROM base)) AS fresh FROM nn GROUP BY 1")
def neighbour_robustness(spark, sf_dir):
    r = spatial.nearest(stations(spark, sf_dir), 6).select("source", "target", "rank")
    nn = r.withColumn("k", F.explode(F.array(F.lit(2), F.lit(4), F.lit(6)))).filter("rank <= k")
    return nn.groupBy("k").agg(F.count("*").alias("n"), F.count_if(F.col("rank") <= 2).alias("recovered"), F.count_if(F.col("rank") > 2).alias("fresh"))


@query(ctes("stations") + f", {_NN} SELECT source, target, string_agg(k::VARCHAR, ',' ORDER BY k) AS ks, count(*) = 3 AS stable FROM nn GROUP BY 1, 2")
def stable_neighbours(spark, sf_dir):
    r = spatial.nearest(stations(spark, sf_dir), 6).select("source", "target", "rank").withColumn("k", F.explode(F.array(F.lit(2), F.lit(4), F.lit(6)))).filter("rank <= k")
    g = r.groupBy("source", "target").agg(F.array_sort(F.collect_set("k")).alias("s"))
    return g.select("source", "target", F.array_join(F.col("s").cast("array<string>"), ",").alias("ks"), (F.size("s") == 3).alias("stable"))


@query(_W + " SELECT least(source_region, target_region) AS a, greatest(source_region, target_region) AS b, round(avg(effect) FILTER (regime = 'winter'), 8) AS winter, round(avg(effect) FILTER (regime = 'summer'), 8) AS summer FROM edges GROUP BY 1, 2")
def direction_pivot(spark, sf_dir):
    e = edges(spark, sf_dir).withColumn("a", F.least("source_region", "target_region")).withColumn("b", F.greatest("source_region", "target_region"))
    p = e.groupBy("a", "b").pivot("regime", ["winter", "summer"]).agg(F.avg("effect"))
    return p.select("a", "b", F.round("winter", 8).alias("winter"), F.round("summer", 8).alias("summer"))


@query(_W + f", o AS (SELECT source_region, target_region, edge_type, regime, effect AS a FROM edges WHERE lag = 1), t AS (SELECT source_region, target_region, edge_type, regime, effect AS b FROM edges WHERE lag = 3) SELECT coalesce(edge_type, 'ALL') AS edge_type, count(*) AS n, round(avg(a * a - b * b), 8) AS improvement, round(avg(CASE WHEN sign(a) = sign(b) THEN 1.0 ELSE 0.0 END), 8) AS concordance FROM o JOIN t USING (source_region, target_region, edge_type, regime) GROUP BY ROLLUP (edge_type)")
def history_comparison(spark, sf_dir):
    k = ["source_region", "target_region", "edge_type", "regime"]
    e = edges(spark, sf_dir)
    j = e.filter("lag = 1").select(*k, F.col("effect").alias("a")).join(e.filter("lag = 3").select(*k, F.col("effect").alias("b")), k)
    same = F.when(F.signum("a") == F.signum("b"), 1.0).otherwise(0.0)
    g = j.rollup("edge_type").agg(F.count("*").alias("n"), F.round(F.avg(F.col("a") * F.col("a") - F.col("b") * F.col("b")), 8).alias("improvement"), F.round(F.avg(same), 8).alias("concordance"))
    return g.withColumn("edge_type", F.coalesce("edge_type", F.lit("ALL")))


@query(_W + ", r AS (SELECT (source_region + target_region) % 7 AS replicate, regime AS method, avg(effect) AS m FROM edges GROUP BY 1, 2), d AS (SELECT a.replicate, a.m - b.m AS d FROM r a JOIN r b USING (replicate) WHERE a.method = 'winter' AND b.method = 'summer') SELECT count(*) AS replicates, round(avg(d), 9) AS difference, round(stddev_samp(d) / sqrt(count(*)), 9) AS se FROM d")
def replicate_differences(spark, sf_dir):
    r = edges(spark, sf_dir).groupBy(((F.col("source_region") + F.col("target_region")) % 7).alias("replicate")).pivot("regime", ["winter", "summer"]).agg(F.avg("effect"))
    d = r.select((F.col("winter") - F.col("summer")).alias("d"))
    return d.agg(F.count("*").alias("replicates"), F.round(F.avg("d"), 9).alias("difference"), F.round(F.stddev_samp("d") / F.sqrt(F.count("*")), 9).alias("se"))


@query(ctes("panel_ship") + ", s AS (SELECT flag, (t // 30) % 2 AS truth, CASE WHEN qty % 2 < 1 THEN 1 ELSE 0 END AS state FROM panel_ship), a AS (SELECT flag, avg((truth = state)::INT) AS same FROM s GROUP BY 1) SELECT flag, round(greatest(same, 1 - same), 8) AS agreement, same < 0.5 AS swapped FROM a")
def state_alignment(spark, sf_dir):
    s = panel_ship(spark, sf_dir).select("flag", (F.floor(F.col("t") / 30) % 2).alias("truth"), F.when(F.col("qty") % 2 < 1, 1).otherwise(0).alias("state"))
    a = s.groupBy("flag").agg(F.avg((F.col("truth") == F.col("state")).cast("int")).alias("same"))
    return a.select("flag", F.round(F.greatest("same", 1 - F.col("same")), 8).alias("agreement"), (F.col("same") < 0.5).alias("swapped"))


@query(_W + f", sig AS (SELECT * FROM edges WHERE p_value < 0.2), pub AS (SELECT source_region, target_region, count(*) + CASE WHEN source_region = 3 THEN 1 ELSE 0 END AS n FROM sig GROUP BY 1, 2), re AS (SELECT source_region, target_region, count(*) AS n FROM sig GROUP BY 1, 2) SELECT count(*) AS pairs, count(*) FILTER (pub.n = re.n) AS agree, count(*) FILTER (pub.n <> re.n) AS differ FROM pub JOIN re USING (source_region, target_region)")
def published_table_check(spark, sf_dir):
    g = edges(spark, sf_dir).filter("p_value < 0.2").groupBy("source_region", "target_region").agg(F.count("*").alias("n"))
    pub = g.withColumn("p", F.col("n") + F.when(F.col("source_region") == 3, 1).otherwise(0)).drop("n")
    j = g.join(pub, ["source_region", "target_region"])
    return j.agg(F.count("*").alias("pairs"), F.count_if(F.col("p") == F.col("n")).alias("agree"), F.count_if(F.col("p") != F.col("n")).alias("differ"))


@query(_W + ", s AS (SELECT edge_type, regime, count(*) AS tested, count(*) FILTER (p_value < 0.2) AS sig, quantile_cont(effect, 0.5) AS slope, quantile_cont(effect, 0.025) AS low, quantile_cont(effect, 0.975) AS high FROM edges GROUP BY 1, 2) SELECT edge_type, regime, round(sig / tested::DOUBLE, 8) AS rate, round(slope, 8) AS slope, round(low, 8) AS low, round(high, 8) AS high FROM s")
def contrast_rates(spark, sf_dir):
    q = F.percentile("effect", F.array(F.lit(0.5), F.lit(0.025), F.lit(0.975)))
    g = edges(spark, sf_dir).groupBy("edge_type", "regime").agg((F.count_if(F.col("p_value") < 0.2) / F.count("*")).alias("rate"), q.alias("q"))
    return g.select("edge_type", "regime", F.round("rate", 8).alias("rate"), *[F.round(F.col("q")[i], 8).alias(n) for i, n in enumerate(("slope", "low", "high"))])


_CLS = """cls AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS label, 1.0 + o_orderkey % 7 AS a, 1.0 + o_custkey % 5 AS b, 1.0 + o_orderkey % 3 AS c FROM orders), pr AS (SELECT o_orderkey, label, [a / (a + b + c), b / (a + b + c), c / (a + b + c)] AS p FROM cls)"""


@query(f"WITH {_CLS}, x AS (SELECT k::INT AS k, p[k + 1] AS p, (label = k)::INT AS o FROM pr, range(3) z(k)) SELECT k, least(floor(p * 10 + 1e-9), 9)::BIGINT AS bin, count(*) AS n, round(avg(p), 8) AS predicted, round(avg(o), 8) AS observed FROM x GROUP BY 1, 2")
def reliability_bins(spark, sf_dir):
    x = class_predictions(spark, sf_dir).select("label", F.posexplode("p").alias("k", "p")).withColumn("o", F.when(F.col("label") == F.col("k"), 1.0).otherwise(0.0))
    return x.groupBy("k", F.least(F.floor(F.col("p") * 10 + 1e-9), F.lit(9)).cast("long").alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("p"), 8).alias("predicted"), F.round(F.avg("o"), 8).alias("observed"))


_PRED = """pred AS (SELECT l_orderkey, l_linenumber, l_returnflag AS region, l_shipdate, year(l_shipdate) AS y, l_quantity AS actual, m.model,
 CASE m.model WHEN 'price' THEN l_extendedprice / 1600 ELSE 26 + 40 * (l_discount - 0.05) END AS prediction FROM lineitem, (VALUES ('price'), ('discount')) m(model))"""


@query(f"WITH {_PRED}, r AS (SELECT y, model, avg(pow(prediction - actual, 2)) AS mse FROM pred GROUP BY 1, 2) SELECT a.y, round(100 * (1 - a.mse / b.mse), 6) AS reduction FROM r a JOIN r b ON a.y = b.y AND a.model = 'price' AND b.model = 'discount'")
def error_reduction(spark, sf_dir):
    e = F.col("prediction") - F.col("actual")
    r = predictions(spark, sf_dir).groupBy("y").pivot("model", ["price", "discount"]).agg(F.avg(e * e))
    return r.select("y", F.round(100 * (1 - F.col("price") / F.col("discount")), 6).alias("reduction"))


@query(f"WITH {_PRED}, m AS (SELECT region, model, y, avg(prediction - actual) AS b FROM pred GROUP BY 1, 2, 3) SELECT region, model, count(*) AS replicates, round(avg(b), 7) AS mean, round(stddev_samp(b), 7) AS sd, round(sqrt(avg(b * b)), 7) AS rmse FROM m GROUP BY 1, 2")
def replicate_summary(spark, sf_dir):
    m = predictions(spark, sf_dir).groupBy("region", "model", "y").agg(F.avg(F.col("prediction") - F.col("actual")).alias("b"))
    return m.groupBy("region", "model").agg(F.count("*").alias("replicates"), F.round(F.avg("b"), 7).alias("mean"), F.round(F.stddev_samp("b"), 7).alias("sd"), F.round(F.sqrt(F.avg(F.col("b") * F.col("b"))), 7).alias("rmse"))


@query(ctes("panel_ship", "panel_orders") + ", o AS (SELECT ts, avg(price) AS price FROM panel_orders GROUP BY 1), s AS (SELECT CAST(date_trunc('month', ts) AS DATE) AS ts, flag, avg(price) AS price FROM panel_ship GROUP BY 1, 2) SELECT flag, count(*) AS n, round(corr(s.price, o.price), 7) AS r, round(avg(s.price - o.price / 5), 4) AS bias FROM s JOIN o USING (ts) GROUP BY 1")
def cross_product_check(spark, sf_dir):
    o = panel_orders(spark, sf_dir).groupBy("ts").agg(F.avg("price").alias("y"))
    s = panel_ship(spark, sf_dir).groupBy(F.trunc("ts", "month").alias("ts"), "flag").agg(F.avg("price").alias("x"))
    r = F.covar_pop("x", "y") / (F.stddev_pop("x") * F.stddev_pop("y"))
    return s.join(o, "ts").groupBy("flag").agg(F.count("*").alias("n"), F.round(r, 7).alias("r"), F.round(F.avg(F.col("x") - F.col("y") / 5), 4).alias("bias"))


@query("WITH n AS (SELECT l_partkey % 12 AS cell, month(l_shipdate) AS m, avg(l_quantity) AS a FROM lineitem GROUP BY 1, 2), w AS (SELECT l_suppkey % 12 AS cell, month(l_shipdate) AS m, avg(l_quantity) AS b FROM lineitem GROUP BY 1, 2) SELECT m, count(*) AS cells, round(max(abs(a - b)), 7) AS worst, round(sqrt(avg(pow(a - b, 2))), 7) AS rmse FROM n JOIN w USING (cell, m) GROUP BY 1")
def route_comparison(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    by = lambda c, n: li.groupBy((F.col(c) % 12).alias("cell"), F.month("l_shipdate").alias("m")).agg(F.avg("l_quantity").alias(n))
    d = F.col("a") - F.col("b")
    return by("l_partkey", "a").join(by("l_suppkey", "b"), ["cell", "m"]).groupBy("m").agg(F.count("*").alias("cells"), F.round(F.max(F.abs(d)), 7).alias("worst"), F.round(F.sqrt(F.avg(d * d)), 7).alias("rmse"))


@query("SELECT l_linestatus AS source, count(*) AS n, round(avg(CASE WHEN l_extendedprice < 20000 THEN 1.0 ELSE 0.0 END), 8) AS below FROM lineitem GROUP BY 1")
def terrain_screen(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("source")).agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("l_extendedprice") < 20000, 1.0).otherwise(0.0)), 8).alias("below"))


@query(ctes("stations") + " SELECT node, round(6371.0 * 6371.0 * radians(14.4) * (sin(radians(least(lat + 3.5, 90))) - sin(radians(greatest(lat - 3.5, -90)))), 3) AS area, round(6371.0 * radians(7), 6) AS meridional_face, round(6371.0 * radians(14.4) * cos(radians(least(lat + 3.5, 90))), 6) AS northern_face FROM cells")
def grid_geometry(spark, sf_dir):
    r, lat = 6371.0, F.col("lat")
    north, south = F.radians(F.least(lat + 3.5, F.lit(90.0))), F.radians(F.greatest(lat - 3.5, F.lit(-90.0)))
    return stations(spark, sf_dir).select("node", F.round(r * r * math.radians(14.4) * (F.sin(north) - F.sin(south)), 3).alias("area"), F.round(F.lit(r * math.radians(7)), 6).alias("meridional_face"), F.round(r * math.radians(14.4) * F.cos(north), 6).alias("northern_face"))


@query("""WITH f AS (SELECT year(l_shipdate) AS t, CAST(l_partkey * 31 % 8 AS BIGINT) AS i, CAST(l_suppkey * 7 % 12 AS BIGINT) AS j, avg(l_quantity) AS qu FROM lineitem GROUP BY 1, 2, 3)
 SELECT c.t, c.j // 4 AS region, round(sum((c.qu + e.qu) / 2 * 6371.0 * radians(22.5)), 4) AS eastward_boundary_flux FROM f c JOIN f e ON e.t = c.t AND e.i = c.i AND e.j = (c.j + 1) % 12 WHERE c.j // 4 <> e.j // 4 GROUP BY 1, 2""")
def boundary_flux(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").alias("t"), (F.col("l_partkey") * 31 % 8).cast("long").alias("i"), (F.col("l_suppkey") * 7 % 12).cast("long").alias("j")).agg(F.avg("l_quantity").alias("qu"))
    e = f.select("t", "i", F.pmod(F.col("j") - 1, F.lit(12)).alias("j"), F.col("qu").alias("eu"))
    face = f.join(e, ["t", "i", "j"]).filter("floor(j / 4) <> floor((j + 1) % 12 / 4)")
    return face.groupBy("t", F.floor(F.col("j") / 4).alias("region")).agg(F.round(F.sum((F.col("qu") + F.col("eu")) / 2 * (6371.0 * math.radians(22.5))), 4).alias("eastward_boundary_flux"))


@query(_W + f", a AS (SELECT {_K}, edge_type, effect, p_value FROM edges WHERE regime = 'winter'), q AS (SELECT edge_type, quantile_cont(abs(effect), 0.75) AS q FROM a WHERE p_value < 0.3 GROUP BY 1), h AS (SELECT a.edge_type, CASE WHEN a.p_value >= 0.3 THEN 'unselected' WHEN abs(a.effect) >= q THEN 'strong' ELSE 'ordinary' END AS stratum, b.p_value < 0.3 AS sig, sign(a.effect) = sign(b.effect) AS same FROM a JOIN q USING (edge_type) JOIN edges b USING ({_K}) WHERE b.regime = 'summer') SELECT edge_type, stratum, count(*) AS n, count(*) FILTER (sig) AS significant, count(*) FILTER (sig AND same) AS same_sign FROM h GROUP BY 1, 2")
def heldout_strata(spark, sf_dir):
    e = edges(spark, sf_dir)
    a = e.filter("regime = 'winter'").select(*KEY, "edge_type", F.col("effect").alias("ea"), F.col("p_value").alias("pa"))
    q = a.filter("pa < 0.3").groupBy("edge_type").agg(F.percentile(F.abs("ea"), 0.75).alias("q"))
    b = e.filter("regime = 'summer'").select(*KEY, F.col("effect").alias("eb"), F.col("p_value").alias("pb"))
    stratum = F.when(F.col("pa") >= 0.3, "unselected").when(F.abs("ea") >= F.col("q"), "strong").otherwise("ordinary")
    sig, same = F.col("pb") < 0.3, F.signum("ea") == F.signum("eb")
    return a.join(F.broadcast(q), "edge_type").join(b, KEY).groupBy("edge_type", stratum.alias("stratum")).agg(F.count("*").alias("n"), F.count_if(sig).alias("significant"), F.count_if(sig & same).alias("same_sign"))
