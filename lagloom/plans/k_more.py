"""More staged reports, contrasts over space, forecasts by libraries and greedy matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagloom.operators import gram, reports, spatial
from lagloom.operators.reports import KEY
from lagloom.operators.ranks import mid_ranks
from lagloom.plans import section
from lagloom.sources.fixtures import HAV_SQL, ctes, edges, panel, panel_orders, panel_ship, stations, table

QUERIES, query = section()
_W = ctes("edges")
_K = ", ".join(KEY)
_WC = _W


@query(_WC + ", x AS (SELECT e.regime, e.edge_type, e.effect, c.lat / 10 AS x FROM edges e JOIN cells c ON c.node = e.target_region), m AS (SELECT regime, edge_type, avg(x) AS mx FROM x GROUP BY 1, 2) SELECT regime, edge_type, round(sum((x - mx) * effect) / sum((x - mx) * (x - mx)), 8) AS trend FROM x JOIN m USING (regime, edge_type) GROUP BY 1, 2")
def latitude_trend(spark, sf_dir):
    """Change of the effect per ten degrees, as a fixed linear contrast."""
    c = stations(spark, sf_dir).select(F.col("node").alias("target_region"), (F.col("lat") / 10).alias("x"))
    e = edges(spark, sf_dir).join(c, "target_region")
    w = Window.partitionBy("regime", "edge_type")
    e = e.withColumn("c", F.col("x") - F.avg("x").over(w))
    return e.groupBy("regime", "edge_type").agg(F.round(F.sum(F.col("c") * F.col("effect")) / F.sum(F.col("c") * F.col("c")), 8).alias("trend"))


@query(_WC + ", b AS (SELECT regime, edge_type, CASE WHEN abs(lat) < 23.5 THEN 'tropics' WHEN abs(lat) < 60 THEN 'midlatitude' ELSE 'polar' END AS band, avg(effect) AS m, count(*) AS n FROM edges JOIN cells ON node = target_region GROUP BY 1, 2, 3) SELECT h.regime, h.edge_type, h.band AS band, h.n, round(h.m - l.m, 8) AS minus_tropics FROM b h JOIN b l USING (regime, edge_type) WHERE l.band = 'tropics' AND h.band <> 'tropics'")
def band_differences(spark, sf_dir):
    c = stations(spark, sf_dir).select(F.col("node").alias("target_region"), spatial.band(F.col("lat")).alias("band"))
    b = edges(spark, sf_dir).join(c, "target_region").groupBy("regime", "edge_type", "band").agg(F.avg("effect").alias("m"), F.count("*").alias("n"))
    low = b.filter("band = 'tropics'").select("regime", "edge_type", F.col("m").alias("low"))
    return b.filter("band <> 'tropics'").join(low, ["regime", "edge_type"]).select("regime", "edge_type", "band", "n", F.round(F.col("m") - F.col("low"), 8).alias("minus_tropics"))


@query(_W + f", a AS (SELECT {_K}, edge_type, effect AS w FROM edges WHERE regime = 'winter'), b AS (SELECT {_K}, effect AS s FROM edges WHERE regime = 'summer') SELECT edge_type, count(*) AS n, round(avg(CASE WHEN sign(w) = sign(s) THEN 1.0 ELSE 0.0 END), 8) AS same_sign, round(corr(w, s), 8) AS pearson, round(quantile_cont(abs(w - s), 0.5), 8) AS median_change FROM a JOIN b USING ({_K}) GROUP BY 1")
def substitution_summary(spark, sf_dir):
    e = edges(spark, sf_dir)
    j = e.filter("regime = 'winter'").select(*KEY, "edge_type", F.col("effect").alias("w")).join(e.filter("regime = 'summer'").select(*KEY, F.col("effect").alias("s")), KEY)
    r = F.covar_pop("w", "s") / (F.stddev_pop("w") * F.stddev_pop("s"))
    return j.groupBy("edge_type").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.signum("w") == F.signum("s"), 1.0).otherwise(0.0)), 8).alias("same_sign"), F.round(r, 8).alias("pearson"), F.round(F.percentile(F.abs(F.col("w") - F.col("s")), 0.5), 8).alias("median_change"))


@query(_W + ", k AS (SELECT regime, edge_type, effect, p_value, rank() OVER (PARTITION BY regime, edge_type ORDER BY effect) + (count(*) OVER (PARTITION BY regime, edge_type, effect) - 1) / 2.0 AS a, rank() OVER (PARTITION BY regime, edge_type ORDER BY p_value) + (count(*) OVER (PARTITION BY regime, edge_type, p_value) - 1) / 2.0 AS b FROM edges) SELECT regime, edge_type, round(corr(a, b), 8) AS spearman FROM k GROUP BY 1, 2")
def spearman_ranks(spark, sf_dir):
    """Rank correlation of effect and p, from mid-ranks of distinct values with their counts."""
    by = ["regime", "edge_type"]
    e = edges(spark, sf_dir).select(*by, "effect", "p_value")
    for c, r in (("effect", "a"), ("p_value", "b")):
        e = e.join(mid_ranks(e, by, c, r).hint("shuffle_merge"), [*by, c])
    return e.groupBy(*by).agg(F.round(F.covar_pop("a", "b") / (F.stddev_pop("a") * F.stddev_pop("b")), 8).alias("spearman"))


@query(_W + ", t AS (SELECT edge_type, regime, count(*) AS tested, count(*) FILTER (p_value < 0.2) AS sig, quantile_cont(abs(effect), 0.5) AS m FROM edges GROUP BY 1, 2) SELECT edge_type, CASE WHEN bool_and(sig * 5 >= tested) THEN 'supported' WHEN bool_or(sig * 5 >= tested) THEN 'mixed' WHEN max(m) > 0.6 THEN 'strong but rare' ELSE 'unsupported' END AS verdict, sum(sig)::BIGINT AS significant FROM t GROUP BY 1")
def four_way_verdict(spark, sf_dir):
    t = edges(spark, sf_dir).groupBy("edge_type", "regime").agg(F.count("*").alias("tested"), F.count_if(F.col("p_value") < 0.2).alias("sig"), F.percentile(F.abs("effect"), 0.5).alias("m"))
    ok = F.col("sig") * 5 >= F.col("tested")
    verdict = F.when(F.bool_and(ok), "supported").when(F.bool_or(ok), "mixed").when(F.max("m") > 0.6, "strong but rare").otherwise("unsupported")
    return t.groupBy("edge_type").agg(verdict.alias("verdict"), F.sum("sig").alias("significant"))


@query(_W + f", sig AS (SELECT * FROM edges WHERE p_value < 0.2), ch AS (SELECT x.regime, x.source_region AS s, x.target_region AS m, y.target_region AS t, x.lag AS la, y.lag AS lb, abs(x.effect * y.effect) AS v FROM sig x JOIN sig y ON x.regime = y.regime AND x.target_region = y.source_region WHERE x.edge_type = 'wind->humidity' AND y.edge_type = 'humidity->cloud_cover'), q AS (SELECT regime, quantile_cont(v, 0.75) AS q FROM ch GROUP BY 1), k AS (SELECT ch.*, CASE WHEN v >= q THEN 'strong' ELSE 'ordinary' END AS stratum FROM ch JOIN q USING (regime)), r AS (SELECT *, row_number() OVER (PARTITION BY regime, stratum ORDER BY (s * 131 + m * 31 + t * 7 + la * 3 + lb) % 1009, s, m, t, la, lb) AS r FROM k) SELECT regime, stratum, s, m, t, la, lb FROM r WHERE r <= 5")
def stratified_paths(spark, sf_dir):
    ch = reports.chains(edges(spark, sf_dir).filter("p_value < 0.2")).select("regime", F.col("a_source_region").alias("s"), F.col("mediator").alias("m"), F.col("b_target_region").alias("t"), F.col("a_lag").alias("la"), F.col("b_lag").alias("lb"), F.abs(F.col("a_effect") * F.col("b_effect")).alias("v"))
    q = ch.groupBy("regime").agg(F.percentile("v", 0.75).alias("q"))
    k = ch.join(F.broadcast(q), "regime").withColumn("stratum", F.when(F.col("v") >= F.col("q"), "strong").otherwise("ordinary"))  # one row per regime
    order = (F.col("s") * 131 + F.col("m") * 31 + F.col("t") * 7 + F.col("la") * 3 + F.col("lb")) % 1009
    return k.withColumn("r", F.row_number().over(Window.partitionBy("regime", "stratum").orderBy(order, "s", "m", "t", "la", "lb"))).filter("r <= 5").select("regime", "stratum", "s", "m", "t", "la", "lb")


_P, _COARSE = 60, 3  # proposals of an edge; cubes coarser than this level are not used


def _draw(k: str, a: int) -> str:
    """Arithmetic draw number ``a`` of proposal ``k`` of an edge, the same in both engines."""
    return f"((((es * 7919 + et * 104729 + {k} * 15485863) % 1000003) * {a} + {k} * 611953) % 1000003)"


def _cube_exprs(level: str) -> list[str]:
    return [f"CAST(floor(({c} + 1) / pow(CAST(2 AS DOUBLE), 1 - {level})) AS BIGINT) AS q{c}" for c in "xyz"]


_CHORD = "2 * sin(ekm / (2 * 6371.0))"
_LEVEL = f"CAST(greatest(0, least(12, floor(ln(2 / greatest(1.2 * {_CHORD}, 1e-6)) / ln(CAST(2 AS DOUBLE))))) AS BIGINT)"
_RANK = "CASE WHEN abs(km - ekm) <= 0.1 * ekm THEN 0 WHEN abs(km - ekm) <= 0.2 * ekm THEN 1 ELSE 2 END"
_HAV = HAV_SQL.replace("a.lat", "la").replace("b.lat", "lb").replace("a.lon", "lo").replace("b.lon", "lp")

_MATCH = ctes("edges") + f""", pt AS MATERIALIZED (SELECT node, lat, lon, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM cells), mm AS (SELECT count(*) AS m FROM pt),
 nb AS (SELECT pt.*, node % m AS bucket, row_number() OVER (PARTITION BY node % m ORDER BY node) - 1 AS i, count(*) OVER (PARTITION BY node % m) AS c FROM pt, mm),
 cb AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY level, qx, qy, qz ORDER BY node) - 1 AS i, count(*) OVER (PARTITION BY level, qx, qy, qz) AS c FROM (SELECT node, lat, lon, level, {", ".join(_cube_exprs("level"))} FROM pt, range({_COARSE}, 13) l(level))),
 ee AS (SELECT DISTINCT source_region AS es, target_region AS et FROM edges WHERE p_value < 0.3 AND source_region <> target_region),
 ed AS (SELECT es, et, {HAV_SQL} AS ekm FROM ee JOIN cells a ON a.node = es JOIN cells b ON b.node = et),
 pr AS (SELECT e.*, k, n.node AS source, n.lat AS la, n.lon AS lo, x, y, z, {_LEVEL} AS level FROM ed e, range({_P}) r(k), mm JOIN nb n ON n.bucket = {_draw("k", 31)} % m AND n.i = {_draw("k", 37)} % n.c),
 far AS (SELECT p.* EXCLUDE (x, y, z), n.node AS target, n.lat AS lb, n.lon AS lp FROM pr p, mm JOIN nb n ON n.bucket = {_draw("k", 41)} % m AND n.i = {_draw("k", 43)} % n.c WHERE level < {_COARSE}),
 nr AS (SELECT es, et, ekm, k, source, la, lo, level, qx + {_draw("k", 47)} % 3 - 1 AS qx, qy + {_draw("k", 53)} % 3 - 1 AS qy, qz + {_draw("k", 59)} % 3 - 1 AS qz FROM (SELECT *, {", ".join(_cube_exprs("level"))} FROM pr WHERE level >= {_COARSE})),
 near_ AS (SELECT n.es, n.et, n.ekm, n.k, n.source, n.la, n.lo, n.level, c.node AS target, c.lat AS lb, c.lon AS lp FROM nr n JOIN cb c USING (level, qx, qy, qz) WHERE c.i = {_draw("k", 61).replace("es", "n.es").replace("et", "n.et")} % c.c),
 ok AS (SELECT *, {_RANK} AS class FROM (SELECT *, {_HAV} AS km FROM (SELECT es, et, ekm, k, source, target, la, lo, lb, lp FROM far UNION ALL SELECT es, et, ekm, k, source, target, la, lo, lb, lp FROM near_)) WHERE source <> target AND NOT (source = es AND target = et)),
 pw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY class, CASE WHEN class = 2 THEN round(abs(km - ekm), 6) ELSE 0 END, k, es, et) AS r FROM ok) WHERE r = 1),
 ew AS (SELECT * FROM (SELECT * EXCLUDE (r), row_number() OVER (PARTITION BY es, et ORDER BY class, CASE WHEN class = 2 THEN round(abs(km - ekm), 6) ELSE 0 END, k) AS r FROM pw) WHERE r = 1)
 SELECT ed.es, ed.et, round(ed.ekm, 5) AS ekm, source, target, round(km, 5) AS km, class::INT AS class FROM ed LEFT JOIN ew USING (es, et)"""


@query(_MATCH)
def matched_random_edges(spark, sf_dir):
    """Random pairs of about an edge's distance, each pair used once: within a tenth (class 0), a fifth (1), else the nearest proposed (2)."""
    e = edges(spark, sf_dir).filter("p_value < 0.3 and source_region <> target_region").select(F.col("source_region").alias("es"), F.col("target_region").alias("et")).distinct()
    m = match_by_distance(e, stations(spark, sf_dir))
    return m.select("es", "et", F.round("ekm", 5).alias("ekm"), "source", "target", F.round("km", 5).alias("km"), "class")


def match_by_distance(e: DataFrame, nodes: DataFrame, proposals: int = _P) -> DataFrame:
    """es, et, ekm with source, target, km, class of its match; an edge whose proposals are all taken has nulls.

    Pairs of all nodes are never formed: a proposal draws a source, a cube beside it (on the
    unit sphere, of a side that suits the edge's distance) and a node in that cube; for far
    edges, a node anywhere. A pair goes to the edge it suits best, so no pair is used twice,
    then each edge takes its best pair. Rows are edges times proposals.
    """
    la, lo = F.radians("lat"), F.radians("lon")
    pt = nodes.select("node", "lat", "lon", (F.cos(la) * F.cos(lo)).alias("x"), (F.cos(la) * F.sin(lo)).alias("y"), F.sin(la).alias("z"))
    m = nodes.count()
    spot = nodes.select("node", F.struct("lat", "lon").alias("p"))
    ends = e.join(spot.toDF("es", "a").hint("shuffle_merge"), "es").join(spot.toDF("et", "b").hint("shuffle_merge"), "et")
    ends = ends.select("es", "et", spatial.haversine(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")).alias("ekm"))
    place = Window.partitionBy("bucket")
    numbered = pt.withColumn("bucket", F.pmod("node", F.lit(m))).withColumn("i", F.row_number().over(place.orderBy("node")) - 1).withColumn("c", F.count("*").over(place))
    cubes = pt.withColumn("level", F.explode(F.sequence(F.lit(_COARSE).cast("long"), F.lit(12).cast("long")))).selectExpr("node", "lat", "lon", "level", *_cube_exprs("level"))
    inside = Window.partitionBy("level", "qx", "qy", "qz")
    cubes = cubes.withColumn("i", F.row_number().over(inside.orderBy("node")) - 1)
    sizes = cubes.groupBy("level", "qx", "qy", "qz").agg(F.count("*").alias("c"))

    def drawn(rows: DataFrame, bucket: int, index: int, **names: str) -> DataFrame:
        n = numbered.select("bucket", "i", "c", *[F.col(c).alias(a) for c, a in names.items()])
        d = rows.withColumn("bucket", F.expr(f"{_draw('k', bucket)} % {m}"))
        return d.join(n.hint("shuffle_merge"), "bucket").filter(F.expr(f"i = {_draw('k', index)} % c")).drop("bucket", "i", "c")

    pr = drawn(ends.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(proposals - 1).cast("long")))), 31, 37, node="source", lat="la", lon="lo", x="x", y="y", z="z")
    pr = pr.withColumn("level", F.expr(_LEVEL))
    keep = ["es", "et", "ekm", "k", "source", "target", "la", "lo", "lb", "lp"]
    far = drawn(pr.filter(F.col("level") < _COARSE), 41, 43, node="target", lat="lb", lon="lp").select(*keep)
    close = pr.filter(F.col("level") >= _COARSE).selectExpr("es", "et", "ekm", "k", "source", "la", "lo", "level", *_cube_exprs("level"))
    close = close.withColumns({f"q{c}": F.expr(f"q{c} + {_draw('k', a)} % 3 - 1") for c, a in zip("xyz", (47, 53, 59), strict=True)})
    close = close.join(sizes.hint("shuffle_merge"), ["level", "qx", "qy", "qz"]).withColumn("i", F.expr(f"{_draw('k', 61)} % c"))
    close = close.join(cubes.select("level", "qx", "qy", "qz", "i", F.col("node").alias("target"), F.col("lat").alias("lb"), F.col("lon").alias("lp")).hint("shuffle_merge"), ["level", "qx", "qy", "qz", "i"]).select(*keep)
    ok = far.unionByName(close).withColumn("km", spatial.haversine(F.col("la"), F.col("lo"), F.col("lb"), F.col("lp"))).filter("source <> target and not (source = es and target = et)")
    ok = ok.withColumn("class", F.expr(_RANK)).withColumn("off", F.when(F.col("class") == 2, F.round(F.abs(F.col("km") - F.col("ekm")), 6)).otherwise(0.0))
    best = ok.groupBy("source", "target").agg(F.min(F.struct("class", "off", "k", "es", "et", "km")).alias("w"))
    own = best.select("w.*", "source", "target").groupBy("es", "et").agg(F.min(F.struct("class", "off", "k", "source", "target", "km")).alias("w"))
    return ends.join(own.hint("shuffle_merge"), ["es", "et"], "left").select("es", "et", "ekm", "w.source", "w.target", "w.km", "w.class")


@query(ctes("panel_ship") + ", m AS (SELECT t, flag, price FROM panel_ship), b AS (SELECT flag, regr_slope(y, x) AS beta, regr_intercept(y, x) AS c FROM (SELECT a.flag, a.price AS y, p.price AS x FROM m a JOIN m p ON p.flag = a.flag AND p.t = a.t - 1 WHERE a.t < 1500) GROUP BY 1) SELECT b.flag, round(beta, 7) AS beta, count(*) AS n, round(avg(abs(a.price - c - beta * p.price)), 5) AS mae FROM b JOIN m a ON a.flag = b.flag JOIN m p ON p.flag = a.flag AND p.t = a.t - 1 WHERE a.t >= 1500 GROUP BY 1, 2")
def own_history_forecast(spark, sf_dir):
    p = panel_ship(spark, sf_dir).select("t", "flag", F.col("price").alias("y"))
    x = p.select((F.col("t") + 1).alias("t"), "flag", F.col("y").alias("z"))
    rows = p.join(x, ["t", "flag"])
    f = gram.fit(rows.filter("t < 1500"), ["flag"], []).select("flag", "beta", F.col("gy")[0].alias("my"), F.col("gz")[0].alias("mz"))
    e = F.abs(F.col("y") - F.col("my") - F.col("beta") * (F.col("z") - F.col("mz")))
    return rows.filter("t >= 1500").join(F.broadcast(f), "flag").groupBy("flag").agg(F.round(F.first("beta"), 7).alias("beta"), F.count("*").alias("n"), F.round(F.avg(e), 5).alias("mae"))


@query()
def kmeans_regions(spark, sf_dir):
    """Regions by k-means on the unit sphere; labels are those of the library."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    la, lo = F.radians("lat"), F.radians("lon")
    c = stations(spark, sf_dir).select("node", (F.cos(la) * F.cos(lo)).alias("x"), (F.cos(la) * F.sin(lo)).alias("y"), F.sin(la).alias("z"))
    v = VectorAssembler(inputCols=["x", "y", "z"], outputCol="v").transform(c)
    return KMeans(k=6, seed=1, featuresCol="v", predictionCol="region").fit(v).transform(v).select("node", "region")


@query()
def multinomial_baseline(spark, sf_dir):
    """Class probabilities of the order status from price and month, fitted on two thirds of the orders."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    o = table(spark, sf_dir, "orders")
    label = F.when(F.col("o_orderstatus") == "F", 0.0).when(F.col("o_orderstatus") == "O", 1.0).otherwise(2.0)
    x = o.select("o_orderkey", label.alias("label"), "o_totalprice", F.year("o_orderdate").cast("double").alias("year"), F.month("o_orderdate").cast("double").alias("month"))
    v = VectorAssembler(inputCols=["o_totalprice", "year", "month"], outputCol="raw").transform(x)
    train = v.filter("o_orderkey % 3 <> 0")
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(train)
    model = LogisticRegression(family="multinomial", regParam=1e-3, maxIter=30).fit(scaler.transform(train))
    p = model.transform(scaler.transform(v.filter("o_orderkey % 3 = 0"))).withColumn("p", vector_to_array("probability"))
    at = F.element_at("p", F.col("label").cast("int") + 1)
    return p.groupBy("label").agg(F.count("*").alias("n"), F.avg(-F.log(F.greatest(at, F.lit(1e-12)))).alias("log_loss"))


@query()
def boosted_forecast(spark, sf_dir):
    """Boosted trees for quantity from price, discount and month, scored on later years."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    li = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("label"), "l_extendedprice", "l_discount", F.month("l_shipdate").cast("double").alias("month"), F.year("l_shipdate").alias("year"))
    v = VectorAssembler(inputCols=["l_extendedprice", "l_discount", "month"], outputCol="features").transform(li)
    model = GBTRegressor(maxIter=5, maxDepth=3, seed=1).fit(v.filter("year < 1999"))
    e = F.col("prediction") - F.col("label")
    return model.transform(v.filter("year >= 1999")).groupBy("year").agg(F.count("*").alias("n"), F.avg(e * e).alias("mse"))


@query(ctes("panel_orders") + ", f AS (SELECT t, node, price, lag(price, 1) OVER w AS l1, lag(price, 2) OVER w AS l2, t - lag(t, 2) OVER w AS span, month(ts) AS m FROM panel_orders WINDOW w AS (PARTITION BY node ORDER BY t)) SELECT t, node, round(price, 5) AS y, round(l1, 5) AS l1, round(l2, 5) AS l2, round(sin(2 * pi() * m / 12), 8) AS s, round(cos(2 * pi() * m / 12), 8) AS c FROM f WHERE span = 2")
def forecast_features(spark, sf_dir):
    p = panel_orders(spark, sf_dir).select("t", "ts", "node", "price")
    at = lambda k: p.select((F.col("t") + k).alias("t"), "node", F.round("price", 5).alias(f"l{k}"))
    a = 2 * F.pi() * F.month("ts") / 12
    return p.join(at(1), ["t", "node"]).join(at(2), ["t", "node"]).select("t", "node", F.round("price", 5).alias("y"), "l1", "l2", F.round(F.sin(a), 8).alias("s"), F.round(F.cos(a), 8).alias("c"))


@query(ctes("panel") + ", x AS (SELECT b.t, b.node, b.humidity AS y, a.wind AS p, f.wind AS u FROM panel b JOIN panel a ON a.node = (b.node + 1) % 5 AND a.t = b.t - 1 JOIN panel f ON f.node = (b.node + 1) % 5 AND f.t = b.t + 1) SELECT node, count(*) AS n, round(corr(y, p), 8) AS past, round(corr(y, u), 8) AS future FROM x GROUP BY 1")
def signed_lag_direction(spark, sf_dir):
    p = panel(spark, sf_dir)
    other = lambda d, n: p.select((F.col("t") + d).alias("t"), F.pmod(F.col("node") - 1, F.lit(5)).alias("node"), F.col("wind").alias(n))
    x = p.select("t", "node", F.col("humidity").alias("y")).join(other(1, "p"), ["t", "node"]).join(other(-1, "u"), ["t", "node"])
    r = lambda c: F.round(F.covar_pop("y", c) / (F.stddev_pop("y") * F.stddev_pop(c)), 8)
    return x.groupBy("node").agg(F.count("*").alias("n"), r("p").alias("past"), r("u").alias("future"))
