"""Forecast features, verification, product agreement, drift, flux."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagloom.operators import gram
from lagloom.plans import section
from lagloom.sources.fixtures import cells, ctes, panel, panel_orders, panel_ship, table

QUERIES, query = section()

_PRED = """pred AS (SELECT l_orderkey, l_linenumber, l_returnflag AS region, year(l_shipdate) AS y, month(l_shipdate) AS m, CAST(l_shipdate AS DATE) AS day, l_quantity AS actual, m.model,
 CASE m.model WHEN 'price' THEN l_extendedprice / 1600 ELSE 26 + 40 * (l_discount - 0.05) END AS prediction FROM lineitem, (VALUES ('price'), ('discount')) m(model))"""


def predictions(spark, sf_dir) -> DataFrame:
    """Quantities with the forecasts of two models: one row per line and model."""
    li = table(spark, sf_dir, "lineitem")
    models = F.explode(F.array(F.struct(F.lit("price").alias("model"), (F.col("l_extendedprice") / 1600).alias("prediction")), F.struct(F.lit("discount").alias("model"), (26 + 40 * (F.col("l_discount") - 0.05)).alias("prediction"))))
    return li.select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("region"), F.year("l_shipdate").alias("y"), F.month("l_shipdate").alias("m"), F.col("l_shipdate").cast("date").alias("day"), F.col("l_quantity").alias("actual"), models.alias("p")).select("*", "p.*").drop("p")


def errors() -> list:
    e = F.col("prediction") - F.col("actual")
    return [F.count("*").alias("n"), F.round(F.avg(e * e), 6).alias("mse"), F.round(F.avg(F.abs(e)), 6).alias("mae"), F.round(F.avg(e), 6).alias("bias")]


_ERR = "count(*) AS n, round(avg((prediction - actual) * (prediction - actual)), 6) AS mse, round(avg(abs(prediction - actual)), 6) AS mae, round(avg(prediction - actual), 6) AS bias"


@query(f"WITH {_PRED} SELECT model, s.slice AS slice, {_ERR} FROM pred, LATERAL (SELECT unnest(['all', 'region=' || region, 'season=' || (m % 12 // 3)]) AS slice) s GROUP BY 1, 2")
def verification_by_slice(spark, sf_dir):
    slices = F.explode(F.array(F.lit("all"), F.concat(F.lit("region="), "region"), F.concat(F.lit("season="), F.floor(F.col("m") % 12 / 3).cast("string"))))
    return predictions(spark, sf_dir).withColumn("slice", slices).groupBy("model", "slice").agg(*errors())


@query(f"WITH {_PRED}, r AS (SELECT model, region, avg((prediction - actual) * (prediction - actual)) AS mse FROM pred GROUP BY 1, 2) SELECT model, count(*) AS regions, round(avg(mse), 6) AS pooled_mse FROM r GROUP BY 1")
def pooled_equal_regions(spark, sf_dir):
    e = F.col("prediction") - F.col("actual")
    return predictions(spark, sf_dir).groupBy("model", "region").agg(F.avg(e * e).alias("mse")).groupBy("model").agg(F.count("*").alias("regions"), F.round(F.avg("mse"), 6).alias("pooled_mse"))


@query(f"WITH {_PRED} SELECT model, count(*) FILTER (prediction < 5 OR prediction > 45) AS clipped, round(avg(pow(least(greatest(prediction, 5), 45) - actual, 2)), 6) AS mse FROM pred GROUP BY 1")
def clipped_targets(spark, sf_dir):
    p = F.col("prediction")
    c = F.least(F.greatest(p, F.lit(5.0)), F.lit(45.0)) - F.col("actual")
    return predictions(spark, sf_dir).groupBy("model").agg(F.count_if((p < 5) | (p > 45)).alias("clipped"), F.round(F.avg(c * c), 6).alias("mse"))


@query(f"WITH {_PRED}, d AS (SELECT day, avg(pow(prediction - actual, 2)) FILTER (model = 'price') - avg(pow(prediction - actual, 2)) FILTER (model = 'discount') AS d FROM pred GROUP BY 1) SELECT year(day) AS y, count(*) AS days, round(avg(d), 6) AS difference, round(avg(CASE WHEN d < 0 THEN 1.0 ELSE 0.0 END), 6) AS wins FROM d GROUP BY 1")
def paired_comparison(spark, sf_dir):
    e = F.col("prediction") - F.col("actual")
    of = lambda m: F.avg(F.when(F.col("model") == m, e * e))
    d = predictions(spark, sf_dir).groupBy("day").agg((of("price") - of("discount")).alias("d"))
    return d.groupBy(F.year("day").alias("y")).agg(F.count("*").alias("days"), F.round(F.avg("d"), 6).alias("difference"), F.round(F.avg(F.when(F.col("d") < 0, 1.0).otherwise(0.0)), 6).alias("wins"))


@query("""WITH tr AS (SELECT l_returnflag AS region, month(l_shipdate) AS m, avg(l_quantity) AS clim FROM lineitem WHERE year(l_shipdate) < 1999 GROUP BY 1, 2), g AS (SELECT avg(l_quantity) AS g FROM lineitem WHERE year(l_shipdate) < 1999)
 SELECT month(l_shipdate) AS m, count(*) AS n, round(avg(pow(l_quantity - g, 2)), 6) AS global_mse, round(avg(pow(l_quantity - clim, 2)), 6) AS month_mse FROM lineitem CROSS JOIN g JOIN tr ON region = l_returnflag AND m = month(l_shipdate) WHERE year(l_shipdate) >= 1999 GROUP BY 1""")
def climatology_baselines(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("region"), F.month("l_shipdate").alias("m"), F.year("l_shipdate").alias("y"), F.col("l_quantity").alias("q"))
    clim = li.filter("y < 1999").groupBy("region", "m").agg(F.avg("q").alias("clim"))
    g = li.filter("y < 1999").agg(F.avg("q").alias("g"))
    test = li.filter("y >= 1999").join(clim, ["region", "m"]).crossJoin(F.broadcast(g))  # one row
    return test.groupBy("m").agg(F.count("*").alias("n"), F.round(F.avg(F.pow(F.col("q") - F.col("g"), 2)), 6).alias("global_mse"), F.round(F.avg(F.pow(F.col("q") - F.col("clim"), 2)), 6).alias("month_mse"))


@query(ctes("panel_ship") + " SELECT a.flag, count(*) AS n, round(avg(abs(a.price - b.price)), 5) AS mae FROM panel_ship a JOIN panel_ship b ON a.flag = b.flag AND b.t = a.t - 1 WHERE a.t >= 1500 GROUP BY 1")
def persistence_baseline(spark, sf_dir):
    p = panel_ship(spark, sf_dir).select("t", "flag", "price")
    b = p.select((F.col("t") + 1).alias("t"), "flag", F.col("price").alias("before"))
    return p.filter("t >= 1500").join(b, ["t", "flag"]).groupBy("flag").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("price") - F.col("before"))), 5).alias("mae"))


@query(ctes("panel_ship") + ", e AS (SELECT flag, quantile_cont(price, [1/9.0, 2/9.0, 3/9.0, 4/9.0, 5/9.0, 6/9.0, 7/9.0, 8/9.0]) AS q FROM panel_ship WHERE t < 1500 GROUP BY 1), b AS (SELECT flag, price, t, len(list_filter(q, lambda x: x <= price)) AS token FROM panel_ship JOIN e USING (flag)) SELECT flag, token, count(*) AS n, round(avg(price), 5) AS centre FROM b GROUP BY 1, 2")
def quantile_tokens(spark, sf_dir):
    p = panel_ship(spark, sf_dir)
    e = p.filter("t < 1500").groupBy("flag").agg(F.percentile("price", F.array(*[F.lit(i / 9) for i in range(1, 9)])).alias("q"))
    token = F.size(F.filter("q", lambda x: x <= F.col("price")))
    return p.join(e, "flag").groupBy("flag", token.alias("token")).agg(F.count("*").alias("n"), F.round(F.avg("price"), 5).alias("centre"))


@query(ctes("panel_ship") + ", z AS (SELECT t, flag, (price - avg(price) OVER (PARTITION BY flag)) / stddev_pop(price) OVER (PARTITION BY flag) AS z FROM panel_ship), b AS (SELECT t, flag, z, (z >= -2)::INT + (z >= -1)::INT + (z >= -0.5)::INT + (z >= -0.15)::INT + (z >= 0.15)::INT + (z >= 0.5)::INT + (z >= 1)::INT + (z >= 2)::INT AS token FROM z), c AS (SELECT flag, token, avg(z) AS c FROM b WHERE t < 1500 GROUP BY 1, 2) SELECT flag, t >= 1500 AS test, count(*) AS n, round(sqrt(avg(pow(z - c, 2))), 7) AS rmse, round(avg(CASE WHEN token IN (0, 8) THEN 1.0 ELSE 0.0 END), 8) AS outer_share FROM b JOIN c USING (flag, token) GROUP BY 1, 2")
def token_reconstruction(spark, sf_dir):
    w = Window.partitionBy("flag")
    z = panel_ship(spark, sf_dir).select("t", "flag", ((F.col("price") - F.avg("price").over(w)) / F.stddev_pop("price").over(w)).alias("z"))
    b = z.withColumn("token", sum((F.when(F.col("z") >= e, 1).otherwise(0) for e in (-2, -1, -0.5, -0.15, 0.15, 0.5, 1, 2)), F.lit(0)))
    c = b.filter("t < 1500").groupBy("flag", "token").agg(F.avg("z").alias("c"))
    return b.join(c, ["flag", "token"]).groupBy("flag", (F.col("t") >= 1500).alias("test")).agg(F.count("*").alias("n"), F.round(F.sqrt(F.avg(F.pow(F.col("z") - F.col("c"), 2))), 7).alias("rmse"), F.round(F.avg(F.when(F.col("token").isin(0, 8), 1.0).otherwise(0.0)), 8).alias("outer_share"))


@query(ctes("panel_ship") + ", p AS (SELECT a.flag, k.h, b.disc - a.disc AS d FROM panel_ship a CROSS JOIN (VALUES (1), (2), (4)) k(h) JOIN panel_ship b ON b.flag = a.flag AND b.t = a.t + k.h) SELECT flag, h, CASE WHEN d > 0.005 THEN 'up' WHEN d < -0.005 THEN 'down' ELSE 'steady' END AS label, count(*) AS n FROM p GROUP BY 1, 2, 3")
def change_labels(spark, sf_dir):
    p = panel_ship(spark, sf_dir).select("t", "flag", "disc")
    a = p.withColumn("h", F.explode(F.array(F.lit(1), F.lit(2), F.lit(4)))).withColumn("t", F.col("t") + F.col("h")).withColumnRenamed("disc", "before")
    d = F.col("disc") - F.col("before")
    return a.join(p, ["t", "flag"]).groupBy("flag", "h", F.when(d > 0.005, "up").when(d < -0.005, "down").otherwise("steady").alias("label")).agg(F.count("*").alias("n"))


_CLS = """cls AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS label, 1.0 + o_orderkey % 7 AS a, 1.0 + o_custkey % 5 AS b, 1.0 + o_orderkey % 3 AS c FROM orders), pr AS (SELECT o_orderkey, label, [a / (a + b + c), b / (a + b + c), c / (a + b + c)] AS p FROM cls)"""


def class_predictions(spark, sf_dir) -> DataFrame:
    """Order status as one of three classes with probabilities: o_orderkey, label, p."""
    o = table(spark, sf_dir, "orders")
    w = F.array(1.0 + F.col("o_orderkey") % 7, 1.0 + F.col("o_custkey") % 5, 1.0 + F.col("o_orderkey") % 3)
    total = F.aggregate("w", F.lit(0.0), lambda s, x: s + x)
    label = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return o.select("o_orderkey", label.alias("label"), w.alias("w")).withColumn("s", total).select("o_orderkey", "label", F.transform("w", lambda x: x / F.col("s")).alias("p"))


@query(f"WITH {_CLS} SELECT label, count(*) AS n, round(avg(pow(p[1] - (label = 0)::INT, 2) + pow(p[2] - (label = 1)::INT, 2) + pow(p[3] - (label = 2)::INT, 2)), 8) AS brier, round(avg(-ln(greatest(p[label + 1], 1e-12))), 8) AS log_loss, round(avg((p[label + 1] = greatest(p[1], p[2], p[3]))::INT), 8) AS hit FROM pr GROUP BY 1")
def probability_scores(spark, sf_dir):
    c = class_predictions(spark, sf_dir).withColumn("at", F.element_at("p", F.col("label") + 1))
    brier = F.aggregate(F.transform("p", lambda x, i: F.pow(x - F.when(i == F.col("label"), 1.0).otherwise(0.0), F.lit(2))), F.lit(0.0), lambda s, x: s + x)
    return c.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(brier), 8).alias("brier"), F.round(F.avg(-F.log(F.greatest("at", F.lit(1e-12)))), 8).alias("log_loss"), F.round(F.avg((F.col("at") == F.array_max("p")).cast("int")), 8).alias("hit"))


@query(f"WITH {_CLS}, x AS (SELECT greatest(p[1], p[2], p[3]) AS conf, (p[label + 1] = greatest(p[1], p[2], p[3]))::INT AS hit FROM pr) SELECT least(floor(conf * 10), 9)::BIGINT AS bin, count(*) AS n, round(avg(conf), 8) AS confidence, round(avg(hit), 8) AS accuracy, round(abs(avg(conf) - avg(hit)) * count(*) / (SELECT count(*) FROM x), 8) AS ece_part FROM x GROUP BY 1")
def calibration_bins(spark, sf_dir):
    c = class_predictions(spark, sf_dir).select(F.array_max("p").alias("conf"), (F.element_at("p", F.col("label") + 1) == F.array_max("p")).cast("int").alias("hit"))
    g = c.groupBy(F.least(F.floor(F.col("conf") * 10), F.lit(9)).cast("long").alias("bin")).agg(F.count("*").alias("n"), F.avg("conf").alias("c"), F.avg("hit").alias("a"))
    total = F.sum("n").over(Window.partitionBy())  # ten bins at most
    return g.select("bin", "n", F.round("c", 8).alias("confidence"), F.round("a", 8).alias("accuracy"), F.round(F.abs(F.col("c") - F.col("a")) * F.col("n") / total, 8).alias("ece_part"))


@query(f"WITH {_CLS}, x AS (SELECT k, p[k + 1] AS p, (label = k)::INT AS o FROM pr, range(3) z(k)), m AS (SELECT k, avg(o) AS po, avg(p) AS pp, var_pop(p) AS vp, covar_pop(p, o) AS cv, avg(pow(p - o, 2)) AS b FROM x GROUP BY 1) SELECT k::INT AS k, round(po * (1 - po), 8) AS uncertainty, round(pow(pp - po, 2), 8) AS bias2, round(vp, 8) AS variance, round(2 * cv, 8) AS credit, round(b, 8) AS brier FROM m")
def brier_decomposition(spark, sf_dir):
    x = class_predictions(spark, sf_dir).select("label", F.posexplode("p").alias("k", "p")).withColumn("o", F.when(F.col("label") == F.col("k"), 1.0).otherwise(0.0))
    po, pp = F.avg("o"), F.avg("p")
    return x.groupBy("k").agg(F.round(po * (1 - po), 8).alias("uncertainty"), F.round(F.pow(pp - po, 2), 8).alias("bias2"), F.round(F.var_pop("p"), 8).alias("variance"), F.round(2 * F.covar_pop("p", "o"), 8).alias("credit"), F.round(F.avg(F.pow(F.col("p") - F.col("o"), 2)), 8).alias("brier"))


@query(f"WITH {_CLS}, x AS (SELECT label, list_position(p, greatest(p[1], p[2], p[3])) - 1 AS guess FROM pr), c AS (SELECT k, (SELECT count(*) FROM x WHERE label = k AND guess = k) AS tp, (SELECT count(*) FROM x WHERE guess = k) AS g, (SELECT count(*) FROM x WHERE label = k) AS l FROM range(3) z(k)) SELECT k::INT AS k, tp, g AS guessed, l AS actual, round(CASE WHEN g + l = 0 THEN 0 ELSE 2.0 * tp / (g + l) END, 8) AS f1 FROM c")
def class_f1(spark, sf_dir):
    x = class_predictions(spark, sf_dir).select("label", (F.array_position("p", F.array_max("p")) - 1).cast("int").alias("guess"))
    c = x.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).groupBy("k").agg(F.count_if((F.col("label") == F.col("k")) & (F.col("guess") == F.col("k"))).alias("tp"), F.count_if(F.col("guess") == F.col("k")).alias("guessed"), F.count_if(F.col("label") == F.col("k")).alias("actual"))
    return c.withColumn("f1", F.round(F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("guessed") + F.col("actual")), F.lit(0.0)), 8))


@query(f"WITH {_CLS}, f AS (SELECT label, (count(*) + 1) / ((SELECT count(*) FROM pr WHERE o_orderkey % 3 <> 0) + 3.0) AS share FROM pr WHERE o_orderkey % 3 <> 0 GROUP BY 1) SELECT p.label, count(*) AS n, round(any_value(share), 8) AS share, round(avg(-ln(share)), 8) AS log_loss FROM pr p JOIN f USING (label) WHERE o_orderkey % 3 = 0 GROUP BY 1")
def class_frequency_baseline(spark, sf_dir):
    c = class_predictions(spark, sf_dir)
    f = c.filter("o_orderkey % 3 <> 0").groupBy("label").agg(F.count("*").alias("n"))
    f = f.select("label", ((F.col("n") + 1) / (F.sum("n").over(Window.partitionBy()) + 3.0)).alias("share"))  # three classes
    return c.filter("o_orderkey % 3 = 0").join(F.broadcast(f), "label").groupBy("label").agg(F.count("*").alias("n"), F.round(F.first("share"), 8).alias("share"), F.round(F.avg(-F.log("share")), 8).alias("log_loss"))


@query(f"WITH {_PRED}, s AS (SELECT region, greatest(prediction - 10 - actual, actual - prediction - 10, 0) AS score FROM pred WHERE model = 'price' AND y < 1999), k AS (SELECT region, score, row_number() OVER (PARTITION BY region ORDER BY score) AS r, count(*) OVER (PARTITION BY region) AS n FROM s), e AS (SELECT region, score AS expansion FROM k WHERE r = ceil((n + 1) * 0.9)) SELECT region, round(any_value(expansion), 6) AS expansion, any_value(expansion) IS NULL AS unbounded, count(*) AS n, round(avg(CASE WHEN expansion IS NULL OR abs(actual - prediction) <= 10 + expansion THEN 1.0 ELSE 0.0 END), 8) AS coverage FROM pred LEFT JOIN e USING (region) WHERE model = 'price' AND y >= 1999 GROUP BY 1")
def conformal_intervals(spark, sf_dir):
    """Expansion by the order statistic of rank ceil((n + 1) 0.9); where that rank is above n the interval is unbounded, and the region stays."""
    p = predictions(spark, sf_dir).filter("model = 'price'").withColumn("miss", F.abs(F.col("prediction") - F.col("actual")))
    cal = p.filter("y < 1999").groupBy("region", F.greatest(F.col("miss") - 10, F.lit(0.0)).alias("score")).agg(F.count("*").alias("c"))
    up = Window.partitionBy("region").orderBy("score")
    cal = cal.withColumn("upto", F.sum("c").over(up)).withColumn("n", F.sum("c").over(Window.partitionBy("region")))
    e = cal.filter(F.col("upto") >= F.ceil((F.col("n") + 1) * F.lit(0.9))).groupBy("region").agg(F.min("score").alias("expansion"))
    hit = F.when(F.col("expansion").isNull() | (F.col("miss") <= 10 + F.col("expansion")), 1.0).otherwise(0.0)
    return p.filter("y >= 1999").join(F.broadcast(e), "region", "left").groupBy("region").agg(F.round(F.first("expansion"), 6).alias("expansion"), F.first("expansion").isNull().alias("unbounded"), F.count("*").alias("n"), F.round(F.avg(hit), 8).alias("coverage"))


@query("WITH r AS (SELECT min(l_quantity) + 5 AS lo, max(l_quantity) - 5 AS hi FROM lineitem WHERE year(l_shipdate) < 1999) SELECT l_returnflag AS region, count(*) AS n, count(*) FILTER (l_quantity < lo OR l_quantity > hi) AS outside FROM lineitem, r WHERE year(l_shipdate) >= 1999 GROUP BY 1")
def support_check(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    r = li.filter(F.year("l_shipdate") < 1999).agg((F.min("l_quantity") + 5).alias("lo"), (F.max("l_quantity") - 5).alias("hi"))
    out = (F.col("l_quantity") < F.col("lo")) | (F.col("l_quantity") > F.col("hi"))
    return li.filter(F.year("l_shipdate") >= 1999).crossJoin(F.broadcast(r)).groupBy(F.col("l_returnflag").alias("region")).agg(F.count("*").alias("n"), F.count_if(out).alias("outside"))  # one row


@query("SELECT l_returnflag AS region, round(sum(l_discount * l_quantity) / 1e3, 6) AS sxy, round(covar_pop(l_extendedprice, l_quantity) * count(*) / (var_pop(l_quantity) * count(*) + 1e-6), 6) AS slope FROM lineitem WHERE year(l_shipdate) < 1999 GROUP BY 1")
def ridge_limit(spark, sf_dir):
    """Ridge with a penalty of 1e-6, the limit towards least squares; see ridge_path for larger ones."""
    li = table(spark, sf_dir, "lineitem").filter(F.year("l_shipdate") < 1999)
    f = gram.fit(li.select(F.col("l_returnflag").alias("region"), F.col("l_quantity").alias("z"), F.col("l_extendedprice").alias("y")), ["region"], [])
    s = li.groupBy(F.col("l_returnflag").alias("region")).agg(F.round(F.sum(F.col("l_discount") * F.col("l_quantity")) / 1e3, 6).alias("sxy"))
    return s.join(f.select("region", F.round(F.col("zy") / (F.col("zss") + 1e-6), 6).alias("slope")), "region")


@query("WITH s AS (SELECT l_returnflag AS region, covar_pop(l_quantity, l_extendedprice) * count(*) AS xy, var_pop(l_quantity) * count(*) AS xx, avg(l_quantity) AS mx, avg(l_extendedprice) AS my FROM lineitem WHERE year(l_shipdate) < 1998 GROUP BY 1), b AS (SELECT region, a.alpha, xy / (xx + a.alpha) AS beta, mx, my FROM s, (VALUES (1.0), (10.0), (100.0), (1000.0)) a(alpha)) SELECT region, alpha::DOUBLE AS alpha, round(any_value(beta), 5) AS beta, round(avg(pow(l_extendedprice - my - beta * (l_quantity - mx), 2)) / 1e6, 6) AS mse FROM lineitem JOIN b ON region = l_returnflag WHERE year(l_shipdate) >= 1998 GROUP BY 1, 2")
def ridge_path(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("region"), F.year("l_shipdate").alias("year"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    s = li.filter("year < 1998").groupBy("region").agg((F.covar_pop("x", "y") * F.count("*")).alias("xy"), (F.var_pop("x") * F.count("*")).alias("xx"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    b = s.withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in (1.0, 10.0, 100.0, 1000.0)]))).withColumn("beta", F.col("xy") / (F.col("xx") + F.col("alpha")))
    e = F.col("y") - F.col("my") - F.col("beta") * (F.col("x") - F.col("mx"))
    return li.filter("year >= 1998").join(F.broadcast(b), "region").groupBy("region", "alpha").agg(F.round(F.first("beta"), 5).alias("beta"), F.round(F.avg(e * e) / 1e6, 6).alias("mse"))


# ---- product agreement and drift
_AG = """ag AS (SELECT a.t, a.ts, a.price AS x, b.price AS y FROM panel_ship a JOIN panel_ship b ON a.t = b.t WHERE a.flag = 'A' AND b.flag = 'N')"""


def _products(spark, sf_dir) -> DataFrame:
    p = panel_ship(spark, sf_dir)
    return p.filter("flag = 'A'").select("t", "ts", F.col("price").alias("x")).join(p.filter("flag = 'N'").select("t", F.col("price").alias("y")), "t")


def agreement(*by) -> list:
    """Agreement of x and y where both are there; no correlation of constants."""
    d, sx, sy = F.col("x") - F.col("y"), F.stddev_pop("x"), F.stddev_pop("y")
    return [F.count("*").alias("n"), F.round(F.avg(d), 5).alias("bias"), F.round(F.avg(F.abs(d)), 5).alias("mae"), F.round(F.sqrt(F.avg(d * d)), 5).alias("rmse"), F.round(F.when((sx > 0) & (sy > 0), F.covar_pop("x", "y") / (sx * sy)), 8).alias("r")]


_AGG = "count(*) AS n, round(avg(x - y), 5) AS bias, round(avg(abs(x - y)), 5) AS mae, round(sqrt(avg((x - y) * (x - y))), 5) AS rmse, round(corr(x, y), 8) AS r"


@query(ctes("panel_ship") + f", {_AG} SELECT g.grain AS grain, {_AGG} FROM ag, LATERAL (SELECT unnest(['all', 'year=' || year(ts), 'month=' || month(ts)]) AS grain) g GROUP BY 1")
def product_agreement(spark, sf_dir):
    grain = F.explode(F.array(F.lit("all"), F.concat(F.lit("year="), F.year("ts").cast("string")), F.concat(F.lit("month="), F.month("ts").cast("string"))))
    return _products(spark, sf_dir).withColumn("grain", grain).groupBy("grain").agg(*agreement())


@query(ctes("panel_ship") + f", {_AG}, d AS (SELECT x - avg(x) OVER w AS x, y - avg(y) OVER w AS y, year(ts) AS year FROM ag WINDOW w AS (PARTITION BY month(ts))) SELECT year, {_AGG} FROM d GROUP BY 1")
def anomaly_agreement(spark, sf_dir):
    w = Window.partitionBy(F.month("ts"))
    d = _products(spark, sf_dir).select(F.year("ts").alias("year"), (F.col("x") - F.avg("x").over(w)).alias("x"), (F.col("y") - F.avg("y").over(w)).alias("y"))
    return d.groupBy("year").agg(*agreement())


@query("WITH d AS (SELECT CAST(ts AS DATE) AS day, avg(value) FILTER (hour(ts) IN (0, 6, 12, 18)) AS four, avg(value) AS every, count(*) FILTER (hour(ts) IN (0, 6, 12, 18)) AS n4, count(*) AS n FROM events GROUP BY 1) SELECT day, n4, n, round(four, 8) AS four, round(every, 8) AS every FROM d")
def daily_sampling_schemes(spark, sf_dir):
    four = F.hour("ts").isin(0, 6, 12, 18)
    return table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.count_if(four).alias("n4"), F.count("*").alias("n"), F.round(F.avg(F.when(four, F.col("value"))), 8).alias("four"), F.round(F.avg("value"), 8).alias("every"))


@query(ctes("panel_ship") + f", {_AG}, q AS (SELECT quantile_cont(x, 0.8) AS hi FROM ag WHERE t < 1500) SELECT t >= 1500 AS late, count(*) AS n, count(*) FILTER (x >= hi) AS high_x, count(*) FILTER (y >= hi) AS high_y, count(*) FILTER ((x >= hi) <> (y >= hi)) AS disagree FROM ag, q GROUP BY 1")
def state_disagreement(spark, sf_dir):
    p = _products(spark, sf_dir)
    q = p.filter("t < 1500").agg(F.percentile("x", 0.8).alias("hi"))
    hx, hy = F.col("x") >= F.col("hi"), F.col("y") >= F.col("hi")
    return p.crossJoin(F.broadcast(q)).groupBy((F.col("t") >= 1500).alias("late")).agg(F.count("*").alias("n"), F.count_if(hx).alias("high_x"), F.count_if(hy).alias("high_y"), F.count_if(hx != hy).alias("disagree"))  # one row


@query(ctes("panel_orders", "cells") + ", c AS (SELECT node, t // 24 AS segment, CASE WHEN stddev_pop(total) > 0 AND stddev_pop(price) > 0 THEN corr(total, price) END AS r FROM panel_orders GROUP BY 1, 2) SELECT segment, count(*) AS cells, round(sum(r * cos(radians(lat))) / sum(cos(radians(lat))), 7) AS weighted, round(quantile_cont(r, 0.5), 7) AS median FROM c JOIN cells USING (node) GROUP BY 1")
def cell_correlations(spark, sf_dir):
    p = panel_orders(spark, sf_dir)
    sx, sy = F.stddev_pop("total"), F.stddev_pop("price")
    c = p.groupBy("node", F.floor(F.col("t") / 24).alias("segment")).agg(F.when((sx > 0) & (sy > 0), F.covar_pop("total", "price") / (sx * sy)).alias("r"))
    w = F.cos(F.radians("lat"))
    return c.join(F.broadcast(cells(spark, sf_dir)), "node").groupBy("segment").agg(F.count("*").alias("cells"), F.round(F.sum(F.col("r") * w) / F.sum(w), 7).alias("weighted"), F.round(F.percentile("r", 0.5), 7).alias("median"))


@query(ctes("panel_ship") + " SELECT year(ts) AS year, flag, count(*) AS n, round(avg(price), 5) AS mean, round(stddev_samp(price), 5) AS sd, round(quantile_cont(price, 0.1), 5) AS p10, round(quantile_cont(price, 0.9), 5) AS p90 FROM panel_ship GROUP BY 1, 2")
def annual_statistics(spark, sf_dir):
    q = F.percentile("price", F.array(F.lit(0.1), F.lit(0.9)))
    g = panel_ship(spark, sf_dir).groupBy(F.year("ts").alias("year"), "flag").agg(F.count("*").alias("n"), F.round(F.avg("price"), 5).alias("mean"), F.round(F.stddev_samp("price"), 5).alias("sd"), q.alias("q"))
    return g.select("year", "flag", "n", "mean", "sd", F.round(F.col("q")[0], 5).alias("p10"), F.round(F.col("q")[1], 5).alias("p90"))


@query(ctes("panel_ship") + ", d AS (SELECT flag, t, price - lag(price) OVER (PARTITION BY flag ORDER BY t) AS d FROM panel_ship), s AS (SELECT flag, d AS step FROM d WHERE t = 1500) SELECT s.flag, round(any_value(step), 5) AS step, round(avg(CASE WHEN abs(d) <= abs(step) THEN 1.0 ELSE 0.0 END), 8) AS percentile, count(d) AS n FROM s JOIN d ON d.flag = s.flag AND d.t < 1500 WHERE d IS NOT NULL GROUP BY 1")
def seam_diagnostics(spark, sf_dir):
    d = panel_ship(spark, sf_dir).select("flag", "t", (F.col("price") - F.lag("price").over(Window.partitionBy("flag").orderBy("t"))).alias("d"))
    s = d.filter("t = 1500").select("flag", F.col("d").alias("step"))
    j = d.filter("t < 1500 and d is not null").join(F.broadcast(s), "flag")
    return j.groupBy("flag").agg(F.round(F.first("step"), 5).alias("step"), F.round(F.avg(F.when(F.abs("d") <= F.abs("step"), 1.0).otherwise(0.0)), 8).alias("percentile"), F.count("d").alias("n"))


@query("SELECT l_shipmode_like AS source, count(*) AS n, min(l_tax) AS low, max(l_tax) AS high, max(l_tax) <= 0.08 AS in_range FROM (SELECT l_linestatus AS l_shipmode_like, l_tax FROM lineitem) GROUP BY 1")
def range_consistency(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("source")).agg(F.count("*").alias("n"), F.min("l_tax").alias("low"), F.max("l_tax").alias("high"), (F.max("l_tax") <= 0.08).alias("in_range"))


@query(ctes("panel_orders") + ", v AS (SELECT node, t // 12 AS y, var_pop(price) AS v FROM panel_orders GROUP BY 1, 2) SELECT node, round(max(v) / min(v), 5) AS max_min, round(quantile_cont(v, 0.9) / quantile_cont(v, 0.1), 5) AS p90_p10 FROM v WHERE v > 0 GROUP BY 1")
def variance_by_year(spark, sf_dir):
    v = panel_orders(spark, sf_dir).groupBy("node", F.floor(F.col("t") / 12).alias("y")).agg(F.var_pop("price").alias("v")).filter("v > 0")
    q = F.percentile("v", F.array(F.lit(0.1), F.lit(0.9)))
    return v.groupBy("node").agg((F.max("v") / F.min("v")).alias("m"), q.alias("q")).select("node", F.round("m", 5).alias("max_min"), F.round(F.col("q")[1] / F.col("q")[0], 5).alias("p90_p10"))


# ---- moisture flux on a periodic grid of 8 by 12 cells
_G = """f AS (SELECT year(l_shipdate) AS t, CAST(l_partkey * 31 % 8 AS BIGINT) AS i, CAST(l_suppkey * 7 % 12 AS BIGINT) AS j, avg(l_quantity) AS qu, avg(l_discount) * 100 AS qv FROM lineitem GROUP BY 1, 2, 3),
 dv AS (SELECT c.t, c.i, c.j, (((c.qu + e.qu) / 2 - (c.qu + w.qu) / 2) * 6371.0 * radians(22.5) + (coalesce((c.qv + n.qv) / 2, 0) * cos(radians(-90 + 22.5 * (c.i + 1))) - coalesce((c.qv + s.qv) / 2, 0) * cos(radians(-90 + 22.5 * c.i))) * 6371.0 * radians(30))
  / (6371.0 * 6371.0 * radians(30) * (sin(radians(-90 + 22.5 * (c.i + 1))) - sin(radians(-90 + 22.5 * c.i)))) AS d
 FROM f c JOIN f e ON e.t = c.t AND e.i = c.i AND e.j = (c.j + 1) % 12 JOIN f w ON w.t = c.t AND w.i = c.i AND w.j = (c.j + 11) % 12 LEFT JOIN f n ON n.t = c.t AND n.j = c.j AND n.i = c.i + 1 LEFT JOIN f s ON s.t = c.t AND s.j = c.j AND s.i = c.i - 1)"""


def flux_divergence(f: DataFrame, rows: int, cols: int, radius: float = 6371.0, by: tuple[str, ...] = ("t",)) -> DataFrame:
    """``by``, i, j, d, area: divergence of (qu, qv) on a periodic grid, face flux the mean of neighbours, none across the poles."""
    dla, dlo = 180.0 / rows, 360.0 / cols
    at = lambda di, dj, names: f.select(*by, (F.col("i") - di).alias("i"), F.pmod(F.col("j") - dj, F.lit(cols)).alias("j"), *[F.col(a).alias(b) for a, b in names])
    k = [*by, "i", "j"]
    g = f.join(at(0, 1, [("qu", "eu")]), k).join(at(0, -1, [("qu", "wu")]), k)
    g = g.join(at(1, 0, [("qv", "nv")]), k, "left").join(at(-1, 0, [("qv", "sv")]), k, "left")
    lat = lambda k: F.radians(F.lit(-90.0) + dla * (F.col("i") + k))
    zonal = (F.col("eu") - F.col("wu")) / 2 * (radius * math.radians(dla))
    merid = (F.coalesce((F.col("qv") + F.col("nv")) / 2, F.lit(0.0)) * F.cos(lat(1)) - F.coalesce((F.col("qv") + F.col("sv")) / 2, F.lit(0.0)) * F.cos(lat(0))) * (radius * math.radians(dlo))
    area = radius * radius * math.radians(dlo) * (F.sin(lat(1)) - F.sin(lat(0)))
    return g.select(*k, ((zonal + merid) / area).alias("d"), area.alias("area"))


def _flux(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").alias("t"), (F.col("l_partkey") * 31 % 8).cast("long").alias("i"), (F.col("l_suppkey") * 7 % 12).cast("long").alias("j")).agg(F.avg("l_quantity").alias("qu"), (F.avg("l_discount") * 100).alias("qv"))


@query(f"WITH {_G} SELECT t, i, j, round(d, 9) AS d FROM dv")
def moisture_divergence(spark, sf_dir):
    return flux_divergence(_flux(spark, sf_dir), 8, 12).select("t", "i", "j", F.round("d", 9).alias("d"))


@query(f"WITH {_G} SELECT t, (i // 2) * 3 + j // 4 AS region, round(sum(d * a) / sum(a), 9) + 0.0 AS convergence FROM (SELECT *, -6371.0 * 6371.0 * radians(30) * (sin(radians(-90 + 22.5 * (i + 1))) - sin(radians(-90 + 22.5 * i))) AS a FROM dv) GROUP BY 1, 2")
def regional_convergence(spark, sf_dir):
    d = flux_divergence(_flux(spark, sf_dir), 8, 12)
    return d.groupBy("t", (F.floor(F.col("i") / 2) * 3 + F.floor(F.col("j") / 4)).alias("region")).agg((F.round(F.sum(F.col("d") * F.col("area")) / F.sum("area"), 9) + 0.0).alias("convergence"))


@query("WITH f AS (SELECT year(l_shipdate) AS t, CAST(l_partkey * 31 % 8 AS BIGINT) AS i, l_quantity AS q, l_discount AS u FROM lineitem), w AS (SELECT *, cos(radians(-90 + 22.5 * (i + 0.5))) AS w FROM f) SELECT t, round(sum(w * q) / sum(w), 8) AS q, round(sum(w * q * u) / sum(w) - sum(w * q) / sum(w) * (sum(w * u) / sum(w)), 8) AS covariance FROM w GROUP BY 1")
def weighted_covariance(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("t"), F.cos(F.radians(F.lit(-90.0) + 22.5 * ((F.col("l_partkey") * 31 % 8) + 0.5))).alias("w"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("u"))
    w, q, u = F.col("w"), F.col("q"), F.col("u")
    m = lambda x: F.sum(w * x) / F.sum(w)
    return f.groupBy("t").agg(F.round(m(q), 8).alias("q"), F.round(m(q * u) - m(q) * m(u), 8).alias("covariance"))


@query(ctes("panel") + ", q AS (SELECT node, quantile_cont(temperature, 0.9) AS q FROM panel GROUP BY 1), e AS (SELECT p.node, p.t FROM panel p JOIN q USING (node) WHERE temperature >= q), a AS (SELECT t, node, wind - avg(wind) OVER (PARTITION BY node) AS w FROM panel) SELECT e.node AS target, a.node AS source, k.h AS steps, count(*) AS n, round(avg(a.w), 8) AS precursor FROM e CROSS JOIN (VALUES (1), (2), (4), (8)) k(h) JOIN a ON a.t = e.t - k.h GROUP BY 1, 2, 3")
def event_precursors(spark, sf_dir):
    p = panel(spark, sf_dir)
    q = p.groupBy("node").agg(F.percentile("temperature", 0.9).alias("q"))
    e = p.join(q, "node").filter("temperature >= q").select("t", F.col("node").alias("target")).withColumn("steps", F.explode(F.array(*[F.lit(k) for k in (1, 2, 4, 8)])))
    a = p.select(F.col("t").alias("at"), F.col("node").alias("source"), (F.col("wind") - F.avg("wind").over(Window.partitionBy("node"))).alias("w"))
    return e.withColumn("at", F.col("t") - F.col("steps")).join(a, "at").groupBy("target", "source", "steps").agg(F.count("*").alias("n"), F.round(F.avg("w"), 8).alias("precursor"))


@query("WITH x AS (SELECT c_mktseg, 2.0 * a - 1 AS s, o_totalprice / 1e4 AS y, 0.25 + 0.5 * (o_custkey % 3) / 2.0 AS e, a FROM (SELECT o.*, o_orderkey % 2 AS a, c_nationkey % 5 AS c_mktseg FROM orders o JOIN customer ON c_custkey = o_custkey)), p AS (SELECT c_mktseg AS g, CASE WHEN a = 1 THEN y / e ELSE -y / (1 - e) END AS z FROM x) SELECT g, count(*) AS n, round(avg(z), 7) AS effect, round(stddev_samp(z) / sqrt(count(*)), 7) AS se FROM p GROUP BY 1")
def weighted_effects(spark, sf_dir):
    """Inverse-probability effect of an arm with known propensity."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_nationkey") % 5).alias("g"))
    e = 0.25 + 0.5 * (F.col("o_custkey") % 3) / 2.0
    y = F.col("o_totalprice") / 1e4
    z = F.when(F.col("o_orderkey") % 2 == 1, y / e).otherwise(-y / (1 - e))
    return table(spark, sf_dir, "orders").join(c, "o_custkey").select("g", z.alias("z")).groupBy("g").agg(F.count("*").alias("n"), F.round(F.avg("z"), 7).alias("effect"), F.round(F.stddev_samp("z") / F.sqrt(F.count("*")), 7).alias("se"))
