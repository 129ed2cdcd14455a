"""Calendar, gaps, cleaning and standardising."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lagloom.operators import clean
from lagloom.plans import section
from lagloom.sources.fixtures import ctes, long_panel, panel, panel_events, panel_orders, panel_ship

QUERIES, query = section()

_LONG = "long AS (SELECT t, node, variable, value FROM panel UNPIVOT (value FOR variable IN (wind, humidity, cloud_cover, temperature)))"


def _dense_events(spark, sf_dir):
    e = panel_events(spark, sf_dir)
    ends = e.agg(F.min("t").alias("a"), F.max("t").alias("b"))
    times = ends.select(F.explode(F.sequence("a", "b")).alias("t"))
    return clean.dense(e, times, e.select("node", "variable").distinct())


_DENSE = """times AS (SELECT unnest(range((SELECT min(t) FROM panel_events), (SELECT max(t) FROM panel_events) + 1)) AS t),
dense AS (SELECT times.t, k.node, k.variable, p.value FROM times CROSS JOIN (SELECT DISTINCT node, variable FROM panel_events) k LEFT JOIN panel_events p ON p.t = times.t AND p.node = k.node AND p.variable = k.variable)"""


@query(ctes("panel_events") + """ SELECT node, variable, min(t) AS first_t, max(t) AS last_t, count(*) AS n, max(t) - min(t) + 1 AS expected, max(t) - min(t) + 1 - count(DISTINCT t) AS missing,
 count(*) - count(DISTINCT t) AS duplicated FROM panel_events GROUP BY 1, 2""")
def time_audit(spark, sf_dir):
    return panel_events(spark, sf_dir).groupBy("node", "variable").agg(
        F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count("*").alias("n"), (F.max("t") - F.min("t") + 1).alias("expected"),
        (F.max("t") - F.min("t") + 1 - F.count_distinct("t")).alias("missing"), (F.count("*") - F.count_distinct("t")).alias("duplicated"),
    )


@query(ctes("panel_ship") + """, s AS (SELECT flag, t, t - lag(t) OVER (PARTITION BY flag ORDER BY t) AS step FROM panel_ship)
 SELECT flag, count(*) FILTER (step = 1) AS regular, count(*) FILTER (step > 1) AS gaps, count(*) FILTER (step = 0) AS duplicates, count(*) FILTER (step < 0) AS reversals FROM s GROUP BY 1""")
def calendar_check(spark, sf_dir):
    step = F.col("t") - F.lag("t").over(Window.partitionBy("flag").orderBy("t"))
    s = panel_ship(spark, sf_dir).withColumn("step", step)
    n = lambda c: F.count(F.when(c, 1))
    return s.groupBy("flag").agg(n(F.col("step") == 1).alias("regular"), n(F.col("step") > 1).alias("gaps"), n(F.col("step") == 0).alias("duplicates"), n(F.col("step") < 0).alias("reversals"))


@query(ctes("panel_events") + f""", {_DENSE}, good AS (SELECT node FROM dense GROUP BY node HAVING avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) <= 0.2)
 SELECT node, variable, count(*) AS n, count(value) AS present FROM dense WHERE node IN (SELECT node FROM good) GROUP BY 1, 2""")
def drop_sparse_nodes(spark, sf_dir):
    return clean.drop_sparse(_dense_events(spark, sf_dir), "node").groupBy("node", "variable").agg(F.count("*").alias("n"), F.count("value").alias("present"))


@query(ctes("panel_events") + f""", {_DENSE},
 f AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER b AS tp, last_value(value IGNORE NULLS) OVER b AS vp,
  first_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER a AS tn, first_value(value IGNORE NULLS) OVER a AS vn FROM dense
  WINDOW b AS (PARTITION BY node, variable ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY node, variable ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
 SELECT t, node, variable, round(CASE WHEN value IS NOT NULL THEN value WHEN tp IS NULL THEN coalesce(vn, 0) WHEN tn IS NULL THEN vp
  ELSE vp + (vn - vp) * (CASE WHEN t - tp <= 6 OR tn - t <= 6 THEN t - tp ELSE 6 END) / (tn - tp) END, 8) AS value FROM f""")
def gap_fill(spark, sf_dir):
    return clean.fill_gaps(_dense_events(spark, sf_dir), ["node", "variable"], 6).withColumn("value", F.round("value", 8))


@query(ctes("panel", ) + f", {_LONG} SELECT t, node, variable, round(value - avg(value) OVER (PARTITION BY node, variable, t % 52), 7) AS value FROM long")
def climatology_anomaly(spark, sf_dir):
    return clean.anomaly(long_panel(panel(spark, sf_dir), "t", "node"), ["node", "variable"], F.col("t") % 52).withColumn("value", F.round("value", 7))


@query(ctes("panel_orders") + " SELECT t, node, round(price - avg(price) OVER (PARTITION BY node, month(ts)), 6) AS value FROM panel_orders")
def monthly_anomaly(spark, sf_dir):
    p = panel_orders(spark, sf_dir).select("t", "ts", "node", F.col("price").alias("value"))
    return clean.anomaly(p, ["node"], F.month("ts")).select("t", "node", F.round("value", 6).alias("value"))


@query(ctes("panel_ship") + " SELECT t, flag, round(price - avg(price) OVER (PARTITION BY flag ORDER BY t ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING), 6) AS value FROM panel_ship")
def rolling_anomaly(spark, sf_dir):
    p = panel_ship(spark, sf_dir).select("t", "flag", F.col("price").alias("value"))
    return clean.rolling_anomaly(p, ["flag"], 31).select("t", "flag", F.round("value", 6).alias("value"))


@query(ctes("panel") + f", {_LONG}, d AS (SELECT t, node, variable, value - lag(value) OVER w AS value, row_number() OVER w AS r FROM long WINDOW w AS (PARTITION BY node, variable ORDER BY t)) SELECT t, node, variable, round(value, 7) AS value FROM d WHERE r > 1")
def first_difference(spark, sf_dir):
    return clean.difference(long_panel(panel(spark, sf_dir), "t", "node"), ["node", "variable"]).withColumn("value", F.round("value", 7))


@query(ctes("panel") + f", {_LONG} SELECT t, node, variable, round((value - avg(value) OVER w) / CASE WHEN stddev_pop(value) OVER w < 1e-8 THEN 1 ELSE stddev_pop(value) OVER w END, 7) AS value FROM long WINDOW w AS (PARTITION BY node, variable)")
def z_score(spark, sf_dir):
    return clean.standardise(long_panel(panel(spark, sf_dir), "t", "node"), ["node", "variable"]).withColumn("value", F.round("value", 7))


_RECIPES = """a AS (SELECT t, node, variable, value - avg(value) OVER (PARTITION BY node, variable, t % 52) AS v FROM long),
p2 AS (SELECT t, node, variable, v - lag(v) OVER (PARTITION BY node, variable ORDER BY t) AS v FROM a),
p3 AS (SELECT t, node, variable, value - lag(value) OVER (PARTITION BY node, variable ORDER BY t) AS v FROM long),
p4 AS (SELECT t, node, variable, value - avg(value) OVER (PARTITION BY node, variable ORDER BY t ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING) AS v FROM long),
al AS (SELECT 'P1' AS setting, * FROM a UNION ALL SELECT 'P2', * FROM p2 WHERE v IS NOT NULL UNION ALL SELECT 'P3', * FROM p3 WHERE v IS NOT NULL UNION ALL SELECT 'P4', * FROM p4)"""


@query(ctes("panel") + f""", {_LONG}, {_RECIPES}, z AS (SELECT setting, variable, (v - avg(v) OVER w) / stddev_pop(v) OVER w AS z FROM al WINDOW w AS (PARTITION BY setting, node, variable))
 SELECT setting, variable, count(*) AS n, round(max(z), 6) AS high, round(min(z), 6) AS low FROM z GROUP BY 1, 2""")
def preprocessing_recipes(spark, sf_dir):
    long, keys = long_panel(panel(spark, sf_dir), "t", "node"), ["node", "variable"]
    monthly = clean.anomaly(long, keys, F.col("t") % 52)
    recipes = {"P1": monthly, "P2": clean.difference(monthly, keys), "P3": clean.difference(long, keys), "P4": clean.rolling_anomaly(long, keys, 31)}
    out = None
    for name, df in recipes.items():
        df = clean.standardise(df, keys).withColumn("setting", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out.groupBy("setting", "variable").agg(F.count("*").alias("n"), F.round(F.max("value"), 6).alias("high"), F.round(F.min("value"), 6).alias("low"))


@query(ctes("panel") + f""", {_LONG}, m AS (SELECT node, variable, t % 52 AS s, avg(value) AS m FROM long WHERE t < 250 GROUP BY 1, 2, 3),
 a AS (SELECT l.t, l.node, l.variable, l.value - m.m AS a FROM long l LEFT JOIN m ON m.node = l.node AND m.variable = l.variable AND m.s = l.t % 52),
 c AS (SELECT node, variable, avg(a) AS c, stddev_pop(a) AS sd FROM a WHERE t < 250 GROUP BY 1, 2)
 SELECT a.t, a.variable, round(avg((a - c) / CASE WHEN sd < 1e-8 THEN 1 ELSE sd END), 7) AS value FROM a JOIN c ON a.node = c.node AND a.variable = c.variable GROUP BY 1, 2""")
def train_fitted_transform(spark, sf_dir):
    p = clean.fit_transform(long_panel(panel(spark, sf_dir), "t", "node"), ["node", "variable"], F.col("t") % 52, F.col("t") < 250)
    return p.groupBy("t", "variable").agg(F.round(F.avg("value"), 7).alias("value"))


@query("""WITH h AS (SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS t, event_type AS variable, avg(value) AS value FROM events GROUP BY 1, 2),
 m AS (SELECT variable, t % 24 AS s, avg(value) AS m FROM h WHERE t % 7 < 5 GROUP BY 1, 2), a AS (SELECT h.t, h.variable, value - m AS a FROM h LEFT JOIN m ON m.variable = h.variable AND m.s = h.t % 24),
 c AS (SELECT variable, avg(a) AS c, stddev_pop(a) AS sd FROM a WHERE t % 7 < 5 GROUP BY 1)
 SELECT a.t, a.variable, round((a - c) / CASE WHEN sd < 1e-8 THEN 1 ELSE sd END, 7) AS value FROM a JOIN c ON a.variable = c.variable""")
def train_fitted_diurnal(spark, sf_dir):
    from lagloom.sources.fixtures import table

    t = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).cast("long")
    h = table(spark, sf_dir, "events").groupBy(t.alias("t"), F.col("event_type").alias("variable")).agg(F.avg("value").alias("value"))
    return clean.fit_transform(h, ["variable"], F.col("t") % 24, F.col("t") % 7 < 5).withColumn("value", F.round("value", 7))


@query(ctes("panel_ship") + """, c AS (SELECT flag, month(ts) AS m, count(*) AS n, sum(price) / count(*) AS mean FROM panel_ship GROUP BY 1, 2), d AS (SELECT p.flag, price - mean AS x FROM panel_ship p JOIN c ON p.flag = c.flag AND month(p.ts) = c.m)
 SELECT flag, count(*) AS n, round(sum(x) / count(*), 6) + 0.0 AS centre, round(greatest(sqrt(sum(x * x) / count(*)), 1e-8), 6) AS scale FROM d GROUP BY 1""")
def three_pass_statistics(spark, sf_dir):
    p = panel_ship(spark, sf_dir).withColumn("m", F.month("ts"))
    means = p.groupBy("flag", "m").agg((F.sum("price") / F.count("*")).alias("mean"))
    d = p.join(means, ["flag", "m"]).withColumn("x", F.col("price") - F.col("mean"))
    return d.groupBy("flag").agg(F.count("*").alias("n"), (F.round(F.sum("x") / F.count("*"), 6) + 0.0).alias("centre"), F.round(F.greatest(F.sqrt(F.sum(F.col("x") * F.col("x")) / F.count("*")), F.lit(1e-8)), 6).alias("scale"))


@query(ctes("panel_ship") + """, d AS (SELECT t, flag, price - avg(price) OVER (PARTITION BY flag, month(ts)) AS x FROM panel_ship WHERE t BETWEEN 300 AND 1200)
 SELECT t, flag, round(x / stddev_pop(x) OVER (PARTITION BY flag), 7) AS value FROM d""")
def window_standardise(spark, sf_dir):
    p = panel_ship(spark, sf_dir).filter("t between 300 and 1200").select("t", "ts", "flag", F.col("price").alias("value"))
    d = clean.anomaly(p, ["flag"], F.month("ts"))
    return d.select("t", "flag", F.round(F.col("value") / F.stddev_pop("value").over(Window.partitionBy("flag")), 7).alias("value"))


@query(ctes("panel_orders", "cells") + """ SELECT CASE WHEN abs(lat) < 23.5 THEN 'tropics' WHEN abs(lat) < 60 THEN 'midlatitude' ELSE 'polar' END AS band, (month(ts) + CASE WHEN lat < 0 THEN 6 ELSE 0 END) % 12 AS local_month,
 count(*) AS n, round(avg(price), 6) AS price FROM panel_orders JOIN cells USING (node) GROUP BY 1, 2""")
def band_climatology(spark, sf_dir):
    from lagloom.operators.spatial import band
    from lagloom.sources.fixtures import cells

    p = panel_orders(spark, sf_dir).join(F.broadcast(cells(spark, sf_dir)), "node")  # 25 cells
    month = F.pmod(F.month("ts") + F.when(F.col("lat") < 0, 6).otherwise(0), F.lit(12))
    return p.groupBy(band(F.col("lat")).alias("band"), month.alias("local_month")).agg(F.count("*").alias("n"), F.round(F.avg("price"), 6).alias("price"))


@query("""WITH h AS (SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS t, avg(value) AS value FROM events GROUP BY 1)
 SELECT b.t, round(0.5 * (a.value + b.value), 8) AS value FROM h b JOIN h a ON a.t = b.t - 1 WHERE b.t % 6 = 0""")
def centred_two_hour_mean(spark, sf_dir):
    from lagloom.sources.fixtures import table

    t = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).cast("long")
    h = table(spark, sf_dir, "events").groupBy(t.alias("t")).agg(F.avg("value").alias("value"))
    before = h.select((F.col("t") + 1).alias("t"), F.col("value").alias("before"))
    return h.filter("t % 6 = 0").join(before, "t").select("t", F.round(0.5 * (F.col("before") + F.col("value")), 8).alias("value"))


@query("""SELECT CAST(floor((floor(epoch(ts)) + 900) / 1800) * 1800 - 1800 AS BIGINT) AS slot, count(*) AS n, round(sum(value), 6) AS total FROM events WHERE hour(ts) IN (0, 6, 12, 18) GROUP BY 1""")
def nominal_slots(spark, sf_dir):
    from lagloom.sources.fixtures import table

    s = F.unix_seconds(F.col("ts").cast("timestamp"))
    e = table(spark, sf_dir, "events").filter(F.hour("ts").isin(0, 6, 12, 18))
    return e.groupBy((F.floor((s + 900) / 1800) * 1800 - 1800).cast("long").alias("slot")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
