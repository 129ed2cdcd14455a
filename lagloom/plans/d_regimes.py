"""Regimes, states, periods and sample eligibility."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from lagloom.plans import section
from lagloom.sources.fixtures import cells, ctes, panel, panel_orders, panel_ship

QUERIES, query = section()


def season(month: Column) -> Column:
    """DJF, MAM, JJA or SON."""
    return F.when(month.isin(12, 1, 2), "DJF").when(month.isin(3, 4, 5), "MAM").when(month.isin(6, 7, 8), "JJA").otherwise("SON")


_SEASON = "CASE WHEN month(ts) IN (12, 1, 2) THEN 'DJF' WHEN month(ts) IN (3, 4, 5) THEN 'MAM' WHEN month(ts) IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END"


@query(ctes("panel_ship") + f" SELECT {_SEASON} AS regime, count(DISTINCT t) AS n, min(t) AS first_t, max(t) AS last_t FROM panel_ship GROUP BY 1")
def season_regimes(spark, sf_dir):
    return panel_ship(spark, sf_dir).groupBy(season(F.month("ts")).alias("regime")).agg(F.count_distinct("t").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


_STATE = "m AS (SELECT t, avg(humidity) AS x FROM panel GROUP BY 1), q AS (SELECT quantile_cont(x, 0.2) AS lo, quantile_cont(x, 0.8) AS hi FROM m), st AS (SELECT t, x, CASE WHEN x <= lo THEN 'low' WHEN x >= hi THEN 'high' ELSE 'normal' END AS state FROM m, q)"


def quantile_states(df, value: str, low: float = 0.2, high: float = 0.8):
    """t, x and state from quantiles of the spatial mean."""
    m = df.groupBy("t").agg(F.avg(value).alias("x"))
    q = m.agg(F.percentile("x", F.array(F.lit(low), F.lit(high))).alias("q"))
    state = F.when(F.col("x") <= F.col("q")[0], "low").when(F.col("x") >= F.col("q")[1], "high").otherwise("normal")
    return m.crossJoin(F.broadcast(q)).select("t", "x", state.alias("state"))  # one row


@query(ctes("panel") + f", {_STATE} SELECT t, state FROM st")
def humidity_states(spark, sf_dir):
    return quantile_states(panel(spark, sf_dir), "humidity").select("t", "state")


@query(ctes("panel") + f""", {_STATE}, reg AS (SELECT 'all' AS regime, t FROM st UNION ALL SELECT 'humidity_' || state, t FROM st WHERE state <> 'low' UNION ALL SELECT 'season_' || (t % 52 // 13), t FROM st)
 SELECT regime, count(*) AS n, min(t) AS first_t FROM reg GROUP BY 1""")
def regime_membership(spark, sf_dir):
    st = quantile_states(panel(spark, sf_dir), "humidity")
    reg = (
        st.select(F.lit("all").alias("regime"), "t")
        .unionByName(st.filter("state <> 'low'").select(F.concat(F.lit("humidity_"), "state").alias("regime"), "t"))
        .unionByName(st.select(F.concat(F.lit("season_"), F.floor(F.col("t") % 52 / 13).cast("string")).alias("regime"), "t"))
    )
    return reg.groupBy("regime").agg(F.count("*").alias("n"), F.min("t").alias("first_t"))


@query(ctes("panel") + """, m AS (SELECT t, avg(humidity) AS x FROM panel GROUP BY 1), q AS (SELECT quantile_cont(x, 0.2) AS lo, quantile_cont(x, 0.8) AS hi FROM m WHERE t < 250)
 SELECT m.t, CASE WHEN b.x IS NULL THEN 'missing' WHEN b.x <= lo THEN 'low' WHEN b.x >= hi THEN 'high' ELSE 'normal' END AS antecedent FROM m CROSS JOIN q LEFT JOIN m b ON b.t = m.t - 4""")
def antecedent_states(spark, sf_dir):
    m = panel(spark, sf_dir).groupBy("t").agg(F.avg("humidity").alias("x"))
    q = m.filter("t < 250").agg(F.percentile("x", F.array(F.lit(0.2), F.lit(0.8))).alias("q"))
    b = m.select((F.col("t") + 4).alias("t"), F.col("x").alias("b")).join(m.select("t"), "t", "right")
    state = F.when(F.col("b").isNull(), "missing").when(F.col("b") <= F.col("q")[0], "low").when(F.col("b") >= F.col("q")[1], "high").otherwise("normal")
    return b.crossJoin(F.broadcast(q)).select("t", state.alias("antecedent"))  # one row


_INDEX = "ix AS (SELECT t AS month, avg(price) AS v FROM panel_orders GROUP BY 1), q AS (SELECT quantile_cont(v, 0.2) AS lo, quantile_cont(v, 0.8) AS hi FROM ix WHERE month < 48), im AS (SELECT month, v, CASE WHEN v <= lo THEN 0 WHEN v >= hi THEN 2 ELSE 1 END AS state FROM ix, q)"


def index_states(spark, sf_dir):
    """Monthly index with its state from quantiles of the training months."""
    ix = panel_orders(spark, sf_dir).groupBy(F.col("t").alias("month")).agg(F.avg("price").alias("v"))
    q = ix.filter("month < 48").agg(F.percentile("v", F.array(F.lit(0.2), F.lit(0.8))).alias("q"))
    state = F.when(F.col("v") <= F.col("q")[0], 0).when(F.col("v") >= F.col("q")[1], 2).otherwise(1)
    return ix.crossJoin(F.broadcast(q)).select("month", "v", state.alias("state"))  # one row


@query(ctes("panel_orders") + f", {_INDEX} SELECT month, round(v, 6) AS v, state FROM im")
def external_index_states(spark, sf_dir):
    return index_states(spark, sf_dir).withColumn("v", F.round("v", 6))


_ASOF = """a AS (SELECT DISTINCT s.ts, s.t, (year(s.ts - INTERVAL 1 DAY) - 1995) * 12 + month(s.ts - INTERVAL 1 DAY) - 2 AS month FROM panel_ship s), st AS (SELECT a.t, a.ts, a.month, coalesce(im.state, 3) AS state FROM a LEFT JOIN im ON im.month = a.month)"""


def asof_states(spark, sf_dir):
    """State of the month before that of a day ago; 3 where the index has no such month."""
    day = F.date_sub("ts", 1)
    a = panel_ship(spark, sf_dir).select("ts", "t").distinct().withColumn("month", ((F.year(day) - 1995) * 12 + F.month(day) - 2).cast("long"))
    return a.join(index_states(spark, sf_dir).select("month", "state"), "month", "left").select("t", "ts", "month", F.coalesce("state", F.lit(3)).alias("state"))


@query(ctes("panel_orders", "panel_ship") + f", {_INDEX}, {_ASOF} SELECT t, month, state FROM st")
def asof_index_state(spark, sf_dir):
    return asof_states(spark, sf_dir).select("t", "month", "state")


@query(ctes("panel_orders", "panel_ship") + f""", {_INDEX}, {_ASOF}, e AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY state ORDER BY t) = 1 THEN 0 ELSE 1 END AS fresh FROM st)
 SELECT state, count(*) AS n, count(DISTINCT month) AS months, sum(fresh)::BIGINT AS episodes FROM e GROUP BY 1""")
def state_population(spark, sf_dir):
    before = F.lag("t").over(Window.partitionBy("state").orderBy("t"))
    e = asof_states(spark, sf_dir).withColumn("fresh", F.when(F.col("t") - before == 1, 0).otherwise(1))
    return e.groupBy("state").agg(F.count("*").alias("n"), F.count_distinct("month").alias("months"), F.sum("fresh").alias("episodes"))


@query(ctes("panel_orders", "cells") + """ SELECT node, ts, CASE WHEN (lat >= 0 AND month(ts) IN (12, 1, 2)) OR (lat < 0 AND month(ts) IN (6, 7, 8)) THEN 'winter' ELSE 'summer' END AS local_season
 FROM panel_orders JOIN cells USING (node) WHERE month(ts) IN (12, 1, 2, 6, 7, 8)""")
def hemisphere_seasons(spark, sf_dir):
    p = panel_orders(spark, sf_dir).join(F.broadcast(cells(spark, sf_dir)), "node").filter(F.month("ts").isin(12, 1, 2, 6, 7, 8))
    north, djf = F.col("lat") >= 0, F.month("ts").isin(12, 1, 2)
    return p.select("node", "ts", F.when(north == djf, "winter").otherwise("summer").alias("local_season"))


@query(ctes("panel_orders", "cells") + " SELECT node, t, CAST((floor((month(ts) % 12) / 3) + CASE WHEN lat >= 0 THEN 0 ELSE 2 END) % 4 AS BIGINT) AS season, count(*) AS n FROM panel_orders JOIN cells USING (node) GROUP BY 1, 2, 3")
def local_season_label(spark, sf_dir):
    p = panel_orders(spark, sf_dir).join(F.broadcast(cells(spark, sf_dir)), "node")
    s = F.pmod(F.floor(F.month("ts") % 12 / 3) + F.when(F.col("lat") >= 0, 0).otherwise(2), F.lit(4)).cast("long")
    return p.groupBy("node", "t", s.alias("season")).agg(F.count("*").alias("n"))


_PERIODS = (("early", "1995-01-01", "1996-12-31"), ("middle", "1997-01-01", "1998-12-31"), ("late", "1999-01-01", "2001-12-31"), ("full", "1995-01-01", "2001-12-31"))


@query(ctes("panel_ship") + """ SELECT p.name AS period, flag, count(*) AS n, round(avg(price), 6) AS price FROM panel_ship JOIN (VALUES """ + ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in _PERIODS) + """) p(name, a, b) ON ts BETWEEN a AND b GROUP BY 1, 2""")
def period_masks(spark, sf_dir):
    p = panel_ship(spark, sf_dir)
    name = F.explode(F.filter(F.array(*[F.when(F.col("ts").between(F.lit(a).cast("date"), F.lit(b).cast("date")), F.lit(n)) for n, a, b in _PERIODS]), lambda x: x.isNotNull()))
    return p.withColumn("period", name).groupBy("period", "flag").agg(F.count("*").alias("n"), F.round(F.avg("price"), 6).alias("price"))


_ELIGIBLE = """c AS (SELECT t, flag, t // 365 AS split, t // 100 AS segment FROM panel_ship), w AS (SELECT *, count(*) OVER v AS n, min(t) OVER v AS a, max(t) OVER v AS b, min(split) OVER v AS s0, max(split) OVER v AS s1, min(segment) OVER v AS g0, max(segment) OVER v AS g1
 FROM c WINDOW v AS (PARTITION BY flag ORDER BY t ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING))"""


@query(ctes("panel_ship") + f""", {_ELIGIBLE} SELECT flag, count(*) AS n, count(*) FILTER (n = 4 AND b - a = 3) AS full_window, count(*) FILTER (n = 4 AND b - a = 3 AND s0 = s1) AS same_split,
 count(*) FILTER (n = 4 AND b - a = 3 AND s0 = s1 AND g0 = g1) AS eligible FROM w GROUP BY 1""")
def eligibility_ledger(spark, sf_dir):
    v = Window.partitionBy("flag").orderBy("t").rowsBetween(-2, 1)
    c = panel_ship(spark, sf_dir).select("t", "flag", F.floor(F.col("t") / 365).alias("split"), F.floor(F.col("t") / 100).alias("segment"))
    c = c.withColumn("full", (F.count("*").over(v) == 4) & (F.max("t").over(v) - F.min("t").over(v) == 3))
    c = c.withColumn("split_ok", F.col("full") & (F.min("split").over(v) == F.max("split").over(v))).withColumn("ok", F.col("split_ok") & (F.min("segment").over(v) == F.max("segment").over(v)))
    return c.groupBy("flag").agg(F.count("*").alias("n"), F.count_if("full").alias("full_window"), F.count_if("split_ok").alias("same_split"), F.count_if("ok").alias("eligible"))


@query(ctes("panel_ship") + """, x AS (SELECT DISTINCT t, t // 100 AS seg FROM panel_ship), j AS (SELECT x.t, x.seg, a.seg AS sa, b.seg AS sb FROM x LEFT JOIN x a ON a.t = x.t - 8 LEFT JOIN x b ON b.t = x.t + 4)
 SELECT CASE WHEN t < 1400 THEN 'train' WHEN t < 1900 THEN 'val' ELSE 'test' END AS split, count(*) AS n, count(*) FILTER (seg = sa AND seg = sb) AS kept FROM j GROUP BY 1""")
def split_index(spark, sf_dir):
    x = panel_ship(spark, sf_dir).select("t", F.floor(F.col("t") / 100).alias("seg")).distinct()
    at = lambda d, n: x.select((F.col("t") + d).alias("t"), F.col("seg").alias(n))
    j = x.join(at(8, "sa"), "t", "left").join(at(-4, "sb"), "t", "left")
    split = F.when(F.col("t") < 1400, "train").when(F.col("t") < 1900, "val").otherwise("test")
    return j.groupBy(split.alias("split")).agg(F.count("*").alias("n"), F.count_if((F.col("seg") == F.col("sa")) & (F.col("seg") == F.col("sb"))).alias("kept"))


@query(ctes("panel") + ", q AS (SELECT node, quantile_cont(temperature, 0.9) AS q FROM panel GROUP BY 1) SELECT p.node, p.t FROM panel p JOIN q USING (node) WHERE temperature >= q")
def extreme_events(spark, sf_dir):
    p = panel(spark, sf_dir)
    q = p.groupBy("node").agg(F.percentile("temperature", 0.9).alias("q"))
    return p.join(q, "node").filter("temperature >= q").select("node", "t")


@query("""SELECT s.slice AS slice, count(*) AS n, round(avg(l_quantity), 8) AS q FROM lineitem, (VALUES (0), (1), (2)) k(i), LATERAL (SELECT CASE i WHEN 0 THEN 'all' WHEN 1 THEN 'mode=' || l_returnflag ELSE 'season=' || (month(l_shipdate) % 12 // 3) END AS slice) s GROUP BY 1""")
def evaluation_slices(spark, sf_dir):
    from lagloom.sources.fixtures import table

    li = table(spark, sf_dir, "lineitem")
    slices = F.explode(F.array(F.lit("all"), F.concat(F.lit("mode="), "l_returnflag"), F.concat(F.lit("season="), F.floor(F.month("l_shipdate") % 12 / 3).cast("string"))))
    return li.select(slices.alias("slice"), "l_quantity").groupBy("slice").agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 8).alias("q"))
