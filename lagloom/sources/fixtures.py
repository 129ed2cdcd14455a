"""Panels, grids and edge tables derived from the order, event and nation tables.

Each view has a Spark form and, in ``SQL``, the same definition for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagloom.operators import clean, panels, screen, spatial
from lagloom.operators.lineage import stored
from lagloom.sources.ship import ship

VARIABLES = ("wind", "humidity", "cloud_cover", "temperature")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sources(sf_dir: str, *names: str) -> list[str]:
    """Paths of tables, as stored() takes them."""
    return [f"{sf_dir}/{n}.parquet" for n in names]


def day_number(ts: Column, origin: str = "1995-01-01") -> Column:
    return F.datediff(ts.cast("date"), F.lit(origin).cast("date"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly panel of five nodes: t, node and four variables."""
    li = table(spark, sf_dir, "lineitem")
    t = F.floor(day_number(F.col("l_shipdate")) / 7).cast("long")
    return li.groupBy(t.alias("t"), (F.col("l_suppkey") % 5).cast("long").alias("node")).agg(
        F.avg("l_quantity").alias("wind"), F.avg("l_discount").alias("humidity"), F.avg("l_tax").alias("cloud_cover"), F.avg("l_extendedprice").alias("temperature")
    )


def long_panel(wide: DataFrame, *ids: str, variables: tuple[str, ...] = VARIABLES) -> DataFrame:
    return wide.unpivot(list(ids), list(variables), "variable", "value")


def panel_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly panel of 25 nodes from orders: t (months since January 1995), node, ts, n, total, price, share_f."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("node"))
    ts = F.date_trunc("month", F.col("o_orderdate"))
    return (
        o.join(c, o.o_custkey == c.c_custkey)
        .groupBy(ts.cast("date").alias("ts"), "node")
        .agg(
            F.count("*").alias("n"), F.sum("o_totalprice").alias("total"), F.avg("o_totalprice").alias("price"),
            F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)).alias("share_f"),
        )
        .withColumn("t", ((F.year("ts") - 1995) * 12 + F.month("ts") - 1).cast("long"))
    )


def panel_ship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily panel by return flag: t (days since 1995-01-01), ts, flag, qty, disc, tax, price."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_shipdate").cast("date").alias("ts"), F.col("l_returnflag").alias("flag")).agg(
        F.sum("l_quantity").alias("qty"), F.avg("l_discount").alias("disc"), F.avg("l_tax").alias("tax"), F.avg("l_extendedprice").alias("price")
    ).withColumn("t", day_number(F.col("ts")).cast("long"))


def panel_events(spark: SparkSession, sf_dir: str, hours: int = 6) -> DataFrame:
    """Event values by ``hours``-hour bucket, node = user_id % 4 and event type."""
    e = table(spark, sf_dir, "events")
    t = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / (3600 * hours)).cast("long")
    return e.groupBy(t.alias("t"), (F.col("user_id") % 4).cast("long").alias("node"), F.col("event_type").alias("variable")).agg(F.avg("value").alias("value"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 nodes with coordinates."""
    n = F.col("n_nationkey").cast("long")
    return table(spark, sf_dir, "nation").select(
        n.alias("node"), (F.lit(-85.0) + F.lit(170.0) * ((n * 7) % 25) / F.lit(24.0)).alias("lat"), (F.lit(-180.0) + F.lit(360.0) * ((n * 11) % 25) / F.lit(25.0)).alias("lon")
    )


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One node for each supplier with coordinates from its key; keys 2j and 2j + 1 mirror each other across the equator."""
    k = F.col("s_suppkey").cast("long")
    j = F.floor(k / 2).cast("long")
    lat = F.lit(2.5) + F.lit(80.0) * ((j * 414214) % 1000003) / F.lit(1000003.0)
    return table(spark, sf_dir, "supplier").select(
        k.alias("node"), F.when(k % 2 == 0, lat).otherwise(-lat).alias("lat"), (F.lit(-180.0) + F.lit(360.0) * ((j * 618034) % 1000003) / F.lit(1000003.0)).alias("lon")
    )


def station_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standardised weekly anomalies of every supplier, gaps filled: node, first and an array for each variable. Stored once."""

    def make():
        apart = spark.conf.get("spark.sql.requireAllClusterKeysForDistribution") == "true"  # then weeks of a node are dealt out too
        return panels.climate(_station_panel(spark, sf_dir), list(VARIABLES), weeks(spark, sf_dir), dealt=not apart)

    return stored(spark, "bundles", sources(sf_dir, "lineitem"), make)


def station_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as node, variable, first, values, as screen.series() gives them."""
    return panels.unbundled(station_bundles(spark, sf_dir))


def station_climate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a row for each step: t, node, variable, value. Stored once, as joins need its size."""
    return stored(spark, "station-climate", sources(sf_dir, "lineitem"), lambda: panels.steps(station_series(spark, sf_dir)))


def _week() -> Column:
    return F.floor(day_number(F.col("l_shipdate")) / 7).cast("long")


def weeks(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """First week of lineitem and number of weeks."""
    return panels.calendar(table(spark, sf_dir, "lineitem").select(_week().alias("t")))


def _station_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t, node and four variables, dealt by node: rows of lineitem are shuffled once, hardly more of them than weeks of a supplier."""
    li = table(spark, sf_dir, "lineitem").select(_week().alias("t"), F.col("l_suppkey").cast("long").alias("node"), "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    return li.repartition("node").groupBy("t", "node").agg(
        F.avg("l_quantity").alias("wind"), F.avg("l_discount").alias("humidity"), F.avg("l_tax").alias("cloud_cover"), F.avg("l_extendedprice").alias("temperature")
    )


def climate_of(wide: DataFrame) -> DataFrame:
    """A panel of the four variables in long form, dense in t, gaps filled, as standardised weekly anomalies."""
    long = long_panel(wide, "t", "node")
    ends = long.agg(F.min("t").alias("a"), F.max("t").alias("b"))
    grid = clean.dense(long, ends.select(F.explode(F.sequence("a", "b")).alias("t")), long.select("node", "variable").distinct())
    return clean.weekly_climate(clean.fill_gaps(grid, ["node", "variable"], 6), ["node", "variable"])


#: Variable pairs of the tested edges.
EDGE_TYPES = (("wind", "humidity"), ("humidity", "cloud_cover"), ("wind", "cloud_cover"))


def station_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each station with itself and with its two nearest ones, both ways, for every variable pair."""
    st = stations(spark, sf_dir)
    near = spatial.nearest(st, 2).select("source", "target")
    both = near.union(near.select("target", "source")).union(st.select("node", "node")).distinct().toDF("source_region", "target_region")
    pair = F.explode(F.array(*[F.struct(F.lit(a).alias("source_var"), F.lit(b).alias("target_var")) for a, b in EDGE_TYPES]))
    return both.withColumn("v", pair).select("source_region", "target_region", "v.*")


def tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All station candidates tested at lags 1 to 3 in winter and summer, with HAC errors. Stored once."""
    used = sorted({v for pair in EDGE_TYPES for v in pair})
    make = lambda: screen.screen(station_candidates(spark, sf_dir), panels.unbundled(station_bundles(spark, sf_dir).select("node", "first", *used)))
    return stored(spark, "station-tests", sources(sf_dir, "lineitem", "supplier"), make)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tests as edges: KEY, regime, p_value, effect (both rounded, so that reports agree to the last digit), edge_type."""
    return tests(spark, sf_dir).filter("effect is not null").select(
        "source_region", "target_region", "source_var", "target_var", "lag", "regime", F.round("p_value", 7).alias("p_value"), F.round("effect", 6).alias("effect"),
        F.concat_ws("->", "source_var", "target_var").alias("edge_type"),
    )


def normal_tail_sql(z: str) -> str:
    """Two-sided tail of the normal distribution: the series of the error function with positive terms, for the oracle."""
    x = f"(abs({z}) / sqrt(2.0))"
    terms = f"list_sum(list_transform(range(0, 120), lambda k: exp((2 * k + 1) * ln(greatest({x}, 1e-300)) + (2 * k) * ln(2.0) + lgamma(k + 1.0) - lgamma(2 * k + 2.0) - {x} * {x})))"
    return f"(CASE WHEN abs({z}) > 8 THEN 0.0 ELSE greatest(0.0, 1 - 2 / sqrt(pi()) * {terms}) END)"


HAV_SQL = "2 * 6371.0 * asin(sqrt(least(greatest(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2), 0), 1)))"


def climate_sql(src: str, name: str) -> str:
    """The steps of climate_of() for a panel ``src``; ends in ``name`` (t, node, variable, v)."""
    p = name + "_"
    return f"""{p}l AS (SELECT t, node, variable, value FROM {src} UNPIVOT (value FOR variable IN (wind, humidity, cloud_cover, temperature))),
{p}g AS (SELECT tt.t, k.node, k.variable, l.value FROM (SELECT unnest(range((SELECT min(t) FROM {p}l), (SELECT max(t) FROM {p}l) + 1)) AS t) tt CROSS JOIN (SELECT DISTINCT node, variable FROM {p}l) k LEFT JOIN {p}l l ON l.t = tt.t AND l.node = k.node AND l.variable = k.variable),
{p}f AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER b AS tp, last_value(value IGNORE NULLS) OVER b AS vp, first_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER f AS tn, first_value(value IGNORE NULLS) OVER f AS vn FROM {p}g
 WINDOW b AS (PARTITION BY node, variable ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY node, variable ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
{p}v AS (SELECT t, node, variable, CASE WHEN value IS NOT NULL THEN value WHEN tp IS NULL THEN coalesce(vn, 0) WHEN tn IS NULL THEN vp ELSE vp + (vn - vp) * (CASE WHEN t - tp <= 6 OR tn - t <= 6 THEN t - tp ELSE 6 END) / (tn - tp) END AS value FROM {p}f),
{p}a AS (SELECT t, node, variable, value - avg(value) OVER (PARTITION BY node, variable, t % 52) AS a FROM {p}v),
{name} AS MATERIALIZED (SELECT t, node, variable, coalesce((a - avg(a) OVER w) / (CASE WHEN stddev_pop(a) OVER w < 1e-8 THEN 1 ELSE stddev_pop(a) OVER w END), 0) AS v FROM {p}a WINDOW w AS (PARTITION BY node, variable))"""


SQL = {
    "panel": """panel AS (SELECT CAST(floor(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) / 7) AS BIGINT) AS t, CAST(l_suppkey % 5 AS BIGINT) AS node,
  avg(l_quantity) AS wind, avg(l_discount) AS humidity, avg(l_tax) AS cloud_cover, avg(l_extendedprice) AS temperature FROM lineitem GROUP BY 1, 2)""",
    "panel_orders": """panel_orders AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS ts, CAST(c_nationkey AS BIGINT) AS node, count(*) AS n, sum(o_totalprice) AS total, avg(o_totalprice) AS price,
  avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS share_f, CAST((year(CAST(date_trunc('month', o_orderdate) AS DATE)) - 1995) * 12 + month(CAST(date_trunc('month', o_orderdate) AS DATE)) - 1 AS BIGINT) AS t
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 7)""",
    "panel_ship": """panel_ship AS (SELECT CAST(l_shipdate AS DATE) AS ts, l_returnflag AS flag, sum(l_quantity) AS qty, avg(l_discount) AS disc, avg(l_tax) AS tax, avg(l_extendedprice) AS price,
  CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS t FROM lineitem GROUP BY 1, 2, 7)""",
    "panel_events": """panel_events AS (SELECT CAST(floor(epoch(ts) / 21600) AS BIGINT) AS t, CAST(user_id % 4 AS BIGINT) AS node, event_type AS variable, avg(value) AS value FROM events GROUP BY 1, 2, 3)""",
    "cells": """cells AS (SELECT CAST(n_nationkey AS BIGINT) AS node, CAST(-85.0 AS DOUBLE) + CAST(170.0 AS DOUBLE) * ((n_nationkey * 7) % 25) / CAST(24.0 AS DOUBLE) AS lat,
  CAST(-180.0 AS DOUBLE) + CAST(360.0 AS DOUBLE) * ((n_nationkey * 11) % 25) / CAST(25.0 AS DOUBLE) AS lon FROM nation)""",
    "stations": """cells AS MATERIALIZED (SELECT s_suppkey::BIGINT AS node, CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE -1 END * (CAST(2.5 AS DOUBLE) + CAST(80.0 AS DOUBLE) * ((s_suppkey // 2 * 414214) % 1000003) / CAST(1000003.0 AS DOUBLE)) AS lat,
  CAST(-180.0 AS DOUBLE) + CAST(360.0 AS DOUBLE) * ((s_suppkey // 2 * 618034) % 1000003) / CAST(1000003.0 AS DOUBLE) AS lon FROM supplier)""",
    "station_climate": """sp AS (SELECT CAST(floor(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) / 7) AS BIGINT) AS t, l_suppkey::BIGINT AS node,
  avg(l_quantity) AS wind, avg(l_discount) AS humidity, avg(l_tax) AS cloud_cover, avg(l_extendedprice) AS temperature FROM lineitem GROUP BY 1, 2),
""" + climate_sql("sp", "sc"),
    "neighbours": f"""near2 AS (SELECT source, target FROM (SELECT a.node AS source, b.node AS target, row_number() OVER (PARTITION BY b.node ORDER BY {HAV_SQL}, a.node) AS r FROM cells a, cells b WHERE a.node <> b.node) WHERE r <= 2),
cand2 AS (SELECT source AS s, target AS g FROM near2 UNION SELECT target, source FROM near2 UNION SELECT node, node FROM cells)""",
    "tests": f"""ct AS MATERIALIZED (SELECT s, g, sv, tv FROM cand2 CROSS JOIN (VALUES {", ".join(f"('{a}', '{b}')" for a, b in EDGE_TYPES)}) e(sv, tv)),
yo AS MATERIALIZED (SELECT t, node, variable, v, lag(v) OVER (PARTITION BY node, variable ORDER BY t) AS o FROM sc), xl AS MATERIALIZED (SELECT node, variable, t + lag AS t, lag::BIGINT AS lag, v FROM sc, (VALUES (1), (2), (3)) k(lag)),
td AS MATERIALIZED (SELECT y.t, s AS source_region, g AS target_region, sv AS source_var, tv AS target_var, x.lag, CASE WHEN y.t % 52 < 26 THEN 'winter' ELSE 'summer' END AS regime, y.v AS y, y.o AS c, x.v AS z
  FROM ct JOIN yo y ON y.node = g AND y.variable = tv JOIN xl x ON x.node = s AND x.variable = sv AND x.t = y.t WHERE y.o IS NOT NULL),
tf AS (SELECT *, szz - scz * scz / scc AS zss, syz - scz * syc / scc AS zy, syy - syc * syc / scc AS rss_r, n - 3 AS df FROM (SELECT source_region, target_region, source_var, target_var, lag, regime, count(*) AS n, covar_pop(y, y) * count(*) AS syy, covar_pop(c, c) * count(*) AS scc, covar_pop(z, z) * count(*) AS szz,
  covar_pop(y, c) * count(*) AS syc, covar_pop(y, z) * count(*) AS syz, covar_pop(c, z) * count(*) AS scz, avg(y) AS my, avg(c) AS mc, avg(z) AS mz FROM td GROUP BY ALL)),
ts AS (SELECT d.source_region, d.target_region, d.source_var, d.target_var, d.lag, d.regime, d.t, ((z - mz) - scz / scc * (c - mc)) * (((y - my) - syc / scc * (c - mc)) - zy / zss * ((z - mz) - scz / scc * (c - mc))) AS s FROM td d JOIN tf f USING (source_region, target_region, source_var, target_var, lag, regime)),
tm AS (SELECT source_region, target_region, source_var, target_var, lag, regime, sum(s * (s + 2 * ((1 - t / 5.0) * coalesce(s0, 0) + coalesce(s1, 0) / 5.0))) AS meat FROM (SELECT *, sum(s) OVER w AS s0, sum(s * t) OVER w AS s1 FROM ts WINDOW w AS (PARTITION BY source_region, target_region, source_var, target_var, lag, regime ORDER BY t RANGE BETWEEN 4 PRECEDING AND 1 PRECEDING)) GROUP BY ALL),
tests AS MATERIALIZED (SELECT source_region, target_region, source_var, target_var, lag, regime, n, zy / zss AS effect, sqrt((rss_r - zy * zy / zss) / df / zss) AS se_ols, sqrt(meat * n / df) / zss AS se_hac, zy / sqrt(meat * n / df) AS z_hac, zy * zy / zss / rss_r AS partial_r2 FROM tf JOIN tm USING (source_region, target_region, source_var, target_var, lag, regime))""",
    "edges": f"""edges AS MATERIALIZED (SELECT source_region, target_region, source_var, target_var, lag, regime, round({normal_tail_sql("z_hac")}, 7) AS p_value, round(effect, 6) AS effect, source_var || '->' || target_var AS edge_type FROM tests)""",
}

_NEEDS = {"neighbours": ("stations",), "tests": ("neighbours", "station_climate"), "edges": ("tests",)}


def ctes(*names: str) -> str:
    """WITH clause of the named views and of those they read, to which a query appends its own."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in _NEEDS.get(n, ()):
            add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(SQL[n] for n in order)
