"""Spatial operators: regions, distances, bearings, regridding."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lagloom.operators import spatial
from lagloom.plans import section
from lagloom.sources.fixtures import cells, ctes, panel, panel_orders, stations

QUERIES, query = section()

_HAV = """2 * 6371.0 * asin(sqrt(least(greatest(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2), 0), 1)))"""
_PAIRS = "pairs AS (SELECT a.node AS source, b.node AS target, " + _HAV.format(a="a", b="b") + " AS km, a.lat AS lat1, a.lon AS lon1, b.lat AS lat2, b.lon AS lon2 FROM cells a, cells b)"
_BAND = "CASE WHEN abs(lat) < 23.5 THEN 'tropics' WHEN abs(lat) < 60 THEN 'midlatitude' ELSE 'polar' END"
_BIN = "CAST(least(floor((least(greatest(lat, -90), 90) + 90) / 180 * 2), 1) * 4 + least(floor(((lon % 360) + 360) % 360 / 360 * 4), 3) AS BIGINT)"


@query(ctes("stations") + f" SELECT node, {_BIN} AS region FROM cells")
def latlon_bins(spark, sf_dir):
    return stations(spark, sf_dir).select("node", spatial.bins(F.col("lat"), F.col("lon"), 8).alias("region"))


@query(ctes("stations") + " SELECT node, CAST(floor(node * 6 / (SELECT count(*) FROM cells)) AS BIGINT) AS region FROM cells")
def equal_chunks(spark, sf_dir):
    c = stations(spark, sf_dir)
    n = c.agg(F.count("*").alias("n"))
    return c.crossJoin(F.broadcast(n)).select("node", F.floor(F.col("node") * 6 / F.col("n")).cast("long").alias("region"))  # one row


@query(ctes("stations") + f" SELECT node, dense_rank() OVER (ORDER BY {_BIN}) - 1 AS region FROM cells")
def consecutive_labels(spark, sf_dir):
    label = spatial.bins(F.col("lat"), F.col("lon"), 8)
    c = stations(spark, sf_dir).withColumn("label", label)
    number = c.groupBy("label").count().select("label", (F.dense_rank().over(Window.orderBy("label")) - 1).alias("region"))  # one row per label
    return c.join(F.broadcast(number), "label").select("node", "region")


@query(ctes("panel_orders", "cells") + f", r AS (SELECT *, {_BIN} AS region FROM cells) SELECT t, region, round(avg(price), 6) AS price, round(avg(share_f), 8) AS share_f, count(DISTINCT node) AS nodes FROM panel_orders JOIN r USING (node) GROUP BY 1, 2")
def region_series(spark, sf_dir):
    r = cells(spark, sf_dir).select("node", spatial.bins(F.col("lat"), F.col("lon"), 8).alias("region"))
    return panel_orders(spark, sf_dir).join(F.broadcast(r), "node").groupBy("t", "region").agg(
        F.round(F.avg("price"), 6).alias("price"), F.round(F.avg("share_f"), 8).alias("share_f"), F.count_distinct("node").alias("nodes")
    )


@query(ctes("stations") + f", r AS (SELECT *, {_BIN} AS region FROM cells), g AS (SELECT region, avg(lat) AS lat, degrees(atan2(avg(sin(radians(lon))), avg(cos(radians(lon))))) AS lon, count(*) AS n FROM r GROUP BY 1) SELECT region, round(lat, 8) AS lat, round(lon, 8) AS lon, n, {_BAND} AS band FROM g")
def region_metadata(spark, sf_dir):
    r = stations(spark, sf_dir).withColumn("region", spatial.bins(F.col("lat"), F.col("lon"), 8))
    g = r.groupBy("region").agg(F.avg("lat").alias("lat"), spatial.circular_mean_lon().alias("lon"), F.count("*").alias("n"))
    return g.select("region", F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"), "n", spatial.band(F.col("lat")).alias("band"))


def regions(spark, sf_dir):
    """Centres of about 66 boxes of stations, as nodes: their number is bounded, that of the stations is not."""
    r = stations(spark, sf_dir).withColumn("node", spatial.bins(F.col("lat"), F.col("lon"), 66))
    return r.groupBy("node").agg(F.avg("lat").alias("lat"), spatial.circular_mean_lon().alias("lon"))


_REGIONS = ctes("stations").replace("cells AS", "st AS") + """, cells AS (SELECT node, avg(lat) AS lat, degrees(atan2(avg(sin(radians(lon))), avg(cos(radians(lon))))) AS lon
 FROM (SELECT CAST(least(floor((least(greatest(lat, -90), 90) + 90) / 180 * 6), 5) * 11 + least(floor(((lon % 360) + 360) % 360 / 360 * 11), 10) AS BIGINT) AS node, lat, lon FROM st) GROUP BY 1)"""


@query(_REGIONS + f", {_PAIRS} SELECT source, target, round(km, 6) AS km FROM pairs")
def distance_matrix(spark, sf_dir):
    return spatial.pairs(regions(spark, sf_dir)).select("source", "target", F.round("km", 6).alias("km"))


@query(ctes("stations") + f", {_PAIRS} SELECT source, target, rank FROM (SELECT source, target, row_number() OVER (PARTITION BY target ORDER BY km, source) AS rank FROM pairs WHERE source <> target) WHERE rank <= 3")
def nearest_sources(spark, sf_dir):
    return spatial.nearest(stations(spark, sf_dir), 3).select("source", "target", "rank")


@query(_REGIONS + f", {_PAIRS} SELECT (km >= 1e-8)::BIGINT + (km >= 1000)::BIGINT + (km >= 2000)::BIGINT + (km >= 3000)::BIGINT + (km >= 4000)::BIGINT + (km >= 6000)::BIGINT + (km >= 10000)::BIGINT AS stratum, count(*) AS n FROM pairs GROUP BY 1")
def distance_strata(spark, sf_dir):
    return spatial.pairs(regions(spark, sf_dir)).groupBy(spatial.stratum(F.col("km")).alias("stratum")).agg(F.count("*").alias("n"))


@query(_REGIONS + f""", {_PAIRS}, b AS (SELECT source, target, atan2(sin(radians(lon2 - lon1)) * cos(radians(lat2)), cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1))) AS b FROM pairs WHERE source <> target)
 SELECT source, target, round(degrees(b), 6) AS bearing, round(3.0 * sin(b) - 2.0 * cos(b), 8) AS along FROM b""")
def bearing_projection(spark, sf_dir):
    p = spatial.pairs(regions(spark, sf_dir)).filter("source <> target")
    b = spatial.bearing(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    return p.withColumn("b", b).select("source", "target", F.round(F.degrees("b"), 6).alias("bearing"), F.round(3.0 * F.sin("b") - 2.0 * F.cos("b"), 8).alias("along"))


@query(ctes("stations") + " SELECT a.node AS north, b.node AS south FROM cells a JOIN cells b ON abs(a.lat + b.lat) <= 1e-6 AND abs((((b.lon - a.lon + 180) % 360) + 360) % 360 - 180) <= 1e-6 WHERE a.lat > 0")
def mirror_pairs(spark, sf_dir):
    """Nodes and their reflections across the equator, to a millionth of a degree; places are compared as whole numbers, by an equi-join."""
    g = stations(spark, sf_dir).select("node", F.round(F.col("lat") * 1e6).cast("long").alias("y"), F.round(F.pmod("lon", F.lit(360.0)) * 1e6).cast("long").alias("x"))
    south = g.select(F.col("node").alias("south"), (-F.col("y")).alias("y"), "x")
    return g.filter("y > 0").withColumnRenamed("node", "north").join(south, ["y", "x"]).select("north", "south")


@query(ctes("stations") + ", o AS (SELECT node, 'shifted' AS part, lon + 180 AS lon FROM cells UNION ALL SELECT node, 'plain', lon FROM cells), m AS (SELECT *, max(lon) OVER (PARTITION BY part) > 180 AS far FROM o) SELECT part, node, round(CASE WHEN far THEN (((lon + 180) % 360) + 360) % 360 - 180 ELSE lon END, 8) AS lon FROM m")
def longitude_normalised(spark, sf_dir):
    """Longitudes of two grids in [-180, 180): a grid is wrapped only if one of its longitudes lies above 180."""
    c = stations(spark, sf_dir)
    o = c.select("node", F.lit("shifted").alias("part"), (F.col("lon") + 180).alias("lon")).unionByName(c.select("node", F.lit("plain").alias("part"), "lon"))
    far = o.groupBy("part").agg((F.max("lon") > 180).alias("far"))
    j = o.join(F.broadcast(far), "part")  # one row per grid
    return j.select("part", "node", F.round(F.when(F.col("far"), spatial.wrap(F.col("lon"))).otherwise(F.col("lon")), 8).alias("lon"))


# source cells of 10 by 20 degrees, target cells of 15 by 30 degrees
_GRID = """s AS (SELECT i, j, -90 + 10 * i AS la0, -80 + 10 * i AS la1, 20 * j AS lo0, 20 * j + 20 AS lo1 FROM range(18) x(i), range(18) y(j)),
g AS (SELECT i, j, -90 + 15 * i AS la0, -75 + 15 * i AS la1, 30 * j - 15 AS lo0, 30 * j + 15 AS lo1 FROM range(12) x(i), range(12) y(j)),
w AS (SELECT s.i * 18 + s.j AS source, g.i * 12 + g.j AS target, (sin(radians(least(s.la1, g.la1))) - sin(radians(greatest(s.la0, g.la0)))) * (least(s.lo1 + k.d, g.lo1) - greatest(s.lo0 + k.d, g.lo0)) AS a
 FROM s, g, (VALUES (-360), (0), (360)) k(d) WHERE s.la0 < g.la1 AND g.la0 < s.la1 AND s.lo0 + k.d < g.lo1 AND g.lo0 < s.lo1 + k.d),
wn AS (SELECT source, target, a / sum(a) OVER (PARTITION BY target) AS w FROM w)"""


def overlap_weights(spark):
    """Conservative weights between two regular grids: overlap in sine of latitude times longitude, one per target."""
    idx = lambda n, name: spark.range(n).select(F.col("id").alias(name))  # noqa: E731  grid dimensions
    s = idx(18, "i").crossJoin(F.broadcast(idx(18, "j"))).selectExpr("i * 18 + j AS source", "-90 + 10 * i AS sa", "-80 + 10 * i AS sb", "20 * j AS sc", "20 * j + 20 AS sd")
    g = idx(12, "i").crossJoin(F.broadcast(idx(12, "j"))).selectExpr("i * 12 + j AS target", "-90 + 15 * i AS ga", "-75 + 15 * i AS gb", "30 * j - 15 AS gc", "30 * j + 15 AS gd")
    s = s.withColumn("k", F.explode(F.array(*[F.lit(k) for k in (-360, 0, 360)]))).withColumn("sc", F.col("sc") + F.col("k")).withColumn("sd", F.col("sd") + F.col("k"))
    hit = (F.col("sa") < F.col("gb")) & (F.col("ga") < F.col("sb")) & (F.col("sc") < F.col("gd")) & (F.col("gc") < F.col("sd"))
    a = (F.sin(F.radians(F.least("sb", "gb"))) - F.sin(F.radians(F.greatest("sa", "ga")))) * (F.least("sd", "gd") - F.greatest("sc", "gc"))
    w = s.join(F.broadcast(g), hit).withColumn("a", a)  # 144 target cells
    return w.select("source", "target", (F.col("a") / F.sum("a").over(Window.partitionBy("target"))).alias("w"))


_FIELD = "f AS (SELECT CAST(floor(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) / 365) AS BIGINT) AS t, CAST(l_partkey * 37 % 324 AS BIGINT) AS source, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"


def _field(spark, sf_dir):
    from lagloom.sources.fixtures import day_number, table

    t = F.floor(day_number(F.col("l_shipdate")) / 365).cast("long")
    return table(spark, sf_dir, "lineitem").groupBy(t.alias("t"), (F.col("l_partkey") * 37 % 324).cast("long").alias("source")).agg(F.avg("l_quantity").alias("v"))


@query(f"WITH {_FIELD}, {_GRID} SELECT t, target, round(sum(v * w), 8) AS value FROM f JOIN wn USING (source) GROUP BY 1, 2")
def conservative_regrid(spark, sf_dir):
    f = _field(spark, sf_dir).join(F.broadcast(overlap_weights(spark)), "source")  # weights: a few per cell of the target grid
    return f.groupBy("t", "target").agg(F.round(F.sum(F.col("v") * F.col("w")), 8).alias("value"))


@query(f"""WITH {_FIELD}, {_GRID}, x AS (SELECT t, target, CASE WHEN v < 30 THEN v END AS v, w FROM f JOIN wn USING (source))
 SELECT t, target, round(sum(v * w) / sum(CASE WHEN v IS NOT NULL THEN w END), 8) AS value, round(coalesce(sum(CASE WHEN v IS NOT NULL THEN w END), 0) / 1.0, 8) AS coverage FROM x GROUP BY 1, 2""")
def missing_aware_regrid(spark, sf_dir):
    f = _field(spark, sf_dir).withColumn("v", F.when(F.col("v") < 30, F.col("v"))).join(F.broadcast(overlap_weights(spark)), "source")
    valid = F.sum(F.when(F.col("v").isNotNull(), F.col("w")))
    return f.groupBy("t", "target").agg(F.round(F.sum(F.col("v") * F.col("w")) / valid, 8).alias("value"), F.round(F.coalesce(valid, F.lit(0.0)), 8).alias("coverage"))


@query(f"WITH {_FIELD}, {_GRID}, c AS (SELECT target, sum(w) AS cov, count(*) AS n FROM wn WHERE source IN (SELECT source FROM f GROUP BY 1 HAVING avg(v) < 26) GROUP BY 1) SELECT target, n, round(cov, 8) AS coverage FROM c WHERE round(cov, 9) >= 0.5")
def region_footprint(spark, sf_dir):
    some = _field(spark, sf_dir).groupBy("source").agg(F.avg("v").alias("m")).filter("m < 26").select("source")
    c = overlap_weights(spark).join(some, "source", "left_semi").groupBy("target").agg(F.count("*").alias("n"), F.sum("w").alias("cov"))
    return c.filter("round(cov, 9) >= 0.5").select("target", "n", F.round("cov", 8).alias("coverage"))


@query(ctes("panel_orders", "cells") + " SELECT t, round(sum(price * cos(radians(lat))) / sum(cos(radians(lat))), 6) AS price FROM panel_orders JOIN cells USING (node) GROUP BY 1")
def area_weighted_mean(spark, sf_dir):
    w = F.cos(F.radians("lat"))
    return panel_orders(spark, sf_dir).join(F.broadcast(cells(spark, sf_dir)), "node").groupBy("t").agg(F.round(F.sum(F.col("price") * w) / F.sum(w), 6).alias("price"))


@query(ctes("panel") + " SELECT t, node, (node // 5) * 5 + (node % 5 + 2) % 5 AS remote, round(wind, 8) AS wind FROM panel")
def remote_region(spark, sf_dir):
    return panel(spark, sf_dir).select("t", "node", (F.floor(F.col("node") / 5) * 5 + (F.col("node") % 5 + 2) % 5).alias("remote"), F.round("wind", 8).alias("wind"))


@query("""WITH x AS (SELECT event_id, value AS speed, (user_id * 7 % 400)::DOUBLE AS dir FROM events)
 SELECT event_id, round(-speed * sin(radians(dir)), 8) AS u, round(-speed * cos(radians(dir)), 8) AS v FROM x WHERE dir >= 0 AND dir <= 360 AND speed >= 0""")
def wind_components(spark, sf_dir):
    from lagloom.sources.fixtures import table

    e = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("speed"), (F.col("user_id") * 7 % 400).cast("double").alias("dir"))
    e = e.filter("dir between 0 and 360 and speed >= 0")
    return e.select("event_id", F.round(-F.col("speed") * F.sin(F.radians("dir")), 8).alias("u"), F.round(-F.col("speed") * F.cos(F.radians("dir")), 8).alias("v"))
