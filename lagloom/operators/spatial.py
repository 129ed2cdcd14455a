"""Spatial operators on latitude and longitude in degrees."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RADIUS_KM = 6371.0


def wrap(lon: Column) -> Column:
    """Longitude in [-180, 180)."""
    return F.pmod(lon + 180, F.lit(360.0)) - 180


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * RADIUS_KM) * F.asin(F.sqrt(F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0))))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial great-circle bearing in radians."""
    d = F.radians(lon2 - lon1)
    a, b = F.radians(lat1), F.radians(lat2)
    return F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))


def band(lat: Column, low: float = 23.5, high: float = 60.0) -> Column:
    return F.when(lat.isNull(), "unknown").when(F.abs(lat) < low, "tropics").when(F.abs(lat) < high, "midlatitude").otherwise("polar")


def circular_mean_lon() -> Column:
    return F.degrees(F.atan2(F.avg(F.sin(F.radians("lon"))), F.avg(F.cos(F.radians("lon")))))


def bins(lat: Column, lon: Column, n: int) -> Column:
    """Region of about ``n`` latitude-longitude boxes."""
    rows = max(1, round(math.sqrt(n / 2)))  # half to even
    cols = math.ceil(n / rows)
    i = F.least(F.floor((F.least(F.greatest(lat, F.lit(-90.0)), F.lit(90.0)) + 90) / 180 * rows), F.lit(rows - 1))
    j = F.least(F.floor(F.pmod(lon, F.lit(360.0)) / 360 * cols), F.lit(cols - 1))
    return (i * cols + j).cast("long")


def pairs(nodes: DataFrame) -> DataFrame:
    """All ordered pairs of a node dimension table with their distance."""
    a = nodes.select(F.col("node").alias("source"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    b = nodes.select(F.col("node").alias("target"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return a.crossJoin(F.broadcast(b)).withColumn("km", haversine(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")))


_LEVELS = 12


def _bins(level: Column) -> list[Column]:
    """Cube of side 2 / 2**level that holds the node's point on the unit sphere."""
    size = F.pow(F.lit(2.0), F.lit(1.0) - level)
    return [F.floor((F.col(c) + 1) / size).cast("int").alias("b" + c) for c in "xyz"]


def nearest(nodes: DataFrame, k: int) -> DataFrame:
    """The k nearest sources of each target with km and rank, ties to the smaller source.

    No pair of all nodes is formed: points on the unit sphere lie in cubes of halving
    sides. A target takes the finest level at which the cube of half the side around
    it holds more than k nodes; its k nearest then are in the 27 cubes about its own,
    as they are nearer than one side. Nodes in one place count with their k + 1
    smallest numbers as sources.
    """
    la, lo = F.radians("lat"), F.radians("lon")
    p = nodes.select("node", "lat", "lon", (F.cos(la) * F.cos(lo)).alias("x"), (F.cos(la) * F.sin(lo)).alias("y"), F.sin(la).alias("z"))
    cube = ["bx", "by", "bz"]
    every = p.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(_LEVELS + 1))))
    binned = every.select("*", *_bins(F.col("level")))
    full = binned.groupBy("level", *cube).agg(F.count("*").alias("c")).filter(F.col("c") > k).select("level", *cube)
    fine = binned.join(full.hint("shuffle_hash"), ["level", *cube], "left_semi").groupBy("node").agg(F.max("level").alias("half"))
    targets = p.join(fine.hint("shuffle_hash"), "node", "left").withColumn("level", F.greatest(F.coalesce(F.col("half") - 1, F.lit(0)), F.lit(0)))
    around = F.explode(F.expr("flatten(transform(sequence(-1, 1), i -> flatten(transform(sequence(-1, 1), j -> transform(sequence(-1, 1), l -> named_struct('i', i, 'j', j, 'l', l))))))"))
    wanted = targets.select(F.col("node").alias("target"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), "level", *_bins(F.col("level"))).withColumn("d", around)
    wanted = wanted.select("target", "lat2", "lon2", "level", *[(F.col("b" + c) + F.col("d." + n)).alias("b" + c) for c, n in zip("xyz", "ijl", strict=True)])
    one_place = Window.partitionBy("lat", "lon").orderBy("node")
    sources = p.withColumn("r", F.row_number().over(one_place)).filter(F.col("r") <= k + 1)
    sources = sources.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(_LEVELS))))
    sources = sources.select(F.col("node").alias("source"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), "level", *_bins(F.col("level")))
    met = wanted.join(sources.hint("shuffle_merge"), ["level", *cube]).filter("source <> target")
    met = met.withColumn("km", haversine(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")))
    w = Window.partitionBy("target").orderBy("km", "source")
    return met.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("source", "target", "lat1", "lon1", "lat2", "lon2", "km", "rank")


def stratum(km: Column, edges: tuple[float, ...] = (1e-8, 1000, 2000, 3000, 4000, 6000, 10000)) -> Column:
    """Number of edges at or below a distance."""
    return sum((F.when(km >= e, 1).otherwise(0) for e in edges), F.lit(0)).cast("long")


RADIUS_M = 6_371_000.0


def footprint(source: DataFrame, target: DataFrame, bin_degrees: float = 15.0, tolerance: float = 1e-10) -> tuple[DataFrame, DataFrame]:
    """Overlap of two sets of latitude-longitude cells: (weights, coverage).

    Cells: id, south, north, west, east in degrees, east up to 360 beyond west. Both sides are
    cut by a grid of bins, so only cells that share a bin meet; an overlap counts in the bin
    of its south-west corner, once. weights: source, target, weight (overlap over the area of
    the target) for targets that are covered whole; coverage: target, area_m2, coverage,
    n_sources, included. A target without any source has coverage 0.
    """

    def binned(cells: DataFrame, side: str) -> DataFrame:
        c = cells.select(F.col("id").alias(side), *[F.col(e).cast("double").alias(f"{side}_{e}") for e in ("south", "north", "west", "east")])
        w, e, s, n = (F.col(f"{side}_{x}") for x in ("west", "east", "south", "north"))
        if side == "source":  # the same cell one turn on and back
            c = c.withColumn("_k", F.explode(F.array(F.lit(-360.0), F.lit(0.0), F.lit(360.0)))).withColumns({"source_west": w + F.col("_k"), "source_east": e + F.col("_k")}).drop("_k")
        edge = lambda x: F.floor(x / bin_degrees)
        c = c.withColumn("bi", F.explode(F.sequence(edge(s), edge(n - 1e-9)))).withColumn("bj", F.explode(F.sequence(edge(w), edge(e - 1e-9))))
        return c

    a, b = binned(source, "source"), binned(target, "target")
    j = b.join(a.hint("shuffle_merge"), ["bi", "bj"])
    south, north = F.greatest("source_south", "target_south"), F.least("source_north", "target_north")
    west, east = F.greatest("source_west", "target_west"), F.least("source_east", "target_east")
    j = j.filter((south < north) & (west < east) & (F.floor(south / bin_degrees) == F.col("bi")) & (F.floor(west / bin_degrees) == F.col("bj")))
    lap = j.select("source", "target", ((F.sin(F.radians(north)) - F.sin(F.radians(south))) * F.radians(east - west)).alias("a"))
    lap = lap.groupBy("source", "target").agg(F.sum("a").alias("a"))
    area = (F.sin(F.radians("north")) - F.sin(F.radians("south"))) * F.radians(F.col("east") - F.col("west"))
    t = target.select(F.col("id").alias("target"), area.alias("area"))
    sums = lap.groupBy("target").agg(F.sum("a").alias("covered"), F.count("*").alias("n_sources"))
    cover = t.join(sums.hint("shuffle_merge"), "target", "left").select("target", "area", (F.coalesce("covered", F.lit(0.0)) / F.col("area")).alias("coverage"), F.coalesce("n_sources", F.lit(0)).alias("n_sources"))
    cover = cover.withColumn("included", F.abs(F.col("coverage") - 1) <= tolerance)
    weights = lap.join(cover.filter("included").select("target", "area").hint("shuffle_merge"), "target").select("source", "target", (F.col("a") / F.col("area")).alias("weight"))
    return weights, cover.select("target", (F.col("area") * RADIUS_M * RADIUS_M).alias("area_m2"), "coverage", "n_sources", "included")
