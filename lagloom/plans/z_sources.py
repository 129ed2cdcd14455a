"""Archives with coordinates, levels by pressure, one contract for many files, footprints of cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagloom.operators import spatial
from lagloom.plans import section
from lagloom.plans.x_fields import _COLS, _ROWS, fields
from lagloom.sources import archives
from lagloom.sources.fixtures import ctes, stations, table

QUERIES, query = section()

_FIELDS = f"""WITH f0 AS (SELECT ((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1)::BIGINT AS t, CAST(l_partkey * 31 % {_ROWS} AS BIGINT) AS i, CAST(l_suppkey * 7 % {_COLS} AS BIGINT) AS j, avg(l_quantity) AS q, avg(l_discount) * 100 AS u, avg(l_tax) * 100 AS v FROM lineitem GROUP BY 1, 2, 3),
 ff AS (SELECT tt.t, i.i, j.j, q, u, v FROM (SELECT unnest(range((SELECT min(t) FROM f0), (SELECT max(t) FROM f0) + 1)) AS t) tt CROSS JOIN range({_ROWS}) i(i) CROSS JOIN range({_COLS}) j(j) LEFT JOIN f0 ON f0.t = tt.t AND f0.i = i.i AND f0.j = j.j)"""


def field_archives(spark, sf_dir):
    """The monthly fields as one NPZ file for each half year (so that no two axes are as long): three orders of axes in turn, one array per variable or one for all, wind by its components."""
    f = fields(spark, sf_dir).withColumn("half", F.floor(F.col("t") / 6).cast("long"))

    def pack(key, df):
        import io

        import numpy as np
        import pandas as pd

        steps = np.sort(df["t"].unique())
        d = df.sort_values(["t", "i", "j"])
        parts = {n: d[n].to_numpy(float).reshape(len(steps), _ROWS, _COLS) for n in ("q", "u", "v")}
        turn = [(0, 1, 2), (2, 1, 0), (1, 2, 0)][int(key[0]) % 3]
        parts = {n: np.transpose(x, turn) for n, x in parts.items()}
        coords = {"latitude": -90 + 180 / _ROWS * (np.arange(_ROWS) + 0.5), "longitude": 360 / _COLS * np.arange(_COLS), "time": np.datetime64("1995-01", "M").astype("datetime64[M]") + steps}
        coords["time"] = coords["time"].astype("datetime64[s]").astype("datetime64[us]")
        buf = io.BytesIO()
        if int(key[0]) % 2:
            np.savez(buf, specific_humidity=parts["q"], u10=parts["u"], v10=parts["v"], **coords)
        else:
            np.savez(buf, data=np.stack([parts["v"], parts["q"], parts["u"]], axis=-1), variable_names=np.array(["v10", "specific_humidity", "u10"]), **coords)
        return pd.DataFrame({"path": [f"fields-{key[0]}.npz"], "content": [buf.getvalue()]})

    return f.groupBy("half").applyInPandas(pack, "path string, content binary")


@query(_FIELDS + f""", l AS (SELECT t, -90 + {180 / _ROWS} * (i + 0.5) AS lat, CASE WHEN j * {360 / _COLS} > 180 OR j * {360 / _COLS} = 180 THEN j * {360 / _COLS} - 360 ELSE j * {360 / _COLS} END AS lon, unnest(['humidity', 'u', 'v', 'wind']) AS variable, unnest([q, u, v, sqrt(u * u + v * v)]) AS value FROM ff)
 SELECT variable, round(lat, 6) AS lat, count(value) AS n, round(avg(value), 8) AS mean, round(avg(lon) FILTER (value IS NOT NULL), 6) AS lon, min(t) FILTER (value IS NOT NULL) AS first_t, max(t) FILTER (value IS NOT NULL) AS last_t FROM l GROUP BY 1, 2""")
def archive_grids(spark, sf_dir):
    """Archives of any axis order read back with coordinates, times and wind from its components, by variable and latitude."""
    r = archives.decode(field_archives(spark, sf_dir)).filter(~F.isnan("value"))
    t = (F.year("ts") - 1995) * 12 + F.month("ts") - 1
    return r.groupBy("variable", F.round("lat", 6).alias("lat")).agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 8).alias("mean"), F.round(F.avg("lon"), 6).alias("lon"), F.min(t).cast("long").alias("first_t"), F.max(t).cast("long").alias("last_t")
    )


_HPA = "(1000 - 75 * l_linenumber)"


@query(f"WITH g AS (SELECT l_partkey % 6 * 8 + l_suppkey % 8 AS node, {_HPA} AS level, l_quantity AS v FROM lineitem), b AS (SELECT level FROM (SELECT DISTINCT level FROM g) ORDER BY abs(level - 860), level LIMIT 1) SELECT node, any_value(level) AS level, count(*) AS n, round(avg(v), 8) AS v FROM g WHERE level = (SELECT level FROM b) GROUP BY 1")
def level_by_pressure(spark, sf_dir):
    """Grid rows of the level nearest to 860 hPa, whose coordinate is given in Pa, by node."""
    g = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 6 * 8 + F.col("l_suppkey") % 8).alias("node"), F.expr(f"{_HPA} * 100").alias("pa"), F.col("l_quantity").alias("v"))
    g = archives.at_level(g, F.col("pa"), 860.0)
    return g.groupBy("node").agg((F.first("pa") / 100).cast("long").alias("level"), F.count("*").alias("n"), F.round(F.avg("v"), 8).alias("v"))


# one file for each quarter and half of the grid; some break the contract
_CONTRACT = f"""{_FIELDS}, fr AS (SELECT 'part-' || (t // 3) || CASE WHEN i < {_ROWS // 2} THEN '-south' ELSE '-north' END AS file, t, i * {_COLS} + j AS node, i, j, unnest(['q', 'u', 'v']) AS variable, unnest([q, u, v]) AS value FROM ff),
 fs AS (SELECT *, CASE WHEN variable = 'q' AND t // 3 % 7 = 3 THEN 'g/kg' WHEN variable = 'q' THEN 'kg/kg' ELSE 'm/s' END AS units, CASE WHEN variable = 'u' AND t // 3 % 5 = 1 THEN 500 ELSE 850 END AS level, -90 + {180 / _ROWS} * (i + 0.5) + CASE WHEN t // 3 % 11 = 2 AND j = 0 THEN 0.5 ELSE 0 END AS lat, j * {360 / _COLS} AS lon FROM fr WHERE NOT (variable = 'v' AND t // 3 % 6 = 4) AND NOT (t % 13 = 4)),
 rw AS MATERIALIZED (SELECT file, variable, t, node, units, level, lat, lon FROM fs UNION ALL SELECT file || '-copy', variable, t, node, units, level, lat, lon FROM fs WHERE t // 3 % 9 = 5 AND variable = 'u'),
 fd(variable, units, level) AS (VALUES ('q', 'kg/kg', 850), ('u', 'm/s', 850), ('v', 'm/s', 850)), ca AS (SELECT DISTINCT t FROM ff WHERE t >= (SELECT min(t) FROM ff) + 2), gr AS (SELECT DISTINCT i * {_COLS} + j AS node, -90 + {180 / _ROWS} * (i + 0.5) AS lat, j * {360 / _COLS} AS lon FROM ff)"""


@query(_CONTRACT + """, kd AS (SELECT file, variable, any_value(units) AS units, any_value(level) AS level FROM rw GROUP BY 1, 2), st AS (SELECT DISTINCT file, variable, t FROM rw),
 al AS (SELECT file, 'field' AS what, count(*) AS n FROM (SELECT f.file, fd.variable FROM (SELECT DISTINCT file FROM rw) f CROSS JOIN fd) x WHERE NOT EXISTS (SELECT 1 FROM kd WHERE kd.file = x.file AND kd.variable = x.variable) GROUP BY 1
  UNION ALL SELECT file, 'units', count(*) FROM kd JOIN fd USING (variable) WHERE kd.units <> fd.units GROUP BY 1 UNION ALL SELECT file, 'level', count(*) FROM kd JOIN fd USING (variable) WHERE kd.level IS DISTINCT FROM fd.level GROUP BY 1
  UNION ALL SELECT file, 'grid', count(*) FROM (SELECT DISTINCT file, node, lat, lon FROM rw) p LEFT JOIN gr USING (node) WHERE gr.lat IS NULL OR gr.lat <> p.lat OR gr.lon <> p.lon GROUP BY 1
  UNION ALL SELECT file, 'calendar', count(*) FROM st WHERE t NOT IN (SELECT t FROM ca) GROUP BY 1 UNION ALL SELECT file, 'gap', sum(g) FROM (SELECT file, t - lag(t) OVER (PARTITION BY file, variable ORDER BY t) - 1 AS g FROM st) WHERE g > 0 GROUP BY 1
  UNION ALL SELECT file, 'twice', count(*) FROM (SELECT file, row_number() OVER (PARTITION BY variable, t ORDER BY file) AS r FROM st) WHERE r > 1 GROUP BY 1
  UNION ALL SELECT NULL, 'absent', count(*) FROM (SELECT t, variable FROM ca CROSS JOIN fd EXCEPT SELECT t, variable FROM st) HAVING count(*) > 0)
 SELECT file, what, sum(n)::BIGINT AS n FROM al GROUP BY 1, 2""")
def contract_violations(spark, sf_dir):
    """What each file of a set breaks of the contract on fields, units, level, grid and calendar that all share."""
    part = F.floor(F.col("t") / 3)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("variable")) for n in "quv"])).alias("v")
    f = fields(spark, sf_dir)
    rows = f.select("t", "i", "j", each).select("t", "i", "j", "v.variable", part.alias("part"), F.concat(F.lit("part-"), part.cast("string"), F.when(F.col("i") < _ROWS // 2, "-south").otherwise("-north")).alias("file"))
    rows = rows.filter(~((F.col("variable") == "v") & (F.col("part") % 6 == 4)) & (F.col("t") % 13 != 4))
    q, lat = F.col("variable") == "q", F.lit(-90.0) + 180 / _ROWS * (F.col("i") + 0.5)
    rows = rows.select(
        "file", "variable", "t", (F.col("i") * _COLS + F.col("j")).alias("node"), F.when(q & (F.col("part") % 7 == 3), "g/kg").when(q, "kg/kg").otherwise("m/s").alias("units"),
        F.when((F.col("variable") == "u") & (F.col("part") % 5 == 1), 500).otherwise(850).alias("level"), (lat + F.when((F.col("part") % 11 == 2) & (F.col("j") == 0), 0.5).otherwise(0.0)).alias("lat"), (F.col("j") * (360 / _COLS)).alias("lon"), "part",
    )
    copy = rows.filter((F.col("part") % 9 == 5) & (F.col("variable") == "u")).withColumn("file", F.concat("file", F.lit("-copy")))
    wanted = spark.createDataFrame([("q", "kg/kg", 850), ("u", "m/s", 850), ("v", "m/s", 850)], "variable string, units string, level int")
    steps = f.select("t").distinct()
    calendar = steps.crossJoin(F.broadcast(f.agg((F.min("t") + 2).alias("a")))).filter("t >= a").select("t")  # one row
    grid = f.select((F.col("i") * _COLS + F.col("j")).alias("node"), lat.alias("lat"), (F.col("j") * (360 / _COLS)).alias("lon")).distinct()
    return archives.violations(rows.unionByName(copy).drop("part"), wanted, calendar, grid)


# sources: cells of 20 x 30 degrees from -180 that hold a station, and those north and south of them; targets, from 0 to 360: cells of 12 x 15 degrees that touch one
_SRC = "SELECT DISTINCT i * 12 + j AS id, -90 + 20 * i AS south, -70 + 20 * i AS north, 30 * j - 180 AS west, 30 * j - 150 AS east FROM (SELECT floor((lat + 90) / 20)::BIGINT + k AS i, floor((lon + 180) / 30)::BIGINT AS j FROM cells, (VALUES (-1), (0), (1)) r(k)) WHERE i BETWEEN 0 AND 8"
_TGT = "SELECT DISTINCT i * 24 + j AS id, -90 + 12 * i AS south, -78 + 12 * i AS north, 15 * j AS west, 15 * j + 15 AS east FROM (SELECT floor((lat + 90) / 12)::BIGINT AS i, floor((CASE WHEN lon < 0 THEN lon + 360 ELSE lon END) / 15)::BIGINT AS j FROM cells)"
_FOOT = ctes("stations") + f""", so AS ({_SRC}), ta AS ({_TGT}), lp AS (SELECT so.id AS source, ta.id AS target, sum((sin(radians(least(so.north, ta.north))) - sin(radians(greatest(so.south, ta.south)))) * radians(least(so.east + k, ta.east) - greatest(so.west + k, ta.west))) AS a
 FROM so, ta, (VALUES (-360), (0), (360)) t(k) WHERE so.south < ta.north AND ta.south < so.north AND so.west + k < ta.east AND ta.west < so.east + k GROUP BY 1, 2),
 cv AS (SELECT id AS target, (sin(radians(north)) - sin(radians(south))) * radians(east - west) AS area, coalesce(sum(a), 0) AS covered, count(source) AS n_sources FROM ta LEFT JOIN lp ON lp.target = ta.id GROUP BY ALL)"""


def _cells(spark, sf_dir):
    s = stations(spark, sf_dir)
    here, j = F.floor((F.col("lat") + 90) / 20), F.floor((F.col("lon") + 180) / 30)
    near = s.select("lon", F.explode(F.array(here - 1, here, here + 1)).alias("i")).filter("i between 0 and 8")
    i = F.col("i")
    source = near.select((i * 12 + j).alias("id"), (i * 20 - 90).alias("south"), (i * 20 - 70).alias("north"), (j * 30 - 180).alias("west"), (j * 30 - 150).alias("east")).distinct()
    i, j = F.floor((F.col("lat") + 90) / 12), F.floor(F.when(F.col("lon") < 0, F.col("lon") + 360).otherwise(F.col("lon")) / 15)
    target = s.select((i * 24 + j).alias("id"), (i * 12 - 90).alias("south"), (i * 12 - 78).alias("north"), (j * 15).alias("west"), (j * 15 + 15).alias("east")).distinct()
    return source, target


@query(_FOOT + " SELECT target, round(area * 6371000.0 * 6371000.0, 2) AS area_m2, round(covered / area, 9) AS coverage, n_sources, abs(covered / area - 1) <= 1e-10 AS included FROM cv")
def cell_footprint(spark, sf_dir):
    """How much of each target cell the source cells cover, with areas; cells meet by bins, never all with all."""
    _, c = spatial.footprint(*_cells(spark, sf_dir))
    return c.select("target", F.round("area_m2", 2).alias("area_m2"), F.round("coverage", 9).alias("coverage"), "n_sources", "included")


@query(_FOOT + " SELECT source, target, round(a / area, 9) AS weight, true AS adds_up FROM lp JOIN cv USING (target) WHERE abs(covered / area - 1) <= 1e-10")
def footprint_weights(spark, sf_dir):
    """Weights of the source cells in the target cells that are covered whole; they add up to one."""
    from pyspark.sql import Window

    w, _ = spatial.footprint(*_cells(spark, sf_dir))
    return w.select("source", "target", F.round("weight", 9).alias("weight"), (F.abs(F.sum("weight").over(Window.partitionBy("target")) - 1) < 1e-9).alias("adds_up"))
