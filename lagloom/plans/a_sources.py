"""Sources, scans and sinks."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Window
from pyspark.sql import functions as F

from lagloom.operators import spatial
from lagloom.operators.lineage import shared_folder
from lagloom.plans import section
from lagloom.sources import readers
from lagloom.sources.fixtures import ctes, long_panel, panel, panel_orders, panel_ship, station_climate, stations, table

QUERIES, query = section()


#: Columns of the tables that stand for weather variables here.
LINEITEM = {"temperature": ("l_extendedprice",), "humidity": ("l_discount",), "cloud_cover": ("l_tax",), "wind": ("l_quantity",)}


@query()
def file_scan(spark, sf_dir):
    """Data files of the folder with their format and size, without reading contents."""
    return readers.scan(spark, sf_dir).select("name", "format", F.col("bytes").alias("length"))


_TIMES = {"events": "ts", "orders": "o_orderdate", "lineitem": "l_shipdate"}
_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, 'parquet' AS format, count(*) AS n, {f'CAST(min({_TIMES[t]}) AS DATE)' if t in _TIMES else 'NULL::DATE'} AS first, {f'CAST(max({_TIMES[t]}) AS DATE)' if t in _TIMES else 'NULL::DATE'} AS last, (SELECT count(*) FROM information_schema.columns WHERE table_name = '{t}') AS columns, NULL AS error FROM {t}" for t in _TABLES) + " UNION ALL SELECT 'absent', 'parquet', NULL, NULL, NULL, NULL, 'not readable'")
def table_inventory(spark, sf_dir):
    """Every table with rows, columns and time range; one that can't be read keeps its row, with an error."""
    out = None
    for name in [*_TABLES, "absent"]:
        try:
            df = table(spark, sf_dir, name)
            ends = [f(_TIMES[name]).cast("date") for f in (F.min, F.max)] if name in _TIMES else [F.lit(None).cast("date")] * 2
            r = df.agg(F.count("*").alias("n"), ends[0].alias("first"), ends[1].alias("last")).select(F.lit(name).alias("name"), F.lit("parquet").alias("format"), "*", F.lit(len(df.columns)).cast("long").alias("columns"), F.lit(None).cast("string").alias("error"))
        except AnalysisException:
            r = spark.range(1).select(F.lit(name).alias("name"), F.lit("parquet").alias("format"), *[F.lit(None).cast(k).alias(c) for c, k in (("n", "long"), ("first", "date"), ("last", "date"), ("columns", "long"))], F.lit("not readable").alias("error"))
        out = r if out is None else out.unionByName(r)
    return out


@query("SELECT variable, count(*) AS n, round(avg(value), 6) AS mean, round(max(value), 6) AS high FROM (SELECT l_quantity AS wind, l_discount AS humidity, l_tax AS cloud_cover, l_extendedprice AS temperature FROM lineitem) UNPIVOT (value FOR variable IN (wind, humidity, cloud_cover, temperature)) GROUP BY 1")
def alias_resolved_long(spark, sf_dir):
    c = readers.canonical(table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_extendedprice"), LINEITEM)
    return c.unpivot([], ["wind", "humidity", "cloud_cover", "temperature"], "variable", "value").groupBy("variable").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.max("value"), 6).alias("high"))


@query("WITH k AS (SELECT DISTINCT l_suppkey % 5 AS a, l_returnflag AS b FROM lineitem) SELECT l_suppkey % 5 AS a, l_returnflag AS b, node, count(*) AS n FROM lineitem JOIN (SELECT a, b, row_number() OVER (ORDER BY a, b) - 1 AS node FROM k) k ON k.a = l_suppkey % 5 AND k.b = l_returnflag GROUP BY 1, 2, 3")
def node_numbers(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 5).alias("a"), F.col("l_returnflag").alias("b"))
    nodes = li.distinct().withColumn("node", F.row_number().over(Window.orderBy("a", "b")) - 1)  # one row per node
    return li.groupBy("a", "b").agg(F.count("*").alias("n")).join(nodes, ["a", "b"])


@query("""WITH g AS (SELECT CAST(o_orderdate AS DATE) AS ts, o_custkey % 4 AS node, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2), t AS (SELECT DISTINCT ts FROM g), n AS (SELECT DISTINCT node FROM g)
 SELECT t.ts, n.node, round(g.v, 6) AS v FROM t CROSS JOIN n LEFT JOIN g ON g.ts = t.ts AND g.node = n.node""")
def dense_grid(spark, sf_dir):
    from lagloom.operators.clean import dense

    g = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("ts"), (F.col("o_custkey") % 4).alias("node")).agg(F.avg("o_totalprice").alias("v"))
    return dense(g, g.select("ts").distinct(), g.select("node").distinct(), "ts").select("ts", "node", F.round("v", 6).alias("v"))


@query(ctes("panel") + " SELECT t, node, round(wind, 8) AS wind FROM panel WHERE t % 4 = 0 AND t < 200 AND node % 2 = 0")
def strided_subsample(spark, sf_dir):
    return panel(spark, sf_dir).filter("t % 4 = 0 and t < 200 and node % 2 = 0").select("t", "node", F.round("wind", 8).alias("wind"))


@query(ctes("stations") + """, p AS (SELECT 'a' AS part, node, lat, lon FROM cells UNION ALL SELECT 'b', node, lat + 0.001, lon FROM cells WHERE node % 5 <> 4 UNION ALL SELECT 'c', node, lat + 5, lon FROM cells WHERE node % 11 <> 10),
 ref AS (SELECT part FROM p GROUP BY 1 ORDER BY count(*) DESC, part LIMIT 1) SELECT p.part, count(*) AS nodes, round(avg(abs(p.lat - r.lat) + abs(p.lon - r.lon)), 8) AS apart, avg(abs(p.lat - r.lat) + abs(p.lon - r.lon)) < 0.01 AS compatible FROM p JOIN p r ON r.node = p.node AND r.part = (SELECT part FROM ref) GROUP BY 1""")
def compatible_grids(spark, sf_dir):
    c = stations(spark, sf_dir)
    part = lambda n, df, d: df.select(F.lit(n).alias("part"), "node", (F.col("lat") + d).alias("lat"), "lon")
    p = part("a", c, 0.0).unionByName(part("b", c.filter("node % 5 <> 4"), 0.001)).unionByName(part("c", c.filter("node % 11 <> 10"), 5.0))
    ref = p.groupBy("part").count().orderBy(F.desc("count"), "part").limit(1).select(F.col("part"))
    r = p.join(ref, "part", "left_semi").select("node", F.col("lat").alias("rl"), F.col("lon").alias("rn"))
    apart = F.avg(F.abs(F.col("lat") - F.col("rl")) + F.abs(F.col("lon") - F.col("rn")))
    return p.join(r, "node").groupBy("part").agg(F.count("*").alias("nodes"), F.round(apart, 8).alias("apart"), (apart < 0.01).alias("compatible"))


@query(ctes("panel_ship") + """, a AS (SELECT 0 AS segment, t, flag, price FROM panel_ship WHERE t < 1000 UNION ALL SELECT 1, t, flag, price + 1 FROM panel_ship WHERE t BETWEEN 900 AND 1500 UNION ALL SELECT 2, t, flag, price + 2 FROM panel_ship WHERE t > 1400)
 SELECT segment, flag, count(*) AS n, round(avg(price), 6) AS price FROM (SELECT *, row_number() OVER (PARTITION BY t, flag ORDER BY segment) AS r FROM a) WHERE r = 1 GROUP BY 1, 2""")
def segments_first_wins(spark, sf_dir):
    p = panel_ship(spark, sf_dir).select("t", "flag", "price")
    parts = [p.filter("t < 1000"), p.filter("t between 900 and 1500").withColumn("price", F.col("price") + 1), p.filter("t > 1400").withColumn("price", F.col("price") + 2)]
    return readers.concat_segments(parts, ["t", "flag"]).groupBy("segment", "flag").agg(F.count("*").alias("n"), F.round(F.avg("price"), 6).alias("price"))


@query(ctes("panel_ship") + """, w AS (SELECT 0 AS rank, t, flag, qty AS wind FROM panel_ship WHERE t % 3 = 0 UNION ALL SELECT 1, t, flag, sqrt(disc * disc + tax * tax) FROM panel_ship WHERE t % 2 = 0 UNION ALL SELECT 2, t, flag, abs(disc) FROM panel_ship)
 SELECT rank, count(*) AS n, round(avg(wind), 7) AS wind FROM (SELECT *, row_number() OVER (PARTITION BY t, flag ORDER BY rank) AS r FROM w) WHERE r = 1 GROUP BY 1""")
def wind_choice(spark, sf_dir):
    p = panel_ship(spark, sf_dir)
    speed = p.filter("t % 3 = 0").select("t", "flag", F.col("qty").alias("wind"))
    both = p.filter("t % 2 = 0").select("t", "flag", F.sqrt(F.col("disc") * F.col("disc") + F.col("tax") * F.col("tax")).alias("wind"))
    one = p.select("t", "flag", F.abs("disc").alias("wind"))
    w = readers.concat_segments([speed, both, one], ["t", "flag"])
    return w.groupBy(F.col("segment").alias("rank")).agg(F.count("*").alias("n"), F.round(F.avg("wind"), 7).alias("wind"))


@query(ctes("panel_events") + " SELECT t, node, variable, round(value, 8) AS value FROM panel_events WHERE t IN (SELECT t FROM panel_events GROUP BY 1 HAVING count(DISTINCT variable) = 5)")
def aligned_variables(spark, sf_dir):
    from lagloom.sources.fixtures import panel_events

    e = panel_events(spark, sf_dir)
    full = e.groupBy("t").agg(F.count_distinct("variable").alias("k")).filter("k = 5").select("t")
    return e.join(full, "t", "left_semi").select("t", "node", "variable", F.round("value", 8).alias("value"))


@query(ctes("panel") + " SELECT node, variable, count(*) AS n, round(sum(value), 4) AS total FROM panel UNPIVOT (value FOR variable IN (wind, humidity, cloud_cover, temperature)) GROUP BY 1, 2")
def region_output_sink(spark, sf_dir):
    """Long panel written by variable and read back from the shared folder."""
    path = f"{shared_folder(spark)}/region-series-{uuid.uuid4().hex}"
    long_panel(panel(spark, sf_dir), "t", "node").write.partitionBy("variable").parquet(path)
    return spark.read.parquet(path).groupBy("node", "variable").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


_BIN66 = "CAST(least(floor((least(greatest(lat, -90), 90) + 90) / 180 * 6), 5) * 11 + least(floor(((lon % 360) + 360) % 360 / 360 * 11), 10) AS BIGINT)"


@query(ctes("stations", "station_climate") + f""", nm AS (SELECT node, {_BIN66} AS region FROM cells), md AS (SELECT region, avg(lat) AS lat, degrees(atan2(avg(sin(radians(lon))), avg(cos(radians(lon))))) AS lon, count(*) AS n FROM cells JOIN nm USING (node) GROUP BY 1), se AS (SELECT region, t, variable, avg(v) AS v FROM sc JOIN nm USING (node) GROUP BY 1, 2, 3)
 SELECT 'metadata' AS sink, count(*) AS n, round(sum(lat), 5) AS a, round(sum(lon), 5) AS b FROM md UNION ALL SELECT 'node_map', count(*), sum(node)::DOUBLE, sum(region)::DOUBLE FROM nm UNION ALL SELECT 'series', count(*), round(sum(abs(v)), 4), sum(t)::DOUBLE FROM se""")
def region_csv_sinks(spark, sf_dir):
    """Regions of the stations as CSV files with a header: metadata, node map and series, read back."""
    st = stations(spark, sf_dir)
    nodes = st.select("node", spatial.bins(F.col("lat"), F.col("lon"), 66).alias("region"))
    meta = st.join(nodes.hint("shuffle_merge"), "node").groupBy("region").agg(F.avg("lat").alias("lat"), spatial.circular_mean_lon().alias("lon"), F.count("*").alias("n"))
    series = station_climate(spark, sf_dir).join(nodes.hint("shuffle_merge"), "node").groupBy("region", "t", "variable").agg(F.avg("value").alias("v"))
    out = None
    for name, df, a, b in (("metadata", meta, F.round(F.sum("lat"), 5), F.round(F.sum("lon"), 5)), ("node_map", nodes, F.sum("node").cast("double"), F.sum("region").cast("double")), ("series", series, F.round(F.sum(F.abs("v")), 4), F.sum("t").cast("double"))):
        back = readers.csv_sink(df, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
        r = back.agg(F.count("*").alias("n"), a.alias("a"), b.alias("b")).select(F.lit(name).alias("sink"), "*")
        out = r if out is None else out.unionByName(r)
    return out


_RAW = """raw AS (SELECT flag, ts, CASE WHEN t % 11 = 0 THEN 'NA' WHEN t % 7 = 0 THEN '-999.0' WHEN t % 101 = 0 THEN 'Infinity' ELSE CAST(CAST(floor(qty) AS DOUBLE) / 4 AS VARCHAR) END AS s FROM panel_ship)"""


def _raw(spark, sf_dir):
    p = panel_ship(spark, sf_dir)
    s = F.when(F.col("t") % 11 == 0, "NA").when(F.col("t") % 7 == 0, "-999.0").when(F.col("t") % 101 == 0, "Infinity").otherwise((F.floor("qty") / 4).cast("string"))
    return p.select("flag", "ts", s.alias("s"))


def parse_index(raw, sentinel: float = -999.0, columns: tuple[str, ...] = ("ts", "s")):
    """Value and status of every entry of a text index; a table without its columns is an error."""
    missing = [c for c in columns if c not in raw.columns]
    if missing:
        raise ValueError(f"index without columns {missing}")
    v = F.expr("try_cast(s AS double)")
    inf = F.abs(v) == F.lit(float("inf"))
    status = F.when(v == sentinel, "sentinel").when(v.isNull(), "missing").when(F.isnan(v) | inf, "not finite").otherwise("ok")
    return raw.select(*[c for c in raw.columns if c != "s"], F.when(status == "ok", v).alias("value"), status.alias("status"))


@query(ctes("panel_ship") + f", {_RAW} SELECT flag, ts, CASE WHEN v <> -999.0 AND isfinite(v) THEN v END AS value, CASE WHEN v = -999.0 THEN 'sentinel' WHEN v IS NULL THEN 'missing' WHEN NOT isfinite(v) THEN 'not finite' ELSE 'ok' END AS status FROM (SELECT *, TRY_CAST(s AS DOUBLE) AS v FROM raw)")
def index_parse(spark, sf_dir):
    """Daily index of every flag."""
    return parse_index(_raw(spark, sf_dir))


@query(ctes("panel_ship") + f", {_RAW}, e AS (SELECT flag, CAST(unnest(generate_series((SELECT min(ts) FROM raw)::TIMESTAMP, (SELECT max(ts) FROM raw)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS ts FROM (SELECT DISTINCT flag FROM raw)) SELECT e.flag, count(r.ts) AS n_rows, count(DISTINCT r.ts) AS n_dates, count(*) FILTER (r.ts IS NULL) AS missing, count(*) FILTER (TRY_CAST(r.s AS DOUBLE) < 0) AS below_range FROM e LEFT JOIN raw r ON r.flag = e.flag AND r.ts = e.ts GROUP BY 1")
def index_profile(spark, sf_dir):
    """Rows, dates and missing days of every flag between the first and the last day of all."""
    r = _raw(spark, sf_dir).select("flag", "ts", F.expr("try_cast(s AS double)").alias("v"), F.lit(True).alias("given"))
    ends = r.agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    e = r.select("flag").distinct().crossJoin(F.broadcast(ends)).select("flag", F.explode(F.sequence("a", "b")).alias("ts"))  # one row
    j = e.join(r.hint("shuffle_merge"), ["flag", "ts"], "left")
    return j.groupBy("flag").agg(F.count("given").alias("n_rows"), F.count_distinct(F.when(F.col("given"), F.col("ts"))).alias("n_dates"), F.count_if(F.col("given").isNull()).alias("missing"), F.count_if(F.col("v") < 0).alias("below_range"))


@query(ctes("panel_ship") + ", f AS (SELECT flag, qty / 8 AS v FROM panel_ship) SELECT flag, count(*) AS n, round(max(abs(v - round(v, 3))), 10) AS worst, count(*) FILTER (abs(v - round(v, 3)) > 0.0004) AS off FROM f GROUP BY 1")
def fixed_width_crosscheck(spark, sf_dir):
    """Fixed-width text (year 4, month 3, day 3, value 12.3) written to the shared folder, read as text and held against the values."""
    f = panel_ship(spark, sf_dir).select("flag", "ts", (F.col("qty") / 8).alias("v"))
    path = f"{shared_folder(spark)}/fixed-width-{uuid.uuid4().hex}"
    line = F.concat(F.format_string("%4d%3d%3d%12.3f", F.year("ts"), F.month("ts"), F.dayofmonth("ts"), F.round("v", 3)), "flag")
    f.select(line.alias("value")).write.text(path)
    part = lambda a, n: F.trim(F.substring("value", a, n))
    back = spark.read.text(path).select(part(23, 10).alias("flag"), F.make_date(part(1, 4).cast("int"), part(5, 3).cast("int"), part(8, 3).cast("int")).alias("ts"), F.try_to_number(part(11, 12), F.lit("999999999.999")).cast("double").alias("w"))
    d = F.abs(F.col("v") - F.col("w"))
    return f.join(back.hint("shuffle_merge"), ["flag", "ts"], "full").groupBy("flag").agg(F.count("*").alias("n"), F.round(F.max(d), 10).alias("worst"), F.count_if(d > 0.0004).alias("off"))


_RAW_ALL = """raw AS (SELECT node, t, ts, CASE WHEN t % 11 = 0 THEN 'NA' WHEN t % 7 = 0 THEN '-999.0' ELSE CAST(CAST(n AS DOUBLE) / 4 AS VARCHAR) END AS s FROM panel_orders)"""


def _raw_all(spark, sf_dir):
    p = panel_orders(spark, sf_dir)
    return p.select("node", "t", "ts", F.when(F.col("t") % 11 == 0, "NA").when(F.col("t") % 7 == 0, "-999.0").otherwise((F.col("n") / 4).cast("string")).alias("s"))


@query(ctes("panel_orders") + f", {_RAW_ALL} SELECT node, ts, TRY_CAST(CASE WHEN s = '-999.0' THEN NULL ELSE s END AS DOUBLE) AS value, CASE WHEN s = '-999.0' THEN 'sentinel' WHEN TRY_CAST(s AS DOUBLE) IS NULL THEN 'missing' ELSE 'ok' END AS status FROM raw")
def index_parse_all(spark, sf_dir):
    """As index_parse, for every node."""
    v = F.expr("try_cast(s AS double)")
    return _raw_all(spark, sf_dir).select("node", "ts", F.when(v != -999.0, v).alias("value"), F.when(v == -999.0, "sentinel").when(v.isNull(), "missing").otherwise("ok").alias("status"))


@query(ctes("panel_orders") + f", {_RAW_ALL}, e AS (SELECT node, CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-12-01', INTERVAL 1 MONTH)) AS DATE) AS ts FROM (SELECT DISTINCT node FROM raw)) SELECT coalesce(r.node, e.node) AS node, count(r.ts) AS n_rows, count(DISTINCT r.ts) AS n_dates, count(*) FILTER (r.ts IS NULL) AS missing, count(*) FILTER (e.ts IS NULL) AS unexpected, count(*) FILTER (TRY_CAST(r.s AS DOUBLE) < 0) AS below_range FROM raw r FULL JOIN e ON r.node = e.node AND r.ts = e.ts GROUP BY 1")
def index_profile_all(spark, sf_dir):
    """As index_profile, by node."""
    return profile_nodes(_raw_all(spark, sf_dir))


def profile_nodes(raw, first: str = "1995-01-01", last: str = "2001-12-01"):
    """Rows, dates and gaps of each node against the months ``first`` to ``last``; months outside are counted as unexpected."""
    r = raw.select("node", "ts", F.expr("try_cast(s AS double)").alias("v"), F.lit(True).alias("given"))
    e = raw.select("node").distinct().select("node", F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 month"))).alias("ts"), F.lit(True).alias("expected"))
    return r.join(e, ["node", "ts"], "full").groupBy("node").agg(
        F.count("given").alias("n_rows"), F.count_distinct(F.when(F.col("given"), F.col("ts"))).alias("n_dates"), F.count_if(F.col("given").isNull()).alias("missing"), F.count_if(F.col("expected").isNull()).alias("unexpected"), F.count_if(F.col("v") < 0).alias("below_range")
    )


@query(ctes("panel_orders") + ", f AS (SELECT node, CAST(n AS DOUBLE) / 8 AS v FROM panel_orders) SELECT node, count(*) AS n, round(max(abs(v - round(v, 3))), 10) AS worst, count(*) FILTER (abs(v - round(v, 3)) > 0.0004) AS off FROM f GROUP BY 1")
def fixed_width_crosscheck_all(spark, sf_dir):
    """As fixed_width_crosscheck, by node."""
    f = panel_orders(spark, sf_dir).select("node", "ts", (F.col("n") / 8).alias("v"))
    line = F.format_string("%4d%3d%3d%9.3f", F.year("ts"), F.month("ts"), F.dayofmonth("ts"), F.round("v", 3))
    back = f.select("node", line.alias("line")).select("node", F.make_date(F.expr("int(trim(substring(line, 1, 4)))"), F.expr("int(trim(substring(line, 5, 3)))"), F.expr("int(trim(substring(line, 8, 3)))")).alias("ts"), F.expr("try_cast(trim(substring(line, 11, 9)) AS double)").alias("w"))
    d = F.abs(F.col("v") - F.col("w"))
    return f.join(back, ["node", "ts"], "full").groupBy("node").agg(F.count("*").alias("n"), F.round(F.max(d), 10).alias("worst"), F.count_if(d > 0.0004).alias("off"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 256 BETWEEN 10 AND 250 AND l_partkey % 256 <> 200 THEN round(l_partkey % 256 * 0.4 + 2.5, 8) END AS value FROM lineitem")
def packed_decode(spark, sf_dir):
    raw = F.col("l_partkey") % 256
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(raw.between(10, 250) & (raw != 200), F.round(raw * F.lit(0.4) + 2.5, 8)).alias("value"))


@query("SELECT rule, n FROM (SELECT count(*) FILTER (l_discount < 0.01 OR l_discount > 0.09) AS share_range, count(*) FILTER (l_shipdate IS NULL) AS no_time, count(*) FILTER (l_quantity <> floor(l_quantity)) AS not_whole FROM lineitem) UNPIVOT (n FOR rule IN (share_range, no_time, not_whole))")
def input_contract(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").agg(F.count_if((F.col("l_discount") < 0.01) | (F.col("l_discount") > 0.09)).alias("share_range"), F.count_if(F.col("l_shipdate").isNull()).alias("no_time"), F.count_if(F.col("l_quantity") != F.floor("l_quantity")).alias("not_whole"))
    return v.unpivot([], ["share_range", "no_time", "not_whole"], "rule", "n")


@query("""SELECT status, count(*) AS n FROM (SELECT CASE WHEN doc_id % 17 = 0 THEN 'missing' WHEN doc_id % 19 = 0 THEN 'unlisted' WHEN doc_id % 5 = 0 THEN 'size' WHEN doc_id % 7 = 0 THEN 'hash' ELSE 'ok' END AS status FROM documents WHERE NOT (doc_id % 17 = 0 AND doc_id % 19 = 0)) GROUP BY 1""")
def artifact_check(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), "doc_id", F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("sha256"))
    listed = d.filter("doc_id % 19 <> 0").withColumn("bytes", F.col("bytes") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)).withColumn("sha256", F.when(F.col("doc_id") % 7 == 0, F.reverse("sha256")).otherwise(F.col("sha256")))
    return readers.check_artifacts(d.filter("doc_id % 17 <> 0"), listed.drop("doc_id")).groupBy("status").agg(F.count("*").alias("n"))


@query("WITH g AS (SELECT l_partkey % 6 AS i, l_suppkey % 8 AS j, l_linenumber AS level, l_quantity AS v FROM lineitem) SELECT i * 8 + j AS node, count(*) AS n, round(avg(v), 8) AS v FROM g WHERE level = (SELECT min(level) FROM g) GROUP BY 1")
def grid_flatten(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 6).alias("i"), (F.col("l_suppkey") % 8).alias("j"), F.col("l_linenumber").alias("level"), F.col("l_quantity").alias("v"))
    first = g.agg(F.min("level").alias("level"))
    return g.join(F.broadcast(first), "level").groupBy((F.col("i") * 8 + F.col("j")).alias("node")).agg(F.count("*").alias("n"), F.round(F.avg("v"), 8).alias("v"))  # one row


@query(ctes("panel_orders") + ", e AS (SELECT m.t, n.node FROM (SELECT unnest(range(0, 80)) AS t) m CROSS JOIN (SELECT DISTINCT node FROM panel_orders) n) SELECT e.node, count(p.t) AS present, count(*) - count(p.t) AS absent FROM e LEFT JOIN panel_orders p ON p.t = e.t AND p.node = e.node GROUP BY 1")
def coverage_proof(spark, sf_dir):
    return coverage(panel_orders(spark, sf_dir))


def coverage(p):
    """Months present and absent by node, from the first to the last month of all nodes."""
    p = p.select("t", "node", F.lit(1).alias("here"))
    ends = p.agg(F.min("t").alias("low"), F.max("t").alias("high"))
    e = p.select("node").distinct().crossJoin(F.broadcast(ends)).select("node", F.explode(F.sequence("low", "high")).alias("t"))  # one row
    return e.join(p, ["t", "node"], "left").groupBy("node").agg(F.count("here").alias("present"), (F.count("*") - F.count("here")).alias("absent"))
