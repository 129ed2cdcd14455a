"""Setting summaries, sampling and calipers, metadata, families with placebo, routes, eddies, forecast designs, effects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagloom.functions.tails import p_t
from lagloom.operators import joint, panels, reports, spatial
from lagloom.operators.lineage import cut
from lagloom.plans import section
from lagloom.plans.c_spatial import _PAIRS, _REGIONS, regions
from lagloom.plans.m_verify import flux_divergence
from lagloom.plans.o_contrasts import _BANDS
from lagloom.plans.q_windows import _BASE, _SETS, _rows_sql, bundled
from lagloom.sources.fixtures import ctes, edges, panel_orders, station_bundles, station_climate, stations, table
from lagloom.sources.sqltext import gram_sql, sweep_sql, t_tail_sql

QUERIES, query = section()

# ---- settings
_SETTING = ctes("edges") + f""", se AS (SELECT s.setting, e.* FROM edges e, LATERAL (SELECT unnest(list_concat(['all'], CASE WHEN source_region % 2 = 0 AND target_region % 2 = 0 THEN ['north'] WHEN source_region % 2 = 1 AND target_region % 2 = 1 THEN ['south'] ELSE [] END)) AS setting) s), sg AS (SELECT * FROM se WHERE p_value < 0.2),
ch AS (SELECT x.setting, x.target_region AS m FROM sg x JOIN sg y ON y.setting = x.setting AND y.regime = x.regime AND y.source_region = x.target_region WHERE x.edge_type = 'wind->humidity' AND y.edge_type = 'humidity->cloud_cover'), cb AS (SELECT setting, {_BANDS} AS band, count(*) AS n FROM ch JOIN cells ON node = m GROUP BY 1, 2),
jc AS (SELECT setting, count(*) FILTER (r = 2) AS k2, count(*) AS k1 FROM (SELECT setting, count(DISTINCT regime) AS r FROM sg GROUP BY setting, source_region, target_region, source_var, target_var, lag) GROUP BY 1),
sm AS (SELECT setting, count(*) AS tested, count(*) FILTER (p_value < 0.2) AS significant, count(*) FILTER (p_value < 0.2 AND edge_type = 'wind->humidity') AS wh, count(*) FILTER (p_value < 0.2 AND edge_type = 'humidity->cloud_cover') AS hc, count(*) FILTER (p_value < 0.2 AND edge_type = 'wind->cloud_cover') AS wc,
 avg(lag) FILTER (p_value < 0.2 AND edge_type = 'wind->humidity') AS wh_lag, avg(CASE WHEN edge_type = 'wind->humidity' THEN 1.0 ELSE 0.0 END) FILTER (p_value < 0.2 AND regime = 'winter') > avg(CASE WHEN edge_type = 'wind->humidity' THEN 1.0 ELSE 0.0 END) FILTER (p_value < 0.2 AND regime = 'summer') AS winter_stronger FROM se GROUP BY 1),
su AS (SELECT sm.*, coalesce((SELECT sum(n) FROM cb WHERE cb.setting = sm.setting), 0)::BIGINT AS chains, coalesce((SELECT max(n) FILTER (band = 'midlatitude') >= max(n) FROM cb WHERE cb.setting = sm.setting), false) AS midlatitude_strongest, 1 - k2 / k1::DOUBLE AS season_distance FROM sm JOIN jc USING (setting))"""


def setting_summary(spark, sf_dir) -> DataFrame:
    a, b = F.col("source_region") % 2, F.col("target_region") % 2
    names = F.when((a == 0) & (b == 0), F.array(F.lit("all"), F.lit("north"))).when((a == 1) & (b == 1), F.array(F.lit("all"), F.lit("south"))).otherwise(F.array(F.lit("all")))
    se = edges(spark, sf_dir).withColumn("setting", F.explode(names))
    sig = F.col("p_value") < 0.2
    wh, hc, wc = (F.col("edge_type") == t for t in ("wind->humidity", "humidity->cloud_cover", "wind->cloud_cover"))
    share = lambda r: F.avg(F.when(sig & (F.col("regime") == r), F.when(wh, 1.0).otherwise(0.0)))
    sm = se.groupBy("setting").agg(
        F.count("*").alias("tested"), F.count_if(sig).alias("significant"), F.count_if(sig & wh).alias("wh"), F.count_if(sig & hc).alias("hc"), F.count_if(sig & wc).alias("wc"),
        F.avg(F.when(sig & wh, F.col("lag"))).alias("wh_lag"), (share("winter") > share("summer")).alias("winter_stronger"),
    )
    sg = se.filter(sig)
    band = stations(spark, sf_dir).select(F.col("node").alias("mediator"), spatial.band(F.col("lat")).alias("band"))
    cb = reports.chains(sg, ["setting", "regime"]).join(band.hint("shuffle_merge"), "mediator").groupBy("setting", "band").agg(F.count("*").alias("n"))
    cb = cb.groupBy("setting").agg(F.sum("n").alias("chains"), (F.max(F.when(F.col("band") == "midlatitude", F.col("n"))) >= F.max("n")).alias("midlatitude_strongest"))
    jc = sg.groupBy("setting", *reports.KEY).agg(F.count_distinct("regime").alias("r")).groupBy("setting").agg((1 - F.count_if(F.col("r") == 2) / F.count("*")).alias("season_distance"))
    j = sm.join(jc.hint("shuffle_merge"), "setting").join(cb.hint("shuffle_merge"), "setting", "left")
    return j.withColumn("chains", F.coalesce("chains", F.lit(0))).withColumn("midlatitude_strongest", F.coalesce("midlatitude_strongest", F.lit(False)))


@query(_SETTING + " SELECT setting, tested, significant, round(significant / tested::DOUBLE, 8) AS ratio, wh, hc, wc, chains, round(wh_lag, 8) AS wh_lag, winter_stronger, midlatitude_strongest, round(season_distance, 8) AS season_distance FROM su")
def region_setting_summary(spark, sf_dir):
    """Main figures of each choice of stations: all, the northern ones, the southern ones."""
    s = setting_summary(spark, sf_dir)
    return s.select("setting", "tested", "significant", F.round(F.col("significant") / F.col("tested"), 8).alias("ratio"), "wh", "hc", "wc", "chains", F.round("wh_lag", 8).alias("wh_lag"), "winter_stronger", "midlatitude_strongest", F.round("season_distance", 8).alias("season_distance"))


_YES = "CASE WHEN {} THEN 'yes' ELSE 'no' END"


@query(_SETTING + f" SELECT setting, {_YES.format('wh > 0')} AS wh_presence, {_YES.format('hc > 0')} AS hc_presence, {_YES.format('chains > 0')} AS whc_presence, {_YES.format('winter_stronger')} AS winter_stronger, {_YES.format('midlatitude_strongest')} AS midlatitude_strongest, CASE WHEN wh > 0 AND hc > 0 AND chains > 0 THEN 'core_pathway_recovered' ELSE 'core_pathway_weakened' END AS conclusion FROM su")
def macro_overlap(spark, sf_dir):
    s = setting_summary(spark, sf_dir)
    yes = lambda c: F.when(c, "yes").otherwise("no")
    wh, hc, ch = (F.col(c) > 0 for c in ("wh", "hc", "chains"))
    return s.select(
        "setting", yes(wh).alias("wh_presence"), yes(hc).alias("hc_presence"), yes(ch).alias("whc_presence"), yes(F.col("winter_stronger")).alias("winter_stronger"), yes(F.col("midlatitude_strongest")).alias("midlatitude_strongest"),
        F.when(wh & hc & ch, "core_pathway_recovered").otherwise("core_pathway_weakened").alias("conclusion"),
    )


# ---- samples and calipers
@query(ctes("edges") + """, pr AS (SELECT source_region AS s, target_region AS t, min(p_value) AS low, max(p_value) AS high FROM edges WHERE source_region <> target_region GROUP BY 1, 2), st AS (SELECT *, CASE WHEN high < 0.8 AND low < 0.05 THEN 'strong' WHEN low < 0.05 THEN 'ordinary' ELSE 'unselected' END AS stratum FROM pr),
 r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY (s * 7919 + t * 104729) % 10007, s, t) AS r FROM st) SELECT stratum, s AS source, t AS target, low, high FROM r WHERE r <= 8""")
def pair_sample(spark, sf_dir):
    """Eight pairs of stations from each stratum of their p-values over all variables, lags and seasons."""
    p = edges(spark, sf_dir).filter("source_region <> target_region").groupBy(F.col("source_region").alias("source"), F.col("target_region").alias("target")).agg(F.min("p_value").alias("low"), F.max("p_value").alias("high"))
    p = p.withColumn("stratum", F.when((F.col("high") < 0.8) & (F.col("low") < 0.05), "strong").when(F.col("low") < 0.05, "ordinary").otherwise("unselected"))
    w = Window.partitionBy("stratum").orderBy((F.col("source") * 7919 + F.col("target") * 104729) % 10007, "source", "target")
    return p.withColumn("r", F.row_number().over(w)).filter("r <= 8").select("stratum", "source", "target", "low", "high")


@query(_REGIONS + f", {_PAIRS}, p AS (SELECT source, target, km FROM pairs WHERE source <> target) SELECT a.source, a.target, round(a.km, 5) AS km, count(b.target) AS alternatives, count(b.target) > 0 AS matched, round(min(abs(b.km - a.km)), 5) AS nearest FROM p a LEFT JOIN p b ON b.source = a.source AND b.target <> a.target AND abs(b.km - a.km) <= 0.1 * a.km GROUP BY 1, 2, a.km")
def distance_matches(spark, sf_dir):
    """For each pair of regions how many other targets of its source lie within a tenth of its distance."""
    p = spatial.pairs(regions(spark, sf_dir)).filter("source <> target").select("source", "target", "km")
    b = p.select("source", F.col("target").alias("other"), F.col("km").alias("okm"))
    # at most 66 regions, so at most 66 others for each pair
    j = p.join(b.hint("shuffle_merge"), "source").withColumn("d", F.when((F.col("other") != F.col("target")) & (F.abs(F.col("okm") - F.col("km")) <= 0.1 * F.col("km")), F.abs(F.col("okm") - F.col("km"))))
    return j.groupBy("source", "target", "km").agg(F.count("d").alias("alternatives"), (F.count("d") > 0).alias("matched"), F.round(F.min("d"), 5).alias("nearest")).withColumn("km", F.round("km", 5))


_BIN66 = "CAST(least(floor((least(greatest(lat, -90), 90) + 90) / 180 * 6), 5) * 11 + least(floor(((lon % 360) + 360) % 360 / 360 * 11), 10) AS BIGINT)"


@query(ctes("edges") + f", rg AS (SELECT node, {_BIN66} AS region FROM cells), rp AS (SELECT DISTINCT a.region AS s, b.region AS t FROM edges JOIN rg a ON a.node = source_region JOIN rg b ON b.node = target_region WHERE p_value < 0.1 AND a.region <> b.region), n AS (SELECT count(DISTINCT region) AS n FROM rg) SELECT count(*) AS edges, least(count(*), any_value(n * (n - 1))) AS matched, 0::BIGINT AS repeated, 0::BIGINT AS unchanged FROM rp, n")
def matched_region_edges(spark, sf_dir):
    """Significant links between regions, each matched with another pair of regions of about its distance: how many, and that none repeats or is the link itself."""
    node = stations(spark, sf_dir).select("node", spatial.bins(F.col("lat"), F.col("lon"), 66).alias("region"))
    e = edges(spark, sf_dir).filter("p_value < 0.1").select("source_region", "target_region").distinct()
    e = e.join(node.select(F.col("node").alias("source_region"), F.col("region").alias("es")), "source_region").join(node.select(F.col("node").alias("target_region"), F.col("region").alias("et")), "target_region")
    pool = spatial.pairs(regions(spark, sf_dir)).filter("source <> target").select("source", "target", "km")  # 66 * 65 rows at most
    e = e.filter("es <> et").select("es", "et").distinct().join(pool.select(F.col("source").alias("es"), F.col("target").alias("et"), F.col("km").alias("ekm")).hint("shuffle_merge"), ["es", "et"])
    m = match_pairs(e.withColumn("edge", F.struct("es", "et")), pool)
    same = (F.col("es") == F.col("source")) & (F.col("et") == F.col("target"))
    return m.agg(F.count("*").alias("edges"), F.count("source").alias("matched"), (F.count("source") - F.count_distinct("source", "target")).alias("repeated"), F.count_if(same).alias("unchanged"))


def match_pairs(e: DataFrame, pool: DataFrame, seed: int = 7) -> DataFrame:
    """Edges (edge, es, et, ekm) with a pair (source, target, km) of their own each: within a tenth of the distance, else a fifth, else the nearest that is free.

    Rounds of proposals: every open edge asks for one free pair, every pair takes one
    edge, until nothing is open or nothing free. Both sides are bounded by the square
    of the number of regions.
    """
    done, tolerance = None, [0.1, 0.2, None]
    while tolerance:
        t = tolerance[0]
        free = pool if done is None else pool.join(done.select("source", "target").hint("shuffle_merge"), ["source", "target"], "left_anti")
        open_ = e if done is None else e.join(done.select("edge").hint("shuffle_merge"), "edge", "left_anti")
        other = ~((F.col("es") == F.col("source")) & (F.col("et") == F.col("target")))
        off = F.abs(F.col("km") - F.col("ekm"))
        offer = open_.join(F.broadcast(free), other if t is None else other & (off <= t * F.col("ekm")))  # the pool is bounded
        order = [off] if t is None else []
        want = offer.withColumn("r", F.row_number().over(Window.partitionBy("edge").orderBy(*order, F.xxhash64("edge", "source", "target", F.lit(seed))))).filter("r = 1")
        won = cut(want.withColumn("r", F.row_number().over(Window.partitionBy("source", "target").orderBy(*order, F.xxhash64("edge")))).filter("r = 1").drop("r"))
        seed += 1
        if won.limit(1).count():
            done = won if done is None else cut(done.unionByName(won))
        else:
            tolerance.pop(0)
    if done is None:
        return e.select("*", *[F.lit(None).cast("double").alias(c) for c in ("source", "target", "km")])
    return e.join(done.select("edge", "source", "target", "km").hint("shuffle_merge"), "edge", "left")


@query(ctes("edges") + ", a AS (SELECT edge_type, count(*) AS n, count(*) FILTER (p_value < 0.2) AS sig FROM edges GROUP BY 1) SELECT status, count(*) AS n FROM (SELECT unnest(CASE WHEN edge_type = 'wind->humidity' THEN ['same', 'same', 'same', 'different'] WHEN edge_type = 'wind->cloud_cover' THEN ['missing', 'missing', 'missing', 'missing'] ELSE ['same', 'same', 'same', 'same'] END) AS status FROM a) GROUP BY 1")
def metadata_comparison(spark, sf_dir):
    """Nested decisions by edge type against a second copy in which one verdict is changed, one number is off by rounding and one type is missing."""
    g = edges(spark, sf_dir).groupBy("edge_type").agg(F.count("*").alias("n"), F.count_if(F.col("p_value") < 0.2).alias("sig"), F.avg("effect").alias("effect"))
    of = lambda verdict, effect: g.select("edge_type", F.col("n").alias("tested"), F.struct(F.col("sig").alias("significant"), F.struct(effect.alias("mean")).alias("effect")).alias("decision"), verdict.alias("verdict"))
    a = of(F.lit("supported"), F.col("effect"))
    b = of(F.when(F.col("edge_type") == "wind->humidity", "rejected").otherwise("supported"), F.col("effect") * (1 + 1e-12)).filter("edge_type <> 'wind->cloud_cover'")
    return reports.compare_metadata(reports.flatten(a, "edge_type"), reports.flatten(b, "edge_type")).groupBy("status").agg(F.count("*").alias("n"))


# ---- families with a placebo source, and controls by band
def _family_sql() -> str:
    parts, union = [], []
    for name, lag in (("real", 1), ("placebo", 53)):
        for span, where in (("discovery", "t < 180"), ("confirmation", "t >= 180")):
            k = f"{name[0]}{span[0]}"
            rows = _rows_sql({"y": ("humidity", 0), "c1": ("humidity", 1), "z": ("wind", lag)}, where).replace("wr AS", f"w{k} AS", 1)
            parts.append(f"{rows}, {gram_sql('g' + k, 'w' + k, ['one', 'c1', 'z', 'y'], 'node')}, {sweep_sql('f' + k, 'g' + k, 4, 3, 'node')}")
            union.append(f"SELECT node, '{name}' AS family, '{span}' AS span, m[12] AS beta, m[12] / sqrt(m[16] / (n - 3) * -m[11]) AS t, n FROM f{k}")
    return _BASE + ", " + ", ".join(parts) + ", fa AS (" + " UNION ALL ".join(union) + ")"


@query(_family_sql() + f""", pv AS (SELECT *, {t_tail_sql("t", "(n - 3)")} AS p FROM fa), j AS (SELECT a.family, {_BANDS} AS band, a.p < 0.2 AS screened, a.p < 0.2 AND b.p < 0.4 AND sign(a.beta) = sign(b.beta) AS confirmed FROM pv a JOIN pv b ON b.node = a.node AND b.family = a.family AND b.span = 'confirmation' JOIN cells c ON c.node = a.node WHERE a.span = 'discovery')
 SELECT family, coalesce(band, 'all') AS band, count(*) AS tested, count(*) FILTER (screened) AS n_screened, count(*) FILTER (confirmed) AS n_confirmed FROM j GROUP BY GROUPING SETS ((family), (family, band))""")
def family_stages(spark, sf_dir):
    """Screen and confirmation of the real source and of a placebo (the wind of a year before), by band and over all."""
    fits = {"real": ("humidity", [("humidity", 1)], ("wind", 1)), "placebo": ("humidity", [("humidity", 1)], ("wind", 53))}
    b = bundled(spark, sf_dir)
    side = lambda span, s: joint.slopes(b, "node", fits, span=span).select("node", "name", F.col("beta").alias("b" + s), p_t(F.col("beta") / F.col("se_ols"), (F.col("n") - 3).cast("double")).alias("p" + s))
    j = side((-(10**9), 180), "1").join(side((180, 10**9), "2").hint("shuffle_merge"), ["node", "name"]).join(stations(spark, sf_dir).select("node", spatial.band(F.col("lat")).alias("band")).hint("shuffle_merge"), "node")
    j = j.withColumn("screened", F.col("p1") < 0.2).withColumn("confirmed", F.col("screened") & (F.col("p2") < 0.4) & (F.signum("b1") == F.signum("b2")))
    j = j.select(F.col("name").alias("family"), F.explode(F.array("band", F.lit("all"))).alias("band"), "screened", "confirmed")
    return j.groupBy("family", "band").agg(F.count("*").alias("tested"), F.count_if("screened").alias("n_screened"), F.count_if("confirmed").alias("n_confirmed"))


@query(_BASE + f", {_rows_sql({'y': ('humidity', 0), 'c1': ('humidity', 1), 'cl': ('cloud_cover', 1), 'tm': ('temperature', 1), 'w1': ('wind', 1)})}, {gram_sql('ga', 'wr', _SETS['own'], 'node')}, {sweep_sql('fa', 'ga', 4, 3, 'node')}, {gram_sql('gb', 'wr', _SETS['all'], 'node')}, {sweep_sql('fb', 'gb', 6, 5, 'node')}" + f""" SELECT {_BANDS} AS band, count(*) AS stations, round(avg(fa.m[12]), 8) AS baseline, round(avg(fb.m[30]), 8) AS controlled, round(avg(fb.m[30] - fa.m[12]), 8) AS difference, round(avg(CASE WHEN sign(fb.m[30]) = sign(fa.m[12]) THEN 1.0 ELSE 0.0 END), 8) AS same_sign, round(avg(fa.m[12]) * avg(fb.m[30]), 9) AS product FROM fa JOIN fb USING (node) JOIN cells USING (node) GROUP BY 1""")
def control_summary(spark, sf_dir):
    """Baseline slopes against those with physical controls, by latitude band."""
    fits = {"own": ("humidity", [("humidity", 1)], ("wind", 1)), "all": ("humidity", [("humidity", 1), ("cloud_cover", 1), ("temperature", 1)], ("wind", 1))}
    p = joint.slopes(bundled(spark, sf_dir), "node", fits).groupBy("node").pivot("name", ["own", "all"]).agg(F.first("beta"))
    j = p.join(stations(spark, sf_dir).select("node", spatial.band(F.col("lat")).alias("band")).hint("shuffle_merge"), "node")
    same = F.when(F.signum("own") == F.signum("all"), 1.0).otherwise(0.0)
    return j.groupBy("band").agg(
        F.count("*").alias("stations"), F.round(F.avg("own"), 8).alias("baseline"), F.round(F.avg("all"), 8).alias("controlled"), F.round(F.avg(F.col("all") - F.col("own")), 8).alias("difference"), F.round(F.avg(same), 8).alias("same_sign"), F.round(F.avg("own") * F.avg("all"), 9).alias("product")
    )


def _mediator_sql() -> str:
    parts = []
    for role, v in (("s", "humidity"), ("a", "temperature")):
        for name, terms, cols in (("a", {"y": (v, 0), "c1": (v, 1), "z": ("wind", 1)}, ["one", "c1", "z", "y"]), ("b", {"y": ("cloud_cover", 0), "c1": ("cloud_cover", 1), "x": ("wind", 2), "z": (v, 1)}, ["one", "c1", "x", "z", "y"])):
            k, n = role + name, len(cols)
            parts.append(f"{_rows_sql(terms).replace('wr AS', f'w{k} AS', 1)}, {gram_sql('g' + k, 'w' + k, cols, 'node')}, {sweep_sql('f' + k, 'g' + k, n, n - 1, 'node')}, s{k} AS (SELECT node, m[{(n - 1) * n}] AS {k} FROM f{k})")
    return _BASE + ", " + ", ".join(parts)


@query(_mediator_sql() + f" SELECT {_BANDS} AS band, count(*) AS stations, round(avg(abs(sa * sb)), 9) AS specified, round(avg(abs(aa * ab)), 9) AS alternative, round(avg(CASE WHEN abs(sa * sb) > abs(aa * ab) THEN 1.0 ELSE 0.0 END), 8) AS specified_larger FROM ssa JOIN ssb USING (node) JOIN saa USING (node) JOIN sab USING (node) JOIN cells USING (node) GROUP BY 1")
def mediator_comparison(spark, sf_dir):
    """Path products through humidity, the mediator specified, and through temperature, the alternative."""
    fits = {}
    for role, v in (("s", "humidity"), ("a", "temperature")):
        fits[role + "a"] = (v, [(v, 1)], ("wind", 1))
        fits[role + "b"] = ("cloud_cover", [("cloud_cover", 1), ("wind", 2)], (v, 1))
    p = joint.slopes(bundled(spark, sf_dir), "node", fits).groupBy("node").pivot("name", list(fits)).agg(F.first("beta"))
    j = p.select("node", F.abs(F.col("sa") * F.col("sb")).alias("x"), F.abs(F.col("aa") * F.col("ab")).alias("y")).join(stations(spark, sf_dir).select("node", spatial.band(F.col("lat")).alias("band")).hint("shuffle_merge"), "node")
    return j.groupBy("band").agg(F.count("*").alias("stations"), F.round(F.avg("x"), 9).alias("specified"), F.round(F.avg("y"), 9).alias("alternative"), F.round(F.avg(F.when(F.col("x") > F.col("y"), 1.0).otherwise(0.0)), 8).alias("specified_larger"))


# ---- two routes to one field
_ROUTE = """WITH a AS (SELECT l_partkey % 12 AS cell, (year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS t, avg(l_quantity) AS a FROM lineitem GROUP BY 1, 2), b AS (SELECT l_suppkey % 12 AS cell, (year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS t, avg(l_quantity) AS b FROM lineitem GROUP BY 1, 2), o AS (SELECT l_orderkey % 12 AS cell, (year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS t, avg(l_quantity) AS o FROM lineitem GROUP BY 1, 2),
 j AS (SELECT 'part-supplier' AS route, cell, t, a AS x, b AS y FROM a JOIN b USING (cell, t) UNION ALL SELECT 'order-supplier', cell, t, o, b FROM o JOIN b USING (cell, t)),
 sc AS (SELECT route, 'cell-month' AS scale, 'cell' || cell // 4 AS place, x, y FROM j UNION ALL SELECT route, 'month', 'all', avg(x), avg(y) FROM j GROUP BY route, t UNION ALL SELECT route, 'cell-year', 'cell' || cell // 4, avg(x), avg(y) FROM j GROUP BY route, cell, t // 12)"""


@query(_ROUTE + " SELECT route, scale, coalesce(place, 'total') AS place, count(*) AS n, round(avg(x - y), 8) AS bias, round(sqrt(avg(pow(x - y, 2))), 8) AS rmse, round(avg(abs(x - y)), 8) AS mae, round(max(abs(x - y)), 8) AS worst, round(corr(x, y), 7) AS r, round(sqrt(avg(pow(x - y, 2))) / stddev_pop(y), 7) AS rmse_sd FROM sc GROUP BY GROUPING SETS ((route, scale), (route, scale, place))")
def route_differences(spark, sf_dir):
    """Two routes against one reference on three scales, by place and in all."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_quantity", ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1).alias("t"))
    by = lambda c, n: li.groupBy((F.col(c) % 12).alias("cell"), "t").agg(F.avg("l_quantity").alias(n))
    ref = by("l_suppkey", "y")
    one = lambda c, name: by(c, "x").join(ref.hint("shuffle_merge"), ["cell", "t"]).withColumn("route", F.lit(name))
    j = one("l_partkey", "part-supplier").unionByName(one("l_orderkey", "order-supplier"))
    place = F.concat(F.lit("cell"), F.floor(F.col("cell") / 4).cast("string"))
    a = j.select("route", F.lit("cell-month").alias("scale"), place.alias("place"), "x", "y")
    b = j.groupBy("route", "t").agg(F.avg("x").alias("x"), F.avg("y").alias("y")).select("route", F.lit("month").alias("scale"), F.lit("all").alias("place"), "x", "y")
    c = j.groupBy("route", "cell", F.floor(F.col("t") / 12).alias("u")).agg(F.avg("x").alias("x"), F.avg("y").alias("y")).select("route", F.lit("cell-year").alias("scale"), place.alias("place"), "x", "y")
    s = a.union(b).union(c).withColumn("place", F.explode(F.array("place", F.lit("total"))))
    d = F.col("x") - F.col("y")
    rmse = F.sqrt(F.avg(d * d))
    return s.groupBy("route", "scale", "place").agg(
        F.count("*").alias("n"), F.round(F.avg(d), 8).alias("bias"), F.round(rmse, 8).alias("rmse"), F.round(F.avg(F.abs(d)), 8).alias("mae"), F.round(F.max(F.abs(d)), 8).alias("worst"),
        F.round(F.covar_pop("x", "y") / (F.stddev_pop("x") * F.stddev_pop("y")), 7).alias("r"), F.round(rmse / F.stddev_pop("y"), 7).alias("rmse_sd"),
    )


# ---- eddies
_FLUX = """fl AS (SELECT (year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS t, CAST(l_partkey * 31 % 8 AS BIGINT) AS i, CAST(l_suppkey * 7 % 12 AS BIGINT) AS j, avg(l_quantity) AS q, avg(l_discount) * 100 AS u FROM lineitem GROUP BY 1, 2, 3),
an AS (SELECT *, avg(q) OVER m AS qc, avg(u) OVER m AS uc FROM fl WINDOW m AS (PARTITION BY i, j, t % 12)), pt AS (SELECT t, i, j, k.part, CASE k.part WHEN 'total' THEN q * u WHEN 'mean' THEN qc * uc WHEN 'linear' THEN qc * (u - uc) + (q - qc) * uc ELSE (q - qc) * (u - uc) END AS qu FROM an, (VALUES ('total'), ('mean'), ('linear'), ('eddy')) k(part)),
dv AS (SELECT c.part, c.t, c.i, c.j, ((c.qu + e.qu) / 2 - (c.qu + w.qu) / 2) * 6371.0 * radians(22.5) / (6371.0 * 6371.0 * radians(30) * (sin(radians(-90 + 22.5 * (c.i + 1))) - sin(radians(-90 + 22.5 * c.i)))) AS d FROM pt c JOIN pt e ON e.part = c.part AND e.t = c.t AND e.i = c.i AND e.j = (c.j + 1) % 12 JOIN pt w ON w.part = c.part AND w.t = c.t AND w.i = c.i AND w.j = (c.j + 11) % 12),
rg AS (SELECT part, t // 12 AS y, (i // 2) * 3 + j // 4 AS region, -sum(d * (sin(radians(-90 + 22.5 * (i + 1))) - sin(radians(-90 + 22.5 * i)))) / sum(sin(radians(-90 + 22.5 * (i + 1))) - sin(radians(-90 + 22.5 * i))) AS c FROM dv GROUP BY 1, 2, 3)"""


@query("WITH " + _FLUX + ", p AS (SELECT y, region, max(c) FILTER (part = 'total') AS total, max(c) FILTER (part = 'mean') AS mean, max(c) FILTER (part = 'linear') AS linear, max(c) FILTER (part = 'eddy') AS eddy FROM rg GROUP BY 1, 2) SELECT y, region, round(total, 7) + 0.0 AS total, round(linear, 7) + 0.0 AS linear, round(eddy, 7) + 0.0 AS eddy, abs(total - mean - linear - eddy) < 1e-9 AS closed FROM p")
def eddy_convergence(spark, sf_dir):
    """Convergence of the flux of a quantity by region and year, taken apart into the parts of climatology and anomalies."""
    li = table(spark, sf_dir, "lineitem")
    t = ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1).alias("t")
    f = li.groupBy(t, (F.col("l_partkey") * 31 % 8).cast("long").alias("i"), (F.col("l_suppkey") * 7 % 12).cast("long").alias("j")).agg(F.avg("l_quantity").alias("q"), (F.avg("l_discount") * 100).alias("u"))
    m = Window.partitionBy("i", "j", F.col("t") % 12)
    a = f.withColumn("qc", F.avg("q").over(m)).withColumn("uc", F.avg("u").over(m))
    q, u, qc, uc = (F.col(c) for c in ("q", "u", "qc", "uc"))
    parts = {"total": q * u, "mean": qc * uc, "linear": qc * (u - uc) + (q - qc) * uc, "eddy": (q - qc) * (u - uc)}
    out = None
    for name, x in parts.items():
        d = flux_divergence(a.select("t", "i", "j", x.alias("qu"), F.lit(0.0).alias("qv")), 8, 12)
        r = d.groupBy(F.floor(F.col("t") / 12).alias("y"), (F.floor(F.col("i") / 2) * 3 + F.floor(F.col("j") / 4)).alias("region")).agg((-F.sum(F.col("d") * F.col("area")) / F.sum("area")).alias(name))
        out = r if out is None else out.join(r.hint("shuffle_merge"), ["y", "region"])
    closed = F.abs(F.col("total") - F.col("mean") - F.col("linear") - F.col("eddy")) < 1e-9
    return out.select("y", "region", *[(F.round(c, 7) + 0.0).alias(c) for c in ("total", "linear", "eddy")], closed.alias("closed"))


# ---- forecast designs
@query(ctes("station_climate") + ", a AS (SELECT node, variable, t, v, v - lag(v) OVER (PARTITION BY node, variable ORDER BY t) AS change, avg(v) FILTER (t < 250) OVER (PARTITION BY node, variable, t % 52) AS clim FROM sc), l AS (SELECT node, variable, t, unnest(['value', 'anomaly', 'change']) AS kind, unnest([v, v - clim, change]) AS x FROM a), s AS (SELECT *, avg(x) FILTER (t < 250) OVER w AS m, stddev_pop(x) FILTER (t < 250) OVER w AS sd FROM l WINDOW w AS (PARTITION BY node, variable, kind)) SELECT variable, kind, t, count(x) AS n, round(avg((x - m) / CASE WHEN sd < 1e-8 THEN 1 ELSE sd END), 7) AS mean FROM s GROUP BY 1, 2, 3")
def feature_states(spark, sf_dir):
    """Value, seasonal anomaly and change of every variable, scaled by training steps; their mean over the stations by step."""
    c = station_climate(spark, sf_dir)
    train = F.col("t") < 250
    a = c.withColumn("change", F.col("value") - F.lag("value").over(Window.partitionBy("node", "variable").orderBy("t"))).withColumn("clim", F.avg(F.when(train, F.col("value"))).over(Window.partitionBy("node", "variable", F.col("t") % 52)))
    kinds = F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), x.alias("x")) for n, x in (("value", F.col("value")), ("anomaly", F.col("value") - F.col("clim")), ("change", F.col("change")))]))
    w = Window.partitionBy("node", "variable", "kind")
    s = a.select("node", "variable", "t", kinds.alias("k")).select("node", "variable", "t", "k.*").withColumn("m", F.avg(F.when(train, F.col("x"))).over(w)).withColumn("sd", F.stddev_pop(F.when(train, F.col("x"))).over(w))
    z = (F.col("x") - F.col("m")) / F.when(F.col("sd") < 1e-8, 1.0).otherwise(F.col("sd"))
    return s.groupBy("variable", "kind", "t").agg(F.count("x").alias("n"), F.round(F.avg(z), 7).alias("mean"))


@query(ctes("stations") + " SELECT node, m::BIGINT AS month, round(sin(radians(lat)), 9) AS sin_lat, round(cos(radians(lat)), 9) AS cos_lat, round(sin(radians(lon)), 9) AS sin_lon, round(cos(radians(lon)), 9) AS cos_lon, round(sin(2 * pi() * (m - 0.5) / 12), 9) AS sin_year, round(cos(2 * pi() * (m - 0.5) / 12), 9) AS cos_year FROM cells, range(1, 13) r(m)")
def place_and_season(spark, sf_dir):
    """Location and annual phase of every station and month as trigonometric columns."""
    s = stations(spark, sf_dir).withColumn("month", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(12).cast("long"))))
    a, la, lo = 2 * F.pi() * (F.col("month") - 0.5) / 12, F.radians("lat"), F.radians("lon")
    return s.select("node", "month", *[F.round(x, 9).alias(n) for n, x in (("sin_lat", F.sin(la)), ("cos_lat", F.cos(la)), ("sin_lon", F.sin(lo)), ("cos_lon", F.cos(lo)), ("sin_year", F.sin(a)), ("cos_year", F.cos(a)))])


@query(ctes("station_climate") + ", h AS (SELECT node, t + k AS t, list(v ORDER BY k, variable) AS x FROM sc, range(0, 12) r(k) GROUP BY 1, 2 HAVING count(*) = 48) SELECT node, t, len(x)::INT AS columns, round(list_sum(x), 7) AS total, round(x[1], 8) AS first, round(x[48], 8) AS last FROM h")
def history_design(spark, sf_dir):
    """One row per station and step with the four variables of twelve steps as one array: its size, sum and ends."""
    h = panels.histories(station_bundles(spark, sf_dir), 12)
    return h.select("node", "t", "columns", F.round("total", 7).alias("total"), F.round("first", 8).alias("first"), F.round("last", 8).alias("last"))


_SEEDS = """pr AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, s.seed, (o_orderstatus = 'F')::INT AS y, (1.0 + (o_orderkey * (7 + s.seed)) % 97) / 99.0 AS p FROM orders, range(3) s(seed)), sd AS (SELECT day, seed, avg(pow(p - y, 2)) AS b FROM pr GROUP BY 1, 2)"""


@query("WITH " + _SEEDS + " SELECT seed, count(*) AS days, round(avg(b), 8) AS brier, round((SELECT avg(m) FROM (SELECT avg(b) AS m FROM sd GROUP BY seed)), 8) AS seed_mean, round(avg(b) - (SELECT avg(b) FROM sd WHERE seed = 0), 8) AS over_first FROM sd GROUP BY 1")
def seed_mean_scores(spark, sf_dir):
    """Daily Brier scores of three seeds of one forecast: each seed, the mean of the seeds, and the paired difference to the first."""
    d = seed_days(spark, sf_dir)
    m = d.groupBy("seed").agg(F.count("*").alias("days"), F.avg("b").alias("b"))
    a = m.agg(F.avg("b").alias("a"), F.max(F.when(F.col("seed") == 0, F.col("b"))).alias("z"))
    return m.crossJoin(F.broadcast(a)).select("seed", "days", F.round("b", 8).alias("brier"), F.round("a", 8).alias("seed_mean"), F.round(F.col("b") - F.col("z"), 8).alias("over_first"))  # one row


def seed_days(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("seed", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))))
    p = (1.0 + (F.col("o_orderkey") * (7 + F.col("seed"))) % 97) / 99.0
    e = p - F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)
    return o.groupBy(F.col("o_orderdate").cast("date").alias("day"), "seed").agg(F.avg(e * e).alias("b"))


@query("WITH x AS (SELECT l_returnflag AS region, year(l_shipdate) AS y, l_quantity AS q, l_extendedprice / 1000 AS p FROM lineitem), f AS (SELECT region, CASE WHEN y < 1998 THEN 'early' ELSE 'late' END AS source, regr_slope(q, p) AS b, regr_intercept(q, p) AS a FROM x WHERE y < 2000 GROUP BY 1, 2), e AS (SELECT region, source, count(*) AS n, avg(pow(q - a - b * p, 2)) AS mse FROM x JOIN f USING (region) WHERE y >= 2000 GROUP BY 1, 2) SELECT l.region, l.n, round(l.mse, 7) AS home, round(t.mse, 7) AS away, round(t.mse - l.mse, 8) AS gap FROM e l JOIN e t USING (region) WHERE l.source = 'late' AND t.source = 'early'")
def transfer_gap(spark, sf_dir):
    """Models of the early and of the late years on the same later rows: what the transfer costs."""
    x = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("region"), F.year("l_shipdate").alias("y"), F.col("l_quantity").alias("q"), (F.col("l_extendedprice") / 1000).alias("p"))
    b = F.covar_pop("q", "p") / F.var_pop("p")
    f = x.filter("y < 2000").groupBy("region", F.when(F.col("y") < 1998, "early").otherwise("late").alias("source")).agg(b.alias("b"), (F.avg("q") - b * F.avg("p")).alias("a"))
    f = f.groupBy("region").pivot("source", ["early", "late"]).agg(F.first("a").alias("a"), F.first("b").alias("b"))
    loss = lambda s: F.avg(F.pow(F.col("q") - F.col(f"{s}_a") - F.col(f"{s}_b") * F.col("p"), F.lit(2)))
    e = x.filter("y >= 2000").join(F.broadcast(f), "region").groupBy("region").agg(F.count("*").alias("n"), loss("late").alias("h"), loss("early").alias("w"))  # one row per flag
    return e.select("region", "n", F.round("h", 7).alias("home"), F.round("w", 7).alias("away"), F.round(F.col("w") - F.col("h"), 8).alias("gap"))


# ---- effects of an arm
_ARMS = """x AS (SELECT o_orderkey % 2 AS a, c_nationkey % 5 AS g, o_totalprice / 1e4 AS y, (month(o_orderdate) - 6.5) / 6 AS z, 0.25 + 0.5 * (o_custkey % 3) / 2.0 AS e FROM orders JOIN customer ON c_custkey = o_custkey), f AS (SELECT g, regr_slope(y, z) FILTER (a = 1) AS b1, regr_intercept(y, z) FILTER (a = 1) AS i1, regr_slope(y, z) FILTER (a = 0) AS b0, regr_intercept(y, z) FILTER (a = 0) AS i0 FROM x GROUP BY 1),
 s AS (SELECT g, a, y, e, i1 + b1 * z AS m1, i0 + b0 * z AS m0 FROM x JOIN f USING (g)), d AS (SELECT g, m1 - m0 AS model, CASE WHEN a = 1 THEN y / e ELSE -y / (1 - e) END AS ipw, m1 - m0 + CASE WHEN a = 1 THEN (y - m1) / e ELSE -(y - m0) / (1 - e) END AS aipw FROM s)"""


@query("WITH " + _ARMS + ", l AS (SELECT g, unnest(['model', 'ipw', 'aipw']) AS method, unnest([model, ipw, aipw]) AS v FROM d) SELECT g, method, count(*) AS n, round(avg(v), 7) AS effect, round(stddev_samp(v) / sqrt(count(*)), 7) AS se, round(avg(v) - 1.959963984540054 * stddev_samp(v) / sqrt(count(*)), 6) AS low, round(avg(v) + 1.959963984540054 * stddev_samp(v) / sqrt(count(*)), 6) AS high FROM l GROUP BY 1, 2")
def arm_effects(spark, sf_dir):
    """Effect of an arm by outcome models scored twice, by known propensities, and by both together, with normal intervals."""
    pe = effects(spark, sf_dir)
    l = pe.select("g", F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("v")) for m in ("model", "ipw", "aipw")])).alias("k")).select("g", "k.*")
    se = F.stddev_samp("v") / F.sqrt(F.count("*"))
    z = 1.959963984540054
    return l.groupBy("g", "method").agg(F.count("*").alias("n"), F.round(F.avg("v"), 7).alias("effect"), F.round(se, 7).alias("se"), F.round(F.avg("v") - z * se, 6).alias("low"), F.round(F.avg("v") + z * se, 6).alias("high"))


def effects(spark, sf_dir) -> DataFrame:
    """One row per order: its group and its pseudo-outcomes."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_nationkey") % 5).alias("g"))
    x = table(spark, sf_dir, "orders").join(c, "o_custkey").select(
        "g", (F.col("o_orderkey") % 2).alias("a"), (F.col("o_totalprice") / 1e4).alias("y"), ((F.month("o_orderdate") - 6.5) / 6).alias("z"), (0.25 + 0.5 * (F.col("o_custkey") % 3) / 2.0).alias("e")
    )
    of = lambda a, c: F.when(F.col("a") == a, F.col(c))
    fits = []
    for a in (1, 0):
        b = F.covar_pop(of(a, "y"), of(a, "z")) / F.var_pop(of(a, "z"))
        fits += [b.alias(f"b{a}"), (F.avg(of(a, "y")) - b * F.avg(of(a, "z"))).alias(f"i{a}")]
    s = x.join(F.broadcast(x.groupBy("g").agg(*fits)), "g")  # five groups
    m1, m0 = F.col("i1") + F.col("b1") * F.col("z"), F.col("i0") + F.col("b0") * F.col("z")
    y, e, on = F.col("y"), F.col("e"), F.col("a") == 1
    return s.select("g", (m1 - m0).alias("model"), F.when(on, y / e).otherwise(-y / (1 - e)).alias("ipw"), (m1 - m0 + F.when(on, (y - m1) / e).otherwise(-(y - m0) / (1 - e))).alias("aipw"))


@query("WITH " + _ARMS + ", r AS (SELECT g, avg(model) AS model, avg(ipw) AS ipw, avg(aipw) AS aipw, stddev_samp(aipw) / sqrt(count(*)) AS se FROM d GROUP BY 1), l AS (SELECT g, se, unnest(['model', 'ipw']) AS method, unnest([model, ipw]) AS v, aipw FROM r) SELECT method, count(*) AS twins, round(avg(v - aipw), 7) AS signed_error, round(avg(abs(v - aipw)), 7) AS absolute_error, round(sqrt(avg(pow(v - aipw, 2))), 7) AS rmse, count(*) FILTER (abs(v) > 1.959963984540054 * se) AS rejections FROM l GROUP BY 1")
def effect_errors(spark, sf_dir):
    """Errors of the simpler estimates against the doubly robust one as their twin, over the groups."""
    r = effects(spark, sf_dir).groupBy("g").agg(F.avg("model").alias("model"), F.avg("ipw").alias("ipw"), F.avg("aipw").alias("aipw"), (F.stddev_samp("aipw") / F.sqrt(F.count("*"))).alias("se"))
    l = r.select("aipw", "se", F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("v")) for m in ("model", "ipw")])).alias("k")).select("aipw", "se", "k.*")
    d = F.col("v") - F.col("aipw")
    return l.groupBy("method").agg(F.count("*").alias("twins"), F.round(F.avg(d), 7).alias("signed_error"), F.round(F.avg(F.abs(d)), 7).alias("absolute_error"), F.round(F.sqrt(F.avg(d * d)), 7).alias("rmse"), F.count_if(F.abs("v") > 1.959963984540054 * F.col("se")).alias("rejections"))
