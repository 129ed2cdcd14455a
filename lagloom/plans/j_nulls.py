"""Nulls, resampling and directional controls, with draws by arithmetic on replicate and position."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lagloom.operators.lineage import cut
from lagloom.operators.ranks import rank_by_ranges
from lagloom.plans import section
from lagloom.sources.fixtures import ctes, edges, panel, panel_ship, stations

QUERIES, query = section()
_P = "p AS (SELECT t, node, wind, humidity FROM panel)"


@query(ctes("panel") + """, m AS (SELECT t, avg(humidity) AS x, row_number() OVER (ORDER BY t) - 1 AS pos FROM panel GROUP BY 1), n AS (SELECT count(*) AS n FROM m), b AS (SELECT r, k, (r * 7919 + k * 104729) % (n - 15) AS start FROM n, range(20) a(r), range((n + 15) // 16) b(k)),
 s AS (SELECT r, k * 16 + o AS slot, start + o AS pos FROM b, range(16) c(o), n WHERE k * 16 + o < n), e AS (SELECT r, avg(x) AS mean FROM s JOIN m USING (pos) GROUP BY 1) SELECT count(*) AS draws, round(avg(mean), 9) AS mean, round(quantile_cont(mean, 0.025), 9) AS low, round(quantile_cont(mean, 0.975), 9) AS high FROM e""")
def block_bootstrap(spark, sf_dir):
    m = panel(spark, sf_dir).groupBy("t").agg(F.avg("humidity").alias("x"))
    m = m.withColumn("pos", F.row_number().over(Window.orderBy("t")) - 1)  # one row per calendar step
    n = m.agg(F.count("*").alias("n"))
    r = n.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(19)))).withColumn("k", F.explode(F.sequence(F.lit(0), (F.floor((F.col("n") + 15) / 16) - 1).cast("int"))))
    s = r.withColumn("start", (F.col("r") * 7919 + F.col("k") * 104729) % (F.col("n") - 15)).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(15)))).filter("k * 16 + o < n")
    e = s.select("r", (F.col("start") + F.col("o")).cast("int").alias("pos")).join(m.select("pos", "x").hint("shuffle_hash"), "pos").groupBy("r").agg(F.avg("x").alias("mean"))
    q = F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975)))
    return e.agg(F.count("*").alias("draws"), F.round(F.avg("mean"), 9).alias("mean"), q.alias("q")).select("draws", "mean", F.round(F.col("q")[0], 9).alias("low"), F.round(F.col("q")[1], 9).alias("high"))


_SHIFT = "s AS (SELECT k.shift, a.node AS source, b.node AS target, corr(a.wind, b.humidity) AS c FROM p b CROSS JOIN (SELECT unnest([0, 37, 101, 173]) AS shift) k JOIN p a ON a.t = (b.t - 1 - k.shift + 10 * (SELECT max(t) + 1 FROM p)) % (SELECT max(t) + 1 FROM p) WHERE b.t > 0 GROUP BY 1, 2, 3)"


@query(ctes("panel") + f", {_P}, {_SHIFT} SELECT shift, count(*) AS pairs, round(avg(abs(c)), 8) AS strength, round(max(abs(c)), 8) AS strongest FROM s GROUP BY 1")
def circular_shift_control(spark, sf_dir):
    p = panel(spark, sf_dir)
    n = p.agg((F.max("t") + 1).alias("n"))
    b = p.filter("t > 0").select("t", F.col("node").alias("target"), F.col("humidity").alias("y")).crossJoin(F.broadcast(n)).withColumn("shift", F.explode(F.array(*[F.lit(k) for k in (0, 37, 101, 173)])))  # one row
    b = b.withColumn("t", F.pmod(F.col("t") - 1 - F.col("shift"), F.col("n")))
    j = b.join(p.select("t", F.col("node").alias("source"), F.col("wind").alias("x")), "t")
    c = j.groupBy("shift", "source", "target").agg((F.covar_pop("x", "y") / (F.stddev_pop("x") * F.stddev_pop("y"))).alias("c"))
    return c.groupBy("shift").agg(F.count("*").alias("pairs"), F.round(F.avg(F.abs("c")), 8).alias("strength"), F.round(F.max(F.abs("c")), 8).alias("strongest"))


@query(ctes("panel") + f", {_P}, r AS (SELECT (SELECT max(t) FROM p) - t AS t, node, wind, humidity FROM p), c AS (SELECT 'forward' AS d, a.node AS s, b.node AS g, corr(a.wind, b.humidity) AS c FROM p a JOIN p b ON b.t = a.t + 1 GROUP BY 2, 3 UNION ALL SELECT 'reversed', a.node, b.node, corr(a.wind, b.humidity) FROM r a JOIN r b ON b.t = a.t + 1 GROUP BY 2, 3) SELECT d AS direction, s AS source, g AS target, round(c, 8) AS c FROM c")
def reversed_time_control(spark, sf_dir):
    p = panel(spark, sf_dir).select("t", "node", "wind", "humidity")
    last = p.agg(F.max("t").alias("last"))
    both = p.withColumn("direction", F.lit("forward")).unionByName(p.crossJoin(F.broadcast(last)).withColumn("t", F.col("last") - F.col("t")).drop("last").withColumn("direction", F.lit("reversed")))  # one row
    a = both.select((F.col("t") + 1).alias("t"), "direction", F.col("node").alias("source"), F.col("wind").alias("x"))
    j = a.join(both.select("t", "direction", F.col("node").alias("target"), F.col("humidity").alias("y")), ["t", "direction"])
    c = F.covar_pop("x", "y") / (F.stddev_pop("x") * F.stddev_pop("y"))
    return j.groupBy("direction", "source", "target").agg(F.round(c, 8).alias("c"))


@query(ctes("edges") + """, n AS (SELECT r, regime, edge_type, avg(effect) AS m FROM (SELECT r, regime, edge_type, effect, row_number() OVER (PARTITION BY r, regime, edge_type ORDER BY (source_region * 131 + target_region * 37 + lag * 17 + r * 53) % 1009, source_region, target_region, lag) AS k FROM edges, range(1, 21) x(r)) WHERE k <= 30 GROUP BY 1, 2, 3),
 o AS (SELECT regime, edge_type, avg(effect) AS o FROM edges WHERE p_value < 0.1 GROUP BY 1, 2) SELECT regime, edge_type, round(any_value(o), 8) AS observed, round(avg(m), 8) AS null_mean, round(quantile_cont(m, 0.95), 8) AS null_q95, round((1 + count(*) FILTER (m >= o)) / 21.0, 8) AS upper FROM n JOIN o USING (regime, edge_type) GROUP BY 1, 2""")
def stratified_null_enrichment(spark, sf_dir):
    e = edges(spark, sf_dir)
    draws = e.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(20))))
    order = (F.col("source_region") * 131 + F.col("target_region") * 37 + F.col("lag") * 17 + F.col("r") * 53) % 1009
    w = Window.partitionBy("r", "regime", "edge_type").orderBy(order, "source_region", "target_region", "lag")
    n = draws.withColumn("k", F.row_number().over(w)).filter("k <= 30").groupBy("r", "regime", "edge_type").agg(F.avg("effect").alias("m"))
    o = e.filter("p_value < 0.1").groupBy("regime", "edge_type").agg(F.avg("effect").alias("o"))
    return n.join(o, ["regime", "edge_type"]).groupBy("regime", "edge_type").agg(
        F.round(F.first("o"), 8).alias("observed"), F.round(F.avg("m"), 8).alias("null_mean"), F.round(F.percentile("m", 0.95), 8).alias("null_q95"), F.round((1 + F.count_if(F.col("m") >= F.col("o"))) / 21.0, 8).alias("upper")
    )


@query(ctes("panel") + """, m AS (SELECT t, avg(humidity) AS x, avg(cloud_cover) AS y FROM panel GROUP BY 1), q AS (SELECT quantile_cont(x, 0.8) AS hi FROM m), s AS (SELECT m.*, x >= hi AS high FROM m, q), h AS (SELECT count(*) AS k, avg(y) AS obs FROM s WHERE high),
 d AS (SELECT r, t, y, row_number() OVER (PARTITION BY r ORDER BY (t * 7349 + r * 4591) % 10007, t) AS k FROM s, range(1, 41) a(r) WHERE NOT high), z AS (SELECT r, avg(y) AS m FROM d, h WHERE d.k <= h.k GROUP BY 1)
 SELECT round(any_value(obs), 9) AS observed, round(avg(m), 9) AS mean, round(least(1, (1 + count(*) FILTER (abs(m - mm) >= abs(obs - mm))) / 41.0), 8) AS p FROM (SELECT z.m, avg(m) OVER () AS mm FROM z) z, h""")
def matched_size_control(spark, sf_dir):
    m = panel(spark, sf_dir).groupBy("t").agg(F.avg("humidity").alias("x"), F.avg("cloud_cover").alias("y"))
    q = m.agg(F.percentile("x", 0.8).alias("hi"))
    s = m.crossJoin(F.broadcast(q)).withColumn("high", F.col("x") >= F.col("hi"))  # one row
    h = s.filter("high").agg(F.count("*").alias("size"), F.avg("y").alias("obs"))
    d = s.filter("not high").withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(40))))
    d = d.withColumn("k", F.row_number().over(Window.partitionBy("r").orderBy((F.col("t") * 7349 + F.col("r") * 4591) % 10007, "t")))
    z = d.crossJoin(F.broadcast(h)).filter("k <= size").groupBy("r").agg(F.avg("y").alias("m"), F.first("obs").alias("obs"))
    c = z.agg(F.avg("m").alias("mm"))
    far = F.count_if(F.abs(F.col("m") - F.col("mm")) >= F.abs(F.col("obs") - F.col("mm")))
    return z.crossJoin(F.broadcast(c)).agg(F.round(F.first("obs"), 9).alias("observed"), F.round(F.first("mm"), 9).alias("mean"), F.round(F.least(F.lit(1.0), (1 + far) / 41.0), 8).alias("p"))


@query(ctes("edges") + """, ys AS (SELECT edge_type, t // 52 AS year, regr_slope(y, z) AS slope FROM (SELECT *, source_var || '->' || target_var AS edge_type FROM td WHERE lag = 1 AND source_region = target_region) GROUP BY 1, 2), zs AS (SELECT *, row_number() OVER (PARTITION BY edge_type ORDER BY year) - 1 AS pos, count(*) OVER (PARTITION BY edge_type) AS n FROM ys),
 dr AS (SELECT DISTINCT edge_type, n, r, k FROM zs, range(1, 51) x(r), range(1000) w(k) WHERE k < n), b AS (SELECT dr.edge_type, r, dr.n, avg(slope) AS m FROM dr JOIN zs ON zs.edge_type = dr.edge_type AND zs.pos = (r * 31 + k * 17 + r * k) % dr.n GROUP BY 1, 2, 3)
 SELECT edge_type, n AS years, round(avg(m), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM b GROUP BY 1, 2""")
def year_block_interval(spark, sf_dir):
    """By edge type: yearly slopes over all stations, resampled over all years that occur."""
    from lagloom.sources.fixtures import EDGE_TYPES, station_climate

    c = station_climate(spark, sf_dir)
    out = None
    for a, b in EDGE_TYPES:
        y = c.filter(F.col("variable") == b).select("t", "node", F.col("value").alias("y"))
        z = c.filter(F.col("variable") == a).select((F.col("t") + 1).alias("t"), "node", F.col("value").alias("z"))
        j = y.join(z.hint("shuffle_merge"), ["t", "node"]).groupBy(F.floor(F.col("t") / 52).alias("year")).agg((F.covar_pop("y", "z") / F.var_pop("z")).alias("slope"))
        j = j.withColumn("edge_type", F.lit(f"{a}->{b}"))
        out = j if out is None else out.unionByName(j)
    return resampled_years(out, "edge_type").select("edge_type", "years", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


@query(ctes("panel_ship") + """, y AS (SELECT flag, t // 365 AS year, regr_slope(price, disc) AS slope FROM panel_ship GROUP BY 1, 2), z AS (SELECT flag, slope, row_number() OVER (PARTITION BY flag ORDER BY year) - 1 AS pos, count(*) OVER (PARTITION BY flag) AS n FROM y),
 a AS (SELECT DISTINCT flag, n, r, k FROM z, range(1, 51) x(r), range(1000) w(k) WHERE k < n), b AS (SELECT a.flag, r, avg(z.slope) AS m FROM a JOIN z ON z.flag = a.flag AND z.pos = (r * 31 + k * 17 + r * k) % a.n GROUP BY 1, 2)
 SELECT flag, max(years) AS years, round(avg(m), 4) AS mean, round(quantile_cont(m, 0.025), 4) AS low, round(quantile_cont(m, 0.975), 4) AS high FROM b JOIN (SELECT flag, count(*) AS years FROM y GROUP BY 1) USING (flag) GROUP BY 1""")
def year_block_interval_all(spark, sf_dir):
    """As year_block_interval, over all years that occur."""
    return all_years_interval(panel_ship(spark, sf_dir))


def all_years_interval(p):
    """Interval of the yearly slopes' mean by flag."""
    y = p.groupBy("flag", F.floor(F.col("t") / 365).alias("year")).agg(F.try_divide(F.covar_pop("price", "disc"), F.var_pop("disc")).alias("slope"))
    return resampled_years(y, "flag").select("flag", "years", *[F.round(c, 4).alias(c) for c in ("mean", "low", "high")])


def resampled_years(y, by: str):
    """Mean and interval of yearly slopes (by, year, slope): replicates draw as many years as occur, with replacement, from all of them."""
    y = y.withColumn("pos", F.row_number().over(Window.partitionBy(by).orderBy("year")) - 1)  # one row per year
    draw = y.groupBy(by).agg(F.count("*").alias("years")).withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(50)))).withColumn("k", F.explode(F.sequence(F.lit(0), (F.col("years") - 1).cast("int"))))
    draw = draw.withColumn("pos", ((F.col("r") * 31 + F.col("k") * 17 + F.col("r") * F.col("k")) % F.col("years")).cast("int"))
    b = draw.join(y.hint("shuffle_hash"), [by, "pos"]).groupBy(by, "years", "r").agg(F.avg("slope").alias("m"))
    q = F.percentile("m", F.array(F.lit(0.025), F.lit(0.975)))
    return b.groupBy(by, "years").agg(F.avg("m").alias("mean"), q.alias("q")).select(by, "years", "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


@query(ctes("panel") + """, c AS (SELECT t, node, humidity, t < 250 AS discovery, (SELECT min(t) FROM panel) AS t0 FROM panel), a AS (SELECT *, CASE WHEN t - 52 >= t0 THEN t - 52 ELSE t - 52 + 250 - t0 END AS source FROM c)
 SELECT a.t, a.node, a.source, a.discovery, round(a.humidity - b.humidity, 9) AS placebo, a.discovery AND a.source >= 250 AS leak FROM a JOIN panel b ON b.node = a.node AND b.t = a.source""")
def placebo_index(spark, sf_dir):
    return placebo(panel(spark, sf_dir).select("t", "node", "humidity"), 250)


def placebo(p, held_out: int, year: int = 52):
    """t, node, source (a year before), discovery, placebo, leak: the first year takes its source from the end of discovery, never from held-out steps."""
    ends = p.agg(F.min("t").alias("t0"))
    a = p.crossJoin(F.broadcast(ends)).withColumn("source", F.col("t") - year)  # one row
    a = a.withColumn("source", F.when(F.col("source") >= F.col("t0"), F.col("source")).otherwise(F.col("source") + held_out - F.col("t0")))
    b = p.select(F.col("t").alias("source"), "node", F.col("humidity").alias("before"))
    j = a.join(b.hint("shuffle_merge"), ["source", "node"]).withColumn("discovery", F.col("t") < held_out).withColumn("leak", F.col("discovery") & (F.col("source") >= held_out))
    return j.select("t", "node", "source", "discovery", F.round(F.col("humidity") - F.col("before"), 9).alias("placebo"), "leak")


def without_leak(p):
    """The placebo, or an error if a discovery step reads a held-out one."""
    if p.filter("leak").limit(1).count():
        raise ValueError("placebo sources of discovery steps lie in the held-out part")
    return p


@query(ctes("edges") + ", a AS (SELECT *, p_value < 0.3 AS w FROM edges WHERE regime = 'winter'), b AS (SELECT *, p_value < 0.3 AS s FROM edges WHERE regime = 'summer') SELECT edge_type, lag, count(*) FILTER (w AND s) AS both, count(*) FILTER (w OR s) AS either, round(count(*) FILTER (w AND s) / (count(*) FILTER (w OR s))::DOUBLE, 8) AS jaccard FROM a JOIN b USING (source_region, target_region, source_var, target_var, lag, edge_type) GROUP BY 1, 2")
def period_graph_overlap(spark, sf_dir):
    g = edges(spark, sf_dir).groupBy("source_region", "target_region", "edge_type", "lag").agg(F.max((F.col("regime") == "winter") & (F.col("p_value") < 0.3)).alias("w"), F.max((F.col("regime") == "summer") & (F.col("p_value") < 0.3)).alias("s"))
    both, either = F.count_if(F.col("w") & F.col("s")), F.count_if(F.col("w") | F.col("s"))
    return g.groupBy("edge_type", "lag").agg(both.alias("both"), either.alias("either"), F.round(F.try_divide(both, either), 8).alias("jaccard"))


@query(ctes("edges") + ", c AS (SELECT regime AS chain, lag AS metric, effect AS v, row_number() OVER (PARTITION BY regime, lag ORDER BY source_region, target_region, edge_type) AS draw FROM edges), ch AS (SELECT metric, chain, v, 2 * draw <= count(*) OVER (PARTITION BY chain, metric) + 1 AS half FROM c), h AS (SELECT metric, chain, half, avg(v) AS m, var_samp(v) AS s, count(*) AS n FROM ch GROUP BY 1, 2, 3) SELECT metric, round(sqrt(((avg(n) - 1) / avg(n) * avg(s) + var_samp(m)) / avg(s)), 8) AS split_rhat FROM h GROUP BY 1")
def split_r_hat(spark, sf_dir):
    return split_chains(edges(spark, sf_dir))


def split_chains(e):
    """R-hat by lag of the effects' chains (regimes), each cut at half of its own draws."""
    n = e.groupBy("regime", "lag").agg(F.count("*").alias("n"))
    c = rank_by_ranges(e, ["regime", "lag"], ["source_region", "target_region", "edge_type"], "r").join(F.broadcast(n), ["regime", "lag"])  # a row per chain
    c = c.withColumn("half", 2 * F.col("r") <= F.col("n") + 1).drop("n", "r")
    h = c.groupBy(F.col("lag").alias("metric"), "regime", "half").agg(F.avg("effect").alias("m"), F.var_samp("effect").alias("s"), F.count("*").alias("n"))
    return h.groupBy("metric").agg(F.round(F.sqrt(((F.avg("n") - 1) / F.avg("n") * F.avg("s") + F.var_samp("m")) / F.avg("s")), 8).alias("split_rhat"))


_TYPED = "typed AS (SELECT DISTINCT edge_type AS type, source_region AS a, target_region AS b FROM edges WHERE regime = 'winter' AND p_value < 0.3 AND source_region <> target_region)"


def _typed(spark, sf_dir):
    e = edges(spark, sf_dir).filter("regime = 'winter' and p_value < 0.3 and source_region <> target_region")
    return e.select(F.col("edge_type").alias("type"), F.col("source_region").alias("a"), F.col("target_region").alias("b")).distinct()


@query(ctes("edges") + f", {_TYPED} SELECT r AS rep, type, count(*) AS edges, count(DISTINCT a) AS sources, count(DISTINCT b) AS targets, 0::BIGINT AS degrees_changed, 0::BIGINT AS strata_changed FROM typed CROSS JOIN range(3) x(r) GROUP BY 1, 2")
def rewired_null(spark, sf_dir):
    """Graphs rewired in three replicates: what must hold of them, against the graphs they came from."""
    from lagloom.operators.rewire import end_counts, kept, located, rewire

    nodes = stations(spark, sf_dir)
    g = _typed(spark, sf_dir).withColumn("rep", F.explode(F.array(*[F.lit(r).cast("long") for r in range(3)])))
    first = cut(located(g, nodes))
    done, _ = rewire(first, nodes, ["global", "near", "cycle"])
    return kept(done, end_counts(first, "x"))


@query()
def rewiring_log(spark, sf_dir):
    """Moves of each round by kernel and outcome, with the fingerprint of the graphs in the end."""
    from lagloom.operators.rewire import rewire

    g = _typed(spark, sf_dir).withColumn("rep", F.lit(0).cast("long"))
    done, log = rewire(g, stations(spark, sf_dir), ["global", "near", "cycle", "global"], seed=3)
    # the sum of the hashes of the edges: the same for the same set in any order
    marks = done.groupBy("rep", "type").agg(F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))).alias("fingerprint"))
    return log.join(marks.hint("shuffle_merge"), ["rep", "type"])


_KERNELS = ("global", "near", "cycle", "global")


def _draws_sql() -> str:
    from lagloom.operators.rewire import KERNELS, PRIME
    from lagloom.sources.fixtures import HAV_SQL

    edges_of = (1e-8, 1000, 2000, 3000, 4000, 6000, 10000)
    stratum = lambda km: " + ".join(f"({km} >= {e})::BIGINT" for e in edges_of)
    out = [f"g0 AS MATERIALIZED (SELECT rep, type, t.a, t.b, {stratum(HAV_SQL.replace('a.', 'p.').replace('b.', 'q.'))} AS s FROM typed t CROSS JOIN range(2) r(rep) JOIN cells p ON p.node = t.a JOIN cells q ON q.node = t.b)"]
    for k, kernel in enumerate(_KERNELS):
        m = KERNELS[kernel]
        part = "CAST(floor(p.lat / 30) * 100 + floor(p.lon / 45) AS BIGINT)" if kernel == "near" else "0"
        x = f"((g.a * 7919 + g.b * 104729 + rep * 15485863 + {k * 32452843 + 5 * 611953}) % 1000003)"
        ring = " UNION ALL ".join(f"SELECT o.rep, o.type, o.part, o.i, o.a, n.b FROM o{k} o JOIN o{k} n USING (rep, type, part, i) WHERE o.k = {j + 1} AND n.k = {(j + 1) % m + 1}" for j in range(m))
        ids = "rep, type, part, i"
        out += [
            f"h{k} AS (SELECT g.*, {part} AS part, {x} * 613 % 1000003 AS luck, {x} * 7907 % 1000033 AS r FROM g{k} g JOIN cells p ON p.node = g.a)",
            f"d{k} AS (SELECT *, luck % greatest(1, ceil(count(*) OVER (PARTITION BY rep, type, part) / {m}.0))::BIGINT AS i FROM h{k})",
            f"o{k} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {ids} ORDER BY r, a, b) AS k, count(*) OVER (PARTITION BY {ids}) AS c FROM d{k}) WHERE c >= {m} AND k <= {m})",
            f"n{k} AS MATERIALIZED (SELECT x.*, {stratum(HAV_SQL.replace('a.', 'p.').replace('b.', 'q.'))} AS s FROM ({ring}) x JOIN cells p ON p.node = x.a JOIN cells q ON q.node = x.b)",
            f"c{k} AS (SELECT {ids}, bool_or(a = b) AS loop, list(s ORDER BY s) AS ns FROM n{k} GROUP BY ALL), q{k} AS (SELECT {ids}, list(s ORDER BY s) AS os FROM o{k} GROUP BY ALL)",
            f"f{k} AS MATERIALIZED (SELECT n.* FROM n{k} n JOIN c{k} USING ({ids}) JOIN q{k} USING ({ids}) WHERE NOT loop AND ns = os)",
            f"b{k} AS (SELECT DISTINCT {ids} FROM f{k} JOIN g{k} USING (rep, type, a, b) UNION SELECT {ids} FROM (SELECT *, count(*) OVER (PARTITION BY rep, type, a, b) AS c FROM f{k}) WHERE c > 1)",
            f"w{k} AS MATERIALIZED (SELECT f.* FROM f{k} f ANTI JOIN b{k} USING ({ids}))",
            f"g{k + 1} AS MATERIALIZED (SELECT rep, type, a, b, s FROM g{k} g WHERE NOT EXISTS (SELECT 1 FROM o{k} o JOIN (SELECT DISTINCT {ids} FROM w{k}) v USING ({ids}) WHERE o.rep = g.rep AND o.type = g.type AND o.a = g.a AND o.b = g.b) UNION ALL SELECT rep, type, a, b, s FROM w{k})",
            f"""m{k} AS (SELECT rep, type, {k} AS step, '{kernel}' AS kernel, count(*) AS edges, sum(((x.a * 1000003 + x.b) % {PRIME}) * ((x.a * 1000003 + x.b) % {PRIME}) % {PRIME})::BIGINT AS fingerprint, round(1 - count(o.a) / count(*)::DOUBLE, 8) AS changed, count(r.a) AS reciprocal,
  coalesce((SELECT count(*) FROM (SELECT DISTINCT rep, type, part, i FROM w{k}) v WHERE v.rep = x.rep AND v.type = x.type), 0) AS moved FROM g{k + 1} x LEFT JOIN g0 o USING (rep, type, a, b) LEFT JOIN (SELECT rep, type, b AS a, a AS b FROM g{k + 1}) r USING (rep, type, a, b) GROUP BY rep, type)""",
            f"""e{k} AS (SELECT rep, type, count(*) FILTER (e <> 's' AND x IS DISTINCT FROM y) AS degrees_changed, count(*) FILTER (e = 's' AND x IS DISTINCT FROM y) AS strata_changed FROM (SELECT rep, type, e, v, sum(w) FILTER (old) AS x, sum(w) FILTER (NOT old) AS y FROM
  (SELECT rep, type, unnest(['a', 'b', 's']) AS e, unnest([a, b, s]) AS v, 1 AS w, true AS old FROM g0 UNION ALL SELECT rep, type, unnest(['a', 'b', 's']), unnest([a, b, s]), 1, false FROM g{k + 1}) GROUP BY ALL) GROUP BY ALL)""",
        ]
    steps = " UNION ALL ".join(f"SELECT m.*, degrees_changed, strata_changed, (SELECT count(*) FROM g{k + 1} x JOIN g{k + 1} y ON y.rep = x.rep AND y.a = x.b WHERE x.rep = m.rep AND x.type = 'wind->humidity' AND y.type = 'humidity->cloud_cover') AS chains FROM m{k} m JOIN e{k} USING (rep, type)" for k in range(len(_KERNELS)))
    return ctes("edges") + f", {_TYPED}, " + ", ".join(out) + " SELECT rep::BIGINT AS rep, type, step, kernel, edges, fingerprint, changed, reciprocal, moved, degrees_changed, strata_changed, chains FROM (" + steps + ")"


@query(_draws_sql())
def rewiring_draws(spark, sf_dir):
    """Two replicates after every round of moves: a mark of the graph, what changed of it, productive moves, and what must not change (degrees by type, distance strata, chains)."""
    from lagloom.operators.rewire import arithmetic, end_counts, measures, rewire

    g = _typed(spark, sf_dir).withColumn("rep", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))))

    before = []

    def observe(now, first):
        if not before:
            before.append(cut(end_counts(first, "x")))  # the same in every round
        a = now.filter("type = 'wind->humidity'").groupBy("rep", F.col("b").alias("m")).agg(F.count("*").alias("x"))
        b = now.filter("type = 'humidity->cloud_cover'").groupBy("rep", F.col("a").alias("m")).agg(F.count("*").alias("y"))
        chains = a.join(b.hint("shuffle_merge"), ["rep", "m"]).groupBy("rep").agg(F.sum(F.col("x") * F.col("y")).alias("chains"))
        return measures(now, first, before[0]).join(chains.hint("shuffle_merge"), "rep", "left").withColumns({"chains": F.coalesce("chains", F.lit(0)), "changed": F.round("changed", 8)})

    _, log = rewire(g, stations(spark, sf_dir), list(_KERNELS), seed=5, luck=arithmetic, observe=observe)
    return log.select("rep", "type", "step", "kernel", "edges", "fingerprint", "changed", "reciprocal", "moved", "degrees_changed", "strata_changed", "chains")
