"""Edge scores, histories, chosen ridge, intervals, seams, geometry, contracts, states as of a step, replicate tables."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lagloom.functions.tails import p_t, p_t_whole, t_quantile
from lagloom.operators import clean, dense, gram, panels, spatial
from lagloom.operators.fdr import bh_large
from lagloom.operators.lineage import written
from lagloom.operators.reports import KEY
from lagloom.plans import section
from lagloom.plans.a_sources import LINEITEM
from lagloom.plans.c_spatial import _GRID, overlap_weights
from lagloom.plans.d_regimes import _ASOF, _INDEX, asof_states, index_states
from lagloom.plans.m_verify import _PRED, flux_divergence, predictions
from lagloom.plans.n_dense import _sql, named, names_of
from lagloom.sources import readers
from lagloom.sources.fixtures import ctes, panel_orders, panel_ship, station_climate, station_series, stations, table, tests
from lagloom.sources.sqltext import t_tail_sql

QUERIES, query = section()
_K = ", ".join(KEY)


@query(ctes("tests") + f""", p AS (SELECT {_K}, regime, source_var || '->' || target_var AS edge_type, effect, round({t_tail_sql("(effect / se_ols)", "(n - 3)")}, 9) AS p FROM tests), r AS (SELECT *, row_number() OVER (PARTITION BY regime, edge_type ORDER BY p) AS r, count(*) OVER (PARTITION BY regime, edge_type) AS m FROM p), q AS (SELECT *, least(1, min(p * m / r) OVER (PARTITION BY regime, edge_type ORDER BY r DESC)) AS q FROM r)
 SELECT {_K}, regime, p AS p_value, round(q, 8) AS q_value, q < 0.05 AS significant, round(sign(effect) * -log10(q + 1e-12) * abs(effect), 7) + 0.0 AS effect_score FROM q""")
def link_scores(spark, sf_dir):
    """F tests of all candidates by season, q within season and type, and the score: sign times minus log q times size."""
    t = tests(spark, sf_dir).filter("effect is not null").withColumn("edge_type", F.concat_ws("->", "source_var", "target_var"))
    t = t.withColumn("p", F.round(p_t_whole(F.col("effect") / F.col("se_ols"), (F.col("n") - 3).cast("double")), 9))
    t = written(t.select(*KEY, "regime", "edge_type", "effect", "p"), "link-scores")  # read for the ranks and again for their join
    q = bh_large(t, ["regime", "edge_type"], "p", "q", 0.05)
    score = F.signum("effect") * -F.log10(F.col("q") + 1e-12) * F.abs("effect")
    return q.select(*KEY, "regime", F.col("p").alias("p_value"), F.round("q", 8).alias("q_value"), "significant", (F.round(score, 7) + 0.0).alias("effect_score"))


def _history_sql() -> str:
    three = _sql("SELECT 'three' AS period, * FROM x", 3)
    return three + f""", w1 AS MATERIALIZED (SELECT a.t, list_concat([1.0::DOUBLE], b.v) AS x, a.v AS y, list_concat(list_concat([1.0::DOUBLE], b.v), a.v) AS z FROM w a JOIN w b ON b.t = a.t - 1 WHERE a.t >= (SELECT min(t) FROM x)),
 g1 AS MATERIALIZED (SELECT 'one' AS period, max(n) AS n, list(s ORDER BY q) AS m FROM (SELECT q, sum(z[q // 41 + 1] * z[q % 41 + 1]) AS s, count(*) AS n FROM w1 CROSS JOIN range(1681) r(q) GROUP BY 1)), {_sweep_one()}"""


def _sweep_one() -> str:
    from lagloom.sources.sqltext import sweep_sql

    return sweep_sql("s1", "g1", 41, 21, "period")


@query(_history_sql() + """, c1 AS (SELECT o, c, m[c * 41 + 21 + o + 1] AS b, m[(21 + o) * 41 + 21 + o + 1] AS rss, n, -m[c * 41 + c + 1] AS icc FROM s1 CROSS JOIN range(20) x(o) CROSS JOIN range(1, 21) y(c)), c3 AS (SELECT o, c, m[c * 81 + 61 + o + 1] AS b, m[(61 + o) * 81 + 61 + o + 1] AS rss, n, -m[c * 81 + c + 1] AS icc FROM sw CROSS JOIN range(20) x(o) CROSS JOIN range(1, 21) y(c))
 SELECT nm.name AS target, count(*) FILTER (abs(a.b) > 1.96 * sqrt(a.rss / (a.n - 21) * a.icc)) AS significant_1, count(*) FILTER (abs(b.b) > 1.96 * sqrt(b.rss / (b.n - 61) * b.icc)) AS significant_3, round(avg(CASE WHEN sign(a.b) = sign(b.b) THEN 1.0 ELSE 0.0 END), 8) AS same_sign, round(any_value(a.rss / a.n - b.rss / b.n), 8) AS mse_gain FROM c1 a JOIN c3 b USING (o, c) JOIN nm ON nm.i = o GROUP BY 1""")
def var_histories(spark, sf_dir):
    """Dense models of one and of three steps of history on the same rows: significant lag-1 links, agreement of signs, error saved."""
    s = named(spark, sf_dir)
    names = names_of(s)
    first = s.agg(F.min("t")).first()[0]
    one = dense.fit(dense.design(s, names, [1]).filter(F.col("t") >= first + 3), names, [1])
    three = dense.fit(dense.design(s, names, [1, 2, 3]), names, [1, 2, 3])
    rows = []
    for o, target in enumerate(names):
        sig, same = [0, 0], 0
        for n in names:
            b = []
            for i, m in enumerate((one, three)):
                c = m.column(n, 1)
                b.append(m.beta[c, o])
                sig[i] += abs(m.beta[c, o]) > 1.96 * math.sqrt(m.rss[o] / (m.n - m.p) * m.inverse[c, c])
            same += (b[0] > 0) == (b[1] > 0)
        rows.append((target, int(sig[0]), int(sig[1]), round(float(same) / len(names), 8), round(float(one.rss[o] / one.n - three.rss[o] / three.n), 8)))
    return spark.createDataFrame(rows, "target string, significant_1 long, significant_3 long, same_sign double, mse_gain double")


_RIDGE = ctes("panel_ship") + """, l AS (SELECT a.t, a.flag, a.price AS y, b.price AS x1, b.disc AS x2 FROM panel_ship a JOIN panel_ship b ON b.flag = a.flag AND b.t = a.t - 1), m AS (SELECT flag, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2 FROM l WHERE t < 1200 GROUP BY 1), z AS (SELECT t, flag, y - my AS y, (x1 - m1) / s1 AS a, (x2 - m2) / s2 AS b FROM l JOIN m USING (flag)),
g AS (SELECT flag, sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab, sum(a * y) AS ay, sum(b * y) AS yb FROM z WHERE t < 1200 GROUP BY 1), c AS (SELECT flag, pen, ((bb + pen) * ay - ab * yb) / ((aa + pen) * (bb + pen) - ab * ab) AS wa, ((aa + pen) * yb - ab * ay) / ((aa + pen) * (bb + pen) - ab * ab) AS wb FROM g, (VALUES (0.0), (10.0), (100.0), (1000.0), (10000.0)) p(pen)),
e AS (SELECT flag, pen, avg(pow(y - wa * a - wb * b, 2)) FILTER (t >= 1200 AND t < 1800) AS val, avg(pow(y - wa * a - wb * b, 2)) FILTER (t >= 1800) AS test FROM z JOIN c USING (flag) GROUP BY 1, 2)"""


@query(_RIDGE + " SELECT flag, pen::DOUBLE AS penalty, round(val, 4) AS validation_mse, round(test, 4) AS test_mse FROM (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY round(val, 6), pen) AS r FROM e) WHERE r = 1")
def ridge_selection(spark, sf_dir):
    """Ridge on two scaled lagged features, penalty chosen on the validation days and judged on later ones."""
    p = panel_ship(spark, sf_dir)
    x = p.select((F.col("t") + 1).alias("t"), "flag", F.col("price").alias("x1"), F.col("disc").alias("x2"))
    l = p.select("t", "flag", F.col("price").alias("y")).join(x.hint("shuffle_merge"), ["t", "flag"])
    m = l.filter("t < 1200").groupBy("flag").agg(F.avg("y").alias("my"), F.avg("x1").alias("m1"), F.avg("x2").alias("m2"), F.stddev_pop("x1").alias("s1"), F.stddev_pop("x2").alias("s2"))
    z = l.join(F.broadcast(m), "flag").select("t", "flag", (F.col("y") - F.col("my")).alias("y"), ((F.col("x1") - F.col("m1")) / F.col("s1")).alias("a"), ((F.col("x2") - F.col("m2")) / F.col("s2")).alias("b"))  # one row per flag
    s = lambda u, v: F.sum(F.col(u) * F.col(v)).alias(u + v)
    g = z.filter("t < 1200").groupBy("flag").agg(s("a", "a"), s("b", "b"), s("a", "b"), s("a", "y"), s("b", "y")).withColumn("pen", F.explode(F.array(*[F.lit(v) for v in (0.0, 10.0, 100.0, 1000.0, 10000.0)])))
    aa, bb = F.col("aa") + F.col("pen"), F.col("bb") + F.col("pen")
    det = aa * bb - F.col("ab") * F.col("ab")
    c = g.select("flag", "pen", ((bb * F.col("ay") - F.col("ab") * F.col("by")) / det).alias("wa"), ((aa * F.col("by") - F.col("ab") * F.col("ay")) / det).alias("wb"))
    d = F.pow(F.col("y") - F.col("wa") * F.col("a") - F.col("wb") * F.col("b"), F.lit(2))
    e = z.join(F.broadcast(c), "flag").groupBy("flag", "pen").agg(F.avg(F.when((F.col("t") >= 1200) & (F.col("t") < 1800), d)).alias("val"), F.avg(F.when(F.col("t") >= 1800, d)).alias("test"))  # five rows per flag
    r = e.withColumn("r", F.row_number().over(Window.partitionBy("flag").orderBy(F.round("val", 6), "pen"))).filter("r = 1")
    return r.select("flag", F.col("pen").alias("penalty"), F.round("val", 4).alias("validation_mse"), F.round("test", 4).alias("test_mse"))


@query(ctes("panel_ship") + """, c AS (SELECT flag, month(ts) AS m, avg(price) AS clim FROM panel_ship WHERE t < 1200 GROUP BY 1, 2), d AS (SELECT a.flag, a.price AS y, b.price AS persistence, ca.clim AS climatology, b.price + ca.clim - cb.clim AS budget FROM panel_ship a JOIN panel_ship b ON b.flag = a.flag AND b.t = a.t - 1 JOIN c ca ON ca.flag = a.flag AND ca.m = month(a.ts) JOIN c cb ON cb.flag = a.flag AND cb.m = month(b.ts) WHERE a.t >= 1200)
 SELECT flag, model, count(*) AS n, round(avg(pow(p - y, 2)), 4) AS mse, round(avg(p - y), 5) AS bias FROM (SELECT flag, y, unnest(['persistence', 'climatology', 'budget']) AS model, unnest([persistence, climatology, budget]) AS p FROM d) GROUP BY 1, 2""")
def baseline_errors(spark, sf_dir):
    """Persistence, monthly climatology of the training days, and persistence plus the climatological change."""
    p = panel_ship(spark, sf_dir).select("t", "flag", "price", F.month("ts").alias("m"))
    c = p.filter("t < 1200").groupBy("flag", "m").agg(F.avg("price").alias("clim"))
    b = p.select((F.col("t") + 1).alias("t"), "flag", F.col("price").alias("before"), F.col("m").alias("mb"))
    d = p.filter("t >= 1200").join(b.hint("shuffle_merge"), ["t", "flag"]).join(F.broadcast(c), ["flag", "m"]).join(F.broadcast(c.toDF("flag", "mb", "climb")), ["flag", "mb"])  # 12 rows per flag
    models = {"persistence": F.col("before"), "climatology": F.col("clim"), "budget": F.col("before") + F.col("clim") - F.col("climb")}
    k = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), x.alias("p")) for n, x in models.items()]))
    e = F.col("p") - F.col("price")
    return d.select("flag", "price", k.alias("k")).select("flag", "price", "k.*").groupBy("flag", "model").agg(F.count("*").alias("n"), F.round(F.avg(e * e), 4).alias("mse"), F.round(F.avg(e), 5).alias("bias"))


@query(f"WITH {_PRED}, i AS (SELECT region, model, y, actual, prediction, prediction - 8 AS low, prediction + 8 - abs(prediction - 26) / 2 AS high FROM pred), s AS (SELECT *, unnest(['all', 'year=' || y]) AS subset FROM i), k AS (SELECT region, model, subset, unnest(['raw', 'wider']) AS interval, actual, prediction, unnest([low, low - 3]) AS low, unnest([high, high + 3]) AS high FROM s) SELECT model, region, subset, interval, count(*) AS n, round(avg(CASE WHEN actual >= least(low, high) AND actual <= greatest(low, high) THEN 1.0 ELSE 0.0 END), 8) AS coverage, round(avg(abs(high - low)), 7) AS width, round(avg(CASE WHEN low > high THEN 1.0 ELSE 0.0 END), 8) AS crossing, round(avg(abs(prediction - actual)), 7) AS mae, round(sqrt(avg(pow(prediction - actual, 2))), 7) AS rmse FROM k GROUP BY 1, 2, 3, 4")
def interval_metrics(spark, sf_dir):
    """Coverage, width and crossings of intervals as given and widened, with the point errors, by subset."""
    p = predictions(spark, sf_dir)
    x = F.col("prediction")
    p = p.withColumn("low", x - 8).withColumn("high", x + 8 - F.abs(x - 26) / 2).withColumn("subset", F.explode(F.array(F.lit("all"), F.concat(F.lit("year="), F.col("y").cast("string")))))
    k = F.explode(F.array(*[F.struct(F.lit(n).alias("interval"), (F.col("low") - d).alias("lo"), (F.col("high") + d).alias("hi")) for n, d in (("raw", 0), ("wider", 3))]))
    p = p.withColumn("k", k).select("model", "region", "subset", "actual", "prediction", "k.*")
    one = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 8)
    e = F.col("prediction") - F.col("actual")
    return p.groupBy("model", "region", "subset", "interval").agg(
        F.count("*").alias("n"), one((F.col("actual") >= F.least("lo", "hi")) & (F.col("actual") <= F.greatest("lo", "hi"))).alias("coverage"), F.round(F.avg(F.abs(F.col("hi") - F.col("lo"))), 7).alias("width"),
        one(F.col("lo") > F.col("hi")).alias("crossing"), F.round(F.avg(F.abs(e)), 7).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 7).alias("rmse"),
    )


@query("""WITH pr AS (SELECT o_orderpriority AS region, s.seed, (o_orderstatus = 'F')::INT AS y, (1.0 + (o_orderkey * (7 + s.seed)) % 97) / 99.0 AS p, 1.0 / 3 AS base FROM orders, range(3) s(seed)), d AS (SELECT region, seed, sum(pow(p - y, 2) - pow(base - y, 2)) AS s FROM pr GROUP BY 1, 2), n AS (SELECT count(*) / 3.0 AS n FROM pr) SELECT region, count(*) AS seeds, round(avg(s / n), 9) AS excess FROM d, n GROUP BY 1""")
def regional_excess(spark, sf_dir):
    """Each region's part of the excess of a forecast's Brier score over a constant one, averaged over seeds."""
    o = table(spark, sf_dir, "orders").withColumn("seed", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))))
    p = (1.0 + (F.col("o_orderkey") * (7 + F.col("seed"))) % 97) / 99.0
    y = F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)
    d = o.groupBy(F.col("o_orderpriority").alias("region"), "seed").agg(F.sum(F.pow(p - y, F.lit(2)) - F.pow(1.0 / 3 - y, F.lit(2))).alias("s"))
    n = table(spark, sf_dir, "orders").agg(F.count("*").alias("n"))
    return d.crossJoin(F.broadcast(n)).groupBy("region").agg(F.count("*").alias("seeds"), F.round(F.avg(F.col("s") / F.col("n")), 9).alias("excess"))  # one row


@query(ctes("panel_ship") + """, s AS (SELECT t, ts, flag, price, price - lag(price) OVER (PARTITION BY flag ORDER BY t) AS step, t - lag(t) OVER (PARTITION BY flag ORDER BY t) AS gap FROM panel_ship), a AS (SELECT flag, min_by(abs(step), t) AS seam FROM s WHERE t >= 1500 AND gap = 1 GROUP BY 1), w AS (SELECT flag, avg(price) FILTER (t BETWEEN 1470 AND 1499) AS b30, avg(price) FILTER (t BETWEEN 1500 AND 1529) AS a30, avg(price) FILTER (t BETWEEN 1135 AND 1499) AS b365, avg(price) FILTER (t BETWEEN 1500 AND 1864) AS a365 FROM panel_ship GROUP BY 1)
 SELECT a.flag, round(seam, 4) AS seam, round(avg(CASE WHEN abs(step) <= seam + 1e-9 THEN 1.0 ELSE 0.0 END) FILTER (t < 1500 AND gap = 1), 8) AS percentile, round(avg(abs(step)) FILTER (gap = 1 AND month(ts) = 2 AND day(ts) = 8), 4) AS same_day, round(any_value(a30 - b30), 4) AS change_30, round(any_value(a365 - b365), 4) AS change_365 FROM s JOIN a USING (flag) JOIN w USING (flag) GROUP BY 1, 2""")
def seam_steps(spark, sf_dir):
    """The step at a seam: its percentile among earlier steps, the same calendar day's steps, and changes of the means around it."""
    w = Window.partitionBy("flag").orderBy("t")
    p = panel_ship(spark, sf_dir)
    s = p.select("t", "ts", "flag", (F.col("price") - F.lag("price").over(w)).alias("step"), (F.col("t") - F.lag("t").over(w)).alias("gap"))
    a = s.filter("t >= 1500 and gap = 1").groupBy("flag").agg(F.min_by(F.abs("step"), "t").alias("seam"))
    m = lambda x, y: F.avg(F.when(F.col("t").between(x, y), F.col("price")))
    c = p.groupBy("flag").agg(F.round(m(1500, 1529) - m(1470, 1499), 4).alias("change_30"), F.round(m(1500, 1864) - m(1135, 1499), 4).alias("change_365"))
    j = s.join(F.broadcast(a), "flag").join(F.broadcast(c), "flag")  # one row per flag
    use = F.col("gap") == 1
    g = j.groupBy("flag", "seam", "change_30", "change_365").agg(
        F.round(F.avg(F.when(use & (F.col("t") < 1500), F.when(F.abs("step") <= F.col("seam") + 1e-9, 1.0).otherwise(0.0))), 8).alias("percentile"), F.round(F.avg(F.when(use & (F.month("ts") == 2) & (F.dayofmonth("ts") == 8), F.abs("step"))), 4).alias("same_day")
    )
    return g.withColumn("seam", F.round("seam", 4))


# ---- geometry
@query(ctes("stations") + ", l AS (SELECT DISTINCT round(lat, 6) AS lat FROM cells), e AS (SELECT lat, coalesce((lat + lag(lat) OVER (ORDER BY lat)) / 2, -90) AS south, coalesce((lat + lead(lat) OVER (ORDER BY lat)) / 2, 90) AS north FROM l) SELECT lat, round(6371.0 * 6371.0 * radians(10) * (sin(radians(north)) - sin(radians(south))), 3) AS area, round(6371.0 * radians(north - south), 5) AS eastern_face, round(6371.0 * radians(10) * cos(radians(north)), 5) AS northern_face FROM e")
def row_geometry(spark, sf_dir):
    """Rows of a grid at the stations' latitudes: edges halfway to the neighbours, areas and face lengths of cells ten degrees wide."""
    l = stations(spark, sf_dir).select(F.round("lat", 6).alias("lat")).distinct()
    w = Window.orderBy("lat")  # one row per latitude of the grid
    e = l.withColumn("south", F.coalesce((F.col("lat") + F.lag("lat").over(w)) / 2, F.lit(-90.0))).withColumn("north", F.coalesce((F.col("lat") + F.lead("lat").over(w)) / 2, F.lit(90.0)))
    r, d = 6371.0, math.radians(10)
    return e.select("lat", F.round(r * r * d * (F.sin(F.radians("north")) - F.sin(F.radians("south"))), 3).alias("area"), F.round(r * F.radians(F.col("north") - F.col("south")), 5).alias("eastern_face"), F.round(r * d * F.cos(F.radians("north")), 5).alias("northern_face"))


_FACES = """f AS (SELECT year(l_shipdate) AS t, CAST(l_partkey * 31 % 8 AS BIGINT) AS i, CAST(l_suppkey * 7 % 12 AS BIGINT) AS j, avg(l_quantity) AS qu, avg(l_discount) * 100 AS qv FROM lineitem GROUP BY 1, 2, 3), full_t AS (SELECT t FROM f GROUP BY 1 HAVING count(*) = (SELECT max(c) FROM (SELECT count(*) AS c FROM f GROUP BY t))),
 r AS (SELECT f.*, (i // 2) * 3 + j // 4 AS region FROM f JOIN full_t USING (t)), ef AS (SELECT a.t, a.region AS ra, b.region AS rb, (a.qu + b.qu) / 2 * 6371.0 * radians(22.5) AS x FROM r a JOIN r b ON b.t = a.t AND b.i = a.i AND b.j = (a.j + 1) % 12 WHERE a.region <> b.region UNION ALL SELECT a.t, a.region, b.region, (a.qv + b.qv) / 2 * 6371.0 * radians(30) * cos(radians(-90 + 22.5 * (a.i + 1))) FROM r a JOIN r b ON b.t = a.t AND b.j = a.j AND b.i = a.i + 1 WHERE a.region <> b.region),
 fl AS (SELECT t, region, sum(x) AS outward FROM (SELECT t, ra AS region, x FROM ef UNION ALL SELECT t, rb, -x FROM ef) GROUP BY 1, 2)"""


@query("WITH " + _FACES + " SELECT t, region, round(outward, 3) AS outward, true AS agrees FROM fl")
def face_convergence(spark, sf_dir):
    """Outward flux of every region from its boundary faces only, held against the sum of its cells' divergence."""
    f = table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").alias("t"), (F.col("l_partkey") * 31 % 8).cast("long").alias("i"), (F.col("l_suppkey") * 7 % 12).cast("long").alias("j")).agg(F.avg("l_quantity").alias("qu"), (F.avg("l_discount") * 100).alias("qv"))
    n = f.groupBy("t").agg(F.count("*").alias("c"))
    most = n.agg(F.max("c").alias("most"))
    f = f.join(n.crossJoin(F.broadcast(most)).filter("c = most").select("t").hint("shuffle_merge"), "t", "left_semi")  # one row
    region = F.floor(F.col("i") / 2) * 3 + F.floor(F.col("j") / 4)
    r = f.withColumn("region", region)
    east = r.select("t", "i", F.pmod(F.col("j") - 1, F.lit(12)).alias("j"), F.col("qu").alias("nu"), F.col("region").alias("rb"))
    north = r.select("t", (F.col("i") - 1).alias("i"), "j", F.col("qv").alias("nv"), F.col("region").alias("rb"))
    e = r.join(east.hint("shuffle_merge"), ["t", "i", "j"]).filter("region <> rb").select("t", "region", "rb", ((F.col("qu") + F.col("nu")) / 2 * (6371.0 * math.radians(22.5))).alias("x"))
    v = r.join(north.hint("shuffle_merge"), ["t", "i", "j"]).filter("region <> rb").select("t", "region", "rb", ((F.col("qv") + F.col("nv")) / 2 * (6371.0 * math.radians(30)) * F.cos(F.radians(F.lit(-90.0) + 22.5 * (F.col("i") + 1)))).alias("x"))
    face = e.union(v)
    out = face.select("t", "region", "x").union(face.select("t", "rb", -F.col("x"))).groupBy("t", "region").agg(F.sum("x").alias("outward"))
    d = flux_divergence(f, 8, 12).groupBy("t", (F.floor(F.col("i") / 2) * 3 + F.floor(F.col("j") / 4)).alias("region")).agg(F.sum(F.col("d") * F.col("area")).alias("inside"), F.count("*").alias("cells"))
    j = out.join(d.hint("shuffle_merge"), ["t", "region"])
    whole = F.max("cells").over(Window.partitionBy("t")) == F.col("cells")
    return j.select("t", "region", F.round("outward", 3).alias("outward"), ((F.abs(F.col("outward") - F.col("inside")) <= 1e-6 * (1 + F.abs("inside"))) | ~whole).alias("agrees"))


@query(f"WITH {_GRID} SELECT target, count(*) AS overlaps, true AS closed FROM wn GROUP BY 1")
def weight_exactness(spark, sf_dir):
    """Overlap weights of each target cell: how many source cells meet it, and whether they add up to one."""
    w = overlap_weights(spark).groupBy("target").agg(F.count("*").alias("overlaps"), F.sum("w").alias("s"))
    return w.select("target", "overlaps", (F.abs(F.col("s") - 1) < 1e-12).alias("closed"))


@query(ctes("stations") + ", i AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS i FROM cells) SELECT a.node AS target, b.node AS source, row_number() OVER (PARTITION BY a.node ORDER BY abs(a.i - b.i), b.node) AS rank FROM i a JOIN i b ON a.i <> b.i AND abs(a.i - b.i) <= 3 QUALIFY row_number() OVER (PARTITION BY a.node ORDER BY abs(a.i - b.i), b.node) <= 3")
def index_neighbours(spark, sf_dir):
    """Nearest sources by position where there are no coordinates: only the k positions on either side are looked at."""
    from lagloom.plans.p_resampling import number

    i = number(stations(spark, sf_dir).select("node"), "node")
    near = i.select(F.col("node").alias("source"), F.explode(F.sequence(F.col("i") - 3, F.col("i") + 3)).alias("at"), F.col("i").alias("j"))
    j = i.select(F.col("node").alias("target"), F.col("i").alias("at")).join(near.hint("shuffle_merge"), "at").filter("j <> at")
    r = F.row_number().over(Window.partitionBy("target").orderBy(F.abs(F.col("j") - F.col("at")), "source"))
    return j.withColumn("rank", r).filter("rank <= 3").select("target", "source", "rank")


# ---- sources
@query(ctes("stations") + """, p AS (SELECT 'a' AS part, node, lat, lon, node % 10 * 1.0 AS v FROM cells UNION ALL SELECT 'b', node, lat + 0.001, lon, node % 7 * 1.0 FROM cells WHERE node % 5 <> 4 UNION ALL SELECT 'c', node, lat + 5, lon, 99.0 FROM cells WHERE node % 11 <> 10), ref AS (SELECT part FROM p GROUP BY 1 ORDER BY count(*) DESC, part LIMIT 1), ok AS (SELECT p.part FROM p JOIN p r ON r.node = p.node AND r.part = (SELECT part FROM ref) GROUP BY 1 HAVING avg(abs(p.lat - r.lat) + abs(p.lon - r.lon)) < 0.01)
 SELECT r.node, round(r.lat, 6) AS lat, count(*) AS parts, round(avg(p.v), 8) AS value FROM p r JOIN p ON p.node = r.node AND p.part IN (SELECT part FROM ok) WHERE r.part = (SELECT part FROM ref) GROUP BY 1, 2""")
def merged_grid(spark, sf_dir):
    """Partial grids merged on the richest one: parts whose coordinates fit are averaged, others are left out."""
    c = stations(spark, sf_dir)
    part = lambda n, df, d, v: df.select(F.lit(n).alias("part"), "node", (F.col("lat") + d).alias("lat"), "lon", v.cast("double").alias("v"))
    p = part("a", c, 0.0, F.col("node") % 10).unionByName(part("b", c.filter("node % 5 <> 4"), 0.001, F.col("node") % 7)).unionByName(part("c", c.filter("node % 11 <> 10"), 5.0, F.lit(99.0)))
    ref = p.groupBy("part").count().orderBy(F.desc("count"), "part").limit(1).select("part")
    r = p.join(F.broadcast(ref), "part", "left_semi").select("node", F.col("lat").alias("rl"), F.col("lon").alias("rn"))  # one row
    j = p.join(r.hint("shuffle_merge"), "node")
    ok = j.groupBy("part").agg(F.avg(F.abs(F.col("lat") - F.col("rl")) + F.abs(F.col("lon") - F.col("rn"))).alias("apart")).filter("apart < 0.01").select("part")
    return j.join(F.broadcast(ok), "part", "left_semi").groupBy("node", "rl").agg(F.count("*").alias("parts"), F.round(F.avg("v"), 8).alias("value")).select("node", F.round("rl", 6).alias("lat"), "parts", "value")  # one row per part


@query(ctes("panel_orders") + """, n AS (SELECT count(DISTINCT node) AS n, min(t) AS a, max(t) AS b FROM panel_orders), s AS (SELECT t, count(*) AS k FROM panel_orders GROUP BY 1), g AS (SELECT count(*) AS gaps FROM (SELECT t - lag(t) OVER (ORDER BY t) AS d FROM s) WHERE d <> 1)
 SELECT unnest(['shape', 'calendar', 'duplicates', 'finite', 'range']) AS rule, unnest([(SELECT count(*) FILTER (k <> n) FROM s, n), (SELECT gaps FROM g), (SELECT count(*) FROM (SELECT t, node FROM panel_orders GROUP BY 1, 2 HAVING count(*) > 1)), (SELECT count(*) FROM panel_orders WHERE NOT isfinite(price)), (SELECT count(*) FROM panel_orders WHERE share_f < 0 OR share_f > 1)]) AS violations""")
def panel_contract(spark, sf_dir):
    """Violations of a panel's contract: steps without every node, gaps in the calendar, repeated cells, values not finite or out of range."""
    p = panel_orders(spark, sf_dir)
    n = p.agg(F.count_distinct("node").alias("n"))
    s = p.groupBy("t").agg(F.count("*").alias("k"))
    one = lambda rule, df, cond: df.agg(F.count_if(cond).alias("violations")).select(F.lit(rule).alias("rule"), "violations")
    gap = s.withColumn("d", F.col("t") - F.lag("t").over(Window.orderBy("t")))  # one row per step
    out = one("shape", s.crossJoin(F.broadcast(n)), F.col("k") != F.col("n")).union(one("calendar", gap, F.col("d") != 1))  # one row
    out = out.union(one("duplicates", p.groupBy("t", "node").agg(F.count("*").alias("c")), F.col("c") > 1))
    return out.union(one("finite", p, F.isnan("price") | (F.abs("price") == F.lit(float("inf"))))).union(one("range", p, (F.col("share_f") < 0) | (F.col("share_f") > 1)))


@query(ctes("panel_ship") + """, a AS (SELECT 0 AS segment, t, flag, CASE WHEN t % 97 = 0 THEN NULL ELSE price END AS price FROM panel_ship WHERE t < 1000 UNION ALL SELECT 1, t, flag, price + 1 FROM panel_ship WHERE t BETWEEN 900 AND 1500 UNION ALL SELECT 2, t, flag, price + 2 FROM panel_ship WHERE t > 1400), r AS (SELECT *, row_number() OVER (PARTITION BY t, flag ORDER BY price IS NULL, segment) AS r, min(segment) OVER (PARTITION BY t, flag) AS first FROM a)
 SELECT segment AS source, count(*) AS n, count(*) FILTER (segment <> first) AS replaced, count(*) FILTER (price IS NULL) AS missing, round(avg(price), 5) AS price FROM r WHERE r = 1 GROUP BY 1""")
def segment_provenance(spark, sf_dir):
    """Segments joined with the earliest valid value of each step: which segment it came from, and where it replaces a missing one."""
    p = panel_ship(spark, sf_dir).select("t", "flag", "price")
    a = p.filter("t < 1000").withColumn("price", F.when(F.col("t") % 97 != 0, F.col("price"))).withColumn("segment", F.lit(0))
    a = a.unionByName(p.filter("t between 900 and 1500").withColumn("price", F.col("price") + 1).withColumn("segment", F.lit(1))).unionByName(p.filter("t > 1400").withColumn("price", F.col("price") + 2).withColumn("segment", F.lit(2)))
    w = Window.partitionBy("t", "flag")
    r = a.withColumn("r", F.row_number().over(w.orderBy(F.col("price").isNull(), "segment"))).withColumn("first", F.min("segment").over(w)).filter("r = 1")
    return r.groupBy(F.col("segment").alias("source")).agg(F.count("*").alias("n"), F.count_if(F.col("segment") != F.col("first")).alias("replaced"), F.count_if(F.col("price").isNull()).alias("missing"), F.round(F.avg("price"), 5).alias("price"))


# ---- seasons of day and year, states as of a step
_HOURS = "h AS (SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS t, month(ts) * 24 + hour(ts) AS s, event_type AS variable, avg(value) AS value FROM events GROUP BY 1, 2, 3)"


@query("WITH " + _HOURS + ", m AS (SELECT variable, s, avg(value) AS m FROM h WHERE t % 7 < 5 GROUP BY 1, 2), a AS (SELECT h.t, h.variable, value - m AS a FROM h LEFT JOIN m USING (variable, s)), c AS (SELECT variable, avg(a) AS c, stddev_pop(a) AS sd FROM a WHERE t % 7 < 5 GROUP BY 1) SELECT a.t, a.variable, round((a - c) / sd, 7) AS value FROM a JOIN c USING (variable)")
def train_fitted_hours(spark, sf_dir):
    """Transform fitted to training hours by month and hour of day; a series without variance is an error."""
    return fitted(hourly(spark, sf_dir), ["variable"], F.col("s"), F.col("t") % 7 < 5).select("t", "variable", F.round("value", 7).alias("value"))


def hourly(spark, sf_dir) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.floor(F.unix_seconds(ts) / 3600).cast("long").alias("t"), (F.month("ts") * 24 + F.hour("ts")).alias("s"), F.col("event_type").alias("variable")).agg(F.avg("value").alias("value"))


def fitted(df: DataFrame, keys: list[str], season, training, least: float = 1e-12) -> DataFrame:
    """clean.fit_transform, but a deviation below ``least`` in training is an error."""
    train = df.filter(training).groupBy(*keys).agg(F.stddev_pop("value").alias("sd"))
    flat = [tuple(r[:-1]) for r in train.filter(F.coalesce(F.col("sd"), F.lit(0.0)) < least).limit(5).collect()]
    if flat:
        raise ValueError(f"no variance in training: {flat}")
    return clean.fit_transform(df, keys, season, training)


@query("WITH " + _HOURS + ", d AS (SELECT t, variable, value - avg(value) OVER (PARTITION BY variable, s) AS x FROM h WHERE t % 5 <> 0) SELECT t, variable, round(x / stddev_pop(x) OVER (PARTITION BY variable), 7) AS value FROM d")
def window_hours(spark, sf_dir):
    """Standardised inside a window only: demeaned by month and hour, scaled by what is left."""
    d = clean.anomaly(hourly(spark, sf_dir).filter("t % 5 <> 0"), ["variable", "s"], F.lit(0))
    return d.select("t", "variable", F.round(F.col("value") / F.stddev_pop("value").over(Window.partitionBy("variable")), 7).alias("value"))


@query(ctes("station_climate") + """, m AS (SELECT t, avg(v) FILTER (variable = 'humidity') AS h, avg(v) FILTER (variable = 'cloud_cover') AS c FROM sc GROUP BY 1), q AS (SELECT quantile_cont(h, 0.2) AS hl, quantile_cont(h, 0.8) AS hh, quantile_cont(c, 0.2) AS cl, quantile_cont(c, 0.8) AS ch FROM m)
 SELECT regime, count(*) AS n, min(t) AS first_t, max(t) AS last_t FROM (SELECT t, unnest(['all', 'season_' || (t % 52 // 13), 'humidity_' || CASE WHEN h <= hl THEN 'low' WHEN h >= hh THEN 'high' ELSE 'normal' END, 'cloud_' || CASE WHEN c <= cl THEN 'low' WHEN c >= ch THEN 'high' ELSE 'normal' END]) AS regime FROM m, q) GROUP BY 1""")
def regime_catalogue(spark, sf_dir):
    """All regimes of the calendar: all, seasons, humidity states, cloud states."""
    return catalogue(panels.steps(station_series(spark, sf_dir).filter("variable in ('humidity', 'cloud_cover')"))).groupBy("regime").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


def catalogue(c: DataFrame, seasons: tuple[int, ...] = (0, 1, 2, 3), low: float = 0.2, high: float = 0.8, states: tuple[str, ...] = ("humidity", "cloud_cover")) -> DataFrame:
    """t, regime; the seasons, quantiles and variables asked for."""
    m = c.groupBy("t").pivot("variable", list(states)).agg(F.avg("value"))
    q = m.agg(*[F.percentile(v, F.array(F.lit(low), F.lit(high))).alias("q_" + v) for v in states])
    j = m.crossJoin(F.broadcast(q))  # one row
    state = lambda v: F.concat(F.lit(v.split("_")[0] + "_"), F.when(F.col(v) <= F.col("q_" + v)[0], "low").when(F.col(v) >= F.col("q_" + v)[1], "high").otherwise("normal"))
    season = F.floor(F.col("t") % 52 / 13)
    names = F.array(F.lit("all"), F.when(season.isin(*seasons), F.concat(F.lit("season_"), season.cast("string"))), *[state(v) for v in states])
    return j.select("t", F.explode(names).alias("regime")).filter("regime is not null")


@query(ctes("panel_orders", "panel_ship") + f", {_INDEX}, {_ASOF}, im2 AS (SELECT month, round(v, 5) AS v FROM im) SELECT st.t, st.month, im2.v AS value, CASE st.state WHEN 0 THEN 'low' WHEN 1 THEN 'middle' WHEN 2 THEN 'high' ELSE 'none' END AS state, CASE WHEN st.t < 1200 THEN 'train' ELSE 'later' END AS period, im2.v IS NULL AS missing, st.month < (year(st.ts) - 1995) * 12 + month(st.ts) - 1 AS before_cut FROM st LEFT JOIN im2 USING (month)")
def state_assignments(spark, sf_dir):
    """State of every target day with the month it is taken from, its value, the period, and that the month is over before the day."""
    i = index_states(spark, sf_dir).select("month", F.round("v", 5).alias("value"))
    s = asof_states(spark, sf_dir).join(i.hint("shuffle_merge"), "month", "left")
    name = F.when(F.col("state") == 0, "low").when(F.col("state") == 1, "middle").when(F.col("state") == 2, "high").otherwise("none")
    now = (F.year("ts") - 1995) * 12 + F.month("ts") - 1
    return s.select("t", "month", "value", name.alias("state"), F.when(F.col("t") < 1200, "train").otherwise("later").alias("period"), F.col("value").isNull().alias("missing"), (F.col("month") < now).alias("before_cut"))


@query(ctes("panel_orders", "panel_ship") + f", {_INDEX}, {_ASOF}, d AS (SELECT st.state, p.flag, p.price / 1000 AS y, b.disc * 100 AS z FROM panel_ship p JOIN st ON st.t = p.t JOIN panel_ship b ON b.flag = p.flag AND b.t = p.t - 1 WHERE st.state < 3), f AS (SELECT flag, state, count(*) AS n, regr_slope(y, z) AS b FROM d GROUP BY 1, 2) SELECT a.flag, CASE a.state WHEN 2 THEN 'high-middle' ELSE 'low-middle' END AS contrast, a.n + m.n AS n, round(a.b - m.b, 7) AS delta FROM f a JOIN f m ON m.flag = a.flag AND m.state = 1 WHERE a.state IN (0, 2)")
def antecedent_contrasts(spark, sf_dir):
    """Slopes under a high and a low antecedent index against the middle one."""
    st = asof_states(spark, sf_dir).filter("state < 3").select("t", "state")
    p = panel_ship(spark, sf_dir)
    z = p.select((F.col("t") + 1).alias("t"), "flag", (F.col("disc") * 100).alias("z"))
    d = p.select("t", "flag", (F.col("price") / 1000).alias("y")).join(z.hint("shuffle_merge"), ["t", "flag"]).join(st.hint("shuffle_merge"), "t")
    f = gram.fit(d, ["flag", "state"], []).select("flag", "state", "n", "beta")
    m = f.filter("state = 1").select("flag", F.col("n").alias("nm"), F.col("beta").alias("bm"))
    j = f.filter("state <> 1").join(m.hint("shuffle_merge"), "flag")
    return j.select("flag", F.when(F.col("state") == 2, "high-middle").otherwise("low-middle").alias("contrast"), (F.col("n") + F.col("nm")).alias("n"), F.round(F.col("beta") - F.col("bm"), 7).alias("delta"))


@query(ctes("panel_ship") + ", pd(period, a, b) AS (VALUES ('first', 100, 700), ('second', 650, 1400), ('third', 1400, 2400)), sg AS (SELECT flag, t, t - row_number() OVER (PARTITION BY flag ORDER BY t) AS island FROM panel_ship), w AS (SELECT s.flag, s.t, min(s.t) OVER (PARTITION BY s.flag, island) AS start FROM sg s) SELECT period, flag, count(*) AS origins, min(t) AS first_t, max(t) AS last_t FROM w, pd WHERE t BETWEEN a AND b AND t - 13 >= greatest(a, start) GROUP BY 1, 2")
def period_windows(spark, sf_dir):
    """Days of each period whose whole window of 13 days before lies inside the period and one unbroken stretch."""
    p = panel_ship(spark, sf_dir).select("flag", "t")
    s = p.withColumn("island", F.col("t") - F.row_number().over(Window.partitionBy("flag").orderBy("t")))
    s = s.withColumn("start", F.min("t").over(Window.partitionBy("flag", "island")))
    one = lambda n, a, b: s.filter(F.col("t").between(a, b) & (F.col("t") - 13 >= F.greatest(F.lit(a), "start"))).withColumn("period", F.lit(n))
    u = one("first", 100, 700).unionByName(one("second", 650, 1400)).unionByName(one("third", 1400, 2400))
    return u.groupBy("period", "flag").agg(F.count("*").alias("origins"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


# ---- replicates
@F.pandas_udf(DoubleType())
def t_half(df: pd.Series) -> pd.Series:
    return df.map(lambda k: t_quantile(0.975, float(k)))


@query(f"WITH RECURSIVE {_PRED}, m AS (SELECT region, model, y, avg(prediction - actual) AS b FROM pred GROUP BY 1, 2, 3), a AS (SELECT region, model, count(*) AS n, avg(b) AS mean, stddev_samp(b) AS sd, sqrt(avg(b * b)) AS rmse, count(*) FILTER (b > 0) AS up FROM m GROUP BY 1, 2 HAVING count(*) > 1), bs AS (SELECT df, 0.0::DOUBLE AS lo, 100.0::DOUBLE AS hi, 0 AS i FROM (SELECT DISTINCT n - 1 AS df FROM a) UNION ALL SELECT df, CASE WHEN {t_tail_sql('((lo + hi) / 2)', 'df')} > 0.05 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {t_tail_sql('((lo + hi) / 2)', 'df')} > 0.05 THEN hi ELSE (lo + hi) / 2 END, i + 1 FROM bs WHERE i < 60) SELECT region, model, n AS replicates, round(mean, 7) AS mean, round(mean - lo * sd / sqrt(n), 6) AS low, round(mean + lo * sd / sqrt(n), 6) AS high, round(rmse, 7) AS rmse, round(up / n::DOUBLE, 8) AS positive, abs(mean) > lo * sd / sqrt(n) AS rejects FROM a JOIN bs ON bs.df = a.n - 1 AND i = 60")
def replicate_intervals(spark, sf_dir):
    """Yearly biases as replicates: mean with its t interval, root mean square, share above zero, whether zero is rejected."""
    m = predictions(spark, sf_dir).groupBy("region", "model", "y").agg(F.avg(F.col("prediction") - F.col("actual")).alias("b"))
    a = m.groupBy("region", "model").agg(F.count("*").alias("replicates"), F.avg("b").alias("mean"), F.stddev_samp("b").alias("sd"), F.sqrt(F.avg(F.col("b") * F.col("b"))).alias("rmse"), F.avg(F.when(F.col("b") > 0, 1.0).otherwise(0.0)).alias("up")).filter("replicates > 1")
    half = F.col("q") * F.col("sd") / F.sqrt("replicates")
    a = a.withColumn("q", t_half((F.col("replicates") - 1).cast("double")))
    return a.select("region", "model", "replicates", F.round("mean", 7).alias("mean"), F.round(F.col("mean") - half, 6).alias("low"), F.round(F.col("mean") + half, 6).alias("high"), F.round("rmse", 7).alias("rmse"), F.round("up", 8).alias("positive"), (F.abs("mean") > half).alias("rejects"))


@query(ctes("tests") + f", p AS (SELECT regime, source_region = target_region AS truth, unnest(['ols', 'hac']) AS method, unnest([abs(effect) / se_ols, abs(effect) / se_hac]) > 1.96 AS sig FROM tests) SELECT regime, method, count(*) AS tested, count(*) FILTER (sig) AS found, count(*) FILTER (sig AND NOT truth) AS false_found, round(count(*) FILTER (sig AND NOT truth) / nullif(count(*) FILTER (sig), 0)::DOUBLE, 8) AS empirical_fdr, round(count(*) FILTER (sig AND truth) / (count(*) FILTER (truth))::DOUBLE, 8) AS power FROM p GROUP BY 1, 2")
def empirical_fdr(spark, sf_dir):
    """Finds of two error models with a station's own links taken as true: false share and power by season."""
    t = tests(spark, sf_dir).filter("effect is not null")
    k = F.explode(F.array(*[F.struct(F.lit(n).alias("method"), (F.abs("effect") / F.col("se_" + n) > 1.96).alias("sig")) for n in ("ols", "hac")]))
    p = t.select("regime", (F.col("source_region") == F.col("target_region")).alias("truth"), k.alias("k")).select("regime", "truth", "k.*")
    found, false = F.count_if("sig"), F.count_if(F.col("sig") & ~F.col("truth"))
    return p.groupBy("regime", "method").agg(
        F.count("*").alias("tested"), found.alias("found"), false.alias("false_found"), F.round(F.try_divide(false, found), 8).alias("empirical_fdr"), F.round(F.try_divide(F.count_if(F.col("sig") & F.col("truth")), F.count_if("truth")), 8).alias("power")
    )


@query(ctes("station_climate") + f", d AS (SELECT node, variable, t, v AS y, lag(v, 1) OVER w AS c, lag(v, 2) OVER w AS z FROM sc WINDOW w AS (PARTITION BY node, variable ORDER BY t)), m AS (SELECT node, variable, count(*) AS n, covar_pop(y, y) * count(*) AS syy, covar_pop(c, c) * count(*) AS scc, covar_pop(z, z) * count(*) AS szz, covar_pop(y, c) * count(*) AS syc, covar_pop(y, z) * count(*) AS syz, covar_pop(c, z) * count(*) AS scz FROM d WHERE z IS NOT NULL GROUP BY 1, 2), f AS (SELECT *, syz - scz * syc / scc AS zy, szz - scz * scz / scc AS zss, syy - syc * syc / scc AS r FROM m), s AS (SELECT *, zy / sqrt(zss * (r - zy * zy / zss) / (n - 3)) AS t FROM f) SELECT node, variable, n, round(zy / zss, 7) AS beta, round(t, 5) AS t, round({t_tail_sql('t', '(n - 3)')}, 7) AS p_value FROM s")
def own_history_tests(spark, sf_dir):
    """What the second step of a series' own past adds to the first, for every series."""
    w = Window.partitionBy("node", "variable").orderBy("t")
    d = station_climate(spark, sf_dir).select("node", "variable", F.col("value").alias("y"), F.lag("value", 1).over(w).alias("c"), F.lag("value", 2).over(w).alias("z")).filter("z is not null")
    f = gram.fit(d, ["node", "variable"], ["c"])
    t = F.col("beta") / F.col("se")
    return f.select("node", "variable", "n", F.round("beta", 7).alias("beta"), F.round(t, 5).alias("t"), F.round(p_t(t, F.col("df").cast("double")), 7).alias("p_value"))
