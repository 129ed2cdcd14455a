"""Eddy, linear and placebo convergence of fields with zonal means and closure."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagloom.plans import section
from lagloom.plans.m_verify import flux_divergence
from lagloom.sources.fixtures import table

QUERIES, query = section()
_ROWS, _COLS, _YEAR = 8, 12, 12
_DISCOVERY = 0.7  # share of the calendar that climatology and placebo may read
_PARTS = ("total", "mean", "linear", "eddy", "eddy_zonal", "eddy_wave", "placebo")


def fields(spark, sf_dir) -> DataFrame:
    """Monthly fields u, v, q on a grid of 8 x 12 cells, every cell at every step (null where nothing was measured)."""
    li = table(spark, sf_dir, "lineitem")
    t = ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1).cast("long").alias("t")
    i, j = (F.col("l_partkey") * 31 % _ROWS).cast("long").alias("i"), (F.col("l_suppkey") * 7 % _COLS).cast("long").alias("j")
    f = li.groupBy(t, i, j).agg(F.avg("l_quantity").alias("q"), (F.avg("l_discount") * 100).alias("u"), (F.avg("l_tax") * 100).alias("v"))
    ends = f.agg(F.min("t").alias("a"), F.max("t").alias("b")).select(F.explode(F.sequence("a", "b")).alias("t"))
    grid = ends.select("t", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_ROWS - 1).cast("long"))).alias("i")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_COLS - 1).cast("long"))).alias("j"))
    return grid.join(f.hint("shuffle_merge"), ["t", "i", "j"], "left")


def anomalies(f: DataFrame, names: list[str], year: int = _YEAR, discovery: float = _DISCOVERY) -> DataFrame:
    """``f`` with climatology ``xc`` (of discovery steps) and anomaly ``xa`` (0 where missing) of each name, and the placebo's step.

    The placebo of a step is a year before; that of the first year lies at the end of
    discovery, so no discovery step reads a later one.
    """
    ends = f.agg(F.min("t").alias("t0"), F.max("t").alias("t1")).withColumn("held", F.col("t0") + F.floor((F.col("t1") - F.col("t0") + 1) * discovery).cast("long")).drop("t1")
    x = f.crossJoin(F.broadcast(ends))  # one row
    w = Window.partitionBy("i", "j", F.col("t") % year)
    x = x.withColumns({f"{n}c": F.coalesce(F.avg(F.when(F.col("t") < F.col("held"), F.col(n))).over(w), F.lit(0.0)) for n in names})
    x = x.withColumns({f"{n}a": F.coalesce(F.col(n) - F.col(f"{n}c"), F.lit(0.0)) for n in names})
    before = F.col("t") - year
    return x.withColumn("source", F.when(before >= F.col("t0"), before).otherwise(before + F.col("held") - F.col("t0")))


def flux_parts(spark, sf_dir) -> DataFrame:
    """part, t, i, j, qu, qv, discovery: products of climatology and anomalies that make up the flux, the zonal mean of the eddy part, and the placebo."""
    a = anomalies(fields(spark, sf_dir), ["u", "v", "q"])
    lagged = a.select("i", "j", F.col("t").alias("source"), F.col("qa").alias("qp"))
    a = a.join(lagged.hint("shuffle_merge"), ["i", "j", "source"])
    row = Window.partitionBy("t", "i")
    q, qa = F.col("qc"), F.col("qa")

    def parts(n: str) -> dict:
        base, an = F.col(f"{n}c"), F.col(f"{n}a")
        eddy = an * qa
        return {
            "total": (base + an) * (q + qa), "mean": base * q, "linear": base * qa + an * q, "eddy": eddy, "eddy_zonal": F.avg(eddy).over(row),
            "eddy_wave": eddy - F.avg(eddy).over(row), "placebo": an * F.col("qp"),
        }

    a = a.withColumns({f"{p}_{n}": c for n in "uv" for p, c in parts(n).items()})
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.col(f"{p}_u").alias("qu"), F.col(f"{p}_v").alias("qv")) for p in _PARTS]))
    return a.select("t", "i", "j", (F.col("t") < F.col("held")).alias("discovery"), each.alias("p")).select("p.part", "t", "i", "j", "discovery", "p.qu", "p.qv")


_F = f"""WITH f0 AS (SELECT ((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1)::BIGINT AS t, CAST(l_partkey * 31 % {_ROWS} AS BIGINT) AS i, CAST(l_suppkey * 7 % {_COLS} AS BIGINT) AS j, avg(l_quantity) AS q, avg(l_discount) * 100 AS u, avg(l_tax) * 100 AS v FROM lineitem GROUP BY 1, 2, 3),
 ff AS (SELECT tt.t, i.i, j.j, q, u, v, t0, t0 + floor((t1 - t0 + 1) * {_DISCOVERY}::DOUBLE)::BIGINT AS held FROM (SELECT min(t) AS t0, max(t) AS t1 FROM f0) e, LATERAL (SELECT unnest(range(t0, t1 + 1)) AS t) tt, range({_ROWS}) i(i), range({_COLS}) j(j) LEFT JOIN f0 ON f0.t = tt.t AND f0.i = i.i AND f0.j = j.j),
 fc AS (SELECT *, {", ".join(f"coalesce(avg({n}) FILTER (t < held) OVER w, 0) AS {n}c" for n in "uvq")} FROM ff WINDOW w AS (PARTITION BY i, j, t % {_YEAR})), fa AS MATERIALIZED (SELECT *, {", ".join(f"coalesce({n} - {n}c, 0) AS {n}a" for n in "uvq")}, CASE WHEN t - {_YEAR} >= t0 THEN t - {_YEAR} ELSE t - {_YEAR} + held - t0 END AS source FROM fc),
 fp AS (SELECT a.*, b.qa AS qp FROM fa a JOIN fa b ON b.i = a.i AND b.j = a.j AND b.t = a.source),
 pt AS MATERIALIZED (SELECT part, t, i, j, t < held AS discovery, {", ".join(f"CASE part WHEN 'total' THEN ({n}c + {n}a) * (qc + qa) WHEN 'mean' THEN {n}c * qc WHEN 'linear' THEN {n}c * qa + {n}a * qc WHEN 'eddy' THEN {n}a * qa WHEN 'eddy_zonal' THEN {n}z WHEN 'eddy_wave' THEN {n}a * qa - {n}z ELSE {n}a * qp END AS q{n}" for n in "uv")}
  FROM (SELECT *, avg(ua * qa) OVER (PARTITION BY t, i) AS uz, avg(va * qa) OVER (PARTITION BY t, i) AS vz FROM fp), (VALUES {", ".join(f"('{p}')" for p in _PARTS)}) k(part)),
 nb AS (SELECT c.part, c.t, c.i, c.j, c.qu, c.qv, e.qu AS eu, w.qu AS wu, n.qv AS nv, s.qv AS sv FROM pt c JOIN pt e ON e.part = c.part AND e.t = c.t AND e.i = c.i AND e.j = (c.j + 1) % {_COLS} JOIN pt w ON w.part = c.part AND w.t = c.t AND w.i = c.i AND w.j = (c.j + {_COLS - 1}) % {_COLS}
  LEFT JOIN pt n ON n.part = c.part AND n.t = c.t AND n.j = c.j AND n.i = c.i + 1 LEFT JOIN pt s ON s.part = c.part AND s.t = c.t AND s.j = c.j AND s.i = c.i - 1),
 ar AS (SELECT *, 6371.0 * 6371.0 * radians({360.0 / _COLS}) * (sin(radians(-90 + {180.0 / _ROWS} * (i + 1))) - sin(radians(-90 + {180.0 / _ROWS} * i))) AS area FROM nb),
 dv AS MATERIALIZED (SELECT part, t, i, j, area, ((eu - wu) / 2 * 6371.0 * radians({180.0 / _ROWS}) + (coalesce((qv + nv) / 2, 0) * cos(radians(-90 + {180.0 / _ROWS} * (i + 1))) - coalesce((qv + sv) / 2, 0) * cos(radians(-90 + {180.0 / _ROWS} * i))) * 6371.0 * radians({360.0 / _COLS})) / area AS d FROM ar)"""


def _divergence(spark, sf_dir) -> DataFrame:
    return flux_divergence(flux_parts(spark, sf_dir).select("part", "t", "i", "j", "qu", "qv"), _ROWS, _COLS, by=("part", "t"))


@query(_F + f""", rg AS (SELECT part, t, (i // 2) * 3 + j // 4 AS region, -sum(d * area) / sum(area) AS c FROM dv GROUP BY 1, 2, 3), p AS (SELECT t, region, {", ".join(f"max(c) FILTER (part = '{p}') AS {p}" for p in _PARTS)} FROM rg GROUP BY 1, 2)
 SELECT t, region, {", ".join(f"round({p}, 8) + 0.0 AS {p}" for p in _PARTS)}, abs(total - mean - linear - eddy) < 1e-9 AND abs(eddy - eddy_zonal - eddy_wave) < 1e-9 AS adds_up FROM p""")
def eddy_terms(spark, sf_dir):
    """Convergence by region and month of the whole flux and its parts: climatology, linear, eddy (its zonal mean and its waves), and the eddy with last year's quantity as a placebo."""
    d = _divergence(spark, sf_dir)
    region = (F.floor(F.col("i") / 2) * 3 + F.floor(F.col("j") / 4)).alias("region")
    p = d.groupBy("t", region).pivot("part", list(_PARTS)).agg(-F.sum(F.col("d") * F.col("area")) / F.sum("area"))
    ok = (F.abs(F.col("total") - F.col("mean") - F.col("linear") - F.col("eddy")) < 1e-9) & (F.abs(F.col("eddy") - F.col("eddy_zonal") - F.col("eddy_wave")) < 1e-9)
    return p.select("t", "region", *[(F.round(c, 8) + 0.0).alias(c) for c in _PARTS], ok.alias("adds_up"))


@query(_F + ", s AS (SELECT part, t, sum(d * area) AS net, sum(abs(d) * area) AS size FROM dv GROUP BY 1, 2) SELECT part, count(*) AS steps, max(abs(net) / CASE WHEN size > 0 THEN size ELSE 1 END) < 1e-9 AS closed FROM s GROUP BY 1")
def eddy_closure(spark, sf_dir):
    """The divergences of every part add up to nothing over the sphere at each step."""
    s = _divergence(spark, sf_dir).groupBy("part", "t").agg(F.sum(F.col("d") * F.col("area")).alias("net"), F.sum(F.abs("d") * F.col("area")).alias("size"))
    return s.groupBy("part").agg(F.count("*").alias("steps"), (F.max(F.abs("net") / F.when(F.col("size") > 0, F.col("size")).otherwise(1.0)) < 1e-9).alias("closed"))


@query(_F + f" SELECT i, round(-90 + {180.0 / _ROWS} * (i + 0.5), 4) AS lat, count(*) AS n, round(avg(qu), 8) AS uq, round(avg(qv), 8) AS vq FROM pt WHERE part = 'eddy' AND discovery GROUP BY 1")
def zonal_eddy_flux(spark, sf_dir):
    """Mean eddy flux of each row of the grid over the discovery steps."""
    e = flux_parts(spark, sf_dir).filter("part = 'eddy' and discovery")
    return e.groupBy("i").agg(F.round(F.lit(-90.0) + 180.0 / _ROWS * (F.first("i") + 0.5), 4).alias("lat"), F.count("*").alias("n"), F.round(F.avg("qu"), 8).alias("uq"), F.round(F.avg("qv"), 8).alias("vq"))


@query(_F + ", x AS (SELECT part, t, (i // 2) * 3 + j // 4 AS region, -sum(d * area) / sum(area) AS c FROM dv WHERE part IN ('eddy', 'placebo') GROUP BY 1, 2, 3), m AS (SELECT *, c - avg(c) FILTER (t < held) OVER (PARTITION BY part, region, t % 12) AS a, t < held AS discovery FROM x, (SELECT any_value(held) AS held FROM ff)), z AS (SELECT *, (a - avg(a) FILTER (discovery) OVER w) / greatest(stddev_pop(a) FILTER (discovery) OVER w, 1e-8) AS z FROM m WINDOW w AS (PARTITION BY part, region)) SELECT region, part, count(*) AS n, round(stddev_pop(c), 7) AS sd, round(avg(z) FILTER (NOT discovery), 6) AS later_mean, round(stddev_pop(z) FILTER (NOT discovery), 6) AS later_sd FROM z GROUP BY 1, 2")
def eddy_index(spark, sf_dir):
    """The eddy and the placebo series of every region, standardised by month with the discovery steps; what the later steps then look like."""
    d = _divergence(spark, sf_dir).filter("part in ('eddy', 'placebo')")
    x = d.groupBy("part", "t", (F.floor(F.col("i") / 2) * 3 + F.floor(F.col("j") / 4)).alias("region")).agg((-F.sum(F.col("d") * F.col("area")) / F.sum("area")).alias("c"))
    marks = fields(spark, sf_dir).agg((F.min("t") + F.floor((F.max("t") - F.min("t") + 1) * _DISCOVERY)).cast("long").alias("held"))
    x = x.crossJoin(F.broadcast(marks)).withColumn("discovery", F.col("t") < F.col("held"))  # one row
    known = lambda c: F.when(F.col("discovery"), F.col(c))
    x = x.withColumn("a", F.col("c") - F.avg(known("c")).over(Window.partitionBy("part", "region", F.col("t") % 12)))
    w = Window.partitionBy("part", "region")
    x = x.withColumn("z", (F.col("a") - F.avg(known("a")).over(w)) / F.greatest(F.stddev_pop(known("a")).over(w), F.lit(1e-8)))
    later = F.when(~F.col("discovery"), F.col("z"))
    return x.groupBy("region", "part").agg(F.count("*").alias("n"), F.round(F.stddev_pop("c"), 7).alias("sd"), F.round(F.avg(later), 6).alias("later_mean"), F.round(F.stddev_pop(later), 6).alias("later_sd"))
