"""Contrasts between states of the calendar with HAC errors, families with remote and placebo sources, projected vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagloom.functions.tails import p_z
from lagloom.operators import joint, panels, screen, settings, spatial
from lagloom.operators.fdr import bh_large
from lagloom.operators.lineage import stored, written
from lagloom.plans import section
from lagloom.plans.o_contrasts import _BANDS, _hac_sql
from lagloom.plans.q_windows import bundled
from lagloom.plans.v_shared import calendar_shares
from lagloom.plans.w_settings import _RUN, _bin_sql
from lagloom.sources.fixtures import VARIABLES, _station_panel, ctes, normal_tail_sql, sources, station_candidates, station_series, stations, weeks
from lagloom.sources.sqltext import gram_sql, influence_sql, sweep_sql

QUERIES, query = section()
_KEY = ["source_region", "target_region", "source_var", "target_var"]
_K = ", ".join(_KEY)
_AHEAD, _TRAINED = 4, 0.70  # the state of a step is that of four steps before, by quantiles of this share of the calendar

# ---- contrasts
_CUT = f"cu AS (SELECT a, b, a + floor((b - a) * {_TRAINED}::DOUBLE)::BIGINT AS cut FROM (SELECT min(t) AS a, max(t) + 1 AS b FROM sc))"
_STATES = f"""{_CUT}, hm AS (SELECT t, avg(v) AS x FROM sc WHERE variable = 'humidity' GROUP BY 1), hq AS (SELECT quantile_cont(x, 0.2) AS lo, quantile_cont(x, 0.8) AS hi FROM hm, cu WHERE t < cut),
 st0 AS (SELECT t + {_AHEAD} AS t, CASE WHEN x <= lo THEN 'low' WHEN x >= hi THEN 'high' ELSE 'middle' END AS state FROM hm, hq),
 st AS MATERIALIZED (SELECT st0.t, contrast, s FROM st0, (VALUES ('high-middle', 'high', 1.0), ('high-middle', 'middle', 0.0), ('low-middle', 'low', 1.0), ('low-middle', 'middle', 0.0)) k(contrast, name, s) WHERE state = name UNION ALL SELECT t, 'winter-summer', CASE WHEN t % 52 < 26 THEN 1.0 ELSE 0.0 END FROM (SELECT DISTINCT t FROM sc))"""
_CK = f"{_K}, contrast, period"
_COLS = ["one", "c1", "s", "cs", "z", "zs", "y"]
_CONTRAST = ctes("tests").replace("WITH ", "WITH RECURSIVE ", 1) + f""", {_STATES},
 ro AS MATERIALIZED (SELECT {_K}, contrast, CASE WHEN td.t < cut THEN 'early' ELSE 'late' END AS period, td.t, 1.0::DOUBLE AS one, c AS c1, s::DOUBLE AS s, c * s AS cs, z, z * s AS zs, y FROM td JOIN st ON st.t = td.t, cu WHERE lag = 1),
 {gram_sql("g", "ro", _COLS, _CK)}, {sweep_sql("f", "g", 7, 6, _CK)}, {influence_sql("iv", "ro", "f", _COLS, _CK, ", m[35] AS reference")}, {_hac_sql("hv", "iv", _CK)},
 al AS (SELECT {_CK}, any_value(n) AS n, any_value(beta) AS delta, any_value(reference) AS reference FROM iv GROUP BY ALL), pv AS (SELECT al.*, sqrt(var) AS se, round({normal_tail_sql("(delta / sqrt(var))")}, 9) AS p, source_var || '->' || target_var AS edge_type FROM al JOIN hv USING ({_CK})),
 r1 AS (SELECT *, row_number() OVER (PARTITION BY period, contrast ORDER BY p) AS r, count(*) OVER (PARTITION BY period, contrast) AS m, row_number() OVER (ORDER BY p) AS ra, count(*) OVER () AS ma FROM pv),
 cq AS MATERIALIZED (SELECT *, least(1, min(p * m / r) OVER (PARTITION BY period, contrast ORDER BY r DESC)) AS q_family, least(1, min(p * ma / ra) OVER (ORDER BY ra DESC)) AS q_all FROM r1)"""


def state_steps(c: DataFrame, cut: int) -> dict[str, tuple[set[int], set[int]]]:
    """Steps of the reference and of the other state of each contrast; as many as the calendar has."""
    m = c.filter("variable = 'humidity'").groupBy("t").agg(F.avg("value").alias("x"))
    lo, hi = m.filter(F.col("t") < cut).agg(F.percentile("x", F.array(F.lit(0.2), F.lit(0.8)))).first()[0]
    state: dict[str, set[int]] = {"low": set(), "middle": set(), "high": set()}
    steps = m.collect()  # one row per step of the calendar
    for r in steps:
        state["low" if r.x <= lo else "high" if r.x >= hi else "middle"].add(r.t + _AHEAD)
    season = {r.t for r in steps if r.t % 52 < 26}, {r.t for r in steps if r.t % 52 >= 26}
    return {"high-middle": (state["middle"], state["high"]), "low-middle": (state["middle"], state["low"]), "winter-summer": (season[1], season[0])}


def contrasts(spark, sf_dir) -> DataFrame:
    """All contrasts of all candidates, q within period and contrast and over all. Stored once."""

    def make():
        s = station_series(spark, sf_dir)
        (cut,) = calendar_shares(s, _TRAINED)
        r = screen.state_contrasts(station_candidates(spark, sf_dir), s, state_steps(panels.steps(s), cut), {"early": (-(10**9), cut), "late": (cut, 10**9)})
        r = written(r.filter("delta is not null").withColumn("p_value", F.round("p_value", 9)), "contrasts")  # read by both families
        return bh_large(bh_large(r, ["period", "contrast"], q="q_family"), None, q="q_all").withColumn("edge_type", F.concat_ws("->", "source_var", "target_var"))

    return stored(spark, "contrasts", sources(sf_dir, "lineitem", "supplier"), make, trained=_TRAINED, ahead=_AHEAD)


@query(_CONTRAST + f" SELECT {_CK}, n, round(reference, 7) AS reference, round(delta, 7) AS delta, round(se, 7) AS se_hac, p AS p_value, round(q_family, 7) AS q_family, round(q_all, 7) AS q_all FROM cq")
def state_contrast_tests(spark, sf_dir):
    """Links of all stations under a high and a low antecedent state against the middle one, and in winter against summer, with HAC errors."""
    return contrasts(spark, sf_dir).select(*_KEY, "contrast", "period", "n", "p_value", *[F.round(c, 7).alias(c) for c in ("reference", "delta", "se_hac", "q_family", "q_all")])


@query(_CONTRAST + """, cs AS (SELECT *, CASE WHEN lat >= 0 THEN 'north' ELSE 'south' END AS hemisphere FROM cq JOIN cells ON node = target_region) SELECT period, contrast, edge_type, coalesce(hemisphere, 'all') AS hemisphere, count(*) AS tested, count(*) FILTER (q_family < 0.2) AS found, count(*) FILTER (q_all < 0.2) AS found_all, round(avg(delta), 8) AS mean, round(quantile_cont(delta, 0.5), 7) AS median, round(avg(CASE WHEN sign(delta) = sign(reference) THEN 1.0 ELSE 0.0 END), 8) AS strengthened
 FROM cs GROUP BY GROUPING SETS ((period, contrast, edge_type), (period, contrast, edge_type, hemisphere))""")
def state_contrast_summary(spark, sf_dir):
    """Contrasts by period, type and hemisphere of the target: how many are found in each family, their mean and median, and the share that adds to the link."""
    side = stations(spark, sf_dir).select(F.col("node").alias("target_region"), F.when(F.col("lat") >= 0, "north").otherwise("south").alias("h"))
    c = contrasts(spark, sf_dir).join(side.hint("shuffle_merge"), "target_region").withColumn("hemisphere", F.explode(F.array("h", F.lit("all"))))
    same = F.when(F.signum("delta") == F.signum("reference"), 1.0).otherwise(0.0)
    return c.groupBy("period", "contrast", "edge_type", "hemisphere").agg(
        F.count("*").alias("tested"), F.count_if(F.col("q_family") < 0.2).alias("found"), F.count_if(F.col("q_all") < 0.2).alias("found_all"), F.round(F.avg("delta"), 8).alias("mean"),
        F.round(F.percentile("delta", 0.5), 7).alias("median"), F.round(F.avg(same), 8).alias("strengthened"),
    )


@query(_CONTRAST + f", e AS (SELECT * FROM cq WHERE period = 'early'), l AS (SELECT * FROM cq WHERE period = 'late') SELECT contrast, edge_type, count(*) AS links, round(avg(CASE WHEN sign(e.delta) = sign(l.delta) THEN 1.0 ELSE 0.0 END), 8) AS same_sign, round(corr(e.delta, l.delta), 7) AS r, count(*) FILTER (e.p < 0.2 AND l.p < 0.2 AND sign(e.delta) = sign(l.delta)) AS kept FROM e JOIN l USING ({_K}, contrast, edge_type) GROUP BY 1, 2")
def state_contrast_stability(spark, sf_dir):
    """Whether the contrasts of the early period come back in the late one."""
    c = contrasts(spark, sf_dir)
    key = [*_KEY, "contrast", "edge_type"]
    of = lambda p, s: c.filter(F.col("period") == p).select(*key, F.col("delta").alias("d" + s), F.col("p_value").alias("p" + s))
    j = of("early", "1").join(of("late", "2").hint("shuffle_merge"), key)
    same = F.signum("d1") == F.signum("d2")
    return j.groupBy("contrast", "edge_type").agg(
        F.count("*").alias("links"), F.round(F.avg(F.when(same, 1.0).otherwise(0.0)), 8).alias("same_sign"), F.round(F.covar_pop("d1", "d2") / (F.stddev_pop("d1") * F.stddev_pop("d2")), 7).alias("r"),
        F.count_if(same & (F.col("p1") < 0.2) & (F.col("p2") < 0.2)).alias("kept"),
    )


# ---- families
_COLUMNS, _SHIFT, _YEAR, _ALPHA = 11, 5, 52, 0.3
_SPANS = (0.5, 0.75)  # shares of the calendar at which screening and confirmation end


def remote_of(region):
    """The region of the same band ``_SHIFT`` columns on, of ``_COLUMNS``."""
    band = F.floor(region / _COLUMNS)
    return (band * _COLUMNS + (region % _COLUMNS + _SHIFT) % _COLUMNS).cast("long")


def family_tests(spark, sf_dir) -> DataFrame:
    """family, region, lag with the stages of every test. Stored once.

    Sources of a region's humidity: its own wind (local), that of the same band further on
    (remote), its own wind of a year before (placebo). Screened, confirmed and replicated on
    three spans of the calendar; q within family, at the end among confirmed tests and, as a
    negative control, among the others.
    """

    def make():
        one = [s for s in settings.SETTINGS if s[0] == "P1_monthly"]
        r = panels.steps(settings.regional(_station_panel(spark, sf_dir), VARIABLES, weeks(spark, sf_dir), stations(spark, sf_dir), one, _YEAR))
        late = r.filter("variable = 'wind'").select("node", F.lit("wind_before").alias("variable"), (F.col("t") + _YEAR).alias("t"), "value")
        given = screen.series(r.filter("variable in ('wind', 'humidity')").unionByName(late))
        nodes = r.select("node").distinct()
        families = F.explode(F.array(
            F.struct(F.lit("local").alias("family"), F.col("node").alias("source_region"), F.lit("wind").alias("source_var")), F.struct(F.lit("remote").alias("family"), remote_of(F.col("node")).alias("source_region"), F.lit("wind").alias("source_var")),
            F.struct(F.lit("placebo").alias("family"), F.col("node").alias("source_region"), F.lit("wind_before").alias("source_var")),
        )).alias("f")
        cand = nodes.select(F.col("node").alias("target_region"), families, F.lit("humidity").alias("target_var")).select("f.family", "f.source_region", "target_region", "f.source_var", "target_var")
        a, b = calendar_shares(given.filter("variable = 'humidity'"), *_SPANS)
        spans = {"s1": (10**9, 0, a), "s2": (10**9, a, b), "s3": (10**9, b, 10**9)}
        t = screen.screen(cand, given, regimes=spans).filter("effect is not null")
        t = t.join(cand.hint("shuffle_merge"), _KEY).groupBy("family", F.col("target_region").alias("region"), "lag").pivot("regime", list(spans)).agg(F.first("effect").alias("effect"), F.round(F.first("p_value"), 9).alias("p"), F.first("partial_r2").alias("r2"))
        t = t.filter("s1_p is not null and s2_p is not null and s3_p is not null")
        t = bh_large(bh_large(t, ["family"], "s1_p", "s1_q"), ["family"], "s2_p", "s2_q")
        t = t.withColumn("s1_pass", F.col("s1_q") < _ALPHA).withColumn("s2_pass", F.col("s1_pass") & (F.col("s2_q") < _ALPHA))
        one_sided = F.when(F.signum("s3_effect") == F.signum("s2_effect"), F.col("s3_p") / 2).otherwise(1 - F.col("s3_p") / 2)
        return bh_large(t.withColumn("s3_one", F.round(one_sided, 9)), ["family", "s2_pass"], "s3_one", "s3_q")

    return stored(spark, "family-tests", sources(sf_dir, "lineitem", "supplier"), make, alpha=_ALPHA, spans=_SPANS)


def _q_sql(name: str, src: str, by: str, p: str, q: str) -> str:
    return f"{name}_ AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {p}) AS r_, count(*) OVER (PARTITION BY {by}) AS n_ FROM {src}), {name} AS (SELECT * EXCLUDE (r_, n_), least(1, min({p} * n_ / r_) OVER (PARTITION BY {by} ORDER BY r_ DESC)) AS {q} FROM {name}_)"


_FK = "family, region, lag, span"
_FAM = _RUN[: _RUN.index(",\nct AS MATERIALIZED")].replace("WITH ", "WITH RECURSIVE ", 1) + f""",
 rs AS MATERIALIZED (SELECT node, variable, t, v FROM zs WHERE setting = 'P1_monthly' AND variable IN ('wind', 'humidity') UNION ALL SELECT node, 'wind_before', t + {_YEAR}, v FROM zs WHERE setting = 'P1_monthly' AND variable = 'wind'),
 cu AS (SELECT a + floor((b - a) * {_SPANS[0]}::DOUBLE)::BIGINT AS c1, a + floor((b - a) * {_SPANS[1]}::DOUBLE)::BIGINT AS c2, b FROM (SELECT min(t) AS a, max(t) + 1 AS b FROM rs WHERE variable = 'humidity')),
 fm AS (SELECT DISTINCT node AS region, f.* FROM rs, LATERAL (VALUES ('local', node, 'wind'), ('remote', (node // {_COLUMNS}) * {_COLUMNS} + (node % {_COLUMNS} + {_SHIFT}) % {_COLUMNS}, 'wind'), ('placebo', node, 'wind_before')) f(family, source, var) WHERE variable = 'humidity'),
 fo AS MATERIALIZED (SELECT node, t, v AS y, lag(v) OVER (PARTITION BY node ORDER BY t) AS c1 FROM rs WHERE variable = 'humidity'),
 fr AS MATERIALIZED (SELECT family, region, lag::BIGINT AS lag, CASE WHEN fo.t < cu.c1 THEN 's1' WHEN fo.t < cu.c2 THEN 's2' ELSE 's3' END AS span, fo.t, 1.0::DOUBLE AS one, fo.c1, x.v AS z, y FROM fm JOIN fo ON fo.node = region CROSS JOIN range(1, 4) l(lag) JOIN rs x ON x.node = source AND x.variable = var AND x.t = fo.t - lag, cu WHERE fo.c1 IS NOT NULL AND EXISTS (SELECT 1 FROM rs w WHERE w.node = source AND w.variable = var AND w.t = fo.t - 1)),
 fl AS (SELECT family, region, min(t) AS t0 FROM fr GROUP BY ALL),
 {gram_sql("g", "fr", ["one", "c1", "z", "y"], _FK)}, {sweep_sql("f", "g", 4, 3, _FK)}, {influence_sql("iv", "fr", "f", ["one", "c1", "z", "y"], _FK)}, {_hac_sql("hv", "iv", _FK)},
 fa AS (SELECT {_FK}, any_value(beta) AS effect, round({normal_tail_sql("(any_value(beta) / sqrt(any_value(var)))")}, 9) AS p FROM iv JOIN hv USING ({_FK}) GROUP BY ALL),
 fw AS (SELECT family, region, lag, {", ".join(f"max({c}) FILTER (span = '{s}') AS {s}_{c}" for s in ("s1", "s2", "s3") for c in ("effect", "p"))} FROM fa GROUP BY ALL HAVING count(*) = 3),
 {_q_sql("q1", "fw", "family", "s1_p", "s1_q")}, {_q_sql("q2", "q1", "family", "s2_p", "s2_q")},
 fs AS (SELECT *, s1_q < {_ALPHA} AS s1_pass, s1_q < {_ALPHA} AND s2_q < {_ALPHA} AS s2_pass, round(CASE WHEN sign(s3_effect) = sign(s2_effect) THEN s3_p / 2 ELSE 1 - s3_p / 2 END, 9) AS s3_one FROM q2), {_q_sql("q3", "fs", "family, s2_pass", "s3_one", "s3_q")}"""


@query(_FAM + " SELECT family, region, lag, round(s1_effect, 7) AS s1_effect, round(s1_q, 7) AS s1_q, round(s2_q, 7) AS s2_q, s1_pass, s2_pass, s3_one, round(s3_q, 7) AS s3_q FROM q3")
def source_families(spark, sf_dir):
    """Stages of every test of the local, remote and placebo sources of the regions."""
    return family_tests(spark, sf_dir).select("family", "region", "lag", *[F.round(c, 7).alias(c) for c in ("s1_effect", "s1_q", "s2_q")], "s1_pass", "s2_pass", "s3_one", F.round("s3_q", 7).alias("s3_q"))


@query(_FAM + f", w AS (SELECT q3.*, {_BANDS} AS band FROM q3 JOIN rg ON rg.size = 66 AND rg.node = region) SELECT family, coalesce(band, 'all') AS band, count(*) AS tested, count(*) FILTER (s1_pass) AS screened, count(*) FILTER (s2_pass) AS confirmed, count(*) FILTER (s2_pass AND s2_effect > 0) AS confirmed_positive, count(*) FILTER (s2_pass AND s3_q < {_ALPHA}) AS replicated, count(*) FILTER (NOT s2_pass) AS controls, count(*) FILTER (NOT s2_pass AND s3_q < {_ALPHA}) AS controls_replicated FROM w GROUP BY GROUPING SETS ((family), (family, band))")
def source_family_summary(spark, sf_dir):
    """Stages of each family by band and over all, with the negative controls."""
    box = stations(spark, sf_dir).withColumn("region", spatial.bins(F.col("lat"), F.col("lon"), 66)).groupBy("region").agg(F.avg("lat").alias("lat"))
    t = family_tests(spark, sf_dir).join(box.hint("shuffle_merge"), "region").withColumn("band", F.explode(F.array(spatial.band(F.col("lat")), F.lit("all"))))
    ok, last = F.col("s2_pass"), F.col("s3_q") < _ALPHA
    return t.groupBy("family", "band").agg(
        F.count("*").alias("tested"), F.count_if("s1_pass").alias("screened"), F.count_if("s2_pass").alias("confirmed"), F.count_if(ok & (F.col("s2_effect") > 0)).alias("confirmed_positive"),
        F.count_if(ok & last).alias("replicated"), F.count_if(~ok).alias("controls"), F.count_if(~ok & last).alias("controls_replicated"),
    )


# ---- vectors turned to their edge
_HELD = 0.72
_PK = "source, target, lag"
_BEARING = "atan2(sin(radians(b.lon - a.lon)) * cos(radians(b.lat)), cos(radians(a.lat)) * sin(radians(b.lat)) - sin(radians(a.lat)) * cos(radians(b.lat)) * cos(radians(b.lon - a.lon)))"


def _projection_sql() -> str:
    full, less = ["one", "c1", "c2", "c3", "x", "p", "y"], ["one", "c1", "c2", "c3", "x", "y"]
    dot = lambda fit, cols: " + ".join(f"{c} * {fit}.m[{(i + 1) * len(cols)}]" for i, c in enumerate(cols[:-1]))
    return ctes("neighbours", "station_climate").replace("WITH ", "WITH RECURSIVE ", 1) + f""",
 cu AS (SELECT a + floor((b - a) * {_TRAINED}::DOUBLE)::BIGINT AS train, a + floor((b - a) * {_HELD}::DOUBLE)::BIGINT AS held FROM (SELECT min(t) AS a, max(t) + 1 AS b FROM sc)),
 pr AS (SELECT s AS source, g AS target, {_BEARING} AS bearing FROM cand2 JOIN cells a ON a.node = s JOIN cells b ON b.node = g WHERE s <> g),
 pj AS (SELECT source, target, e.t, e.v * sin(bearing) + n.v * cos(bearing) AS p FROM pr JOIN sc e ON e.node = source AND e.variable = 'wind' JOIN sc n ON n.node = source AND n.variable = 'temperature' AND n.t = e.t),
 pm AS (SELECT source, target, t, p - coalesce(avg(p) FILTER (t < train) OVER (PARTITION BY source, target, t % 52), 0) AS p, t < train AS past FROM pj, cu),
 ps AS MATERIALIZED (SELECT source, target, t, (p - avg(p) FILTER (past) OVER w) / CASE WHEN stddev_pop(p) FILTER (past) OVER w > 1e-8 THEN stddev_pop(p) FILTER (past) OVER w ELSE 1 END AS p FROM pm WINDOW w AS (PARTITION BY source, target)),
 yo AS MATERIALIZED (SELECT t, node, v AS y, lag(v, 1) OVER w AS c1, lag(v, 2) OVER w AS c2, lag(v, 3) OVER w AS c3 FROM sc WHERE variable = 'humidity' WINDOW w AS (PARTITION BY node ORDER BY t)),
 ro AS MATERIALIZED (SELECT ps.source, ps.target, lag::BIGINT AS lag, yo.t, 1.0::DOUBLE AS one, c1, c2, c3, x.v AS x, p, y FROM ps CROSS JOIN range(1, 4) l(lag) JOIN yo ON yo.node = ps.target AND yo.t = ps.t + lag JOIN sc x ON x.node = ps.source AND x.variable = 'wind' AND x.t = ps.t WHERE c3 IS NOT NULL),
 tr AS MATERIALIZED (SELECT ro.* FROM ro, cu WHERE t < train), he AS MATERIALIZED (SELECT ro.* FROM ro, cu WHERE t >= held),
 {gram_sql("gh", "he", full, _PK)}, {sweep_sql("fh", "gh", 7, 6, _PK)}, {influence_sql("iv", "he", "fh", full, _PK)}, {_hac_sql("hv", "iv", _PK)}, {gram_sql("gt", "tr", full, _PK)}, {sweep_sql("ft", "gt", 7, 6, _PK)}, {gram_sql("gr", "tr", less, _PK)}, {sweep_sql("fr", "gr", 6, 5, _PK)},
 gl AS (SELECT {_PK}, t, pow(y - ({dot("fr", less)}), 2) - pow(y - ({dot("ft", full)}), 2) AS g FROM he JOIN fr USING ({_PK}) JOIN ft USING ({_PK})), gc AS (SELECT *, g - avg(g) OVER (PARTITION BY {_PK}) AS v FROM gl), {_hac_sql("hg", "gc", _PK)},
 ga AS (SELECT {_PK}, count(*) AS n_held, avg(g) AS gain FROM gl GROUP BY ALL), al AS (SELECT {_PK}, any_value(n) AS n, any_value(beta) AS beta FROM iv GROUP BY ALL),
 vr AS MATERIALIZED (SELECT {_PK}, n, beta, sqrt(hv.var) AS se_hac, n_held, gain, sqrt(hg.var * n_held / (n_held - 1.0)) / n_held AS gain_se, round({normal_tail_sql("(beta / sqrt(hv.var))")}, 9) AS p FROM al JOIN hv USING ({_PK}) JOIN ga USING ({_PK}) JOIN hg USING ({_PK}))"""


def projections(spark, sf_dir) -> DataFrame:
    """Tests of the sources' vectors (wind to the east, temperature to the north) along the edges between neighbours. Stored once."""

    def make():
        st = stations(spark, sf_dir)
        near = spatial.nearest(st, 2).select("source", "target")
        both = near.union(near.select("target", "source")).distinct()
        at = lambda a: st.select(F.col("node").alias(a), F.col("lat").alias(a + "_lat"), F.col("lon").alias(a + "_lon"))
        p = both.join(at("source").hint("shuffle_merge"), "source").join(at("target").hint("shuffle_merge"), "target")
        la, lb, d = F.radians("source_lat"), F.radians("target_lat"), F.radians(F.col("target_lon") - F.col("source_lon"))
        p = p.select("source", "target", F.atan2(F.sin(d) * F.cos(lb), F.cos(la) * F.sin(lb) - F.sin(la) * F.cos(lb) * F.cos(d)).alias("bearing"))
        train, held = calendar_shares(station_series(spark, sf_dir), _TRAINED, _HELD)
        r = joint.projection_tests(p, bundled(spark, sf_dir), "node", "wind", "temperature", "humidity", "wind", train, held)
        return r.withColumn("p_value", F.round(p_z(F.col("beta") / F.col("se_hac")), 9))

    return stored(spark, "projections", sources(sf_dir, "lineitem", "supplier"), make, trained=_TRAINED, held=_HELD)


@query(_projection_sql() + f" SELECT {_PK}, n, round(beta, 7) AS beta, round(se_hac, 7) AS se_hac, p AS p_value, n_held, round(gain, 8) AS gain, round(gain_se, 8) AS gain_se FROM vr")
def projected_vectors(spark, sf_dir):
    """Each source's vector turned by the bearing of its edge, tested in the target's humidity beside its history and the source's wind."""
    return projections(spark, sf_dir).select("source", "target", "lag", "n", F.round("beta", 7).alias("beta"), F.round("se_hac", 7).alias("se_hac"), "p_value", "n_held", F.round("gain", 8).alias("gain"), F.round("gain_se", 8).alias("gain_se"))


@query(_projection_sql() + f", {_q_sql('vq', 'vr', '1', 'p', 'q')} SELECT lag, count(*) AS hypotheses, round(quantile_cont(gain, 0.5), 8) AS median_gain, count(*) FILTER (gain > 0) AS positive_gain, count(*) FILTER (q < 0.05) AS found FROM vq GROUP BY 1")
def projected_vector_summary(spark, sf_dir):
    """By lag: how many projections gain on later years and how many are found, q over all."""
    q = bh_large(projections(spark, sf_dir), None, q="q")
    return q.groupBy("lag").agg(F.count("*").alias("hypotheses"), F.round(F.percentile("gain", 0.5), 8).alias("median_gain"), F.count_if(F.col("gain") > 0).alias("positive_gain"), F.count_if(F.col("q") < 0.05).alias("found"))
