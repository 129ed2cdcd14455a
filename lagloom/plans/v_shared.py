"""Fits that all sources of a target share: common controls on common steps, frozen sources with a refit on the later years."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagloom.functions.tails import p_z
from lagloom.operators import screen, spatial
from lagloom.plans import section
from lagloom.plans.o_contrasts import _hac_sql
from lagloom.sources.fixtures import EDGE_TYPES, ctes, normal_tail_sql, station_candidates, station_series, stations
from lagloom.sources.sqltext import gram_sql, influence_sql, sweep_sql, t_tail_sql

QUERIES, query = section()
_KEY = ["source_region", "target_region", "source_var", "target_var"]
_K = ", ".join(_KEY)
_BLOCK = 13  # steps of a calendar block
_OWN = ("humidity", "humidity")


def _with_own_variable(spark, sf_dir) -> DataFrame:
    """The station candidates and, for every pair of regions, humidity in humidity: where both are one region the source is a control of its own target."""
    st = stations(spark, sf_dir)
    near = spatial.nearest(st, 2).select("source", "target")
    pairs = near.union(near.select("target", "source")).union(st.select("node", "node")).distinct().toDF("source_region", "target_region")
    return station_candidates(spark, sf_dir).unionByName(pairs.withColumns({"source_var": F.lit(_OWN[0]), "target_var": F.lit(_OWN[1])}))


def _common_sql() -> str:
    keys = f"{_K}, lag, regime"
    season = "CASE WHEN t % 52 < 26 THEN 'winter' ELSE 'summer' END AS regime"
    pairs = ", ".join(f"('{a}', '{b}')" for a, b in (*EDGE_TYPES, _OWN))
    # the two controls that stay beside an own lag of the target, by lag
    rest = "CASE lag WHEN 1 THEN c2 ELSE c1 END AS ca, CASE lag WHEN 3 THEN c2 ELSE c3 END AS cb"
    wide, small = ["one", "c1", "c2", "c3", "z", "y"], ["one", "ca", "cb", "z", "y"]

    return ctes("neighbours", "station_climate").replace("WITH ", "WITH RECURSIVE ", 1) + f""",
ct AS MATERIALIZED (SELECT s AS source_region, g AS target_region, sv AS source_var, tv AS target_var FROM cand2 CROSS JOIN (VALUES {pairs}) e(sv, tv)),
yo AS MATERIALIZED (SELECT t, node, variable, v AS y, lag(v, 1) OVER w AS c1, lag(v, 2) OVER w AS c2, lag(v, 3) OVER w AS c3 FROM sc WINDOW w AS (PARTITION BY node, variable ORDER BY t)),
xl AS MATERIALIZED (SELECT node, variable, t + k AS t, k::BIGINT AS lag, v AS z FROM sc, range(1, 4) x(k)),
td AS MATERIALIZED (SELECT {_K}, lag, y.t, {season.replace("t %", "y.t %")}, 1.0::DOUBLE AS one, c1, c2, c3, {rest}, z, y, source_region = target_region AND source_var = target_var AS own FROM ct JOIN yo y ON y.node = target_region AND y.variable = target_var JOIN xl x ON x.node = source_region AND x.variable = source_var AND x.t = y.t WHERE c3 IS NOT NULL),
ta AS (SELECT * FROM td WHERE NOT own), tb AS (SELECT * FROM td WHERE own),
{gram_sql("ga", "ta", wide, keys)}, {sweep_sql("fa", "ga", 6, 5, keys)}, {gram_sql("gb", "tb", small, keys)}, {sweep_sql("fb", "gb", 5, 4, keys)},
{influence_sql("ia", "ta", "fa", wide, keys, ", 3 AS n_controls")}, {influence_sql("ib", "tb", "fb", small, keys, ", 2 AS n_controls")}, iv AS MATERIALIZED (SELECT * FROM ia UNION ALL SELECT * FROM ib),
{_hac_sql("h4", "iv", keys)}, {_hac_sql("h8", "iv", keys, bandwidth="8")},
cb AS (SELECT {keys}, count(*) AS g, sum(s * s) AS meat FROM (SELECT {keys}, floor(t / {_BLOCK}.0) AS b, sum(v) AS s FROM iv GROUP BY ALL) GROUP BY ALL),
one AS (SELECT {keys}, any_value(n) AS n, any_value(n_controls) AS n_controls, any_value(beta) AS beta, any_value(se_ols) AS se_ols FROM iv GROUP BY ALL),
al AS (SELECT *, sqrt(h4.var) AS se4, sqrt(h8.var) AS se8, sqrt(meat * g / (g - 1.0) * (n - 1.0) / n) AS sec FROM one JOIN h4 USING ({keys}) JOIN h8 USING ({keys}) JOIN cb USING ({keys}))"""


@query(_common_sql() + f" SELECT {_K}, lag, regime, n, n_controls::BIGINT AS n_controls, round(beta, 7) AS effect, round(se_ols, 7) AS se_ols, round(se4, 7) AS se_hac4, round({normal_tail_sql('(beta / se4)')}, 7) AS p_hac4, round(se8, 7) AS se_hac8, round(sec, 7) AS se_cluster, round({t_tail_sql('(beta / sec)', '(g - 1)')}, 7) AS p_cluster FROM al")
def shared_target_fits(spark, sf_dir):
    """Every candidate and lag beside three own lags of its target, on the same steps: one fit of the controls per target and season; OLS, two HAC bandwidths, calendar blocks."""
    r = screen.common_controls(_with_own_variable(spark, sf_dir), station_series(spark, sf_dir), bandwidths=(4, 8), blocks=(_BLOCK,)).filter("effect is not null")
    return r.select(
        *_KEY, "lag", "regime", "n", "n_controls", *[F.round(c, 7).alias(a) for c, a in (("effect", "effect"), ("se_ols", "se_ols"), ("se_hac4", "se_hac4"), ("p_hac4", "p_hac4"), ("se_hac8", "se_hac8"), (f"se_cluster{_BLOCK}", "se_cluster"), (f"p_cluster{_BLOCK}", "p_cluster"))]
    )


def calendar_shares(series: DataFrame, *shares: float) -> list[int]:
    """Steps that stand at the given shares of the calendar of ``series``."""
    r = series.agg(F.min("first").alias("a"), F.max(F.col("first") + F.size("values")).alias("b")).first()
    return [r.a + int((r.b - r.a) * s) for s in shares]


_TRAIN, _HELD = 0.70, 0.72  # shares of the calendar: training ends, judging begins
_CUTS = f"cu AS (SELECT a + floor((b - a) * {_TRAIN}::DOUBLE)::BIGINT AS train, a + floor((b - a) * {_HELD}::DOUBLE)::BIGINT AS held FROM (SELECT min(t) AS a, max(t) + 1 AS b FROM sc))"


def _frozen_sql() -> str:
    cols, less, keys = ["one", "c1", "z", "y"], ["one", "c1", "y"], _K

    def fit(tag: str, rows: str) -> str:
        full = f"{gram_sql('g' + tag, rows, cols, keys)}, {sweep_sql('f' + tag, 'g' + tag, 4, 3, keys)}"
        iv = f"i{tag} AS (SELECT {keys}, t, n, m[12] AS beta, -(one * m[9] + c1 * m[10] + z * m[11]) * (y - (one * m[4] + c1 * m[8] + z * m[12])) * sqrt(n / (n - 3.0)) AS v FROM {rows} JOIN f{tag} USING ({keys})), {_hac_sql('h' + tag, 'i' + tag, keys)}"
        return full + ", " + iv

    return ctes("tests").replace("WITH ", "WITH RECURSIVE ", 1) + f""", {_CUTS},
rows1 AS MATERIALIZED (SELECT {keys}, t, 1.0::DOUBLE AS one, c AS c1, z, y FROM td WHERE lag = 1), tr AS MATERIALIZED (SELECT rows1.* FROM rows1, cu WHERE t < train), hd AS MATERIALIZED (SELECT rows1.* FROM rows1, cu WHERE t >= held),
{fit("t", "tr")}, {fit("e", "hd")}, {gram_sql("gr", "tr", less, keys)}, {sweep_sql("fr", "gr", 3, 2, keys)},
ls AS (SELECT {keys}, t, y - (one * fr.m[3] + c1 * fr.m[6]) AS er, y - (one * ft.m[4] + c1 * ft.m[8] + z * ft.m[12]) AS ef FROM hd JOIN fr USING ({keys}) JOIN ft USING ({keys})),
gl AS (SELECT *, er * er - ef * ef - avg(er * er - ef * ef) OVER (PARTITION BY {keys}) AS v FROM ls), {_hac_sql("hg", "gl", keys)},
ag AS (SELECT {keys}, count(*) AS n, avg(er * er) AS mse_restricted, avg(ef * ef) AS mse_full, avg(er * er - ef * ef) AS gain FROM ls GROUP BY ALL)
SELECT {keys}, ft.n AS n_train, ag.n, round(ft.m[12], 7) AS effect, round(sqrt(ht.var), 7) AS se_hac, round(fe.m[12], 7) AS refit_effect, round(sqrt(he.var), 7) AS refit_se_hac, round({normal_tail_sql("(fe.m[12] / sqrt(he.var))")}, 7) AS refit_p, round(mse_restricted, 8) AS mse_restricted, round(mse_full, 8) AS mse_full, round(gain, 8) AS gain, round(sqrt(hg.var * ag.n / (ag.n - 1.0)) / ag.n, 8) AS gain_se
FROM ag JOIN ft USING ({keys}) JOIN fe USING ({keys}) JOIN ht USING ({keys}) JOIN he USING ({keys}) JOIN hg USING ({keys})"""


@query(_frozen_sql())
def frozen_source_refits(spark, sf_dir):
    """Each source frozen at the training years and judged on the later ones, beside the same fit made anew on the later years."""
    s = station_series(spark, sf_dir)
    train, held = calendar_shares(s, _TRAIN, _HELD)
    r = screen.frozen_sources(station_candidates(spark, sf_dir), s, train, held).filter("effect is not null")
    p = F.round(p_z(F.col("refit_effect") / F.col("refit_se_hac")), 7).alias("refit_p")
    return r.select(*_KEY, "n_train", "n", *[F.round(c, 7).alias(c) for c in ("effect", "se_hac", "refit_effect", "refit_se_hac")], p, *[F.round(c, 8).alias(c) for c in ("mse_restricted", "mse_full", "gain", "gain_se")])
