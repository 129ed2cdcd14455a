"""What the lag tests of the stations send through shuffles."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagloom.functions import tails
from lagloom.operators import fdr, panels, reports, rewire, screen
from lagloom.plans import h_reports, t_links, u_tables
from lagloom.sources import fixtures


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_series_reach_a_region_once(spark):
    """Two nodes, two variables tested on two: a source's series come once each, the region's own are not sent to it."""
    rng = np.random.default_rng(1)
    rows = [(t, n, v, float(rng.normal())) for n in (0, 1) for v in ("u", "v", "w") for t in range(60)]
    given = screen.series(spark.createDataFrame(rows, "t long, node long, variable string, value double"))
    cand = [(s, 0, a, b) for s in (0, 1) for a in ("u", "v") for b in ("v", "w")]
    cand = spark.createDataFrame([*cand, (9, 0, "u", "v"), (1, 0, "x", "v"), (0, 9, "u", "v")], "source_region long, target_region long, source_var string, target_var string")
    r = screen._by_target(cand, given).collect()
    assert len(r) == 1 and {v.variable for v in r[0].own} == {"u", "v", "w"}
    sent = {s.source_region: s.series for s in r[0].sources}
    assert sent[0] is None and sorted(v.variable for v in sent[1]) == ["u", "v"]
    tests = screen.screen(cand, given, lags=2).collect()  # candidates without a series have no rows
    assert len(tests) == 8 * 2 * 2 and all((t.effect is None) == (t.source_region == t.target_region and t.source_var == t.target_var and t.lag == 1) for t in tests)


def test_many_targets_at_once_equal_tests_one_by_one(spark):
    """Series on several calendars, constant ones and regions of many sources, against the tests of one target."""
    rng = np.random.default_rng(2)
    begin = lambda n: 7 if n % 5 == 0 else 40 if n == 3 else 0
    data = {(n, v): rng.normal(size=120 - begin(n)).cumsum() * 0.2 for n in range(90) for v in "ab"}
    data[4, "a"] = np.zeros(120)
    rows = [(begin(n) + t, n, v, float(x)) for (n, v), s in data.items() for t, x in enumerate(s)]
    given = screen.series(spark.createDataFrame(rows, "t long, node long, variable string, value double"))
    cand = [(s, 1, "a", "b") for s in range(90)] + [(n, (n * 7) % 90, a, b) for n in range(90) for a in "ab" for b in "ab"]
    cand = spark.createDataFrame(cand, "source_region long, target_region long, source_var string, target_var string").distinct()
    got = screen.screen(cand, given, own=2).collect()
    assert len(got) == cand.count() * 6 and sum(r.effect is None for r in got) < len(got) / 10
    for r in got:
        first = max(begin(r.source_region), begin(r.target_region))
        y, x = data[r.target_region, r.target_var][first - begin(r.target_region) :], data[r.source_region, r.source_var][first - begin(r.source_region) :]
        p, a, b = screen.SEASONS[r.regime]
        t = screen.lag_design(y, x[:, None], first, r.lag, lambda s, a=a, b=b, p=p: (s % p >= a) & (s % p < b), 2)
        if t is None or not t.valid[0]:
            assert r.effect is None and r.n is None and r.p_value is None
            continue
        se = t.se_hac(4)
        assert r.n == t.n and np.allclose([r.effect, r.se_ols, r.se_hac, r.p_value, r.partial_r2], [t.beta[0], t.se_ols[0], se[0], screen.normal_p(t.beta, se)[0], t.partial_r2[0]], rtol=1e-9, atol=1e-12)


def test_rows_of_the_station_panel_are_shuffled_once(spark, sf_dir):
    wide, span = fixtures._station_panel(spark, sf_dir), fixtures.weeks(spark, sf_dir)
    b = panels.climate(wide, list(fixtures.VARIABLES), span, dealt=True)
    assert len(re.findall(r"Exchange hashpartitioning", _plan(b))) == 1
    again = panels.climate(wide, list(fixtures.VARIABLES), span)
    key = lambda df: sorted((r.node, r.first, tuple(np.round(r.wind, 9) + 0.0), tuple(np.round(r.humidity, 9) + 0.0)) for r in df.collect())
    assert key(b) == key(again)


def test_windows_of_a_small_family_share_a_shuffle(spark):
    df = spark.createDataFrame([(1, 0.1), (1, None), (2, 0.3)], "g long, p_value double")
    assert len(re.findall(r"Exchange hashpartitioning", _plan(fdr.bh(df, ["g"])))) == 1


def test_tails_of_many_t_values():
    t, df = np.array([0.0, 1.3, -2.0, 40.0, np.inf, np.nan, 2.0, 2.0, 1.5]), np.array([5.0, 5, 176, 176, 9, 9, 2.5, np.nan, 3000])
    got = tails.t_tails(t, df)
    want = [np.nan if x != x or d != d else tails.t_tail(x, d) for x, d in zip(t.tolist(), df.tolist(), strict=True)]
    assert np.allclose(got, want, rtol=0, atol=1e-12, equal_nan=True)


def test_link_scores_makes_its_p_values_once(spark, sf_dir):
    assert "ArrowEvalPython" not in _plan(u_tables.link_scores(spark, sf_dir))  # they are stored before the ranks read them


def test_graphs_are_compared_in_one_join(spark):
    """A graph and one with an edge moved: edges, nodes at each end, nodes whose degree and strata whose count changed."""
    schema = "rep long, type string, a long, b long, s long"
    first = spark.createDataFrame([(0, "x", 1, 2, 0), (0, "x", 2, 3, 1), (0, "x", 1, 4, 1)], schema)
    now = spark.createDataFrame([(0, "x", 1, 2, 0), (0, "x", 2, 3, 1), (0, "x", 5, 2, 2)], schema)
    r = rewire.kept(now, rewire.end_counts(first, "x")).collect()
    assert [tuple(x) for x in r] == [(0, "x", 3, 3, 2, 4, 2)]


def test_edges_of_a_type_are_dealt_to_all_tasks(spark):
    """One graph of one type: no task takes all its edges, its groups are as many as its edges allow, and grouping does not shuffle again."""
    g = spark.range(0, 4000, 1, 4).selectExpr("id % 1 AS rep", "concat('x', id % 1) AS type", "id AS a", "id * 7 % 4000 AS b", "0D AS ya", "0D AS xa", "0D AS yb", "0D AS xb", "0L AS s")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for kernel, groups in (("global", 2000), ("near", 2000), ("cycle", 1334)):
            d = rewire.dealt(g, kernel, 0, 1)
            assert d.select(F.spark_partition_id().alias("p")).groupBy("p").count().agg(F.max("count")).first()[0] < 2000
            moves = d.groupBy("rep", "type", "part", "i").agg(F.collect_list("a"))
            assert len(re.findall("Exchange hashpartitioning", _plan(moves))) == 2  # of the sizes and of the edges
            assert d.count() == 4000 and {r.groups for r in d.select("groups").distinct().collect()} == {groups}
            assert "SortMergeJoin" not in _plan(d)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def seasons(spark):
    """Edges of two types; some lack a season, many share their p."""
    rng, rows = np.random.default_rng(5), []
    for i in range(240):
        s, t = i % 12, i // 12
        for regime in ("winter", "summer"):
            for lag in (1, 2):
                if rng.random() < 0.85:
                    rows.append((s, t, "u", "v" if i % 3 else "w", lag, regime, float(np.round(rng.random() ** 2, 2)), float(np.round(rng.normal(), 2)), "u->v" if i % 3 else "u->w"))
    return rows, spark.createDataFrame(rows, "source_region long, target_region long, source_var string, target_var string, lag long, regime string, p_value double, effect double, edge_type string").repartition(5)


def _q(p: list[float]) -> list[float]:
    order, q, low = np.argsort(p), np.empty(len(p)), 1.0
    for r in range(len(p), 0, -1):
        q[order[r - 1]] = low = min(low, p[order[r - 1]] * len(p) / r)
    return q.tolist()


def _pairs(rows):
    held = {r: {x[:5]: x for x in rows if x[5] == r} for r in ("winter", "summer")}
    return [(held["winter"][k], held["summer"][k]) for k in held["winter"] if k in held["summer"]]


def test_both_seasons_meet_in_one_shuffle(seasons):
    rows, e = seasons
    b = reports.both_seasons(e)
    assert _plan(b).count("Exchange hashpartitioning") == 1
    got = {tuple(r)[:5]: (r.p1, r.e1, r.p2, r.e2, r.edge_type) for r in b.collect()}
    want = {}
    for x in rows:
        at = want.setdefault(x[:5], [None] * 4 + [x[8]])
        at[0 if x[5] == "winter" else 2], at[1 if x[5] == "winter" else 3] = x[6], x[7]
    assert got == {k: tuple(v) for k, v in want.items()}


def test_a_row_may_stand_for_several_tests(spark):
    p = [0.2, 0.01, 0.2, 0.03, 0.01, 0.5]
    c = spark.createDataFrame([("x", v, p.count(v)) for v in set(p)] + [("y", 0.3, 2)], "g string, p_value double, c long")
    got = {(r.g, r.p_value): r.q_value for r in fdr.bh_large(c, ["g"], count="c").collect()}
    want = {("x", v): q for v, q in zip(p, _q(p), strict=True)} | {("y", 0.3): 0.3}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-12 for k, v in want.items())


def test_confirmation_sends_counts_to_q(seasons):
    """The keys are gone before q is made; q of summer counts tests that winter lacks."""
    rows, e = seasons
    summer = [x for x in rows if x[5] == "summer"]
    q = {x[:5]: v for x, v in zip(summer, _q([x[6] for x in summer]), strict=True)}
    got = t_links.confirmed(e)
    assert "source_region" not in _plan(got)
    want = {}
    for w, s in _pairs(rows):
        want.setdefault(w[8], []).append((w[6] < 0.2 and s[6] < 0.2 and np.sign(w[7]) == np.sign(s[7]), s[6], q[s[:5]]))
    got = {r.edge_type: (r.tested, r.confirmed_ratio, r.mean_p, r.mean_q) for r in got.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[t], (len(v), *np.mean(v, axis=0)), atol=1e-8) for t, v in want.items())


def test_stages_send_counts_to_q_and_to_the_median(seasons):
    rows, e = seasons
    pairs = [(w[8], w[6] < 0.4, s[6] / 2 if np.sign(w[7]) == np.sign(s[7]) else 1 - s[6] / 2, abs(w[7])) for w, s in _pairs(rows)]
    q = {}
    for on in (True, False):
        some = [p for _, s, p, _ in pairs if s == on]
        q |= {(on, p): v for p, v in zip(some, _q(some), strict=True)}
    got = h_reports.staged(e)
    assert "source_region" not in _plan(got)
    got = {r.edge_type: tuple(r)[1:] for r in got.collect()}
    for t in ("u->v", "u->w", "ALL"):
        v = [x for x in pairs if t in (x[0], "ALL")]
        want = [len(v), sum(x[1] for x in v), sum(x[1] and q[x[1:3]] < 0.9 for x in v), sum(not x[1] and q[x[1:3]] < 0.9 for x in v), np.median([x[3] for x in v])]
        assert np.allclose(got[t], want, atol=1e-8)


def test_subset_is_gathered_without_a_join(seasons):
    """Edges of two regions meet by one shuffle at every size, so the megabytes don't jump where a broadcast would end."""
    rows, e = seasons
    linked = {x[:2] for x in rows if x[4] == 1 and x[5] == "winter" and x[6] < 0.1}
    got = h_reports.recalibrated(e)
    assert "LeftSemi" not in _plan(got)
    got = {(r.regime, *tuple(r)[1:6]): r.q_value for r in got.collect()}
    want = {}
    for regime in ("winter", "summer"):
        some = [x for x in rows if x[5] == regime and x[:2] in linked]
        want |= {(regime, *x[:5]): v for x, v in zip(some, _q([x[6] for x in some]), strict=True)}
    assert 0 < len(want) < len(rows) and got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())
