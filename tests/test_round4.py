"""Queries made from whole series of the stations instead of their dense rows."""

import datetime

import duckdb
import numpy as np
import pytest

from lagloom import registry
from lagloom.operators import panels, screen


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Forty stations over two years and a bit with gaps: one of constant wind, one without any rows, one not in supplier, rows without a supplier."""
    d, rng = tmp_path_factory.mktemp("odd"), np.random.default_rng(4)
    rows = []
    for k in [*range(39), 50, None]:
        for day in rng.choice(780, 150, replace=False).tolist():
            value = [10.0 if k == 7 else float(rng.integers(1, 50)), float(rng.integers(0, 11)) / 100, float(rng.integers(0, 9)) / 100, float(np.round(rng.uniform(900, 90000), 2))]
            rows.append((k, datetime.datetime(1995, 3, 1) + datetime.timedelta(days=day), *value))
    c = duckdb.connect()
    c.execute("CREATE TABLE li (l_suppkey BIGINT, l_shipdate TIMESTAMP, l_quantity DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_extendedprice DOUBLE)")
    c.executemany("INSERT INTO li VALUES (?, ?, ?, ?, ?, ?)", rows)
    c.execute(f"COPY li TO '{d}/lineitem.parquet' (FORMAT parquet)")
    c.execute(f"COPY (SELECT i::BIGINT AS s_suppkey FROM range(40) r(i)) TO '{d}/supplier.parquet' (FORMAT parquet)")
    return str(d)


def _same(spark, sf_dir, name):
    """Rows of a query, the same as those of its SQL; NaN equals NaN."""
    c = duckdb.connect()
    for t in ("lineitem", "supplier"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rel = c.execute(registry.oracle_sql()[name])
    df = registry.queries()[name](spark, sf_dir)
    assert df.columns == [x[0] for x in rel.description]
    norm = lambda r: tuple(f"{v:.6g}" if isinstance(v, float) and v else str(v) if v else "0" if v is not None else "null" for v in r)
    got = df.collect()
    assert sorted(map(norm, got)) == sorted(map(norm, rel.fetchall()))
    return got


def test_histories_shuffle_nothing(spark, odd):
    """The design is read off the series of a node: a value is not sent to the twelve rows that hold it."""
    assert "Exchange" not in _plan(registry.queries()["history_design"](spark, odd))
    got = _same(spark, odd, "history_design")
    nodes = {r.node for r in got}
    assert {None, 7, 50} <= nodes and 39 not in nodes
    assert len(got) == len(nodes) * (max(r.t for r in got) - min(r.t for r in got) + 1)


@pytest.mark.parametrize("size", [4, 3, 2])
def test_histories_of_short_series(spark, size):
    """Each window of three steps of two variables, latest first; series shorter than that have none."""
    rng = np.random.default_rng(size)
    data = {n: (rng.normal(size=size), rng.normal(size=size)) for n in range(600)}
    b = spark.createDataFrame([(n, 5, a.tolist(), b.tolist()) for n, (a, b) in data.items()], "node long, first long, b array<double>, a array<double>").coalesce(1)
    got = {(r.node, r.t): tuple(r)[2:] for r in panels.histories(b, 3).collect()}
    assert len(got) == 600 * max(0, size - 2)
    for (n, t), (columns, total, first, last) in got.items():
        b, a = (v[t - 5 - 2 : t - 5 + 1] for v in data[n])
        assert columns == 6 and (first, last) == (a[2], b[0]) and abs(total - a.sum() - b.sum()) < 1e-12


def test_screened_series_reach_a_target_once(spark, odd):
    """No row for each step of a pair: a source's series come to a target whole. Constant series have no correlation; they rank first, as in SQL."""
    plan = _plan(registry.queries()["correlation_screen"](spark, odd))
    assert "station-climate" not in plan and "MapInArrow" in plan
    got = _same(spark, odd, "correlation_screen")
    assert {r.source for r in got} <= set(range(39)) and any(r.source == 7 and np.isnan(r.c) for r in got)


def test_correlations_equal_numpy(spark):
    """Series that start apart, one constant, one too short, one missing; more sources than a row takes."""
    rng = np.random.default_rng(6)
    begin = lambda n: 4 if n % 3 == 0 else 0
    data = {n: rng.normal(size=30 - begin(n)) for n in range(80)}
    data[5] = np.full(30, 0.1)
    data[6] = data[6][:1]
    given = spark.createDataFrame([(n, "u", begin(n), v.tolist()) for n, v in data.items()], "node long, variable string, first long, values array<double>")
    cand = [(s, g) for s in range(81) for g in (0, 1, 5, 81) if s != g]
    cand = spark.createDataFrame([(s, g, "u", "u") for s, g in cand], "source_region long, target_region long, source_var string, target_var string")
    got = {(r.source_region, r.target_region): r.c for r in screen.correlations(cand, given, 2).collect()}
    assert got.keys() == {(s, g) for s in data for g in (0, 1, 5) if s not in (g, 6)}
    for (s, g), c in got.items():
        at = max(begin(s), begin(g))
        x, y = data[s][at - begin(s) :][:-2], data[g][at - begin(g) :][2:]
        assert np.isnan(c) if 5 in (s, g) else abs(c - np.corrcoef(x, y)[0, 1]) < 1e-12


def test_matched_refits_send_no_series(spark, odd):
    """Steps are drawn in the task that holds a node's series; what is shuffled is partial means and one row a node. Constant wind has no slope."""
    plan = _plan(registry.queries()["matched_size_refit"](spark, odd))
    assert "Window" not in plan and "Generate" not in plan
    got = {r.node: r for r in _same(spark, odd, "matched_size_refit")}
    assert got.keys() == set(range(39)) and np.isnan(got[7].observed) and got[7].p == 1


@pytest.mark.parametrize("marked", [3, 14, 25])
def test_matched_refits_equal_plain_draws(spark, marked):
    """As many other steps as marked ones: some of them, nearly all, and each of them several times; negative steps keep their sign."""
    rng, size, first = np.random.default_rng(marked), 30, -12
    high = np.zeros(size, bool)
    high[rng.permutation(np.arange(1, size))[:marked]] = True
    data = {n: (rng.normal(size=size), rng.normal(size=size)) for n in range(3)}
    b = spark.createDataFrame([(n, first, high.tolist(), y.tolist(), z.tolist()) for n, (y, z) in data.items()], "node long, first long, high array<boolean>, y array<double>, z array<double>")
    for r in screen.matched_refits(b, "z", "y").collect():
        y, z = data[r.node][0][1:], data[r.node][1][:-1]
        slope = lambda at: np.polyfit(z[at], y[at], 1)[0]  # noqa: B023, E731
        draws, low = [], [i for i in range(size - 1) if not high[i + 1]]
        for k in range(1, 21):
            order = sorted(low, key=lambda i: (int(np.fmod((first + 1 + i) * 7349 + k * 4591, 10007)), i))
            draws.append(slope([order[i % len(order)] for i in range(marked)]))
        seen, mean = slope(np.flatnonzero(high[1:])), np.mean(draws)
        p = min(1, (1 + sum(abs(x - mean) >= abs(seen - mean) for x in draws)) / 21)
        assert np.allclose([r.observed, r.mean, r.p], [seen, mean, p], atol=1e-9)
