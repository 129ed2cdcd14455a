"""Operators of this round against plain numpy: dense models, screens, joint windows, neighbours, families, rewiring, placebo."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagloom.functions import tails
from lagloom.operators import dense, fdr, joint, reports, rewire, screen, spatial
from lagloom.plans import j_nulls, t_links, u_tables
from lagloom.plans.p_resampling import number
from lagloom.plans.r_reports import match_pairs
from lagloom.sources import readers


@pytest.fixture(scope="module")
def var(spark):
    rng = np.random.default_rng(3)
    x = np.zeros((400, 3))
    for t in range(1, 400):
        x[t] = 0.4 * x[t - 1] + 0.3 * x[t - 1, [1, 2, 0]] + rng.normal(size=3)
    rows = [(t, n, float(x[t, i])) for t in range(400) for i, n in enumerate("abc")]
    return x, spark.createDataFrame(rows, "t long, name string, value double")


def plain_hac(z, e, t, bandwidth):
    s = z * e
    at = dict(zip(t.tolist(), s.tolist(), strict=True))
    return sum((1 - abs(h) / (bandwidth + 1)) * v * at.get(k + h, 0.0) for k, v in at.items() for h in range(-bandwidth, bandwidth + 1))


def test_dense_model_equals_numpy(spark, var):
    x, series = var
    names = ["a", "b", "c"]
    rows = dense.design(series, names, [1, 2])
    model = dense.fit(rows, names, [1, 2])
    X = np.column_stack([np.ones(398), x[1:-1], x[:-2]])
    Y, t = x[2:], np.arange(2, 400)
    beta = np.linalg.lstsq(X, Y, rcond=None)[0]
    assert np.allclose(model.beta, beta) and model.n == 398 and model.normal_residual < 1e-10
    tests = [(model.column("b", 2), 0), (model.column("c", 1), 2)]
    got = dense.tested(rows, model, tests, 4, 16).orderBy("target").collect()
    for r, (c, o) in zip(got, tests, strict=True):
        z = X[:, c] - np.delete(X, c, 1) @ np.linalg.lstsq(np.delete(X, c, 1), X[:, c], rcond=None)[0]
        e = Y[:, o] - X @ beta[:, o]
        assert math.isclose(r.se_hac, math.sqrt(plain_hac(z, e, t, 4) * 398 / (398 - 7)) / (z @ z), rel_tol=1e-9)
        blocks = [sum((z * e)[t // 16 == b]) for b in sorted(set(t // 16))]
        k = len(blocks)
        assert r.clusters == k and math.isclose(r.se_cluster, math.sqrt(k / (k - 1) * 397 / 391 * sum(b * b for b in blocks)) / (z @ z), rel_tol=1e-9)


def test_frozen_gains_equal_refits_without_the_column(spark, var):
    x, series = var
    names = ["a", "b", "c"]
    rows = dense.design(series, names, [1])
    model = dense.fit(rows.filter("t < 250"), names, [1])
    tests = [(c, o) for c, _, _ in model.regressors() for o in range(3)]
    got = {(r.source, r.target): r for r in dense.frozen_gains(rows.filter("t >= 260"), model, tests, 4, 16).collect()}
    X, Y, t = np.column_stack([np.ones(399), x[:-1]]), x[1:], np.arange(1, 400)
    a, b = t < 250, t >= 260
    for (c, o), (_, name, _) in zip(tests, [r for r in model.regressors() for _ in range(3)], strict=True):
        full = Y[b, o] - X[b] @ np.linalg.lstsq(X[a], Y[a, o], rcond=None)[0]
        L = np.delete(X, c, 1)
        less = Y[b, o] - L[b] @ np.linalg.lstsq(L[a], Y[a, o], rcond=None)[0]
        g = less**2 - full**2
        r = got[name, names[o]]
        assert math.isclose(r.gain, g.mean(), rel_tol=1e-8, abs_tol=1e-12) and math.isclose(r.relative_gain, g.sum() / (less**2).sum(), rel_tol=1e-7, abs_tol=1e-10)
        d = g - g.mean()
        assert math.isclose(r.se, math.sqrt(plain_hac(d, np.ones(len(d)), t[b], 4) * len(d) / (len(d) - 1)) / len(d), rel_tol=1e-7)


def test_a_design_without_full_rank_is_an_error(spark, var):
    _, series = var
    twice = series.unionByName(series.filter("name = 'a'").withColumn("name", F.lit("d")))
    names = ["a", "b", "c", "d"]
    with pytest.raises(ValueError, match="rank"):
        dense.fit(dense.design(twice, names, [1]), names, [1])


def test_screen_equals_a_single_test(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 2))
    x[2:, 1] += 0.5 * x[:-2, 0]
    rows = [(t, n, "v", float(x[t, n])) for t in range(300) for n in range(2)]
    s = screen.series(spark.createDataFrame(rows, "t long, node long, variable string, value double"))
    cand = spark.createDataFrame([(0, 1, "v", "v"), (0, 7, "v", "v")], "source_region long, target_region long, source_var string, target_var string")
    got = {(r.lag, r.regime): r for r in screen.screen(cand, s).collect()}
    assert len(got) == 6  # a candidate without a series has no rows
    t = np.arange(2, 300)
    on = t % 52 < 26
    X = np.column_stack([np.ones(on.sum()), x[t[on] - 1, 1]])
    res = lambda v: v - X @ np.linalg.lstsq(X, v, rcond=None)[0]
    z, y = res(x[t[on] - 2, 0]), res(x[t[on], 1])
    b = z @ y / (z @ z)
    r = got[2, "winter"]
    assert math.isclose(r.effect, b, rel_tol=1e-9) and r.n == on.sum()
    assert math.isclose(r.se_hac, math.sqrt(plain_hac(z, y - z * b, t[on], 4) * r.n / (r.n - 3)) / (z @ z), rel_tol=1e-9)
    assert r.p_value < 1e-3 < got[1, "winter"].p_value


def test_replicates_keep_lags_and_rows():
    w = screen.block_weights(100, 16, 3)
    assert w.sum() == 100 and (screen.block_weights(10, 16, 0) == 1).all()


def test_joint_window_and_rank(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=200), np.zeros(200)
    for t in range(3, 200):
        y[t] = 0.3 * y[t - 1] + 0.5 * x[t - 2] + rng.normal()
    df = spark.createDataFrame([(1, 0, x.tolist(), y.tolist(), x.tolist())], "node long, first long, x array<double>, y array<double>, twin array<double>")
    got = joint.block_tests(df, "node", "y", [("y", 1)], [("x", k) for k in (1, 2, 3)]).collect()
    t = np.arange(3, 200)
    X = np.column_stack([np.ones(197), y[t - 1], x[t - 1], x[t - 2], x[t - 3]])
    assert np.allclose([r.beta for r in got], np.linalg.lstsq(X, y[t], rcond=None)[0][2:]) and got[0].wald > 20
    bad = joint.block_tests(df, "node", "y", [("y", 1)], [("x", 1), ("twin", 1)]).collect()
    assert all(r.beta is None for r in bad)  # a copy of a column makes the block invalid


def test_nearest_equals_all_pairs(spark):
    rng = random.Random(2)
    places = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(60)] + [(10.0, 20.0)] * 8 + [(90.0, 0.0), (-90.0, 50.0), (0.0, 179.999), (0.0, -179.999)]
    places += [(10 + rng.uniform(0, 1e-3), 20 + rng.uniform(0, 1e-3)) for _ in range(20)]
    nodes = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "node long, lat double, lon double")
    got = sorted((r.target, r["rank"], r.source) for r in spatial.nearest(nodes, 3).collect())
    want = spatial.pairs(nodes).filter("source <> target").collect()
    best = {}
    for r in want:
        best.setdefault(r.target, []).append((r.km, r.source))
    assert got == sorted((t, i + 1, s) for t, v in best.items() for i, (_, s) in enumerate(sorted(v)[:3]))
    few = spark.createDataFrame([(1, 0.0, 0.0), (2, 50.0, 100.0)], "node long, lat double, lon double")
    assert spatial.nearest(few, 3).count() == 2 and spatial.nearest(few.limit(0), 3).count() == 0


def test_one_large_family(spark):
    rng = random.Random(4)
    p = [round(rng.random() ** 3, 2) for _ in range(500)] + [None, float("nan")]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i long, p_value double")
    a = {r.i: r.q_value for r in fdr.bh_large(df).collect()}
    b = {r.i: r.q_value for r in fdr.bh(df.withColumn("f", F.lit(1)), ["f"]).collect()}
    assert a.keys() == b.keys() and all(math.isclose(a[i], b[i], rel_tol=1e-12) for i in a)


def test_rewiring_keeps_degrees_and_strata(spark):
    rng = random.Random(6)
    nodes = spark.createDataFrame([(i, rng.uniform(-60, 60), rng.uniform(-180, 180)) for i in range(40)], "node long, lat double, lon double")
    edges = {(rng.randrange(40), rng.randrange(40)) for _ in range(300)}
    g = spark.createDataFrame([(0, "w", a, b) for a, b in edges if a != b], "rep long, type string, a long, b long")
    done, log = rewire.rewire(g, nodes, ["global", "near", "cycle"])
    after, before = done.collect(), rewire.located(g, nodes).collect()
    for f in (lambda r: r.a, lambda r: r.b, lambda r: r.s):
        assert sorted(map(f, after)) == sorted(map(f, before))
    moved = sum(r.n for r in log.filter("code = 'moved'").collect())
    assert moved > 0 and {(r.a, r.b) for r in after} != {(r.a, r.b) for r in before} and all(r.a != r.b for r in after)
    assert len({(r.a, r.b) for r in after}) == len(after)


def test_placebo_stays_inside_discovery(spark):
    p = spark.createDataFrame([(t, 0, float(t)) for t in range(400)], "t long, node long, humidity double")
    ok = j_nulls.placebo(p, 250)
    assert not ok.filter("leak").count() and ok.filter("t < 52").agg(F.max("source")).first()[0] < 250
    j_nulls.without_leak(ok)
    with pytest.raises(ValueError, match="held-out"):
        j_nulls.without_leak(j_nulls.placebo(p, 250).withColumn("leak", F.col("t") == 3))


def test_tails_agree():
    for df in (1, 2, 3, 4, 11, 176):
        t = np.array([0.0, 0.3, 1.9, 4.2])
        assert np.allclose(tails.t_tail_whole(t, df), [tails.t_tail(x, df) if x else 1.0 for x in t], atol=1e-12)


def test_numbers_follow_order(spark):
    n = number(spark.createDataFrame([(v,) for v in (5, 3, 9, 1, 7)], "v long"), "v")
    assert sorted((r.v, r.i) for r in n.collect()) == [(1, 0), (3, 1), (5, 2), (7, 3), (9, 4)]


def test_matching_uses_every_pair_once(spark):
    pool = spark.createDataFrame([(a, b, 100.0 * abs(a - b)) for a in range(6) for b in range(6) if a != b], "source long, target long, km double")
    e = pool.filter("source < 3").select(F.col("source").alias("es"), F.col("target").alias("et"), F.col("km").alias("ekm")).withColumn("edge", F.struct("es", "et"))
    m = match_pairs(e, pool).collect()
    assert len({(r.source, r.target) for r in m}) == len(m) == 15 and all((r.es, r.et) != (r.source, r.target) for r in m)


def test_tables_with_other_columns_are_refused(spark):
    a = spark.createDataFrame([(1, 2.0, 3.0)], "k long, x double, y double")
    assert t_links.column_differences(a, a.withColumn("y", F.lit(4.0)), ["k"]).filter("disagreements > 0").count() == 1
    with pytest.raises(ValueError, match="columns"):
        t_links.column_differences(a, a.select("k", "y", "x"), ["k"])
    s = reports.compare_metadata(reports.flatten(a.withColumn("z", F.struct(F.lit("u").alias("v"))), "k"), reports.flatten(a, "k"))
    assert {r.path: r.status for r in s.collect()} == {"1/x": "same", "1/y": "same", "1/z.v": "missing"}


def test_flat_training_series_is_an_error(spark):
    df = spark.createDataFrame([("a", t, 1.0) for t in range(10)], "k string, t long, value double")
    with pytest.raises(ValueError, match="variance"):
        u_tables.fitted(df, ["k"], F.lit(0), F.col("t") < 5)


def test_arrays_and_aliases(spark, tmp_path):
    np.savez(tmp_path / "a.npz", t2m=np.arange(12.0).reshape(3, 2, 2), q=np.ones((3, 2, 2)))
    np.save(tmp_path / "b.npy", np.arange(6.0).reshape(3, 2))
    rows = readers.array_files(spark, str(tmp_path)).collect()
    assert len(rows) == 12 + 12 + 6 and max(r.value for r in rows if r.variable == "t2m") == 11
    assert readers.resolve(["T2M", "lat", "Valid_Time", "total_cloud_cover"]) == {"ts": "Valid_Time", "lat": "lat", "temperature": "T2M", "cloud_cover": "total_cloud_cover"}
