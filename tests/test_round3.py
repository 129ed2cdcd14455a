"""Stored tables, families of any size, shared fits of a target, matched pairs."""

import math
import os
import random
import shutil
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagloom.operators import clean, dense, fdr, lineage, ranks, screen, spatial
from lagloom.plans import k_more
from lagloom.sources import archives, fixtures, readers


def test_stored_tables_follow_every_source(spark, sf_dir, tmp_path):
    for name in ("lineitem", "supplier"):
        shutil.copy(f"{sf_dir}/{name}.parquet", tmp_path / f"{name}.parquet")
    first = fixtures.tests(spark, str(tmp_path))
    n, files = first.count(), first.inputFiles()
    assert fixtures.tests(spark, str(tmp_path)).inputFiles() == files  # kept
    few = spark.read.parquet(f"{sf_dir}/supplier.parquet").toPandas().head(4)
    few.to_parquet(tmp_path / "supplier.parquet")
    again = fixtures.tests(spark, str(tmp_path))
    assert again.count() < n and {r[0] for r in again.select("source_region").distinct().collect()} <= set(few.s_suppkey)
    assert not os.path.exists(files[0].removeprefix("file://").removeprefix("file:"))  # the superseded table is gone
    one = lineage.stored(spark, "p", [], lambda: spark.range(3), k=1)
    assert lineage.stored(spark, "p", [], lambda: spark.range(5), k=2).count() == 5 and one.count() == 3


@pytest.mark.parametrize("invalid", ["leave", "keep"])
def test_families_of_any_size(spark, invalid):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", None]), rng.randint(0, 2), rng.choice([None, float("nan"), 1.0, 0.2, round(rng.random(), 2), rng.random() ** 4])) for i in range(1500)]
    rows.append((1500, "alone", 9, None))
    df = spark.createDataFrame(rows, "i long, g string, h long, p_value double").repartition(5)
    got = {r.i: r.q_value for r in fdr.bh_large(df, ["g", "h"], invalid=invalid).collect()}
    families = defaultdict(list)
    for i, g, h, p in rows:
        if p is None or p != p:
            p = 1.0 if invalid == "keep" else None
        if p is not None:
            families[g, h].append((p, i))
    want = dict.fromkeys(range(1501), 1.0)
    for f in families.values():
        low = 1.0
        for rank, (p, i) in sorted(enumerate(sorted(f), 1), reverse=True):
            low = min(low, p * len(f) / rank)
            want[i] = low
    assert all(math.isclose(got[i], want[i], rel_tol=1e-12) for i in want) and len(got) == 1501
    small = {r.i: r.q_value for r in fdr.bh(df, ["g", "h"], invalid=invalid).collect()}
    assert all(math.isclose(small[i], want[i], rel_tol=1e-12) for i in want)


def test_shared_fits_equal_fits_one_by_one(spark):
    """Against least squares of each candidate alone; one target has more sources than a row may carry."""
    rng = np.random.default_rng(1)
    nodes, steps = 80, 130
    data = rng.normal(size=(nodes, steps)).cumsum(axis=1) * 0.1 + rng.normal(size=(nodes, steps))
    rows = [(int(t + 5), n, "v", float(data[n, t])) for n in range(nodes) for t in range(steps) if not (n == 7 and t < 30)]
    given = screen.series(spark.createDataFrame(rows, "t long, node long, variable string, value double"))
    cand = spark.createDataFrame([(s, 0, "v", "v") for s in range(nodes)] + [(3, 4, "v", "v")], "source_region long, target_region long, source_var string, target_var string")
    got = screen.common_controls(cand, given, bandwidths=(4,), blocks=(13,)).collect()
    assert len(got) == (nodes + 1) * 3 * 2 and {r.n_controls for r in got if r.source_region == r.target_region} == {2}
    for r in got:
        if r.source_region % 11 and r.source_region != 7:
            continue
        begin = 30 if r.source_region == 7 else 0  # its calendar begins later
        y, x = data[r.target_region], data[r.source_region]
        at = np.arange(begin + 3, steps)
        at = at[((at + 5) % 52 < 26) == (r.regime == "winter")]
        own = [y[at - k] for k in (1, 2, 3) if not (r.source_region == r.target_region and k == r.lag)]
        c = np.stack([np.ones(len(at)), *own, x[at - r.lag]], axis=1)
        beta, *_ = np.linalg.lstsq(c, y[at], rcond=None)
        e = y[at] - c @ beta
        inverse = np.linalg.inv(c.T @ c)
        v = np.zeros(steps)
        v[at] = c @ inverse[:, -1] * e * math.sqrt(len(at) / (len(at) - c.shape[1]))
        hac = sum((1 - abs(a - b) / 5) * v[a] * v[b] for a in range(steps) for b in range(max(0, a - 4), min(steps, a + 5)))
        block = (5 + np.arange(steps)) // 13
        sums = np.array([v[block == b].sum() for b in np.unique(block)])
        g = len(np.unique(block[at]))
        cr1 = (sums**2).sum() * g / (g - 1) * (len(at) - 1) / len(at)
        assert r.n == len(at)
        assert np.allclose([r.effect, r.se_ols, r.se_hac4, r.se_cluster13], [beta[-1], math.sqrt(e @ e / (len(at) - c.shape[1]) * inverse[-1, -1]), math.sqrt(hac), math.sqrt(cr1)], rtol=1e-8)


def test_frozen_sources_against_plain_fits(spark):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(3, 200))
    data[0, 1:] += 0.5 * data[1, :-1]
    rows = [(t, n, "v", float(data[n, t])) for n in range(3) for t in range(200)]
    given = screen.series(spark.createDataFrame(rows, "t long, node long, variable string, value double"))
    cand = spark.createDataFrame([(s, 0, "v", "v") for s in (1, 2)], "source_region long, target_region long, source_var string, target_var string")
    for r in screen.frozen_sources(cand, given, 140, 150).collect():
        y, x = data[0], data[r.source_region]
        design = lambda at, *more: np.stack([np.ones(len(at)), y[at - 1], *(m[at - 1] for m in more)], axis=1)
        past, test = np.arange(1, 140), np.arange(150, 200)
        b0, b1, b2 = (np.linalg.lstsq(design(a, *m), y[a], rcond=None)[0] for a, m in ((past, ()), (past, (x,)), (test, (x,))))
        er, ef = y[test] - design(test) @ b0, y[test] - design(test, x) @ b1
        assert np.allclose([r.effect, r.refit_effect, r.mse_restricted, r.mse_full, r.gain], [b1[-1], b2[-1], (er**2).mean(), (ef**2).mean(), (er**2 - ef**2).mean()])
        assert (r.effect > 0.3) == (r.source_region == 1)


def test_matched_pairs_are_used_once(spark):
    rng = random.Random(4)
    nodes = spark.createDataFrame([(i, rng.uniform(-80, 80), rng.uniform(-180, 180)) for i in range(400)], "node long, lat double, lon double")
    e = spark.createDataFrame([(i, (i * 37 + 1) % 400) for i in range(150)] + [(i, i + 1) for i in range(150, 300)], "es long, et long").filter("es <> et")
    m = k_more.match_by_distance(e, nodes).collect()
    assert len(m) == e.count()
    found = [(r.source, r.target) for r in m if r.source is not None]
    assert len(set(found)) == len(found) > 0.98 * len(m)
    assert all((r.source, r.target) != (r.es, r.et) for r in m)
    assert sum(r.source is not None and abs(r.km - r.ekm) <= 0.2 * r.ekm for r in m) > 0.9 * len(m)
    plan = k_more.match_by_distance(e, nodes)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert k_more.match_by_distance(e.limit(0), nodes).agg(F.count("*")).first()[0] == 0


def test_ranks_of_large_groups(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), rng.randint(0, 20), i) for i in range(800)]
    df = spark.createDataFrame(rows, "g string, x long, i long").repartition(6)
    got = {r.i: r.rank for r in ranks.rank_by_ranges(df, ["g"], [F.desc("x"), "i"]).collect()}
    for g in ("a", "b", None):
        part = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        assert [got[r[2]] for r in part] == list(range(1, len(part) + 1))


def test_cross_products_of_many_partitions(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(300, 4)), rng.normal(size=(300, 2))
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y, strict=True)], "x array<double>, y array<double>").repartition(70)
    n, g = dense.gram(df, 6)
    m = np.hstack([x, y])
    assert n == 300 and np.allclose(g, m.T @ m)
    assert dense.gram(df.limit(0), 6)[0] == 0


def test_no_node_left_is_an_error(spark):
    df = spark.createDataFrame([(1, None), (1, 2.0)], "node long, value double")
    with pytest.raises(ValueError):
        clean.some_left(clean.drop_sparse(df, "node"))
    assert clean.some_left(clean.drop_sparse(df, "node", 0.5)).count() == 2


def test_scan_leaves_out_hidden_names_and_store_contents(spark, tmp_path):
    for p in ("a.csv", "b/c.NPZ", "b/.hidden.csv", ".d/e.csv", "s.zarr/0.0/x.csv", "s.zarr/.zarray", "note.txt", "deep/t.parquet"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x" * 7)
    got = [(r.name, r.format, r.bytes) for r in readers.scan(spark, str(tmp_path)).collect()]
    assert got == [("a.csv", "csv", 7), ("c.NPZ", "npz", 7), ("t.parquet", "parquet", 7), ("s.zarr", "zarr", None)]


@pytest.mark.parametrize("axes", [(0, 1, 2), (2, 1, 0), (1, 0, 2), (1, 2, 0)])
def test_archives_of_any_axis_order(axes):
    import io

    rng = np.random.default_rng(5)
    lat, lon, time = np.array([-10.0, 0, 10]), np.array([0.0, 90, 180, 270]), np.arange("2001-01", "2001-08", dtype="datetime64[M]")
    q, u, v = rng.normal(size=(3, 7, 3, 4))
    buf = io.BytesIO()
    np.savez(buf, q=np.transpose(q, axes), u10=np.transpose(u, axes), v10=np.transpose(v, axes), latitude=lat, longitude=lon, time=time)
    held, times, la, lo = archives.read_archive(buf.getvalue())
    assert np.allclose(held["humidity"], q.reshape(7, 12)) and np.allclose(held["wind"], np.hypot(u, v).reshape(7, 12)) and len(times) == 7
    assert la.tolist() == np.repeat(lat, 4).tolist() and lo.tolist() == [0, 90, -180, -90] * 3
    buf = io.BytesIO()
    np.savez(buf, data=np.stack([np.transpose(u, axes), np.transpose(q, axes)], axis=0), variable_names=np.array(["wind_speed", "humidity"]), lat=lat, lon=lon, timestamps=time)
    held, *_ = archives.read_archive(buf.getvalue())
    assert np.allclose(held["humidity"], q.reshape(7, 12)) and np.allclose(held["wind"], u.reshape(7, 12))


def test_footprint_of_cells_across_the_seam(spark):
    box = "id long, south double, north double, west double, east double"
    source = spark.createDataFrame([(i * 36 + j, -90.0 + 10 * i, -80.0 + 10 * i, 10.0 * j, 10.0 * j + 10) for i in range(18) for j in range(36) if (i, j) != (9, 0)], box)
    target = spark.createDataFrame([(1, -5.0, 7.0, -15.0, 25.0), (2, 31.0, 47.0, 170.0, 195.0), (3, -90.0, -80.0, 350.0, 370.0)], box)
    weights, cover = spatial.footprint(source, target)
    c = {r.target: r for r in cover.collect()}
    assert not c[1].included and 0.7 < c[1].coverage < 0.95 and c[2].included and c[3].included
    sums = weights.groupBy("target").agg(F.sum("weight").alias("w")).collect()
    assert {r.target for r in sums} == {2, 3} and all(math.isclose(r.w, 1) for r in sums)
    assert math.isclose(c[2].area_m2, 6_371_000.0**2 * (math.sin(math.radians(47)) - math.sin(math.radians(31))) * math.radians(25))


def test_levels_by_pressure(spark):
    df = spark.createDataFrame([(1, 100000), (2, 85000), (3, 50000)], "i long, level long")
    pick = lambda p: [r.i for r in archives.at_level(df, F.col("level"), p).collect()]
    assert pick(860.0) == [2] and pick(520.0) == [3] and pick(None) == [3]
    assert [r.i for r in archives.at_level(df.withColumn("level", F.col("level") / 100), F.col("level"), 990.0).collect()] == [1]


def test_contrasts_find_a_planted_difference(spark):
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=400), rng.normal(size=400)
    high = set(range(0, 400, 2))
    for t in range(1, 400):
        y[t] += (0.9 if t in high else 0.1) * x[t - 1]
    rows = [(t, n, "v", float(s[t])) for n, s in ((0, y), (1, x)) for t in range(400)]
    given = screen.series(spark.createDataFrame(rows, "t long, node long, variable string, value double"))
    cand = spark.createDataFrame([(1, 0, "v", "v")], "source_region long, target_region long, source_var string, target_var string")
    r = screen.state_contrasts(cand, given, {"c": (set(range(400)) - high, high)}, {"all": (0, 400)}).collect()[0]
    at = np.arange(1, 400)
    s = (at % 2 == 0).astype(float)
    c = np.stack([np.ones(399), y[at - 1], s, s * y[at - 1], x[at - 1], s * x[at - 1]], axis=1)
    beta = np.linalg.lstsq(c, y[at], rcond=None)[0]
    assert math.isclose(r.delta, beta[5], rel_tol=1e-9) and math.isclose(r.reference, beta[4], rel_tol=1e-9) and r.delta > 0.5 and r.p_value < 1e-4
