"""Operators against independent formulas, and degenerate inputs."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lagloom.functions import tails
from lagloom.operators import clean, gram, reports, spatial
from lagloom.operators.fdr import bh
from lagloom.sources import readers


def test_gap_fill_equals_pandas(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for k in range(60):
        v = [None if rng.random() < rng.choice((0.3, 0.9)) else rng.random() for _ in range(30)]
        rows += [(k, t, x) for t, x in enumerate(v)]
        s = pd.Series(v, dtype=float).interpolate(limit=6, limit_direction="both", method="linear").ffill().bfill().fillna(0)
        want[k] = s.tolist()
    df = spark.createDataFrame(rows, "k long, t long, value double")
    for r in clean.fill_gaps(df, ["k"]).collect():
        assert r.value == pytest.approx(want[r.k][r.t], abs=1e-12)


def test_bh_with_invalid_member(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate((0.001, 0.02, 0.04, float("nan")))], "i long, p_value double").withColumn("g", F.lit(1))
    kept = {r.i: r.q_value for r in bh(df, ["g"], invalid="keep").collect()}
    assert [kept[i] for i in range(4)] == pytest.approx([0.004, 0.04, 4 * 0.04 / 3, 1])
    left = {r.i: r.q_value for r in bh(df, ["g"]).collect()}
    assert [left[i] for i in range(4)] == pytest.approx([0.003, 0.03, 0.04, 1])
    assert bh(df.limit(0), ["g"]).count() == 0


def _panel(n=160, seed=0):
    rng = np.random.default_rng(seed)
    z, c, d = rng.normal(size=n), rng.normal(size=n), rng.normal(size=n)
    y = 0.5 * z + 0.3 * c + rng.normal(size=n)
    keep = np.flatnonzero(rng.random(n) > 0.2)
    return keep, z, c, d, y


def test_gram_and_hac_equal_brute_force(spark):
    keep, z, c, d, y = _panel()
    df = spark.createDataFrame([(1, int(t), float(z[t]), float(c[t]), float(2 * c[t]), float(d[t]), float(y[t])) for t in keep], "k int, t long, z double, c double, c2 double, d double, y double")
    r = gram.hac(df, ["k"], ["c", "c2", "d"], 5).first()
    x = np.column_stack([np.ones(len(keep)), c[keep], d[keep], z[keep]])
    b, rss, *_ = np.linalg.lstsq(x, y[keep], rcond=None)
    assert r["rank"] == 3 and r.beta == pytest.approx(b[3], abs=1e-10) and r.rss_f == pytest.approx(rss[0], rel=1e-9)
    w = x[:, :3]
    zr = z[keep] - w @ np.linalg.lstsq(w, z[keep], rcond=None)[0]
    s = np.zeros(len(z))
    s[keep] = zr * (y[keep] - x @ b)
    meat = s @ s + 2 * sum((1 - h / 6) * (s[h:] @ s[:-h]) for h in range(1, 6))
    dof = len(keep) - 4
    assert r.se_hac == pytest.approx(math.sqrt(meat * len(keep) / dof) / (zr @ zr), rel=1e-9)


def test_training_fit_ignores_evaluation_rows(spark):
    rows = [(1, t, float(t % 7) + t * 0.01) for t in range(100)]
    df = spark.createDataFrame(rows, "k int, t long, value double")
    changed = df.withColumn("value", F.when(F.col("t") >= 60, F.col("value") * 1000).otherwise(F.col("value")))
    a, b = ({r.t: r.value for r in clean.fit_transform(x, ["k"], F.col("t") % 5, F.col("t") < 60).filter("t < 60").collect()} for x in (df, changed))
    assert a == pytest.approx(b)


def test_tails():
    assert tails.f_tail(4.0, 1, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert tails.t_tail(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert tails.t_tail(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert tails.t_quantile(0.975, 10) == pytest.approx(2.228138852, abs=1e-6)
    assert tails.f_tail(0.0, 1, 5) == 1.0


def test_chains_and_degree_totals_agree(spark):
    rows = [("r", a, b, v, w, 1, 0.1, 1.0) for a in range(4) for b in range(4) for v, w in (("wind", "humidity"), ("humidity", "cloud_cover")) if (a + 2 * b) % 3]
    e = spark.createDataFrame(rows, "regime string, source_region long, target_region long, source_var string, target_var string, lag long, p_value double, effect double")
    n = reports.chains(e).count()
    i = e.filter("target_var = 'humidity'").groupBy(F.col("target_region").alias("m")).agg(F.count("*").alias("i"))
    o = e.filter("source_var = 'humidity'").groupBy(F.col("source_region").alias("m")).agg(F.count("*").alias("o"))
    assert n == i.join(o, "m").agg(F.sum(F.col("i") * F.col("o"))).first()[0]
    assert reports.chains(e.limit(0)).count() == 0


def test_spatial_edges(spark):
    df = spark.createDataFrame([(90.0, 180.0), (-90.0, -180.0), (None, 0.0), (23.5, 0.0), (60.0, 0.0)], "lat double, lon double")
    assert [r[0] for r in df.select(spatial.band(F.col("lat"))).collect()] == ["polar", "polar", "unknown", "midlatitude", "polar"]
    assert [r[0] for r in df.select(spatial.wrap(F.col("lon"))).collect()] == [-180, -180, 0, 0, 0]
    d = df.select(spatial.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))).first()[0]
    assert d == pytest.approx(math.pi * 6371)


def test_alias_resolution():
    assert readers.resolve(["Valid_Time", "Latitude", "my_temperature_2m", "TCC", "x", "other"]) == {"ts": "Valid_Time", "lat": "Latitude", "lon": "x", "cloud_cover": "TCC", "temperature": "my_temperature_2m"}


def test_segments_and_artifacts(spark):
    a, b = spark.createDataFrame([(1, 1.0), (2, 2.0)], "t long, v double"), spark.createDataFrame([(2, 9.0), (3, 3.0)], "t long, v double")
    assert sorted((r.t, r.v) for r in readers.concat_segments([a, b], ["t"]).collect()) == [(1, 1.0), (2, 2.0), (3, 3.0)]
    m = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("c", 3, "z")], "path string, bytes long, sha256 string")
    f = spark.createDataFrame([("a", 1, "x"), ("b", 5, "y"), ("d", 1, "q")], "path string, bytes long, sha256 string")
    assert {r.path: r.status for r in readers.check_artifacts(f, m).collect()} == {"a": "ok", "b": "size", "c": "missing", "d": "unlisted"}


def test_standardise_constant_and_null(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 5.0), ("b", 1, None), ("b", 2, 1.0)], "k string, t long, value double")
    assert {(r.k, r.t): r.value for r in clean.standardise(df, ["k"]).collect()} == {("a", 1): 0, ("a", 2): 0, ("b", 1): 0, ("b", 2): 0}


def test_rewiring_keeps_degrees_and_strata(spark):
    from lagloom.operators.rewire import located, rewire

    nodes = spark.createDataFrame([(i, 7.0 * (i % 3) - 7, 9.0 * i) for i in range(20)], "node long, lat double, lon double")
    g = spark.createDataFrame([(rep, "x", a, b) for rep in (0, 1) for a in range(20) for b in range(20) if a != b and (a + 3 * b) % 5 == 0], "rep int, type string, a long, b long")
    out, _ = rewire(g, nodes, ["global", "global", "cycle"])

    def shape(df):
        rows = df.select("rep", "a", "b").collect()
        return [sorted(x) for x in ([(r.rep, r.a) for r in rows], [(r.rep, r.b) for r in rows])], len({tuple(r) for r in rows})

    assert shape(out) == shape(g)
    count = lambda df: sorted(tuple(r) for r in df.groupBy("rep", "s").count().collect())
    assert count(out) == count(located(g, nodes))
    assert {tuple(r) for r in out.select("rep", "a", "b").collect()} != {tuple(r) for r in g.select("rep", "a", "b").collect()}
