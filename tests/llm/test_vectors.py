"""Vector operators against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagloom.llm import common, egojoin, vafile


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    common.ship(spark)
    rng = np.random.default_rng(0)
    out = [(r.vec_id, list(r.embedding)) for r in common.table(spark, sf_dir, "embeddings").limit(300).collect()]
    out = [(i, v) for i, (_, v) in enumerate(sorted(out))]
    d, n = len(out[0][1]), len(out)
    for k in range(n, n + 100):
        v = np.array(out[rng.integers(0, 12)][1]) + rng.normal(0, 0.02, d)
        out.append((k, [float(np.float32(x)) for x in v]))
    out += [(k, out[3][1]) for k in range(n + 100, n + 160)]
    odd = [None, [0.0] * d, [float("nan")] + [1.0] * (d - 1), [None] + [1.0] * (d - 1), [float("inf")] + [1.0] * (d - 1), []]
    return out + [(1000 + 50 * k, v) for k, v in enumerate(odd)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("clash") for c in ("id", "dim", "k1", "k2", "vector", "block", "score", "label")}).repartition(3)


def valid(rows):
    return [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]


@pytest.mark.parametrize("block", [64, 4096])
def test_ego_join_equals_all_pairs(rows, table, block):
    good = [(i, np.array(v, np.float64)) for i, v in valid(rows) if any(v)]
    u = np.array([v / np.linalg.norm(v) for _, v in good])
    hit = u @ u.T >= 0.9
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = {i: 0 for i, _ in rows}
    for a in range(len(good)):
        for b in np.flatnonzero(hit[a]):
            if a != b:
                links[good[a][0]] += 1
                x, y = find(good[a][0]), find(good[b][0])
                root[max(x, y)] = min(x, y)
    got = {r.vec_id: r for r in egojoin.near_duplicates(table, block=block).collect()}
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (links[i], find(i), find(i) == i) for i, _ in rows}
    assert sum(links.values()) > 1000


def test_top_k_equals_brute_force(rows, table):
    q = [(i, np.floor(256 * np.array(v, np.float64)).astype(np.int64)) for i, v in valid(rows)]
    want = []
    for i, x in q:
        if i % 50 == 0:
            best = sorted((-int(x @ y), j) for j, y in q if j != i)[:5]
            want += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    got = sorted(tuple(r) for r in vafile.top_k(table, query_block=4, row_block=60, at_once=2).collect())
    assert got == sorted(want)
    assert sorted(tuple(r) for r in vafile.top_k(table, bits=2).collect()) == got


def test_top_k_of_large_components(spark, rows):
    d = len(rows[0][1])
    rng = np.random.default_rng(1)
    large = [(i, v) for i, v in rows if i < 120]
    large += [(2000 + i, [float(np.float32(x)) for x in rng.normal(0, 10.0 ** rng.integers(3, 9), d)]) for i in range(60)]
    large += [(3000, [1e30] * d), (3001, [3e38] + [-3e38] * (d - 1)), (3050, [1e30] + [0.0] * (d - 1)), (3100, [0.0] * (d - 1) + [2.0**23]), (3150, [1e18] + [1.0] * (d - 1))]
    large += [(4000 + i, [1e30] + [0.5] * (d - 1)) for i in range(20)]
    q = [(i, [math.floor(float(np.float32(x)) * 256) for x in v]) for i, v in large]
    want = []
    for i, x in q:
        if i % 50 == 0:
            scores = [(-sum(a * b for a, b in zip(x, y, strict=True)), j) for j, y in q if j != i]
            want += [(i, r, j, -s) for r, (s, j) in enumerate(sorted(p for p in scores if -(2**63) <= -p[0] < 2**63)[:5], 1)]
    got = vafile.top_k(spark.createDataFrame(large, "vec_id long, embedding array<float>"), query_block=4, row_block=60)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert {3050, 3100, 3150} <= {w[0] for w in want} and any(w[2] >= 2000 for w in want)


def test_small_tables(spark):
    one = spark.createDataFrame([(50, [1.0, 0.0]), (None, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert vafile.top_k(one).count() == 0 and vafile.top_k(one.limit(0)).count() == 0
    r = egojoin.near_duplicates(one).collect()
    assert sorted((x.vec_id or 0, x.n_links, x.kept) for x in r) == [(0, 0, True), (50, 0, True)]
    assert egojoin.near_duplicates(one.limit(0)).count() == 0
    mixed = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [1.0, 0.0, 0.0]), (50, [2.0, 0.0])], "vec_id long, embedding array<double>")
    assert {x.vec_id: (x.n_links, x.component_id) for x in egojoin.near_duplicates(mixed).collect()} == {0: (2, 0), 1: (2, 0), 2: (0, 2), 50: (2, 0)}
    assert sorted((x.query_id, x.rank, x.vec_id) for x in vafile.top_k(mixed).collect()) == [(0, 1, 50), (0, 2, 1), (50, 1, 0), (50, 2, 1)]
