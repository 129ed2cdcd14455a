"""Queries that have to take all years, draws, nodes and months of their input."""

import pytest

from lagloom import registry
from lagloom.plans import a_sources, j_nulls


def test_every_year_is_drawn(spark, sf_dir):
    # slopes are 0 but in the last of nine years, so only replicates with that year have another mean
    rows = [(year * 365 + d, "A", 100.0 * d if year == 8 else 1.0, float(d)) for year in range(9) for d in range(3)]
    got = j_nulls.all_years_interval(spark.createDataFrame(rows, "t long, flag string, price double, disc double")).collect()
    assert [(r.flag, r.years) for r in got] == [("A", 9)] and got[0].mean > 0
    assert min(r.years for r in registry.queries()["year_block_interval_all"](spark, sf_dir).collect()) >= 6


@pytest.mark.parametrize("n", [10, 11])
def test_chains_are_cut_at_half_of_their_draws(spark, n):
    rows = [(regime, 1, i, 0, "x", float((i * 7 + len(regime)) % 5)) for regime in ("winter", "fall") for i in range(n)]
    got = j_nulls.split_chains(spark.createDataFrame(rows, "regime string, lag long, source_region long, target_region long, edge_type string, effect double")).collect()
    halves = [[r[5] for r in rows if r[0] == g][a:b] for g in ("winter", "fall") for a, b in ((0, (n + 1) // 2), ((n + 1) // 2, n))]
    means = [sum(h) / len(h) for h in halves]
    var = lambda v: sum((x - sum(v) / len(v)) ** 2 for x in v) / (len(v) - 1)
    within, size = sum(var(h) for h in halves) / 4, n / 2
    assert got[0].split_rhat == pytest.approx((((size - 1) / size * within + var(means)) / within) ** 0.5, abs=1e-7)


def test_coverage_counts_months_after_the_first_eighty(spark):
    p = spark.createDataFrame([(0, 1), (90, 1), (91, 2)], "t long, node long")
    assert sorted(tuple(r) for r in a_sources.coverage(p).select("node", "present", "absent").collect()) == [(1, 2, 90), (2, 1, 91)]


@pytest.mark.parametrize("name", ["index_parse_all", "index_profile_all", "fixed_width_crosscheck_all"])
def test_every_node_is_read(spark, sf_dir, name):
    assert {r.node for r in registry.queries()[name](spark, sf_dir).select("node").distinct().collect()} == set(range(25))
