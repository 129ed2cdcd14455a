"""Series by numpy against the row-wise steps of clean.py."""

import random

import pytest
from pyspark.sql import functions as F

from lagloom.operators import clean, panels

NAMES = ["humidity", "wind"]


@pytest.fixture(scope="module")
def wide(spark):
    random.seed(3)
    rows = []
    for node in range(700):
        for t in range(-5, 118):
            if random.random() < (0.02 if node % 9 == 0 else 0.3):
                rows.append((t, node, random.random() if random.random() < 0.9 else None, random.gauss(0, 5) if node % 7 else 2.0))
    rows += [(4, 1000, 1.5, None), (None, 1001, 1.0, 2.0), (6, None, 3.0, 4.0), (8, None, 3.5, 1.0)]
    return spark.createDataFrame(rows, "t long, node long, wind double, humidity double")


def _dense(wide):
    long = wide.unpivot(["t", "node"], NAMES, "variable", "value")
    ends = long.agg(F.min("t").alias("a"), F.max("t").alias("b"))
    grid = clean.dense(long, ends.select(F.explode(F.sequence("a", "b")).alias("t")), long.select("node", "variable").distinct())
    return clean.fill_gaps(grid, ["node", "variable"], 6)


def test_climate_equals_rows(spark, wide):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "53")  # nodes are cut by batches
    try:
        b = panels.climate(wide, NAMES, panels.calendar(wide))
        got = {(r.t, r.node, r.variable): r.value for r in panels.steps(panels.unbundled(b)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {(r.t, r.node, r.variable): r.value for r in clean.weekly_climate(_dense(wide), ["node", "variable"]).collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[k] - v) for k, v in want.items()) < 1e-9


def test_series_make_no_dense_rows(wide):
    """The plan neither crosses nodes with steps nor sorts a row for each of them."""
    b = panels.climate(wide, NAMES, panels.calendar(wide))
    plan = b._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan and "Join" not in plan


def test_regions_are_summed_in_tasks(spark, wide):
    """Only a row for each region, recipe and variable of a task leaves it: no settings or steps are multiplied before the shuffle."""
    from lagloom.operators import settings

    places = spark.range(0, 700).select(F.col("id").alias("node"), (F.col("id") % 170 - 85.0).alias("lat"), (F.col("id") * 37 % 360 - 180.0).alias("lon"))
    r = settings.regional(wide, NAMES, panels.calendar(wide), places)
    plan = r._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("MapInArrow") == 2
    got = {(x.setting, x.node, x.variable): x for x in r.collect()}
    own = {(x.node, x.variable): x["values"] for x in panels.unbundled(panels.climate(wide, NAMES, panels.calendar(wide))).collect()}
    from lagloom.operators.spatial import bins

    box = {x.node: x.b for x in places.select("node", bins(F.col("lat"), F.col("lon"), 32).alias("b")).collect()}
    region = got[("R32_monthly", box[3], "wind")].node
    members = [own[(n, "wind")] for n in box if box[n] == region and (n, "wind") in own]
    want = [sum(v) / len(members) for v in zip(*members, strict=True)]
    assert max(abs(a - b) for a, b in zip(got[("R32_monthly", region, "wind")]["values"], want, strict=True)) < 1e-9
    assert {x.first for k, x in got.items() if k[0] in ("P2_monthly_diff", "P3_diff_only")} == {-4}


def test_mid_ranks(spark):
    """Mean ranks of equal values, and no window over a whole group of rows."""
    from lagloom.operators.ranks import mid_ranks

    rows = [("a", float(v)) for v in (3, 1, 2, 2, 2, 9)] + [("b", 5.0), ("b", 5.0)]
    r = mid_ranks(spark.createDataFrame(rows, "g string, v double"), ["g"], "v")
    assert {(x.g, x.v): x["rank"] for x in r.collect()} == {("a", 1.0): 1.0, ("a", 2.0): 3.0, ("a", 3.0): 5.0, ("a", 9.0): 6.0, ("b", 5.0): 1.5}
    plan = r._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 2 and any("_part" in w.split("ROWS")[0] or "_part" in w for w in windows)
