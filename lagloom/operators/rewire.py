"""Degree- and distance-preserving rewiring of many graphs at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagloom.operators.lineage import cut
from lagloom.operators.spatial import haversine, stratum

KERNELS = {"global": 2, "near": 2, "cycle": 3}


def located(graphs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges rep, type, a, b with the places of both ends and the distance stratum s."""
    at = lambda n: nodes.select(F.col("node").alias(n), F.col("lat").alias("y" + n), F.col("lon").alias("x" + n))
    g = graphs.select("rep", "type", "a", "b").distinct().join(at("a").hint("shuffle_merge"), "a").join(at("b").hint("shuffle_merge"), "b")
    return g.withColumn("s", stratum(haversine(F.col("ya"), F.col("xa"), F.col("yb"), F.col("xb")))).select("rep", "type", "a", "b", "ya", "xa", "yb", "xb", "s")


#: A large prime: sums of squares below it are marks of sets of edges.
PRIME = 2147483647


def hashed(step: int, seed: int) -> tuple[Column, Column]:
    """Luck of an edge in a step: where it is dealt to, and its order there."""
    luck = F.xxhash64("rep", "type", "a", "b", F.lit(seed), F.lit(step))
    return luck, F.xxhash64(luck, F.lit(7))


def arithmetic(step: int, seed: int) -> tuple[Column, Column]:
    """The same from whole numbers alone, so that other engines can follow."""
    x = f"((a * 7919 + b * 104729 + rep * 15485863 + {step * 32452843 + seed * 611953}) % 1000003)"
    return F.expr(f"{x} * 613 % 1000003"), F.expr(f"{x} * 7907 % 1000033")


def fingerprint(a: Column, b: Column) -> Column:
    """Mark of a set of edges, the same in any order: a sum over rows."""
    x = (a * 1000003 + b) % PRIME
    return F.sum(x * x % PRIME)


def end_counts(g: DataFrame, name: str) -> DataFrame:
    """Edges of each (rep, type) by source (end a), by target (b) and by distance stratum (s): rep, type, end, v and the count."""
    ends = F.explode(F.array(*[F.struct(F.lit(c).alias("end"), F.col(c).cast("long").alias("v")) for c in ("a", "b", "s")])).alias("e")
    return g.select("rep", "type", ends).groupBy("rep", "type", "e.end", "e.v").agg(F.count("*").alias(name))


def kept(g: DataFrame, before: DataFrame) -> DataFrame:
    """Of each (rep, type): edges, sources, targets, and how many nodes' degrees and strata's counts differ from ``before``, which is end_counts() of the first graphs as x."""
    x, y, end = F.col("x"), F.col("y"), F.col("end")
    there = lambda c: F.count_if((end == c) & y.isNotNull())
    return before.join(end_counts(g, "y").hint("shuffle_merge"), ["rep", "type", "end", "v"], "full").groupBy("rep", "type").agg(
        F.sum(F.when(end == "a", y)).alias("edges"), there("a").alias("sources"), there("b").alias("targets"),
        F.count_if(~x.eqNullSafe(y) & (end != "s")).alias("degrees_changed"), F.count_if(~x.eqNullSafe(y) & (end == "s")).alias("strata_changed"),
    )


def measures(g: DataFrame, first: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Of each (rep, type): edges, fingerprint, share changed since ``first``, reciprocal edges, nodes whose degree and strata whose count differ from ``first``.

    ``before`` is end_counts() of ``first`` as x, where it is at hand.
    """
    key = ["rep", "type"]
    mark = first.select(*key, "a", "b", F.lit(1).alias("was"))
    back = g.select(*key, F.col("a").alias("b"), F.col("b").alias("a"), F.lit(1).alias("back"))
    x = g.select(*key, "a", "b").join(mark.hint("shuffle_merge"), [*key, "a", "b"], "left").join(back.hint("shuffle_merge"), [*key, "a", "b"], "left")
    m = x.groupBy(*key).agg(F.count("*").alias("edges"), fingerprint(F.col("a"), F.col("b")).alias("fingerprint"), (1 - F.count("was") / F.count("*")).alias("changed"), F.count("back").alias("reciprocal"))
    d = kept(g, end_counts(first, "x") if before is None else before).select(*key, "degrees_changed", "strata_changed")
    return m.join(d.hint("shuffle_merge"), key)


def dealt(g: DataFrame, kernel: str, step: int, seed: int, luck=hashed) -> DataFrame:
    """Edges with the part of the map and the number of the group (i) that a round deals them to, each group in one task.

    The sizes of the parts, a row for each (rep, type, part), are broadcast: a join on these keys would put all edges of a type into one task.
    Edges are shuffled as rows, as groups are too small for lists to be begun before; ``part`` is not among the keys, as where it is a
    constant Spark takes it out of the grouping, which then would shuffle again.
    """
    key = ["rep", "type", "part"]
    part = (F.floor(F.col("ya") / 30) * 100 + F.floor(F.col("xa") / 45)) if kernel == "near" else F.lit(0).cast("long")
    here = g.withColumn("part", part)
    n = here.groupBy(*key).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / KERNELS[kernel])).alias("groups"))
    return here.join(F.broadcast(n), key).withColumn("i", F.pmod(luck(step, seed)[0], F.col("groups"))).repartition("rep", "type", "i")


def rewire(graphs: DataFrame, nodes: DataFrame, kernels: list[str], seed: int = 1, luck=hashed, observe=None) -> tuple[DataFrame, DataFrame]:
    """The graphs after one round per kernel, and what became of the moves: step, kernel, rep, type, code, n.

    graphs: rep, type, a, b, or what located() makes of them, stored; nodes: node, lat, lon. In a round the edges of a (rep,
    type) are dealt by hash into groups of two (``global``; ``near``: of one part of
    the map) or three (``cycle``). A group hands its targets on in a ring unless a new
    edge would be a loop (``loop``), be there already (``present``), be proposed twice
    (``clash``), or the counts by distance stratum would change (``distance``). In- and
    out-degrees by type and the counts by stratum hold exactly. Groups are formed by
    hash, so no window holds all edges of a type. With ``observe(graphs, first graphs)`` the
    log holds its rows (rep, type and columns of its own) after every round instead.
    """
    key = ["rep", "type"]
    g, log = graphs if "s" in graphs.columns else cut(located(graphs, nodes)), None
    first = g
    for step, kernel in enumerate(kernels):
        m = KERNELS[kernel]
        one = F.struct(luck(step, seed)[1].alias("r"), "a", "b", "ya", "xa", "yb", "xb", "s")
        moves = dealt(g, kernel, step, seed, luck).groupBy(*key, "part", "i").agg(F.sort_array(F.collect_list(one)).alias("old")).filter(F.size("old") >= m).withColumn("old", F.slice("old", 1, m))

        def turned(j, m=m):
            e, f = F.col("old")[j], F.col("old")[(j + 1) % m]
            s = stratum(haversine(e["ya"], e["xa"], f["yb"], f["xb"]))
            return F.struct(e["a"].alias("a"), f["b"].alias("b"), e["ya"].alias("ya"), e["xa"].alias("xa"), f["yb"].alias("yb"), f["xb"].alias("xb"), s.alias("s"))

        moves = moves.withColumn("new", F.array(*[turned(j) for j in range(m)]))
        strata = lambda c: F.array_sort(F.transform(c, lambda e: e["s"]))
        code = F.when(F.exists("new", lambda e: e["a"] == e["b"]), "loop").when(strata("new") != strata("old"), "distance")
        moves = cut(moves.withColumn("code", code))
        ids = [*key, "part", "i"]
        made = moves.filter("code is null").select(*ids, F.explode("new").alias("e")).select(*ids, "e.*")
        taken = made.join(g.select(*key, "a", "b").hint("shuffle_merge"), [*key, "a", "b"], "left_semi").select(*ids, F.lit("present").alias("bad"))
        twice = made.groupBy(*key, "a", "b").agg(F.collect_list(F.struct("part", "i")).alias("w")).filter(F.size("w") > 1)
        twice = twice.select(*key, F.explode("w").alias("w")).select(*key, "w.*", F.lit("clash").alias("bad"))
        failed = taken.unionByName(twice).groupBy(*ids).agg(F.max("bad").alias("bad"))
        moves = cut(moves.join(failed.hint("shuffle_merge"), ids, "left").withColumn("code", F.coalesce("code", "bad", F.lit("moved"))).drop("bad"))
        went = moves.filter("code = 'moved'")
        gone = went.select(*key, F.explode("old").alias("e")).select(*key, "e.a", "e.b")
        came = went.select(*key, F.explode("new").alias("e")).select(*key, "e.*")
        g = cut(g.join(gone.hint("shuffle_merge"), [*key, "a", "b"], "left_anti").unionByName(came))
        if observe is not None:
            moved = went.groupBy(*key).agg(F.count("*").alias("moved"))
            told = observe(g, first).join(moved.hint("shuffle_merge"), key, "left").withColumn("moved", F.coalesce("moved", F.lit(0)))
            told = cut(told.withColumns({"step": F.lit(step), "kernel": F.lit(kernel)}))
            log = told if log is None else log.unionByName(told)
            continue
        told = moves.groupBy(*key, "code").agg(F.count("*").alias("n")).select(F.lit(step).alias("step"), F.lit(kernel).alias("kernel"), *key, "code", "n")
        log = told if log is None else log.union(told)
    return g, log
