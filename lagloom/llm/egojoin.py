"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors with cosine >= c lie within eps = sqrt(2 - 2c). Vectors are turned to
their principal axes (fitted on a bounded sample; any rotation keeps distances) and
sorted by the cells of side eps on the leading axes: the epsilon grid order. The
sequence is cut into blocks, blocks into a tree of intervals, and pairs of intervals
are joined from the root down: a pair whose boxes are further apart than eps is
skipped with all below it. Surviving blocks meet in a task that goes on halving
intervals and compares what is left in double precision.

Equal vectors are one class from the start. A task adds link counts and a spanning
set of edges, never the list of all links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagloom.llm.common import components, sample_of, stage
from lagloom.llm.vectors import blocks, finite, matrix

_NEAR = """aggregate(zip_with(zip_with(a.lo, b.hi, (x, y) -> x - y), zip_with(b.lo, a.hi, (x, y) -> x - y), (x, y) -> greatest(x, y, 0D)), 0D, (s, x) -> s + x * x) <= {}"""


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision; very large and small ones without overflow."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal_axes(sample: np.ndarray, n: int) -> np.ndarray:
    """Leading principal axes, one per column."""
    c = sample - sample.mean(axis=0)
    _, vec = np.linalg.eigh(c.T @ c)
    return np.ascontiguousarray(vec[:, ::-1][:, :n])


def join_blocks(xa, xb, ca, cb, axes, cosine: float, same: bool, leaf: int = 256):
    """Link counts of both sides (weighted by copies) and edges (i, j) that span the links; b's rows follow a's."""
    na, nb = len(xa), len(xb)
    eps2 = 2 - 2 * cosine + 1e-9
    ya, yb = xa @ axes, xb @ axes
    da, db = np.zeros(na, np.int64), np.zeros(nb, np.int64)
    root = list(range(na + (0 if same else nb)))
    off = 0 if same else na
    edges = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    def box(y, lo, hi):
        return y[lo:hi].min(axis=0), y[lo:hi].max(axis=0)

    todo = [(0, na, 0, nb)] if na and nb else []
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if same and b1 <= a0:
            continue
        (la, ha), (lb, hb) = box(ya, a0, a1), box(yb, b0, b1)
        gap = np.maximum(np.maximum(la - hb, lb - ha), 0)
        if gap @ gap > eps2:
            continue
        if a1 - a0 > leaf or b1 - b0 > leaf:
            if a1 - a0 >= b1 - b0:
                m = (a0 + a1) // 2
                todo += [(a0, m, b0, b1), (m, a1, b0, b1)]
            else:
                m = (b0 + b1) // 2
                todo += [(a0, a1, b0, m), (a0, a1, m, b1)]
            continue
        hit = xa[a0:a1] @ xb[b0:b1].T >= cosine
        if same:
            hit &= np.arange(a0, a1)[:, None] < np.arange(b0, b1)[None, :]
        if not hit.any():
            continue
        da[a0:a1] += hit @ cb[b0:b1]
        db[b0:b1] += ca[a0:a1] @ hit
        # least label along links until nothing changes: at most one edge per row
        rows, cols = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
        h = hit[np.ix_(rows, cols)]
        lr, lc = rows + a0, cols + b0 + off
        while True:
            nr = np.minimum(lr, np.where(h, lc[None, :], 1 << 60).min(axis=1))
            nc = np.minimum(lc, np.where(h, nr[:, None], 1 << 60).min(axis=0))
            if (nr == lr).all() and (nc == lc).all():
                break
            lr, lc = nr, nc
        for i, j in [*zip((rows + a0).tolist(), lr.tolist(), strict=True), *zip((cols + b0 + off).tolist(), lc.tolist(), strict=True)]:
            p, q = find(i), find(j)
            if p != q:
                root[max(p, q)] = min(p, q)
                edges.append((i, j))
    return da, db, edges


def _order(axes: np.ndarray, eps: float, leading: int, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y = unit(matrix(batch.column(2), dtype)) @ axes[:, :leading]
                cells = np.floor(y / eps).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(cells), pa.list_(pa.int64())), pa.array(y[:, 0])], ["id", "copies", "vector", "cells", "y"])

    return run


def _boxes(axes: np.ndarray, dim: int, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = [unit(np.frombuffer(r, dtype).reshape(-1, dim)) @ axes for r in batch.column(2).to_pylist()]
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([v.min(axis=0) for v in y], kind), pa.array([v.max(axis=0) for v in y], kind)], ["key", "part", "lo", "hi"]
            )

    return run


def _leaves(axes: np.ndarray, dim: int, dtype: str, cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                same = r["same"]
                xa = unit(np.frombuffer(r["a_raw"], dtype).reshape(-1, dim))
                xb = xa if same else unit(np.frombuffer(r["b_raw"], dtype).reshape(-1, dim))
                ca, cb = np.array(r["a_copies"], np.int64), np.array(r["b_copies"], np.int64)
                da, db, edges = join_blocks(xa, xb, ca, cb, axes, cosine, same)
                ids = np.array(r["a_ids"] + ([] if same else r["b_ids"]), np.int64)
                deg = da + db if same else np.concatenate([da, db])
                on = np.flatnonzero(deg)
                e = np.array(edges, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([ids[on], ids[e[:, 0]]])), pa.array(np.concatenate([deg[on], np.zeros(len(e), np.int64)])),
                     pa.array([None] * len(on) + ids[e[:, 1]].tolist(), pa.int64())], ["id", "links", "to"]
                )

    return run


def _link_classes(cls: DataFrame, dim: int, dtype: str, cosine: float, leading: int, sample: int, block: int) -> DataFrame:
    """(id, links, to) rows of the classes of one dimension: counts where to is null, else edges."""
    got = sample_of(cls, "id", sample, "vector")
    axes = principal_axes(unit(np.array([r[0] for r in got], np.float64)), min(16, dim))
    eps = math.sqrt(2 - 2 * cosine)
    n = cls.count()
    seq = cls.select("id", "copies", "vector").mapInArrow(
        _order(axes, eps, min(leading, dim), dtype), f"id long, copies long, vector {cls.schema['vector'].dataType.simpleString()}, cells array<long>, y double"
    )
    seq = seq.repartitionByRange(max(1, n // (4 * block)) + 1, "cells", "y", "id").sortWithinPartitions("cells", "y", "id")
    packed = stage(blocks(seq.withColumn("p", F.spark_partition_id().cast("long")), "p", dtype, block), "blocks")
    boxes = packed.select("key", "part", "raw").mapInArrow(_boxes(axes, dim, dtype), "key long, part long, lo array<double>, hi array<double>")
    levels = [stage(boxes.select(F.col("key").alias("up"), (F.col("key") * (1 << 20) + F.col("part")).alias("node"), "lo", "hi"), "boxes")]
    width, top = min(16, dim), boxes.agg(F.max("key")).first()[0] or 0

    def merged(df: DataFrame, up) -> DataFrame:
        ends = [F.min(F.col("lo")[i]).alias(f"l{i}") for i in range(width)] + [F.max(F.col("hi")[i]).alias(f"h{i}") for i in range(width)]
        g = df.groupBy(F.col("up").alias("node")).agg(*ends)
        return g.select(up.alias("up"), "node", F.array(*[f"l{i}" for i in range(width)]).alias("lo"), F.array(*[f"h{i}" for i in range(width)]).alias("hi"))

    while True:  # intervals above: eight to one, up to a single root
        levels.append(merged(levels[-1], F.floor(F.col("node") / 8)))
        if top == 0:
            break
        top //= 8
    root = levels.pop()
    pairs = root.select(F.col("node").alias("pa"), F.col("node").alias("pb"))
    for level in reversed(levels):
        a, b = level.alias("a"), level.alias("b")
        pairs = (
            pairs.join(a.hint("shuffle_merge"), F.col("pa") == F.col("a.up")).join(b.hint("shuffle_merge"), F.col("pb") == F.col("b.up"))
            .filter((F.col("a.node") <= F.col("b.node")) & F.expr(_NEAR.format(eps * eps + 1e-9)))
            .select(F.col("a.node").alias("pa"), F.col("b.node").alias("pb"))
        )
        pairs = stage(pairs, "intervals")
    named = packed.select((F.col("key") * (1 << 20) + F.col("part")).alias("node"), "ids", "copies", "raw")
    side = lambda s: named.select(F.col("node").alias("p" + s), *[F.col(c).alias(f"{s}_{c}") for c in ("ids", "copies", "raw")])
    return (
        pairs.join(side("a").hint("shuffle_merge"), "pa").join(side("b").hint("shuffle_merge"), "pb")
        .withColumn("same", F.col("pa") == F.col("pb")).drop("pa", "pb")
        .mapInArrow(_leaves(axes, dim, dtype, cosine), "id long, links long, to long")
    )


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, leading: int = 8, sample: int = 4096, block: int = 4096) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Null vectors, zero vectors and vectors with a null or non-finite component link
    with nothing; vectors of different length don't link; a row without vec_id takes
    no part and is kept. Repeated rows are vectors of their own: they link with each
    other; rows that share a vec_id are one node of the components. Other columns are not read. The axes are fitted on the ``sample`` vectors
    of least id hash, which affects only speed.
    """
    dtype = "<f8" if "double" in vectors.schema["embedding"].dataType.simpleString() else "<f4"
    x = F.col("embedding")
    ok = F.col("vec_id").isNotNull() & finite("embedding") & F.exists(x, lambda v: v != 0)
    keys = [F.xxhash64(x).alias("k1"), F.xxhash64(F.reverse(x), F.lit(1)).alias("k2"), F.size(x).alias("dim")]
    good = vectors.filter(ok).select("vec_id", *keys, F.col("embedding").alias("vector"))
    cls = stage(good.groupBy("k1", "k2", "dim").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("vector").alias("vector")), "classes")
    found = None
    for r in cls.select("dim").distinct().orderBy("dim").collect():  # vector lengths in use
        part = _link_classes(cls.filter(F.col("dim") == r[0]), r[0], dtype, cosine, leading, sample, block)
        found = part if found is None else found.union(part)
    if found is None:
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = stage(found, "links")
    degree = found.filter("to is null").groupBy("id").agg(F.sum("links").alias("links"))
    comp = components(found.filter("to is not null"), "id", "to").withColumnRenamed("id", "cid")
    solved = (
        cls.select("k1", "k2", "dim", "id", "copies").join(degree.hint("shuffle_merge"), "id", "left").join(comp.hint("shuffle_merge"), F.col("id") == F.col("cid"), "left")
        .select("k1", "k2", "dim", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    )
    key = [F.when(ok, k).alias(n) for k, n in zip(keys, ("k1", "k2", "dim"), strict=True)]
    return (
        vectors.select("vec_id", *key).join(solved.hint("shuffle_merge"), ["k1", "k2", "dim"], "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
