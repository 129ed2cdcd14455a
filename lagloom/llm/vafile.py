"""Exact top-k by inner product with a vector-approximation file.

Each vector's components become integers floor(256 x), held as doubles, which are
exact for them; the approximation keeps one cell number per component. Scanning the cells bounds every score from both sides:
what lies below the k-th best lower bound can't be among the best. The exact vectors
of the rest are read in the order of their upper bounds until the k-th best score
beats the next bound.

Queries meet the rows in blocks: a task holds one block of cells and a bounded number of
query blocks, dealt by a salt, so the work of a block spreads however many queries there
are. Equal integer vectors are one class that keeps the
k + 1 smallest ids, which is all that a top-k with ties to the smaller id can use.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagloom.llm.common import sample_of, stage, unstage
from lagloom.llm.vectors import blocks, finite, matrix


def cell_edges(sample: np.ndarray, bits: int) -> np.ndarray:
    """Inner edges of 2**bits cells per component, as quantiles of a sample."""
    q = np.linspace(0, 1, (1 << bits) + 1)[1:-1]
    sample = np.clip(sample, -(2.0**900), 2.0**900)  # differences of quantiles stay finite
    return np.ceil(np.quantile(sample, q, axis=0)).T if len(sample) else np.zeros((0, (1 << bits) - 1))


def approximate(x: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell numbers of a block, and the least and greatest value that each cell can hold."""
    d = x.shape[1]
    codes = np.stack([np.searchsorted(edges[i], x[:, i], "right") for i in range(d)], axis=1).astype(np.uint8)
    low, high = np.empty((d, edges.shape[1] + 1)), np.empty((d, edges.shape[1] + 1))
    low[:, 0], low[:, 1:] = x.min(axis=0), edges
    high[:, -1], high[:, :-1] = x.max(axis=0), edges - 1
    return codes, low, high


def bounds(q: np.ndarray, codes: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of all queries with all approximations.

    Sums of integers that stay below 2**53 are exact; others are widened by their
    rounding error, and what overflows has no bound.
    """
    d = np.arange(codes.shape[1])
    lo, hi = low[d, codes], high[d, codes]
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    with np.errstate(over="ignore", invalid="ignore"):
        lower, upper = up @ lo.T + down @ hi.T, up @ hi.T + down @ lo.T
        most = np.maximum(np.abs(lo), np.abs(hi))
        if len(q) and len(codes) and np.abs(q).max() * most.max() * len(d) >= 2.0**53:
            slack = (2 * len(d) + 4) * 2.0**-52 * (np.abs(q) @ most.T)
            lower, upper = lower - slack, upper + slack
            lower[~np.isfinite(lower)], upper[~np.isfinite(upper)] = -np.inf, np.inf
    return lower, upper


def _codes(edges: np.ndarray, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, ids, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                codes, low, high = approximate(np.frombuffer(raw, "<f8").reshape(-1, dim).astype(np.float64), edges)
                cols = [pa.array([key]), pa.array([ids], pa.list_(pa.int64())), *(pa.array([b.tobytes()], pa.binary()) for b in (codes, low, high))]
                yield pa.RecordBatch.from_arrays(cols, ["block", "ids", "codes", "low", "high"])

    return run


def _scan(dim: int, need: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q = np.frombuffer(r["q_raw"], "<f8").reshape(-1, dim).astype(np.float64)
                qid, ids = np.array(r["q_ids"], np.int64), np.array(r["ids"], np.int64)
                codes = np.frombuffer(r["codes"], np.uint8).reshape(-1, dim)
                low, high = np.frombuffer(r["low"]).reshape(dim, -1), np.frombuffer(r["high"]).reshape(dim, -1)
                for at in range(0, len(q), 256):
                    lo, hi = bounds(q[at : at + 256], codes, low, high)
                    # a score that may not fit a long can't push others out
                    lo = np.where((lo < -_LONG) | (hi >= _LONG), -np.inf, lo)
                    k = min(need, lo.shape[1])
                    least = np.partition(lo, lo.shape[1] - k, axis=1)[:, lo.shape[1] - k]
                    i, j = np.nonzero(hi >= least[:, None])
                    yield pa.RecordBatch.from_arrays([pa.array(qid[i + at]), pa.array(ids[j]), pa.array(lo[i, j]), pa.array(hi[i, j])], ["query_id", "class", "lower", "upper"])

    return run


#: Scores are longs: at least -_LONG and below _LONG.
_LONG = 2.0**63


def _read_best(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, best, q, ints, most = None, [], None, [], 0.0

        def out() -> pa.RecordBatch:
            n = len(best)
            return pa.RecordBatch.from_arrays(
                [pa.array([at] * n, pa.int64()), pa.array(range(1, n + 1), pa.int32()), pa.array([b[1] for b in best], pa.int64()), pa.array([-b[0] for b in best], pa.int64())],
                ["query_id", "rank", "vec_id", "score"],
            )

        for batch in batches:  # sorted by query, then by upper bound from the top
            if not batch.num_rows:
                continue
            asked, rows = matrix(batch.column(2), "<f8"), matrix(batch.column(3), "<f8")
            for i, (qid, upper, ids) in enumerate(zip(*(batch.column(i).to_pylist() for i in (0, 1, 4)), strict=True)):
                if qid != at:
                    if best:
                        yield out()
                    at, best, q = qid, [], asked[i]
                    ints, most = [], float(np.abs(q).max())
                if len(best) == k and upper < -best[-1][0]:
                    continue  # certain: neither this nor any later one can enter
                x = rows[i]
                if most * float(np.abs(x).max()) * len(x) < 2.0**53:
                    score = int(q @ x)  # every partial sum is an exact integer
                else:
                    ints = ints or [int(a) for a in q]
                    score = sum(a * int(b) for a, b in zip(ints, x.tolist(), strict=True))
                    if not -(2**63) <= score < 2**63:
                        continue
                best = sorted({*best, *((-score, i) for i in ids if i != qid)})[:k]
        if best:
            yield out()

    return run


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, bits: int = 6, sample: int = 4096, query_block: int = 1024, row_block: int = 8192, at_once: int = 32) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each query (vec_id divisible by ``every``), ties to the smaller vec_id.

    Vectors that are null or hold null or non-finite components take no part, nor do
    rows without vec_id, nor pairs whose score does not fit a long; vectors of
    different length don't meet. (In a column of doubles, a component counts as
    non-finite if 256 times it is.) Repeated rows count once; a vec_id with several vectors
    is a query with its least one and a candidate with each of them. With fewer than
    k other rows all of them are returned, with none no row. Cells are fitted on the
    ``sample`` vectors of least id hash, which affects only speed. About ``at_once`` query
    blocks meet a block of cells in one task.
    """
    x = F.col("embedding")
    ok = F.col("vec_id").isNotNull() & finite("embedding") & F.forall(x, lambda v: F.abs(v.cast("double") * 256) < F.lit(float("inf")))

    def floored(v):
        y = v.cast("double") * 256
        return F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)  # doubles beyond are integers

    ints = F.transform(x, floored)
    rows = vectors.filter(ok).select("vec_id", ints.alias("vector")).withColumn("dim", F.size("vector"))
    keyed = rows.withColumns({"k1": F.xxhash64("vector"), "k2": F.xxhash64(F.reverse("vector"), F.lit(1))})
    by_class = Window.partitionBy("k1", "k2", "dim").orderBy("vec_id")
    least = keyed.withColumn("r", F.dense_rank().over(by_class)).filter(F.col("r") <= k + 1)
    cls = stage(
        least.groupBy("k1", "k2", "dim").agg(F.min("vec_id").alias("first"), F.array_sort(F.collect_set("vec_id")).alias("members"), F.first("vector").alias("vector"))
        .withColumn("id", F.xxhash64("k1", "k2", "dim")),
        "classes",
    )
    queries = keyed.filter(F.col("vec_id") % every == 0).groupBy("vec_id", "dim").agg(F.min("vector").alias("vector")).groupBy("vec_id").agg(F.min(F.struct("dim", "vector")).alias("q"))
    queries = stage(queries.select("vec_id", "q.dim", "q.vector"), "queries")
    out = None
    for r in cls.groupBy("dim").count().orderBy("dim").collect():  # vector lengths in use
        part = _search(cls.filter(F.col("dim") == r[0]), queries.filter(F.col("dim") == r[0]), r[0], r[1], k, bits, sample, query_block, row_block, at_once)
        out = part if out is None else out.union(part)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return out


def _search(cls: DataFrame, queries: DataFrame, dim: int, n: int, k: int, bits: int, sample: int, query_block: int, row_block: int, at_once: int) -> DataFrame:
    got = sample_of(cls, "id", sample, "vector")
    edges = cell_edges(np.array([r[0] for r in got], np.float64).reshape(-1, dim), bits)
    n_rows, n_queries = n // row_block + 1, queries.count() // query_block + 1
    deal = lambda df, parts: df.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(parts))).repartition(parts, "block").sortWithinPartitions("block")
    one = F.lit(1).cast("long").alias("copies")
    row_blocks = blocks(deal(cls.select("id", one, "vector"), n_rows), "block", "<f8").select("key", "ids", "raw")
    codes = stage(row_blocks.mapInArrow(_codes(edges, dim), "block long, ids array<long>, codes binary, low binary, high binary"), "cells")
    query_blocks = blocks(deal(queries.select(F.col("vec_id").alias("id"), one, "vector"), n_queries), "block", "<f8")
    salts = -(-n_queries // at_once)
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    salt = F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(salts)).alias("salt")
    asked = query_blocks.select(F.col("ids").alias("q_ids"), F.col("raw").alias("q_raw"), salt, upto(n_rows).alias("block"))
    bound = asked.join(codes.select("*", upto(salts).alias("salt")).hint("shuffle_merge"), ["block", "salt"])
    bound = stage(bound.mapInArrow(_scan(dim, k + 1), "query_id long, class long, lower double, upper double"), "bounds")
    unstage(codes)
    per_query = Window.partitionBy("query_id").orderBy(F.desc("lower"))
    certain = bound.withColumn("r", F.row_number().over(per_query)).filter(F.col("r") <= k + 1).groupBy("query_id").agg(F.min("lower").alias("least"), F.count("*").alias("c"))
    near = bound.join(certain.hint("shuffle_merge"), "query_id").filter((F.col("upper") >= F.col("least")) | (F.col("c") <= k)).select("query_id", "class", "upper")
    q = queries.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("q"))
    return (
        near.join(cls.select(F.col("id").alias("class"), "vector", "members").hint("shuffle_merge"), "class")
        .join(q.hint("shuffle_merge"), "query_id")
        .select("query_id", "upper", "q", "vector", "members")
        .repartition("query_id").sortWithinPartitions("query_id", F.desc("upper"))
        .mapInArrow(_read_best(k), "query_id long, rank int, vec_id long, score long")
    )
