"""Helpers of the vector operators: valid rows and blocks of packed vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(name: str) -> Column:
    """Whether a vector is there and has only finite components, at least one."""
    x = F.col(name)
    return x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))


def matrix(column: pa.Array, dtype: str) -> np.ndarray:
    """Rows of equally long lists as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    return flat.reshape(len(column), -1)


def blocks(df: DataFrame, key: str, dtype: str, most: int | None = None) -> DataFrame:
    """One row per block: block, ids, copies, raw (vectors as bytes of ``dtype``).

    df: block columns ``key``, id, copies, vector, sorted by key within partitions.
    With ``most``, a block is cut after so many rows and numbered within its key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, at, part = 0, None, 0

        def flush() -> pa.RecordBatch:
            cols = [
                pa.array([at], pa.int64()), pa.array([part], pa.int64()),
                pa.array([np.concatenate([h[0] for h in held])], pa.list_(pa.int64())),
                pa.array([np.concatenate([h[1] for h in held])], pa.list_(pa.int64())),
                pa.array([np.concatenate([h[2] for h in held]).tobytes()], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(cols, ["key", "part", "ids", "copies", "raw"])

        for batch in batches:
            if not batch.num_rows:
                continue
            k, ids, copies, x = (batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(), matrix(batch.column(3), dtype))
            cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if at is not None and k[a] != at:
                    if held:
                        yield flush()
                    held, size, part = [], 0, 0
                at = int(k[a])
                while a < b:
                    e = b if most is None else min(b, a + most - size)
                    held.append((ids[a:e], copies[a:e], x[a:e]))
                    size += e - a
                    a = e
                    if most is not None and size == most:
                        yield flush()
                        held, size, part = [], 0, part + 1
        if held:
            yield flush()

    return df.select(key, "id", "copies", "vector").mapInArrow(run, "key long, part long, ids array<long>, copies array<long>, raw binary")
