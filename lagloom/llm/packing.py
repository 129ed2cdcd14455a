"""Packing of token sequences: shortest pack first over the histogram of lengths.

Documents are cut into pieces of at most ``size`` ids. Only the histogram of piece
lengths (at most ``size`` rows) reaches the driver. Lengths are placed longest
first, each into the pack that is filled least among those with room; equal packs
are one pattern with a count, so the work depends on ``size`` and not on the
number of pieces. Each piece then finds its place by its rank among the pieces of
its length: ranks come from counts by (length, salt), never from one window over
all pieces of a length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagloom.llm import bpe
from lagloom.llm.common import send_file, stage


def pieces(docs: DataFrame, path: str | None = None, size: int = 1024, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Cut each document's ids, closed by ``end_id``, into full pieces and a rest.

    Null text counts as empty: one piece that holds only the closing id.
    """
    path = send_file(docs.sparkSession, path or bpe.default_path())
    schema = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = bpe.vocab(path, bpe.LibraryVocab)
        close = int(end_id).to_bytes(4, "little")
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for doc_id, raw in zip(batch.column(0).to_pylist(), v.encode_batch(batch.column(1).to_pylist()), strict=True):
                raw += close
                n = len(raw) // 4
                for lo in range(0, n, size):
                    part = raw[4 * lo : 4 * (lo + size)]
                    row = (doc_id, lo, len(part) // 4, zlib.crc32(part), n, np.frombuffer(part, "<i4") if with_ids else None)
                    for c, x in zip(cols, row, strict=True):
                        c.append(x)
            out = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=False)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                out.append(pa.array(cols[5], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths in a pack, number of such packs) for a histogram of lengths."""
    room: dict[int, list[tuple[list[int], int]]] = {}  # packs by the room left in them
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            widest = max(room, default=-1)
            if widest < length:
                room.setdefault(size - length, []).append(([length], left))
                break
            lengths, packs = room[widest].pop()
            if not room[widest]:
                del room[widest]
            n = min(packs, left)
            if packs > n:
                room.setdefault(widest, []).append((lengths, packs - n))
            room.setdefault(widest - length, []).append(([*lengths, length], n))
            left -= n
    return [p for r in sorted(room) for p in room[r]]


def places(patterns: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first ranks, first sequence and offset of each slot that takes pieces of it."""
    slots: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for lengths, packs in patterns:
        offset = 0
        for x in lengths:
            slots.setdefault(x, []).append((taken.get(x, 0), sequence, offset))
            taken[x] = taken.get(x, 0) + packs
            offset += x
        sequence += packs
    return {x: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for x, rows in slots.items()}


def pack(docs: DataFrame, path: str | None = None, size: int = 1024, end_id: int = 0, with_ids: bool = False, per_salt: int = 50_000) -> DataFrame:
    """Pack the ids of all documents into sequences of at most ``size``.

    Returns per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset (and the ids on request). Null and empty texts give one piece with the
    closing id; repeated rows are packed each on their own; an empty table gives no
    rows. Other columns are not read. The slot table that tasks receive has at most
    one row per (pattern, position): it grows with ``size``, not with the data.
    """
    spark = docs.sparkSession
    cut = stage(pieces(docs, path, size, end_id, with_ids), "pieces")
    histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most `size` rows
    salts = sum(histogram.values()) // per_salt + 1
    keyed = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = keyed.groupBy("length", "salt").count()
    base = counts.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start")) - 1
    ranked = keyed.withColumn("rank", rank).join(base.hint("shuffle_merge"), ["length", "salt"])
    slots = spark.sparkContext.broadcast(places(shortest_pack_first(histogram, size)))

    @F.pandas_udf("struct<sequence_id long, offset long>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(), rank.to_numpy()
        seq, off = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
        for x in np.unique(n):
            first, sequence, offset = slots.value[int(x)]
            at = n == x
            k = np.searchsorted(first, r[at], "right") - 1
            seq[at], off[at] = sequence[k] + r[at] - first[k], offset[k]
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    out = ranked.withColumn("place", place("length", (F.col("base") + F.col("rank")).cast("long")))
    cols = ["doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "place.sequence_id", "place.offset"]
    return out.select(*cols, *(["ids"] if with_ids else []))
