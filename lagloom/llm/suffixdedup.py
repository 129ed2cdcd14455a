"""Removal of repeated byte strings by a hash-compared suffix sort.

A byte goes if a string of ``length`` bytes that covers it starts anywhere else,
in the same document or another; copies are judged on the input.

Sparse suffixes. Every window of ``length`` bytes names one anchor: its leftmost
least ``gram``-byte substring in hash order. Equal windows name the same anchor at
the same place, so only anchors that occur twice can lie in a repeated window, and
all that matters of an occurrence is its context: the bytes that such a window can
reach to the left and to the right.

* Occurrences are grouped by anchor, then by context (counts first, before any
  shuffle of rows). A context that occurs twice is covered whole.
* The different contexts of an anchor are sorted twice, by the suffix that starts
  at the anchor and by the reversed bytes before it. Suffixes are compared by their
  longest common extension, found by binary search over prefix polynomial hashes;
  a bottom-up mergesort makes all comparisons of a round at once. The extensions of
  neighbours are then compared byte by byte: if one differs from its hash, that
  batch is sorted by its bytes instead.
* Cutting both orders at the l-th byte gives classes of equal left and equal right
  parts; a window that starts l bytes before the anchor repeats exactly if its pair
  of classes occurs twice.
* Anchors with more different contexts than ``most`` (a passage that very many
  documents embed differently) never meet in one task: their windows are counted
  by hash with partial sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagloom.llm.common import stage, unstage

_BASE = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 22  # bytes of a text handled at once; neighbouring chunks overlap by a window


def _powers(n: int, base: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def gram_hashes(b: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all substrings of ``gram`` bytes, mixed so that their order is random."""
    h, size = b.astype(np.uint64) + np.uint64(1), 1
    acc, done = None, 0
    while True:  # doubling: the hash of 2n bytes from two of n bytes
        if gram & size:
            shift = np.uint64(pow(int(_BASE), size, 1 << 64))
            acc = h[: len(b) - size + 1] if acc is None else acc[: len(b) - done - size + 1] * shift + h[done : len(b) - size + 1]
            done += size
        if size * 2 > gram:
            break
        h = h[:-size] * np.uint64(pow(int(_BASE), size, 1 << 64)) + h[size:]
        size *= 2
    acc = acc ^ (acc >> np.uint64(31))
    acc = acc * np.uint64(0xBF58476D1CE4E5B9)
    return acc ^ (acc >> np.uint64(29))


def anchors(text: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of all windows of a text."""
    found = []
    for lo in range(0, max(1, len(text) - length + 1), _CHUNK):
        b = np.frombuffer(text[lo : lo + _CHUNK + length - 1], np.uint8)
        if len(b) < length:
            break
        h = gram_hashes(b, gram)
        key = h >> np.uint64(23) << np.uint64(23) | np.arange(len(h), dtype=np.uint64)
        width, size = length - gram + 1, 1
        while size * 2 <= width:
            key = np.minimum(key[:-size], key[size:])
            size *= 2
        if size < width:
            key = np.minimum(key[: len(key) - (width - size)], key[width - size :])
        at = np.unique(key & np.uint64((1 << 23) - 1)).astype(np.int64)
        found.append((at + lo, h[at].view(np.int64)))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    pos, at = np.unique(np.concatenate([p for p, _ in found]), return_index=True)
    return pos, np.concatenate([h for _, h in found])[at]


class Suffixes:
    """Byte strings compared by longest common extension over prefix polynomial hashes."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.size = np.array([len(s) for s in strings], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        buf = np.frombuffer(b"".join(strings), np.uint8)
        self.bytes = np.concatenate([buf, np.zeros(1, np.uint8)])
        n = len(buf) + 1
        terms = (buf.astype(np.uint64) + np.uint64(1)) * _powers(n, int(_BASE))[:-1]
        self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        self.unshift = _powers(n, pow(int(_BASE), -1, 1 << 64))

    def _hash(self, i: np.ndarray, n: np.ndarray) -> np.ndarray:
        s = self.start[i]
        return (self.prefix[s + n] - self.prefix[s]) * self.unshift[s]

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of strings i and j, pair by pair, by binary search."""
        lo, hi = np.zeros(len(i), np.int64), np.minimum(self.size[i], self.size[j])
        while np.any(lo < hi):
            mid = (lo + hi + 1) >> 1
            same = self._hash(i, mid) == self._hash(j, mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def before(self, i: np.ndarray, j: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether string i comes before j, or is equal to it where that counts."""
        n = self.extension(i, j)
        ei, ej = n == self.size[i], n == self.size[j]
        bi, bj = self.bytes[np.minimum(self.start[i] + n, len(self.bytes) - 1)], self.bytes[np.minimum(self.start[j] + n, len(self.bytes) - 1)]
        return np.where(ei & ej, or_equal, np.where(ei, True, np.where(ej, False, bi < bj)))

    def sort(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order within groups (equal numbers side by side), and each one's extension with its predecessor (-1: first of its group)."""
        n = len(group)
        first = np.concatenate([[True], group[1:] != group[:-1]]) if n else np.empty(0, bool)
        begin = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        ends = np.append(np.flatnonzero(first), n)
        end = np.repeat(ends[1:], np.diff(ends))
        order = np.arange(n)
        at = np.arange(n) - begin
        width = 1
        while n and width < np.max(end - begin):
            run = at // width
            mate = begin + (run ^ 1) * width
            lo, hi = np.minimum(mate, end), np.minimum(mate + width, end)
            base = lo.copy()
            right = (run & 1) == 1
            live = np.flatnonzero(lo < hi)
            while len(live):  # how many of the mate's run come first
                mid = (lo[live] + hi[live]) >> 1
                less = self.before(order[mid], order[live], right[live])
                lo[live] = np.where(less, mid + 1, lo[live])
                hi[live] = np.where(less, hi[live], mid)
                live = live[lo[live] < hi[live]]
            to = begin + (run >> 1) * 2 * width + (at - run * width) + (lo - base)
            new = np.empty(n, np.int64)
            new[to] = order
            order, width = new, width * 2
        common = np.full(n, -1, np.int64)
        inner = np.flatnonzero(~first)
        common[inner] = self.extension(order[inner - 1], order[inner])
        return order, common

    def verified_sort(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """sort(), with every extension held against the bytes; sorted by bytes if a hash misled."""
        order, common = self.sort(group)
        if self._true(order, common):
            return order, common
        order = np.array(sorted(range(len(group)), key=lambda i: (group[i], self.strings[i])), np.int64)
        for k in np.flatnonzero(common >= 0):
            a, b = self.strings[order[k - 1]], self.strings[order[k]]
            common[k] = next((x for x in range(min(len(a), len(b))) if a[x] != b[x]), min(len(a), len(b)))
        return order, common

    def _true(self, order: np.ndarray, common: np.ndarray) -> bool:
        for k in np.flatnonzero(common >= 0):
            a, b, n = self.strings[order[k - 1]], self.strings[order[k]], common[k]
            if a[:n] != b[:n] or (len(a) > n and len(b) > n and a[n] >= b[n]):
                return False
        return True


def repeated_windows(group: np.ndarray, left: list[bytes], right: list[bytes], count: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest l for which the window that starts l bytes before the anchor repeats; (1, 0) if none does."""
    n = len(group)
    lo, hi = np.full(n, length, np.int64), np.full(n, -1, np.int64)
    left_size, right_size = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    lo_order, lo_common = Suffixes([x[::-1] for x in left]).verified_sort(group)
    ro_order, ro_common = Suffixes(right).verified_sort(group)
    a, b = np.empty(n, np.int64), np.empty(n, np.int64)
    for l in range(length - gram + 1):
        ok = np.flatnonzero((left_size >= l) & (right_size >= length - l))
        if not len(ok):
            continue
        a[lo_order] = np.cumsum(lo_common < l)
        b[ro_order] = np.cumsum(ro_common < length - l)
        _, where = np.unique(a[ok] * (n + 1) + b[ok], return_inverse=True)
        twice = ok[np.bincount(where, weights=count[ok])[where] >= 2]
        lo[twice], hi[twice] = np.minimum(lo[twice], l), np.maximum(hi[twice], l)
    return np.where(hi < 0, 1, lo), np.where(hi < 0, 0, hi)


def occurrences(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Anchors of all documents: anchor, context, d, h, at (position, bytes to the left and to the right in one number, to keep rows short)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(5)]
            for d, h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = t.encode()
                pos, key = anchors(raw, length, gram)
                if not len(pos):
                    continue
                lo, hi = np.maximum(pos - (length - gram), 0), np.minimum(pos + length, len(raw))
                ctx = [xxhash.xxh3_64_intdigest(raw[a:b], p - a) for a, b, p in zip(lo.tolist(), hi.tolist(), pos.tolist(), strict=True)]
                cols = (key, np.array(ctx, np.uint64).view(np.int64), np.full(len(pos), d), np.full(len(pos), h), pos << 20 | (pos - lo) << 10 | (hi - pos))
                for c, x in zip(out, cols, strict=True):
                    c.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["anchor", "context", "d", "h", "at"])

    return docs.filter(F.octet_length("text") >= length).select("d", "h", "text").mapInArrow(
        run, "anchor long, context long, d long, h long, at long"
    )


def _sorted_classes(length: int, gram: int, at_once: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def solve(t: pa.Table) -> pa.RecordBatch:
            key, name = t.column("anchor").to_numpy(), t.column("context").to_numpy()
            t = t.filter(pa.array(np.concatenate([[True], (key[1:] != key[:-1]) | (name[1:] != name[:-1])])))
            key = t.column("anchor").to_numpy()
            group = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]))
            raw, cut = t.column("bytes").to_pylist(), t.column("left").to_pylist()
            lo, hi = repeated_windows(group, [r[:c] for r, c in zip(raw, cut, strict=True)], [r[c:] for r, c in zip(raw, cut, strict=True)], t.column("n").to_numpy(), length, gram)
            keep = lo <= hi
            cols = [key, t.column("context").to_numpy(), lo.astype(np.int16), hi.astype(np.int16)]
            return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in cols], ["anchor", "context", "lo", "hi"])

        for batch in batches:  # sorted by anchor; a group ends where the anchor changes
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= at_once:
                t = pa.Table.from_batches(held).combine_chunks()
                key = t.column("anchor").to_numpy()
                last = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
                if last:
                    yield solve(t.slice(0, last))
                held = t.slice(last).to_batches()
                rows = sum(b.num_rows for b in held)
        if rows:
            yield solve(pa.Table.from_batches(held).combine_chunks())

    return run


def _cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, wanted) to one row per wanted context with its bytes."""
    for batch in batches:
        rows = []
        for t, wanted in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            raw = t.encode()
            for w in wanted:
                pos, left, right = w["at"] >> 20, w["at"] >> 10 & 1023, w["at"] & 1023
                rows.append((w["anchor"], w["context"], w["n"], left, raw[pos - left : pos + right]))
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int16(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(cols, types, strict=True)], ["anchor", "context", "n", "left", "bytes"])


def _window_hashes(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int16(), pa.binary()]
        at = None
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                out: list[list] = [[] for _ in range(5)]
                for a, c, n, left, raw in zip(*(batch.slice(begin, 256).column(i).to_pylist() for i in range(5)), strict=True):
                    if (a, c) == at:
                        continue
                    at = (a, c)
                    for l in range(min(left, length - gram) + 1):
                        if left - l + length <= len(raw):
                            key = xxhash.xxh3_128_digest(raw[left - l : left - l + length], l)
                            for x, y in zip(out, (a, c, n, l, key), strict=True):
                                x.append(y)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["anchor", "context", "n", "l", "window"])

    return run


def spans(docs: DataFrame, length: int = 200, gram: int = 32, most: int = 8192) -> DataFrame:
    """(d, h, text, spans): each document with the byte ranges that repeat, unmerged; spans is null without any.

    docs: d, h, doc_id, text without nulls; d and h name a document, copies may share a name.
    """
    # a stored table on both sides of the join: adaptive execution can split a frequent anchor
    occ = stage(occurrences(docs, length, gram), "occurrences")
    per_anchor = occ.groupBy("anchor").agg(F.count("*").alias("c"), F.min("context").alias("lo_c"), F.max("context").alias("hi_c")).filter("c > 1")
    per_anchor = stage(per_anchor.select("anchor", (F.col("lo_c") != F.col("hi_c")).alias("mixed")), "repeated")
    hits = stage(occ.join(per_anchor.hint("shuffle_merge"), "anchor").select(*occ.columns, "mixed"), "anchors")
    unstage(occ)
    unstage(per_anchor)
    pos, left, right = F.expr("at >> 20"), F.expr("(at >> 10) & 1023L"), F.expr("at & 1023L")
    whole = F.struct((pos - left).alias("a"), (pos + right).alias("b"))
    classes = stage(
        hits.filter("mixed").groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(F.struct("d", "h", "at")).alias("first")), "contexts"
    )
    crowd = stage(classes.groupBy("anchor").agg((F.count("*") > most).alias("crowded")), "crowded")
    wanted = (
        classes.join(crowd.hint("shuffle_merge"), "anchor")
        .groupBy("first.d", "first.h", "crowded")
        .agg(F.collect_list(F.struct("anchor", "context", "n", "first.at")).alias("wanted"))
    )

    def cut(crowded: bool) -> DataFrame:
        some = wanted.filter(F.col("crowded") == crowded).drop("crowded")
        found = docs.join(some.hint("shuffle_merge"), ["d", "h"]).select("doc_id", "text", "wanted")
        # a document that occurs twice under one name gives its contexts twice; once is taken below
        return (
            found.mapInArrow(_cut_contexts, "anchor long, context long, n long, left short, bytes binary")
            .repartition("anchor", *(["context"] if crowded else [])).sortWithinPartitions("anchor", "context")
        )

    calm = cut(False).mapInArrow(_sorted_classes(length, gram, 8_000), "anchor long, context long, lo short, hi short")
    windows = cut(True).mapInArrow(_window_hashes(length, gram), "anchor long, context long, n long, l short, window binary")
    # one shuffle of the windows; a group of equal ones spills, it is never held
    twice = windows.withColumn("c", F.sum("n").over(Window.partitionBy("window"))).filter("c > 1")
    dense = twice.groupBy("anchor", "context").agg(F.min("l").alias("lo"), F.max("l").alias("hi"))
    solved = calm.unionByName(dense)
    part = hits.filter("mixed").join(solved.hint("shuffle_merge"), ["anchor", "context"])
    ranges = hits.filter("not mixed").select("d", "h", whole.alias("s")).unionByName(
        part.select("d", "h", F.struct((pos - F.col("hi")).alias("a"), (pos - F.col("lo") + length).alias("b")).alias("s"))
    )
    per_doc = ranges.groupBy("d", "h").agg(F.collect_set("s").alias("spans"))
    return docs.join(per_doc.hint("shuffle_merge"), ["d", "h"], "left")


def merge(spans: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _named(docs: DataFrame, *more: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce("doc_id", F.lit(-1)).alias("d"), F.xxhash64(text).alias("h"), "doc_id", text.alias("text"), *more)


def remove_repeats(docs: DataFrame, length: int = 200, gram: int = 32, most: int = 8192, with_text: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Remove every byte that a repeated string of ``length`` bytes covers.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256
    and on request the kept text (a character that a cut splits goes too) and the columns ``keep``. Null
    text counts as empty; texts shorter than ``length`` stay whole; rows that
    repeat a whole text lose all of it; rows with a null doc_id are kept. Columns
    other than doc_id and text are not read.
    """
    keep = keep or []
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", text string" if with_text else "")
    schema += "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, t, found in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                raw = t.encode()
                cuts = merge(found or [])
                ends = [0, *(x for c in cuts for x in c), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
                rows.append((doc_id, len(raw), len(raw) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]
            k = 6 if with_text else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(cols[:k], types[:k], strict=True)] + batch.columns[3:], names[:k] + keep)

    return spans(_named(docs, *keep), length, gram, most).select("doc_id", "text", "spans", *keep).mapInArrow(run, schema)
