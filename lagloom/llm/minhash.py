"""Near-duplicate groups by Order MinHash and banded alignment.

The k-mers of a text are its five-word shingles. For each of ``bands`` hash functions
the sketch takes the ``take`` least occurrence-labelled shingles (the second
occurrence of a shingle is another element than the first) and keeps them in text
order; the key of a band is the hash of that ordered list, so two texts agree in a
band when they share those shingles in the same order. Texts that share a key are
candidates, and a pair links if an alignment of its words, inside the band that the threshold
allows, matches enough of them in order: matched / (n + m - matched) >= similarity. This is
the edit similarity that the sketch is sensitive to: a changed word costs one word of the
alignment, not the five shingles that hold it.

Buckets are never expanded into all their pairs. In a round every member of a
bucket meets the bucket's pivots: one in the first rounds, which take a few bands, then more
bands, then the rest, so that what few bands join is not compared again in the others; 64 in
the round after them, then twice as many each time. Members that one component already joins need no more comparisons, and pivots that
have met all others leave. Rounds go on while a bucket that is not one component has more
members or words left than a task may hold; what remains is settled bucket by bucket in a task,
where histograms of the words rule out most pairs with certainty. Word sequences
that are equal are one class from the start.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagloom.llm.common import components, stage, unstage

_WORD = re.compile(r"\w+")
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def word_hashes(ws: list[str], known: dict[str, int]) -> np.ndarray:
    """32-bit hashes of words; ``known`` keeps those of frequent words."""
    if len(known) > 500_000:
        known.clear()
    for w in [w for w in set(ws) if w not in known]:
        known[w] = xxhash.xxh32_intdigest(w)
    return np.fromiter(map(known.__getitem__, ws), np.uint32, len(ws))


def shingles(h: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of k successive words; a text of fewer words has one shingle of all of them."""
    k = min(k, len(h))
    if not k:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = _mix(out + h[i : len(h) - k + 1 + i].astype(np.uint64) + np.uint64(k))
    return out


def labelled(s: np.ndarray) -> np.ndarray:
    """Each shingle with the number of its earlier occurrences mixed in."""
    if len(s) < 2:
        return s
    order = np.argsort(s, kind="stable")
    t = s[order]
    first = np.concatenate([[True], t[1:] != t[:-1]])
    if first.all():
        return s
    at = np.arange(len(s))
    nth = at - np.maximum.accumulate(np.where(first, at, 0))
    out = np.empty_like(s)
    out[order] = np.where(nth > 0, _mix(t + nth.astype(np.uint64)), t)
    return out


def sketch(s: np.ndarray, bands: int, take: int) -> np.ndarray:
    """Key of each band: the hash of the ``take`` least labelled shingles in text order."""
    e = labelled(s)
    # shingles are well mixed, so that the high half of a product with an odd number is hash enough
    odd = _mix(np.arange(1, bands + 1, dtype=np.uint64)) | np.uint64(1)
    h = (e[None, :] * odd[:, None] >> np.uint64(32)).astype(np.uint32)
    at = np.sort(np.argpartition(h, take - 1, axis=1)[:, :take], axis=1) if len(e) > take else np.tile(np.arange(len(e)), (bands, 1))
    keys = np.arange(1, bands + 1, dtype=np.uint64)
    for column in e[at].T:
        keys = _mix(keys + column)
    return keys


def matched(a: np.ndarray, b: np.ndarray, similarity: float) -> int:
    """Most elements that an alignment of a and b matches in order, or -1 if that is below the threshold.

    The threshold leaves room for so many unmatched elements only, so cells further
    off the diagonal are outside the band. Rows are bit vectors.
    """
    n, m = len(a), len(b)
    need = similarity * (n + m) / (1 + similarity)
    if min(n, m) < need - 1e-9:
        return -1
    head = 0
    low = min(n, m)
    diff = np.flatnonzero(a[:low] != b[:low])
    head = int(diff[0]) if len(diff) else low
    a, b = a[head:], b[head:]
    low = min(len(a), len(b))
    diff = np.flatnonzero(a[::-1][:low] != b[::-1][:low])
    tail = int(diff[0]) if len(diff) else low
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if len(a) and len(b):
        ca, na = np.unique(a, return_counts=True)
        cb, nb = np.unique(b, return_counts=True)
        _, ia, ib = np.intersect1d(ca, cb, assume_unique=True, return_indices=True)
        if head + tail + int(np.minimum(na[ia], nb[ib]).sum()) < need - 1e-9:  # more can't match in any order
            return -1
        width = int(n + m - 2 * need) + 1
        spots: dict[int, int] = {}
        for i, x in enumerate(a.tolist()):
            spots[x] = spots.get(x, 0) | 1 << i
        row = full = (1 << len(a)) - 1
        band = (1 << (2 * width + 1)) - 1
        for j, x in enumerate(b.tolist()):
            at = spots.get(x, 0)
            if at:
                hit = row & at & (band << (j - width) if j > width else band >> (width - j))
                row = ((row + hit) | (row - hit)) & full
        middle = len(a) - row.bit_count()
    else:
        middle = 0
    got = head + tail + middle
    return got if got >= need - 1e-9 else -1


def sketches(docs: DataFrame, bands: int, take: int, shingle: int) -> DataFrame:
    """doc_id, hash of the word sequence, number of words, keys; texts without a word don't occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ws = words(text)
                if ws:
                    s = shingles(word_hashes(ws, known), shingle)
                    rows.append((doc_id, xxhash.xxh3_128_digest(" ".join(ws)), len(ws), sketch(s, bands, take).view(np.int64)))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            types = [pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "same", "n", "keys"])

    return docs.select("doc_id", "text").filter("doc_id is not null").mapInArrow(run, "doc_id long, same binary, n int, keys array<long>")


def _hash_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, int] = {}
    for batch in batches:
        raw = [word_hashes(words(t), known).tobytes() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["doc_id", "words"])


def _compare(similarity: float):
    """Rows sorted by (pivot, salt), the pivot's own row first, to links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pivot = None, None
        for batch in batches:
            out = []
            for p, salt, member, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                s = np.frombuffer(raw, np.uint32)
                if (p, salt) != at:
                    at, pivot = (p, salt), None
                if member == p:
                    pivot = s
                elif pivot is not None:
                    got = matched(pivot, s, similarity)
                    if got >= 0:
                        out.append((p, member, got / (len(pivot) + len(s) - got)))
            cols = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["a", "b", "similarity"])

    return run


def settle(words: list[np.ndarray], component: list[int], similarity: float) -> list[tuple[int, int, float]]:
    """Links between members of a bucket that join components; members are sequences of words."""
    n = np.array([len(w) for w in words])
    h = np.stack([np.bincount((w & 255).astype(np.int64), minlength=256) for w in words]).astype(np.int32)
    first: dict[int, int] = {}
    root = [first.setdefault(c, i) for i, c in enumerate(component)]

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    out = []
    for i in range(1, len(words)):
        # unmatched words are at least those by which the histograms differ
        room = (n[i] + n[:i]) * (1 - similarity) / (1 + similarity)
        for j in np.flatnonzero(np.abs(h[:i] - h[i]).sum(axis=1) <= room + 1e-9).tolist():
            a, b = find(i), find(j)
            if a != b and (got := matched(words[i], words[j], similarity)) >= 0:
                root[max(a, b)] = min(a, b)
                out.append((i, j, got / (n[i] + n[j] - got)))
    return out


def _settle(similarity: float):
    """Rows sorted by bucket to links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def solve() -> pa.RecordBatch:
            links = settle([h[2] for h in held], [h[1] for h in held], similarity) if len(held) > 1 else []
            cols = list(zip(*((held[i][0], held[j][0], s) for i, j, s in links), strict=True)) or [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["a", "b", "similarity"])

        for batch in batches:
            for bucket, doc_id, component, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if bucket != at:
                    if held:
                        yield solve()
                    at, held = bucket, []
                held.append((doc_id, component, np.frombuffer(raw, np.uint32)))
        if held:
            yield solve()

    return run


#: First bands of the rounds with one pivot.
TURNS = (0, 4, 12)


def turn(band: str) -> Column:
    """Number of the round in which a band is taken first."""
    return F.expr(" + ".join(f"int({band} >= {t})" for t in TURNS[1:]))


def near_duplicates(
    docs: DataFrame, similarity: float = 0.8, shingle: int = 5, bands: int = 32, take: int = 3, pivots: int = 64, per_task: int = 2000, at_once: int = 4000, most_words: int = 8_000_000
) -> DataFrame:
    """One row per document: doc_id, group_id (smallest doc_id of its group), n_copies (documents with the same words), kept.

    Links inside a joined component aren't all enumerated, so there is no count of
    them. A document whose text is null or has no word links with nothing, nor does
    one without doc_id: it is its own group (group_id null without doc_id) and is kept. Rows
    that repeat a doc_id stay as they are, with the group of the least words hash.
    Texts shorter than a shingle link with equal texts only. An empty table gives no rows. A
    task holds one text and its words at a time, and settles at most ``at_once`` members and
    ``most_words`` words of a bucket, so long texts take their pivots one by one. Other
    columns are not read.
    """
    base = stage(sketches(docs, bands, take, shingle), "sketches")
    same = base.groupBy("same").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    same = stage(same, "classes")
    rows = same.select("rep", "n", F.posexplode("keys").alias("band", "key")).select("rep", "n", F.xxhash64("band", "key").alias("bucket"), turn("band").alias("turn"))
    full = rows.groupBy("bucket").agg(F.count("*").alias("c")).filter("c > 1").select("bucket")
    active = stage(rows.join(full.hint("shuffle_merge"), "bucket").withColumn("component", F.col("rep")).distinct(), "buckets")
    texts = stage(
        docs.filter("doc_id is not null").select("doc_id", "text")
        .join(active.select(F.col("rep").alias("doc_id")).distinct().hint("shuffle_merge"), "doc_id")
        .mapInArrow(_hash_words, "doc_id long, words binary"),
        "words",
    )
    links, tested, rounds, spent = None, None, -len(TURNS), [texts]
    while True:
        slot = F.pmod(F.xxhash64("rep"), F.lit(1 if rounds < 0 else pivots << rounds))
        mixed = active.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("bucket")
        live = stage(active.join(mixed.hint("shuffle_merge"), "bucket"), "live")
        spent += [active, live]
        crowded = live.groupBy("bucket").agg(F.count("*").alias("c"), F.sum("n").alias("s"), F.min("rep").alias("lo"), F.bit_xor(F.xxhash64("rep")).alias("set"))
        # what a task holds at once is bounded in members and in words (four bytes each)
        most = crowded.agg(F.max(F.greatest(F.col("c") / at_once, F.col("s") / most_words))).first()[0]
        if most is None:
            break
        if rounds >= 0 and most <= 1:
            # buckets of several bands with the same members are settled once
            once = crowded.groupBy("c", "lo", "set").agg(F.min("bucket").alias("bucket")).select("bucket")
            found = (
                live.join(once.hint("shuffle_merge"), "bucket").join(texts.hint("shuffle_merge"), F.col("rep") == F.col("doc_id"))
                .select("bucket", "doc_id", "component", "words").repartition("bucket").sortWithinPartitions("bucket", "doc_id")
                .mapInArrow(_settle(similarity), "a long, b long, similarity double")
            )
            found = stage(found, "links")
            links = found if links is None else links.union(found)
            break
        now = live if rounds >= 0 else live.filter(F.col("turn") == len(TURNS) + rounds)
        heads = now.groupBy("bucket", slot.alias("slot")).agg(F.min(F.struct(F.xxhash64("rep").alias("r"), "rep", "n", "component")).alias("p"))
        # stored, so that adaptive execution can split a crowded bucket in the join
        heads = stage(heads.select("bucket", F.col("p.rep").alias("pivot"), F.col("p.n").alias("pn"), F.col("p.component").alias("pc")).distinct(), "heads")
        met = (
            now.join(heads.hint("shuffle_merge"), "bucket")
            .filter(f"component <> pc and least(n, pn) >= {similarity} * greatest(n, pn) - 1e-9")
            .select(F.least("pivot", "rep").alias("a"), F.greatest("pivot", "rep").alias("b"), "pivot")
            .groupBy("a", "b").agg(F.min("pivot").alias("pivot"))
        )
        if tested is not None:
            met = met.join(tested.hint("shuffle_merge"), ["a", "b"], "left_anti")
        met = stage(met, "pairs")
        spent += [heads, met]
        if met.limit(1).count():
            pairs = met.select("pivot", F.when(F.col("pivot") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("member"))
            size = pairs.groupBy("pivot").agg((F.count("*") / per_task + 1).cast("int").alias("salts"))
            salted = pairs.join(size.hint("shuffle_merge"), "pivot").select("pivot", F.pmod(F.xxhash64("member"), F.col("salts")).cast("int").alias("salt"), "member")
            ends = salted.union(size.select("pivot", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("pivot").alias("member")))
            found = (
                ends.join(texts.hint("shuffle_merge"), ends.member == texts.doc_id)
                .select("pivot", "salt", "member", "words", (F.col("member") != F.col("pivot")).alias("later"))
                .repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "later")
                .select("pivot", "salt", "member", "words")
                .mapInArrow(_compare(similarity), "a long, b long, similarity double")
            )
            found = stage(found, "links")
            links = found if links is None else links.union(found)
            done = met.select("a", "b")
            tested = done if tested is None else tested.union(done)
            comp = components(links)
            spent.append(comp)
            live = live.drop("component").join(comp.hint("shuffle_merge"), F.col("rep") == F.col("id"), "left").withColumn("component", F.coalesce("component", "rep")).drop("id")
        out = heads.select("bucket", F.col("pivot").alias("rep"))
        active = stage(live.join(out.hint("shuffle_merge"), ["bucket", "rep"], "left_anti"), "buckets")
        rounds += 1
    if links is None:
        joined = same.select("same", "n_copies", F.col("rep").alias("group_id"))
    else:
        comp = components(links).withColumnRenamed("component", "group_id")
        spent.append(links)
        joined = (
            same.join(comp.hint("shuffle_merge"), same.rep == comp.id, "left")
            .select("same", "n_copies", F.coalesce("group_id", "rep").alias("group_id"))
        )
    for t in spent:
        unstage(t)
    of_doc = (
        base.select("doc_id", "same").join(joined.hint("shuffle_merge"), "same")
        .groupBy("doc_id").agg(F.min(F.struct("same", "group_id", "n_copies")).alias("g"))
    )
    return (
        docs.select("doc_id").join(of_doc.hint("shuffle_merge"), "doc_id", "left")
        .select(
            "doc_id", F.coalesce("g.group_id", "doc_id").alias("group_id"), F.coalesce("g.n_copies", F.lit(1)).alias("n_copies"),
            F.coalesce(F.col("g.group_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
        )
    )
