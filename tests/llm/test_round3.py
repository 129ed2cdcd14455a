"""Resampling, licence scan and manifest against their SQL and plain versions, on given and odd tables."""

import hashlib
import itertools
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lagloom.llm import common, htmlextract, licences, merkle, minhash, queries, resampling

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(LOWER))


ODD = [
    (1, None, None, None, None), (2, "", "", "", 0), (3, " !?", "en", "a", 3), (None, "GNU General Public License no id", "en", None, 5), (None, None, None, None, None),
    (4, "the MIT license, the mit-license; MIT\nLicense MIT LICENCE", "en", "b", 9), (5, "cc by cc by cc", "xx", "b", 9), (6, "worK under the Apache LicenKe apache license", "xx", "b", 9),
    (7, "tie tie", "en", "c", 7), (7, "tie tie", "en", "c", 7), (7, "tie other", "en", "c", 7), (-8, "éÉ\U0001f600 x1 " * 30, "é", "d", 1),
    (9, "w" * 100_000 + " apache license " + "x y " * 60_000, "en", "d", 1), (2**62, "Licensed under the shiny Apache License, Version 2.0", "en", "e", 2),
    (11, "permission is hereby granted free of charge to every person obtaining even a copy of this software", None, "e", 2),
]
ODD += [(100 + i, " ".join(f"Word{(i * j) % 17}" for j in range(40)), "en", "f", i) for i in range(70)]


@pytest.fixture(scope="module")
def odd(spark):
    common.ship(spark)
    df = spark.createDataFrame(ODD, SCHEMA).repartition(3)
    # further columns with names that the operators use themselves
    return df.withColumns({c: F.lit("clash") for c in ("row", "rank", "score", "pos", "grp", "n", "hash", "leaf", "words", "label", "position", "weight")})


def norm(rows):
    return Counter(tuple(f"{v:.12g}" if isinstance(v, float) else v for v in r) for r in rows)


def from_sql(con, sql):
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), norm([tuple(r[i] for i in order) for r in rel.fetchall()])


NEW = ("op11_resampling", "op12_licences", "op13_merkle")


@pytest.mark.parametrize("name", NEW)
def test_given_tables(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries.queries()[name](spark, sf_dir)
    cols, want = from_sql(con, queries.oracle_sql()[name])
    assert sorted(df.columns) == cols
    assert norm([tuple(r[c] for c in cols) for r in df.collect()]) == want


def test_resampling_odd(spark, odd):
    target = spark.createDataFrame([(1, "word1 word2 tie"), (2, None), (3, "x x")], "item_id long, text string")
    got = resampling.resample(odd, target).collect()
    s, t = Counter(), Counter()
    for side, texts in ((s, [r[1] for r in ODD]), (t, ["word1 word2 tie", "x x"])):
        for x in texts:
            side.update(zlib.crc32(w.encode()) % 10_000 for w in words(x))
    all_s, all_t = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    rows = []
    for i, x, *_ in ODD:
        w = words(x)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in (zlib.crc32(v.encode()) % 10_000 for v in w))
        h = None if i is None else int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(w), weight, None if h is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((r for r in rows if r[1] >= 20 and r[0] is not None), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(able[: len(able) * 10 // 100]):
        r[4] = k + 1
    assert norm(map(tuple, got)) == norm(map(tuple, rows)) and len(able) > 60
    assert resampling.resample(odd.limit(0), target).count() == 0
    assert resampling.resample(odd, target.limit(0)).count() == len(ODD)


def test_radix_sort_orders_all_keys(spark):
    rng = random.Random(5)
    edge = [0, -1, 1, 2**63 - 1, -(2**63), 2**40]
    data = [(rng.choice(edge) if rng.random() < 0.3 else rng.randint(-50, 50), rng.choice([7, 8, -(2**60)])) for _ in range(3000)]
    df = common.stage(spark.createDataFrame(data, "a long, b long").repartition(5).withColumn("row", F.monotonically_increasing_id()), "test")
    got = resampling.radix_sort(df, [("a", True), ("b", False)], bits=5, blocks=8).orderBy("position").collect()
    assert [r.position for r in got] == list(range(3000))
    assert [(r.a, r.b) for r in got] == sorted(data, key=lambda x: (-x[0], x[1]))
    ties = [(r.a, r.b, r.row) for r in got]
    assert all(x[2] < y[2] for x, y in zip(ties, ties[1:], strict=False) if x[:2] == y[:2])
    same = common.stage(spark.range(100).select(F.lit(3).cast("long").alias("a"), F.col("id").alias("row")), "test")
    assert sorted(r.position for r in resampling.radix_sort(same, [("a", False)]).collect()) == list(range(100))


def test_long_texts_come_in_pieces():
    raw = ("Ab " * 1000 + "c" * 500 + " d").encode()
    for longest in (1, 2, 3):
        known = resampling._Buckets(97)
        whole = list(resampling.features(raw, known, longest))
        parts = list(resampling.features(raw, known, longest, piece=64))
        assert len(parts) > 10 and sum(n for n, _ in parts) == whole[0][0] == 1002
        assert (np.bincount(np.concatenate([b for _, b in parts]), minlength=97) == np.bincount(whole[0][1], minlength=97)).all()
        assert len(whole[0][1]) == sum(1002 - r + 1 for r in range(1, longest + 1))


def test_licences_odd(spark, odd):
    got = licences.scan(odd).collect()
    cols, want = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"), []
    for i, x, *_ in ODD:
        w, at, labels = words(x), [], set()
        for p, label in licences.PHRASES:
            p = p.split()
            hits = [k for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
            at += hits
            labels |= {label} if hits else set()
        want.append((i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))))
    assert norm([tuple(r[c] for c in cols) for r in got]) == norm(want)
    by = {r.doc_id: r for r in got}
    assert "apache-2.0" in by[2**62].labels and by[11].labels == "mit" and by[11].score >= 0.6 and not by[11].n_base  # words changed inside of a notice
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    assert licences.scan(odd.limit(0)).count() == 0


def plain_manifest(rows):
    """The contract, step by step."""
    seal = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    leaf = lambda r, x: sha("".join(map(seal, (r[0], r[3], r[2], r[4], x))))

    def tree(level):
        """Digest of all, and for each leaf its steps (before, after)."""
        steps = [[] for _ in level]
        under = [[i] for i in range(len(level))]
        while len(level) > 1:
            up, below = [], []
            for lo in range(0, len(level), 8):
                run = level[lo : lo + 8]
                for k in range(len(run)):
                    for i in under[lo + k]:
                        steps[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
                up.append(sha("".join(run)))
                below.append(sum(under[lo : lo + 8], []))
            level, under = up, below
        return level[0], steps

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = [sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1]))) for g in langs]
    trees = [tree([leaf(r, r[1]) for r in g]) for g in groups]
    root, top = tree([t[0] for t in trees])
    out = []
    for g, (sub, steps), head in zip(groups, trees, top, strict=True):
        for r, s in zip(g, steps, strict=True):
            path = s + head
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            at = leaf(r, r[1].translate(LOWER) if bad and r[1] is not None else r[1])
            for a, b in path:
                at = sha(a + at + b)
            out.append((r[0], leaf(r, r[1]), sub, root, sha("".join(a + b for a, b in path)), at, at == root))
    return out


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_manifest_odd(spark, odd, levels):
    cols = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    got = merkle.manifest(odd, levels=levels).select(*cols).collect()
    assert norm(map(tuple, got)) == norm(plain_manifest(ODD)) and {r.verified for r in got} == {True, False}


def test_manifest_of_one_row_and_none(spark, odd):
    one = odd.filter("doc_id = 5")
    r = merkle.manifest(one).collect()
    assert len(r) == 1 and r[0].leaf == r[0].subroot == r[0].root and r[0].proof_sha256 == hashlib.sha256(b"").hexdigest()
    assert merkle.manifest(odd.limit(0)).count() == 0


def test_near_copies_are_found(spark):
    """Of all pairs that are alike by 0.4 and more in shingles, 0.9 are joined; of those that are hardly alike, none."""
    where = "/root/testdata/sf0.01"
    if not os.path.exists(where):
        pytest.skip("no sf0.01")
    docs = common.table(spark, where, "documents")
    known: dict = {}
    s = {r.doc_id: minhash.shingles(minhash.word_hashes(minhash.words(r.text), known)) for r in docs.collect()}
    holders = defaultdict(set)
    for i, x in s.items():
        for v in set(x.tolist()):
            holders[v].add(i)
    shared = Counter(pair for d in holders.values() if 1 < len(d) < 60 for pair in itertools.combinations(sorted(d), 2))
    group = {r.doc_id: r.group_id for r in minhash.near_duplicates(docs).collect()}
    near, joined, wrong = 0, 0, 0
    for (a, b), n in shared.items():
        if len(s[a]) == len(s[b]) and (s[a] == s[b]).all():
            continue
        got = minhash.matched(s[a], s[b], 0.4) if n > 0.3 * min(len(s[a]), len(s[b])) else -1
        same = group[a] == group[b]
        near, joined, wrong = near + (got >= 0), joined + (got >= 0 and same), wrong + (n < 0.2 * min(len(s[a]), len(s[b])) and same)
    assert near > 90 and joined >= 0.9 * near and not wrong


P1 = "The committee met on Tuesday to discuss the new plan for the river, which has been delayed since last spring because of rising costs and a lack of skilled workers."
P2 = "Several members said that they would vote against it unless the town found another way to pay for the work, and the mayor promised to return with an answer soon."
P3 = "I have lived by that river for thirty years and never saw anyone from the council come down to look at it, so I doubt that much will change this time."
HEAD, FOOT = "<html><body><nav><ul><li><a href=/>Home</a><li><a href=/news>News</a></ul></nav>", "<footer>&copy; 2020 Town Gazette</footer></body></html>"
#: Pages in other markup than those of the table, with the main text as a reader would mark it.
HAND_LABELLED = {
    "no telling name": (f"<div class=header>Site name</div><div class=x9><p>{P1}</p><p>{P2}</p></div><div class=comments><p>Nice article, thanks!</p></div>", f"{P1}\n{P2}"),
    "plain text": (f"{P1} {P2}", f"{P1} {P2}"),
    "bare paragraphs": (f"<p>{P1}</p><p>{P2}</p>", f"{P1}\n{P2}"),
    "part of a name": (f"{HEAD}<article><h1>Head line</h1><p class='comment-free'>{P1}</p><p>{P2}</p></article>{FOOT}", f"Head line\n{P1}\n{P2}"),
    "wrapper with part of a name": (f"{HEAD}<article><div class='related-content'><p>{P1}</p><p>{P2}</p></div></article>{FOOT}", f"{P1}\n{P2}"),
    "blog": (f"<html><body><div class='site-header'><a href=/>Blog</a></div><div class=wrap><div class='entry'><p>{P1}</p><p>{P2}</p></div><div class=sidebar><ul><li><a href=/x>One</a></ul></div></div><div class='site-footer'>me</div></body></html>", f"{P1}\n{P2}"),
    "long reader comment": (f"{HEAD}<article><p>{P1}</p><p>{P2}</p></article><div class=comments><p>{P3}</p></div>{FOOT}", f"{P1}\n{P2}"),
}


def test_pages_of_other_markup(spark):
    pages = common.table(spark, "/root/testdata/sf0.01" if os.path.exists("/root/testdata/sf0.01") else "/root/testdata/sf0.001", "pages")
    more = spark.createDataFrame([(10**9 + i, "u", h) for i, (h, _) in enumerate(HAND_LABELLED.values())], "page_id long, url string, html string")
    got = {r.page_id - 10**9: r.text for r in htmlextract.extract(pages.unionByName(more)).collect() if r.page_id >= 10**9}
    assert {k: got[i] for i, k in enumerate(HAND_LABELLED)} == {k: want for k, (_, want) in HAND_LABELLED.items()}


def test_labels_look_at_whole_names():
    blocks = htmlextract.leaf_blocks("<article><p class='comment-free'>A</p><div class='related-content'><p>B</p></div><div class=comments><p>C</p></div></article>")
    assert [htmlextract.rule_label(b[1]) for b in blocks] == [1, 1, 0]
