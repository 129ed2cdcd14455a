"""Text operators against the libraries and brute force, with odd and empty inputs."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagloom.llm import bpe, common, minhash, packing, quality, suffixdedup, tokencounts, toxicity

DOCS = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, " "), (4, "a"), (None, "no id at all"), (5, "x" * 5000), (6, "tie tie tie"), (6, "tie tie tie"), (7, "\n\n  \t é漢字 ½٣ <|endoftext|> don't")]


@pytest.fixture(scope="module")
def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(bpe.default_path())


@pytest.fixture(scope="module")
def odd(spark):
    common.ship(spark)
    # further columns with names that the operators use themselves
    df = spark.createDataFrame(ODD, DOCS)
    return df.withColumns({c: F.lit("clash") for c in ("score", "start", "length", "h", "d", "n", "group_id", "label", "rank", "source", "lang", "kept")})


def fuzz(n, seed):
    rng = random.Random(seed)
    alpha = ["a", "b", "the", "'s", " ", "  ", "\n", "1", "!", "½", "é", "漢", "<|endoftext|>", "‍", "\x1c", "\x85", "Ω", "ing "]
    return ["".join(rng.choice(alpha) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("kind", [bpe.Vocab, bpe.LibraryVocab])
def test_encoding_equals_library(tokenizer, kind):
    texts = [*fuzz(1500, 3), "a" * 3000, " " * 500 + "x", "The quick brown fox. " * 50]
    v = kind(bpe.default_path())
    got = [np.frombuffer(x, "<u4").tolist() for x in v.encode_batch(texts)]
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert got == want
    assert all(v.decode(ids) == tokenizer.decode(ids, skip_special_tokens=False) for ids in want)
    assert v.decode([222, 10]) == tokenizer.decode([222, 10], skip_special_tokens=False)


def test_encode_decode(spark, sf_dir, tokenizer, odd):
    for docs in (odd, common.table(spark, sf_dir, "documents")):
        texts = {(r.doc_id, r.text) for r in docs.collect()}
        want = Counter()
        for i, t in [(r.doc_id, r.text) for r in docs.collect()]:
            ids = tokenizer.encode(t or "", add_special_tokens=False).ids
            want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
        assert Counter(tuple(r) for r in bpe.encode_decode(docs).collect()) == want and texts
    assert bpe.encode_decode(odd.limit(0)).count() == 0


def test_packing(spark, sf_dir, tokenizer, odd):
    for docs in (odd, common.table(spark, sf_dir, "documents")):
        rows = packing.pack(docs).collect()
        ids = Counter()
        for r in docs.collect():
            full = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
            for lo in range(0, len(full), 1024):
                part = full[lo : lo + 1024]
                ids[r.doc_id, lo, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(full)] += 1
        assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == ids
        seqs = {}
        for r in rows:
            seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for parts in seqs.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 1024
    assert sum(r.length for r in rows) / (1024 * len(seqs)) > 0.9
    assert packing.pack(odd.limit(0)).count() == 0


def test_shortest_pack_first_places_every_piece():
    rng = random.Random(0)
    h = {n: rng.randint(1, 50) for n in rng.sample(range(1, 65), 40)}
    patterns = packing.shortest_pack_first(h, 64)
    used = Counter()
    for lengths, n in patterns:
        assert sum(lengths) <= 64
        for x in lengths:
            used[x] += n
    assert used == h
    assert packing.shortest_pack_first({}, 64) == []


def repeats(texts, size=200):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + size] for r in raws for i in range(len(r) - size + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - size + 1):
            if seen[r[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        runs = sum(1 for i in range(len(gone)) if gone[i] and (not i or not gone[i - 1]))
        out.append((len(r), sum(gone), runs, hashlib.sha256(bytes(x for x, k in zip(r, gone, strict=True) if not k)).hexdigest()))
    return out


@pytest.mark.parametrize("most", [4096, 3])
def test_suffix_dedup_equals_brute_force(spark, odd, most):
    rng = random.Random(5)
    words = ["ab", "é", "the", "zz", "qu", "x", "漢"]
    text = lambda n: "".join(rng.choice(words) + rng.choice(" abc") for _ in range(n))
    texts = [t for _, t in ODD] + ["a" * 1000, "ab" * 400]
    for b in [text(250) for _ in range(4)]:
        texts.append(b)
        for _ in range(3):
            c = list(b)
            for _ in range(rng.randint(1, 3)):
                i = rng.randrange(len(c))
                c[i : i + rng.randint(0, 3)] = text(1)
            texts.append("".join(c))
    passage = text(80)
    texts += [text(rng.randint(0, 80)) + passage + text(rng.randint(0, 80)) for _ in range(8)] + [passage * 3, texts[-1]]
    rows = [(i if i != 4 else None, t) for i, t in enumerate(texts)] + [(3, "a" * 1000)]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("d", "h", "spans", "at", "n")})
    got = Counter(tuple(r) for r in suffixdedup.remove_repeats(df, most=most).collect())
    assert got == Counter((i, *e) for (i, _), e in zip(rows, repeats([t for _, t in rows]), strict=True))
    assert suffixdedup.remove_repeats(df.limit(0)).count() == 0


def test_suffix_sort_orders_and_verifies(monkeypatch):
    rng = random.Random(2)
    strings = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 12))).encode() for _ in range(300)]
    group = np.sort(np.array([rng.randrange(9) for _ in strings]))
    want = sorted(range(300), key=lambda i: (group[i], strings[i]))
    order, common_ = suffixdedup.Suffixes(strings).verified_sort(group)
    assert [(group[i], strings[i]) for i in order] == [(group[i], strings[i]) for i in want]
    broken = suffixdedup.Suffixes(strings)
    broken.prefix = np.zeros_like(broken.prefix)  # every hash collides
    order2, common2 = broken.verified_sort(group)
    assert [(group[i], strings[i]) for i in order2] == [(group[i], strings[i]) for i in want] and common2.tolist() == common_.tolist()


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_banded_alignment_equals_full_table():
    rng = random.Random(4)
    for _ in range(300):
        a = [rng.randrange(30) for _ in range(rng.randint(1, 40))]
        b = list(a)
        for _ in range(rng.randint(0, 6)):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.randint(0, 2)] = [rng.randrange(30) for _ in range(rng.randint(0, 2))]
        n = lcs(a, b)
        want = n if b and n / (len(a) + len(b) - n) >= 0.8 else -1
        assert minhash.matched(np.array(a, np.uint64), np.array(b, np.uint64), 0.8) == want


@pytest.mark.parametrize("at_once", [1000, 2])
def test_near_duplicates_equal_all_pairs(spark, sf_dir, at_once):
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocab) for _ in range(40)]
    more = [(10_000 + i, " ".join([rng.choice(vocab) for _ in range(8)] + passage + [rng.choice(vocab) for _ in range(rng.randint(0, 8))])) for i in range(30)]
    more += [(1_000_000 + (i or 0), t) for i, t in ODD if i] + [(None, "no id")]
    docs = docs.unionByName(spark.createDataFrame(more, DOCS)).withColumn("group_id", F.lit("clash"))
    got = {r.doc_id: r for r in minhash.near_duplicates(docs, at_once=at_once).collect() if r.doc_id is not None}
    known: dict = {}
    s = {r.doc_id: minhash.word_hashes(minhash.words(r.text), known) for r in docs.collect() if r.doc_id is not None}
    root = {i: i for i in s}
    sure, found = 0, 0

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in s if len(s[i]))
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if minhash.matched(s[a], s[b], 0.8) >= 0:
                root[max(find(a), find(b))] = min(find(a), find(b))
                sa, sb = minhash.shingles(s[a]), minhash.shingles(s[b])
                if minhash.matched(sa, sb, 0.4) >= 0:  # alike enough to share a band
                    sure, found = sure + 1, found + (got[a].group_id == got[b].group_id)
    assert all(find(r.group_id) == find(i) for i, r in got.items())  # no group joins what alignments don't
    assert found >= 0.95 * sure > 0
    assert all(r.kept == (r.group_id == i) for i, r in got.items())
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_token_counts_follow_edits(spark, odd):
    v = bpe.LibraryVocab(bpe.default_path())
    size = lambda t: len(next(iter(v.encode_batch([t])))) // 4
    rng = random.Random(1)
    bits = ["a", "b", " ", "  ", "\n", "'s", "1", "!", "foo bar", "é", "<|endoftext|>", "\n\n x"]
    for _ in range(300):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 120)))
        tree = tokencounts.CountTree(t, v, width=rng.choice([1, 2, 4]))
        for _ in range(5):
            a, n, x = rng.randint(0, len(t) + 2), rng.randint(0, rng.choice([2, 60])), "".join(rng.choice(bits) for _ in range(rng.randint(0, 4)))
            tree.edit(a, n, x)
            t = t[: min(a, len(t))] + x + t[a + n :]
            assert tree.text() == t and tree.n_tokens == size(t)
    stored = common.stage(tokencounts.trees(tokencounts.revisions(odd), with_edits=True), "test-trees")
    new = tokencounts.update(stored, with_trees=True).collect()
    assert len(new) == len(ODD) and all(r.n_tokens == size(r.text) == sum(r.tokens) and len(r.text) == sum(r.chars) for r in new)
    got = tokencounts.update(stored).collect()
    assert sorted(r.n_tokens_edited for r in got) == sorted(r.n_tokens for r in new)
    edits = spark.createDataFrame([(4, 1, 0, 1, "bb"), (4, 2, 1, 0, None), (3, 1, 9, None, "end")], "doc_id long, seq long, start long, length long, text string")
    texts = {r.doc_id: r.text for r in tokencounts.update(tokencounts.attach(stored, edits, tokencounts.TREE), with_trees=True).collect()}
    assert texts[4] == "bb" and texts[3] == " end" and texts[1] == ""
    assert tokencounts.update(tokencounts.trees(odd.limit(0)).withColumn("edits", F.lit(None))).count() == 0


def test_edits_encode_what_they_touch_only():
    v = bpe.LibraryVocab(bpe.default_path())
    text = "one two three four " * 20_000
    tree = tokencounts.CountTree(text, v)
    long = "five six <|endoftext|> seven " * 2_000  # many leaves at once
    for start, length, new in ((200_000, 3, "x"), (100_000, 0, long), (0, 50_000, ""), (10, 0, "<|endoftext|>")):
        before = tree.encoded
        tree.edit(start, length, new)
        text = text[:start] + new + text[start + length :]
        assert tree.text() == text and tree.encoded - before < new.count(" ") + 200
    assert tree.n_tokens == len(next(iter(v.encode_batch([text])))) // 4
    kept = tokencounts.CountTree(text, v, 32, *tree.counts())
    assert kept.encoded == 0 and kept.n_tokens == tree.n_tokens


@pytest.mark.parametrize("op,label", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers_on_held_out_rows(spark, odd, op, label):
    big = "/root/testdata/sf0.01"
    docs, labels = common.table(spark, big, "documents"), common.table(spark, big, "labels")
    truth = {r.doc_id: r[label] for r in labels.collect()}
    rows = op.classify(docs, labels).collect()
    held = [(r.score, r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    pos, neg = [s for s, _, y in held if y], [s for s, _, y in held if not y]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert auc > 0.9
    flipped = labels.withColumn(label, F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col(label)).otherwise(F.col(label)))
    again = op.classify(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("yy")), flipped).collect()
    assert {r.doc_id: r.score for r in again} == {r.doc_id: r.score for r in rows}  # held-out labels, lang and source have no part
    few = op.classify(odd, labels).collect()
    assert len(few) == len(ODD) and all(0 <= r.score <= 1 for r in few)
    none = op.classify(odd, labels.limit(0)).collect()
    assert all(r.score == 0.5 for r in none)
    assert op.classify(odd.limit(0), labels).count() == 0
