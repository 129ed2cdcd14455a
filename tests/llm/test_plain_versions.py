"""Trained parts against plain versions of their steps, and inputs that would reach the driver or grow without bound."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagloom.llm import bpe, common, htmlextract, labelled, minhash, quality, toxicity, vafile


def test_ftrl_steps_equal_the_plain_rule():
    rng = random.Random(1)
    rows = [(sorted(rng.sample(range(20), 4)), rng.randint(0, 1)) for _ in range(200)]
    model = toxicity.Ftrl(20, alpha=0.1, beta=1.0, l1=0.4, l2=0.5)
    z, n = [0.0] * 21, [0.0] * 21

    def weight(i):
        l1 = 0.0 if i == 20 else 0.4
        return 0.0 if abs(z[i]) <= l1 else (math.copysign(l1, z[i]) - z[i]) / ((1.0 + math.sqrt(n[i])) / 0.1 + 0.5)

    for at, y in rows:
        at = [*at, 20]
        w = {i: weight(i) for i in at}
        g = 1 / (1 + math.exp(-sum(w.values()))) - y
        for i in at:
            s = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.1
            z[i] += g - s * w[i]
            n[i] += g * g
        model.update(np.array(at), y)
    assert np.allclose(model.z, z) and np.allclose(model.n, n)
    assert np.allclose(model.weights(np.arange(21)), [weight(i) for i in range(21)]) and (model.weights(np.arange(20)) == 0).any()


def test_subword_steps_equal_the_plain_rule():
    texts = [("good words here", 1), ("bad 123 bad bad", 0), ("more good text", 1), ("", 0)]
    model, plain = quality.Subwords(6, 3), quality.Subwords(6, 3)
    model.train(texts, epochs=2, rate=0.5)
    V, U, b = plain.vectors.copy(), plain.output.copy(), plain.bias.copy()
    rows = [(plain.counts(t), y) for t, y in texts if t]
    for k in range(2 * len(rows)):
        (at, n), y = rows[k % len(rows)]
        lr, share = 0.5 * (1 - k / (2 * len(rows))), (n / n.sum()).astype(np.float32)
        mean = sum(s * V[i] for i, s in zip(at, share, strict=True))
        p = np.exp(U @ mean + b)
        p = p / p.sum() - np.eye(2)[y]
        back = p @ U
        U, b = U - lr * np.outer(p, mean), b - lr * p
        for i, s in zip(at, share, strict=True):
            V[i] = V[i] - lr * s / share.max() * back
    assert np.allclose(model.vectors, V, atol=1e-6) and np.allclose(model.output, U, atol=1e-6) and np.allclose(model.bias, b, atol=1e-6)


def test_subword_buckets_are_those_of_each_token_alone():
    tokens = ["a", "Straße", "x1y2", "漢字", "....", "hello", "hello"]
    flat, of = quality.buckets(tokens, 10)
    for i, t in enumerate(tokens):
        alone, _ = quality.buckets([t], 10)
        assert sorted(flat[of == i].tolist()) == sorted(alone.tolist()) and len(alone) == 2 + sum(max(0, len(t) + 3 - n) for n in (3, 4, 5))
    assert len(quality.buckets([], 10)[0]) == 0


def test_gradients_of_the_labeller():
    model = htmlextract.BiLstm(bits=8, dim=3, hidden=4, seed=1)
    pages = [htmlextract.leaf_blocks(p, True) for p in ("<article class='x y'><p>One two<p>three <div>q</div></article><nav><a>four</a></nav>", "plain<div>a b c<p>d</div>e")]
    coded = [htmlextract.encode(b, {}, model.bits) for b in pages]
    labels = [np.array([htmlextract.rule_label(b[1]) for b in p], float) for p in pages]

    def loss():
        return -sum(np.log(np.where(y > 0, p, 1 - p)).sum() for p, y in zip(model.scores(coded), labels, strict=True)) / sum(map(len, labels))

    state: dict = {}
    model.step(coded, labels, state, 0.0)
    rng = np.random.default_rng(0)
    for name in model.p:
        g = state[name][0] / 0.1
        for at in map(tuple, rng.permutation(np.argwhere(np.abs(g) > 1e-9))[:6]):
            was = model.p[name][at]
            model.p[name][at] = was + 1e-6
            up = loss()
            model.p[name][at] = was - 1e-6
            down = loss()
            model.p[name][at] = was
            assert math.isclose((up - down) / 2e-6, g[at], rel_tol=1e-3, abs_tol=1e-7)


@pytest.mark.parametrize("page", ["<div>" * 50_000 + "x", "<div>x" * 50_000, "<li>" + "<div>" * 50_000 + "</a></section>" * 5_000, "<a" * 100_000, '<a "' * 50_001 + ">", "<table>" * 20_000 + "<td>" * 20_000 + "q"])
def test_deep_and_broken_pages_take_linear_time(page):
    began = time.process_time()
    blocks = htmlextract.leaf_blocks(page, True)
    if blocks:
        coded = htmlextract.encode(blocks, {}, 8)
        assert len(coded.node) == len(blocks) and len(coded.parent) <= 50_002
    assert time.process_time() - began < 10


def test_unclosed_elements_swallow_the_rest():
    texts = lambda p: [b[0] for b in htmlextract.leaf_blocks(p, True)]
    assert texts("<script>var x = 1") == [] and texts("<p>a<!-- b > c") == ["a"] and texts("<p>a<!-- b > c --> d < e") == ["a d < e"] and texts("<p>x<script>1</script>tail") == ["xtail"]


def test_a_labelled_id_that_repeats_sends_one_text(spark):
    docs = spark.range(20_000).select(F.lit(3).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(6, "long " * 100_000), (9, None), (12, "other")], "doc_id long, text string"))
    labels = spark.createDataFrame([(3, 1), (3, 0), (6, 0), (9, 0), (12, 0), (None, 1)], "doc_id long, toxic int")
    got = labelled.sample(docs, labels, "toxic", 100)
    held = {r.doc_id for r in docs.filter(labelled.held_out()).select("doc_id").distinct().collect()}
    want = {i for i in (3, 9, 12) if i not in held}  # the long text teaches nothing
    assert len(got) == len(want) and all(y == (t.startswith("text")) for t, y in got)
    rows = common.sample_of(docs, "doc_id", 2, "text")
    assert len(rows) == 2


def test_thresholds_decide(spark):
    docs = spark.createDataFrame([(1, "fine words"), (2, ""), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    for threshold, want in ((0.0, 1), (1.1, 0)):
        assert {r.predicted for r in toxicity.classify(docs, labels, threshold).collect()} == {want}
        assert {r.predicted for r in quality.classify(docs, labels.withColumnRenamed("toxic", "quality"), threshold).collect()} == {want}


def test_very_long_white_space_is_encoded():
    tokenizers = pytest.importorskip("tokenizers")
    hf = tokenizers.Tokenizer.from_file(bpe.default_path())
    v = bpe.LibraryVocab(bpe.default_path())
    v.run = 1000
    for t in (" " * 200_000 + "a", ("ab " * 40 + " " * 50 + "\n c") * 2000, "x" * 5000 + " <|endoftext|>  y"):
        assert np.frombuffer(next(v.encode_batch([t])), "<u4").tolist() == hf.encode(t, add_special_tokens=False).ids


def test_pairs_at_the_threshold_share_a_band():
    """Recall where it is promised: of pairs that are alike by 0.8 and more, nearly all become candidates."""
    rng, hit, n = random.Random(9), 0, 0
    while n < 300:
        a = [rng.randrange(10**6) for _ in range(rng.randint(60, 400))]
        b = list(a)
        for _ in range(rng.randint(1, max(1, len(a) // 60))):
            b[rng.randrange(len(b))] = rng.randrange(10**6)
        sa, sb = (minhash.shingles(np.array(x, np.uint32)) for x in (a, b))
        got = minhash.matched(sa, sb, 0.8)
        if got < 0 or got == len(sa):
            continue
        n += 1
        hit += bool((minhash.sketch(sa, 12, 3) == minhash.sketch(sb, 12, 3)).any())
    assert hit >= 0.99 * n


def test_exact_scores_beyond_doubles():
    q, x = [2.0**40 + 1, -3.0], [2.0**20 + 1, 5.0]
    rows = [(1, 1e30, q, x, [7])]
    import pyarrow as pa

    types = [pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int64())]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["query_id", "upper", "q", "vector", "members"])
    out = pa.Table.from_batches(vafile._read_best(5)(iter([batch]))).to_pylist()
    assert out == [{"query_id": 1, "rank": 1, "vec_id": 7, "score": (2**40 + 1) * (2**20 + 1) - 15}]
