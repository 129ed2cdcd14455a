"""Queries of this folder's operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lagloom.llm import bpe, egojoin, htmlextract, licences, merkle, minhash, packing, quality, resampling, suffixdedup, tokencounts, toxicity, vafile
from lagloom.llm.common import stage, table


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"))


def op3_ego_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return egojoin.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_va_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.top_k(table(spark, sf_dir, "embeddings"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.remove_repeats(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tokencounts.revisions(table(spark, sf_dir, "documents"))
    return tokencounts.update(stage(tokencounts.trees(docs, with_edits=True), "trees"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlextract.extract(table(spark, sf_dir, "pages"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


_ALL = (
    op1_minhash, op2_bpe, op3_ego_join, op4_va_file, op5_packing, op6_toxicity, op7_suffix_dedup, op8_token_counts, op9_quality, op10_html_extract,
    op11_resampling, op12_licences, op13_merkle,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


_VALID = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"

#: CRC-32 table by shifts: each entry is a byte after eight steps.
_CRC_TABLE = "tab AS (SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS tab FROM range(256) r(b))"


def _crc(text: str) -> str:
    """SQL of the unsigned CRC-32 of a string's UTF-8 bytes; ``tab`` is the table."""
    codes = f"list_transform(range(1, strlen({text}) * 2, 2), lambda i: ('0x' || substr(hex({text}), i, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])), 4294967295)"


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP11 = f"""WITH {_CRC_TABLE},
 d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents), t AS (SELECT {_WORDS} AS w FROM benchmark),
 dw AS (SELECT r, unnest(w) AS w FROM d), tw AS (SELECT unnest(w) AS w FROM t),
 b AS (SELECT w, {_crc("w")} % 10000 AS b FROM (SELECT w FROM dw UNION SELECT w FROM tw), tab),
 s AS (SELECT b, count(*) AS n FROM dw JOIN b USING (w) GROUP BY b), t2 AS (SELECT b, count(*) AS n FROM tw JOIN b USING (w) GROUP BY b),
 g AS (SELECT b.b, floor(1000 * ln((coalesce(any_value(t2.n), 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000)::DOUBLE / ((coalesce(any_value(s.n), 0) + 1)::DOUBLE * ((SELECT count(*) FROM tw) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM (SELECT DISTINCT b FROM b) b LEFT JOIN s ON s.b = b.b LEFT JOIN t2 ON t2.b = b.b GROUP BY b.b),
 x AS (SELECT r, sum(gain)::BIGINT AS weight FROM dw JOIN b USING (w) JOIN g USING (b) GROUP BY r),
 y AS (SELECT r, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id)[:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN x USING (r)),
 z AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id, r) AS rank, count(*) OVER () AS n FROM y WHERE n_features >= 20 AND doc_id IS NOT NULL)
 SELECT doc_id, n_features, weight, score, rank::BIGINT AS rank FROM y LEFT JOIN (SELECT r, rank FROM z WHERE rank <= 10 * n // 100) k USING (r)"""

_TEMPLATES = ", ".join(f"({i}, '{label}', '{wording}', {2 if i < len(licences.PHRASES) else 3})" for i, (wording, label) in enumerate((*licences.PHRASES, *licences.NOTICES)))

_OP12 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS words FROM documents),
 t AS (SELECT template, label, k, string_split(wording, ' ') AS s FROM (VALUES {_TEMPLATES}) x(template, label, wording, k)),
 g AS (SELECT template, label, k, len(s) - k + 1 AS grams, s, unnest(range(len(s) - k + 1)) AS place FROM t),
 gram AS (SELECT template, label, k, grams, place, array_to_string(s[place + 1:place + k], ' ') AS gram FROM g),
 p AS (SELECT r, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS pos FROM d),
 n AS (SELECT r, pos, w, lead(w) OVER o AS w1, lead(w, 2) OVER o AS w2 FROM p WINDOW o AS (PARTITION BY r ORDER BY pos)),
 two AS (SELECT r, pos, w || ' ' || w1 AS gram, 2 AS k FROM n UNION ALL SELECT r, pos, w || ' ' || w1 || ' ' || w2, 3 FROM n),
 v AS (SELECT r, template, label, k, grams, pos - place AS start, list(DISTINCT place) AS place FROM two JOIN gram USING (gram, k) GROUP BY ALL),
 m AS (SELECT *, list(place) OVER (PARTITION BY r, template ORDER BY start RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM v),
 e AS (SELECT r, label, start, k = 2 AND len(place) = grams AS whole, len(list_distinct(flatten(near))) / grams AS share FROM m),
 f AS (SELECT r, count(*) FILTER (whole) AS n_base, min(start) FILTER (whole) AS lo, max(start) FILTER (whole) AS hi, max(share) AS score,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (whole) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (whole OR share >= 0.6) AS labels FROM e GROUP BY r)
 SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
 FROM d LEFT JOIN f USING (r)"""


def _sealed(c: str) -> str:
    return f"coalesce(strlen(({c})::VARCHAR)::VARCHAR || ':' || ({c})::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_sealed(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Trees of the langs and the tree of their roots are one recursion each; a proof climbs both.
_OP13 = f"""WITH RECURSIVE {_CRC_TABLE},
 l AS (SELECT doc_id, lang, {_leaf("text")} AS leaf, CASE WHEN {_crc("doc_id::VARCHAR")} % 3 = 0 THEN {_leaf(_LOWERED)} END AS bad FROM documents, tab),
 r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER () AS id FROM l),
 nodes(lang, level, pos, n, hash) AS (SELECT lang, 0, pos, n, leaf FROM r UNION ALL
  SELECT lang, level + 1, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(hash, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY lang, level, pos // 8),
 sub AS (SELECT lang, hash AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
 crown(level, pos, n, hash) AS (SELECT 0, pos, n, subroot FROM sub UNION ALL
  SELECT level + 1, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(hash, '' ORDER BY pos)) FROM crown WHERE n > 1 GROUP BY level, pos // 8),
 steps AS (SELECT r.id, n.level, n.pos, n.hash, n.pos < r.pos // (8 ** n.level)::BIGINT AS before FROM r JOIN nodes n ON n.lang IS NOT DISTINCT FROM r.lang AND n.n > 1 AND n.pos // 8 = (r.pos // (8 ** n.level)::BIGINT) // 8 AND n.pos <> r.pos // (8 ** n.level)::BIGINT
  UNION ALL SELECT r.id, 100 + k.level, k.pos, k.hash, k.pos < s.pos // (8 ** k.level)::BIGINT FROM r JOIN sub s ON s.lang IS NOT DISTINCT FROM r.lang JOIN crown k ON k.n > 1 AND k.pos // 8 = (s.pos // (8 ** k.level)::BIGINT) // 8 AND k.pos <> s.pos // (8 ** k.level)::BIGINT),
 side AS (SELECT id, level, coalesce(string_agg(hash, '' ORDER BY pos) FILTER (before), '') AS b, coalesce(string_agg(hash, '' ORDER BY pos) FILTER (NOT before), '') AS a FROM steps GROUP BY id, level),
 levels AS (SELECT DISTINCT r.id, n.level FROM r JOIN (SELECT DISTINCT lang, level FROM nodes WHERE n > 1) n ON n.lang IS NOT DISTINCT FROM r.lang UNION SELECT r.id, 100 + k.level FROM r, (SELECT DISTINCT level FROM crown WHERE n > 1) k),
 path AS (SELECT v.id, row_number() OVER (PARTITION BY v.id ORDER BY v.level) AS step, coalesce(b, '') AS b, coalesce(a, '') AS a FROM levels v LEFT JOIN side USING (id, level)),
 fold(id, step, cur) AS (SELECT id, 0::BIGINT, coalesce(bad, leaf) FROM r UNION ALL SELECT f.id, p.step, sha256(p.b || f.cur || p.a) FROM fold f JOIN path p ON p.id = f.id AND p.step = f.step + 1),
 proof AS (SELECT id, sha256(string_agg(b || a, '' ORDER BY step)) AS proof FROM path GROUP BY id)
 SELECT r.doc_id, r.leaf, s.subroot, k.hash AS root, coalesce(proof.proof, sha256('')) AS proof_sha256, f.cur AS folded_root, f.cur = k.hash AS verified
 FROM r JOIN sub s ON s.lang IS NOT DISTINCT FROM r.lang JOIN crown k ON k.n = 1 JOIN (SELECT id, max_by(cur, step) AS cur FROM fold GROUP BY id) f ON f.id = r.id LEFT JOIN proof ON proof.id = r.id"""

#: Encoding, packing, training, edits, alignment and whole-corpus windows have no workable SQL; tests hold them against libraries and brute force.
_SQL = {
    "op3_ego_join": f"""WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE {_VALID} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= 0.9),
 reach(vec_id, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.vec_id, e.b FROM reach JOIN e ON e.a = reach.r)
 SELECT vec_id, coalesce((SELECT count(*) FROM e WHERE e.a = x.vec_id), 0)::BIGINT AS n_links, min(r)::BIGINT AS component_id, min(r) = vec_id AS kept FROM reach x GROUP BY vec_id""",
    "op4_va_file": f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE {_VALID}),
 s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 50 = 0),
 r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s) SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op11_resampling": _OP11,
    "op12_licences": _OP12,
    "op13_merkle": _OP13,
}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
