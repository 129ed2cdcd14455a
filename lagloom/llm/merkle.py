"""Merkle manifest of a table, with a proof for every row, by nested-struct rollup.

Rows are ranked inside their group; the octal digits of a rank are the path from the root
of the group's tree to its leaf. A block is ``8 ** levels`` leaves in a row. Inside of a
block the digit columns are grouped away, the last one first, each time nesting the structs
of the children below their digest; one shuffle by block serves all these groupings. Tops
of blocks are nodes of the next stage, until a group has one node; then the groups are
nodes of one more tree, up to the root.

Proofs come down the same way. A stage's nodes and the proofs of its blocks are one table
(a union), so the rollup that nests the nodes picks up the block's proof too; a transform
turns nested structs into one entry for each node with its siblings, and an explode deals
them out. A nested row holds one block, whatever the table's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagloom.llm.common import stage, unstage

FAN_BITS = 3
FAN = 1 << FAN_BITS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sealed(c: Column) -> Column:
    """A value with its length in bytes; ``-`` for null."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, lang, grp (not null, in the order of lang), leaf, tampered (leaf of the altered row, else null)."""
    tampered = {"text": F.translate("text", _UPPER, _LOWER)}
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return docs.select(
        "doc_id", "lang", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("grp"),
        digest(*(sealed(F.col(c)) for c in FIELDS)).alias("leaf"),
        F.when(hit, digest(*(sealed(tampered.get(c, F.col(c))) for c in FIELDS))).alias("tampered"),
    )


def ranked(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``pos`` (from 0 in its grp, in the order of ``order``) and ``n`` (rows of its grp).

    A range sort stored as it is; then ranks are row numbers inside of a part plus the rows
    of the group in earlier parts, of which there is one count for each part and group.
    Neither a large group nor many equal keys fall to one task. ``order`` must tell all rows
    apart.
    """
    keys = [F.col("grp"), *(F.asc_nulls_first(c) for c in order)]
    laid = stage(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), "sorted")
    x = laid.withColumn("part", F.shiftright("at", 33))
    whole = Window.partitionBy("grp")
    counts = x.groupBy("part", "grp").agg(F.min("at").alias("lo"), F.count("*").alias("c"))
    starts = counts.select("part", "grp", "lo", (F.sum("c").over(whole.orderBy("part")) - F.col("c")).alias("before"), F.sum("c").over(whole).alias("n"))
    out = stage(x.join(starts.hint("shuffle_merge"), ["part", "grp"]).withColumn("pos", F.col("at") - F.col("lo") + F.col("before")).drop("at", "part", "lo", "before"), "ranked")
    unstage(laid)
    return out


def _rollup(rows: DataFrame, levels: int) -> DataFrame:
    """One row per block: grp, block, n, hash (its top), below (nested children), up.

    ``rows``: grp, pos, n, hash, below; rows of proofs have block and up, and no hash.
    A level at which the group has one node left passes that node on unhashed.
    """
    x = rows.withColumns({f"d{j}": F.shiftright("pos", FAN_BITS * j).bitwiseAND(F.lit(FAN - 1)) for j in range(levels)})
    x = x.drop("pos").repartition("grp", "block")
    keys = ["grp", "block", *(f"d{j}" for j in reversed(range(levels)))]
    for j in range(levels):
        keys = keys[:-1]
        child = F.when(F.col("hash").isNotNull(), F.struct(F.col(f"d{j}").alias("d"), "hash", "below"))
        x = x.groupBy(*keys).agg(F.max("n").alias("n"), F.first("up", ignorenulls=True).alias("up"), F.sort_array(F.collect_list(child)).alias("below"))
        one = F.get("below", F.lit(0)).getField("hash")
        hashed = F.sha2(F.array_join(F.transform("below", lambda c: c.hash), ""), 256)
        x = x.withColumn("hash", F.when((F.size("below") > 0) & (F.col("n") > FAN**j), hashed).otherwise(one))
    return x


def tops(nodes: DataFrame, levels: int) -> DataFrame:
    """Nodes of the next stage: one for each block."""
    rows = nodes.select("grp", "pos", "n", "hash", F.shiftright("pos", FAN_BITS * levels).alias("block"), F.lit(None).cast("long").alias("below"), F.lit(None).cast("long").alias("up"))
    size = FAN**levels
    return _rollup(rows, levels).select(
        "grp", F.col("block").alias("pos"), F.shiftright(F.col("n") + (size - 1), FAN_BITS * levels).alias("n"), "hash", F.struct(F.col("block").alias("pos")).alias("below")
    )


def _side(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda c: c.hash), "")


def _entries(below: Column, n: Column, level: int) -> Column:
    """Array of (item, hash, path) of all nodes of a block, from its nested children."""

    def entries(e: Column, i: Column) -> Column:
        step = F.struct(
            _side(F.slice(below, F.lit(1), i)).alias("before"), _side(F.slice(below, i + 2, F.lit(FAN))).alias("after"), (n > FAN**level).alias("hashed")
        )
        if not level:
            return F.array(F.struct(e.below.alias("item"), e.hash.alias("hash"), F.array(step).alias("path")))
        return F.transform(_entries(e.below, n, level - 1), lambda p: F.struct(p.item.alias("item"), p.hash.alias("hash"), F.concat(p.path, F.array(step)).alias("path")))

    return F.flatten(F.transform(below, entries))


def prove(nodes: DataFrame, ups: DataFrame, levels: int) -> DataFrame:
    """grp, item, hash, path (steps up to the root), subroot, root of each node; ``ups`` has those of the blocks."""
    block = F.shiftright("pos", FAN_BITS * levels).alias("block")
    up = "struct<path:array<struct<before:string,after:string,hashed:boolean>>,subroot:string,root:string>"
    rows = nodes.select("grp", "pos", "n", "hash", block, "below", F.lit(None).cast(up).alias("up"))
    none = [F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in ("pos", "n", "hash")]
    rows = rows.unionByName(ups.select("grp", *none, "block", F.lit(None).cast(nodes.schema["below"].dataType).alias("below"), F.struct("path", "subroot", "root").alias("up")))
    x = _rollup(rows, levels)
    x = x.select("grp", "up", F.explode(_entries(F.col("below"), F.col("n"), levels - 1)).alias("e"))
    return x.select("grp", "e.item", "e.hash", F.concat("e.path", "up.path").alias("path"), "up.subroot", "up.root")


def _climb(nodes: DataFrame, most: int, levels: int) -> list[DataFrame]:
    """Stages of nodes from ``nodes`` up to one node per group; ``most`` nodes in a group at first."""
    out = [nodes]
    while len(out) == 1 or most > 1:
        out.append(stage(tops(out[-1], levels), "nodes"))
        most = -(-most // FAN**levels)
    return out


def manifest(docs: DataFrame, levels: int = 3) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Leaves ascend by doc_id inside of a lang, null first; rows that share a doc_id follow
    their leaves, and rows alike in all fields stand next to each other. A null field is
    ``-``, an empty text ``0:``. Rows without doc_id are not tampered with. An empty table
    gives no rows. Other columns are not read. Only digests are shuffled, so the length of
    texts does not matter after the first pass.
    """
    flat = stage(leaves(docs).withColumn("row", F.monotonically_increasing_id()), "leaves")
    base = ranked(flat, ["doc_id", "leaf", "row"])
    unstage(flat)
    nodes = base.select("grp", "pos", "n", F.col("leaf").alias("hash"), F.struct("doc_id", "tampered").alias("below"))
    most = base.agg(F.max("n")).first()[0] or 1
    trees = _climb(nodes, most, levels)
    langs = ranked(trees[-1].select(F.lit("").alias("grp"), F.col("grp").alias("of"), "hash"), ["of"])
    heads = langs.select("grp", "pos", "n", "hash", F.struct("pos", "of").alias("below"))
    crown = _climb(heads, langs.agg(F.max("n")).first()[0] or 1, levels)

    step = "array<struct<before:string,after:string,hashed:boolean>>"
    ups = crown[-1].select("grp", F.col("pos").alias("block"), F.array().cast(step).alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("hash").alias("root"))
    for stage_nodes in reversed(crown[:-1]):
        found = stage(prove(stage_nodes, ups, levels), "proofs")
        ups = found.select("grp", F.col("item.pos").alias("block"), "path", "subroot", "root")
    ups = found.select(F.col("item.of").alias("grp"), F.lit(0).cast("long").alias("block"), "path", F.col("hash").alias("subroot"), "root")
    for stage_nodes in reversed(trees[1:-1]):
        found = stage(prove(stage_nodes, ups, levels), "proofs")
        ups = found.select("grp", F.col("item.pos").alias("block"), "path", "subroot", "root")
    p = prove(nodes, ups, levels)
    folded = F.aggregate(
        "path", F.coalesce("item.tampered", "hash"), lambda at, s: F.when(s.hashed, F.sha2(F.concat(s.before, at, s.after), 256)).otherwise(at)
    )
    siblings = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s.before, s.after)), ""), 256)
    out = p.select("item.doc_id", F.col("hash").alias("leaf"), "subroot", "root", siblings.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
