"""Token counts that follow edits.

Each document keeps a segment tree over its pre-tokens: leaves hold runs of pieces
that begin at cuts which no change further away can move (a space before a
non-space that begins no special token), inner nodes the sums of characters and
tokens below. An edit finds the leaves it touches by their character sums, takes
the leaf before in if the cut between them does not hold any more, encodes only
those leaves again, and updates the sums on the way up. What has grown beyond two
leaves is split; other leaves keep their counts.

Trees are a table: ``trees`` makes it, ``update`` takes edits and can return it for
the next edits, so that no later edit costs a full encoding.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagloom.llm import bpe
from lagloom.llm.common import send_file

_EDITS = "array<struct<start: long, length: long, text: string>>"
#: Columns of a table of trees: the text and, by leaf, its characters and tokens.
TREE = ["doc_id", "text", "n_tokens", "n_pieces", "chars", "tokens"]
_TREE = "doc_id long, text string, n_tokens long, n_pieces long, chars array<int>, tokens array<int>"


class CountTree:
    """Characters and tokens of a text, by leaves of about ``width`` pieces."""

    def __init__(self, text: str, encode: bpe.Vocab, width: int = 32, chars: list[int] | None = None, tokens: list[int] | None = None):
        """Without counts by leaf (``chars``, ``tokens``) the text is encoded."""
        self.encode, self.width = encode, width
        self.encoded = 0  # pieces encoded so far
        marks = sorted(encode.special, key=len, reverse=True)
        self.spaced = any(" " in s for s in marks)  # such a token may span any cut
        self.cut = regex.compile(r" (?=\S)" + (f"(?!{'|'.join(map(regex.escape, marks))})" if marks else ""))
        if chars is None or tokens is None:
            leaves = self._leaves(self._pieces(text))
            self._lay(leaves, self._count(leaves))
        else:
            leaves, at = [], 0
            for n in chars:
                leaves.append(text[at : at + n])
                at += n
            self._lay(leaves or [""], list(tokens) or [0])

    def _pieces(self, text: str) -> list[str]:
        """Pieces of a text, each but the first with its leading space."""
        if not any(s in text for s in self.encode.special):
            units = bpe._units_of(text)
        elif self.spaced:
            return [text]
        else:
            units = self.cut.split(text)
        return [units[0], *(" " + u for u in units[1:])]

    def _leaves(self, pieces: list[str], parts: int | None = None) -> list[str]:
        """Pieces dealt into leaves of ``width``, or into so many parts."""
        n = self.width if parts is None else -(-len(pieces) // parts)
        return ["".join(pieces[i : i + n]) for i in range(0, len(pieces), n)]

    def _count(self, leaves: list[str]) -> list[int]:
        self.encoded += sum(len(self._pieces(x)) for x in leaves)
        return [len(raw) // 4 for raw in self.encode.encode_batch(leaves)]

    def _lay(self, leaves: list[str], tokens: list[int]) -> None:
        """Put leaves with their counts into a new tree."""
        self.leaves = leaves
        self.size = 1
        while self.size < len(leaves):
            self.size *= 2
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        self.chars[self.size : self.size + len(leaves)] = map(len, leaves)
        self.tokens[self.size : self.size + len(leaves)] = tokens
        for i in range(self.size - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _find(self, at: int) -> tuple[int, int]:
        """Leaf that holds character ``at`` and the offset there; the end is in the last leaf that has characters."""
        if not self.chars[1]:
            return 0, 0
        i, at = 1, min(at, self.chars[1] - 1)
        while i < self.size:
            i *= 2
            if at >= self.chars[i]:
                at -= self.chars[i]
                i += 1
        return i - self.size, at

    def edit(self, start: int, length: int, text: str) -> None:
        """Replace ``length`` characters from ``start`` on; both are held inside the text."""
        start = max(0, min(start, self.chars[1]))
        stop = max(start, min(start + max(0, length), self.chars[1]))
        a, off = self._find(start)
        if start == self.chars[1]:
            off = len(self.leaves[a])
        b = max(a, self._find(stop - 1 if stop > start else start)[0])
        if self.spaced:
            a, b, off = 0, len(self.leaves) - 1, start
        old = "".join(self.leaves[a : b + 1])
        new = old[:off] + text + old[off + stop - start :]
        while a and new and not self.cut.match(new):  # the cut before does not hold any more
            a -= 1
            new = self.leaves[a] + new
        pieces, slots = self._pieces(new), b - a + 1
        if len(pieces) <= 2 * self.width * slots:
            leaves = self._leaves(pieces, min(slots, -(-len(pieces) // self.width))) if new else []
            tokens = self._count(leaves)
            empty = slots - len(leaves)
            leaves, tokens = leaves + [""] * empty, tokens + [0] * empty
            for i, (leaf, n) in enumerate(zip(leaves, tokens, strict=True), a):
                self.leaves[i], self.chars[i + self.size], self.tokens[i + self.size] = leaf, len(leaf), n
            touched = {(i + self.size) // 2 for i in range(a, b + 1)}
            while touched and max(touched):
                for k in touched:
                    self._sum(k)
                touched = {k // 2 for k in touched}
            return
        leaves, tokens = self._leaves(pieces), self.tokens[self.size : self.size + len(self.leaves)]
        self._lay([*self.leaves[:a], *leaves, *self.leaves[b + 1 :]], [*tokens[:a], *self._count(leaves), *tokens[b + 1 :]])

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(self.leaves)

    def counts(self) -> tuple[list[int], list[int]]:
        """Characters and tokens of the leaves that hold any text."""
        n = len(self.leaves)
        both = [(c, t) for c, t in zip(self.chars[self.size : self.size + n], self.tokens[self.size : self.size + n], strict=True) if c]
        return [c for c, _ in both], [t for _, t in both]


def attach(df: DataFrame, edits: DataFrame, columns: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """``columns`` of documents (or of trees) with their edits (doc_id, seq, start, length, text) in order of seq; a document's edits are worked in one place."""
    one = F.struct("seq", "start", "length", F.coalesce("text", F.lit("")).alias("text"))
    per_doc = edits.groupBy(F.col("doc_id").alias("_e_id")).agg(F.sort_array(F.collect_list(one)).alias("_edits"))
    joined = df.select(*columns).join(per_doc.hint("shuffle_merge"), F.col("doc_id") == F.col("_e_id"), "left")
    return joined.select(*columns, F.transform("_edits", lambda e: F.struct(e["start"], e["length"], e["text"])).cast(_EDITS).alias("edits"))


def trees(docs: DataFrame, path: str | None = None, with_edits: bool = False) -> DataFrame:
    """The trees of documents as a table: doc_id, text, n_tokens, n_pieces (encoded), chars and tokens by leaf, and on request the column ``edits``.

    Null text counts as empty, and has no leaves; repeated rows have trees of their
    own; an empty table gives none. Other columns are not read. One pass; a very long
    text takes memory in proportion.
    """
    path = send_file(docs.sparkSession, path or bpe.default_path())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = bpe.vocab(path, bpe.LibraryVocab)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                tree = CountTree(text or "", v)
                rows.append((text or "", tree.n_tokens, tree.encoded, *tree.counts()))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            types = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            made = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *made, *batch.columns[2:]], [*TREE, *(["edits"] if with_edits else [])])

    given = docs.select("doc_id", "text", *([F.col("edits").cast(_EDITS).alias("edits")] if with_edits else []))
    return given.mapInArrow(run, _TREE + (f", edits {_EDITS}" if with_edits else ""))


def update(stored: DataFrame, path: str | None = None, with_trees: bool = False) -> DataFrame:
    """Token counts before and after the edits in column ``edits`` of a table of trees; only what an edit touches is encoded.

    Returns doc_id, n_tokens, n_tokens_edited, n_pieces (encoded when the tree was
    made), n_reencoded (encoded for the edits); with ``with_trees`` the columns of
    ``TREE`` after the edits, to be stored for the next ones. Null edits count as
    none, null fields of an edit as 0 and empty text; positions are code points and
    are held inside the text as it stands then. Rows are independent.
    """
    path = send_file(stored.sparkSession, path or bpe.default_path())
    names = TREE if with_trees else ["doc_id", "n_tokens", "n_tokens_edited", "n_pieces", "n_reencoded"]
    schema = _TREE if with_trees else ", ".join(f"{n} long" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = bpe.vocab(path, bpe.LibraryVocab)
        for batch in batches:
            rows = []
            for doc_id, text, pieces, chars, tokens, edits in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                tree = CountTree(text, v, chars=chars, tokens=tokens)
                before = tree.n_tokens
                for e in edits or []:
                    if e is not None:
                        tree.edit(e["start"] or 0, e["length"] or 0, e["text"] or "")
                if with_trees:
                    rows.append((doc_id, tree.text(), tree.n_tokens, pieces + tree.encoded, *tree.counts()))
                else:
                    rows.append((doc_id, before, tree.n_tokens, pieces, tree.encoded))
            cols = list(zip(*rows, strict=True)) or [[]] * len(names)
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())] if with_trees else [pa.int64()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return stored.select("doc_id", "text", "n_pieces", "chars", "tokens", F.col("edits").cast(_EDITS).alias("edits")).mapInArrow(run, schema)


def revisions(docs: DataFrame) -> DataFrame:
    """Documents with edits made from their own columns: drop the first line, put source and language in the middle, repeat the start near the end."""
    n = F.length("text")
    edit = lambda start, length, text: F.struct(start.cast("long").alias("start"), length.cast("long").alias("length"), text.alias("text"))
    return docs.withColumn(
        "edits",
        F.array(
            edit(F.lit(0), F.instr("text", "\n"), F.lit("")),
            edit(F.floor(n / 2), F.lit(0), F.concat(F.lit(" ["), F.coalesce("source", F.lit("")), F.lit(":"), F.coalesce("lang", F.lit("")), F.lit("] "))),
            edit(F.floor(n * 3 / 4), F.lit(12), F.substring("text", 1, 40)),
        ),
    )
