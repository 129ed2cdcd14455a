"""Byte-level BPE encoding and decoding with shared prefixes.

A text is cut at every space that a non-space follows; the cut is always a
pre-token boundary, so each distinct piece is encoded once per task. The distinct
pre-tokens are inserted into a trie and walked depth first. The state of a prefix is
its last token: exactly one token that ends there fits behind the last token of the
rest, so a word's encoding is read back from the states on its path, and prefixes
that words share are computed once. Trie and pieces are kept between the batches and
tasks of a worker up to a fixed size and then begun anew.

The tokenizer file is a parameter; it is never trained here.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from lagloom.llm.common import send_file

#: The pre-token pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_PRE = regex.compile(PATTERN)
_ODD = re.compile(r" (?:\s|\Z)")
_CUT = re.compile(r" (?=\S)")
_VOCABS: dict[str, Vocab] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _at_hand(path: str) -> str:
    """The copy of a tokenizer file that Spark sent to this worker, or the file itself."""
    if SparkFiles._is_running_on_worker:
        sent = SparkFiles.get(os.path.basename(path))
        if os.path.exists(sent):
            return sent
    return path


def _byte_of_char() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocab:
    """Tokens, merges and the test whether two tokens stay apart when they stand side by side."""

    #: Pieces remembered between batches.
    keep = 800_000

    def __init__(self, path: str):
        with open(_at_hand(path), encoding="utf-8") as f:
            spec = json.load(f)
        back = _byte_of_char()
        to_bytes = lambda s: bytes(back[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.id_of = {to_bytes(s): i for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for b, i in self.id_of.items():
            self.bytes_of[i] = b
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        self.decimal = [str(i) for i in range(size)]
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.spaced: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {}
        self.prepare(vocab, spec["model"]["merges"])

    def prepare(self, vocab: dict[str, int], merges: list) -> None:
        """What the trie needs: merges by rank and parts, and which bytes begin or end tokens."""
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for n, m in enumerate(merges):
            left, right = m if isinstance(m, list) else m.split(" ")
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            self.rank[a, b] = n
            self.parts.setdefault(c, (n, a, b))
        self.begins = {b[:n] for b in self.id_of for n in range(len(b) + 1)}
        self.node_of, self.node_bytes, self.ends, self.steps = {b"": 0}, [b""], [()], {}
        self.apart: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.raw = [i.to_bytes(4, "little") for i in range(len(self.bytes_of))]
        self.sizes = [len(b) for b in self.bytes_of]
        self.clear_trie()

    def plain(self, word: bytes) -> list[int]:
        """Merge by merge; used only to see whether a token encodes to itself."""
        ids = [self.id_of[word[i : i + 1]] for i in range(len(word))]
        while len(ids) > 1:
            n, at = min((self.rank.get(p, 1 << 60), i) for i, p in enumerate(zip(ids, ids[1:], strict=False)))
            if n == 1 << 60:
                break
            ids[at : at + 2] = [self.id_of[self.bytes_of[ids[at]] + self.bytes_of[ids[at + 1]]]]
        return ids

    def stays(self, a: int, b: int) -> bool:
        """Whether the bytes of a then b encode to exactly these two tokens.

        Undo the later of the two tokens' merges step by step: a merge across the
        border spoils the pair if it would have come before the merge undone last.
        """
        x, y, before = a, b, 1 << 60
        while True:
            if self.rank.get((x, y), 1 << 60) < before:
                return False
            px, py = self.parts.get(x), self.parts.get(y)
            if px is None and py is None:
                return True
            # merges of equal rank run from the left: the left token's comes first
            if py is None or (px is not None and px[0] > py[0]):
                before, x = px[0], px[2]
            else:
                before, y = py[0] + 1, py[1]

    def _step(self, node: int, byte: int) -> int:
        """The longest suffix of node's bytes and byte with which some token begins; kept in a table once found."""
        s = self.node_bytes[node] + bytes((byte,))
        while s not in self.begins:
            s = s[1:]
        to = self.node_of.get(s)
        if to is None:
            to = self.node_of[s] = len(self.node_bytes)
            self.node_bytes.append(s)
            self.ends.append(tuple((self.id_of[s[i:]], len(s) - i) for i in range(len(s)) if s[i:] in self.id_of))
        self.steps[node << 8 | byte] = to
        return to

    def clear_trie(self) -> None:
        #: The trie: child of (node, byte), and of each node its last token and the suffix state it stands in.
        self.kids: dict[int, int] = {}
        self.last: list[int] = [0]
        self.suffix: list[int] = [0]

    def encode_words(self, words: Iterable[bytes], most_nodes: int = 500_000) -> list[bytes]:
        """Ids of each word as little-endian 32-bit bytes; states of prefixes already in the trie are reused."""
        apart, whole, ends, steps, raw, sizes = self.apart, self.whole, self.ends, self.steps, self.raw, self.sizes
        if len(self.last) > most_nodes:
            self.clear_trie()
        if len(apart) > 1_000_000:
            apart.clear()
        kids, last, suffix = self.kids, self.last, self.suffix
        out = []
        for w in words:
            node, path = 0, [0]
            for byte in w:
                key = node << 8 | byte
                child = kids.get(key)
                if child is None:
                    state = suffix[node] << 8 | byte
                    state = steps.get(state) or self._step(suffix[node], byte)
                    end = len(path)
                    for t, size in ends[state]:
                        if size < end:
                            p = path[-size] << 32 | t
                            ok = apart.get(p)
                            if ok is None:
                                ok = apart[p] = self.stays(p >> 32, t)
                        else:
                            ok = whole.get(t)
                            if ok is None:
                                ok = whole[t] = self.plain(w[:end]) == [t]
                        if ok:
                            break
                    child = kids[key] = len(last)
                    last.append(t)
                    suffix.append(state)
                node = child
                path.append(last[node])
            ids, at = [], len(w)
            while at:
                t = path[at]
                ids.append(raw[t])
                at -= sizes[t]
            ids.reverse()
            out.append(b"".join(ids))
        return out

    def learn(self, units: set[str], spaced: bool) -> None:
        """Encode units not seen yet; a unit is the text between two cuts, spaced if a space stands before it."""
        known, lead = (self.spaced, " ") if spaced else (self.first, "")
        new = {u for u in units if u not in known}
        words = [u for u in new if u.isalpha()]
        known.update(zip(words, self.encode_words([(lead + u).encode() for u in words]), strict=True))
        mixed = {u: _PRE.findall(lead + u) for u in new - set(words)}
        words = list({p for ps in mixed.values() for p in ps})
        code = dict(zip(words, self.encode_words([p.encode() for p in words]), strict=True))
        for u, ps in mixed.items():
            known[u] = b"".join([code[p] for p in ps])

    def encode_batch(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text as little-endian 32-bit bytes."""
        for lo, hi in _chunks(texts):
            cut = [self._units(t or "") for t in texts[lo:hi]]
            if len(self.spaced) > self.keep:
                self.spaced.clear()
            if len(self.first) > self.keep // 8:
                self.first.clear()
            spaced, first = set(), set()
            for parts in cut:
                for p in parts:
                    if isinstance(p, list):
                        first.add(p[0])
                        spaced.update(p[1:])
            self.learn(first, False)
            self.learn(spaced, True)
            sp, fi = self.spaced.__getitem__, self.first.__getitem__
            for parts in cut:
                out = []
                for p in parts:
                    if isinstance(p, list):
                        out.append(fi(p[0]))
                        out.extend(map(sp, p[1:]))
                    else:
                        out.append(int(p).to_bytes(4, "little"))
                yield b"".join(out)

    def _units(self, text: str) -> list:
        """Lists of units, and ids of special tokens between them."""
        if self.cut is not None and any(s in text for s in self.special):
            return [self.special[p] if i % 2 else _units_of(p) for i, p in enumerate(self.cut.split(text)) if p]
        return [_units_of(text)]

    def decode(self, ids: list[int]) -> str:
        """Text of ids; bytes that are no UTF-8 become U+FFFD, special tokens stay."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


class LibraryVocab(Vocab):
    """The same ids from tiktoken's encoder, for operators whose method is another one.

    Its pattern is PATTERN with possessive repeats. Texts are handed over in runs of
    at most ``run`` characters, cut where a pre-token ends; a run on which its regex
    gives up (very long white space) goes by pieces as in ``Vocab``.
    """

    run = 1_000_000

    def prepare(self, vocab: dict[str, int], merges: list) -> None:
        import tiktoken

        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
        self.core = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=self.id_of, special_tokens={})._core_bpe

    def encode_words(self, words: Iterable[bytes], most_nodes: int = 0) -> list[bytes]:
        one = self.core.encode_single_piece
        return [array("I", one(w)).tobytes() for w in words]

    def encode_batch(self, texts: list[str | None]) -> Iterator[bytes]:
        for t in texts:
            out = []
            marked = self.cut is not None and t and any(s in t for s in self.special)
            for i, p in enumerate(self.cut.split(t) if marked else [t or ""]):
                if i % 2:
                    out.append(self.special[p].to_bytes(4, "little"))
                else:
                    out.extend(map(self._ids, self._runs(p)))
            yield b"".join(out)

    def _runs(self, text: str) -> Iterator[str]:
        lo = 0
        while len(text) - lo > self.run:
            at = _CUT.search(text, lo + self.run)
            if at is None:
                break
            yield text[lo : at.start()]
            lo = at.start()
        yield text[lo:] if lo else text

    def _ids(self, text: str) -> bytes:
        try:
            return memoryview(self.core.encode_to_tiktoken_buffer(text, set())).tobytes()
        except ValueError:
            return next(super().encode_batch([text]))


def _units_of(text: str) -> list[str]:
    return _CUT.split(text) if _ODD.search(text) else text.split(" ")


def _chunks(texts: list, most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    lo = chars = 0
    for i, t in enumerate(texts):
        chars += len(t or "")
        if chars > most:
            yield lo, i + 1
            lo, chars = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def vocab(path: str, kind: type[Vocab] = Vocab) -> Vocab:
    """One vocabulary for each worker process, kept between its tasks."""
    key = f"{kind.__name__} {path}"
    if key not in _VOCABS:
        _VOCABS[key] = kind(path)
    return _VOCABS[key]


def encode_decode(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Encode each whole ``text`` and decode the ids again.

    Returns doc_id, n_tokens, ids_sha256 (decimal ids joined by commas),
    decoded_sha256 and, on request, the ids and the decoded text. Null text counts
    as empty: no ids, both digests of the empty string. Rows are independent, so
    repeated rows give repeated results; columns other than doc_id and text are
    not read. One pass without a shuffle; memory holds one Arrow batch and a
    bounded table of pieces.
    """
    path = send_file(docs.sparkSession, path or default_path())
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocab(path)
        for batch in batches:
            n, sha, back, all_ids, texts = [], [], [], [], []
            for raw in v.encode_batch(batch.column(1).to_pylist()):
                ids = np.frombuffer(raw, "<u4").tolist()
                text = v.decode(ids)
                n.append(len(ids))
                sha.append(hashlib.sha256(",".join(map(v.decimal.__getitem__, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(text.encode()).hexdigest())
                if with_ids:
                    all_ids.append(ids)
                    texts.append(text)
            cols = [batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
