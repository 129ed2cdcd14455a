"""Main text of web pages by a recurrent block labeller.

A page is cut into its leaf blocks: the text between block-level tags. A block is
read as the scaled sum of hashed vectors of its tag path (names, classes and ids of the
open elements), the mean of hashed vectors of its words, and a few figures. A
bidirectional LSTM reads all blocks of the page in order and labels every one with
the whole page as context.

There are no labels for pages. The network learns from a bounded sample of the pages
themselves: blocks inside an element that HTML or its class names as the article are
positive unless they stand in an element named as navigation, advert, form, comment
and so on. Each sample page is learned in several renderings, in which such parts
are renamed, moved and added, so that no single name decides. In a share of them the article
has no telling name, or no element at all, and must be told by its text and its place; in
others it holds elements whose names only contain a word such as comment. Names are whole
class names, ids and roles, never parts of them.
"""

from __future__ import annotations

import html as htmllib
import random
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagloom.llm.common import sample_of

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(script|style|textarea|iframe|title|xmp|noembed|noframes)(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:/>|>(?:.*?</\1\s*>|.*\Z)|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|[^<]+|<",
    re.S | re.I,
)
#: What swallows the rest of a page in which no > follows.
_OPEN = re.compile(r"<(?:[!?]|(?:script|style|textarea|iframe|title|xmp|noembed|noframes)[\s/])", re.I)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_SPACE = re.compile(r"\s+")
#: Inline elements, which do not end a block, and elements without content.
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img "
    "object canvas math mi mo mn ms mtext mspace mrow msup msub msubsup mfrac msqrt mroot munder mover munderover mstyle mpadded mphantom menclose semantics annotation "
    "svg g text tspan textpath path circle ellipse rect line polyline polygon defs use symbol desc lineargradient radialgradient stop clippath mask pattern".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements that an element of the same kind closes, and where the search for it ends.
_CLOSES_OWN = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
#: Names that mark parts of a page for the training labels.
_MAIN = frozenset("article main content post entry story body-text article-body post-content entry-content articlebody".split())
_SIDE = frozenset(
    "nav menu header footer aside form button ad ads advert advertisement sponsor sponsored promo banner cookie consent notice popup modal newsletter subscribe "
    "sidebar widget related recommended share social comment comments reply replies disqus breadcrumb breadcrumbs pagination copyright navigation contentinfo complementary search login signup".split()
)


def attributes(raw: str) -> dict[str, str]:
    """Values of the attributes of a tag by their names in small letters; the first of a name counts."""
    out: dict[str, str] = {}
    for key, *values in _ATTRIBUTE.findall(raw):
        out.setdefault(key.lower(), "".join(values))
    return out


def is_hidden(tag: str, attrs: dict[str, str]) -> bool:
    """Whether the markup hides an element; scripts and style sheets may show it all the same."""
    return tag == "template" or "hidden" in attrs or attrs.get("aria-hidden", "").strip().lower() == "true" or bool(_NO_DISPLAY.search(attrs.get("style", "")))


class Path:
    """The names of an open element and of those around it; each element holds its own names only."""

    __slots__ = ("parent", "names", "main", "side")

    def __init__(self, parent: Path | None, names: tuple[str, ...]):
        self.parent, self.names = parent, names
        self.main = (parent is not None and parent.main) or not _MAIN.isdisjoint(names)
        self.side = (parent is not None and parent.side) or not _SIDE.isdisjoint(names)

    def __iter__(self) -> Iterator[str]:
        """All names, from the outermost element in."""
        chain, p = [], self
        while p is not None:
            chain.append(p.names)
            p = p.parent
        for names in reversed(chain):
            yield from names

    @property
    def leaf(self) -> str:
        """The last name; empty outside of any element."""
        p = self
        while p is not None and not p.names:
            p = p.parent
        return p.names[-1] if p is not None else ""


Block = tuple[str, Path, int, int]


def _tokens(page: str) -> Iterator[re.Match | str]:
    """Tags, comments and texts; behind the last > no tag ends, so that text is not searched for one."""
    end, last = page.rfind(">") + 1, None
    for m in _TOKEN.finditer(page, 0, end):
        yield m
        last = m
    if last and (last.group(1) or last.group().startswith("<!")):  # one that is not closed goes on to the end
        end = max(end, _TOKEN.match(page, last.start()).end())
    cut = _OPEN.search(page, end)
    rest = page[end : cut.start()] if cut else page[end:]
    if rest:
        yield rest


def leaf_blocks(page: str, with_hidden: bool = False) -> list[Block]:
    """(text, path, characters inside links, characters in hidden elements) of each leaf block with any text, in page order.

    Text in hidden elements is left out unless ``with_hidden``. Time and memory grow
    with the length of the page, however deep its elements nest.
    """
    out: list[Block] = []
    root = Path(None, ())
    path: list[tuple[str, Path, bool, int]] = []  # tag, names, hidden, block elements up to here
    spots: dict[str, list[int]] = {}  # where in the path each tag is open
    words: list[str] = []
    linked = unseen = 0
    hidden = 0

    def flush() -> None:
        nonlocal linked, unseen
        if words:
            text = _SPACE.sub(" ", htmllib.unescape("".join(words))).strip()
            if text:
                out.append((text, path[-1][1] if path else root, linked, unseen))
            words.clear()
        linked = unseen = 0

    def close(at: int) -> None:
        nonlocal hidden
        while len(path) > at:
            tag, _, hid, _ = path.pop()
            spots[tag].pop()
            hidden -= hid

    def last(*tags: str) -> int:
        return max((spots[t][-1] for t in tags if spots.get(t)), default=-1)

    for m in _tokens(page):
        tag = None if isinstance(m, str) else m.group(3)
        if tag is None:
            t = m if isinstance(m, str) else m.group()
            if isinstance(m, str) or not t.startswith("<") or t == "<":
                if with_hidden or not hidden:
                    words.append(t)
                    if hidden:
                        unseen += len(t)
                    if spots.get("a"):
                        linked += len(t)
            elif m.group(1) and m.group(1).lower() not in ("script", "style", "title"):
                flush()
            continue
        tag = tag.lower()
        block = tag not in _INLINE
        if tag == "br":
            words.append(" ")
            continue
        if block:
            flush()
        if m.group(2):
            at = last(tag)
            if at >= 0 and (block or path[-1][3] == (path[at - 1][3] if at else 0)):
                close(at)
            continue
        if tag in _CLOSES_P and spots.get("p"):
            close(spots["p"][-1])
        ends = _CLOSES_OWN.get(tag)
        if ends:
            at = last(*(("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,)))
            if at > last(*ends):
                close(at)
        if tag in _VOID or m.group(4).endswith("/"):
            continue
        if not block and tag != "a":
            continue  # other inline elements say nothing about a block and are often left open
        attrs = attributes(m.group(4)) if m.group(4) else {}
        names = [tag]
        for key in ("class", "id", "role"):
            for n in attrs.get(key, "").lower().split():
                names.append(n)
        hid = is_hidden(tag, attrs)
        hidden += hid
        above = path[-1][1] if path else root
        spots.setdefault(tag, []).append(len(path))
        path.append((tag, Path(above, tuple(names)) if block else above, hid, (path[-1][3] if path else 0) + block))
    flush()
    return out


def rule_label(path: Path) -> int:
    """Training label of a block by the names on its path: inside a main part and nothing named otherwise."""
    return int(path.main and not path.side)


_FIGURES = 7


class Coded(NamedTuple):
    """A page for the network: elements (parents come first) with their buckets, and its blocks."""

    parent: np.ndarray
    own: list[np.ndarray]
    node: np.ndarray
    leaf: np.ndarray
    texts: list[np.ndarray]
    figures: np.ndarray


def encode(blocks: list[Block], known: dict, bits: int) -> Coded:
    """Buckets of the elements' names and of the blocks' words, and the figures of each block."""
    if len(known) > 300_000:
        known.clear()

    def bucket(k: str) -> int:
        b = known[k] = xxhash.xxh32_intdigest(k) >> (32 - bits)
        return b

    number: dict[int, int] = {}
    parent, own = [], []
    node, leaf, texts = [], [], []
    figures = np.empty((len(blocks), _FIGURES))
    for i, (text, path, linked, unseen) in enumerate(blocks):
        new, p = [], path
        while p is not None and id(p) not in number:
            new.append(p)
            p = p.parent
        for p in reversed(new):
            number[id(p)] = len(parent)
            parent.append(number[id(p.parent)] if p.parent is not None else -1)
            key = ("own", p.names)
            if key not in known:
                known[key] = np.array([bucket("n:" + n) for n in p.names], np.int64)
            own.append(known[key])
        node.append(number[id(path)])
        leaf.append(bucket("leaf:" + path.leaf))
        w = text.lower().split()
        texts.append(np.array([known[x] if x in known else bucket(x) for x in w], np.int64))
        n = len(text)
        figures[i] = (np.log1p(n) / 6, min(1.0, linked / n), len(w) / 50 if len(w) < 100 else 2, text[-1] in ".!?…:\"”", i / len(blocks), "©" in text or "|" in text, min(1.0, unseen / n))
    return Coded(np.array(parent, np.int64), own, np.array(node, np.int64), np.array(leaf, np.int64), texts, figures)


def _sums(v: np.ndarray, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the rows of ``v`` that each part names, and the sizes of the parts."""
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    flat = v[np.concatenate(parts)] if size.sum() else np.zeros((0, v.shape[1]))
    total = np.concatenate([np.zeros((1, v.shape[1])), np.cumsum(flat, axis=0)])
    end = np.cumsum(size)
    return total[end] - total[end - size], size


def _spread(at: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of v by where they belong."""
    return np.stack([np.bincount(at, v[:, k], n) for k in range(v.shape[1])], axis=1)


class BiLstm:
    """Hashed vectors, a bidirectional LSTM and a logistic output, trained by Adam."""

    def __init__(self, bits: int = 13, dim: int = 12, hidden: int = 16, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.bits, self.dim, self.hidden = bits, dim, hidden
        size = 2 * dim + _FIGURES
        self.p = {"e": rng.normal(0, 0.3, (1 << bits, dim)), "out": rng.normal(0, 0.3, 2 * hidden + size), "b": np.zeros(1)}
        for d in "fb":
            self.p["x" + d] = rng.normal(0, 1 / np.sqrt(size), (size, 4 * hidden))
            self.p["h" + d] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
            self.p["c" + d] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])

    def inputs(self, pages: list) -> tuple[np.ndarray, np.ndarray]:
        """Padded block vectors (pages, blocks, size) and which of them are there."""
        longest = max(len(p.node) for p in pages)
        x = np.zeros((len(pages), longest, 2 * self.dim + _FIGURES))
        there = np.zeros((len(pages), longest), bool)
        e = self.p["e"]
        words, sizes = _sums(e, [b for p in pages for b in p.texts])
        words /= np.maximum(sizes, 1)[:, None]
        names, counts = _sums(e, [b for p in pages for b in p.own])
        row = element = 0
        for i, p in enumerate(pages):
            n, k = len(p.node), len(p.own)
            path, size = names[element : element + k], counts[element : element + k]
            for j, q in enumerate(p.parent.tolist()):  # parents come first
                if q >= 0:
                    path[j] += path[q]
                    size[j] += size[q]
            x[i, :n, : self.dim] = (path[p.node] + e[p.leaf]) / np.sqrt(size[p.node] + 1)[:, None]
            x[i, :n, self.dim : 2 * self.dim] = words[row : row + n]
            x[i, :n, 2 * self.dim :] = p.figures
            there[i, :n] = True
            row, element = row + n, element + k
        return x, there

    def _run(self, x: np.ndarray, there: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        n, steps, _ = x.shape
        H = self.hidden
        z = x @ self.p["x" + d] + self.p["c" + d]
        h, c = np.zeros((n, H)), np.zeros((n, H))
        out, tape = np.zeros((n, steps, H)), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = z[:, t] + h @ self.p["h" + d]
            i, f, o = (1 / (1 + np.exp(-np.clip(a[:, k * H : (k + 1) * H], -30, 30))) for k in range(3))
            g = np.tanh(a[:, 3 * H :])
            on = there[:, t, None]
            c2 = np.where(on, f * c + i * g, c)
            th = np.tanh(c2)
            h2 = np.where(on, o * th, h)
            if keep:
                tape.append((t, h, c, i, f, o, g, th, on))
            h, c = h2, c2
            out[:, t] = h
        return out, tape

    def scores(self, pages: list) -> list[np.ndarray]:
        """Probability of each block of each page to belong to the main text."""
        x, there = self.inputs(pages)
        both = np.concatenate([self._run(x, there, "f", False)[0], self._run(x, there, "b", False)[0], x], axis=2)
        p = 1 / (1 + np.exp(-np.clip(both @ self.p["out"] + self.p["b"], -30, 30)))
        return [p[i, : len(q.node)] for i, q in enumerate(pages)]

    def step(self, pages: list, labels: list[np.ndarray], state: dict, rate: float) -> float:
        x, there = self.inputs(pages)
        H, grad = self.hidden, {k: np.zeros_like(v) for k, v in self.p.items()}
        hf, tf = self._run(x, there, "f", True)
        hb, tb = self._run(x, there, "b", True)
        both = np.concatenate([hf, hb, x], axis=2)
        y = np.zeros(there.shape)
        for i, l in enumerate(labels):
            y[i, : len(l)] = l
        p = 1 / (1 + np.exp(-np.clip(both @ self.p["out"] + self.p["b"], -30, 30)))
        dz = np.where(there, p - y, 0) / there.sum()
        grad["out"], grad["b"] = np.einsum("nt,ntk->k", dz, both), np.array([dz.sum()])
        back = dz[:, :, None] * self.p["out"]
        dx = back[:, :, 2 * H :].copy()
        for d, tape, part in (("f", tf, back[:, :, :H]), ("b", tb, back[:, :, H : 2 * H])):
            dh, dc = np.zeros((len(pages), H)), np.zeros((len(pages), H))
            for t, h, c, i, f, o, g, th, on in reversed(tape):
                dh = dh + part[:, t]
                dc_in = dc + np.where(on, dh * o * (1 - th * th), 0)
                da = np.concatenate([dc_in * g * i * (1 - i), dc_in * c * f * (1 - f), dh * th * o * (1 - o), dc_in * i * (1 - g * g)], axis=1) * on
                grad["x" + d] += x[:, t].T @ da
                grad["h" + d] += h.T @ da
                grad["c" + d] += da.sum(axis=0)
                dx[:, t] += da @ self.p["x" + d].T
                dh = np.where(on, da @ self.p["h" + d].T, dh)
                dc = np.where(on, dc_in * f, dc)
        flat, d = dx[there], self.dim  # one row per block, page by page
        texts = [b for q in pages for b in q.texts]
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        base = np.cumsum([0, *(len(q.own) for q in pages)])
        owned = [b for q in pages for b in q.own]
        own = np.fromiter(map(len, owned), np.int64, len(owned))
        parent = np.concatenate([np.where(q.parent >= 0, q.parent + o, -1) for q, o in zip(pages, base, strict=False)]).tolist()
        node = np.concatenate([q.node + o for q, o in zip(pages, base, strict=False)])
        depth = own.tolist()
        for j, up in enumerate(parent):
            if up >= 0:
                depth[j] += depth[up]
        per = flat[:, :d] / np.sqrt(np.array(depth)[node] + 1)[:, None]
        back_to = _spread(node, per, len(owned))
        for j in range(len(owned) - 1, -1, -1):  # an element's names are in the paths of all below it
            if parent[j] >= 0:
                back_to[parent[j]] += back_to[j]
        at = np.concatenate([*texts, np.concatenate([q.leaf for q in pages]), *owned]).astype(np.int64)
        v = np.concatenate([np.repeat(flat[:, d : 2 * d] / np.maximum(size, 1)[:, None], size, axis=0), per, np.repeat(back_to, own, axis=0)])
        grad["e"] = _spread(at, v, len(grad["e"]))
        state["n"] = n = state.get("n", 0) + 1
        for k, g in grad.items():
            m, v = state.setdefault(k, (np.zeros_like(g), np.zeros_like(g)))
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            state[k] = (m, v)
            self.p[k] = self.p[k] - rate * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.999**n)) + 1e-8)
        return float(-np.where(there, np.log(np.where(y > 0, p, 1 - p) + 1e-12), 0).sum() / there.sum())


#: Wordings for the parts that renderings add; the training texts between them come from the pages.
_MAIN_FORMS = (("article", ""), ("main", ""), ("div", "content"), ("div", "article-body"), ("section", "post-content"), ("div", "entry"), ("div", "story"))
_SIDE_FORMS = (
    ("nav", ""), ("header", ""), ("footer", ""), ("aside", ""), ("form", ""), ("div", "ad"), ("div", "sidebar"), ("div", "cookie-notice"), ("div", "comments"), ("section", "comment"),
    ("div", "related"), ("div", "share"), ("div", "menu"), ("ul", "nav"), ("div", "banner"), ("div", "newsletter"), ("div", "promo"), ("div", "footer"), ("div", "header"), ("aside", "widget"), ("div", "notice"),
    ("div", "site-header"), ("div", "site-footer"), ("div", "page-header"), ("div", "page-footer"), ("ul", "main-menu"), ("div", "navbar"), ("ul", "breadcrumbs"), ("div", "comment-list"), ("div", "comments-area"),
    ("div", "related-posts"), ("div", "share-buttons"), ("div", "social-links"), ("div", "ad-slot"), ("div", "advert"), ("div", "cookie-banner"), ("div", "newsletter-signup"), ("div", "sidebar-widget"), ("div", "popup"),
)
_PLAIN = ("wrap", "row", "col", "inner", "page", "box", "x1", "container")


def _unknown(rng: random.Random) -> str:
    """A class name that tells nothing: made up, or a telling word with another behind it."""
    made = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(rng.randint(2, 6)))
    return f"{rng.choice(sorted(_SIDE))}-{made}" if rng.random() < 0.4 else rng.choice((*_PLAIN, made, "css-" + made))


def renderings(blocks: list, rng: random.Random) -> tuple[list, np.ndarray]:
    """The blocks of a page with its parts renamed, wrapped and added to, and their labels."""
    y = [rule_label(path) for _, path, _, _ in blocks]
    tag, cls = rng.choice(_MAIN_FORMS)
    wrap = rng.choice((["html", "body"], ["html", "body"], ["body"], [])) + [x for _ in range(rng.randint(0, 3)) for x in ("div", rng.choice(_PLAIN))]
    main = (*wrap, tag, *([cls] if cls else []))
    pool = [t for t, _, _, _ in blocks]
    kind = rng.random()
    if kind < 0.12 and any(y):  # nothing but the article, in a body, a paragraph or no element
        path = rng.choice(((), ("p",), ("html", "body"), ("html", "body", "p"), ("html", "body", "div", _unknown(rng), "p")))
        rows = [(text, Path(None, path), linked, unseen) for (text, _, linked, unseen), label in zip(blocks, y, strict=True) if label]
        rows = rows[: rng.choice((1, 2, len(rows)))]
        return rows, np.ones(len(rows))
    unnamed = kind < 0.45
    if unnamed:  # the article stands in an element of no telling name, or right in the body
        main = rng.choice((tuple(wrap), (*wrap, "div", _unknown(rng)), (*wrap, "div"), (*wrap, "section", _unknown(rng)), (*wrap, "table", "tr", "td")))
    # markup may hide all of an article (behind a modal) or its rest from some block on (collapsed)
    at = rng.random() * rng.choice((0, 1)) if rng.random() < 0.3 else 1.0

    def side(inside: bool, prose: bool = False) -> list:
        t, c = rng.choice(_SIDE_FORMS)
        if c and rng.random() < 0.4:
            t, c = rng.choice(("div", "section", "ul", "aside")), rng.choice((c, rng.choice(sorted(_SIDE))))
        path = (*(main if inside else wrap), t, *([c] if c else []))
        rows, hid = [], rng.random() < 0.3
        bare = not inside and not prose and rng.random() < 0.15  # short lines and links without a name
        if bare:
            path = (*wrap, rng.choice(("div", "ul")), _unknown(rng))
        for _ in range(rng.randint(1, 5)):
            s = rng.choice(pool)
            a = rng.randint(0, max(0, len(s) - 30))
            s = s[a : a + rng.randint(5, 40 if bare else 2000 if prose else rng.choice((60, 400, 2000)))].strip() or s
            leaf = rng.choice((("p",), ("li",), ("ul", "li"), ("div",), (), ("h2",), ("h3",), ("label",)))
            rows.append(((s, Path(None, (*path, *leaf)), len(s) if bare or (not prose and rng.random() < 0.5) else 0, len(s) if hid else 0), 0))
        return rows

    rows = [r for _ in range(rng.randint(0, 3)) for r in side(False)]
    odd = rng.random() < 0.25  # some of the article in elements whose names mean something else
    for i, ((text, path, linked, unseen), label) in enumerate(zip(blocks, y, strict=True)):
        if label:
            leaf = (path.leaf,) if path.leaf in ("p", "h1") else ("p",)
            if rng.random() < 0.3:  # lists, tables, quotes and short pieces belong to articles too
                leaf = rng.choice((("ul", "li"), ("ol", "li"), ("h2",), ("h3",), ("blockquote",), ("blockquote", "p"), ("table", "tr", "td"), ("pre",), ("div",), ("figure", "figcaption"), ("div", "p"), ()))
                if rng.random() < 0.6:
                    a = rng.randint(0, max(0, len(text) - 20))
                    text = text[a : a + rng.randint(3, 60)].strip() or text
            more = (rng.choice(("div", "p", "section")), _unknown(rng)) if odd and rng.random() < 0.5 else ()
            rows.append(((text, Path(None, (*main, *more, *leaf)), linked if rng.random() < 0.8 else len(text) // 2, len(text) if i >= at * len(blocks) else unseen), 1))
            if rng.random() < 0.03:
                rows += side(True)
        else:
            rows.append(((text, path if wrap[:1] == ["html"] else Path(None, tuple(wrap) + tuple(x for x in path if x not in ("html", "body"))), linked, unseen), 0))
    rows += [r for _ in range(rng.randint(0, 4)) for r in side(rng.random() < 0.2)]
    if rng.random() < 0.5:  # comments and the like read like an article, but for their name
        rows += side(False, True)
    return [r for r, _ in rows], np.array([l for _, l in rows], float)


def train(pages: list[str], steps: int = 400, copies: int = 4, batch: int = 32, seed: int = 0) -> BiLstm:
    """Learn from the pages that name their article, as they are and in ``copies`` renderings.

    A page without such a name says nothing about its blocks. Where no page has one, all
    blocks count as main text.
    """
    model, rng, known = BiLstm(seed=seed), random.Random(seed), {}
    rows = []
    for p in pages:
        b = leaf_blocks(p, True)
        if any(rule_label(n) for _, n, _, _ in b):
            rows.append((b, np.array([rule_label(n) for _, n, _, _ in b], float)))
            rows += [renderings(b, rng) for _ in range(copies)]
    coded = [(encode(b, known, model.bits), y) for b, y in rows]
    state: dict = {}
    done = 0
    if not coded:
        model.p["out"][:], model.p["b"][:] = 0, 1
    while coded and done < steps:
        rng.shuffle(coded)
        coded.sort(key=lambda r: len(r[1]) // 20)
        cuts = list(range(0, len(coded), batch))
        rng.shuffle(cuts)
        for at in cuts:
            part = coded[at : at + batch]
            model.step([c for c, _ in part], [y for _, y in part], state, 0.02 * max(0.1, 1 - done / steps))
            done += 1
    return model


def extract(pages: DataFrame, sample: int = 300, threshold: float = 0.5, most_chars: int = 200_000) -> DataFrame:
    """page_id, url, text, n_chars for every page.

    Text that the markup hides is read like any other, with hiddenness as one of the
    network's figures; only elements of raw text (scripts, style sheets, text fields,
    frames, the title) and comments are skipped.
    Learns from the ``sample`` pages of least page_id hash among those of at most
    ``most_chars`` characters; a page_id that repeats counts once. Null and empty html give
    empty text, as do pages without a block of main text; repeated rows give
    repeated results. Columns other than page_id, url and html are not read. The
    network that every task receives has a fixed size.
    """
    rows = sample_of(pages.filter("page_id is not null").filter(F.length("html") <= most_chars), "page_id", sample, "html")
    sent = pages.sparkSession.sparkContext.broadcast(train(sorted(r[0] for r in rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = sent.value, {}
        for batch in batches:
            blocks = [leaf_blocks(h or "", True) for h in batch.column(2).to_pylist()]
            texts = [""] * len(blocks)
            order = sorted((i for i, b in enumerate(blocks) if b), key=lambda i: len(blocks[i]))
            at = 0
            while at < len(order):
                n = max(1, min(128, 20_000 // len(blocks[order[min(at + 127, len(order) - 1)]])))
                part = order[at : at + n]
                at += n
                for i, p in zip(part, model.scores([encode(blocks[i], known, model.bits) for i in part]), strict=True):
                    texts[i] = "\n".join(b[0] for b, s in zip(blocks[i], p, strict=True) if s >= threshold)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
