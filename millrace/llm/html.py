"""Main text of web pages as a maximum-scoring subsequence.

A page is a sequence of tags and words. A word scores 1, unless what labelled pages show of its place (open elements,
words of their classes, share of links and length of its block) speaks for furniture; then it scores negative. Tags
score negative, by how much more often they stand outside content. One linear scan finds the best contiguous region;
its words that score positive are the text.
"""

from __future__ import annotations

import bisect
import html as references
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import page_families
from .storage import named, numbered, prepare

# Fixed values of HTML: elements whose content is no text, void elements, and inline elements (others break blocks).
SILENT = frozenset("script style noscript template svg math iframe object head title select textarea canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template")

_ITEM = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|\Z)"
    r"|<(?P<close>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<close2>/?)(?P<tag2>[A-Za-z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S,
)
_ATTR = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}

#: Pages from which the default weights come. Elements marked ``data-main`` are content, unless inside one marked
#: ``data-off``.
LABELLED = tuple(page_families.pages())

#: Attributes of labelled pages.
MARKS = ("data-main", "data-off")

# Fixed values of HTML: elements around all text, those that hold a page's main text, those that only change its looks,
# and those that say themselves that they aren't main text. A form around all of a page's body isn't one of them.
EVERYWHERE = ("<html>", "<body>")
HOLDERS = ("<article>", "<main>")
LOOKS = ("<center>", "<font>", "<big>", "<small>", "<b>", "<i>", "<u>", "<em>", "<strong>", "<span>")
FURNITURE = frozenset("aside nav footer form dialog menu button".split())

#: Words up to which an element that holds a form is part of it, such as the invitation to sign up.
FORM_WORDS = 60
#: Log odds of the words of an element's own class from which they count alone, whatever holds the element.
OWN = -2.5
#: What a word of a heading scores, so that one of few words isn't parted from its text by their tags.
HEADING = 4.0

#: Words of a block, and share of them inside links in tenths, from which the next class begins.
LENGTHS = (2, 4, 8, 16, 32)
SHARES = (1, 4, 8)


@dataclass
class Weights:
    """Scores of tags, and log odds that a word is content: by the open elements around it, and by its block's share of
    links and length together. What isn't listed scores ``tag``, or says nothing."""

    tags: dict[str, float]
    kinds: dict[str, float]
    blocks: list[list[float]] = field(default_factory=lambda: [[0.0] * (len(LENGTHS) + 1) for _ in range(len(SHARES) + 1)])
    bias: float = 0.0
    tag: float = -0.2


def items(page: str):
    """("open" | "close", name, attributes) and ("text", text, "") in order; what can't be seen is left out."""
    at, n = 0, len(page)
    while at < n and (m := _ITEM.match(page, at)):
        at = m.end()
        if m["text"]:
            yield "text", m["text"], ""
        elif name := m["tag"] or m["tag2"]:
            name = name.lower()
            attrs = m["attrs"] or m["attrs2"] or ""
            closing = bool(m["close"] or m["close2"])
            yield ("close" if closing else "open"), name, attrs
            if not closing and name in _END and not attrs.endswith("/"):
                end = _END[name].search(page, at)
                at = end.start() if end else n


def kinds(name: str, attrs: str) -> set[str]:
    """What an element may be known by: its name, and the words of its class, id and role. Elements that hold the
    whole page or article are known by name only."""
    out = {f"<{name}>"}.difference(LOOKS) | {m for m in MARKS if m in attrs}
    if attrs and name not in ("html", "body", "main", "article"):
        for m in _ATTR.finditer(attrs):
            out |= {p.lower() for p in _PART.findall(m[2] or m[3] or m[4] or "")}
    return out


@dataclass
class Element:
    """An open element, and what holds outside it."""

    name: str
    kinds: set[str]
    score: float
    silent: int
    off: int
    first: int
    words: int
    form: bool = False


class Stack:
    """Open elements. Each kind counts once however often it is open; every tag costs the same however deep it is."""

    def __init__(self, odds: dict[str, float]):
        self.odds, self.open_kinds, self.places = odds, Counter(), defaultdict(list)
        self.stack: list[Element] = []
        self.score, self.silent, self.off, self.words = 0.0, 0, 0, 0
        self.forms: list[tuple[int, int]] = []  # pieces of elements that belong to a form

    def push(self, name: str, attrs: str, at: int = 0) -> None:
        if name in ("article", "main"):  # furniture that was never closed ends here
            while self.stack and self.stack[-1].name in ("nav", "header", "ul", "li", "a", "form"):
                self.pop(self.stack[-1].name, at)
        if name in VOID or attrs.endswith("/"):
            return
        own = kinds(name, attrs)
        self.places[name].append(len(self.stack))
        self.stack.append(Element(name, own, self.score, self.silent, self.off, at, self.words))
        new = [(k, self.odds.get(k, 0.0)) for k in own if not self.open_kinds[k]]
        words = sum(v for k, v in new if k[0] != "<")
        self.score = min(self.score, 0.0) + words if words <= OWN else self.score + words
        self.score += sum(v for k, v in new if k[0] == "<")
        self.open_kinds.update(own)
        self.silent += name in SILENT
        self.off += name in FURNITURE and not (name == "form" and all(e.name in ("html", "body") for e in self.stack[:-1]))

    def pop(self, name: str, at: int = 0) -> None:
        """Closes the last element of that name and what is open inside; without one, nothing."""
        if not self.places[name]:
            return
        for _ in range(len(self.stack) - self.places[name][-1]):
            last = self.stack.pop()
            self.score, self.silent = last.score, last.silent
            form = last.form or (last.name == "form" and self.off > last.off)
            self.off = last.off
            self.places[last.name].pop()
            self.open_kinds.subtract(last.kinds)
            few = self.words - last.words <= FORM_WORDS
            if last.name == "form" and not form and few:
                self.forms.append((last.first, at))
            if form and self.stack and last.name not in FURNITURE and last.name not in ("article", "main", "body", "html") and few:
                self.forms.append((last.first, at))
            elif form and self.stack:
                self.stack[-1].form = True


@dataclass
class Piece:
    """A tag, or a stretch of text between tags and its block."""

    text: str
    tag: str | None = None
    words: int = 0
    block: int = 0
    odds: float = 0.0
    around: frozenset[str] = frozenset()
    off: bool = False
    heading: bool = False


def pieces(page: str, odds: dict[str, float], around: bool = False) -> tuple[list[Piece], list[list[int]]]:
    """A page in order, and the words and linked words of each of its blocks; with ``around``, the open kinds of texts."""
    stack, out, blocks = Stack(odds), [], [[0, 0]]
    for what, value, attrs in items(page):
        if what == "text":
            if not stack.silent:
                text = references.unescape(value) if "&" in value else value
                n = len(text.split())
                stack.words += n
                blocks[-1][0] += n
                blocks[-1][1] += n if stack.places["a"] else 0
                out.append(Piece(text, None, n, len(blocks) - 1, stack.score, frozenset(+stack.open_kinds) if around else frozenset(), stack.off > 0, any(stack.places[h] for h in ("h1", "h2", "h3"))))
            continue
        inline = value in INLINE
        out.append(Piece("" if inline else " ", value))
        if not inline:
            blocks.append([0, 0])
        (stack.push(value, attrs, len(out)) if what == "open" else stack.pop(value, len(out)))
    while stack.stack:
        stack.pop(stack.stack[-1].name, len(out))
    for first, last in stack.forms:
        for p in out[first:last]:
            p.off = True
    return out, blocks


def classes(block: list[int]) -> tuple[int, int]:
    """Classes of a block's share of links and of its length."""
    words, linked = block
    return bisect.bisect_right(SHARES, 10 * linked / max(1, words)), bisect.bisect_right(LENGTHS, words)


def content(p: Piece) -> bool:
    """Whether a text of a labelled page is content."""
    return MARKS[0] in p.around and MARKS[1] not in p.around


def train(pages: Iterable[str], ridge: float = 1.0, rounds: int = 12) -> Weights:
    """Weights from labelled pages: log odds by ridge logistic regression over texts outside ``FURNITURE``, each counted by its words up to
    20, once as it is and once without names and ``HOLDERS``, as pages of other families may lack them; and tag scores by log ratios of counts outside and inside content; a tag never scores above 0."""
    tags: dict[bool, Counter] = {True: Counter(), False: Counter()}
    rows: list[tuple[frozenset[str], tuple[int, int], int, bool]] = []
    for page in pages:
        main = False
        found, blocks = pieces(page, {}, around=True)
        for p in found:
            if p.tag is None:
                if p.words and not p.off:
                    main = content(p)
                    seen = p.around.difference(MARKS, EVERYWHERE)
                    plain = frozenset(k for k in seen if k[0] == "<" and k not in HOLDERS)
                    rows += [(k, classes(blocks[p.block]), min(20, p.words), main) for k in (seen, plain)]
            else:
                tags[main][p.tag] += 1
    names = sorted({k for around, *_ in rows for k in around})
    at = {k: i for i, k in enumerate(names)}
    width = len(LENGTHS) + 1
    x = np.zeros((len(rows), len(names) + (len(SHARES) + 1) * width + 1))
    y, weight = np.zeros(len(rows)), np.ones(len(rows))
    for i, (around, (share, length), words, main) in enumerate(rows):
        x[i, [at[k] for k in around]] = 1
        x[i, [len(names) + share * width + length, -1]] = 1
        y[i], weight[i] = main, words
    w = np.zeros(x.shape[1])
    for _ in range(rounds):  # Newton's steps
        p = 1 / (1 + np.exp(-x @ w))
        hessian = x.T @ (x * (weight * p * (1 - p))[:, None]) + ridge * np.eye(len(w))
        w += np.linalg.solve(hessian, x.T @ (weight * (y - p)) - ridge * w)
    ratio = lambda t: math.log((tags[False][t] + 0.5) / (tags[True][t] + 0.5))
    return Weights(
        {t: -min(3.0, max(0.05, 0.2 + 0.3 * ratio(t))) for t in {*tags[True], *tags[False]}},
        {k: float(w[i]) for k, i in at.items()},
        w[len(names) : -1].reshape(-1, width).tolist(),
        float(w[-1]),
    )


@lru_cache(1)
def default() -> Weights:
    return train(LABELLED)


def scored(found: list[Piece], blocks: list[list[int]], weights: Weights) -> tuple[list[float], list[bool]]:
    """What each piece adds to a region, and whether it is text of a region that holds it. A word whose place speaks for
    content stays however short its block is; what surely isn't text may stand between text."""
    scores, kept = [], []
    for p in found:
        if p.tag is not None:
            scores.append(weights.tags.get(p.tag, weights.tag))
            kept.append(True)
            continue
        share, length = classes(blocks[p.block])
        block = weights.blocks[share][length]
        odds = -3.0 if p.off else weights.bias + p.odds + (block if share else max(0.0, block))
        kept.append(odds >= 0 or not p.words)
        scores.append(0.0 if p.off else p.words * ((HEADING if p.heading else 1.0) if odds >= 0 else max(-1.0, odds)))
    return scores, kept


def best_region(scores: list[float]) -> tuple[int, int]:
    """The contiguous region with the largest sum, in one scan; an empty one if no sum is positive."""
    best = total = 0.0
    begin, region = 0, (0, 0)
    for i, s in enumerate(scores):
        total += s
        if total <= 0:
            total, begin = 0.0, i + 1
        elif total > best:
            best, region = total, (begin, i + 1)
    return region


def main_text(page: str, weights: Weights | None = None) -> str:
    """The text of the best region: blocks joined by one space, white space collapsed, references decoded."""
    weights = weights or default()
    found, blocks = pieces(page, weights.kinds)
    scores, kept = scored(found, blocks, weights)
    region = slice(*best_region(scores))
    return " ".join("".join(p.text for p, k in zip(found[region], kept[region], strict=True) if k).split())


def extract(df: DataFrame, weights: Weights | None = None, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Rows ``(*keep, text, n_chars)``: the main text of each page and its code points.

    A null or empty page, and one without content, has an empty text. Pages of any length are read whole, in time linear
    in it. Repeated rows each give a row; columns not in ``keep`` are left out.
    """

    def run(batches):
        for b in batches:
            out = [main_text(h, weights) if h else "" for h in b.column(len(keep)).to_pylist()]
            yield pa.record_batch([*(b.column(i) for i in range(len(keep))), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=[*keep, "text", "n_chars"])

    prepare(df.sparkSession)
    weights = weights or default()
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return numbered(df.select(*map(named, keep), named(html_col))).mapInArrow(run, schema + ", text string, n_chars long")
