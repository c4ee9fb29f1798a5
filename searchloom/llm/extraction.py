"""Main text of web pages from flat text blocks and a decision tree.

A page is cut into flat blocks: the text between two block-level tags. A block has its word count, its link density, the same of
the block before and after it, and three marks of the elements around it. A decision tree grown on a small labelled
table (``extraction_examples``) says which blocks are main text; they are joined in page order by one space. Most of the labelled pages
carry no marks, so the tree decides by words, links and neighbours where marks say nothing.

Scripts, styles, comments and the page head have no blocks. Character references are decoded, white space inside a block becomes one
space. Elements left open are closed by the end of what holds them, a paragraph by the next block.

Defined results: a null or empty page, or one without main text, gives the empty text; a page without any markup is one block;
repeated rows are read one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from searchloom.llm.extraction_examples import EXAMPLES
from searchloom.llm.text import LONG, STRING, record

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|iframe|object|head|title)\b(?P<rest>[^>]*+)>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:\"[^\"]*+\"|'[^']*+'|[^'\"<>])*+)>"
    r"|<[!?][^>]*+>"
    r"|<(?P<open>/?)(?P<name>[a-zA-Z][^\s/>]*+)[^>]*+>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

# Element names of the HTML standard by how they shape blocks.
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rt rp s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
# Elements, and words in class, id and role, that speak against or for main text.
ASIDE_TAGS = set("nav aside form menu dialog button select textarea fieldset footer".split())
ASIDE_WORDS = set(
    "ad ads advert adverts advertisement advertising adsbygoogle alert banner breadcrumb breadcrumbs comment comments complementary "
    "consent contentinfo cookie cookies discussion disqus foot footer gdpr login menu modal nav navbar navigation newsletter "
    "notice notices notification overlay pager pagination popup promo promoted promotion related replies reply respond search "
    "share sharing sidebar social sponsor sponsored subscribe subscription toolbar warning widget".split()
)
HEADER_WORDS = set("header masthead topbar".split())
MAIN_TAGS = {"article", "main"}
MAIN_WORDS = set("article main content post entry story".split())

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "aside", "main", "heading")


@dataclass
class Block:
    text: str
    words: int
    links: float
    aside: bool
    main: bool
    heading: bool


def _marks(tag: str, attrs: str, in_main: bool) -> tuple[bool, bool]:
    """Whether an element speaks against, and for, main text."""
    if tag in ("html", "body"):
        return False, False
    aside, main = tag in ASIDE_TAGS or (tag == "header" and not in_main), tag in MAIN_TAGS
    if attrs and "=" in attrs or "hidden" in attrs:
        for name, double, single, bare in _ATTRIBUTE.findall(attrs):
            value = double or single or bare
            if name.lower() in ("hidden", "aria-hidden"):
                aside |= name.lower() == "hidden" or value.lower() == "true"
                continue
            words = {w.lower() for w in _TOKEN.findall(value)}
            aside |= bool(words & ASIDE_WORDS) or (not in_main and bool(words & HEADER_WORDS))
            main |= bool(words & MAIN_WORDS)
    return aside, main


def blocks(page: str) -> list[Block]:
    """Flat text blocks of a page in page order."""
    out: list[Block] = []
    text: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, aside, main, heading
    in_link = 0

    def flush() -> None:
        nonlocal text, linked
        if text:
            words = html.unescape("".join(text)).split()
            if words:
                n_linked = len(html.unescape("".join(linked)).split()) if linked else 0
                _, aside, main, heading = stack[-1] if stack else ("", False, False, False)
                out.append(Block(" ".join(words), len(words), min(1.0, n_linked / len(words)), aside, main, heading))
        text, linked = [], []

    def push(tag: str, attrs: str) -> None:
        _, aside, main, heading = stack[-1] if stack else ("", False, False, False)
        against, for_ = _marks(tag, attrs, main)
        stack.append((tag, aside or against, main or for_, heading or tag in HEADINGS))

    def pop(tag: str) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == tag:
                del stack[i:]
                return

    at, end = 0, len(page)
    while at < end:
        m = _MARKUP.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            piece = page[at:stop]
            text.append(piece)
            if in_link:
                linked.append(piece)
        if not m:
            break
        at = m.end()
        if m["raw"]:
            if not m["rest"].endswith("/"):
                close = re.compile(rf"</{m['raw']}\b[^>]*>", re.I).search(page, at)
                # an unclosed head ends where the body begins; other raw elements hold all that follows
                if close is None and m["raw"].lower() == "head":
                    close = re.compile(r"(?=<body\b)", re.I).search(page, at)
                at = close.end() if close else end
            flush()
            continue
        tag = m["tag"] or m["name"]
        if not tag:
            continue
        tag, closing = tag.lower(), bool(m["end"] or m["open"])
        attrs = m["attrs"] or ""
        if tag == "a":
            in_link = 0 if closing else 1
        if tag in INLINE:
            if closing:
                if any(s[0] == tag for s in stack[-3:]):
                    flush()
                    pop(tag)
            elif attrs and any(_marks(tag, attrs, False)[:1]):
                flush()
                push(tag, attrs)
            continue
        flush()
        if tag in VOID:
            continue
        if closing:
            pop(tag)
            continue
        while stack and (stack[-1][0] == "p" or stack[-1][0] in INLINE or (tag == stack[-1][0] and tag in ("li", "dd", "dt", "tr", "td", "th", "option"))):
            stack.pop()  # an open paragraph or item ends here
        if not attrs.endswith("/"):
            push(tag, attrs)
    flush()
    return out


def features(found: list[Block]) -> np.ndarray:
    """One row of ``FEATURES`` per block; beyond the first and last block stand zeros."""
    n = len(found)
    table = np.zeros((n, len(FEATURES)))
    table[:, 0] = [b.words for b in found]
    table[:, 1] = [b.links for b in found]
    table[1:, 2:4] = table[:-1, 0:2]
    table[:-1, 4:6] = table[1:, 0:2]
    table[:, 6:9] = [(b.aside, b.main, b.heading) for b in found]
    return table


@dataclass
class Tree:
    """A binary decision tree as arrays; a leaf has feature -1."""

    feature: list[int]
    limit: list[float]
    left: list[int]
    right: list[int]
    label: list[bool]

    def decide(self, rows: np.ndarray) -> np.ndarray:
        node = np.zeros(len(rows), np.int64)
        feature, limit = np.array(self.feature), np.array(self.limit)
        left, right = np.array(self.left), np.array(self.right)
        while True:
            inner = np.flatnonzero(feature[node] >= 0)
            if not len(inner):
                return np.array(self.label)[node]
            at = node[inner]
            low = rows[inner, feature[at]] <= limit[at]
            node[inner] = np.where(low, left[at], right[at])


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 10, least: int = 2) -> Tree:
    """Greedy tree by Gini impurity; ties take the first feature and the lowest limit."""
    tree = Tree([], [], [], [], [])

    def impurity(part: np.ndarray) -> float:
        share = part.mean() if len(part) else 0.0
        return 2 * share * (1 - share) * len(part)

    def add(own: np.ndarray, level: int) -> int:
        node = len(tree.feature)
        here = labels[own]
        for field, value in zip((tree.feature, tree.limit, tree.left, tree.right, tree.label), (-1, 0.0, -1, -1, bool(here.mean() > 0.5))):
            field.append(value)
        best = (impurity(here) - 1e-9, -1, 0.0)
        if level < depth and len(own) >= 2 * least:
            for f in range(rows.shape[1]):
                values = np.unique(rows[own, f])
                for limit in (values[:-1] + values[1:]) / 2:
                    low = rows[own, f] <= limit
                    if low.sum() < least or (~low).sum() < least:
                        continue
                    total = impurity(here[low]) + impurity(here[~low])
                    if total < best[0] - 1e-12:
                        best = (total, f, float(limit))
        if best[1] >= 0:
            low = rows[own, best[1]] <= best[2]
            tree.feature[node], tree.limit[node] = best[1], best[2]
            tree.left[node] = add(own[low], level + 1)
            tree.right[node] = add(own[~low], level + 1)
        return node

    add(np.arange(len(rows)), 0)
    return tree


def labelled(examples: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Block features and labels of pages whose blocks of main text start with ``+`` and others with ``-``."""
    rows, labels = [], []
    for _, page in examples:
        found = blocks(page)
        marks = [b.text[0] for b in found]
        if set(marks) - {"+", "-"}:
            raise ValueError("an example block has no label")
        rows.append(features(found))
        labels += [m == "+" for m in marks]
    return np.concatenate(rows), np.array(labels)


def trained(examples: list[tuple[str, str]] | None = None) -> Tree:
    return grow(*labelled(EXAMPLES if examples is None else examples))


def main_blocks(page: str | None, tree: Tree) -> list[str]:
    found = blocks(page) if page else []
    if not found:
        return []
    return [b.text for b, keep in zip(found, tree.decide(features(found))) if keep]


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html", examples: list[tuple[str, str]] | None = None) -> DataFrame:
    """``page_id``, ``url`` and ``main`` (text, its code points, its blocks) of every row."""
    tree = trained(examples)

    @F.pandas_udf(record(text=STRING, n_chars=LONG, blocks=T.ArrayType(STRING)))
    def extracted(bodies: pd.Series) -> pd.DataFrame:
        kept = [main_blocks(body, tree) for body in bodies]
        texts = [" ".join(k) for k in kept]
        return pd.DataFrame({"text": texts, "n_chars": [len(t) for t in texts], "blocks": kept})

    return pages.select(
        F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), extracted(F.col(f"`{page}`").cast("string")).alias("main")
    )
