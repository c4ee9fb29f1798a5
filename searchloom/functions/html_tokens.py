"""Per-page HTML reading for Arrow batches: elements of interest, visible text, JSON-LD types.

Only tag reading happens here; which element means what is decided by column expressions.
"""

from __future__ import annotations

import json
import re
import sys
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Element and attribute names the site checks read.
SINGLE_TAGS = ("html", "meta", "link", "base", "img", "main")
HEADING_TAGS = ("h1", "h2", "h3", "h4", "h5", "h6")
TEXT_TAGS = ("title", "a", *HEADING_TAGS)
SILENT_TAGS = ("head", "script", "style", "template", "noscript")
SKIPPED_SCHEMES = ("mailto", "tel", "javascript", "data", "blob")
IMAGE_ATTRIBUTES = ("src", "data-src", "data-lazy-src", "data-original", "data-flickity-lazyload", "data-echo")
SRCSET_ATTRIBUTES = ("srcset", "data-srcset", "data-lazy-srcset", "data-original-srcset")

# bytes of HTML whose elements a worker holds at once; a batch that Spark sends may be a hundred times as large
PIECE_BYTES = 1 << 19
# what a page counts besides its HTML, so that a piece has a bounded number of pages as well
PAGE_BYTES = 1 << 10

ELEMENT = pa.struct(
    [
        ("tag", pa.string()),
        ("attrs", pa.map_(pa.string(), pa.string())),
        ("text", pa.string()),
        ("target", pa.string()),
    ]
)
RESOURCE = pa.struct([("element", pa.string()), ("attribute", pa.string()), ("raw", pa.string()), ("target", pa.string())])
FACT_TYPES = {
    "elements": pa.list_(ELEMENT),
    "resources": pa.list_(RESOURCE),
    "visible_text": pa.string(),
    "document_base": pa.string(),
    "json_ld_types": pa.list_(pa.string()),
    "json_ld_errors": pa.list_(pa.string()),
}
FACT_DDL = (
    "elements array<struct<tag:string,attrs:map<string,string>,text:string,target:string>>, "
    "resources array<struct<element:string,attribute:string,raw:string,target:string>>, visible_text string, "
    "document_base string, json_ld_types array<string>, json_ld_errors array<string>"
)


def one_line(text: str) -> str:
    return " ".join(text.split())


class Elements(HTMLParser):
    """Collects ``[tag, attributes, text]`` in document order.

    A heading is recorded where it begins and gets its text where it ends; one that never ends, or that another of its kind
    replaces, stays without text. Other texts are recorded where they end.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[list] = []
        self.words: list[str] = []
        self.depth: Counter[str] = Counter()
        self.reading: dict[str, tuple[list, list[str]]] = {}

    def handle_starttag(self, tag, attrs):
        attributes = {name: value or "" for name, value in attrs}
        self.depth[tag] += 1
        if tag != "a" and attributes.get("role", "").lower() == "link":
            self.found.append(["role-link", {"tag": tag}, ""])
        if tag in SINGLE_TAGS or (tag == "source" and self.depth["picture"] > 0):
            self.found.append([tag, attributes, ""])
        kind = attributes.get("type", "").split(";")[0].strip().lower()
        if tag in TEXT_TAGS or (tag == "script" and kind == "application/ld+json"):
            self.reading[tag] = ([tag, attributes, ""], [])
            if tag in HEADING_TAGS:
                self.found.append(self.reading[tag][0])

    def handle_endtag(self, tag):
        if self.depth[tag] > 0:
            self.depth[tag] -= 1
        if tag in self.reading:
            entry, parts = self.reading.pop(tag)
            entry[2] = "".join(parts)
            if tag not in HEADING_TAGS:
                self.found.append(entry)

    def handle_data(self, data):
        for _entry, parts in self.reading.values():
            parts.append(data)
        if self.depth["body"] > 0 and not any(self.depth[t] for t in SILENT_TAGS):
            self.words.append(data)


def srcset_urls(value: str) -> list[str]:
    """Candidate URLs of a srcset; descriptors may hold commas inside parentheses."""
    urls, rest = [], value
    while rest := rest.lstrip(" \t\r\n\f,"):
        word = re.match(r"\S+", rest).group()
        rest = rest[len(word) :]
        if word.endswith(","):
            word = word.rstrip(",")
        else:
            rest = rest[re.match(r"(?:[^,(]|\([^)]*\)?)*,?", rest).end() :]
        if word:
            urls.append(word)
    return urls


def follow(base: str, raw: str) -> str | None:
    """Absolute form of a link, None for same-page and non-fetchable ones."""
    text = raw.strip()
    try:
        if not text or text[0] == "#" or urlsplit(text).scheme.lower() in SKIPPED_SCHEMES:
            return None
        return urljoin(base, text)
    except ValueError:
        return None


def ld_types(value) -> set[str]:
    """All ``@type`` names at any depth."""
    if isinstance(value, list):
        return set().union(*map(ld_types, value))
    if not isinstance(value, dict):
        return set()
    own = value.get("@type")
    names = [own] if isinstance(own, str) else own if isinstance(own, list) else []
    below = [v for k, v in value.items() if k != "@type"]
    return {n for n in names if isinstance(n, str)} | ld_types(below)


def read_page(url: str, html: str) -> dict:
    page = Elements()
    page.feed(html or "")
    bases = (follow(url, attrs.get("href", "")) for tag, attrs, _ in page.found if tag == "base")
    base = next((b for b in bases if b and b.lower().startswith(("http://", "https://"))), url)
    elements, resources, types, errors = [], [], set(), []
    for tag, attrs, text in page.found:
        if tag == "script":
            try:
                types |= ld_types(json.loads(text.strip()))
            except json.JSONDecodeError as error:
                errors.append(f"line {error.lineno} column {error.colno}" if text.strip() else "empty block")
            continue
        target = follow(base, attrs.get("href", "")) if tag in ("a", "link") else None
        elements.append({"tag": tag, "attrs": list(attrs.items()), "text": one_line(text), "target": target})
        if tag in ("img", "source"):
            listed = [(name, [attrs.get(name, "").strip()]) for name in IMAGE_ATTRIBUTES]
            listed += [(name, srcset_urls(attrs.get(name, ""))) for name in SRCSET_ATTRIBUTES]
            for name, raws in listed:
                for raw in raws:
                    if (where := follow(base, raw)) is not None:
                        resources.append({"element": tag, "attribute": name, "raw": raw, "target": where})
    return {
        "elements": elements,
        "resources": resources,
        "visible_text": one_line(" ".join(page.words)),
        "document_base": base,
        "json_ld_types": sorted(types),
        "json_ld_errors": errors,
    }


def pieces(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch with about ``PIECE_BYTES`` in ``column``; a larger row is a piece of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + PAGE_BYTES
    part = np.cumsum(sizes) // PIECE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(batch)]
    for low, high in zip(cuts, cuts[1:]):
        if high > low:
            yield batch.slice(low, high - low)


def read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace ``html`` by what was read from it; all other columns pass through. What is read leaves the worker piece by piece."""
    for batch in batches:
        kept = [n for n in batch.schema.names if n != "html"]
        for piece in pieces(batch, "html"):
            facts = [read_page(u, h) for u, h in zip(piece.column("url").to_pylist(), piece.column("html").to_pylist())]
            arrays = [piece.column(n) for n in kept]
            arrays += [pa.array([f[n] for f in facts], type=t) for n, t in FACT_TYPES.items()]
            yield pa.RecordBatch.from_arrays(arrays, names=kept + list(FACT_TYPES))
