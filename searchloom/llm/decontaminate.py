"""Benchmark passages in documents by a prefix-filtered set join.

An item's windows are its runs of ``size`` consecutive words (a shorter item is one window). A window is contained
in a document where all its word shingles stand in the window's order, that is at containment 1. The shingles of all windows
are ordered by rarity in the documents; at containment 1 the necessary prefix of a window is its rarest
shingle. Only places of a document that hold such a prefix shingle become candidates; the shingle's offset in the window
gives the one place where the window can start (positional bound), which must lie inside the document (length
bound); then all words are compared.

Windows are matched in blocks of at most ``block`` windows, each sent to the tasks as one bounded array; a benchmark
beyond one block is matched in several passes, so its size is not limited.

Defined results: a null text has no words, neither has an item without them; repeated items count once per id; a null
item id counts as the text ``null``; an empty benchmark hits nothing; repeated documents are judged one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchloom.llm.text import LONG, STRING, packed, plain_words, record, unpacked
from searchloom.session import cut_lineage

SHINGLE = 3
# windows in one block: about 40 MB of words and ids at the most for ten words of usual length
BLOCK = 100_000


@dataclass
class Windows:
    """Distinct windows of one block as arrays of word numbers; 0 is a word that no window has."""

    vocab: dict[bytes, int]
    words: np.ndarray  # windows x size, padded with 0
    lengths: np.ndarray
    items: list[list[str]]  # ids of the items that have the window

    @staticmethod
    def of(rows: list[tuple[bytes, str]]) -> Windows:
        """``rows``: window (words joined by a space) and item id."""
        found: dict[bytes, set[str]] = {}
        for window, item in rows:
            found.setdefault(window, set()).add(item)
        vocab: dict[bytes, int] = {}
        coded = [[vocab.setdefault(w, len(vocab) + 1) for w in window.split(b" ")] for window in found]
        words = np.zeros((len(coded), max(map(len, coded), default=1)), np.int64)
        for i, codes in enumerate(coded):
            words[i, : len(codes)] = codes
        lengths = np.fromiter(map(len, coded), np.int64, len(coded))
        return Windows(vocab, words, lengths, [sorted(x) for x in found.values()])

    def shingle_widths(self) -> np.ndarray:
        """Shingle width of each window: ``SHINGLE`` words, or all of a shorter window."""
        return np.minimum(self.lengths, SHINGLE)

    def codes(self, ids: np.ndarray, width: int) -> np.ndarray:
        """Number of the shingle that starts at each place; -1 where a word is unknown."""
        n = ids.shape[-1] - width + 1
        base, out, known = len(self.vocab) + 1, ids[..., :n].copy(), ids[..., :n] > 0
        for k in range(1, width):
            out = out * base + ids[..., k : k + n]
            known &= ids[..., k : k + n] > 0
        return np.where(known, out, -1)

    def shingles(self, width: int) -> np.ndarray:
        """Sorted distinct shingles of the windows with this shingle width."""
        own = self.words[self.shingle_widths() == width]
        return np.setdiff1d(self.codes(own, width), [-1]) if len(own) else np.empty(0, np.int64)

    def ids(self, text: str | None) -> np.ndarray:
        words = plain_words(text)
        get = self.vocab.get
        return np.fromiter((get(w, 0) for w in words), np.int64, len(words))


def window_rows(items: DataFrame, item_id: str, text: str, size: int) -> DataFrame:
    """``window``, ``item`` and ``block number`` candidates: one row per item window."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for item, body in zip(frame["item"], frame["body"]):
                words = plain_words(body)
                out += [(b" ".join(words[i : i + size]), item) for i in range(max(1, len(words) - size + 1)) if words]
            yield pd.DataFrame(out, columns=["window", "item"])

    named = items.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("null")).alias("item"), F.col(f"`{text}`").cast("string").alias("body"))
    return cut_lineage(named.mapInPandas(cut, "window binary, item string").distinct(), "llm-windows")


def blocks_of(rows: DataFrame, block: int) -> Iterator[Windows]:
    """Blocks of at most about ``block`` windows; equal windows share a block."""
    n = rows.count()
    parts = max(1, -(-n // block))
    for part in range(parts):
        own = rows.where(F.pmod(F.xxhash64("window"), F.lit(parts)) == part) if parts > 1 else rows
        found = [(bytes(r["window"]), r["item"]) for r in own.toLocalIterator()]
        if found or parts == 1:
            yield Windows.of(found)


def shingle_counts(texts: DataFrame, windows: Windows) -> dict[int, np.ndarray]:
    """How often each shingle of the windows stands in ``texts`` (column ``body``), per shingle width, over all of them."""
    tables = {w: windows.shingles(w) for w in range(1, SHINGLE + 1)}
    sent = texts.sparkSession.sparkContext.broadcast((windows, tables))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        windows, tables = sent.value
        sums = {w: np.zeros(len(t), np.int64) for w, t in tables.items()}
        for frame in batches:
            for body in frame["body"]:
                ids = windows.ids(body)
                for w, table in tables.items():
                    if len(table) and len(ids) >= w:
                        codes = windows.codes(ids, w)
                        codes = codes[codes >= 0]
                        at = np.searchsorted(table, codes)
                        at = at[table[np.minimum(at, len(table) - 1)] == codes]
                        sums[w] += np.bincount(at, minlength=len(table))
        for w, s in sums.items():
            at = np.flatnonzero(s)
            yield pd.DataFrame({"width": w, "at": at, "n": s[at]})

    counted = texts.mapInPandas(count, "width int, at bigint, n bigint").groupBy("width", "at").agg(F.sum("n").alias("n"))
    sums = {w: np.zeros(len(t), np.int64) for w, t in tables.items()}
    for r in counted.toLocalIterator():  # at most one row per shingle of the block
        sums[r["width"]][r["at"]] = r["n"]
    sent.destroy()
    return sums


@dataclass
class PrefixIndex:
    """For one shingle width: sorted prefix shingles, and the (window, offset) pairs that each one begins the search of."""

    codes: np.ndarray
    first: np.ndarray
    windows: np.ndarray
    offsets: np.ndarray


def prefix_index(windows: Windows, counts: dict[int, np.ndarray]) -> dict[int, PrefixIndex]:
    """The rarest shingle of every window (ties: smallest number), grouped by shingle."""
    out = {}
    for w in range(1, SHINGLE + 1):
        own = np.flatnonzero(windows.shingle_widths() == w)
        if not len(own):
            continue
        table = windows.shingles(w)
        codes = windows.codes(windows.words[own], w)
        at = np.searchsorted(table, codes)
        rarity = np.where(codes >= 0, counts[w][np.minimum(at, len(table) - 1)] * len(table) + at, np.iinfo(np.int64).max)
        offset = rarity.argmin(axis=1)
        chosen = codes[np.arange(len(own)), offset]
        order = np.argsort(chosen, kind="stable")
        keys, first = np.unique(chosen[order], return_index=True)
        out[w] = PrefixIndex(keys, np.append(first, len(own)), own[order], offset[order])
    return out


def occurrences(ids: np.ndarray, windows: Windows, index: dict[int, PrefixIndex], chunk: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Starts of windows in a document and the windows' numbers, all of them, in parts of bounded size."""
    for w, prefix in index.items():
        if len(ids) < w:
            continue
        codes = windows.codes(ids, w)
        places = np.flatnonzero(codes >= 0)
        at = np.searchsorted(prefix.codes, codes[places])
        hit = prefix.codes[np.minimum(at, len(prefix.codes) - 1)] == codes[places]
        places, at = places[hit], at[hit]
        many = prefix.first[at + 1] - prefix.first[at]
        low = 0
        ends = np.cumsum(many)
        while low < len(places):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + chunk)))
            n = many[low:high]
            rank = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            entry = np.repeat(prefix.first[at[low:high]], n) + rank
            window = prefix.windows[entry]
            start = np.repeat(places[low:high], n) - prefix.offsets[entry]
            length = windows.lengths[window]
            fits = (start >= 0) & (start + length <= len(ids))
            start, window, length = start[fits], window[fits], length[fits]
            for k in range(windows.words.shape[1]):
                if not len(start):
                    break
                same = (length <= k) | (ids[np.minimum(start + k, len(ids) - 1)] == windows.words[window, k])
                start, window, length = start[same], window[same], length[same]
            if len(start):
                yield start, window
            low = high


def _matcher(windows: Windows, index: dict[int, PrefixIndex]) -> Callable[[str | None], tuple[int, list[int], list[str]]]:
    def match(body: str | None) -> tuple[int, list[int], list[str]]:
        ids = windows.ids(body)
        n = len(ids)
        change = np.zeros(n + 1, np.int64)
        items: set[str] = set()
        seen: set[int] = set()
        for start, window in occurrences(ids, windows, index):
            np.add.at(change, start, 1)
            np.add.at(change, start + windows.lengths[window], -1)
            seen.update(np.unique(window).tolist())
        for one in seen:
            items.update(windows.items[one])
        covered = np.cumsum(change[:n]) > 0
        edges = np.flatnonzero(np.diff(np.concatenate(([False], covered, [False])).astype(np.int8)))
        return n, edges.tolist(), sorted(items)

    return match


def hits(rows: DataFrame, benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text", size: int = 10, block: int = BLOCK) -> DataFrame:
    """``rows`` (with a column ``body``, the text) and a column ``hits``:

    an array of ``n_words``, ``spans`` (word places, start and end in turn, of hit runs) and ``items``, one entry per block of windows; with several
    blocks the first entry has the words only, and blocks without a hit have none. Several blocks are several passes over the written rows: a block's hits
    are written before the next block is made, so the driver and the tasks hold one block at a time, however large the benchmark.
    """
    texts, found = rows.select("body"), window_rows(benchmark, item_id, item_text, size)
    if found.count() <= block:
        windows = next(blocks_of(found, block))
        sent = rows.sparkSession.sparkContext.broadcast((windows, prefix_index(windows, shingle_counts(texts, windows))))
        return rows.withColumn("hits", F.array(_block_udf(sent)(F.col("body"))))
    numbered = cut_lineage(rows.withColumn("_id", F.monotonically_increasing_id()), "llm-numbered")
    written = None
    for windows in blocks_of(found, block):
        index = prefix_index(windows, shingle_counts(numbered.select("body"), windows))
        sent = rows.sparkSession.sparkContext.broadcast((windows, index))
        own = numbered.select("_id", _block_udf(sent)(F.col("body")).alias("h")).where(F.size("h.items") > 0)
        own = cut_lineage(own, "llm-block-hits")
        sent.destroy()
        written = own if written is None else written.unionByName(own)
    merged = written.groupBy("_id").agg(F.collect_list("h").alias("_hits"))
    whole = F.struct(word_counts("body").alias("n_words"), F.array().cast("array<int>").alias("spans"), F.array().cast("array<string>").alias("items"))
    joined = numbered.join(merged, "_id", "left").withColumn("hits", F.concat(F.array(whole), F.coalesce("_hits", F.array().cast(merged.schema["_hits"].dataType))))
    return joined.drop("_id", "_hits")


@F.pandas_udf(LONG)
def word_counts(bodies: pd.Series) -> pd.Series:
    return pd.Series([len(plain_words(b)) for b in bodies], dtype="int64")


def _block_udf(sent):
    @F.pandas_udf("struct<n_words:bigint,spans:array<int>,items:array<string>>")
    def matched(bodies: pd.Series) -> pd.DataFrame:
        match = _matcher(*sent.value)
        return pd.DataFrame([match(b) for b in bodies], columns=["n_words", "spans", "items"])

    return matched


def union_length(spans: list[list[int]]) -> int:
    """Number of words inside any of the runs of several blocks."""
    runs = sorted((s[i], s[i + 1]) for s in spans for i in range(0, len(s), 2))
    total, end = 0, 0
    for a, b in runs:
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


@F.pandas_udf(record(n_words=LONG, n_hit=LONG, n_items=LONG, items_sha256=STRING))
def summary(found: pd.Series) -> pd.DataFrame:
    """Per document over all blocks; item ids are sorted as strings by code point."""
    out = []
    for blocks in found:
        items = sorted({i for b in blocks for i in b["items"]})
        n_hit = union_length([list(b["spans"]) for b in blocks])
        out.append((blocks[0]["n_words"], n_hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest()))
    return pd.DataFrame(out, columns=["n_words", "n_hit", "n_items", "items_sha256"])


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 10, block: int = BLOCK) -> DataFrame:
    """``doc_id``, ``hits`` (spans and item ids) and ``s``, their summary, for every row."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("body"))
    return hits(rows, benchmark, size=size, block=block).drop("body").withColumn("s", summary("hits"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", size: int = 10, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark; exactly the columns of ``docs``."""
    rows = packed(docs, F.col(f"`{text}`").cast("string").alias("body"))
    found = hits(rows, benchmark, size=size, block=block)
    untouched = F.forall("hits", lambda h: F.size(h["items"]) == 0)
    return unpacked(found.where(untouched), docs.columns)
