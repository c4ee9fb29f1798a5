"""Near-duplicate groups from SimHash fingerprints.

A document's fingerprint has a bit set where more than half of its shingle hashes have it. Only distinct
fingerprints are compared: a group of a million equal documents is one row. Pairs within ``distance`` bits are found by
pigeonhole blocks: the 64 bits are cut into ``blocks`` parts, two fingerprints that differ in at most
``distance`` bits agree in ``blocks - distance`` of them, and every choice of that many parts is a join key. Fingerprints
of a key are verified by Hamming distance where the key puts them. A key with many fingerprints is cut again by
the same argument on the bits the key leaves open, so no group is compared pair by pair. Each key hands on a spanning
forest of its links, never all pairs; components are then found by joins.

Defined results: null and empty texts have fingerprint zero and are linked like any other; fewer words than a
shingle give one shingle of all words; repeated rows, also with equal ids, share a component; a null id never becomes
a component's name unless all ids of it are null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchloom.llm.components import smallest_reachable
from searchloom.llm.text import LONG, lower_space_words, packed, unpacked
from searchloom.session import cut_lineage

BITS = 64
SEED = 42
# fingerprints of one key that are compared directly; more are cut into smaller keys first
DIRECT = 256


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles."""
    words = lower_space_words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = np.array([digest(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[: n - 1]))
        stops = ends[width - 1 :] - 1
        hashes = np.fromiter(
            (digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), stops.tolist())), np.uint64, n
        )
    counts = np.zeros(BITS, np.int64)
    for low in range(0, n, 1 << 14):  # bounded memory for very long texts
        part = hashes[low : low + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(((counts * 2 > n).astype(np.uint64) << np.arange(BITS, dtype=np.uint64)).sum())


@F.pandas_udf(LONG)
def fingerprints(texts: pd.Series) -> pd.Series:
    values = np.fromiter((fingerprint(t) for t in texts), np.uint64, len(texts))
    return pd.Series(values.view(np.int64))


def block_masks(blocks: int, distance: int) -> list[int]:
    """A mask for every choice of ``blocks - distance`` of the ``blocks`` parts of 64 bits."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    parts = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(parts, blocks - distance)]


def close_pairs(values: np.ndarray, distance: int, free: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that link all ``values`` within ``distance`` bits of each other; they differ only in ``free`` bits.

    Small sets are compared directly. Larger ones are cut by pigeonhole on the free bits: ``distance + 1`` parts, one
    of which a close pair shares. A value has few free bits left after some cuts, so the recursion ends.
    """
    m = len(values)
    bits = [b for b in range(BITS) if free >> b & 1]
    if m <= DIRECT or len(bits) <= distance:
        left, right = np.triu_indices(m, 1)
        near = np.bitwise_count(values[left] ^ values[right]) <= distance
        return left[near], right[near]
    found_left, found_right = [], []
    for part in np.array_split(np.array(bits), distance + 1):
        mask = sum(1 << int(b) for b in part)
        keys = values & np.uint64(mask)
        order = np.argsort(keys, kind="stable")
        cuts = np.flatnonzero(np.diff(keys[order])) + 1
        for group in np.split(order, cuts):
            if len(group) > 1:
                a, b = close_pairs(values[group], distance, free & ~mask)
                found_left.append(group[a])
                found_right.append(group[b])
    if not found_left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(found_left), np.concatenate(found_right)


def spanning(m: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of ``m`` members the smallest member it is linked with, directly or not."""
    root = np.arange(m)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def links(prints: DataFrame, distance: int = 2, blocks: int = 5) -> DataFrame:
    """Links (``a`` < ``b``) whose transitive closure joins all of the distinct ``prints`` within ``distance`` bits."""
    masks = block_masks(blocks, distance)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)])
    keyed = prints.select("fp", F.explode(keys).alias("_k")).select("fp", "_k.mask", "_k.key")
    # keys that hold one fingerprint need no further work; the count combines before the shuffle
    shared = keyed.groupBy("mask", "key").agg(F.count("*").alias("_n"), F.min("fp").alias("_min"), F.max("fp").alias("_max"))
    pairs = shared.where("_n = 2").select(F.col("_min").alias("a"), F.col("_max").alias("b"))
    pairs = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    larger = keyed.join(shared.where("_n > 2").select("mask", "key"), ["mask", "key"], "left_semi")
    # large keys are cut again, in the plan, by a part of the bits that the key leaves open: a close pair shares one
    parts = []
    for m in masks:
        open_bits = [b for b in range(BITS) if not m >> b & 1]
        cut = [sum(1 << int(b) for b in part) for part in np.array_split(np.array(open_bits), distance + 1)]
        parts.append([p - (1 << 64) if p >> 63 else p for p in cut])
    cut_of = F.array(*[F.array(*[F.lit(p) for p in row]) for row in parts])
    sub = (
        larger.select("fp", "mask", "key", F.posexplode(F.element_at(cut_of, F.col("mask") + 1)).alias("part", "_p"))
        .select("fp", "mask", "key", "part", F.col("fp").bitwiseAND(F.col("_p")).alias("rest"))
    )

    def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in groups_of(batches, ["mask", "part", "key", "rest"]):
            mask, part = int(frame["mask"].iloc[0]), int(frame["part"].iloc[0])
            values = np.unique(frame["fp"].to_numpy(np.int64).view(np.uint64))
            fixed = masks[mask] | (parts[mask][part] & (2**64 - 1))
            left, right = close_pairs(values, distance, (2**64 - 1) & ~fixed)
            root = spanning(len(values), left, right)
            other = np.flatnonzero(root != np.arange(len(values)))
            if len(other):
                ends = np.sort(np.stack([values[root[other]].view(np.int64), values[other].view(np.int64)]), axis=0)
                yield pd.DataFrame({"a": ends[0], "b": ends[1]})

    dealt = sub.repartition("mask", "part", "key", "rest").sortWithinPartitions("mask", "part", "key", "rest")
    return pairs.unionByName(dealt.mapInPandas(within, "a bigint, b bigint")).distinct()


def groups_of(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of one key each from batches sorted by ``keys``; a key may span batches."""
    kept: list[pd.DataFrame] = []
    last = None
    for frame in batches:
        if not len(frame):
            continue
        codes = frame[keys].to_numpy()
        cuts = [0, *(np.flatnonzero((codes[1:] != codes[:-1]).any(axis=1)) + 1).tolist(), len(frame)]
        for lo, hi in zip(cuts, cuts[1:]):
            key = tuple(codes[lo].tolist())
            if last is not None and key != last:
                group = pd.concat(kept) if len(kept) > 1 else kept[0]
                kept = []
                if len(group) > 1:
                    yield group
            kept.append(frame.iloc[lo:hi])
            last = key
    if kept:
        group = pd.concat(kept) if len(kept) > 1 else kept[0]
        if len(group) > 1:
            yield group


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = 2, blocks: int = 5) -> DataFrame:
    """``doc_id``, ``fp`` (signed 64 bit) and ``component_id``, the smallest id reachable over links, for every row."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), fingerprints(F.col(f"`{text}`").cast("string")).alias("fp"))
    rows = cut_lineage(rows, "llm-fingerprints")
    return rows.join(_labels(rows, distance, blocks), "fp", "left").select("doc_id", "fp", F.coalesce("component", "own").alias("component_id"))


def _labels(rows: DataFrame, distance: int, blocks: int) -> DataFrame:
    """One row per fingerprint: ``own``, the smallest id with it, and ``component``, the smallest reachable (null: no link)."""
    prints = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("own")), "llm-prints")
    edges = cut_lineage(links(prints, distance, blocks), "llm-links")
    reach = smallest_reachable(edges)  # node, root: a fingerprint that stands for the component
    named = reach.join(prints, reach["node"] == prints["fp"]).groupBy("root").agg(F.min("own").alias("component"))
    members = reach.join(named, "root").select(F.col("node").alias("fp"), "component")
    # written, so that both sides of the join with all rows are plain exchanges: the planner then splits a crowded fingerprint
    return cut_lineage(prints.join(members, "fp", "left"), "llm-labels")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = 2, blocks: int = 5) -> DataFrame:
    """One row of each component, that of its smallest id (null ids last); exactly the columns of ``docs``."""
    rows = packed(docs, F.col(f"`{doc_id}`").alias("doc_id"), fingerprints(F.col(f"`{text}`").cast("string")).alias("fp"))
    small = cut_lineage(rows.select("doc_id", "fp"), "llm-fingerprints")
    labels = _labels(small, distance, blocks)
    component = F.coalesce("component", "own")
    chosen = labels.where(F.col("own").eqNullSafe(component)).select(F.col("fp").alias("_fp"), F.col("own").alias("_own"))
    # a fingerprint stays if it holds the component's smallest id; of its rows the first with that id
    joined = rows.join(chosen, (F.col("fp") == F.col("_fp")) & F.col("doc_id").eqNullSafe(F.col("_own")), "left_semi")
    first = joined.groupBy("doc_id", "fp").agg(F.first("_row").alias("_row"))
    return unpacked(first, docs.columns)
