"""Removal of byte strings that occur more than once in the corpus, found by suffix arrays.

A window is ``window`` consecutive bytes of one text. Every byte inside a window that also starts anywhere else is
removed; windows are judged on the input.

1. Equal texts are counted and kept once, in a table bucketed by their digest, so later joins move no text.
2. Every window is named by the smallest hash of the byte grams (half a window long) inside it, the first of equally small ones.
   Equal windows have equal names at equal distances. Neighbouring windows named by one gram form a piece. Names of one
   piece cannot repeat and are dropped.
3. Equal pieces are counted and kept once. Pieces of one name meet in one task, are laid end to end, and their suffixes are ordered by
   two-stage sorting; neighbours that share a whole window are occurrences of the same string.
4. A name with more than ``group`` different pieces is not sorted in one task: its pieces are cut into shorter ones, named
   by the hash of the bytes that ``STEPS`` windows share, and at last into single windows, which are counted. Nothing is dropped.

Defined results: a null text is an empty one; a text shorter than a window keeps everything; repeated rows, also with
equal ids, are occurrences of each other; very long texts are read in slices of bounded memory; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchloom.llm.suffixes import common_prefixes, suffix_order, words_at
from searchloom.llm.text import fresh, packed
from searchloom.session import cut_lineage, scratch_path

WINDOW = 400
# windows hashed at once, so that a very long text needs bounded memory
SLICE = 1 << 18
# different pieces of one name that one task sorts
GROUP = 2000
# windows that share a name after the first and the second cut of a crowded name
STEPS = (32, 1)
# bytes that one suffix array covers; one group more at the most
ARRAY_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
# bits for a place inside a slice
_PLACE = np.uint64((1 << 20) - 1)


class GramHash:
    """Hashes of all byte grams of a width, by prefix sums of a polynomial modulo 2**64 and a final mix."""

    def __init__(self, width: int, length: int):
        self.width = width
        self.power = np.cumprod(np.full(length, _BASE, np.uint64))
        self.inverse = np.cumprod(np.full(length, pow(_BASE, -1, 2**64), np.uint64))

    def __call__(self, text: np.ndarray) -> np.ndarray:
        n = len(text) - self.width + 1
        sums = np.zeros(len(text) + 1, np.uint64)
        np.cumsum((text.astype(np.uint64) + np.uint64(1)) * self.power[: len(text)], out=sums[1:])
        value = (sums[self.width :] - sums[:n]) * self.inverse[:n]
        value ^= value >> np.uint64(32)
        value *= _MIX
        value ^= value >> np.uint64(29)
        return value


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` consecutive values, by running minima of blocks from both sides."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


_HASHES: dict[int, GramHash] = {}


def _hasher(window: int) -> GramHash:
    if window not in _HASHES:
        _HASHES[window] = GramHash(window // 2, SLICE + window)
    return _HASHES[window]


def window_grams(text: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window of ``text`` (uint8) the place and the hash of the gram that names it."""
    hasher, width = _hasher(window), window - window // 2 + 1
    places, names = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for low in range(0, len(text) - window + 1, SLICE):
        hashes = hasher(text[low : low + SLICE + window - 1])
        # the high bits of the hash decide, then the place
        ranked = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
        at = (sliding_min(ranked, width) & _PLACE).astype(np.int64)
        places.append(at + low)
        names.append(hashes[at])
    return np.concatenate(places), np.concatenate(names)


def runs(places: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Name, first and last window of every run of windows named by one gram."""
    starts = np.concatenate(([0], np.flatnonzero(np.diff(places)) + 1))
    return names[starts], starts, np.concatenate((starts[1:], [len(places)])) - 1


def _distinct_texts(docs: DataFrame, text: str) -> tuple[str, DataFrame]:
    """Name of a table of the distinct texts with their number of rows, bucketed by digest; and every row with its ``_digest``."""
    spark = docs.sparkSession
    rows = docs.withColumn("_body", F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    digest = F.substring(F.unhex(F.sha2("_body", 256)), 1, 16)
    counted = rows.select(digest.alias("digest"), F.col("_body").alias("body")).groupBy("digest").agg(
        F.first("body").alias("body"), F.count("*").alias("n")
    )
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = fresh("llm_texts").replace("-", "_")
    counted.write.bucketBy(buckets, "digest").option("path", scratch_path(spark, "llm-texts")).saveAsTable(name)
    return name, rows.select(*docs.columns, digest.alias("_digest"))


def _judged(spark: SparkSession, table: str, window: int, group: int) -> DataFrame:
    """What ``_removed`` finds for every distinct text, written; the table of texts is then forgotten."""
    texts = spark.table(table)
    found = cut_lineage(_removed(texts, _spans(_members(texts, window), window, group)), "llm-removed")
    spark.sql(f"DROP TABLE {table}")
    return found


def _pieces(texts: DataFrame, window: int) -> DataFrame:
    """One row per text that has a window: its pieces as arrays ``h`` (name), ``s`` and ``e`` (first and last window)."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for digest, body, n in zip(frame["digest"], frame["body"], frame["n"]):
                raw = np.frombuffer(body.encode(), np.uint8)
                if len(raw) >= window:
                    h, s, e = runs(*window_grams(raw, window))
                    out.append((digest, n, h.view(np.int64), s.astype(np.int32), e.astype(np.int32)))
            yield pd.DataFrame(out, columns=["digest", "n", "h", "s", "e"])

    kind = "digest binary, n bigint, h array<bigint>, s array<int>, e array<int>"
    return cut_lineage(texts.mapInPandas(cut, kind), "llm-pieces")


def _members(texts: DataFrame, window: int) -> DataFrame:
    """Pieces whose name occurs at least twice: ``h``, ``x`` (digest of the bytes), ``n``, ``digest``, ``s``, ``piece``."""
    pieces = _pieces(texts, window)
    named = pieces.select("digest", "n", F.explode(F.arrays_zip("h", "s", "e")).alias("p")).select("digest", "n", "p.h", "p.s", "p.e")
    # written, so that both sides of the join are plain exchanges: the planner then splits a crowded name
    repeated = cut_lineage(named.groupBy("h").agg(F.sum("n").alias("c")).where("c > 1").select("h"), "llm-names")
    chosen = named.join(repeated, "h", "left_semi").groupBy("digest").agg(F.collect_list(F.struct("h", "s", "e")).alias("p"))

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out: list[tuple] = []
            size = 0
            for digest, body, n, own in zip(frame["digest"], frame["body"], frame["n"], frame["p"]):
                raw = body.encode()
                for p in own:
                    piece = raw[p["s"] : p["e"] + window]
                    out.append((p["h"], xxhash.xxh3_128_digest(piece), n, digest, p["s"], piece))
                    size += len(piece)
                if size > 1 << 22:
                    yield pd.DataFrame(out, columns=_MEMBER)
                    out, size = [], 0
            yield pd.DataFrame(out, columns=_MEMBER)

    return cut_lineage(texts.join(chosen, "digest").mapInPandas(extract, _MEMBER_KIND), "llm-members")


_MEMBER = ["h", "x", "n", "digest", "s", "piece"]
_MEMBER_KIND = "h bigint, x binary, n bigint, digest binary, s int, piece binary"


def shorter(piece: bytes, window: int, step: int) -> Iterator[tuple[int, int, int]]:
    """Cuts of a piece: new name, first and last window.

    Windows go together by their distance from the gram that names them all, in steps of ``step``; they share the
    bytes that name the cut. The distance depends on a window's own bytes alone, so equal windows get equal names.
    """
    raw = np.frombuffer(piece, np.uint8)
    starts = np.arange(len(raw) - window + 1)
    if step == 1:
        for p in starts.tolist():
            yield xxhash.xxh3_64_intdigest(piece[p : p + window]), p, p
        return
    mark = window_grams(raw, window)[0]
    part = (mark - starts) // step
    cuts = np.flatnonzero(np.diff(part)) + 1
    edges = [0, *cuts.tolist(), len(starts)]
    for low, high in zip(edges, edges[1:]):
        first = int(mark[low] - part[low] * step)  # the last window that the step can hold
        yield xxhash.xxh3_64_intdigest(piece[first : first + window - step + 1], step), low, high - 1


def _cut_crowded(members: DataFrame, crowded: DataFrame, window: int, step: int) -> DataFrame:
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for low in range(0, len(frame), 100):
                out = []
                for n, digest, s, piece in frame.iloc[low : low + 100][["n", "digest", "s", "piece"]].itertuples(index=False):
                    for name, first, last in shorter(piece, window, step):
                        part = piece[first : last + window]
                        signed = name - (1 << 64) if name >> 63 else name
                        out.append((signed, xxhash.xxh3_128_digest(part), n, digest, s + first, part))
                yield pd.DataFrame(out, columns=_MEMBER)

    return members.join(crowded, "h", "left_semi").mapInPandas(cut, _MEMBER_KIND)


def repeated_spans(pieces: list[bytes], counts: np.ndarray, window: int) -> list[list[int]]:
    """Per piece the byte runs, start and end in turn, inside windows that occur at least twice; ``counts``: occurrences of each piece."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    text = np.frombuffer(b"".join(pieces), np.uint8)
    words = words_at(text)
    owner = np.repeat(np.arange(len(pieces)), sizes)
    ends = np.cumsum(sizes)
    order = suffix_order(text, window, words)
    order = order[order + window <= ends[owner[order]]]
    shared = common_prefixes(order, words, window)
    string = np.cumsum(shared < window) - 1
    times = np.bincount(string, weights=counts[owner[order]])
    twice = order[times[string] >= 2]
    change = np.zeros(len(text) + 1, np.int64)
    np.add.at(change, twice, 1)
    np.add.at(change, twice + window, -1)
    covered = np.cumsum(change[:-1]) > 0
    edge = np.zeros(len(text) + 1, bool)
    edge[1:-1] = covered[1:] != covered[:-1]
    edge[ends[:-1]] = True  # a run ends with its piece
    edge[0] = edge[-1] = True
    cuts = np.flatnonzero(edge)
    lows, highs = cuts[:-1], cuts[1:]
    keep = covered[lows]
    out: list[list[int]] = [[] for _ in pieces]
    begin = ends - sizes
    for low, high in zip(lows[keep].tolist(), highs[keep].tolist()):
        i = int(owner[low])
        out[i] += [low - int(begin[i]), high - int(begin[i])]
    return out


def _sorted_groups(distinct: DataFrame, window: int) -> DataFrame:
    """``h``, ``x`` and the repeated ``spans`` of every distinct piece that has some."""

    def sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []
        size, last = 0, None

        def done() -> pd.DataFrame:
            frame = pd.concat(kept)
            spans = repeated_spans(list(frame["piece"]), frame["n"].to_numpy(), window)
            return frame.assign(spans=spans)[["h", "x", "spans"]][[bool(s) for s in spans]]

        for frame in batches:
            if not len(frame):
                continue
            names = frame["h"].to_numpy()
            cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(frame)]
            weight = np.concatenate(([0], np.cumsum(frame["piece"].map(len).to_numpy())))
            for low, high in zip(cuts, cuts[1:]):
                if size >= ARRAY_BYTES and names[low] != last:
                    yield done()
                    kept, size = [], 0
                kept.append(frame.iloc[low:high])
                size += int(weight[high] - weight[low])
                last = names[low]
        if kept:
            yield done()

    dealt = distinct.repartition("h").sortWithinPartitions("h")
    return dealt.mapInPandas(sort, "h bigint, x binary, spans array<int>")


def _spans(members: DataFrame, window: int, group: int) -> DataFrame:
    """``digest`` and ``spans`` (byte places in the text) of every piece with repeated windows."""
    found, level = [], members
    for step in (*STEPS, None):
        distinct = level.groupBy("h", "x").agg(F.sum("n").alias("n"), F.first("piece").alias("piece"))
        sizes = level.select("h", "x").distinct().groupBy("h").agg(F.count("*").alias("c"))
        crowded = cut_lineage(sizes.where(F.col("c") > group).select("h"), "llm-crowded") if step else None
        more = crowded is not None and not crowded.isEmpty()
        calm = distinct.join(crowded, "h", "left_anti") if more else distinct
        spans = cut_lineage(_sorted_groups(calm, window), "llm-spans")
        own = level.select("h", "x", "digest", "s").join(spans, ["h", "x"])
        found.append(own.select("digest", F.transform("spans", lambda p: p + F.col("s")).alias("spans")))
        if not more:
            break
        level = cut_lineage(_cut_crowded(level, crowded, window, step), "llm-members")
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out


def _removed(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """Per text ``n_bytes``, ``removed`` (maximal runs), ``kept_sha256``."""

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for digest, body, lists in zip(frame["digest"], frame["body"], frame["lists"]):
                raw = body.encode()
                merged = merge_runs([one for one in lists] if lists is not None else [])
                out.append((digest, len(raw), merged, hashlib.sha256(without(raw, merged)).hexdigest()))
            yield pd.DataFrame(out, columns=["digest", "n_bytes", "removed", "kept_sha256"])

    lists = spans.groupBy("digest").agg(F.collect_list("spans").alias("lists"))
    kind = "digest binary, n_bytes bigint, removed array<int>, kept_sha256 string"
    return texts.join(lists, "digest", "left").select("digest", "body", "lists").mapInPandas(remove, kind)


def merge_runs(lists: list) -> list[int]:
    """Maximal runs, start and end in turn, of the union of lists of runs."""
    pairs = sorted((int(s[i]), int(s[i + 1])) for s in lists for i in range(0, len(s), 2))
    out: list[int] = []
    for low, high in pairs:
        if out and low <= out[-1]:
            out[-1] = max(out[-1], high)
        else:
            out += [low, high]
    return out


def without(raw: bytes, runs_: list[int]) -> bytes:
    edges = [0, *runs_, len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))


def repeated_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``removed`` (maximal byte runs, start and end in turn) and ``kept_sha256`` of every row."""
    table, rows = _distinct_texts(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), "text")
    found = _judged(docs.sparkSession, table, window, group)
    return rows.select("doc_id", "_digest").join(found, F.col("_digest") == F.col("digest")).drop("_digest", "digest")


def remove_repeats(docs: DataFrame, text: str = "text", window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """``docs`` with the repeated bytes gone from ``text``; bytes of a character cut in two become a replacement sign.

    Columns are packed away, whatever their names; null texts stay null.
    """
    table, rows = _distinct_texts(packed(docs, F.col(f"`{text}`").cast("string").alias("text")), "text")
    found = _judged(docs.sparkSession, table, window, group).select("digest", "removed")

    @F.pandas_udf("string")
    def cut(bodies: pd.Series, removed: pd.Series) -> pd.Series:
        return pd.Series([b if b is None else without(b.encode(), list(r)).decode(errors="replace") for b, r in zip(bodies, removed)], dtype=object)

    joined = rows.join(found, F.col("_digest") == F.col("digest"))
    return joined.select(*[(cut("text", "removed") if c == text else F.col("_row").getField(c)).alias(c) for c in docs.columns])
