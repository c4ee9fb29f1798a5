"""Hard negatives by exact inner products, summed from tables instead of multiplied.

Components are integers. A candidate is kept as bit planes: bit ``b`` of its components, eight components to a byte. For every group
of eight components an anchor has a table of its 256 subset sums, so one look-up gives the anchor's share of a plane's byte
(the method of four Russians); look-ups of one plane are added, and planes are added from the highest down, doubling in
between, the highest with a minus sign (two's complement). That is the full inner product, without rounding.

Anchors are a stated query set; they meet all rows in a grid of blocks: ``ANCHORS`` anchors and one slice of the candidates at a
time, in one task each, so neither a label with a third of all rows nor a long list of anchors meets in one place. First
every anchor meets the rows of its own label, and its best ``positives`` are kept; then it meets all rows with the
scores of its positives, and each block hands on the first ``negatives`` rows within each positive's window. What a
block hands on is bounded by its anchors; windows over (anchor, positive) choose among blocks. No pair is left out.

Defined results: rows with a null label, a null or empty vector or an entry that is null or not finite take no part; vectors of
another length than the commonest take none either; every row stands for itself, so a repeated row is another row, its
copies among the anchor's positives; among equal scores smaller ids come first, null ids last, which are never anchors; an
anchor without positives, and a positive without negatives, give no row; an empty table gives an empty result. Scores that might not
fit a long are refused with a ValueError. Only the three named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from searchloom.llm.vectors import commonest_length, finite, matrix, scaled
from searchloom.session import cut_lineage

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
# a negative's score in hundredths of the positive's
WINDOW = (50, 95)
GROUP = 8
# anchors whose tables stand in a worker at a time, and candidates of a slice
ANCHORS = 1024
SLICE = 4096
# a grid has a partition per cell up to so many; beyond them cells share partitions
CELLS = 10_000
# anchors whose sums are formed together: their tables stay in the processor's cache
TOGETHER = 64
ABSENT = np.iinfo(np.int64).min


def plane_bytes(values: np.ndarray, planes: int) -> np.ndarray:
    """Bit planes of two's complement integers: bytes of shape (rows, planes, groups), component 0 in a byte's lowest bit."""
    rows, length = values.shape
    bits = (values[:, None, :] >> np.arange(planes)[None, :, None]) & 1
    padded = np.zeros((rows, planes, -(-length // GROUP) * GROUP), np.uint8)
    padded[:, :, :length] = bits
    return np.packbits(padded, axis=2, bitorder="little")


def subset_sums(anchors: np.ndarray, kind: type = np.int64) -> np.ndarray:
    """Sums of all subsets of every group of eight components: shape (groups, 256, anchors)."""
    count, length = anchors.shape
    groups = -(-length // GROUP)
    padded = np.zeros((count, groups * GROUP), kind)
    padded[:, :length] = anchors
    parts = padded.reshape(count, groups, GROUP).transpose(1, 2, 0)
    tables = np.zeros((groups, 1 << GROUP, count), kind)
    for k in range(GROUP):
        tables[:, 1 << k : 2 << k] = tables[:, : 1 << k] + parts[:, k : k + 1]
    return tables


def scores(tables: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Inner products (candidates, anchors) from ``subset_sums`` and ``plane_bytes``."""
    rows, planes, groups = index.shape
    total = np.zeros((rows, tables.shape[2]), tables.dtype)
    found = np.empty_like(total)
    at = np.ascontiguousarray(index.transpose(1, 2, 0)).astype(np.intp)
    for plane in reversed(range(planes)):
        for group in range(groups):
            np.take(tables[group], at[plane, group], axis=0, out=found, mode="clip")
            total += found
        if plane == planes - 1:
            np.negative(total, out=total)
        if plane:
            total <<= 1
    return total


def planes_for(lowest: int, highest: int, length: int) -> int:
    """Bits that hold all components; refuses components whose scores might not fit a long."""
    bits = max(int(lowest if lowest >= 0 else -lowest - 1).bit_length(), int(highest if highest >= 0 else -highest - 1).bit_length()) + 1
    if length << (2 * bits - 1) >= 1 << 63:
        raise ValueError(f"inner products of {length} components from {lowest} to {highest} might not fit a long")
    return bits


def _blocks(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, pd.DataFrame]]:
    """Anchors of a block and a batch of its candidates; anchors stand before the candidates in sorted batches."""
    held: list[pd.DataFrame] = []
    block: tuple | None = None
    for frame in batches:
        if not len(frame):
            continue
        codes = frame[[*keys, "kind"]].to_numpy()
        cuts = [0, *(np.flatnonzero((codes[1:] != codes[:-1]).any(axis=1)) + 1).tolist(), len(frame)]
        for lo, hi in zip(cuts, cuts[1:]):
            key, kind = tuple(codes[lo, :-1].tolist()), codes[lo, -1]
            if key != block:
                held, block = [], key
            if kind == 0:
                held.append(frame.iloc[lo:hi])
            elif held:
                if len(held) > 1:
                    held = [pd.concat(held)]
                yield held[0], frame.iloc[lo:hi]


def _tabled(anchors: pd.DataFrame, length: int, kind: type) -> Iterator[tuple[slice, np.ndarray]]:
    values = matrix(anchors["x"], length)
    for lo in range(0, len(values), TOGETHER):
        yield slice(lo, lo + TOGETHER), subset_sums(values[lo : lo + TOGETHER], kind)


def _index(candidates: pd.DataFrame, planes: int, length: int) -> np.ndarray:
    return np.frombuffer(b"".join(candidates["planes"]), np.uint8).reshape(len(candidates), planes, -(-length // GROUP))


def _best(ordered: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``count`` first entries of every row; equal ones in the order of columns, ``ABSENT`` never."""
    count = min(count, ordered.shape[1])
    if not count:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # all entries above the count-th largest, and of those equal to it the first ones
    edge = np.partition(ordered, ordered.shape[1] - count, axis=1)[:, -count][:, None]
    above, equal = ordered > edge, ordered == edge
    room = count - above.sum(axis=1, keepdims=True)
    chosen = (above | (equal & (np.cumsum(equal, axis=1) <= room))) & (ordered != ABSENT)
    return np.nonzero(chosen)


def packed_planes(planes: int, length: int):
    @F.pandas_udf("binary")
    def pack(vectors: pd.Series) -> pd.Series:
        found = plane_bytes(matrix(vectors, length), planes).reshape(len(vectors), -1)
        return pd.Series([row.tobytes() for row in found], dtype=object)

    return pack


def usable(rows: DataFrame, vec_id: str, vector: str, label: Column, scale: int) -> tuple[DataFrame, int]:
    """``row`` (a number of its own), ``vec_id``, ``label`` and integer components ``x`` of the rows that take part; their length."""
    kept = rows.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(f"`{vector}`").alias("x"))
    kept = kept.where(F.col("label").isNotNull() & finite(F.col("x")))
    # a null id is a zero with a mark: workers then see whole numbers only
    number, none = F.monotonically_increasing_id().alias("row"), F.col("vec_id").isNull().alias("none")
    kept = kept.select(number, F.coalesce("vec_id", F.lit(0)).alias("vec_id"), none, "label", scaled(F.col("x"), scale).alias("x"))
    kept = cut_lineage(kept, "llm-vectors")
    length = commonest_length(kept)
    return kept.where(F.size("x") == length), length


def _grid(anchors: DataFrame, candidates: DataFrame, slices: Column, blocks: Column, cells: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Anchors in every slice and candidates in every block of anchors, dealt by (keys, block, slice), anchors first.

    ``slices`` and ``blocks`` say of each row how many there are of them; a row's own one comes from its number. The number of partitions is
    given, since the work of a cell lies in its pairs and not in its bytes.
    """
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    own = lambda n: F.pmod(F.xxhash64("row"), n)
    left = anchors.select("*", own(blocks).alias("block"), spread(slices).alias("slice"), F.lit(0).alias("kind"))
    right = candidates.select("*", own(slices).alias("slice"), spread(blocks).alias("block"), F.lit(1).alias("kind"))
    both = left.unionByName(right, allowMissingColumns=True)
    if keys:
        dealt = both.repartition(min(cells, CELLS), *keys, "block", "slice")
    else:
        dealt = both.repartitionById(min(cells, CELLS), F.pmod(F.col("block") * slices + F.col("slice"), F.lit(min(cells, CELLS))).cast("int"))
    return dealt.sortWithinPartitions(*keys, "block", "slice", "kind", "none", "vec_id", "row")


def _parts(count: Column, size: int) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.ceil(count / F.lit(float(size))).cast("long"))


def mined(
    rows: DataFrame, is_anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: Column | None = None,
    scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW,
    anchors_at_once: int = ANCHORS, slice_rows: int = SLICE,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score`` and ``negative_score`` of every anchor's positives.

    ``is_anchor`` is a condition on the column ``vec_id``; ``label`` an expression over ``rows``, the column ``label`` if not given. The window is in
    hundredths of the positive's score, both ends included.
    """
    kept, length = usable(rows, vec_id, vector, F.col("label") if label is None else label, scale)
    bounds = kept.agg(F.min(F.array_min("x")).alias("lo"), F.max(F.array_max("x")).alias("hi")).first()
    planes = planes_for(bounds["lo"] or 0, bounds["hi"] or 0, length)
    # sums on the way stay below length x 2^(2 x planes), so that narrow components need only half the memory
    kind = np.int32 if max(1, length) << 2 * planes < 1 << 31 else np.int64
    candidates = kept.select("row", "vec_id", "none", "label", packed_planes(planes, length)("x").alias("planes"))
    candidates = cut_lineage(candidates, "llm-planes")
    asks = ~F.col("none") & is_anchor
    anchors = kept.where(asks)
    sizes = kept.groupBy("label").agg(F.count("*").alias("_all"), F.count_if(asks).alias("_asked"))
    sizes = cut_lineage(sizes, "llm-label-sizes")
    slices, blocks = _parts(F.col("_all"), slice_rows), _parts(F.col("_asked"), anchors_at_once)
    totals = sizes.agg(F.sum("_all").alias("n"), F.sum("_asked").alias("asked"), F.sum(slices * blocks).alias("cells")).first()
    label_cells = max(1, totals["cells"] or 0)

    def same_label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for asked, rest in _blocks(batches, ["label", "block", "slice"]):
            index = _index(rest, planes, length)
            number, ids, none = (rest[n].to_numpy() for n in ("row", "vec_id", "none"))
            for part, tables in _tabled(asked, length, kind):
                found = scores(tables, index).T.astype(np.int64)
                own = asked.iloc[part]
                found[own["row"].to_numpy()[:, None] == number[None, :]] = ABSENT
                a, c = _best(found, positives)
                yield pd.DataFrame(
                    {"row": own["row"].to_numpy()[a], "anchor_id": own["vec_id"].to_numpy()[a], "positive": number[c],
                     "positive_id": ids[c], "positive_none": none[c], "positive_score": found[a, c]}
                )

    with_size = lambda df: df.join(sizes.where("_asked > 0"), "label")
    near = _grid(with_size(anchors), with_size(candidates), slices, blocks, label_cells, ("label",)).mapInPandas(
        same_label, "row bigint, anchor_id bigint, positive bigint, positive_id bigint, positive_none boolean, positive_score bigint"
    )
    first = Window.partitionBy("row").orderBy(F.desc("positive_score"), "positive_none", "positive_id", "positive")
    chosen = cut_lineage(near.withColumn("_at", F.row_number().over(first)).where(F.col("_at") <= positives).drop("_at"), "llm-positives")
    # an anchor row with the list of its positives, at most ``positives`` of them
    listed = chosen.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("positive", "positive_score"))).alias("goals"))
    low, high = window

    def other_labels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for asked, rest in _blocks(batches, ["block", "slice"]):
            index = _index(rest, planes, length)
            number, ids, none, labels = (rest[n].to_numpy() for n in ("row", "vec_id", "none", "label"))
            for part, tables in _tabled(asked, length, kind):
                own = asked.iloc[part]
                found = scores(tables, index).T.astype(np.int64)
                found[own["label"].to_numpy()[:, None] == labels[None, :]] = ABSENT
                goals = np.full((len(own), positives), ABSENT)
                named = np.zeros((len(own), positives), np.int64)
                for i, items in enumerate(own["goals"]):
                    for k, item in enumerate(items):
                        named[i, k], goals[i, k] = item["positive"], item["positive_score"]
                for k in range(positives):
                    there = np.flatnonzero(goals[:, k] != ABSENT)
                    if not len(there):
                        break
                    goal, mine = goals[there, k][:, None], found[there]
                    # 100 x score between low x goal and high x goal, as whole bounds of the score
                    least, most = -((-low * goal) // 100), (high * goal) // 100
                    inside = np.where((mine >= least) & (mine <= most), mine, ABSENT)
                    a, c = _best(inside, negatives)
                    yield pd.DataFrame(
                        {"row": own["row"].to_numpy()[there][a], "positive": named[there, k][a], "negative": number[c],
                         "negative_id": ids[c], "negative_none": none[c], "negative_score": inside[a, c]}
                    )

    n_slices, n_blocks = (max(1, math.ceil((totals[n] or 0) / size)) for n, size in (("n", slice_rows), ("asked", anchors_at_once)))
    far = _grid(anchors.join(listed, "row"), candidates, F.lit(n_slices).cast("long"), F.lit(n_blocks).cast("long"), n_slices * n_blocks).mapInPandas(
        other_labels, "row bigint, positive bigint, negative bigint, negative_id bigint, negative_none boolean, negative_score bigint"
    )
    best = Window.partitionBy("row", "positive").orderBy(F.desc("negative_score"), "negative_none", "negative_id", "negative")
    ranked = far.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    real = lambda name: F.when(~F.col(f"{name}_none"), F.col(f"{name}_id")).alias(f"{name}_id")
    joined = ranked.join(chosen, ["row", "positive"])
    return joined.select("anchor_id", real("positive"), "rank", real("negative"), "positive_score", "negative_score")
