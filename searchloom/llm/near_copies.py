"""Near-duplicate groups: SimHash blocks find candidates, the exact Jaccard similarity of word shingles decides.

Equal texts are one node, so a group of a million exact copies is one row. A node's fingerprint has one bit for each of many
random halvings of the shingles: the half that most of its shingles fall in. Two texts at similarity s differ in a share
acos(2 s / (1 + s)) / pi of the bits, 0.15 at 0.8. The fingerprint is cut into blocks; nodes that share a block and differ in
at most ``FAR`` of the ``SKETCH`` first bits are joined to a candidate group. A block has about as many bits as the number of nodes
has digits in base two, so chance fills a bucket with few nodes at any size, and there are as many blocks as keep the
chance that a pair at exactly 0.8 shares none below ``MISSED``.

A bucket hands on a spanning forest, never pairs, and a node lies in one candidate group only, so each text travels once: to the
cell of its group, where the shingle sets are compared and again only a forest is handed on. A group beyond a cell's size is cut
into chunks. Its nodes are first compared with one of them; those it is similar to belong together and need no comparison
among themselves; the open ones then meet all chunks, a cell for each pair of chunks. So crowds of copies cost their size, and
only a crowd whose members are alike but not similar costs its square, spread over cells of bounded size.

Defined results: null texts and texts without words are one node without shingles; fewer words than a shingle give one shingle of all words;
of repeated rows one stays; null ids come last, and a group that has only null ids keeps one row; very long texts are read whole, in
pieces of bounded memory, and fill a chunk of their own; an empty table gives an empty result. Columns are packed away,
whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from searchloom.llm.components import smallest_reachable
from searchloom.llm.simhash import groups_of, spanning
from searchloom.llm.text import lower_space_words, packed, unpacked
from searchloom.session import cut_lineage

WIDTH = 5
SIMILAR = 0.8
SEED = 42
# chance that a pair at the required similarity shares no block
MISSED = 0.01
SHORTEST = 16
# bits that verify a shared block, and how many of them may differ: unrelated texts differ in half of them
SKETCH, FAR = 128, 32
# fingerprints of a bucket that are compared all at once, and up to which buckets are compared together
DIRECT, FEW = 2048, 16
# bits within which members of a crowded bucket are taken for their centre
NEAR = 4
# rows of two numbers that are sent to all tasks, some 30 MB there; larger tables meet the texts by a shuffle
SENT = 500_000
# nodes and bytes of text in a chunk of a group
CHUNK_NODES, CHUNK_BYTES = 512, 8 << 20


def shingle_hashes(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """64-bit hash of every run of ``width`` words; of all words where there are fewer; none without words."""
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-width]))
    stops = ends[width - 1 :] - 1
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), stops.tolist())), np.uint64, len(starts))


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(shingle_hashes(lower_space_words(text)))


def node_of(body: Column) -> Column:
    """Number that stands for a text; 0 for all texts without words."""
    return F.when(body.rlike(r"[^\x20\x09-\x0D]"), F.xxhash64(body)).otherwise(F.lit(0).cast("long"))


def differing(similar: float) -> float:
    """Share of fingerprint bits in which two sets of one size differ at a Jaccard similarity."""
    return math.acos(2 * similar / (1 + similar)) / math.pi


def blocks_for(nodes: int, similar: float = SIMILAR) -> tuple[int, int]:
    """Number of blocks and bits of each for a table of so many nodes."""
    bits = max(SHORTEST, (max(nodes, 1) - 1).bit_length() - 1)
    shared = (1 - differing(similar)) ** bits
    return math.ceil(math.log(MISSED) / math.log1p(-shared)), bits


def bit_counts(rows: np.ndarray) -> np.ndarray:
    """How many ``rows`` (n, words) of 64-bit words have each bit: full adders work on whole columns of words."""
    counts = np.zeros(rows.shape[1] * 64, np.int64)
    weight, current = 0, rows
    while len(current):
        carried = []
        while len(current) >= 3:
            m = len(current) // 3
            a, b, c = current[:m], current[m : 2 * m], current[2 * m : 3 * m]
            odd = a ^ b
            carried.append((a & b) | (odd & c))
            current = np.concatenate([odd ^ c, current[3 * m :]])
        bytes_of = np.ascontiguousarray(current).astype("<u8").view(np.uint8)
        counts += np.unpackbits(bytes_of, axis=1, bitorder="little").sum(axis=0, dtype=np.int64) << weight
        current = np.concatenate(carried) if carried else current[:0]
        weight += 1
    return counts


def wide_bits(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Fingerprint of a set of shingle hashes: ``bits`` zeros and ones."""
    words = -(-bits // 64)
    salts = np.random.default_rng(SEED).integers(0, 1 << 63, (2, words), np.uint64)
    counts = np.zeros(words * 64, np.int64)
    for low in range(0, len(hashes), 4096):  # bounded memory for very long texts
        mixed = (hashes[low : low + 4096, None] ^ salts[0]) * (salts[1] | np.uint64(1))
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        counts += bit_counts(mixed)
    return (2 * counts[:bits] > len(hashes)).astype(np.uint8)


def block_keys(bits: np.ndarray, blocks: int, width: int) -> np.ndarray:
    """One number per block, with the block's own number above its bits."""
    values = bits[: blocks * width].reshape(blocks, width).astype(np.int64) @ (np.int64(1) << np.arange(width, dtype=np.int64))
    return values | np.arange(blocks, dtype=np.int64) << width


def signer(blocks: int, width: int):
    """Column function: block keys and sketch of each text; no keys for a text without words, which has no shingle to share."""

    @F.pandas_udf("struct<keys: array<bigint>, s0: bigint, s1: bigint>")
    def signed(texts: pd.Series) -> pd.DataFrame:
        keys, sketches = [], np.zeros((len(texts), SKETCH // 64), np.int64)
        for at, text in enumerate(texts):
            hashes = shingle_set(text)
            if not len(hashes):
                keys.append([])
                continue
            bits = wide_bits(hashes, max(blocks * width, SKETCH))
            keys.append(block_keys(bits, blocks, width))
            sketches[at] = np.packbits(bits[:SKETCH], bitorder="little").view("<i8")
        return pd.DataFrame({"keys": pd.Series(keys, dtype=object), "s0": sketches[:, 0], "s1": sketches[:, 1]})

    return signed


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a[:, None, :] ^ b[None, :, :]).sum(axis=2, dtype=np.int16)


def close_groups(sketches: np.ndarray, far: int = FAR) -> np.ndarray:
    """For each sketch the smallest member of its group: members within ``far`` bits, directly or not, share one.

    Beyond ``DIRECT`` members they are first gathered round centres, within ``NEAR`` bits; centres join when members of theirs
    could be within ``far``. That can only make groups larger, and costs members x centres.
    """
    m = len(sketches)
    if m <= DIRECT:
        left, right = np.nonzero(np.triu(_distances(sketches, sketches) <= far, 1))
        return spanning(m, left, right)
    centre = np.full(m, -1)
    centres: list[int] = []
    while len(rest := np.flatnonzero(centre < 0)):
        for low in range(0, len(rest), 1 << 20):
            part = rest[low : low + (1 << 20)]
            centre[part[_distances(sketches[rest[:1]], sketches[part])[0] <= NEAR]] = rest[0]
        centres.append(int(rest[0]))
    spots = np.array(centres)
    left, right = [np.flatnonzero(centre != np.arange(m))], []
    right.append(centre[left[0]])
    for low in range(0, len(spots), 256):
        a, b = np.nonzero(_distances(sketches[spots[low : low + 256]], sketches[spots]) <= far + 2 * NEAR)
        left.append(spots[low + a])
        right.append(spots[b])
    return spanning(m, np.concatenate(left), np.concatenate(right))


def _forest(nodes: np.ndarray, root: np.ndarray) -> pd.DataFrame:
    other = np.flatnonzero(root != np.arange(len(root)))
    ends = np.sort(np.stack([nodes[root[other]], nodes[other]]), axis=0)
    return pd.DataFrame({"a": ends[0], "b": ends[1]})


def _close_pairs(keys: np.ndarray, sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that link the close rows of every bucket; ``keys`` are sorted.

    Buckets of a few rows, nearly all of them, are compared together: every row with the one so many places on.
    """
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(starts, len(keys)))
    small = np.repeat(sizes <= FEW, sizes)
    left, right = [], []
    for step in range(1, min(FEW, int(sizes[sizes <= FEW].max(initial=1)))):
        a = np.flatnonzero(small[:-step] & (keys[:-step] == keys[step:]))
        a = a[np.bitwise_count(sketches[a] ^ sketches[a + step]).sum(axis=1, dtype=np.int16) <= FAR]
        left.append(a)
        right.append(a + step)
    for start, size in zip(starts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist()):
        root = close_groups(sketches[start : start + size])
        other = np.flatnonzero(root != np.arange(size))
        left.append(start + root[other])
        right.append(start + other)
    return np.concatenate([*left, np.empty(0, np.int64)]), np.concatenate([*right, np.empty(0, np.int64)])


def _bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forest of the candidate links of all buckets that a batch completes."""
    held: list[list[np.ndarray]] = []

    def linked() -> Iterator[pa.RecordBatch]:
        if held:
            key, node, s0, s1 = (np.concatenate(column) for column in zip(*held))
            held.clear()
            a, b = _close_pairs(key, np.stack([s0, s1], axis=1).view(np.uint64))
            if len(a):
                places, index = np.unique(np.concatenate([node[a], node[b]]), return_inverse=True)
                found = _forest(places, spanning(len(places), index[: len(a)], index[len(a) :]))
                yield pa.RecordBatch.from_pandas(found, preserve_index=False)

    for batch in batches:
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
        if not len(batch):
            continue
        # rows of the batch's last key wait for the next batch
        last = int(np.searchsorted(columns[0], columns[0][-1]))
        if last or (held and held[-1][0][-1] != columns[0][0]):
            held.append([c[:last] for c in columns])
            yield from linked()
        held.append([c[last:] for c in columns])
    yield from linked()


def candidate_groups(nodes: DataFrame) -> DataFrame:
    """``node``, ``root``: candidate groups of the ``nodes`` (``node``, ``keys``, ``s0``, ``s1``); nodes without a candidate are left out."""
    keyed = nodes.select(F.explode("keys").alias("key"), "node", "s0", "s1")
    dealt = keyed.repartition("key").sortWithinPartitions("key", "node")
    return smallest_reachable(cut_lineage(dealt.mapInArrow(_bucketed, "a bigint, b bigint").distinct(), "llm-near-blocks"))


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Number of shared hashes of every set of ``left`` with every one of ``right``."""
    if len(left) * len(right) <= 64:
        return np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in right] for a in left])
    sides = [np.concatenate(s) for s in (left, right)]
    shared = np.intersect1d(*map(np.unique, sides), assume_unique=True)
    total = np.zeros((len(left), len(right)), np.float32)
    places = []
    for sets, flat in zip((left, right), sides):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        kept = np.isin(flat, shared)
        places.append((row[kept], np.searchsorted(shared, flat[kept])))
    for low in range(0, len(shared), 4096):  # counts stay far below 2^24, so single precision is exact
        tables = []
        for sets, (row, column) in zip((left, right), places):
            inside = (column >= low) & (column < low + 4096)
            table = np.zeros((len(sets), 4096), np.float32)
            table[row[inside], column[inside] - low] = 1
            tables.append(table)
        total += tables[0] @ tables[1].T
    return total.astype(np.int64)


def similar_pairs(left: list[np.ndarray], right: list[np.ndarray], similar: float) -> tuple[np.ndarray, np.ndarray]:
    both = overlaps(left, right)
    union = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None, :] - both
    return np.nonzero(both >= similar * union - 1e-9)


def compared(similar: float):
    """Compares the two sides of every cell (side 1 missing: the cell with itself) and hands on a forest of its links."""

    def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in groups_of(batches, ["root", "i", "j"]):
            side = frame["side"].to_numpy()
            if side.min() > 0:
                continue
            nodes, sets = frame["node"].to_numpy(), [shingle_set(t) for t in frame["body"]]
            first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1) if side.max() > 0 else np.flatnonzero(side == 0)
            a, b = similar_pairs([sets[k] for k in first], [sets[k] for k in second], similar)
            # a node may stand on both sides: its places are one
            places, index = np.unique(nodes, return_inverse=True)
            yield _forest(places, spanning(len(places), index[first[a]], index[second[b]]))

    return within


def _cells(rows: DataFrame, similar: float) -> DataFrame:
    """Links of all cells (``root``, ``i``, ``j``) of ``rows`` (``side``, ``node``, ``body``)."""
    cut = rows.select("root", "i", "j", "side", "node", "body").repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "side", "node")
    return cut.mapInPandas(compared(similar), "a bigint, b bigint")


def sent(small: DataFrame) -> DataFrame:
    """A written table of few columns, to be sent to all tasks where it is small enough."""
    return F.broadcast(small) if small.count() <= SENT else small


def links(nodes: DataFrame, bodies: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Verified links (``a`` < ``b``) whose transitive closure joins all ``nodes`` of a candidate group that are ``similar``.

    ``bodies`` has ``node``, ``own`` and ``body`` of every row; of a node's rows those with its smallest id give the text.
    """
    groups = cut_lineage(candidate_groups(nodes).join(nodes.select("node", "own"), "node"), "llm-near-groups")
    asked = sent(groups).select("root", F.col("node").alias("_node"), F.col("own").alias("_own"))
    found = bodies.join(asked, (F.col("node") == F.col("_node")) & F.col("own").eqNullSafe(F.col("_own")))
    texts = cut_lineage(found.groupBy("root", "node").agg(F.first("body").alias("body")), "llm-near-texts")
    sizes = texts.groupBy("root").agg(F.count("*").alias("m"), F.sum(F.octet_length("body")).alias("bytes"), F.min("node").alias("centre"))
    chunks = F.greatest(F.ceil(F.col("m") / CHUNK_NODES), F.ceil(F.col("bytes") / CHUNK_BYTES)).cast("long").alias("c")
    large = cut_lineage(sizes.select("root", "centre", chunks).where("c > 1"), "llm-near-large")
    small = texts.join(large.select("root"), "root", "left_anti").select("root", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "node", "body")
    near = _cells(small, similar)
    if large.isEmpty():
        return near
    own = F.pmod(F.xxhash64("node"), F.col("c"))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1))
    many = texts.join(large, "root").withColumn("at", own)
    # one node of a large group meets all others of it, chunk by chunk
    heads = many.where("node = centre").select("root", each.alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "node", "body")
    rest = many.where("node <> centre").select("root", F.col("at").alias("i"), F.lit(0).alias("j"), F.lit(1).alias("side"), "node", "body")
    stars = cut_lineage(_cells(heads.unionByName(rest), similar), "llm-near-stars")
    # nodes without a link so far are in no component with the centre yet
    settled = stars.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    still = many.where("node <> centre").select("root", "node").join(settled, "node", "left_anti")
    still = cut_lineage(still, "llm-near-open")
    wanted = many.join(still.select("root").distinct(), "root", "left_semi")
    asks = wanted.join(still.select("node"), "node", "left_semi").select("root", F.col("at").alias("i"), each.alias("j"), F.lit(0).alias("side"), "node", "body")
    meets = wanted.select("root", each.alias("i"), F.col("at").alias("j"), F.lit(1).alias("side"), "node", "body")
    return near.unionByName(stars).unionByName(_cells(asks.unionByName(meets), similar)).distinct()


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """One row of each group of near-duplicates, that of its smallest id (null ids last); exactly the columns of ``docs``."""
    body = F.col(f"`{text}`").cast("string")
    own = F.col(f"`{doc_id}`").alias("own")
    counted = docs.select(F.approx_count_distinct(node_of(body)).alias("n")).first()["n"]
    signed = docs.select(own, node_of(body).alias("node"), signer(*blocks_for(counted, similar))(body).alias("p"))
    nodes = signed.groupBy("node").agg(F.min("own").alias("own"), F.first("p").alias("p")).select("node", "own", "p.*")
    nodes = cut_lineage(nodes, "llm-near-nodes")
    reach = smallest_reachable(links(nodes, docs.select(node_of(body).alias("node"), own, body.alias("body")), similar))
    named = nodes.select("node", "own").join(reach, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = named.groupBy("root").agg(F.min(F.struct(F.col("own").isNull().alias("none"), F.col("own").alias("own"), F.col("node").alias("node"))).alias("b"))
    chosen = cut_lineage(best.select(F.col("b.node").alias("_node"), F.col("b.own").alias("_own")), "llm-near-chosen")
    rows = packed(docs, own, node_of(body).alias("node"))
    mine = (F.col("node") == F.col("_node")) & F.col("own").eqNullSafe(F.col("_own"))
    kept = rows.join(sent(chosen), mine, "left_semi")
    # only ids that repeat with one text have rows to choose from
    twice = docs.select(own, node_of(body).alias("node")).groupBy("own", "node").agg(F.count("*").alias("n")).where("n > 1")
    twice = cut_lineage(twice.select(F.col("node").alias("_node"), F.col("own").alias("_own")), "llm-near-repeated")
    if twice.isEmpty():
        return unpacked(kept, docs.columns)
    single = kept.join(sent(twice), mine, "left_anti").select("_row")
    several = kept.join(sent(twice), mine, "left_semi").groupBy("own", "node").agg(F.first("_row").alias("_row")).select("_row")
    return unpacked(single.unionByName(several), docs.columns)
