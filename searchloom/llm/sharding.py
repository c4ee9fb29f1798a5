"""Shards by a seeded permutation of global row numbers, in DataFrame operations only.

Rows get a global number, their place in the order of id (null last), checksum, size and text hash. A Feistel network permutes
the numbers 0 to n - 1: a number is a pair of digits to the bases ``a`` and ``b`` with a x b just above n, every round
adds a keyed function of one digit to the other, and a number that lands at n or above is sent through again until it is below
n (cycle walking). Place ``p`` of the permutation is slot ``p // shards`` of shard ``p % shards``, so shard sizes differ by one
row at the most, slots have no gaps, and shard and slot follow from the row number alone; ``Shuffle`` states the
same law for single numbers, and its inverse.

Only small rows (id, size, checksum) are ordered: one range exchange whose last key tells equal rows apart, so that no group of
equal rows, however large, meets in one task. The number of a row is its place in its range plus the rows of all ranges before
it; one count per range is all that is gathered.

Defined results: a null text has size 8 and the checksum of no bytes; a null id comes last; repeated rows get numbers of their own, side
by side, and are dealt like any others; rows with equal id, size and text may swap their slots between runs, which no result
shows; an empty table gives an empty result. Long texts are only measured. Further columns, whatever their names, are put
away in one column where whole rows are dealt.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from hashlib import md5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from searchloom.llm.text import packed, unpacked
from searchloom.session import cut_lineage, scratch_path

SHARDS = 24
SEED = "shard-1"
ROUNDS = 6
# passes through the network inside one expression; rows that need more are sent through again
WALKS = 3
# what a row costs besides its text
ROW_BYTES = 8


@dataclass(frozen=True)
class Shuffle:
    """The permutation of 0 to ``n`` - 1 for one seed, for numbers on the driver and for columns."""

    n: int
    seed: str = SEED
    rounds: int = ROUNDS

    @property
    def bases(self) -> tuple[int, int]:
        a = max(1, math.isqrt(max(0, self.n - 1)) + 1)
        return a, max(1, -(-self.n // a))

    def _added(self, turn: int, digit: int) -> int:
        return int(md5(f"{self.seed}:{turn}:{digit}".encode()).hexdigest()[:12], 16)

    def _once(self, number: int) -> int:
        a, b = self.bases
        left, right = divmod(number, b)
        for turn in range(self.rounds):
            if turn % 2:
                right = (right + self._added(turn, left)) % b
            else:
                left = (left + self._added(turn, right)) % a
        return left * b + right

    def _back(self, place: int) -> int:
        a, b = self.bases
        left, right = divmod(place, b)
        for turn in reversed(range(self.rounds)):
            if turn % 2:
                right = (right - self._added(turn, left)) % b
            else:
                left = (left - self._added(turn, right)) % a
        return left * b + right

    def place(self, number: int) -> int:
        """Place of a row number in the shuffled order."""
        if not 0 <= number < self.n:
            raise ValueError(f"{number} is not a row number below {self.n}")
        while (number := self._once(number)) >= self.n:
            pass
        return number

    def number(self, place: int) -> int:
        """Row number that stands at ``place``: the inverse of ``place``."""
        if not 0 <= place < self.n:
            raise ValueError(f"{place} is not a place below {self.n}")
        while (place := self._back(place)) >= self.n:
            pass
        return place

    def _once_column(self, number: Column) -> Column:
        a, b = self.bases
        # a struct per round, handed on by a function of one element, so that no digit's expression is copied into the next
        right = F.pmod(number, F.lit(b).cast("long"))
        state = F.struct(_div(number, b).alias("l"), right.alias("r"))

        def turned(turn: int):
            def step(s: Column) -> Column:
                one, other, base = ("r", "l", b) if turn % 2 else ("l", "r", a)
                digest = F.md5(F.concat(F.lit(f"{self.seed}:{turn}:"), s[other].cast("string")))
                added = F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")
                moved = F.pmod(s[one] + added, F.lit(base).cast("long"))
                return F.struct(*[(moved if name == one else s[name]).alias(name) for name in ("l", "r")])

            return step

        for turn in range(self.rounds):
            state = _let(state, turned(turn))
        return _let(state, lambda s: s["l"] * F.lit(b).cast("long") + s["r"])

    def walked(self, number: Column, walks: int = WALKS) -> Column:
        """``number`` after one pass and, while it is ``n`` or more, up to ``walks`` - 1 further ones."""
        n = F.lit(self.n).cast("long")
        out = self._once_column(number)
        for _ in range(walks - 1):
            out = _let(out, lambda p: F.when(p < n, p).otherwise(self._once_column(p)))
        return out

    def placed(self, numbered: DataFrame, number: str = "number", place: str = "place") -> DataFrame:
        """``numbered`` with the place of each row; stragglers of the walk, a few in a billion, go round in a loop of their own."""
        n = F.lit(self.n).cast("long")
        out = cut_lineage(numbered.withColumn(place, self.walked(F.col(f"`{number}`"))), "llm-places")
        while not (late := out.where(F.col(place) >= n)).isEmpty():
            again = late.withColumn(place, self.walked(F.col(place)))
            out = cut_lineage(out.where(F.col(place) < n).unionByName(again), "llm-places")
        return out


def _div(number: Column, by: int) -> Column:
    """Integer quotient; a division of doubles would be exact only below 2^53."""
    return F.call_function("div", number, F.lit(by).cast("long"))


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """``doc_id``, ``size``, ``text_crc32`` and the text's 64-bit hash."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return [
        F.col(f"`{doc_id}`").alias("doc_id"), (F.octet_length(body) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(body).alias("_hash"),
    ]


ORDER = ("_none", "doc_id", "text_crc32", "size", "_hash", "_row_id")


def numbered(rows: DataFrame, order: tuple[str, ...] = ORDER, number: str = "number") -> tuple[DataFrame, int]:
    """``rows`` with their global place from 0 in ``order``, and how many there are.

    ``rows`` must come from a written table, so that a task that runs again sees the same rows. The last column of ``order`` should tell
    all rows apart. Ranges are sorted where they arrive; a row's place in its range is the low part of Spark's own row id.
    """
    low = (1 << 33) - 1
    ranged = rows.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    ranged = ranged.withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit(low)))
    ranged = cut_lineage(ranged.withColumn("_range", F.spark_partition_id()), "llm-ranges")
    # one row per range, no more than the session has shuffle partitions
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n")).orderBy("_range").collect()
    starts, total = [], 0
    for r in counts:
        starts.append((r["_range"], total))
        total += r["_n"]
    before = rows.sparkSession.createDataFrame(starts, "_range int, _before bigint")
    out = ranged.join(F.broadcast(before), "_range").withColumn(number, F.col("_before") + F.col("_at"))
    return out.drop("_range", "_before", "_at"), total


def _numbered(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, int]:
    small = docs.select(*measured(docs, doc_id, text)).withColumn("_none", F.col("doc_id").isNull())
    small = cut_lineage(small.withColumn("_row_id", F.monotonically_increasing_id()), "llm-measured")
    return numbered(small)


def shard_and_slot(place: Column, shards: int) -> list[Column]:
    count = F.lit(shards).cast("long")
    return [F.pmod(place, count).cast("int").alias("shard"), _div(place, shards).alias("slot")]


def sharded(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``number``, ``place``, ``shard`` and ``slot`` of every row."""
    rows, n = _numbered(docs, doc_id, text)
    placed = Shuffle(n, seed).placed(rows.select("doc_id", "size", "text_crc32", "number"))
    return placed.select("*", *shard_and_slot(F.col("place"), shards))


def write_shards(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, seed: str = SEED) -> str:
    """Whole rows written as Parquet below ``path``, a folder per shard, files in the order of slots; returns the path.

    Rows keep their columns in ``row`` beside ``slot`` and ``shard``. Whole rows travel twice here: to get their number, and to their
    shard, where a range of slots is one task, so a shard of any size is written by many.
    """
    small = packed(docs, *measured(docs, doc_id, text)).withColumn("_none", F.col("doc_id").isNull())
    small = cut_lineage(small.withColumn("_row_id", F.monotonically_increasing_id()), "llm-measured")
    rows, n = numbered(small)
    placed = Shuffle(n, seed).placed(rows.select("_row", "number"))
    dealt = placed.select(F.col("_row").alias("row"), *shard_and_slot(F.col("place"), shards))
    target = path or scratch_path(docs.sparkSession, "llm-shards")
    dealt.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(target)
    return target


def read_shard(docs: DataFrame, path: str, shard: int) -> DataFrame:
    """Rows of one shard in the order of their slots, with the columns of ``docs``."""
    rows = docs.sparkSession.read.parquet(path).where(F.col("shard") == shard).orderBy("slot")
    return unpacked(rows.select(F.col("row").alias("_row")), docs.columns)
