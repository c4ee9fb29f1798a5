"""Mixing sources to target weights by capped water-filling.

Every source asks for a share of the budget by its weight. Sources whose share exceeds ``epochs`` times their own size
are clamped there, the excess is shared by weight among the rest, and so on until no source is above its
cap. A source then takes every document floor(target / size) times, and one more time those that a seeded order of the
source puts before the remaining amount. The plan counts the document on that edge in part, so a source's words meet its target; ``mixed`` takes
it whole or not at all.

Defined results: a null text has size 0 and takes nothing; null is a source of its own and comes last; a source of size 0 has
target 0; repeated rows stand side by side in the seeded order and are taken one by one; an empty table gives an empty
result. Rows without an id are ordered by a hash of their text. Ties of the seeded order exist only between rows with equal id, or with neither
id nor different text.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from searchloom.llm.text import LONG, packed, space_words, unpacked
from searchloom.session import cut_lineage

WEIGHTS = (5, 2, 1)
# documents that one bucket of the seeded order should hold
BUCKET_ROWS = 1_000


@F.pandas_udf(LONG)
def word_count(texts: pd.Series) -> pd.Series:
    return pd.Series([len(space_words(t)) for t in texts], dtype="int64")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, epochs: float = 2.0) -> DataFrame:
    """``sources`` (``source``, ``source_size``) with ``weight``, ``target`` and the fractional rest ``whole``, ``rest``.

    Weights go round the sources in code-point order, null last. The table has a row per source and is written once;
    each round reads back one row of sums. A round clamps at least one source or ends the filling, and clamping all at once
    that are above reaches the end in few rounds.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = (F.row_number().over(order) - 1) % len(weights)
    ranked = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")))
    table = cut_lineage(ranked.withColumn("cap", F.col("source_size") * F.lit(float(epochs))), "llm-sources")
    budget = float(table.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0  # words per unit of weight; sources whose weight x level reaches the cap are clamped
    while True:
        clamped = F.col("weight") * F.lit(level) >= F.col("cap")
        sums = table.agg(
            F.sum(F.when(clamped, F.col("cap")).otherwise(0.0)).alias("full"),
            F.sum(F.when(clamped, 0).otherwise(F.col("weight"))).alias("weight"),
        ).first()
        if not sums["weight"]:
            break
        raised = (budget - sums["full"]) / sums["weight"]
        if raised <= level:
            break
        level = raised
    target = F.least(F.col("cap"), F.col("weight") * F.lit(level))
    out = table.withColumn("target", F.round(target, 6))
    taken = F.round(F.col("target")).cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(taken / F.col("source_size"))).otherwise(0)
    return out.withColumn("whole", whole.cast("long")).withColumn("rest", taken - F.col("whole") * F.col("source_size"))


def seeded_order(doc_id: Column, tie: Column, seed: str) -> Column:
    """Hex digest that orders a source's documents: by id, rows without one by ``tie``."""
    return F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), tie.cast("string"), F.lit(""))))


def taken_words(
    sized: DataFrame, rows: DataFrame, weights: tuple[int, ...], share: float, epochs: float, seed: str, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """``rows`` with ``source_size``, ``target``, ``whole``, ``part`` and ``taken``.

    Both inputs have ``doc_id``, ``source``, ``size`` and ``_tie`` (a hash of the text where the id is null) of the same documents; ``rows`` may carry more, ``sized`` is what the sums
    are read from. A document's place in its source is a running sum over the seeded order. The order is cut by the
    digest's first digits, as many as the rows of the largest source ask for; buckets are summed first and only one row per
    bucket is passed on, so a source with a third of all rows never meets in one task.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sizes = cut_lineage(sizes, "llm-source-sizes")
    largest = sizes.agg(F.max("n")).first()[0] or 0
    digits = 1
    while largest > bucket_rows * 16**digits:
        digits += 1
    targets = source_targets(sizes.drop("n"), weights, share, epochs).select(_key().alias("_key"), "source_size", "target", "whole", "rest")

    def spot(df: DataFrame) -> DataFrame:
        placed = df.withColumn("_key", _key()).withColumn("_order", seeded_order(F.col("doc_id"), F.col("_tie"), seed))
        return placed.withColumn("_bucket", F.substring("_order", 1, digits))

    buckets = spot(sized).groupBy("_key", "_bucket").agg(F.sum("size").alias("_sum"))
    along = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = buckets.withColumn("_before", F.sum("_sum").over(along) - F.col("_sum")).drop("_sum").join(targets, "_key")
    inner = Window.partitionBy("_key", "_bucket").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = spot(rows).withColumn("_at", F.sum("size").over(inner) - F.col("size")).join(before, ["_key", "_bucket"])
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("_before") - F.col("_at")))
    return (
        placed.withColumn("part", part.cast("long"))
        .withColumn("taken", F.col("whole") * F.col("size") + F.col("part"))
        .drop("_key", "_tie", "_order", "_bucket", "_at", "_before", "rest")
    )


def _key() -> Column:
    """The source as a text that is never null: sources with a mark before them, null without."""
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))


def _sized(docs: DataFrame, doc_id: str, text: str, source: str) -> list[Column]:
    return [
        F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"),
        word_count(F.col(f"`{text}`").cast("string")).alias("size"),
        F.when(F.col(f"`{doc_id}`").isNull(), F.xxhash64(F.col(f"`{text}`").cast("string"))).alias("_tie"),
    ]


def mixture(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, epochs: float = 2.0, seed: str = "mix-1",
) -> DataFrame:
    """What the mix takes of every row: ``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``whole``, ``part``, ``taken``."""
    rows = cut_lineage(docs.select(*_sized(docs, doc_id, text, source)), "llm-sizes")
    return taken_words(rows, rows, weights, share, epochs, seed)


def mixed(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, epochs: float = 2.0, seed: str = "mix-1",
) -> DataFrame:
    """The mixed rows themselves, with the columns of ``docs``: every row ``whole`` times, and once more where its part of the mix is a half or more.

    Rows are taken whole: the one row on the edge of a source's target is taken or left, whichever comes closer to the target.
    """
    sized = cut_lineage(docs.select(*_sized(docs, doc_id, text, source)), "llm-sizes")
    planned = taken_words(sized, packed(docs, *_sized(docs, doc_id, text, source)), weights, share, epochs, seed)
    more = ((F.col("part") > 0) & (2 * F.col("part") >= F.col("size"))).cast("int")
    copies = F.col("whole").cast("int") + more
    return unpacked(planned.where(copies > 0).select("_row", F.explode(F.sequence(F.lit(1), copies))), docs.columns)
