"""Ordered operations over groups of any size.

A plain window sorts a whole group in one task. These forms first cut each group into ordered buckets,
work inside the buckets in parallel, and pass only one small row per bucket between them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucketed_rank(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, rank: str = "rank", total: str = "n"
) -> DataFrame:
    """1-based rank within ``keys`` and the group size. ``bucket`` must not decrease along ``order``."""
    tagged = df.withColumn("_b", bucket)
    counts = tagged.groupBy(*keys, "_b").agg(F.count("*").alias("_c"))
    along = Window.partitionBy(*keys).orderBy("_b")
    offsets = counts.select(
        *keys,
        "_b",
        (F.sum("_c").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")).alias("_before"),
        F.sum("_c").over(Window.partitionBy(*keys)).alias(total),
    )
    inner = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order))
    return (
        tagged.withColumn("_r", inner)
        .join(offsets, [*keys, "_b"])
        .withColumn(rank, F.col("_r") + F.col("_before"))
        .drop("_b", "_r", "_before")
    )


def bucketed_lag(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, value: str, name: str
) -> DataFrame:
    """Previous row's ``value`` within ``keys``; NULL on the first row."""
    tagged = df.withColumn("_b", bucket)
    last = tagged.groupBy(*keys, "_b").agg(F.max_by(F.struct(value), F.struct(*order)).alias("_last"))
    carried = last.select(*keys, "_b", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_b")).alias("_carry"))
    inside = Window.partitionBy(*keys, "_b").orderBy(*order)
    return (
        tagged.withColumns({"_p": F.lag(value).over(inside), "_i": F.row_number().over(inside)})
        .join(carried, [*keys, "_b"])
        .withColumn(name, F.when(F.col("_i") == 1, F.col(f"_carry.{value}")).otherwise(F.col("_p")))
        .drop("_b", "_p", "_i", "_carry")
    )


def tree_digest(rows: DataFrame, keys: Sequence[str], order: str, digest: str, name: str) -> DataFrame:
    """Order-fixed digest of a group: row digests -> bucket digests -> one digest per key.

    Buckets come from the digest of the ordering value, so no task sees more than a slice of a group.
    """
    tagged = rows.withColumn("_b", F.substring(F.sha2(F.col(order).cast("string"), 256), 1, 3))
    joined = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(digest).alias("d")))), lambda s: s["d"]), ""
    )
    buckets = tagged.groupBy(*keys, "_b").agg(F.sha2(joined, 256).alias("_d"))
    upper = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("_b", "_d"))), lambda s: s["_d"]), ""
    )
    return buckets.groupBy(*keys).agg(F.sha2(upper, 256).alias(name))
