"""Replay of whole results: every leaf of what was stored against every leaf of a recomputation.

A leaf is one value with its path, ``balance.clicks.treatment_mean``; results that are tables give their leaves row by row, documents are taken
apart level by level. Both sides meet by a join on (experiment, path), so a result of any size is compared without being one cell, and a changed leaf
is named by its path.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAF = ("experiment_id", "path", "text", "number")
# relative and absolute tolerance of numbers
TOLERANCE = 1e-12


def table_leaves(rows: DataFrame, part: str, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """``experiment_id, path, text, number`` of the ``fields`` of a result table; ``keys`` name a row inside its experiment."""
    numeric = {f.name for f in rows.schema.fields if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "decimal")}
    number = lambda f: F.col(f).cast("double") if f in numeric else F.lit(None).cast("double")
    entries = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("string").alias("text"), number(f).alias("number")) for f in fields])
    flat = rows.select("experiment_id", *keys, F.inline(entries))
    return flat.select("experiment_id", F.concat_ws(".", F.lit(part), *keys, "f").alias("path"), "text", "number")


def document_leaves(documents: DataFrame, column: str) -> DataFrame:
    """The same for a VARIANT document per ``experiment_id``: object keys and array places make up the paths.

    One round a level of nesting, for all documents together; an empty object or array is a leaf.
    """
    spark = documents.sparkSession
    level = documents.select("experiment_id", F.lit("").alias("path"), F.col(column).alias("v")).where("v IS NOT NULL")
    found = []
    while True:
        nested = F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)<.") & ~F.col("v").cast("string").isin("{}", "[]")
        leaf = level.where(~nested)
        found.append(leaf.select("experiment_id", "path", F.col("v").cast("string").alias("text"), F.try_variant_get("v", "$", "double").alias("number")))
        open_rows = level.where(nested)
        if open_rows.isEmpty():
            break
        inner = open_rows.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        name = F.coalesce("key", F.col("pos").cast("string"))
        level = inner.select("experiment_id", F.when(F.col("path") == "", name).otherwise(F.concat_ws(".", "path", name)).alias("path"), F.col("value").alias("v"))
    return reduce(DataFrame.unionByName, found)


def leaf_differences(stored: DataFrame, recomputed: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """``experiment_id, path, issue, stored, recomputed`` of the leaves that differ.

    ``not_stored`` and ``not_recomputed`` are paths of one side only; numbers differ beyond the larger of the relative and the absolute tolerance, other
    values by their text. A NULL equals a NULL and a path the other side lacks, since documents leave NULLs out.
    """
    sides = [
        df.where("text IS NOT NULL").select("experiment_id", "path", F.col("text").alias(f"{s}_text"), F.col("number").alias(f"{s}_number")) for s, df in (("s", stored), ("r", recomputed))
    ]
    both = sides[0].join(sides[1], ["experiment_id", "path"], "full")
    s, r = F.col("s_number"), F.col("r_number")
    near: Column = F.abs(s - r) <= F.greatest(tolerance * F.greatest(F.abs(s), F.abs(r)), F.lit(tolerance))
    same = F.coalesce(near, F.col("s_text") == F.col("r_text"))
    issue = F.when(F.col("s_text").isNull(), F.lit("not_stored")).when(F.col("r_text").isNull(), F.lit("not_recomputed")).when(~same, F.lit("changed"))
    return both.select("experiment_id", "path", issue.alias("issue"), F.col("s_text").alias("stored"), F.col("r_text").alias("recomputed")).where("issue IS NOT NULL")
