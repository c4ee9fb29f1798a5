"""Connected components over links by alternating joins; links and components stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchloom.session import cut_lineage


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """``node``, ``root``: the smallest node reachable from every node of ``edges`` (``a``, ``b``).

    Large-star and small-star rounds: every node hands its larger neighbours, then its smaller ones, to the smallest
    neighbour. Rounds are logarithmic in the longest path, each one is written to the shared folder, and all
    aggregations combine before their shuffle. A node with very many neighbours meets them by a join on the node, never in
    one list. Runs until nothing changes; there is no bound on rounds.
    """
    links = _written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    before = None
    while before != (before := _signature(links)):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = _written(both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        joined = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        links = _written(joined.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")))
    tops = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(tops)


def _written(links: DataFrame) -> DataFrame:
    return cut_lineage(links.where("u <> v").distinct(), "components")


def _signature(links: DataFrame) -> tuple:
    """One row that tells two link sets apart."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
