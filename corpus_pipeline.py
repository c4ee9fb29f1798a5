"""From raw documents to token files: quality, near-duplicates, decontamination, mixture, tokens.

Every stage takes the documents that the one before it kept. All but the last return exactly the columns of
``documents``. Null ids, null and empty texts, repeated rows, empty tables and further columns behave as each operator's
module says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from searchloom.llm import decontaminate, mixing, near_copies, quality, token_files
from searchloom.session import cut_lineage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and whose host is not rejected."""
    return quality.keep_good(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group whose five-word shingles are similar by 0.8 or more; candidates share SimHash blocks."""
    return near_copies.keep_one(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, always whole."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix; place, length and checksum of each of its documents."""
    import public_tokenizers

    shards = token_files.write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_tokens(spark, shards).drop("shard")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", good_documents),
    ("simhash_near_dedup", one_of_each),
    ("decontamination", uncontaminated),
    ("mixing", mixture),
    ("token_files", tokens),
]

# tokenizers, xxHash64 and component search are beyond SQL; tests hold each stage and the whole against brute force
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is written before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
