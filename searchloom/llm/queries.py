"""Registered queries of the subpackage, each with its SQL check where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchloom.llm import (
    decontaminate, extraction, hard_negatives, licenses, mixing, oracles, quality, sharding, simhash, suffix_dedup, token_files, toxicity, url_filter, whitening,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_quality_rules", oracles.OP1)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures, base verdict and host verdict of every document."""
    judged = quality.measures_by_id(_table(spark, sf_dir, "documents"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *[F.col(f"m.{n}").alias(n) for n in names], "base_failed", "kept", "host_rejected")


@query("op2_token_files")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum, read back from the written token files."""
    import public_tokenizers

    shards = token_files.write_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_tokens(spark, shards).drop("shard")


@query("op6_mixing", oracles.OP6)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of every document."""
    return mixing.mixture(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op7_simhash")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op10_decontamination", oracles.OP10)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "s.n_words", "s.n_hit", "s.n_items", "s.items_sha256", (F.col("s.n_hit") > 0).alias("contaminated"))


@query("op4_suffix_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to byte strings that stand elsewhere too."""
    found = suffix_dedup.repeated_bytes(_table(spark, sf_dir, "documents"))
    total = lambda at: F.aggregate(F.expr(f"filter(removed, (x, i) -> i % 2 = {at})"), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        "doc_id", "n_bytes", (total(1) - total(0)).alias("n_removed"), (F.size("removed") / 2).cast("long").alias("n_spans"), "kept_sha256"
    )


@query("op5_extraction")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extraction.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "main.text", "main.n_chars")


@query("op8_url_filter", oracles.OP8)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's URL; without a rule, mirror hosts are blocked."""
    pages = _table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.mirror_hosts(pages)).select("page_id", "judged.*")


@query("op9_license_scan", oracles.OP9)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in every document."""
    found = licenses.scan(_table(spark, sf_dir, "documents"))
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    return found.select("doc_id", *[f"found.{n}" for n in names])


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = _table(spark, sf_dir, "documents")
    found = toxicity.scores(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op11_sharding", oracles.OP11)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document by a seeded permutation of row numbers; counts at most one apart."""
    dealt = sharding.sharded(_table(spark, sf_dir, "documents"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op12_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every vector."""
    found = whitening.whitened(_table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


@query("op13_hard_negatives", oracles.OP13)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor and positive; ids divisible by 7 carry a wrong label, ids divisible by 50 are anchors."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=moved)
