"""Quality rules whose failures are judged per document and per host.

Every document is measured once. A document fails for itself by the base rule. The failures of every rule are
also counted per host, the host's rate is shrunk towards the corpus by an empirical beta prior, and a host whose
shrunk rate of any rule is above ``limit`` is rejected with all its documents.

Defined results: a null text counts as an empty one (0 words, fails the base rule); a null host is a host of its own;
repeated rows are measured and counted one by one; very long texts are measured whole, one at a time; an empty table gives an empty result. Other columns are
never read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from searchloom.llm.text import LONG, packed, record, space_words, unpacked
from searchloom.session import cut_lineage

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
SCHEMA = record(**dict.fromkeys(MEASURES, LONG))


@dataclass(frozen=True)
class HostPolicy:
    """``limit``: highest shrunk failure rate of a kept host. ``strength``: bounds of the prior's weight in documents."""

    limit: float = 0.8
    strength: tuple[float, float] = (2.0, 1000.0)


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words inside windows of ``width`` words that occur at least twice, the first occurrence included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    codes: dict[bytes, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))
    window, bound = ids[:n], len(codes)
    for k in range(1, width):
        if bound * len(codes) >= 2**62:
            window = np.unique(window, return_inverse=True)[1]
            bound = n
        window = window * len(codes) + ids[k : k + n]
        bound *= len(codes)
    order = np.argsort(window, kind="stable")
    equal = np.diff(window[order]) == 0
    if not equal.any():
        return 0
    repeated = np.zeros(n, bool)
    repeated[order[1:][equal]] = True
    repeated[order[:-1][equal]] = True
    covered = np.zeros(len(words), bool)
    for k in range(width):
        covered[k : k + n] |= repeated
    return int(covered.sum())


def measure_text(text: str | None) -> tuple[int, ...]:
    """The values of ``MEASURES`` for one text."""
    if not text:
        return (0,) * len(MEASURES)
    words = space_words(text)
    lines = [line for line in text.split("\n") if line.strip(" \t\x0b\x0c\r")]
    return (
        len(words),
        len(text) - sum(map(text.count, " \t\n\x0b\x0c\r")),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
    )


@F.pandas_udf(SCHEMA)
def measured(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure_text(t) for t in texts], columns=list(MEASURES), dtype="int64")


def rules(m: Column) -> dict[str, Column]:
    """Named rule failures over a struct of ``MEASURES``; ``base`` alone rejects the document itself."""
    words, lines = m["n_words"], m["n_lines"]
    return {
        "base": (words < 50) | (100 * m["n_repeat_words"] > 50 * words),
        "symbols": 10 * m["n_symbols"] > m["word_chars"],
        "dup_lines": 10 * m["n_dup_lines"] > 3 * lines,
    }


RULES = ("base", "symbols", "dup_lines")


def host_rates(failures: DataFrame, policy: HostPolicy) -> DataFrame:
    """One row per host: documents, failures and shrunk rate of each rule, and ``rejected``.

    ``failures`` has ``host`` and a boolean per rule. Counts are combined before the shuffle, so a host with a third
    of all documents costs one row per task. The prior comes from one row of sums over the hosts.
    """
    counts = failures.groupBy("host").agg(
        F.count("*").alias("n"), *[F.sum(F.col(r).cast("long")).alias(f"k_{r}") for r in RULES]
    )
    counts = cut_lineage(counts, "llm-hosts")
    sums = counts.agg(
        F.sum("n").alias("n"),
        *[F.sum(f"k_{r}").alias(f"k_{r}") for r in RULES],
        *[F.sum(F.col(f"k_{r}") * F.col(f"k_{r}") / F.col("n")).alias(f"s_{r}") for r in RULES],
    ).first()
    rated, worst = counts, F.lit(False)
    for r in RULES:
        mean, weight = beta_prior(sums["n"] or 0, sums[f"k_{r}"] or 0, sums[f"s_{r}"] or 0.0, policy.strength)
        rate = (F.col(f"k_{r}") + F.lit(mean * weight)) / (F.col("n") + F.lit(weight))
        rated = rated.withColumn(f"rate_{r}", rate)
        worst = worst | (F.col(f"rate_{r}") > policy.limit)
    return rated.withColumn("rejected", worst)


def beta_prior(n: float, k: float, squares: float, bounds: tuple[float, float]) -> tuple[float, float]:
    """Mean and weight (a + b) of a beta prior by moments.

    ``squares`` is the sum of k_h * k_h / n_h over the hosts, so squares / n - mean**2 is the variance of the host
    rates weighted by documents. No variance, or none to spare, gives the heaviest weight.
    """
    mean = k / n if n else 0.0
    variance = squares / n - mean * mean if n else 0.0
    spread = mean * (1.0 - mean)
    weight = spread / variance - 1.0 if variance > 1e-12 else bounds[1]
    return mean, min(max(weight, bounds[0]), bounds[1])


def judge(docs: DataFrame, text: str = "text", host: str = "source", policy: HostPolicy = HostPolicy()) -> DataFrame:
    """``_row`` (the whole document), ``m`` (measures), ``base_failed``, ``host_rejected`` and ``kept`` of every document.

    Texts are measured twice, once for the host counts and once beside the rows, so no text is shuffled.
    """
    rows = packed(docs, F.col(f"`{host}`").cast("string").alias("host"), measured(F.col(f"`{text}`").cast("string")).alias("m"))
    return _join_hosts(rows, host_rates(rows.select("host", *_flags()), policy))


def measures_by_id(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", policy: HostPolicy = HostPolicy()) -> DataFrame:
    """As ``judge``, with ``doc_id`` instead of the row: measures are written once and read for both uses."""
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.col(f"`{host}`").cast("string").alias("host"),
        measured(F.col(f"`{text}`").cast("string")).alias("m"),
    )
    rows = cut_lineage(rows, "llm-measures")
    return _join_hosts(rows, host_rates(rows.select("host", *_flags()), policy))


def _flags() -> list[Column]:
    return [failed.alias(name) for name, failed in rules(F.col("m")).items()]


def _join_hosts(rows: DataFrame, hosts: DataFrame) -> DataFrame:
    known = hosts.select(F.col("host").alias("_host"), F.col("rejected").alias("host_rejected"))
    return (
        rows.join(known, F.col("host").eqNullSafe(F.col("_host")), "left")
        .withColumn("base_failed", rules(F.col("m"))["base"])
        .withColumn("kept", ~F.col("base_failed") & ~F.coalesce("host_rejected", F.lit(False)))
        .drop("_host")
    )


def keep_good(docs: DataFrame, text: str = "text", host: str = "source", policy: HostPolicy = HostPolicy()) -> DataFrame:
    """The rows of ``docs`` that pass, with exactly the columns of ``docs``."""
    return unpacked(judge(docs, text, host, policy).where("kept"), docs.columns)
