"""Review exports with configured columns: header mapping per file, typed rows with issues, one table for all sources."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from searchloom.functions import dates, numbers
from searchloom.operators.compare import issue_list
from searchloom.operators.gates import GateError
from searchloom.operators.landing_pages import UrlRules, with_landing_pages
from searchloom.operators.review import KINDS, METRICS
from searchloom.sources import exports


@dataclass(frozen=True)
class ReviewColumns:
    """Columns of one source's files: canonical dimension or metric -> header, and value maps by dimension (lower-case keys)."""

    kind: str
    dimensions: Mapping[str, str]
    metrics: Mapping[str, str]
    source_timezone: str | None = None
    values: Mapping[str, Mapping[str, str]] = field(default_factory=dict)

    def resolve(self, headers: list[str]) -> dict[str, str]:
        found = exports.review_headers(self.kind, headers, self.dimensions, self.metrics)
        return {header: f"c_{name}" for name, header in found.items()}


def _dimension(columns: ReviewColumns, name: str) -> Column:
    """Trimmed, lowered, then mapped; NULL for a blank one."""
    key = F.lower(F.trim(f"c_{name}"))
    known = columns.values.get(name)
    if known:
        table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
        key = F.coalesce(F.try_element_at(table, key), key)
    return F.when(key != "", key)


def read_review_csv(
    spark: SparkSession, path: str, columns: ReviewColumns, rules: UrlRules, timezone: str, url_map: DataFrame | None = None
) -> DataFrame:
    """Rows of one source in the review's shared shape, with ``url_reason``, ``issues``, ``file`` and ``at``.

    A header that lacks a configured column, repeats one, carries an undeclared, personal or query column raises before any row is read. What is
    wrong with a row stands in its ``issues``; blank metrics are NULL and no issue.
    """
    if columns.kind not in KINDS:
        raise ValueError(f"unknown source kind {columns.kind!r}")
    raw = exports.read_mapped_csv(spark, path, columns.resolve)
    raw = numbers.with_numbers(raw, {m: F.col(f"c_{m}") for m in columns.metrics})
    raw = with_landing_pages(raw, "c_landing_page", rules, url_map)
    zone = F.lit(columns.source_timezone or timezone)
    day = dates.parse_day(F.col("c_date"), zone, F.lit(timezone))
    raw = raw.withColumns({"day": day, "temporal_grain": dates.temporal_grain(F.col("c_date"))})
    invalid_day = (F.col("temporal_grain") == "invalid") | (F.col("day").isNull() & (F.col("temporal_grain") != "unknown"))
    metrics = dict.fromkeys(m for kind in KINDS for m in METRICS[kind]) | dict.fromkeys(columns.metrics)
    return raw.select(
        F.lit(columns.kind).alias("kind"), "day", "landing_page", _dimension(columns, "country").alias("country"),
        (_dimension(columns, "device") if "device" in columns.dimensions else F.lit(None).cast("string")).alias("device"),
        "explicitly_mapped", "temporal_grain",
        *[(numbers.non_negative(m) if m in columns.metrics else F.lit(None).cast("double")).alias(m) for m in metrics],
        "url_reason",
        issue_list(
            F.col("row_issue"), F.when(invalid_day, F.lit("date_invalid")),
            *[F.concat(F.lit(f"{m}_"), numbers.number_issue(m, blank_allowed=True)) for m in columns.metrics],
        ).alias("issues"),
        "file", "at",
    )


def require_clean(rows: DataFrame) -> DataFrame:
    """Strict form: raises when a row has an issue; only counts by issue leave the executors."""
    found = rows.select(F.explode("issues").alias("issue")).groupBy("issue").count().orderBy("issue").collect()
    if found:
        raise GateError("review rows refused: " + ", ".join(f"{r['issue']} x {r['count']}" for r in found))
    return rows
