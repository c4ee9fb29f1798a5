"""Row gates: typed rows with issue codes, duplicate grains, refusal of personal data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from searchloom.functions import dates, numbers, privacy


class GateError(ValueError):
    """A strict gate refused the input; the message carries counts, never row values."""


def typed_search_rows(raw: DataFrame) -> DataFrame:
    """Typed columns next to the first issue of each row, in reading order."""
    names = ("clicks", "impressions", "position")
    staged = numbers.with_numbers(raw, {n: F.col(n) for n in names}).withColumn("_d", dates.parse_date(F.col("date")))
    issue = F.coalesce(
        F.when(F.trim("date") == "", F.lit("date_blank")).when(F.col("_d").isNull(), F.lit("date_invalid")),
        F.concat(F.lit("clicks_"), numbers.number_issue("clicks", blank_allowed=False)),
        F.concat(F.lit("impressions_"), numbers.number_issue("impressions", blank_allowed=False)),
        clicks_above_impressions(numbers.non_negative("clicks"), numbers.non_negative("impressions")),
        F.concat(F.lit("position_"), numbers.number_issue("position", blank_allowed=True)),
    )
    return staged.select(
        *[c for c in raw.columns if c not in ("date", *names)],
        F.col("_d").alias("day"),
        *[numbers.non_negative(n).alias(n) for n in names],
        issue.alias("issue"),
    )


def clicks_above_impressions(clicks: Column, impressions: Column) -> Column:
    return F.when(clicks > impressions, F.lit("clicks_above_impressions"))


def duplicate_grain(rows: DataFrame, grain: Sequence[str]) -> DataFrame:
    """Grain values that occur more than once, with their row count (map-side combined)."""
    return rows.groupBy(*grain).agg(F.count("*").alias("rows")).filter("rows > 1")


def require_unique_grain(rows: DataFrame, grain: Sequence[str]) -> None:
    """Strict form: one aggregate decides, and only counts leave the executors."""
    groups, dup_rows = duplicate_grain(rows, grain).agg(F.count("*"), F.sum("rows")).first()
    if groups:
        raise GateError(f"{groups} duplicate grain groups over {dup_rows} rows")


def pii_gate(rows: DataFrame, query: Column | None = None, page: Column | None = None) -> DataFrame:
    """Add ``pii_field`` and ``pii_kind``; NULL on clean rows."""
    query_kind = privacy.query_pii_kind(query) if query is not None else F.lit(None).cast("string")
    page_kind = privacy.page_pii_kind(page) if page is not None else F.lit(None).cast("string")
    return rows.withColumns({"_q": query_kind, "_p": page_kind}).select(
        *rows.columns,
        F.when(F.col("_q").isNotNull(), F.lit("query")).when(F.col("_p").isNotNull(), F.lit("page")).alias("pii_field"),
        F.coalesce("_q", "_p").alias("pii_kind"),
    )


def split_by_gate(gated: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Clean rows, and the refused rows reduced to their key, field and kind."""
    clean = gated.filter("pii_kind IS NULL").drop("pii_field", "pii_kind")
    refused = gated.filter("pii_kind IS NOT NULL").select(*key, "pii_field", "pii_kind")
    return clean, refused


def require_no_pii(gated: DataFrame) -> None:
    refused = gated.filter("pii_kind IS NOT NULL").count()
    if refused:
        raise GateError(f"{refused} rows look like personal data")
