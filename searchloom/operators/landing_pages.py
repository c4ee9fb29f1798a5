"""Landing pages of all sources in one spelling, with an explicit URL map."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from searchloom.functions import urls
from searchloom.operators.gates import GateError


@dataclass(frozen=True)
class UrlRules:
    """How landing pages are brought to one spelling; the host is always lowered."""

    base_url: str
    force_https: bool = True
    trailing_slash: str = "remove"
    strip_query: bool = True
    strip_fragment: bool = True

    def spelled(self, raw: Column) -> Column:
        return urls.landing_page(
            raw, F.lit(self.base_url), force_https=self.force_https, trailing_slash=self.trailing_slash,
            strip_query=self.strip_query, strip_fragment=self.strip_fragment,
        )


def url_map(pairs: DataFrame, rules: UrlRules) -> DataFrame:
    """``source``, ``target`` in the rules' spelling, one row a source; invalid URLs and sources with two targets raise with counts."""
    spelled = pairs.select(rules.spelled(F.col("source")).alias("source"), rules.spelled(F.col("target")).alias("target"))
    grouped = spelled.groupBy("source").agg(F.min("target").alias("target"), F.max("target").alias("_other"), F.count_if(F.col("target").isNull()).alias("_bad"))
    invalid, several = grouped.agg(F.sum("_bad") + F.count_if(F.col("source").isNull()), F.count_if(F.col("target") != F.col("_other"))).first()
    if invalid or several:
        raise GateError(f"URL map: {invalid} entries with an invalid URL, {several} sources with several targets")
    return grouped.select("source", "target")


def with_landing_pages(rows: DataFrame, text: str, rules: UrlRules, pairs: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``landing_page``, ``url_reason`` and ``explicitly_mapped`` for the URL text in column ``text``.

    A blank text gives ``blank_landing_page`` and one that is no http(s) URL ``invalid_landing_page``. The map is met by a left join on
    the spelled URL; without a map nothing is joined.
    """
    raw = F.col(text)
    spelled = rows.withColumn("_spelled", rules.spelled(raw))
    blank = F.coalesce(F.trim(raw), F.lit("")) == ""
    reason = F.when(blank, F.lit("blank_landing_page")).when(F.col("_spelled").isNull(), F.lit("invalid_landing_page"))
    if pairs is None:
        target = F.lit(None).cast("string")
    else:
        spelled = spelled.join(url_map(pairs, rules).select(F.col("source").alias("_spelled"), F.col("target").alias("_target")), "_spelled", "left")
        target = F.col("_target")
    return spelled.select(
        *[F.col(f"`{c}`") for c in rows.columns],
        F.coalesce(target, F.col("_spelled")).alias("landing_page"),
        reason.alias("url_reason"),
        target.isNotNull().alias("explicitly_mapped"),
    )
