"""Two-window comparisons: search performance and AI-surface impressions.

Rows carry a ``property_id``, so one job compares all properties. Every total comes from one pass of
conditional sums that combine map-side; a property holding a third of the rows costs no more shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from searchloom.functions.dates import as_of_day
from searchloom.functions.numbers import clean, ratio, sum_if
from searchloom.operators.skew import bucketed_rank
from searchloom.session import cut_lineage

# Day boundary of search exports, export row limit of the AI surface.
SEARCH_TIMEZONE = "America/Los_Angeles"
AI_ROW_LIMIT = 1000
DIMENSIONS = ("page", "query", "country", "device")
AI_DIMENSIONS = ("page", "country", "device")
WINDOWS = ("baseline", "current")


@dataclass(frozen=True)
class DateWindow:
    """Inclusive day range."""

    start: str
    end: str

    def contains(self, day: Column) -> Column:
        return day.between(F.lit(self.start).cast("date"), F.lit(self.end).cast("date"))


def check_windows(baseline: DateWindow, current: DateWindow) -> None:
    if baseline.start > baseline.end or current.start > current.end:
        raise ValueError("a window starts after it ends")
    if baseline.end >= current.start:
        raise ValueError("the baseline window must end before the current window starts")


def label_windows(rows: DataFrame, baseline: DateWindow, current: DateWindow) -> DataFrame:
    """Keep rows of either window; the day filter reaches the scan."""
    check_windows(baseline, current)
    day = F.col("day")
    return rows.filter(baseline.contains(day) | current.contains(day)).withColumn(
        "period", F.when(baseline.contains(day), F.lit("baseline")).otherwise(F.lit("current"))
    )


def window_selection(rows: DataFrame, baseline: DateWindow, current: DateWindow) -> DataFrame:
    """Per property and window: row count, day range, and whether the window is empty."""
    check_windows(baseline, current)
    aggs = []
    for name, w in zip(WINDOWS, (baseline, current)):
        inside = w.contains(F.col("day"))
        aggs.append(
            F.struct(
                F.lit(name).alias("period"),
                F.count_if(inside).alias("rows"),
                F.min(F.when(inside, F.col("day"))).alias("first_day"),
                F.max(F.when(inside, F.col("day"))).alias("last_day"),
            ).alias(name)
        )
    wide = rows.groupBy("property_id").agg(*aggs)
    return wide.select("property_id", F.inline(F.array(*WINDOWS))).withColumn(
        "status", F.when(F.col("rows") == 0, F.lit("window_empty")).otherwise(F.lit("ok"))
    )


def window_bounds(exports: DataFrame, declared: DataFrame) -> DataFrame:
    """Bounds per property: declared both-or-neither, else observed; issues for everything refused.

    ``exports`` has ``property_id, window, day``; ``declared`` has ``property_id, window, start, end``.
    """
    observed = exports.groupBy("property_id", "period").agg(
        F.min("day").alias("first_day"), F.max("day").alias("last_day")
    )
    bounded = exports.join(declared, ["property_id", "period"], "left")
    outside = bounded.groupBy("property_id", "period").agg(
        F.count_if(~F.col("day").between(F.col("start"), F.col("end"))).alias("rows_outside")
    )
    joined = observed.join(declared, ["property_id", "period"], "left").join(outside, ["property_id", "period"])
    half = F.col("start").isNull() != F.col("end").isNull()
    shaped = joined.select(
        "property_id",
        "period",
        F.coalesce("start", "first_day").alias("eff_start"),
        F.coalesce("end", "last_day").alias("eff_end"),
        F.when(F.col("start").isNotNull(), F.lit("declared")).otherwise(F.lit("observed")).alias("boundary_source"),
        "rows_outside",
        F.when(half, F.lit("half_declared"))
        .when(F.col("start") > F.col("end"), F.lit("start_after_end"))
        .when(F.col("rows_outside") > 0, F.lit("rows_outside_declared"))
        .alias("issue"),
    )
    per = [
        F.max(F.when(F.col("period") == w, F.col(c))).alias(f"{w}_{c}")
        for w in WINDOWS
        for c in ("eff_start", "eff_end", "boundary_source", "rows_outside", "issue")
    ]
    return (
        shaped.groupBy("property_id")
        .agg(*per)
        .withColumn(
            "order_issue",
            F.when(F.col("baseline_eff_end") >= F.col("current_eff_start"), F.lit("windows_not_disjoint")),
        )
    )


def _metric_sums(window: str) -> list[Column]:
    """Sums of one window; position counts only rows with a position and impressions."""
    inside = F.col("period") == window
    ranked = inside & F.col("position").isNotNull() & (F.col("impressions") > 0)
    return [
        sum_if(inside, F.col("clicks")).alias(f"{window}_clicks"),
        sum_if(inside, F.col("impressions")).alias(f"{window}_impressions"),
        sum_if(ranked, F.col("position") * F.col("impressions")).alias(f"{window}_position_sum"),
        sum_if(ranked, F.col("impressions")).alias(f"{window}_position_impressions"),
        F.count_if(inside).alias(f"{window}_rows"),
        F.count_if(ranked).alias(f"{window}_position_rows"),
    ]


def _finish_metrics(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    cols: list[Column] = []
    for w in WINDOWS:
        clicks, imps = F.col(f"{w}_clicks"), F.col(f"{w}_impressions")
        cols += [
            clean(clicks).alias(f"{w}_clicks"),
            clean(imps).alias(f"{w}_impressions"),
            clean(ratio(clicks, imps)).alias(f"{w}_ctr"),
            clean(ratio(F.col(f"{w}_position_sum"), F.col(f"{w}_position_impressions"))).alias(f"{w}_position"),
            F.col(f"{w}_rows"),
            F.col(f"{w}_position_rows"),
            clean(F.col(f"{w}_position_impressions")).alias(f"{w}_position_impressions"),
        ]
    return sums.select(*keys, *cols)


def add_deltas(metrics: DataFrame) -> DataFrame:
    """Differences of the reported values; relative ones are NULL on a zero baseline."""

    def diff(name: str) -> Column:
        return F.col(f"current_{name}") - F.col(f"baseline_{name}")

    return metrics.select(
        "*",
        clean(diff("clicks")).alias("delta_clicks"),
        clean(ratio(diff("clicks"), F.col("baseline_clicks"))).alias("relative_clicks"),
        clean(diff("impressions")).alias("delta_impressions"),
        clean(ratio(diff("impressions"), F.col("baseline_impressions"))).alias("relative_impressions"),
        clean(clean(diff("ctr")) * 100).alias("delta_ctr_points"),
        clean(diff("position")).alias("delta_position"),
    )


def overall_metrics(labelled: DataFrame, keys: Sequence[str] = ("property_id",)) -> DataFrame:
    sums = labelled.groupBy(*keys).agg(*_metric_sums("baseline"), *_metric_sums("current"))
    return _finish_metrics(sums, keys)


def dimension_sums(labelled: DataFrame, dims: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """All single-dimension groupings in one pass; blank values form no group."""
    trimmed = labelled.withColumns({d: F.trim(d) for d in dims})
    which = F.coalesce(*[F.when(F.grouping(d) == 0, F.lit(d)) for d in dims])
    value = F.coalesce(*[F.when(F.grouping(d) == 0, F.col(d)) for d in dims])
    sets = [[F.col("property_id"), F.col(d)] for d in dims]
    grouped = trimmed.groupingSets(sets, F.col("property_id"), *[F.col(d) for d in dims]).agg(
        which.alias("dimension"), value.alias("value"), *aggs
    )
    return grouped.drop(*dims).filter("value <> ''")


def cohort_metrics(labelled: DataFrame, dims: Sequence[str] = DIMENSIONS) -> DataFrame:
    """Every value seen in either window; a side without rows counts as zero."""
    sums = dimension_sums(labelled, dims, [*_metric_sums("baseline"), *_metric_sums("current")])
    return _finish_metrics(sums, ["property_id", "dimension", "value"])


def top_cohorts(cohorts: DataFrame, top: int) -> DataFrame:
    """First ``top`` values per property and dimension, with the group count; 0 keeps all of them (``rank`` is then a bigint).

    The rank filter is applied before the shuffle as well, so a property with very many values sends
    only ``top`` rows per task to the ranking step; without a filter, ranges of the order are ranked apart. Ranking and counting both read the cohorts, so these
    are written once to the shared folder and the search rows are scanned once.
    """
    keys = ["property_id", "dimension"]
    cohorts = cut_lineage(cohorts, "cohorts")
    order = [F.desc("current_impressions"), F.desc("baseline_impressions"), F.asc("value")]
    if top == 0:
        dealt = cohorts.repartitionByRange(*keys, *order).withColumn("_slice", F.spark_partition_id())
        every = bucketed_rank(cut_lineage(dealt, "ranges"), keys, order, F.col("_slice"), total="groups_total")
        return every.drop("_slice").withColumn("groups_returned", F.col("groups_total"))
    totals = cohorts.groupBy(*keys).agg(F.count("*").alias("groups_total"))
    ranked = cohorts.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("rank") <= top).join(totals, keys).withColumn("groups_returned", F.least("groups_total", F.lit(top).cast("bigint")))


def coverage(rows: DataFrame, baseline: DateWindow, current: DateWindow, dims: Sequence[str] = DIMENSIONS) -> DataFrame:
    """Per property: what each window includes, leaves out, and how complete its columns are."""
    imps = F.col("impressions")
    parts = []
    for name, w in zip(WINDOWS, (baseline, current)):
        inside = w.contains(F.col("day"))
        ranked = inside & F.col("position").isNotNull() & (imps > 0)
        cols = [
            F.lit(name).alias("period"),
            F.count("*").alias("source_rows"),
            F.count_if(inside).alias("included_rows"),
            F.count_if(~inside).alias("excluded_rows"),
            F.min(F.when(inside, F.col("day"))).cast("string").alias("first_day"),
            F.max(F.when(inside, F.col("day"))).cast("string").alias("last_day"),
            F.count_if(inside & (imps == 0)).alias("zero_impression_rows"),
            F.count_if(ranked).alias("position_rows"),
            clean(sum_if(ranked, imps)).alias("position_impressions"),
            clean(ratio(sum_if(ranked, imps), sum_if(inside, imps))).alias("position_impression_coverage"),
        ]
        for d in dims:
            filled = F.coalesce(F.trim(d), F.lit("")) != ""
            cols.append(F.count_if(inside & filled).alias(f"{d}_populated_rows"))
            cols.append(F.count_if(inside & ~filled).alias(f"{d}_blank_rows"))
        parts.append(F.struct(*cols).alias(name))
    return rows.groupBy("property_id").agg(*parts).select("property_id", F.inline(F.array(*WINDOWS)))


def shared_dimensions(
    current_columns: Sequence[str], baseline_columns: Sequence[str], allow_unaligned: bool = False
) -> tuple[list[str], dict[str, tuple[bool, bool]]]:
    """Dimensions of both exports, and for the others which side lacks them. Unaligned grains raise."""
    cur = [d for d in DIMENSIONS if d in current_columns]
    base = [d for d in DIMENSIONS if d in baseline_columns]
    if cur != base and not allow_unaligned:
        raise ValueError(f"grains differ: current {cur}, baseline {base}")
    shared = [d for d in DIMENSIONS if d in cur and d in base]
    return shared, {d: (d not in cur, d not in base) for d in DIMENSIONS if d not in shared}


def periods(selection: DataFrame, declared: DataFrame) -> DataFrame:
    """Requested, observed and effective bounds of each window."""
    joined = selection.join(declared, ["property_id", "period"], "left")
    eff_start = F.coalesce("start", "first_day")
    eff_end = F.coalesce("end", "last_day")
    return joined.select(
        "property_id",
        "period",
        F.col("start").cast("string").alias("requested_start"),
        F.col("end").cast("string").alias("requested_end"),
        F.col("first_day").cast("string").alias("observed_start"),
        F.col("last_day").cast("string").alias("observed_end"),
        eff_start.cast("string").alias("effective_start"),
        eff_end.cast("string").alias("effective_end"),
        F.when(F.col("start").isNotNull(), F.lit("declared")).otherwise(F.lit("observed")).alias("boundary_source"),
        (F.datediff(eff_end, eff_start) + 1).cast("double").alias("calendar_days"),
    )


def issue_list(*issues: Column) -> Column:
    return F.array_compact(F.array(*issues))


def issue_status(issues: Column) -> Column:
    """complete / unknown / degraded, by whether some fact is missing or some fact is bad."""
    return (
        F.when(F.size(issues) == 0, F.lit("complete"))
        .when(F.exists(issues, lambda c: c.endswith("_missing") | c.endswith("_unknown")), F.lit("unknown"))
        .otherwise(F.lit("degraded"))
    )


def code(condition: Column, name: str) -> Column:
    return F.when(condition, F.lit(name))


def collection_issues() -> list[Column]:
    """Issues every kind of source shares, read from its declared collection facts."""
    fin, pre = F.col("finality"), F.col("preliminary")
    return [
        code(F.col("data_as_of").isNull(), "data_as_of_missing"),
        F.when(fin == "unknown", F.lit("finality_unknown")).when(
            (fin == "preliminary") | F.coalesce(pre, F.lit(False)), F.lit("data_preliminary")
        ),
        code(pre.isNotNull() & (pre != (fin == "preliminary")), "finality_preliminary_inconsistent"),
        F.when(F.col("row_limit_hit").isNull(), F.lit("row_limit_status_missing")).when(
            F.col("row_limit_hit"), F.lit("row_limit_hit")
        ),
        F.when(F.col("pagination_complete").isNull(), F.lit("pagination_status_missing")).when(
            ~F.col("pagination_complete"), F.lit("pagination_incomplete")
        ),
    ]


def quality_issue() -> Column:
    return F.when(F.col("declared_quality") == "unknown", F.lit("data_quality_unknown")).when(
        F.col("declared_quality") == "degraded", F.lit("data_quality_degraded")
    )


def source_contract(sources: DataFrame) -> DataFrame:
    """Issue codes and status of each search export."""
    embedded, outside = F.col("embedded_timezone"), F.col("outside_timezone")
    zone = F.coalesce(embedded, outside, F.lit(SEARCH_TIMEZONE))
    issues = issue_list(
        code(embedded.isNotNull() & outside.isNotNull() & (embedded != outside), "source_timezone_inconsistent"),
        code(F.col("source_kind") != "gsc_search_analytics", "source_kind_inconsistent"),
        code(zone != SEARCH_TIMEZONE, "gsc_source_timezone_nonstandard"),
        *collection_issues(),
        quality_issue(),
    )
    return sources.withColumns({"source_timezone": zone, "issues": issues}).withColumn(
        "status", issue_status(F.col("issues"))
    )


def report_gate(contracts: DataFrame, window_ends: Column, properties: DataFrame) -> DataFrame:
    """All issues of a comparison and the verdict they leave open.

    ``contracts`` has two rows per property (``source_id`` baseline and current); ``window_ends`` gives
    the last day each source must cover; ``properties`` carries the analysis-level facts.
    """
    day = as_of_day(F.col("data_as_of"), F.col("source_timezone"))
    wrong = F.col("data_as_of").isNotNull() & F.col("source_timezone").isNotNull() & day.isNull()
    late = F.when(wrong, F.array(F.lit("data_as_of_invalid"))).when(day < window_ends, F.array(F.lit("data_as_of_before_window_end"))).otherwise(
        F.array().cast("array<string>")
    )
    own = F.transform(F.concat(F.col("issues"), late), lambda c: F.concat(F.col("source_id"), F.lit(":"), c))
    sided = contracts.withColumn("own", own)
    per = []
    for w in WINDOWS:
        per += [
            F.max(F.when(F.col("source_id") == w, F.col("own"))).alias(f"{w}_own"),
            F.max(F.when(F.col("source_id") == w, F.col("source_timezone"))).alias(f"{w}_zone"),
        ]
    joined = sided.groupBy("property_id").agg(*per).join(properties, "property_id")
    shared = issue_list(
        code(F.col("baseline_zone") != F.col("current_zone"), "baseline,current:source_timezone_mismatch"),
        code(F.col("analysis_timezone").isNull(), "analysis:analysis_timezone_missing"),
        code(F.coalesce(F.col("property_label"), F.lit("")) == "", "analysis:property_id_missing"),
        code(F.coalesce(F.col("search_type"), F.lit("")) == "", "analysis:search_type_missing"),
        code(F.col("grain_overridden"), "baseline,current:grain_alignment_overridden"),
    )
    issues = F.concat("baseline_own", "current_own", shared)
    done = joined.select("property_id", issues.alias("issues"))
    return done.select(
        "property_id",
        "issues",
        F.when(F.size("issues") == 0, F.lit("complete")).otherwise(F.lit("inconclusive")).alias("status"),
        F.when(F.size("issues") == 0, F.lit("descriptive")).otherwise(F.lit("inconclusive")).alias("verdict"),
    )


# --- AI-surface impressions -----------------------------------------------------------------------


def _ai_sums(window: str) -> list[Column]:
    inside = F.col("period") == window
    return [
        sum_if(inside, F.col("impressions")).alias(f"{window}_impressions"),
        F.count_if(inside).alias(f"{window}_rows"),
        F.count_if(inside & (F.col("impressions") == 0)).alias(f"{window}_zero_impression_rows"),
    ]


def ai_totals(labelled: DataFrame, keys: Sequence[str] = ("property_id",)) -> DataFrame:
    return labelled.groupBy(*keys).agg(*_ai_sums("baseline"), *_ai_sums("current"))


def ai_deltas(totals: DataFrame) -> DataFrame:
    """Absolute and relative change; the reason column says why a relative change is absent."""
    base, cur = F.col("baseline_impressions"), F.col("current_impressions")
    return totals.select(
        "*",
        clean(cur - base, 12).alias("impressions_absolute"),
        F.when(base > 0, clean((cur - base) / base, 12)).alias("impressions_relative"),
        F.when(base <= 0, F.lit("baseline_impressions_zero")).alias("relative_reason"),
    )


def ai_cohorts(labelled: DataFrame, dims: Sequence[str] = AI_DIMENSIONS) -> DataFrame:
    return ai_deltas(dimension_sums(labelled, dims, [*_ai_sums("baseline"), *_ai_sums("current")]))


def require_same_grain(current_columns: Sequence[str], baseline_columns: Sequence[str]) -> list[str]:
    fields = ("day", *AI_DIMENSIONS)
    cur, base = ([f for f in fields if f in cols] for cols in (current_columns, baseline_columns))
    if cur != base:
        raise ValueError(f"grains differ: current {cur}, baseline {base}")
    return cur


def ai_source_agreement(sources: DataFrame) -> DataFrame:
    """Null-safe equality of property and filters between the two exports of a comparison."""
    left = sources.filter("source_id = 'baseline'").select(
        "comparison_id", F.col("property_id").alias("b_property"), F.col("filters").alias("b_filters")
    )
    right = sources.filter("source_id = 'current'").select(
        "comparison_id", F.col("property_id").alias("c_property"), F.col("filters").alias("c_filters")
    )
    same_property = F.col("b_property").eqNullSafe(F.col("c_property"))
    same_filters = F.col("b_filters").eqNullSafe(F.col("c_filters"))
    return left.join(right, "comparison_id").select(
        "comparison_id",
        same_property.alias("same_property"),
        same_filters.alias("same_filters"),
        F.when(~same_property, F.lit("property_mismatch"))
        .when(~same_filters, F.lit("filters_mismatch"))
        .alias("refusal"),
    )


def severity_status(limited: Column, count: Column) -> Column:
    return F.when(limited, F.lit("limited")).when(count > 0, F.lit("unknown")).otherwise(F.lit("complete"))


def window_length_gate(two_periods: DataFrame) -> DataFrame:
    """Compare calendar days of the two windows; differing lengths limit the comparison."""
    days = [F.max(F.when(F.col("period") == w, F.col("calendar_days"))).alias(f"{w}_days") for w in WINDOWS]
    out = two_periods.groupBy("property_id").agg(*days)
    unknown = F.col("baseline_days").isNull() | F.col("current_days").isNull()
    differs = F.coalesce(F.col("baseline_days") != F.col("current_days"), F.lit(False))
    issue = F.when(unknown, F.lit("window_length_unknown")).when(differs, F.lit("window_length_mismatch"))
    return out.withColumn("issue", issue).withColumns(
        {
            "severity": F.when(unknown, F.lit("unknown")).when(differs, F.lit("limited")),
            "status": severity_status(differs, issue.isNotNull().cast("int")),
        }
    )


def ai_source_contract(sources: DataFrame, row_limit: int = AI_ROW_LIMIT) -> DataFrame:
    """Issues as ``severity:code`` for each AI-surface export, with status and completeness."""
    fin = F.col("finality")
    pre = F.coalesce(F.col("preliminary"), fin == "preliminary")
    day = as_of_day(F.col("data_as_of"), SEARCH_TIMEZONE)
    issues = issue_list(
        code(F.col("property_id").isNull(), "unknown:property_missing"),
        code(F.col("filters").isNull(), "unknown:filters_missing"),
        F.when(F.col("data_as_of").isNull(), F.lit("unknown:data_as_of_missing"))
        .when(day.isNull(), F.lit("unknown:data_as_of_invalid"))
        .when(
            day < F.col("window_end"), F.lit("limited:data_as_of_before_window_end")
        ),
        F.when(fin == "unknown", F.lit("unknown:finality_unknown")).when(pre, F.lit("limited:data_preliminary")),
        F.when(F.col("completeness") == "unknown", F.lit("unknown:completeness_unknown")).when(
            F.col("completeness") == "incomplete", F.lit("limited:completeness_incomplete")
        ),
        F.when(F.col("row_limit_hit").isNull(), F.lit("unknown:row_limit_status_unknown")).when(
            F.col("row_limit_hit"), F.lit("limited:ui_row_limit_hit")
        ),
        code(F.col("source_rows") >= row_limit, "limited:source_rows_at_or_above_ui_limit"),
        code(F.col("placeholder_rows") > 0, "unknown:ui_placeholders_normalized_to_zero"),
    )
    complete = (
        F.col("property_id").isNotNull()
        & F.col("filters").isNotNull()
        & F.col("data_as_of").isNotNull()
        & (fin != "unknown")
        & (F.col("completeness") != "unknown")
        & F.col("row_limit_hit").isNotNull()
    )
    staged = sources.withColumn("issues", issues)
    limited = F.exists("issues", lambda c: c.startswith("limited:"))
    return staged.withColumns(
        {"status": severity_status(limited, F.size("issues")), "contract_complete": complete}
    )
