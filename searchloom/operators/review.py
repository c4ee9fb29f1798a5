"""Three-source review: search, analytics and CRM aggregates side by side.

A missing value is never zero here: every figure is a value or a reason. Rows of all sources share one
table (``property_id, kind, day, landing_page, country, device, explicitly_mapped, temporal_grain`` and
the metric columns of all kinds), so totals and page cohorts each take one aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from searchloom.functions.dates import as_of_day
from searchloom.functions.numbers import clean
from searchloom.operators.compare import (
    SEARCH_TIMEZONE,
    DateWindow,
    check_windows,
    code,
    collection_issues,
    issue_list,
    issue_status,
    quality_issue,
)
from searchloom.session import cut_lineage

KINDS = ("search", "analytics", "crm")
METRICS = {
    "search": ("clicks", "impressions"),
    "analytics": ("sessions", "conversions"),
    "crm": ("leads", "qualified", "pipeline_value"),
}
# Derived rate -> (numerator, denominator) per source kind.
RATES = {
    "search": {"ctr": ("clicks", "impressions")},
    "analytics": {"conversion_rate": ("conversions", "sessions")},
    "crm": {"qualified_rate": ("qualified", "leads")},
}
GRAIN = {
    "search": ("day", "landing_page", "country", "device"),
    "analytics": ("day", "landing_page", "country", "device"),
    "crm": ("day", "landing_page", "country"),
}
PERIODS = ("baseline", "current")


def period_label(day: Column, baseline: DateWindow, current: DateWindow) -> Column:
    check_windows(baseline, current)
    return (
        F.when(day.isNull(), F.lit("blank_date"))
        .when(baseline.contains(day), F.lit("baseline"))
        .when(current.contains(day), F.lit("current"))
        .otherwise(F.lit("outside"))
    )


def label_periods(rows: DataFrame, baseline: DateWindow, current: DateWindow) -> DataFrame:
    return rows.withColumn("period", period_label(F.col("day"), baseline, current))


def _full_grain() -> Column:
    no_device = F.col("kind") == "crm"
    return (
        F.col("day").isNotNull()
        & F.col("landing_page").isNotNull()
        & F.col("country").isNotNull()
        & (F.col("device").isNotNull() | no_device)
    )


def dataset_quality(labelled: DataFrame) -> DataFrame:
    """Counts per property and source; duplicates are counted on the source's own full grain.

    One pass: rows are first combined per grain value, which settles the duplicates, and those partial
    counts are then added up.
    """
    metrics = [(kind, m) for kind in KINDS for m in METRICS[kind]]
    # Grains as numbers: sums and extremes of numbers stay in hash aggregation, text would be sorted.
    known = F.when(F.col("temporal_grain") == "date", 1).when(F.col("temporal_grain") == "timestamp", 2)
    per_grain = labelled.groupBy("property_id", "kind", *GRAIN["search"], "period").agg(
        F.count("*").alias("n"),
        *[F.count(m).alias(f"known_{m}") for _, m in metrics],
        F.min(known).alias("grain_low"),
        F.max(known).alias("grain_high"),
    )

    def rows_where(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    repeated = _full_grain() & (F.col("n") > 1)
    low, high = F.min("grain_low"), F.max("grain_high")
    grain = (
        F.when(low.isNull(), F.lit("unknown"))
        .when(low != high, F.lit("mixed"))
        .when(low == 1, F.lit("date"))
        .otherwise(F.lit("timestamp"))
    )
    return per_grain.groupBy("property_id", "kind").agg(
        F.sum("n").alias("source_rows"),
        *[rows_where(F.col("period") == p).alias(f"{p}_rows") for p in (*PERIODS, "outside", "blank_date")],
        *[rows_where(F.col(d).isNull()).alias(f"blank_{d}") for d in ("day", "landing_page", "country")],
        rows_where(F.col("device").isNull() & (F.col("kind") != "crm")).alias("blank_device"),
        *[
            F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n") - F.col(f"known_{m}"))), F.lit(0)).alias(
                f"blank_metric_{m}"
            )
            for kind, m in metrics
        ],
        rows_where(_full_grain()).alias("full_grain_rows"),
        grain.alias("temporal_grain"),
        F.count_if(repeated).alias("duplicate_groups"),
        rows_where(repeated).alias("duplicate_rows"),
    )


def quality_issues(quality: DataFrame) -> DataFrame:
    """One row per issue code with the count behind it."""
    entries = [
        F.struct(F.lit(f"blank_or_invalid_{d}").alias("code"), F.col(f"blank_{d}").alias("n"))
        for d in ("day", "landing_page", "country", "device")
    ]
    entries += [
        F.struct(F.lit(f"blank_metric_{m}").alias("code"), F.col(f"blank_metric_{m}").alias("n"))
        for kind in KINDS
        for m in METRICS[kind]
    ]
    unusable = F.col("temporal_grain").isin("mixed", "unknown")
    entries.append(F.struct(F.lit("temporal_grain_unusable").alias("code"), unusable.cast("bigint").alias("n")))
    entries += [
        F.struct(F.lit(f"{p}_window_empty").alias("code"), (F.col(f"{p}_rows") == 0).cast("bigint").alias("n"))
        for p in PERIODS
    ]
    return quality.select("property_id", "kind", F.inline(F.array(*entries))).filter("n > 0")


def _observation(kind: str, metric: str, period: str) -> Column:
    """Strict sum: any blank value withholds the total."""
    stem = f"{kind}_{metric}_{period}"
    rows, known, total = F.col(f"{kind}_{period}_rows"), F.col(f"{stem}_known"), F.col(f"{stem}_total")
    reason = (
        F.when(rows == 0, F.lit("no_rows"))
        .when(known == 0, F.lit("all_values_blank"))
        .when(known < rows, F.lit("partial_values_blank"))
    )
    return F.struct(F.when(reason.isNull(), clean(total)).alias("value"), reason.alias("reason"))


def _rate(numerator: Column, denominator: Column) -> Column:
    num, den = numerator["value"], denominator["value"]
    reason = F.coalesce(
        F.when(num.isNull(), numerator["reason"]),
        F.when(den.isNull(), denominator["reason"]),
        F.when(den == 0, F.lit("zero_denominator")),
    )
    return F.struct(F.when(reason.isNull(), clean(num / den)).alias("value"), reason.alias("reason"))


def metric_bundles(labelled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Totals, rates and deltas per key, source kind and metric, each with its reason when absent."""
    aggs: list[Column] = []
    for kind in KINDS:
        for p in PERIODS:
            inside = (F.col("kind") == kind) & (F.col("period") == p)
            aggs.append(F.count_if(inside).alias(f"{kind}_{p}_rows"))
            for m in METRICS[kind]:
                value = F.when(inside, F.col(m))
                aggs.append(F.count(value).alias(f"{kind}_{m}_{p}_known"))
                aggs.append(F.sum(value).alias(f"{kind}_{m}_{p}_total"))
    inside_any = labelled.filter(F.col("period").isin(*PERIODS))
    sums = inside_any.groupBy(*keys).agg(*aggs)
    rows = [f"{kind}_{p}_rows" for kind in KINDS for p in PERIODS]
    observed = sums.select(
        *keys,
        *rows,
        *[_observation(k, m, p).alias(f"{k}__{m}__{p}") for k in KINDS for m in METRICS[k] for p in PERIODS],
    )
    rated = observed.select(
        "*",
        *[
            _rate(F.col(f"{k}__{num}__{p}"), F.col(f"{k}__{den}__{p}")).alias(f"{k}__{rate}__{p}")
            for k in KINDS
            for rate, (num, den) in RATES[k].items()
            for p in PERIODS
        ],
    )
    entries = []
    for k in KINDS:
        for m in (*METRICS[k], *RATES[k]):
            base, cur = F.col(f"{k}__{m}__baseline"), F.col(f"{k}__{m}__current")
            entries.append(
                F.struct(
                    F.lit(k).alias("kind"),
                    F.lit(m).alias("metric"),
                    F.col(f"{k}_baseline_rows").alias("baseline_rows"),
                    F.col(f"{k}_current_rows").alias("current_rows"),
                    base["value"].alias("baseline_value"),
                    base["reason"].alias("baseline_reason"),
                    cur["value"].alias("current_value"),
                    cur["reason"].alias("current_reason"),
                )
            )
    return with_deltas(rated.select(*keys, F.inline(F.array(*entries))))


def with_deltas(bundles: DataFrame) -> DataFrame:
    base, cur = F.col("baseline_value"), F.col("current_value")
    absent = F.when(
        base.isNull() | cur.isNull(),
        F.when(F.col("baseline_rows") == 0, F.lit("cohort_missing_in_baseline"))
        .when(F.col("current_rows") == 0, F.lit("cohort_missing_in_current"))
        .when(base.isNull(), F.lit("baseline_unavailable"))
        .otherwise(F.lit("current_unavailable")),
    )
    return bundles.select(
        "*",
        clean(cur - base).alias("absolute"),
        absent.alias("absolute_reason"),
        F.when(base != 0, clean((cur - base) / base)).alias("relative"),
        F.coalesce(absent, F.when(base == 0, F.lit("zero_denominator"))).alias("relative_reason"),
    )


def landing_page_cohorts(labelled: DataFrame) -> DataFrame:
    """Every page seen in either window, with all sources and both windows."""
    return metric_bundles(labelled.filter("landing_page IS NOT NULL"), ["property_id", "landing_page"])


def cross_source_alignment(sources: DataFrame) -> DataFrame:
    """How far sources of one property may be joined: by day, or only as window totals.

    ``sources`` has one row per property and kind, with its temporal grain and timezone.
    """
    grains = F.array_sort(F.collect_set("temporal_grain"))
    zones = F.collect_set("source_timezone")
    out = sources.groupBy("property_id").agg(
        F.count("*").alias("n"), grains.alias("grains"), F.size(zones).alias("zones"),
        F.count_if(F.col("source_timezone").isNull()).alias("no_zone"),
    )
    only_date = F.col("grains") == F.array(F.lit("date"))
    only_stamp = F.col("grains") == F.array(F.lit("timestamp"))
    same_zone = (F.col("zones") == 1) & (F.col("no_zone") == 0)
    mode = (
        F.when(F.col("n") == 1, F.lit("single_source"))
        .when(only_stamp, F.lit("timestamp_normalized_daily_join"))
        .when(only_date & same_zone, F.lit("source_date_daily_join"))
        .otherwise(F.lit("window_aggregate_only"))
    )
    issue = F.when(
        mode == "window_aggregate_only",
        F.when(only_date, F.lit("source_day_boundary_mismatch")).otherwise(F.lit("temporal_grain_inconsistent")),
    )
    return out.select(
        "property_id",
        mode.alias("mode"),
        mode.isin("timestamp_normalized_daily_join", "source_date_daily_join").alias("daily_join_allowed"),
        issue.alias("issue"),
    )


def _grain_counts(labelled: DataFrame) -> DataFrame:
    """Rows (``n``) and explicitly mapped rows per grain of all sources, read once and written."""
    inside = labelled.filter(F.col("period").isin(*PERIODS))
    counts = inside.groupBy("property_id", "kind", "period", *GRAIN["search"]).agg(
        F.count("*").alias("n"), F.count_if("explicitly_mapped").alias("mapped")
    )
    return cut_lineage(counts, "coverage")


def _page_matches(grains: DataFrame) -> DataFrame:
    """Rows of each analytics and CRM page that meet a search row on the shared grain, and rows that do not."""
    search = grains.filter("kind = 'search'")
    matched_parts = []
    for kind in ("analytics", "crm"):
        grain = ["property_id", "period", *GRAIN[kind]]
        complete = F.lit(True)
        for d in GRAIN[kind]:
            complete = complete & F.col(d).isNotNull()
        marks = search.filter(complete).select(*grain).distinct().withColumn("hit", F.lit(True))
        mine = grains.filter((F.col("kind") == kind) & complete).groupBy(*grain).agg(F.sum("n").alias("n"))
        matched_parts.append(
            mine.join(marks, grain, "left").select(
                "property_id", F.lit(kind).alias("kind"), "period", "landing_page", "n", F.col("hit").isNotNull().alias("hit")
            )
        )
    joined = matched_parts[0].unionByName(matched_parts[1])
    return joined.groupBy("property_id", "kind", "period", "landing_page").agg(
        F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).alias("hit_rows"),
        F.sum(F.when(F.col("hit"), 0).otherwise(F.col("n"))).alias("miss_rows"),
    )


def unmatched_pages(labelled: DataFrame, alignment: DataFrame) -> DataFrame:
    """Every page of a source that may be joined by day, with its rows that meet no search row."""
    misses = _page_matches(_grain_counts(labelled)).filter("miss_rows > 0")
    allowed = alignment.filter("daily_join_allowed").select("property_id")
    return misses.join(allowed, "property_id", "left_semi").select("property_id", "kind", "period", "landing_page", "miss_rows")


def mapping_coverage(labelled: DataFrame, alignment: DataFrame, examples: int = 10) -> DataFrame:
    """Share of each source's rows that meet a search row on the shared grain.

    All figures come from one table of counts per grain, so the sources are read once and a repeated key crosses later
    shuffles once. Example pages are ranked on distinct pages, never collected whole; ``unmatched_pages`` has all of them.
    """
    grains = _grain_counts(labelled)
    keys = ["property_id", "kind", "period"]
    rows_if = lambda held: F.sum(F.when(held, F.col("n")).otherwise(0))
    base = grains.groupBy(*keys).agg(
        F.sum("n").alias("rows"), rows_if(_full_grain()).alias("eligible_rows"), F.sum("mapped").alias("explicit_url_mapping_rows")
    )
    search = grains.filter("kind = 'search'")
    per_page = _page_matches(grains)
    matched = per_page.groupBy(*keys).agg(F.sum("hit_rows").alias("matched_rows"))
    order = Window.partitionBy(*keys).orderBy("landing_page")
    shown = (
        per_page.filter("miss_rows > 0")
        .withColumn("r", F.row_number().over(order))
        .filter(F.col("r") <= examples)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list("landing_page")).alias("unmatched_examples"))
    )
    has_reference = search.groupBy("property_id", "period").agg(
        rows_if(_full_grain()).alias("reference_device"),
        rows_if(F.col("day").isNotNull() & F.col("landing_page").isNotNull() & F.col("country").isNotNull()).alias("reference_country"),
    )
    wide = (
        base.join(alignment, "property_id")
        .join(matched, keys, "left")
        .join(shown, keys, "left")
        .join(has_reference, ["property_id", "period"], "left")
    )
    is_search = F.col("kind") == "search"
    done = F.col("daily_join_allowed") & ~is_search
    hits = F.coalesce(F.col("matched_rows"), F.lit(0))
    reference = F.when(F.col("kind") == "crm", F.col("reference_country")).otherwise(F.col("reference_device"))
    reason = (
        F.when(is_search, F.lit(None).cast("string"))
        .when(~done, F.lit("cross_source_daily_join_forbidden"))
        .when(F.col("eligible_rows") == 0, F.lit("zero_denominator"))
        .when(F.coalesce(reference, F.lit(0)) == 0, F.lit("no_reference_cohorts"))
    )
    rate = F.when(is_search, F.col("eligible_rows") / F.col("rows")).when(
        reason.isNull(), hits / F.col("eligible_rows")
    )
    count = lambda c: F.when(done | is_search, c).cast("double")
    return wide.select(
        *keys,
        "rows",
        "eligible_rows",
        count(F.when(is_search, F.col("eligible_rows")).otherwise(hits)).alias("matched_rows"),
        count(F.when(is_search, F.lit(0)).otherwise(F.col("eligible_rows") - hits)).alias("unmatched_rows"),
        (F.col("rows") - F.col("eligible_rows")).alias("incomplete_grain_rows"),
        "explicit_url_mapping_rows",
        clean(rate).alias("matched_rate"),
        reason.alias("matched_rate_reason"),
        F.when(done, F.col("unmatched_examples")).alias("unmatched_examples"),
        F.when(is_search, F.lit("reference_source")).when(~done, F.col("mode")).alias("join_reason"),
    )


def review_source_contract(sources: DataFrame) -> DataFrame:
    """Issue codes of each review source; ``window_end`` is the last day it must cover."""
    kind, zone = F.col("kind"), F.col("source_timezone")
    day = as_of_day(F.col("data_as_of"), zone)
    analytics = kind == "analytics"
    issues = issue_list(
        code(zone.isNull(), "source_timezone_missing"),
        code((kind == "search") & (F.coalesce(zone, F.lit("")) != SEARCH_TIMEZONE), "gsc_source_timezone_nonstandard"),
        *collection_issues(),
        F.when(analytics & F.col("sampling_rate").isNull(), F.lit("sampling_rate_missing")).when(
            analytics & (F.col("sampling_rate") < 1), F.lit("sampling_applied")
        ),
        F.when(analytics & F.col("thresholding").isNull(), F.lit("thresholding_status_missing")).when(
            analytics & F.col("thresholding"), F.lit("thresholding_applied")
        ),
        code((kind != "search") & F.col("attribution_model").isNull(), "attribution_model_missing"),
        quality_issue(),
    )
    wrong = F.col("data_as_of").isNotNull() & zone.isNotNull() & day.isNull()
    late = F.when(wrong, F.array(F.lit("data_as_of_invalid"))).when(day < F.col("window_end"), F.array(F.lit("data_as_of_before_current_window_end"))).otherwise(
        F.array().cast("array<string>")
    )
    return (
        sources.withColumn("_own", issues)
        .withColumns(
            {
                "issues": F.concat("_own", late),
                "status": F.when(F.size(late) > 0, F.lit("degraded")).otherwise(issue_status(F.col("_own"))),
            }
        )
        .drop("_own")
    )


def verdicts(
    contracts: DataFrame,
    alignment: DataFrame,
    issues: DataFrame,
    totals: DataFrame,
    coverage: DataFrame,
    properties: DataFrame,
    equal_windows: bool,
) -> DataFrame:
    """Directional only when no reason against it exists; all reasons are listed."""

    def reason(cls: str, *parts: Column) -> Column:
        return F.concat_ws(":", F.lit(cls), *parts)

    pid = F.col("property_id")
    rows = [
        contracts.select(pid, F.explode("issues").alias("c"), "kind").select(
            pid, reason("contract", F.col("kind"), F.col("c")).alias("reason")
        ),
        alignment.filter("issue IS NOT NULL").select(pid, reason("time", F.col("issue")).alias("reason")),
        issues.select(pid, reason("quality", F.col("kind"), F.col("code")).alias("reason")),
    ]
    for p in PERIODS:
        base = totals.filter(F.col("metric").isin(*[m for k in KINDS for m in METRICS[k]]))
        rows.append(
            base.filter(F.col(f"{p}_rows") == 0)
            .select(pid, reason("no_data", F.col("kind"), F.lit(p)).alias("reason"))
            .distinct()
        )
        rows.append(
            base.filter(F.col(f"{p}_value").isNull()).select(
                pid, reason("incomplete", F.col("kind"), F.col("metric"), F.lit(p)).alias("reason")
            )
        )
    other = coverage.filter("kind <> 'search'")
    rows.append(
        other.filter("join_reason IS NOT NULL").select(
            pid, reason("not_joined", F.col("kind"), F.col("period"), F.col("join_reason")).alias("reason")
        )
    )
    rows.append(
        other.filter("join_reason IS NULL AND matched_rows = 0").select(
            pid, reason("no_match", F.col("kind"), F.col("period")).alias("reason")
        )
    )
    if not equal_windows:
        rows.append(properties.select(pid, F.lit("windows_differ_in_days").alias("reason")))
    union = rows[0]
    for part in rows[1:]:
        union = union.unionByName(part)
    per = union.groupBy("property_id").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    none = F.array().cast("array<string>")
    return properties.join(per, "property_id", "left").select(
        "property_id",
        F.coalesce("reasons", none).alias("reasons"),
        F.when(F.coalesce(F.size("reasons"), F.lit(0)) > 0, F.lit("inconclusive"))
        .otherwise(F.lit("directional"))
        .alias("verdict"),
    )
