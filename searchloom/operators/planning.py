"""Planning jobs: web vitals, unit economics, break-even, link gaps, URL parameters, migrations, decline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from searchloom.functions import urls
from searchloom.functions.numbers import clean, ratio
from searchloom.operators import graph

# Upper limits of good and of needs-improvement per vital.
VITAL_LIMITS = {"LCP": (2.5, 4.0), "INP": (200.0, 500.0), "CLS": (0.1, 0.25)}


def _steps(value: Column) -> Column:
    """Ordered buckets of a number: 64 to each doubling, negative numbers mirrored."""
    size = F.floor(F.log2(F.abs(value)) * 64) + F.lit(80_000)
    return F.when(value == 0, F.lit(0).cast("long")).when(value > 0, size).otherwise(-size)


def quantiles(rows: DataFrame, keys: Sequence[str], value: str, points: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles of groups of any size.

    Equal values are counted before the shuffle. Ordered buckets tell which of them holds each wanted place; only those
    buckets' values are ordered, so no task sees a whole group.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    counted = counted.withColumn("_b", _steps(F.col(value)))
    sums = counted.groupBy(*keys, "_b").agg(F.sum("_n").alias("_c"))
    along = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    placed = sums.select(*keys, "_b", (F.sum("_c").over(along) - F.col("_c")).alias("_before"), "_c", F.sum("_c").over(Window.partitionBy(*keys)).alias("samples"))
    # the places below and above each point, from 0
    spots = F.array(*[F.struct(F.lit(name).alias("name"), ((F.col("samples") - 1) * F.lit(p)).alias("at")) for name, p in points.items()])
    wanted = placed.select("*", F.inline(spots))
    holds = lambda place: (place >= F.col("_before")) & (place < F.col("_before") + F.col("_c"))
    wanted = wanted.filter(holds(F.floor("at")) | holds(F.ceil("at"))).drop("_c")
    inside = Window.partitionBy(*keys, "_b", "name").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    sought = wanted.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], F.col("_b").alias("_wb"), "name", "at", "samples", "_before")
    on = [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)] + [F.col("_b") == F.col("_wb")]
    near = counted.join(sought, on)
    ended = near.withColumn("_end", F.sum("_n").over(inside) + F.col("_before"))
    begun = F.col("_end") - F.col("_n")
    hit = lambda place: F.max(F.when((place >= begun) & (place < F.col("_end")), F.col(value)))
    ends = ended.groupBy(*keys, "name", "at", "samples").agg(hit(F.floor("at")).alias("_low"), hit(F.ceil("at")).alias("_high"))
    part = F.col("at") - F.floor("at")
    read = ends.withColumn("_q", F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(F.col("_low") * (1 - part) + F.col("_high") * part))
    return read.groupBy(*keys).agg(
        F.max("samples").alias("samples"), *[F.max(F.when(F.col("name") == name, F.col("_q"))).alias(name) for name in points]
    )


def web_vitals(samples: DataFrame, min_samples: int) -> DataFrame:
    """75th percentile per URL, device and metric, rated; too few samples is its own state.

    ``samples``: ``url, device, metric, value``. Devices are never mixed.
    """
    p75 = quantiles(samples, ["url", "device", "metric"], "value", {"p75": 0.75})
    rating = F.when(F.col("samples") < min_samples, F.lit("insufficient-field-data"))
    for name, (good, fair) in VITAL_LIMITS.items():
        mine = F.col("metric") == name
        rating = (
            rating.when(mine & (F.col("p75") <= good), F.lit("good"))
            .when(mine & (F.col("p75") <= fair), F.lit("needs-improvement"))
            .when(mine, F.lit("poor"))
        )
    return p75.withColumn("rating", rating).withColumn(
        "p75", F.when(F.col("samples") >= min_samples, clean(F.col("p75")))
    )


def funnel_economics(cohorts: DataFrame) -> DataFrame:
    """Rates and unit values per cohort row with ``sessions, qualified, opportunities, matured, won,
    revenue, margin, cost``; every rate keeps its own denominator."""
    return cohorts.select(
        "*",
        clean(ratio(F.col("qualified"), F.col("sessions"))).alias("qualified_rate"),
        clean(ratio(F.col("opportunities"), F.col("qualified"))).alias("opportunity_rate"),
        clean(ratio(F.col("won"), F.col("matured"))).alias("win_rate"),
        clean(ratio(F.col("cost"), F.col("qualified"))).alias("cost_per_qualified"),
        clean(F.col("margin") - F.col("cost")).alias("net_value"),
    )


def break_even(markets: DataFrame) -> DataFrame:
    """Deals and clicks that cover the cost, and the value expected from the clicks at hand."""
    deal_rate = ratio(F.col("deals"), F.col("clicks"))
    needed = ratio(F.col("cost"), F.col("value_per_deal"))
    return markets.select(
        "*",
        clean(needed).alias("break_even_deals"),
        clean(ratio(needed, deal_rate)).alias("break_even_clicks"),
        clean(F.col("clicks") * deal_rate * F.col("value_per_deal")).alias("expected_value"),
    )


def domain_gap(links: DataFrame, ours: Column, min_competitors: int) -> DataFrame:
    """Referring domains of several competitors that do not link to us.

    ``links``: ``domain, site``. Pairs are made distinct map-side first; one pass decides both tests.
    """
    pairs = links.select("domain", "site", ours.alias("is_ours")).distinct()
    per = pairs.groupBy("domain").agg(
        F.count_if(~F.col("is_ours")).alias("competitors"), F.bool_or("is_ours").alias("links_to_us")
    )
    return per.filter((F.col("competitors") >= min_competitors) & ~F.col("links_to_us")).drop("links_to_us")


def parameter_inventory(pages: DataFrame, reach: DataFrame | None = None) -> DataFrame:
    """URLs of one path with the same parameters in another order, and empty or repeated parameters.

    ``pages``: ``site_id, url``. With ``reach`` (``site_id, url, inbound, depth``) each group also has the links into its spellings and the
    smallest click depth of one of them; NULL where none is reached.
    """
    u = F.col("url")
    pairs = F.filter(F.split(urls.query_string(u), "&"), lambda p: p != "")
    names = F.transform(pairs, lambda p: F.substring_index(p, "=", 1))
    rows = pages.select("site_id", "url", urls.path(u).alias("path"), pairs.alias("pairs"), names.alias("names"))
    keyed = rows.filter(F.size("pairs") > 0).select(
        "site_id",
        "path",
        F.array_join(F.array_sort("pairs"), "&").alias("parameters"),
        "url",
        F.exists("pairs", lambda p: ~p.contains("=") | p.endswith("=")).alias("empty_value"),
        (F.size(F.array_distinct("names")) < F.size("names")).alias("repeated_name"),
    )
    # one row a spelling first: the counts of links then meet each once
    spelled = keyed.groupBy("site_id", "path", "parameters", "url").agg(F.bool_or("empty_value").alias("empty_value"), F.bool_or("repeated_name").alias("repeated_name"))
    counts = [F.count("*").alias("spellings"), F.bool_or("empty_value").alias("empty_value"), F.bool_or("repeated_name").alias("repeated_name")]
    if reach is not None:
        spelled = spelled.join(reach.select("site_id", "url", "inbound", "depth"), ["site_id", "url"], "left")
        counts += [F.coalesce(F.sum("inbound"), F.lit(0)).alias("inbound"), F.min("depth").alias("depth")]
    return spelled.groupBy("site_id", "path", "parameters").agg(*counts)


def parameter_share(pages: DataFrame) -> DataFrame:
    with_query = urls.query_string(F.col("url")) != ""
    return pages.groupBy("site_id").agg(
        F.count("*").alias("urls"),
        F.count_if(with_query).alias("parameter_urls"),
        clean(F.count_if(with_query) / F.count("*")).alias("parameter_share"),
    )


def migration_checks(inventory: DataFrame, redirects: DataFrame, statuses: DataFrame) -> DataFrame:
    """State of every old URL: kept, unmapped, loop, chain, or a target that answers with an error.

    ``inventory``: ``url, source`` from all lists; ``redirects``: ``url, location``; ``statuses``:
    ``url, status``.
    """
    old = inventory.groupBy("url").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    ends = graph.resolve_redirects(redirects).select("url", "final_url", "hops", "state")
    final = statuses.select(F.col("url").alias("final_url"), F.col("status").alias("final_status"), F.lit(True).alias("_known"))
    joined = old.join(ends, "url", "left").withColumn("final_url", F.coalesce("final_url", "url")).join(final, "final_url", "left")
    issue = (
        F.when(F.col("state") == "loop", F.lit("loop"))
        .when(F.col("state") == "too_long", F.lit("chain_too_long"))
        .when(F.col("_known").isNull(), F.lit("unmapped"))
        .when(F.col("final_status").isNull() | (F.col("final_status") >= 400), F.lit("target_error"))
        .when(F.col("hops") > 1, F.lit("chain"))
    )
    return joined.select("url", "sources", "final_url", F.coalesce("hops", F.lit(0)).alias("hops"), issue.alias("issue"))


def link_audit(facts: DataFrame, edges: DataFrame, redirects: DataFrame, fetches: DataFrame) -> DataFrame:
    """One row per faulty internal edge: broken, redirecting, or to a page that prefers another URL."""
    hop = redirects.select(F.col("url").alias("target"), "location")
    tried = fetches.select("site_id", F.col("url").alias("target"), "status", F.lit(True).alias("_tried"))
    preferred = facts.select(
        "site_id", F.col("url").alias("target"), F.when(F.size("canonicals") == 1, F.element_at("canonicals", 1)).alias("canonical")
    )
    keys = ["site_id", "target"]
    joined = edges.join(hop, "target", "left").join(tried, keys, "left").join(preferred, keys, "left")
    issue = (
        F.when(F.col("location").isNotNull(), F.lit("redirecting"))
        .when(F.col("_tried") & (F.col("status").isNull() | (F.col("status") >= 400)), F.lit("broken"))
        .when(F.col("canonical") != F.col("target"), F.lit("not_preferred"))
    )
    return joined.select("site_id", "source", "target", issue.alias("issue")).filter("issue IS NOT NULL")


def shared_queries(labelled: DataFrame) -> DataFrame:
    """Queries served by several pages of a property in one window, with the leading page's share."""
    keys = ["property_id", "period", "query"]
    per_page = (
        labelled.filter("trim(query) <> '' AND trim(page) <> ''")
        .groupBy(*keys, "page")
        .agg(F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"))
    )
    total = F.sum("impressions")
    lead = F.max_by("page", F.struct(F.col("impressions"), F.col("page")))
    return (
        per_page.groupBy(*keys)
        .agg(
            F.count("*").alias("pages"),
            total.alias("impressions"),
            lead.alias("leading_page"),
            clean(ratio(F.max("impressions"), total)).alias("leading_share"),
        )
        .filter("pages > 1")
    )


def decline_candidates(daily: DataFrame, history: int, deviations: float) -> DataFrame:
    """Months in which a page falls below its own preceding months; denominators stay visible.

    The window covers the months of one page, so its size is bounded by the calendar.
    """
    monthly = (
        daily.filter("trim(page) <> ''")
        .groupBy("property_id", "page", F.date_format("day", "yyyy-MM").alias("month"))
        .agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"))
    )
    before = Window.partitionBy("property_id", "page").orderBy("month").rowsBetween(-history, -1)
    staged = monthly.withColumns(
        {
            "months_before": F.count("*").over(before),
            "mean_before": F.avg("impressions").over(before),
            "sd_before": F.stddev_samp("impressions").over(before),
        }
    )
    enough = F.col("months_before") >= history
    below = F.col("impressions") < F.col("mean_before") - deviations * F.col("sd_before")
    return staged.select(
        "property_id", "page", "month", "clicks", "impressions", "months_before",
        clean(F.col("mean_before"), 6).alias("mean_before"), clean(F.col("sd_before"), 6).alias("sd_before"),
        F.when(~enough, F.lit("no-comparable-baseline")).when(below, F.lit("candidate")).otherwise(F.lit("in-range")).alias("state"),
    )


def group_decline_candidates(daily: DataFrame, group: Column, history: int, deviations: float) -> DataFrame:
    """Months in which a page's share of its page group's impressions falls below the share of its preceding months.

    Seasons and outages that move the whole group leave shares alone. ``group`` is an expression over ``page``.
    """
    by_page = (
        daily.filter("trim(page) <> ''")
        .groupBy("property_id", group.alias("page_group"), "page", F.date_format("day", "yyyy-MM").alias("month"))
        .agg(F.sum("impressions").alias("impressions"))
    )
    totals = by_page.groupBy("property_id", "page_group", "month").agg(F.sum("impressions").alias("group_impressions"))
    monthly = by_page.join(totals, ["property_id", "page_group", "month"])
    share = clean(ratio(F.col("impressions"), F.col("group_impressions")))
    before = Window.partitionBy("property_id", "page_group", "page").orderBy("month").rowsBetween(-history, -1)
    staged = monthly.withColumn("share", share).withColumns(
        {"months_before": F.count("share").over(before), "_mean": F.avg("share").over(before), "_sd": F.stddev_samp("share").over(before)}
    )
    mean, spread = clean(F.col("_mean"), 6), clean(F.col("_sd"), 6)
    below = F.col("share") < mean - deviations * spread
    return staged.select(
        "property_id", "page_group", "page", "month", "impressions", "group_impressions", "share", "months_before",
        mean.alias("mean_before"), spread.alias("sd_before"),
        F.when(F.col("months_before") < history, F.lit("no-comparable-baseline")).when(below, F.lit("candidate")).otherwise(F.lit("in-range")).alias("state"),
    )


def paid_organic_overlap(organic: DataFrame, paid: DataFrame) -> DataFrame:
    """Full outer comparison on the normalised query; both sides are summed before they meet.

    ``organic``: ``query, clicks, impressions``; ``paid``: ``query, paid_clicks, cost``.
    """
    key = F.regexp_replace(F.lower(F.trim("query")), r"\s+", " ")
    left = organic.groupBy(key.alias("query")).agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"))
    right = paid.groupBy(key.alias("query")).agg(F.sum("paid_clicks").alias("paid_clicks"), F.sum("cost").alias("cost"))
    both = left.filter("query <> ''").join(right.filter("query <> ''"), "query", "full")
    return both.withColumn(
        "coverage",
        F.when(F.col("clicks").isNull(), F.lit("paid_only")).when(F.col("paid_clicks").isNull(), F.lit("organic_only")).otherwise(
            F.lit("both")
        ),
    )
