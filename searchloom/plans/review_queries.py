"""Three-source review: quality, totals, cohorts, alignment, coverage and verdict."""

from pyspark.sql import functions as F

from searchloom.operators import review
from searchloom.operators.landing_pages import UrlRules
from searchloom.plans import sqltext as q
from searchloom.plans.compare_queries import AS_OF, BASELINE, COLLECTION, CURRENT, IN_B, IN_C, QUALITY, issue_list
from searchloom.plans.registry import query
from searchloom.plans.tables import load_view, with_views
from searchloom.session import cut_lineage, scratch_path
from searchloom.sources.review_files import ReviewColumns, read_review_csv

PERIOD = f"CASE WHEN day IS NULL THEN 'blank_date' WHEN {IN_B} THEN 'baseline' WHEN {IN_C} THEN 'current' ELSE 'outside' END"
LABELLED = f"""labelled AS (SELECT *, {PERIOD} AS period,
  day IS NOT NULL AND landing_page IS NOT NULL AND country IS NOT NULL AND (device IS NOT NULL OR kind = 'crm') AS full_grain FROM review_rows)"""
ROWS = with_views("review_rows", extra=LABELLED)


def _labelled(spark, sf):
    return review.label_periods(load_view(spark, sf, "review_rows"), BASELINE, CURRENT)


@query("e1_period_label", ROWS + "SELECT property_id, kind, period, count(*) AS rows FROM labelled GROUP BY ALL")
def e1(spark, sf):
    return _labelled(spark, sf).groupBy("property_id", "kind", "period").agg(F.count("*").alias("rows"))


BLANKS = ", ".join(f"count(*) FILTER ({d} IS NULL) AS blank_{d}" for d in ("day", "landing_page", "country")) + (
    ", count(*) FILTER (device IS NULL AND kind <> 'crm') AS blank_device, "
) + ", ".join(
    f"count(*) FILTER (kind = '{k}' AND {m} IS NULL) AS blank_metric_{m}" for k in review.KINDS for m in review.METRICS[k]
)
QUALITY_CTE = f"""dups AS (SELECT property_id, kind, count(*) AS duplicate_groups, sum(n)::BIGINT AS duplicate_rows FROM (
    SELECT property_id, kind, count(*) AS n FROM labelled WHERE full_grain GROUP BY property_id, kind, day, landing_page, country, device
    HAVING count(*) > 1) d GROUP BY ALL),
  quality AS (SELECT c.*, coalesce(duplicate_groups, 0) AS duplicate_groups, coalesce(duplicate_rows, 0) AS duplicate_rows FROM (
    SELECT property_id, kind, count(*) AS source_rows, count(*) FILTER (period = 'baseline') AS baseline_rows,
      count(*) FILTER (period = 'current') AS current_rows, count(*) FILTER (period = 'outside') AS outside_rows,
      count(*) FILTER (period = 'blank_date') AS blank_date_rows, {BLANKS}, count(*) FILTER (full_grain) AS full_grain_rows,
      CASE count(DISTINCT temporal_grain) FILTER (temporal_grain <> 'unknown') WHEN 0 THEN 'unknown'
        WHEN 1 THEN min(temporal_grain) FILTER (temporal_grain <> 'unknown') ELSE 'mixed' END AS temporal_grain
    FROM labelled GROUP BY property_id, kind) c LEFT JOIN dups USING (property_id, kind))"""


@query("e2_dataset_quality", ROWS + f", {QUALITY_CTE} SELECT * FROM quality")
def e2(spark, sf):
    return review.dataset_quality(_labelled(spark, sf))


METRIC_NAMES = [(k, m) for k in review.KINDS for m in review.METRICS[k]]
RULES = UrlRules("https://shop.example.com/")


def _review_files(spark, sf):
    """The review rows written as exports of three sources with headers, spellings and layouts of their own, and read back."""
    rows = load_view(spark, sf, "review_rows")
    path = scratch_path(spark, "review-files")
    page = F.when(F.col("landing_page") == "/part/11", F.lit("/old//11/?utm_source=x")).otherwise(
        F.concat(F.lit("HTTP://Shop.Example.com:443"), "landing_page", F.lit("/#top"))
    )
    day = F.col("day").cast("string")
    text = (
        F.when(F.col("temporal_grain") == "timestamp", F.concat(day, F.lit("T05:00:00+08:00")))
        .when(F.col("landing_page") == "/part/7", F.replace(day, F.lit("-"), F.lit("/")))
        .otherwise(day)
    )
    names = {"search": ("Day", "Landing page", "Country/Region", "Device"), "analytics": ("日期", "Page", "Country", "device_category"), "crm": ("date", "Lead Page", "Market")}
    url_map = spark.createDataFrame([("/old/11", "/part/11")], "source string, target string")
    parts = []
    for kind in review.KINDS:
        dims = ("date", "landing_page", "country", "device")[: len(names[kind])]
        values = {"date": text, "landing_page": page, "country": F.concat(F.lit(" "), F.lower("country")), "device": F.initcap("device")}
        columns = [values[d].alias(n) for d, n in zip(dims, names[kind])] + [F.col(m).cast("string").alias(m.title()) for m in review.METRICS[kind]]
        if kind == "search":
            columns.append(F.lit("9%").alias("Average CTR"))
        writer = rows.where(F.col("kind") == kind).select(*columns[::-1] if kind == "crm" else columns, F.col("property_id").alias("property"))
        writer.write.partitionBy("property").option("header", True).option("escape", '"').option("sep", {"crm": ";"}.get(kind, ",")).csv(f"{path}/{kind}")
        source = ReviewColumns(kind, dict(zip(dims, names[kind])), {m: m.title() for m in review.METRICS[kind]}, source_timezone="Asia/Shanghai")
        parts.append(read_review_csv(spark, f"{path}/{kind}", source, RULES, "Asia/Shanghai", url_map))
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.withColumn("property_id", F.regexp_extract("file", "property=([^/]+)/", 1))


@query(
    "a9_read_review_csv",
    with_views("review_rows")
    + f"""SELECT property_id, kind, count(*) AS rows, count(DISTINCT day) AS days, count(DISTINCT landing_page) AS pages, count(DISTINCT country) AS countries,
    count(DISTINCT device) AS devices, count(*) FILTER (explicitly_mapped) AS mapped, count(*) FILTER (landing_page IS NULL) AS without_page, count(*) FILTER (temporal_grain = 'timestamp') AS timed,
    {", ".join(f"count({m}) AS known_{m}, sum({m}) AS {m}" for _, m in METRIC_NAMES)}, 0::BIGINT AS issues FROM review_rows GROUP BY property_id, kind""",
)
def a9(spark, sf):
    distinct = lambda n, to: F.countDistinct(n).alias(to)
    return _review_files(spark, sf).groupBy("property_id", "kind").agg(
        F.count("*").alias("rows"), distinct("day", "days"), distinct("landing_page", "pages"), distinct("country", "countries"),
        distinct("device", "devices"), F.count_if("explicitly_mapped").alias("mapped"),
        F.count_if(F.col("url_reason") == "blank_landing_page").alias("without_page"), F.count_if(F.col("temporal_grain") == "timestamp").alias("timed"),
        *[f for _, m in METRIC_NAMES for f in (F.count(m).alias(f"known_{m}"), F.sum(m).alias(m))], F.sum(F.size("issues")).cast("bigint").alias("issues"),
    )


@query("a10_review_files_quality", ROWS + f", {QUALITY_CTE} SELECT * FROM quality")
def a10(spark, sf):
    """Files of three sources, read by their own mappings, reach the review's quality counts."""
    return review.dataset_quality(review.label_periods(_review_files(spark, sf), BASELINE, CURRENT))


ISSUES = "issues AS (" + " UNION ALL ".join(
    [f"SELECT property_id, kind, 'blank_or_invalid_{d}' AS code, blank_{d} AS n FROM quality WHERE blank_{d} > 0" for d in ("day", "landing_page", "country", "device")]
    + [f"SELECT property_id, kind, 'blank_metric_{m}', blank_metric_{m} FROM quality WHERE blank_metric_{m} > 0" for k in review.KINDS for m in review.METRICS[k]]
    + ["SELECT property_id, kind, 'temporal_grain_unusable', 1 FROM quality WHERE temporal_grain IN ('mixed', 'unknown')"]
    + [f"SELECT property_id, kind, '{p}_window_empty', 1 FROM quality WHERE {p}_rows = 0" for p in review.PERIODS]
) + ")"


@query("e3_quality_issues", ROWS + f", {QUALITY_CTE}, {ISSUES} SELECT * FROM issues")
def e3(spark, sf):
    return review.quality_issues(review.dataset_quality(_labelled(spark, sf)))


def _bundle_sql(name: str, keys: str, source: str) -> str:
    """Long form: one row per key, kind and metric, from plain grouped sums."""
    long = " UNION ALL ".join(
        f"SELECT {keys}, '{k}' AS kind, '{m}' AS metric, kind AS row_kind, period, {m} AS v FROM {source}"
        for k in review.KINDS
        for m in review.METRICS[k]
    )
    parts = []
    for p in review.PERIODS:
        inside = f"row_kind = kind AND period = '{p}'"
        parts.append(
            f"count(*) FILTER ({inside}) AS {p}_rows, count(v) FILTER ({inside}) AS {p}_known, sum(v) FILTER ({inside}) AS {p}_total"
        )
    obs = ", ".join(
        f"{p}_rows, CASE WHEN {p}_rows > 0 AND {p}_known = {p}_rows THEN {p}_total END AS {p}_value, "
        f"CASE WHEN {p}_rows = 0 THEN 'no_rows' WHEN {p}_known = 0 THEN 'all_values_blank' WHEN {p}_known < {p}_rows THEN 'partial_values_blank' END AS {p}_reason"
        for p in review.PERIODS
    )
    base = f"{name}_sums AS (SELECT {keys}, kind, metric, {obs} FROM (SELECT {keys}, kind, metric, {', '.join(parts)} FROM ({long}) l WHERE period IN ('baseline', 'current') GROUP BY {keys}, kind, metric) s)"
    rates = []
    for k in review.KINDS:
        for rate, (num, den) in review.RATES[k].items():
            cols = ", ".join(
                f"n.{p}_rows, {q.r10(f'CASE WHEN n.{p}_value IS NOT NULL AND d.{p}_value <> 0 THEN n.{p}_value / d.{p}_value END')} AS {p}_value, "
                f"CASE WHEN n.{p}_value IS NULL THEN n.{p}_reason WHEN d.{p}_value IS NULL THEN d.{p}_reason WHEN d.{p}_value = 0 THEN 'zero_denominator' END AS {p}_reason"
                for p in review.PERIODS
            )
            on = " AND ".join(f"n.{c} = d.{c}" for c in keys.split(", "))
            rates.append(
                f"SELECT {', '.join('n.' + c for c in keys.split(', '))}, '{k}' AS kind, '{rate}' AS metric, {cols} FROM {name}_sums n JOIN {name}_sums d ON {on} "
                f"AND n.kind = '{k}' AND d.kind = '{k}' AND n.metric = '{num}' AND d.metric = '{den}'"
            )
    absent = """CASE WHEN baseline_value IS NULL OR current_value IS NULL THEN CASE WHEN baseline_rows = 0 THEN 'cohort_missing_in_baseline'
      WHEN current_rows = 0 THEN 'cohort_missing_in_current' WHEN baseline_value IS NULL THEN 'baseline_unavailable' ELSE 'current_unavailable' END END"""
    final = f"""{name} AS (SELECT *, {q.r10("current_value - baseline_value")} AS absolute, {absent} AS absolute_reason,
      CASE WHEN baseline_value <> 0 THEN {q.r10("(current_value - baseline_value) / baseline_value")} END AS relative,
      coalesce({absent}, CASE WHEN baseline_value = 0 THEN 'zero_denominator' END) AS relative_reason
      FROM (SELECT * FROM {name}_sums UNION ALL {" UNION ALL ".join(rates)}) x)"""
    return base + ", " + final


TOTALS = _bundle_sql("totals", "property_id", "labelled")
PAGES = _bundle_sql("pages_out", "property_id, landing_page", "paged")
PAGED = "paged AS (SELECT * FROM labelled WHERE landing_page IS NOT NULL)"
OBSERVED = "property_id, kind, metric, baseline_rows, current_rows, baseline_value, baseline_reason, current_value, current_reason"


def _totals(spark, sf):
    return review.metric_bundles(_labelled(spark, sf), ["property_id"])


BASE_METRICS = [m for k in review.KINDS for m in review.METRICS[k]]
RATE_METRICS = [m for k in review.KINDS for m in review.RATES[k]]
_IN = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"


@query("e4_strict_sums", ROWS + f", {TOTALS} SELECT {OBSERVED} FROM totals WHERE metric IN {_IN(BASE_METRICS)}")
def e4(spark, sf):
    return _totals(spark, sf).filter(F.col("metric").isin(*BASE_METRICS)).select(*OBSERVED.split(", "))


@query("e5_derived_rates", ROWS + f", {PAGED}, {PAGES} SELECT landing_page, {OBSERVED} FROM pages_out WHERE metric IN {_IN(RATE_METRICS)}")
def e5(spark, sf):
    pages = review.landing_page_cohorts(_labelled(spark, sf))
    return pages.filter(F.col("metric").isin(*RATE_METRICS)).select("landing_page", *OBSERVED.split(", "))


DELTA_COLS = "property_id, kind, metric, absolute, absolute_reason, relative, relative_reason"


@query("e6_deltas_with_reason", ROWS + f", {PAGED}, {PAGES} SELECT landing_page, {DELTA_COLS} FROM pages_out")
def e6(spark, sf):
    return review.landing_page_cohorts(_labelled(spark, sf)).select("landing_page", *DELTA_COLS.split(", "))


@query("e7_landing_page_cohorts", ROWS + f", {PAGED}, {PAGES} SELECT * FROM pages_out")
def e7(spark, sf):
    return review.landing_page_cohorts(_labelled(spark, sf))


ALIGNMENT = """alignment AS (SELECT property_id, mode, mode IN ('timestamp_normalized_daily_join', 'source_date_daily_join') AS daily_join_allowed,
  CASE WHEN mode = 'window_aggregate_only' THEN CASE WHEN gn = 1 AND g = 'date' THEN 'source_day_boundary_mismatch' ELSE 'temporal_grain_inconsistent' END END AS issue
  FROM (SELECT *, CASE WHEN n = 1 THEN 'single_source' WHEN gn = 1 AND g = 'timestamp' THEN 'timestamp_normalized_daily_join'
      WHEN gn = 1 AND g = 'date' AND zn = 1 AND znull = 0 THEN 'source_date_daily_join' ELSE 'window_aggregate_only' END AS mode FROM (
    SELECT property_id, count(*) AS n, count(DISTINCT temporal_grain) AS gn, min(temporal_grain) AS g, count(DISTINCT source_timezone) AS zn,
      count(*) FILTER (source_timezone IS NULL) AS znull FROM review_sources GROUP BY property_id) a) b)"""


@query("e8_cross_source_alignment", with_views("review_sources", extra=ALIGNMENT) + "SELECT * FROM alignment")
def e8(spark, sf):
    return review.cross_source_alignment(load_view(spark, sf, "review_sources"))


def _match(kind, grain):
    eq = " AND ".join(f"s.{g} = r.{g}" for g in ("property_id", "period", *grain))
    return f"EXISTS (SELECT 1 FROM labelled s WHERE s.kind = 'search' AND s.period IN ('baseline', 'current') AND {eq})"


COVERAGE = f"""flagged AS (SELECT r.*, CASE WHEN NOT full_grain THEN NULL
    WHEN kind = 'analytics' THEN {_match("analytics", review.GRAIN["analytics"])}
    WHEN kind = 'crm' THEN {_match("crm", review.GRAIN["crm"])} END AS hit
  FROM labelled r WHERE period IN ('baseline', 'current')),
 ref AS (SELECT property_id, period, count(*) FILTER (full_grain) AS ref_device,
   count(*) FILTER (day IS NOT NULL AND landing_page IS NOT NULL AND country IS NOT NULL) AS ref_country
   FROM labelled WHERE kind = 'search' GROUP BY ALL),
 coverage AS (SELECT property_id, kind, period, rows, eligible_rows,
   CASE WHEN kind = 'search' THEN eligible_rows WHEN daily_join_allowed THEN hits END::DOUBLE AS matched_rows,
   CASE WHEN kind = 'search' THEN 0 WHEN daily_join_allowed THEN eligible_rows - hits END::DOUBLE AS unmatched_rows,
   rows - eligible_rows AS incomplete_grain_rows, explicit_url_mapping_rows,
   {q.r10("CASE WHEN kind = 'search' THEN eligible_rows / rows WHEN reason IS NULL THEN hits / eligible_rows END")} AS matched_rate,
   reason AS matched_rate_reason, CASE WHEN kind <> 'search' AND daily_join_allowed THEN examples END AS unmatched_examples,
   CASE WHEN kind = 'search' THEN 'reference_source' WHEN NOT daily_join_allowed THEN mode END AS join_reason
  FROM (SELECT f.*, mode, daily_join_allowed, CASE WHEN kind = 'search' THEN NULL WHEN NOT daily_join_allowed THEN 'cross_source_daily_join_forbidden'
      WHEN eligible_rows = 0 THEN 'zero_denominator'
      WHEN coalesce(CASE kind WHEN 'crm' THEN ref_country ELSE ref_device END, 0) = 0 THEN 'no_reference_cohorts' END AS reason
    FROM (SELECT property_id, kind, period, count(*) AS rows, count(*) FILTER (full_grain) AS eligible_rows,
        count(*) FILTER (explicitly_mapped) AS explicit_url_mapping_rows, count(*) FILTER (hit) AS hits,
        list_slice(list_sort(list(DISTINCT landing_page) FILTER (NOT hit)), 1, 10) AS examples FROM flagged GROUP BY ALL) f
    JOIN alignment USING (property_id) LEFT JOIN ref USING (property_id, period)) g)"""
COVERAGE_COLS = [
    "property_id", "kind", "period", "rows", "eligible_rows", "matched_rows", "unmatched_rows", "incomplete_grain_rows",
    "explicit_url_mapping_rows", "matched_rate", "matched_rate_reason", "join_reason",
]
BOTH = with_views("review_rows", "review_sources", extra=f"{LABELLED}, {ALIGNMENT}, {COVERAGE}")


def _coverage(spark, sf):
    alignment = review.cross_source_alignment(load_view(spark, sf, "review_sources"))
    return review.mapping_coverage(_labelled(spark, sf), alignment)


@query(
    "e9_mapping_coverage",
    BOTH + f"SELECT {', '.join(COVERAGE_COLS)}, array_to_string(unmatched_examples, ',') AS unmatched_examples FROM coverage",
)
def e9(spark, sf):
    return _coverage(spark, sf).select(
        *COVERAGE_COLS, F.array_join("unmatched_examples", ",").alias("unmatched_examples")
    )


@query(
    "e9_unmatched_pages",
    BOTH
    + """SELECT property_id, kind, period, landing_page, count(*) AS miss_rows FROM flagged JOIN alignment USING (property_id)
    WHERE daily_join_allowed AND kind <> 'search' AND NOT hit GROUP BY ALL""",
)
def e9_pages(spark, sf):
    return review.unmatched_pages(_labelled(spark, sf), review.cross_source_alignment(load_view(spark, sf, "review_sources")))


CONTRACTS = f"""contracts AS (SELECT *, CASE WHEN len(late) > 0 THEN 'degraded' WHEN len(own) = 0 THEN 'complete'
    WHEN len(list_filter(own, lambda x: suffix(x, '_missing') OR suffix(x, '_unknown'))) > 0 THEN 'unknown' ELSE 'degraded' END AS status,
    list_concat(own, late) AS issues FROM (SELECT *, {issue_list(
        "CASE WHEN source_timezone IS NULL THEN 'source_timezone_missing' END",
        "CASE WHEN kind = 'search' AND coalesce(source_timezone, '') <> 'America/Los_Angeles' THEN 'gsc_source_timezone_nonstandard' END",
        *COLLECTION,
        "CASE WHEN kind = 'analytics' AND sampling_rate IS NULL THEN 'sampling_rate_missing' WHEN kind = 'analytics' AND sampling_rate < 1 THEN 'sampling_applied' END",
        "CASE WHEN kind = 'analytics' AND thresholding IS NULL THEN 'thresholding_status_missing' WHEN kind = 'analytics' AND thresholding THEN 'thresholding_applied' END",
        "CASE WHEN kind <> 'search' AND attribution_model IS NULL THEN 'attribution_model_missing' END",
        QUALITY,
    )} AS own, CASE WHEN {AS_OF.format("replace(data_as_of, 'Z', '')", "source_timezone")} < window_end
      THEN ['data_as_of_before_current_window_end'] ELSE [] END AS late FROM review_sources) a)"""


@query(
    "e10_review_source_contract",
    with_views("review_sources", extra=CONTRACTS) + "SELECT property_id, kind, array_to_string(issues, ',') AS issues, status FROM contracts",
)
def e10(spark, sf):
    out = review.review_source_contract(load_view(spark, sf, "review_sources"))
    return out.select("property_id", "kind", F.array_join("issues", ",").alias("issues"), "status")


@query(
    "e11_review_verdict",
    BOTH
    + f""", {CONTRACTS}, {QUALITY_CTE}, {ISSUES}, {TOTALS}, props AS (SELECT DISTINCT property_id FROM review_rows), reasons AS (
      SELECT property_id, 'contract:' || kind || ':' || unnest(issues) AS reason FROM contracts
      UNION SELECT property_id, 'time:' || issue FROM alignment WHERE issue IS NOT NULL
      UNION SELECT property_id, 'quality:' || kind || ':' || code FROM issues
      UNION SELECT property_id, 'no_data:' || kind || ':' || p FROM totals, (VALUES ('baseline'), ('current')) v(p)
        WHERE CASE p WHEN 'baseline' THEN baseline_rows ELSE current_rows END = 0 AND metric IN {_IN(BASE_METRICS)}
      UNION SELECT property_id, 'incomplete:' || kind || ':' || metric || ':' || p FROM totals, (VALUES ('baseline'), ('current')) v(p)
        WHERE CASE p WHEN 'baseline' THEN baseline_value ELSE current_value END IS NULL AND metric IN {_IN(BASE_METRICS)}
      UNION SELECT property_id, 'not_joined:' || kind || ':' || period || ':' || join_reason FROM coverage WHERE kind <> 'search' AND join_reason IS NOT NULL
      UNION SELECT property_id, 'no_match:' || kind || ':' || period FROM coverage WHERE kind <> 'search' AND join_reason IS NULL AND matched_rows = 0)
    SELECT property_id, coalesce(string_agg(reason, ';' ORDER BY reason), '') AS reasons,
      CASE WHEN count(reason) > 0 THEN 'inconclusive' ELSE 'directional' END AS verdict
    FROM props LEFT JOIN reasons USING (property_id) GROUP BY property_id""",
)
def e11(spark, sf):
    labelled = cut_lineage(_labelled(spark, sf), "review-rows")  # read by five aggregations below
    sources = load_view(spark, sf, "review_sources")
    alignment = review.cross_source_alignment(sources)
    out = review.verdicts(
        review.review_source_contract(sources),
        alignment,
        review.quality_issues(review.dataset_quality(labelled)),
        review.metric_bundles(labelled, ["property_id"]),
        review.mapping_coverage(labelled, alignment),
        labelled.select("property_id").distinct(),
        equal_windows=True,
    )
    return out.withColumn("reasons", F.array_join("reasons", ";"))


@query("e12_window_totals", ROWS + f", {TOTALS} SELECT * FROM totals")
def e12(spark, sf):
    return _totals(spark, sf)
