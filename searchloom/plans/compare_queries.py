"""Search-performance and AI-surface window comparisons."""

from pyspark.sql import functions as F

from searchloom.operators import compare
from searchloom.operators.compare import DateWindow
from searchloom.plans import sqltext as q
from searchloom.plans.registry import query
from searchloom.plans.tables import load_view, with_views

BASELINE = DateWindow("1997-01-01", "1997-12-31")
CURRENT = DateWindow("1998-01-01", "1998-12-31")
TOP = 10

IN_B = "day BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'"
IN_C = "day BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'"
LABELLED = f"""labelled AS (SELECT *, CASE WHEN {IN_B} THEN 'baseline' ELSE 'current' END AS period
  FROM search_daily WHERE {IN_B} OR {IN_C})"""
AI_LABELLED = LABELLED.replace("search_daily", "ai_rows")


def _sums(w: str) -> str:
    inside = f"period = '{w}'"
    ranked = f"{inside} AND position IS NOT NULL AND impressions > 0"
    return f"""coalesce(sum(clicks) FILTER ({inside}), 0) AS {w}_clicks,
      coalesce(sum(impressions) FILTER ({inside}), 0) AS {w}_impressions,
      sum(clicks) FILTER ({inside}) / nullif(sum(impressions) FILTER ({inside}), 0) AS {w}_ctr0,
      sum(position * impressions) FILTER ({ranked}) / nullif(sum(impressions) FILTER ({ranked}), 0) AS {w}_position0,
      count(*) FILTER ({inside}) AS {w}_rows, count(*) FILTER ({ranked}) AS {w}_position_rows,
      coalesce(sum(impressions) FILTER ({ranked}), 0) AS {w}_position_impressions"""


SUMS = _sums("baseline") + ", " + _sums("current")


def _final(w: str) -> str:
    return f"""{w}_clicks, {w}_impressions, {q.r10(f"{w}_ctr0")} AS {w}_ctr, {q.r10(f"{w}_position0")} AS {w}_position,
      {w}_rows, {w}_position_rows, {w}_position_impressions"""


FINAL = _final("baseline") + ", " + _final("current")
DELTAS = f"""current_clicks - baseline_clicks AS delta_clicks,
  CASE WHEN baseline_clicks <> 0 THEN {q.r10("(current_clicks - baseline_clicks) / baseline_clicks")} END AS relative_clicks,
  current_impressions - baseline_impressions AS delta_impressions,
  CASE WHEN baseline_impressions <> 0 THEN
    {q.r10("(current_impressions - baseline_impressions) / baseline_impressions")} END AS relative_impressions,
  {q.r10(q.r10("current_ctr - baseline_ctr") + " * 100")} AS delta_ctr_points,
  {q.r10("current_position - baseline_position")} AS delta_position"""
COHORTS = "cohorts AS (SELECT property_id, dimension, value, " + FINAL + " FROM (" + " UNION ALL ".join(
    f"SELECT property_id, '{d}' AS dimension, trim({d}) AS value, {SUMS} FROM labelled WHERE trim({d}) <> '' GROUP BY ALL"
    for d in compare.DIMENSIONS
) + ") u)"


def _search(spark, sf):
    return load_view(spark, sf, "search_daily")


def _labelled(spark, sf):
    return compare.label_windows(_search(spark, sf), BASELINE, CURRENT)


def _ai_labelled(spark, sf):
    return compare.label_windows(load_view(spark, sf, "ai_rows"), BASELINE, CURRENT)


@query(
    "c1_window_selection",
    with_views("search_daily")
    + " UNION ALL ".join(
        f"""SELECT property_id, '{n}' AS period, count(*) FILTER ({c}) AS rows, (min(day) FILTER ({c}))::STRING AS first_day,
        (max(day) FILTER ({c}))::STRING AS last_day, CASE WHEN count(*) FILTER ({c}) = 0 THEN 'window_empty' ELSE 'ok' END AS status
        FROM search_daily GROUP BY property_id"""
        for n, c in (("baseline", IN_B), ("current", IN_C))
    ),
)
def c1(spark, sf):
    out = compare.window_selection(_search(spark, sf), BASELINE, CURRENT)
    return out.withColumns({c: F.col(c).cast("string") for c in ("first_day", "last_day")})


DECLARED = """declared AS (SELECT DISTINCT property_id, 'baseline' AS period,
    CASE property_id WHEN 'property-0' THEN NULL ELSE DATE '1997-01-01' END AS "start",
    CASE property_id WHEN 'property-0' THEN NULL WHEN 'property-1' THEN NULL WHEN 'property-2' THEN DATE '1997-06-30' ELSE DATE '1997-12-31' END AS "end" FROM search_daily
  UNION ALL SELECT DISTINCT property_id, 'current',
    CASE property_id WHEN 'property-3' THEN NULL ELSE DATE '1998-01-01' END,
    CASE property_id WHEN 'property-3' THEN NULL ELSE DATE '1998-12-31' END FROM search_daily)"""


def _declared(rows):
    """Windows the caller declares, one row per property and side, as a small table beside the data."""
    pid = F.col("property_id")
    day = lambda s: F.lit(s).cast("date")
    none = F.lit(None).cast("date")
    base = F.struct(
        F.lit("baseline").alias("period"),
        F.when(pid != "property-0", day("1997-01-01")).alias("start"),
        F.when(pid.isin("property-0", "property-1"), none)
        .when(pid == "property-2", day("1997-06-30"))
        .otherwise(day("1997-12-31"))
        .alias("end"),
    )
    cur = F.struct(
        F.lit("current").alias("period"),
        F.when(pid != "property-3", day("1998-01-01")).alias("start"),
        F.when(pid != "property-3", day("1998-12-31")).alias("end"),
    )
    return rows.select("property_id").distinct().select("property_id", F.inline(F.array(base, cur)))


@query(
    "c2_window_bounds",
    with_views("search_daily", extra=LABELLED)
    + f""", {DECLARED}, b AS (SELECT property_id, period, coalesce("start", min(day)) AS eff_start,
      coalesce("end", max(day)) AS eff_end, CASE WHEN "start" IS NOT NULL THEN 'declared' ELSE 'observed' END AS boundary_source,
      count(*) FILTER (NOT day BETWEEN "start" AND "end") AS rows_outside,
      CASE WHEN ("start" IS NULL) <> ("end" IS NULL) THEN 'half_declared' WHEN "start" > "end" THEN 'start_after_end'
        WHEN count(*) FILTER (NOT day BETWEEN "start" AND "end") > 0 THEN 'rows_outside_declared' END AS issue
      FROM labelled LEFT JOIN declared USING (property_id, period) GROUP BY property_id, period, "start", "end")
    SELECT b.property_id, b.eff_start::STRING AS baseline_eff_start, b.eff_end::STRING AS baseline_eff_end,
      b.boundary_source AS baseline_boundary_source, b.rows_outside AS baseline_rows_outside, b.issue AS baseline_issue,
      c.eff_start::STRING AS current_eff_start, c.eff_end::STRING AS current_eff_end, c.boundary_source AS current_boundary_source,
      c.rows_outside AS current_rows_outside, c.issue AS current_issue,
      CASE WHEN b.eff_end >= c.eff_start THEN 'windows_not_disjoint' END AS order_issue
    FROM b JOIN b c USING (property_id) WHERE b.period = 'baseline' AND c.period = 'current'""",
)
def c2(spark, sf):
    labelled = _labelled(spark, sf)
    out = compare.window_bounds(labelled, _declared(_search(spark, sf)))
    days = [c for c, t in out.dtypes if t == "date"]
    return out.withColumns({c: F.col(c).cast("string") for c in days})


@query(
    "c3_overall_metrics",
    with_views("search_daily", extra=LABELLED) + f"SELECT property_id, {FINAL} FROM (SELECT property_id, {SUMS} FROM labelled GROUP BY ALL) s",
)
def c3(spark, sf):
    return compare.overall_metrics(_labelled(spark, sf))


@query(
    "c4_dimension_metrics",
    with_views("search_daily", extra=LABELLED) + f", {COHORTS} SELECT property_id, dimension, value, current_clicks, current_impressions, current_ctr, "
    "current_position, current_rows FROM cohorts WHERE current_rows > 0",
)
def c4(spark, sf):
    out = compare.cohort_metrics(_labelled(spark, sf)).filter("current_rows > 0")
    keys = ["property_id", "dimension", "value"]
    return out.select(*keys, *[f"current_{m}" for m in ("clicks", "impressions", "ctr", "position", "rows")])


@query(
    "c5_cohort_comparison",
    with_views("search_daily", extra=LABELLED) + f", {COHORTS} SELECT *, {DELTAS} FROM cohorts",
)
def c5(spark, sf):
    return compare.add_deltas(compare.cohort_metrics(_labelled(spark, sf)))


@query(
    "c6_top_cohorts",
    with_views("search_daily", extra=LABELLED)
    + f""", {COHORTS} SELECT property_id, dimension, value, current_impressions, baseline_impressions, rank, groups_total,
      least(groups_total, {TOP}) AS groups_returned FROM (SELECT *, row_number() OVER (PARTITION BY property_id, dimension
        ORDER BY current_impressions DESC, baseline_impressions DESC, value)::INT AS rank,
      count(*) OVER (PARTITION BY property_id, dimension) AS groups_total FROM cohorts) r WHERE rank <= {TOP}""",
)
def c6(spark, sf):
    out = compare.top_cohorts(compare.cohort_metrics(_labelled(spark, sf)), TOP)
    return out.select(
        "property_id", "dimension", "value", "current_impressions", "baseline_impressions",
        "rank", "groups_total", "groups_returned",
    )


@query(
    "c8_metric_deltas",
    with_views("search_daily", extra=LABELLED)
    + f", m AS (SELECT property_id, {FINAL} FROM (SELECT property_id, {SUMS} FROM labelled GROUP BY ALL) s) SELECT *, {DELTAS} FROM m",
)
def c8(spark, sf):
    return compare.add_deltas(compare.overall_metrics(_labelled(spark, sf)))


def _coverage_sql(n, c):
    dims = ", ".join(
        f"count(*) FILTER ({c} AND trim({d}) <> '') AS {d}_populated_rows, count(*) FILTER ({c} AND trim({d}) = '') AS {d}_blank_rows"
        for d in compare.DIMENSIONS
    )
    ranked = f"{c} AND position IS NOT NULL AND impressions > 0"
    return f"""SELECT property_id, '{n}' AS period, count(*) AS source_rows, count(*) FILTER ({c}) AS included_rows,
      count(*) FILTER (NOT {c}) AS excluded_rows, (min(day) FILTER ({c}))::STRING AS first_day, (max(day) FILTER ({c}))::STRING AS last_day,
      count(*) FILTER ({c} AND impressions = 0) AS zero_impression_rows, count(*) FILTER ({ranked}) AS position_rows,
      sum(impressions) FILTER ({ranked}) AS position_impressions,
      {q.r10(f"sum(impressions) FILTER ({ranked}) / sum(impressions) FILTER ({c})")} AS position_impression_coverage, {dims}
      FROM search_daily GROUP BY property_id"""


@query(
    "c9_coverage",
    with_views("search_daily") + _coverage_sql("baseline", f"({IN_B})") + " UNION ALL " + _coverage_sql("current", f"({IN_C})"),
)
def c9(spark, sf):
    return compare.coverage(_search(spark, sf), BASELINE, CURRENT)


PERIODS = f"""SELECT property_id, period, "start"::STRING AS requested_start, "end"::STRING AS requested_end,
  min(day)::STRING AS observed_start, max(day)::STRING AS observed_end, coalesce("start", min(day))::STRING AS effective_start,
  coalesce("end", max(day))::STRING AS effective_end,
  CASE WHEN "start" IS NOT NULL THEN 'declared' ELSE 'observed' END AS boundary_source,
  (coalesce("end", max(day)) - coalesce("start", min(day)) + 1)::DOUBLE AS calendar_days
  FROM labelled LEFT JOIN declared USING (property_id, period) GROUP BY property_id, period, "start", "end" """


def _periods(spark, sf):
    selection = compare.window_selection(_search(spark, sf), BASELINE, CURRENT)
    return compare.periods(selection, _declared(_search(spark, sf)))


@query("c10_periods", with_views("search_daily", extra=LABELLED) + f", {DECLARED} {PERIODS}")
def c10(spark, sf):
    return _periods(spark, sf)


def issue_list(*parts: str) -> str:
    return "list_filter([" + ", ".join(parts) + "], lambda x: x IS NOT NULL)"


COLLECTION = (
    "CASE WHEN data_as_of IS NULL THEN 'data_as_of_missing' END",
    "CASE WHEN finality = 'unknown' THEN 'finality_unknown' WHEN finality = 'preliminary' OR coalesce(preliminary, FALSE) THEN 'data_preliminary' END",
    "CASE WHEN preliminary IS NOT NULL AND preliminary <> (finality = 'preliminary') THEN 'finality_preliminary_inconsistent' END",
    "CASE WHEN row_limit_hit IS NULL THEN 'row_limit_status_missing' WHEN row_limit_hit THEN 'row_limit_hit' END",
    "CASE WHEN pagination_complete IS NULL THEN 'pagination_status_missing' WHEN NOT pagination_complete THEN 'pagination_incomplete' END",
)
QUALITY = "CASE declared_quality WHEN 'unknown' THEN 'data_quality_unknown' WHEN 'degraded' THEN 'data_quality_degraded' END"
STATUS = """CASE WHEN len(issues) = 0 THEN 'complete' WHEN len(list_filter(issues, lambda x: suffix(x, '_missing') OR suffix(x, '_unknown'))) > 0
  THEN 'unknown' ELSE 'degraded' END"""
CONTRACT = "contracts AS (SELECT *, " + STATUS + " AS status FROM (SELECT *, " + issue_list(
    "CASE WHEN embedded_timezone <> outside_timezone THEN 'source_timezone_inconsistent' END",
    "CASE WHEN source_kind <> 'gsc_search_analytics' THEN 'source_kind_inconsistent' END",
    "CASE WHEN source_timezone <> 'America/Los_Angeles' THEN 'gsc_source_timezone_nonstandard' END",
    *COLLECTION,
    QUALITY,
) + """ AS issues FROM (SELECT *, coalesce(embedded_timezone, outside_timezone, 'America/Los_Angeles') AS source_timezone
  FROM search_sources) a) b)"""


@query(
    "c11_source_contract",
    with_views("search_sources", extra=CONTRACT)
    + "SELECT property_id, source_id, source_timezone, array_to_string(issues, ',') AS issues, status FROM contracts",
)
def c11(spark, sf):
    out = compare.source_contract(load_view(spark, sf, "search_sources"))
    return out.select("property_id", "source_id", "source_timezone", F.array_join("issues", ",").alias("issues"), "status")


AS_OF = "((({0})::TIMESTAMP AT TIME ZONE 'UTC') AT TIME ZONE {1})::DATE"


@query(
    "c12_report_gate",
    with_views("search_sources", "properties", extra=CONTRACT)
    + f""", sided AS (SELECT property_id, source_id, source_timezone, list_transform(list_concat(issues,
        CASE WHEN {AS_OF.format("replace(data_as_of, 'Z', '')", "source_timezone")} <
          CASE source_id WHEN 'baseline' THEN DATE '1997-12-31' ELSE DATE '1998-12-31' END
        THEN ['data_as_of_before_window_end'] ELSE [] END), lambda x: source_id || ':' || x) AS own FROM contracts),
    gate AS (SELECT b.property_id, list_concat(list_concat(b.own, c.own), {issue_list(
        "CASE WHEN b.source_timezone <> c.source_timezone THEN 'baseline,current:source_timezone_mismatch' END",
        "CASE WHEN p.analysis_timezone IS NULL THEN 'analysis:analysis_timezone_missing' END",
        "CASE WHEN coalesce(p.property_label, '') = '' THEN 'analysis:property_id_missing' END",
        "CASE WHEN coalesce(p.search_type, '') = '' THEN 'analysis:search_type_missing' END",
        "CASE WHEN p.grain_overridden THEN 'baseline,current:grain_alignment_overridden' END",
    )}) AS issues FROM sided b JOIN sided c USING (property_id) JOIN properties p USING (property_id)
      WHERE b.source_id = 'baseline' AND c.source_id = 'current')
    SELECT property_id, array_to_string(issues, ';') AS issues, CASE WHEN len(issues) = 0 THEN 'complete' ELSE 'inconclusive' END AS status,
      CASE WHEN len(issues) = 0 THEN 'descriptive' ELSE 'inconclusive' END AS verdict FROM gate""",
)
def c12(spark, sf):
    ends = F.when(F.col("source_id") == "baseline", F.lit(BASELINE.end)).otherwise(F.lit(CURRENT.end)).cast("date")
    contracts = compare.source_contract(load_view(spark, sf, "search_sources"))
    gate = compare.report_gate(contracts, ends, load_view(spark, sf, "properties"))
    return gate.withColumn("issues", F.array_join("issues", ";"))


def _ai_sums(w):
    return f"""coalesce(sum(impressions) FILTER (period = '{w}'), 0) AS {w}_impressions, count(*) FILTER (period = '{w}') AS {w}_rows,
      count(*) FILTER (period = '{w}' AND impressions = 0) AS {w}_zero_impression_rows"""


AI_SUMS = _ai_sums("baseline") + ", " + _ai_sums("current")
AI_DELTA = f"""current_impressions - baseline_impressions AS impressions_absolute,
  CASE WHEN baseline_impressions > 0 THEN {q.r12("(current_impressions - baseline_impressions) / baseline_impressions")} END AS impressions_relative,
  CASE WHEN baseline_impressions <= 0 THEN 'baseline_impressions_zero' END AS relative_reason"""


@query("d1_ai_totals", with_views("ai_rows", extra=AI_LABELLED) + f"SELECT property_id, {AI_SUMS} FROM labelled GROUP BY ALL")
def d1(spark, sf):
    return compare.ai_totals(_ai_labelled(spark, sf))


@query(
    "d2_ai_page_deltas",
    with_views("ai_rows", extra=AI_LABELLED)
    + f"SELECT *, {AI_DELTA} FROM (SELECT property_id, page, country, {AI_SUMS} FROM labelled GROUP BY ALL) t",
)
def d2(spark, sf):
    return compare.ai_deltas(compare.ai_totals(_ai_labelled(spark, sf), ["property_id", "page", "country"]))


AI_COHORTS = "cohorts AS (" + " UNION ALL ".join(
    f"SELECT property_id, '{d}' AS dimension, trim({d}) AS value, {AI_SUMS} FROM labelled WHERE trim({d}) <> '' GROUP BY ALL"
    for d in compare.AI_DIMENSIONS
) + ")"


@query(
    "d3_ai_cohorts",
    with_views("ai_rows", extra=AI_LABELLED)
    + f""", {AI_COHORTS} SELECT *, {AI_DELTA} FROM (SELECT *, row_number() OVER (PARTITION BY property_id, dimension
        ORDER BY current_impressions DESC, baseline_impressions DESC, value)::INT AS rank,
      count(*) OVER (PARTITION BY property_id, dimension) AS groups_total,
      least(count(*) OVER (PARTITION BY property_id, dimension), 20) AS groups_returned FROM cohorts) r WHERE rank <= 20""",
)
def d3(spark, sf):
    return compare.top_cohorts(compare.ai_cohorts(_ai_labelled(spark, sf)), 20)


@query(
    "d4_ai_source_agreement",
    with_views("ai_sources")
    + """SELECT comparison_id, b.property_id IS NOT DISTINCT FROM c.property_id AS same_property,
      b.filters IS NOT DISTINCT FROM c.filters AS same_filters,
      CASE WHEN b.property_id IS DISTINCT FROM c.property_id THEN 'property_mismatch'
        WHEN b.filters IS DISTINCT FROM c.filters THEN 'filters_mismatch' END AS refusal
    FROM ai_sources b JOIN ai_sources c USING (comparison_id) WHERE b.source_id = 'baseline' AND c.source_id = 'current'""",
)
def d4(spark, sf):
    rows = load_view(spark, sf, "ai_rows")
    compare.require_same_grain(rows.columns, rows.columns)
    return compare.ai_source_agreement(load_view(spark, sf, "ai_sources"))


@query(
    "d5_window_length_gate",
    with_views("search_daily", extra=LABELLED)
    + f""", {DECLARED}, p AS ({PERIODS}) SELECT property_id, baseline_days, current_days, issue,
      CASE issue WHEN 'window_length_mismatch' THEN 'limited' WHEN 'window_length_unknown' THEN 'unknown' END AS severity,
      CASE issue WHEN 'window_length_mismatch' THEN 'limited' WHEN 'window_length_unknown' THEN 'unknown' ELSE 'complete' END AS status
    FROM (SELECT property_id, max(calendar_days) FILTER (period = 'baseline') AS baseline_days,
      max(calendar_days) FILTER (period = 'current') AS current_days,
      CASE WHEN max(calendar_days) FILTER (period = 'baseline') IS NULL OR max(calendar_days) FILTER (period = 'current') IS NULL
        THEN 'window_length_unknown'
        WHEN max(calendar_days) FILTER (period = 'baseline') <> max(calendar_days) FILTER (period = 'current')
        THEN 'window_length_mismatch' END AS issue FROM p GROUP BY property_id) t""",
)
def d5(spark, sf):
    return compare.window_length_gate(_periods(spark, sf))


AI_ISSUES = issue_list(
    "CASE WHEN property_id IS NULL THEN 'unknown:property_missing' END",
    "CASE WHEN filters IS NULL THEN 'unknown:filters_missing' END",
    f"CASE WHEN data_as_of IS NULL THEN 'unknown:data_as_of_missing' WHEN {AS_OF.format('''replace(data_as_of, 'Z', '')''', '''('America/Los_Angeles')''')} < window_end THEN 'limited:data_as_of_before_window_end' END",
    "CASE WHEN finality = 'unknown' THEN 'unknown:finality_unknown' WHEN coalesce(preliminary, finality = 'preliminary') THEN 'limited:data_preliminary' END",
    "CASE completeness WHEN 'unknown' THEN 'unknown:completeness_unknown' WHEN 'incomplete' THEN 'limited:completeness_incomplete' END",
    "CASE WHEN row_limit_hit IS NULL THEN 'unknown:row_limit_status_unknown' WHEN row_limit_hit THEN 'limited:ui_row_limit_hit' END",
    "CASE WHEN source_rows >= 14 THEN 'limited:source_rows_at_or_above_ui_limit' END",
    "CASE WHEN placeholder_rows > 0 THEN 'unknown:ui_placeholders_normalized_to_zero' END",
)


@query(
    "d6_ai_source_contract",
    with_views("ai_sources")
    + f"""SELECT comparison_id, source_id, array_to_string(issues, ';') AS issues,
      CASE WHEN len(list_filter(issues, lambda x: starts_with(x, 'limited:'))) > 0 THEN 'limited' WHEN len(issues) > 0 THEN 'unknown' ELSE 'complete' END AS status
    FROM (SELECT *, {AI_ISSUES} AS issues FROM ai_sources) t""",
)
def d6(spark, sf):
    out = compare.ai_source_contract(load_view(spark, sf, "ai_sources"), row_limit=14)
    return out.select("comparison_id", "source_id", F.array_join("issues", ";").alias("issues"), "status")


def _ai_cov(n, c):
    dims = ", ".join(
        f"count(*) FILTER ({c} AND trim({d}) <> '') AS {d}_populated_rows, count(*) FILTER ({c} AND trim({d}) = '') AS {d}_blank_rows"
        for d in compare.AI_DIMENSIONS
    )
    return f"""SELECT property_id, '{n}' AS period, count(*) AS source_rows, count(*) FILTER ({c}) AS included_rows,
      count(*) FILTER (NOT {c}) AS excluded_rows, (min(day) FILTER ({c}))::STRING AS first_day, (max(day) FILTER ({c}))::STRING AS last_day,
      count(*) FILTER ({c} AND impressions = 0) AS zero_impression_rows, {dims} FROM ai_rows GROUP BY property_id"""


@query(
    "d7_ai_coverage",
    with_views("ai_rows") + _ai_cov("baseline", f"({IN_B})") + " UNION ALL " + _ai_cov("current", f"({IN_C})"),
)
def d7(spark, sf):
    rows = load_view(spark, sf, "ai_rows").withColumn("position", F.lit(None).cast("double"))
    out = compare.coverage(rows, BASELINE, CURRENT, compare.AI_DIMENSIONS)
    return out.drop("position_rows", "position_impressions", "position_impression_coverage")
