"""Page experiments over the event panel, and specification checks over one draft per customer."""

from statistics import NormalDist

from pyspark.sql import functions as F

from searchloom.operators import experiment as ex
from searchloom.operators import replay
from searchloom.plans import sqltext as q
from searchloom.plans.compare_queries import COLLECTION, QUALITY, issue_list
from searchloom.plans.registry import query
from searchloom.plans.tables import load_view, with_views
from searchloom.session import cut_lineage, scratch_path
from searchloom.sources import experiment_files

METRICS = ("clicks", "views", "errors")
SPECS = ("exp_specs",)


def _specs(spark, sf):
    return load_view(spark, sf, "exp_specs")


def _units(spark, sf):
    return ex.baseline_units(load_view(spark, sf, "baseline_rows"), _specs(spark, sf), METRICS)


def _assigned(spark, sf):
    return ex.assign_units(_units(spark, sf), _specs(spark, sf))


def _panel(spark, sf):
    return ex.typed_panel(load_view(spark, sf, "panel_rows"), _assigned(spark, sf), METRICS)


UNITS = f"""units AS (SELECT *, CASE WHEN outside_rows > 0 THEN 'date_outside_baseline' WHEN source_rows > days THEN 'duplicate_unit_date'
    WHEN days < expected_days THEN 'missing_baseline_dates' WHEN pairs > 1 THEN 'unit_in_several_pairs' END AS issue FROM (
  SELECT b.experiment_id, unit_id, (baseline_end - baseline_start + 1)::INT AS expected_days,
    {", ".join(f"{q.r12(f'avg({m}) FILTER (day BETWEEN baseline_start AND baseline_end)')} AS {m}" for m in METRICS)},
    count(*) FILTER (day BETWEEN baseline_start AND baseline_end) AS source_rows,
    count(*) FILTER (NOT day BETWEEN baseline_start AND baseline_end) AS outside_rows,
    count(DISTINCT day) FILTER (day BETWEEN baseline_start AND baseline_end) AS days, max(pair_id) AS pair_id, count(DISTINCT pair_id) AS pairs
  FROM baseline_rows b JOIN exp_specs USING (experiment_id) GROUP BY b.experiment_id, unit_id, baseline_start, baseline_end) u)"""
ASSIGN = """assigned AS (SELECT experiment_id, unit_id, NULL AS pair_id,
    CASE WHEN r <= greatest(1, least(n - 1, round_even(n * treatment_fraction, 0)::BIGINT)) THEN 'treatment' ELSE 'control' END AS "group"
  FROM (SELECT experiment_id, unit_id, treatment_fraction, row_number() OVER (PARTITION BY experiment_id ORDER BY sha256(seed || ':' || unit_id), unit_id) AS r,
      count(*) OVER (PARTITION BY experiment_id) AS n FROM units JOIN exp_specs USING (experiment_id) WHERE design = 'randomized_page_holdout') a
  UNION ALL
  SELECT experiment_id, unit_id, pair_id, CASE WHEN row_number() OVER (PARTITION BY experiment_id, pair_id
    ORDER BY sha256(seed || ':' || pair_id || ':' || unit_id)) = 1 THEN 'treatment' ELSE 'control' END
  FROM units JOIN exp_specs USING (experiment_id) WHERE design = 'matched_page_did')"""
BASE = with_views("baseline_rows", "exp_specs", extra=f"{UNITS}, {ASSIGN}")


@query(
    "a17_baseline_units",
    with_views("baseline_rows", "exp_specs", extra=UNITS)
    + "SELECT experiment_id, unit_id, expected_days, clicks, views, errors, source_rows, outside_rows, days, issue FROM units",
)
def a17(spark, sf):
    return _units(spark, sf).drop("pair_id", "pairs")


def _written(rows, name):
    path = scratch_path(rows.sparkSession, name)
    rows.write.partitionBy("experiment").option("header", True).option("escape", '"').csv(path)
    return path


@query(
    "a17_read_baseline_csv",
    with_views("baseline_rows", "exp_specs", extra=UNITS)
    + "SELECT experiment_id, unit_id, pair_id, pairs, expected_days, clicks, views, errors, source_rows, outside_rows, days, issue FROM units",
)
def a17_files(spark, sf):
    """Baseline files, one folder an experiment, read to the units that assignment takes."""
    rows = load_view(spark, sf, "baseline_rows")
    texts = [F.col(m).cast("string").alias(m) for m in METRICS]
    path = _written(rows.select("pair_id", F.col("day").alias("date"), *texts, F.col("unit_id").alias("page"), F.col("experiment_id").alias("experiment")), "baseline")
    read = experiment_files.read_baseline_csv(spark, path, METRICS, "page", matched=True, experiment_from_path="experiment=([^/]+)/")
    return ex.baseline_units(read.where(F.size("issues") == 0), _specs(spark, sf), METRICS)


@query(
    "f1_spec_issues",
    with_views("draft_specs")
    + f"""SELECT experiment_id, array_to_string({issue_list(
        "CASE WHEN trim(experiment_id) = '' THEN 'experiment_id_blank' END",
        "CASE WHEN design NOT IN ('randomized_page_holdout', 'matched_page_did') THEN 'design_unsupported' END",
        "CASE WHEN direction NOT IN ('increase', 'decrease') THEN 'direction_invalid' END",
        "CASE WHEN trim(seed) = '' THEN 'seed_blank' END",
        "CASE WHEN NOT (treatment_fraction > 0 AND treatment_fraction < 1) THEN 'treatment_fraction_out_of_range' END",
        "CASE WHEN design = 'matched_page_did' AND treatment_fraction <> 0.5 THEN 'matched_design_needs_half' END",
        "CASE WHEN baseline_start > baseline_end THEN 'baseline_window_reversed' END",
        "CASE WHEN observation_start > observation_end THEN 'observation_window_reversed' END",
        "CASE WHEN baseline_end >= observation_start THEN 'windows_overlap' END",
        "CASE WHEN coalesce(mde_value, 0) <= 0 THEN 'mde_not_positive' END",
        "CASE WHEN mde_scale NOT IN ('absolute', 'relative_to_control_baseline') THEN 'mde_scale_invalid' END",
        "CASE WHEN NOT (alpha > 0 AND alpha < 1) THEN 'alpha_out_of_range' END",
        "CASE WHEN paid_role NOT IN ('language_research', 'search_term_research', 'landing_page_experiment', 'none') THEN 'paid_role_invalid' END",
        "CASE WHEN rail_1 = 'clicks' THEN 'guardrail_is_primary' END",
        "CASE WHEN rail_1 = rail_2 THEN 'guardrail_repeated' END",
        "CASE WHEN rail_direction = 'flat' THEN 'guardrail_direction_invalid' END",
        "CASE WHEN rail_threshold < 0 THEN 'guardrail_threshold_negative' END",
    )}, ',') AS issues FROM draft_specs""",
)
def f1(spark, sf):
    rail = lambda m: F.struct(
        F.col(m).alias("metric"), F.col("rail_direction").alias("direction"), F.col("rail_threshold").alias("threshold")
    )
    drafts = load_view(spark, sf, "draft_specs").withColumn("guardrails", F.array(rail("rail_1"), rail("rail_2")))
    return ex.spec_issues(drafts).withColumn("issues", F.array_join("issues", ","))


@query(
    "f2_unit_set_checks",
    with_views("baseline_rows", "exp_specs", extra=UNITS)
    + """SELECT experiment_id, units, pairs, broken_pairs, design, CASE WHEN units < 2 THEN 'fewer_than_two_units'
        WHEN design = 'matched_page_did' AND broken_pairs > 0 THEN 'pair_without_two_units'
        WHEN design = 'matched_page_did' AND pairs < 2 THEN 'fewer_than_two_pairs' END AS issue
      FROM (SELECT experiment_id, sum(m)::BIGINT AS units, count(*) AS pairs, count(*) FILTER (m <> 2) AS broken_pairs FROM (
        SELECT experiment_id, pair_id, count(*) AS m FROM units GROUP BY ALL) a GROUP BY experiment_id) b JOIN exp_specs USING (experiment_id)""",
)
def f2(spark, sf):
    out = ex.unit_set_checks(_units(spark, sf), _specs(spark, sf))
    return out.select("experiment_id", "units", "pairs", "broken_pairs", "design", "issue")


@query("f3_randomized_assignment", BASE + """SELECT experiment_id, unit_id, "group" FROM assigned WHERE pair_id IS NULL""")
def f3(spark, sf):
    return ex.assign_randomized(_units(spark, sf), _specs(spark, sf)).drop("pair_id")


@query("f4_matched_assignment", BASE + "SELECT * FROM assigned WHERE pair_id IS NOT NULL")
def f4(spark, sf):
    return ex.assign_matched(_units(spark, sf), _specs(spark, sf))


LONG = "(" + " UNION ALL ".join(f"SELECT experiment_id, unit_id, '{m}' AS metric, {m} AS value FROM units" for m in METRICS) + ")"


@query(
    "f5_balance",
    BASE
    + f"""SELECT experiment_id, metric, tn AS treatment_units, cn AS control_units, {q.r12("tm")} AS treatment_mean, {q.r12("cm")} AS control_mean,
      {q.r12("tm - cm")} AS absolute_difference, CASE WHEN pv > 0 THEN {q.r12("(tm - cm) / sqrt(pv)")} END AS standardized_difference
    FROM (SELECT *, coalesce((tv + cv) / 2, tv, cv) AS pv FROM (SELECT experiment_id, metric, count(*) FILTER ("group" = 'treatment') AS tn,
        count(*) FILTER ("group" = 'control') AS cn, avg(value) FILTER ("group" = 'treatment') AS tm, avg(value) FILTER ("group" = 'control') AS cm,
        var_samp(value) FILTER ("group" = 'treatment') AS tv, var_samp(value) FILTER ("group" = 'control') AS cv
      FROM {LONG} l JOIN (SELECT experiment_id, unit_id, "group" FROM assigned) a USING (experiment_id, unit_id) GROUP BY ALL) s) t""",
)
def f5(spark, sf):
    units = _units(spark, sf)
    return ex.balance(units, ex.assign_units(units, _specs(spark, sf)), METRICS)


def _tree(name: str, source: str, row: str) -> str:
    return f"""SELECT experiment_id, sha256(string_agg(d, '' ORDER BY b)) AS {name} FROM (
      SELECT experiment_id, substr(sha256(unit_id), 1, 3) AS b, sha256(string_agg(sha256({row}), '' ORDER BY unit_id)) AS d FROM {source} GROUP BY ALL) x GROUP BY experiment_id"""


@query(
    "f6_frozen_digests",
    BASE
    + f""", u AS ({_tree("units_digest", "units", "unit_id || '|' || " + " || '|' || ".join(f"round({m} * 1e6)::BIGINT" for m in METRICS))}),
      a AS ({_tree("assignments_digest", "assigned", '''unit_id || '|' || "group"''')})
    SELECT experiment_id, units_digest, assignments_digest, sha256(experiment_id || units_digest || assignments_digest) AS plan_digest
    FROM u JOIN a USING (experiment_id)""",
)
def f6(spark, sf):
    units = _units(spark, sf)
    return ex.frozen_digests(units, ex.assign_units(units, _specs(spark, sf)), METRICS)


def _num(m):
    return f"try_cast(replace({m}, ',', '') AS DOUBLE)"


PANEL = f"""parsed AS (SELECT row_id, experiment_id, trim(unit_id) AS unit_id, day, CASE lower(trim(group_text)) WHEN 'treatment' THEN 'treatment'
    WHEN 'treated' THEN 'treatment' WHEN 'test' THEN 'treatment' WHEN 'control' THEN 'control' WHEN 'holdout' THEN 'control' WHEN '对照组' THEN 'control' END AS "group",
    {", ".join(f"{_num(m)} AS {m}" for m in METRICS)}, CASE lower(contaminated_text) WHEN 'yes' THEN TRUE WHEN 'no' THEN FALSE END AS contaminated,
    CASE applied_text WHEN 'true' THEN TRUE WHEN '0' THEN FALSE END AS applied FROM panel_rows),
  numbered AS (SELECT *, unit_id <> '' AND "group" IS NOT NULL AS readable, row_number() OVER (PARTITION BY experiment_id, unit_id, day,
    unit_id <> '' AND "group" IS NOT NULL ORDER BY row_id) AS k FROM parsed),
  panel AS (SELECT n.row_id, n.experiment_id, n.unit_id, n.day, n."group", a."group" AS assigned, n.clicks, n.views, n.errors, contaminated, applied,
    readable, readable AND k = 1 AS usable, CASE WHEN n.unit_id = '' THEN ['missing_unit_id'] WHEN NOT readable THEN ['invalid_dimension']
      WHEN k > 1 THEN ['duplicate_unit_date'] ELSE {issue_list(
        '''CASE WHEN a."group" IS NULL THEN 'unknown_unit' WHEN a."group" <> n."group" THEN 'assignment_mismatch' END''',
        *[f"CASE WHEN n.{m} IS NULL THEN 'missing_or_invalid_metric:{m}' END" for m in METRICS],
        "CASE WHEN contaminated IS NULL THEN 'invalid_contamination_flag' END",
        "CASE WHEN applied IS NULL THEN 'invalid_treatment_flag' END",
    )} END AS issues, s.baseline_start, s.baseline_end, s.observation_start, s.observation_end,
    CASE WHEN n.day BETWEEN s.baseline_start AND s.baseline_end THEN 'baseline' WHEN n.day BETWEEN s.observation_start AND s.observation_end THEN 'current' END AS period
   FROM numbered n LEFT JOIN assigned a ON n.experiment_id = a.experiment_id AND n.unit_id = a.unit_id JOIN exp_specs s ON s.experiment_id = n.experiment_id)"""
FULL = with_views("baseline_rows", "panel_rows", "exp_specs", "guardrails", extra=f"{UNITS}, {ASSIGN}, {PANEL}")


@query(
    "a18_typed_panel",
    FULL
    + """SELECT row_id, experiment_id, unit_id, day::STRING AS day, "group", clicks, views, errors, contaminated, applied, usable FROM panel""",
)
def a18(spark, sf):
    return _panel(spark, sf).select(
        "row_id", "experiment_id", "unit_id", F.col("day").cast("string").alias("day"), "group", *METRICS,
        "contaminated", "applied", "usable",
    )


@query(
    "a18_read_panel_csv",
    FULL
    + """SELECT row_id, experiment_id, unit_id, day::STRING AS day, "group", clicks, views, errors, contaminated, applied, usable, array_to_string(issues, ',') AS issues FROM panel""",
)
def a18_files(spark, sf):
    """Panel files, one folder an experiment, read to typed unit-days."""
    rows = load_view(spark, sf, "panel_rows")
    path = _written(
        rows.select(
            "row_id", F.col("unit_id").alias("page"), F.col("group_text").alias("group"), F.col("day").alias("date"), *METRICS,
            F.col("contaminated_text").alias("contaminated"), F.col("applied_text").alias("treatment_applied"), F.col("experiment_id").alias("experiment"),
        ),
        "panel",
    )
    read = experiment_files.read_panel_csv(spark, path, METRICS, "page", experiment_from_path="experiment=([^/]+)/", row_column="row_id")
    return ex.typed_panel(read, _assigned(spark, sf), METRICS).select(
        "row_id", "experiment_id", "unit_id", F.col("day").cast("string").alias("day"), "group", *METRICS,
        "contaminated", "applied", "usable", F.array_join("issues", ",").alias("issues"),
    )


@query(
    "f7_panel_issues",
    FULL + "SELECT row_id, experiment_id, unit_id, unnest(issues) AS code FROM panel",
)
def f7(spark, sf):
    return _panel(spark, sf).select("row_id", "experiment_id", "unit_id", F.explode("issues").alias("code"))


@query(
    "f8_units_in_two_groups",
    FULL + """SELECT experiment_id, unit_id, count(DISTINCT "group") AS groups FROM panel WHERE readable GROUP BY ALL HAVING count(DISTINCT "group") > 1""",
)
def f8(spark, sf):
    return ex.units_in_two_groups(_panel(spark, sf))


COMPLETE = """days AS (SELECT experiment_id, unit_id, p.period, d::DATE AS day FROM assigned JOIN exp_specs USING (experiment_id),
    LATERAL (SELECT 'baseline' AS period, unnest(generate_series(baseline_start::TIMESTAMP, baseline_end::TIMESTAMP, INTERVAL 1 DAY)) AS d
      UNION ALL SELECT 'current', unnest(generate_series(observation_start::TIMESTAMP, observation_end::TIMESTAMP, INTERVAL 1 DAY))) p),
  complete AS (SELECT d.experiment_id, d.unit_id, d.period, count(*)::INT AS expected_days, count(p.day)::INT AS observed_days,
    (count(*) - count(p.day))::INT AS missing_count, coalesce(array_to_string(list_slice(list_sort(list(d.day::STRING) FILTER (p.day IS NULL)), 1, 5), ','), '') AS missing_examples
    FROM days d LEFT JOIN panel p ON p.usable AND p.experiment_id = d.experiment_id AND p.unit_id = d.unit_id AND p.day = d.day GROUP BY ALL)"""


@query("f9_panel_completeness", FULL + f", {COMPLETE} SELECT * FROM complete")
def f9(spark, sf):
    assigned = _assigned(spark, sf)
    panel = ex.typed_panel(load_view(spark, sf, "panel_rows"), assigned, METRICS)
    out = ex.panel_completeness(panel, assigned, _specs(spark, sf))
    days = F.transform("missing_examples", lambda d: d.cast("string"))
    return out.withColumn("missing_examples", F.array_join(days, ","))


@query(
    "f9_panel_gaps",
    FULL
    + f""", {COMPLETE} SELECT d.experiment_id, d.unit_id, d.period, d.day::STRING AS day FROM days d
    WHERE NOT EXISTS (SELECT 1 FROM panel p WHERE p.usable AND p.experiment_id = d.experiment_id AND p.unit_id = d.unit_id AND p.day = d.day)""",
)
def f9_gaps(spark, sf):
    assigned = _assigned(spark, sf)
    panel = ex.typed_panel(load_view(spark, sf, "panel_rows"), assigned, METRICS)
    return ex.panel_gaps(panel, assigned, _specs(spark, sf)).withColumn("day", F.col("day").cast("string"))


ADHERENCE = """adherence AS (SELECT row_id, experiment_id, unit_id, unnest(list_filter([CASE WHEN period IS NULL THEN 'outside_preregistered_windows' END,
    CASE WHEN period IS NOT NULL AND contaminated THEN 'contamination_detected' END,
    CASE WHEN period IS NOT NULL AND applied <> (period = 'current' AND coalesce(assigned = 'treatment', FALSE)) THEN 'treatment_contamination' END],
    lambda x: x IS NOT NULL)) AS code FROM panel WHERE usable)"""


@query("f10_adherence_issues", FULL + f", {ADHERENCE} SELECT * FROM adherence")
def f10(spark, sf):
    return ex.adherence_issues(_panel(spark, sf), _specs(spark, sf))


FROZEN = f"""frozen AS (SELECT l.experiment_id, l.unit_id, l.metric, {q.r12("l.value")} AS expected, {q.r12("o.observed")} AS observed FROM {LONG} l
  JOIN (SELECT experiment_id, unit_id, metric, avg(v) AS observed FROM (""" + " UNION ALL ".join(
    f"SELECT experiment_id, unit_id, '{m}' AS metric, {m} AS v FROM panel WHERE usable AND assigned IS NOT NULL AND period = 'baseline'" for m in METRICS
) + """) x GROUP BY ALL) o USING (experiment_id, unit_id, metric) WHERE abs(l.value - o.observed) > greatest(1e-9 * greatest(abs(l.value), abs(o.observed)), 1e-12))"""


@query("f11_frozen_baseline", FULL + f", {FROZEN} SELECT * FROM frozen")
def f11(spark, sf):
    return ex.frozen_baseline_issues(_panel(spark, sf), _specs(spark, sf), _units(spark, sf), METRICS)


MATURITY = """maturity AS (SELECT experiment_id, list_filter([CASE WHEN analysis_as_of <= observation_end THEN 'observation_not_mature' END,
    CASE WHEN CASE WHEN length(data_as_of) = 10 THEN data_as_of::DATE < observation_end
      ELSE timezone(source_timezone, timezone('UTC', replace(data_as_of, 'Z', '')::TIMESTAMP)) < (observation_end + INTERVAL 1 DAY)::TIMESTAMP END THEN 'data_as_of_before_observation_end' END,
    CASE WHEN CASE WHEN length(data_as_of) = 10 THEN data_as_of::DATE >= timezone(source_timezone, timezone('UTC', now_utc::TIMESTAMP))::DATE
      ELSE replace(data_as_of, 'Z', '')::TIMESTAMP > now_utc::TIMESTAMP END THEN 'data_as_of_in_future' END], lambda x: x IS NOT NULL) AS issues FROM exp_specs)"""


@query("f12_maturity", with_views("exp_specs", extra=MATURITY) + "SELECT experiment_id, array_to_string(issues, ',') AS issues FROM maturity")
def f12(spark, sf):
    return ex.maturity(_specs(spark, sf)).withColumn("issues", F.array_join("issues", ","))


Z05, Z10 = NormalDist().inv_cdf(0.975), NormalDist().inv_cdf(0.95)
CHANGES = "changes AS (SELECT *, after - before AS change FROM (" + " UNION ALL ".join(
    f"""SELECT p.experiment_id, p.unit_id, a.pair_id, a."group", '{m}' AS metric, avg({m}) FILTER (period = 'baseline') AS before,
    avg({m}) FILTER (period = 'current') AS after FROM panel p JOIN assigned a USING (experiment_id, unit_id) WHERE usable GROUP BY ALL"""
    for m in METRICS
) + ") x WHERE before IS NOT NULL AND after IS NOT NULL)"


def _arm(g, s):
    f = f"""FILTER ("group" = '{g}')"""
    return f"count(*) {f} AS {s}_units, avg(before) {f} AS {s}_before, avg(after) {f} AS {s}_after, var_samp(change) {f} AS {s}_var"


ESTIMATES = f"""raw_est AS (SELECT e.*, p.pair_var, p.pairs, design, mde_value, mde_scale, CASE alpha WHEN 0.1 THEN {Z10!r} ELSE {Z05!r} END AS z FROM (
    SELECT experiment_id, metric, {_arm("treatment", "t")}, {_arm("control", "c")} FROM changes GROUP BY ALL) e
  LEFT JOIN (SELECT experiment_id, metric, var_samp(d) AS pair_var, count(*) AS pairs FROM (SELECT experiment_id, metric, pair_id,
      max(change) FILTER ("group" = 'treatment') - max(change) FILTER ("group" = 'control') AS d FROM changes WHERE pair_id IS NOT NULL GROUP BY ALL) d
    WHERE d IS NOT NULL GROUP BY ALL) p USING (experiment_id, metric) JOIN exp_specs USING (experiment_id)),
 staged AS (SELECT *, {q.r12("t_after - t_before")} AS t_change, {q.r12("c_after - c_before")} AS c_change, {q.r12("c_before")} AS base,
   CASE WHEN design = 'matched_page_did' THEN CASE WHEN pairs >= 2 THEN sqrt(pair_var / pairs) END
     WHEN t_units >= 2 AND c_units >= 2 THEN sqrt(t_var / t_units + c_var / c_units) END AS se FROM raw_est),
 staged2 AS (SELECT *, t_change - c_change AS d0, z * se AS half0, CASE mde_scale WHEN 'absolute' THEN mde_value ELSE CASE WHEN base <> 0 THEN mde_value * abs(base) END END AS mde0 FROM staged),
 estimates AS (SELECT experiment_id, metric, t_units, c_units, {q.r12("t_before")} AS treatment_baseline, {q.r12("t_after")} AS treatment_current, t_change AS treatment_change,
   base AS control_baseline, {q.r12("c_after")} AS control_current, c_change AS control_change, {q.r12("d0")} AS did,
   CASE WHEN base <> 0 THEN {q.r12("d0 / abs(base)")} END AS relative_did, {q.r12("se")} AS standard_error, {q.r12("d0 - half0")} AS ci_lower, {q.r12("d0 + half0")} AS ci_upper,
   {q.r12("half0")} AS half_width, CASE WHEN se IS NULL THEN 0 WHEN design = 'matched_page_did' THEN pairs ELSE t_units + c_units END::BIGINT AS inference_units,
   {q.r12("mde0")} AS mde_in_metric_units, coalesce(half0 <= mde0, FALSE) AS precision_sufficient FROM staged2)"""
EST = FULL + f", {CHANGES}, {ESTIMATES} "


def _estimates(spark, sf):
    assigned = _assigned(spark, sf)
    panel = ex.typed_panel(load_view(spark, sf, "panel_rows"), assigned, METRICS)
    specs = _specs(spark, sf)
    return ex.estimates(ex.unit_changes(panel, assigned, specs, METRICS), specs)


ARMS = "experiment_id, metric, t_units, c_units, treatment_baseline, treatment_current, treatment_change, control_baseline, control_current, control_change, did, relative_did"
INTERVAL = "experiment_id, metric, did, standard_error, ci_lower, ci_upper, half_width, inference_units"
MDE = "experiment_id, metric, half_width, mde_in_metric_units, precision_sufficient"


@query("f13_did_estimate", EST + f"SELECT {ARMS} FROM estimates")
def f13(spark, sf):
    return _estimates(spark, sf).select(*ARMS.split(", "))


@query("f14_standard_error_interval", EST + f"SELECT {INTERVAL} FROM estimates")
def f14(spark, sf):
    return _estimates(spark, sf).select(*INTERVAL.split(", "))


@query("f15_mde_precision", EST + f"SELECT {MDE} FROM estimates")
def f15(spark, sf):
    return _estimates(spark, sf).select(*MDE.split(", "))


GUARDED = """guarded AS (SELECT experiment_id, metric, g.direction, threshold, did,
  CASE g.direction WHEN 'non_decrease' THEN did >= -threshold ELSE did <= threshold END AS passed FROM guardrails g LEFT JOIN estimates USING (experiment_id, metric))"""


@query("f16_guardrails", EST + f", {GUARDED} SELECT * FROM guarded")
def f16(spark, sf):
    return ex.guardrail_results(_estimates(spark, sf), load_view(spark, sf, "guardrails"))


CODES = f"""codes AS (SELECT experiment_id, split_part(unnest(issues), ':', 1) AS code FROM panel UNION SELECT experiment_id, code FROM adherence
  UNION SELECT experiment_id, 'missing_unit_dates' FROM complete WHERE missing_count > 0
  UNION SELECT experiment_id, 'missing_unit_period' FROM complete WHERE observed_days = 0
  UNION SELECT experiment_id, 'frozen_baseline_mismatch' FROM frozen UNION SELECT experiment_id, unnest(issues) FROM maturity)"""


@query(
    "f17_eligibility",
    EST
    + f""", {GUARDED}, {COMPLETE}, {ADHERENCE}, {FROZEN}, {MATURITY}, {CODES},
    j AS (SELECT s.*, e.did, e.standard_error, e.ci_lower, e.ci_upper, e.precision_sufficient, c.codes, g.breached, g.unknown FROM exp_specs s
      LEFT JOIN estimates e ON e.experiment_id = s.experiment_id AND e.metric = s.primary_metric
      LEFT JOIN (SELECT experiment_id, list_sort(list(DISTINCT code)) AS codes FROM codes GROUP BY ALL) c ON c.experiment_id = s.experiment_id
      LEFT JOIN (SELECT experiment_id, count(*) FILTER (NOT passed) AS breached, count(*) FILTER (passed IS NULL) AS unknown FROM guarded GROUP BY ALL) g ON g.experiment_id = s.experiment_id),
    k AS (SELECT *, CASE WHEN artifact_passed = FALSE THEN ['artifact_verification_failed'] ELSE list_concat(list_concat(
        CASE WHEN artifact_passed IS NULL THEN ['artifact_verification_missing'] ELSE [] END, coalesce(codes, [])), {issue_list(
          "CASE WHEN did IS NULL THEN 'primary_metric_not_estimable' END", "CASE WHEN standard_error IS NULL THEN 'confidence_interval_not_estimable' END",
          "CASE WHEN NOT coalesce(precision_sufficient, FALSE) THEN 'mde_precision_not_met' END", "CASE WHEN breached > 0 THEN 'guardrail_breached' END",
          "CASE WHEN unknown > 0 THEN 'guardrail_not_estimable' END")}) END AS reasons,
      coalesce(CASE direction WHEN 'increase' THEN did > 0 ELSE did < 0 END, FALSE) AS point_supports,
      coalesce(CASE direction WHEN 'increase' THEN ci_lower > 0 ELSE ci_upper < 0 END, FALSE) AS interval_supports FROM j),
    m AS (SELECT *, CASE WHEN artifact_passed = FALSE THEN 'implementation-failed' WHEN len(reasons) > 0 THEN 'inconclusive' ELSE 'eligible_incremental' END AS eligibility FROM k)
    SELECT experiment_id, eligibility, array_to_string(reasons, ',') AS reasons, point_supports, interval_supports,
      eligibility = 'eligible_incremental' AND point_supports AND interval_supports AS incremental_positive_allowed FROM m""",
)
def f17(spark, sf):
    specs, units = _specs(spark, sf), _units(spark, sf)
    assigned = cut_lineage(ex.assign_units(units, specs), "assignments")  # frozen once, read by every check
    panel = cut_lineage(ex.typed_panel(load_view(spark, sf, "panel_rows"), assigned, METRICS), "panel")
    complete = ex.panel_completeness(panel, assigned, specs)
    pid = F.col("experiment_id")
    issues = (
        panel.select(pid, F.explode(F.transform("issues", lambda c: F.substring_index(c, ":", 1))).alias("code"))
        .unionByName(ex.adherence_issues(panel, specs).select(pid, "code"))
        .unionByName(complete.filter("missing_count > 0").select(pid, F.lit("missing_unit_dates").alias("code")))
        .unionByName(complete.filter("observed_days = 0").select(pid, F.lit("missing_unit_period").alias("code")))
        .unionByName(
            ex.frozen_baseline_issues(panel, specs, units, METRICS).select(pid, F.lit("frozen_baseline_mismatch").alias("code"))
        )
        .unionByName(ex.maturity(specs).select(pid, F.explode("issues").alias("code")))
    )
    estimated = ex.estimates(ex.unit_changes(panel, assigned, specs, METRICS), specs)
    guarded = ex.guardrail_results(estimated, load_view(spark, sf, "guardrails"))
    out = ex.eligibility(specs, estimated, guarded, issues)
    return out.withColumn("reasons", F.array_join("reasons", ","))


FIXED = ("source_kind", "source_timezone", "metrics", "attribution_model")
FACTS = ("data_as_of", "finality", "preliminary", "row_limit_hit", "pagination_complete", "sampling_rate", "thresholding", "declared_quality")
SOURCE_ISSUES = issue_list(
    *[f"CASE WHEN n_{c} IS NOT NULL AND n_{c} IS DISTINCT FROM {c} THEN 'source_{c}_changed_after_preregistration' END" for c in FIXED],
    "CASE WHEN source_timezone IS NULL THEN 'source_timezone_missing' END",
    *COLLECTION,
    "CASE WHEN sampling_rate IS NULL THEN CASE WHEN source_kind = 'ga4_property_report' THEN 'sampling_rate_missing' END WHEN sampling_rate < 1 THEN 'sampling_applied' END",
    "CASE WHEN thresholding IS NULL THEN CASE WHEN source_kind = 'ga4_property_report' THEN 'thresholding_status_missing' END WHEN thresholding THEN 'thresholding_applied' END",
    "CASE WHEN attribution_model IS NULL THEN 'attribution_model_missing' END",
    QUALITY,
)
REGISTERED = """registered AS (SELECT 'exp-' || c_custkey AS experiment_id, 'clicks' AS metric FROM customer UNION ALL SELECT 'exp-' || c_custkey, 'views' FROM customer
  UNION ALL SELECT 'exp-' || c_custkey, 'leads' FROM customer)"""


@query(
    "f18_measurement_contract",
    with_views("frozen_sources", "supplied_sources", extra=REGISTERED)
    + f""", merged AS (SELECT f.experiment_id, f.source_id, {", ".join(f"f.{c}, s.{c} AS n_{c}" for c in FIXED)}, {", ".join(f"coalesce(s.{c}, f.{c}) AS {c}" for c in FACTS)}
      FROM frozen_sources f LEFT JOIN supplied_sources s USING (experiment_id, source_id)),
    mapped AS (SELECT experiment_id, unnest(string_split(metrics, ',')) AS metric FROM frozen_sources),
    codes AS (SELECT experiment_id, unnest({SOURCE_ISSUES}) AS code FROM merged
      UNION SELECT experiment_id, 'source_added_after_preregistration' FROM supplied_sources s WHERE NOT EXISTS (SELECT 1 FROM frozen_sources f WHERE f.experiment_id = s.experiment_id AND f.source_id = s.source_id)
      UNION SELECT experiment_id, 'metric_source_mapping_missing' FROM registered r WHERE NOT EXISTS (SELECT 1 FROM mapped m WHERE m.experiment_id = r.experiment_id AND m.metric = r.metric)
      UNION SELECT experiment_id, 'metric_source_mapping_unregistered' FROM mapped m WHERE NOT EXISTS (SELECT 1 FROM registered r WHERE m.experiment_id = r.experiment_id AND m.metric = r.metric)
      UNION SELECT experiment_id, 'metric_source_mapping_ambiguous' FROM (SELECT experiment_id, metric FROM mapped JOIN registered USING (experiment_id, metric) GROUP BY ALL HAVING count(*) > 1) a
      UNION SELECT experiment_id, 'source_day_boundary_mismatch' FROM frozen_sources GROUP BY experiment_id HAVING count(*) > 1 AND (count(DISTINCT source_timezone) <> 1 OR count(*) FILTER (source_timezone IS NULL) > 0))
    SELECT r.experiment_id, coalesce(string_agg(code, ',' ORDER BY code), '') AS issues, CASE WHEN count(code) > 0 THEN 'inconclusive' ELSE 'complete' END AS status
    FROM (SELECT DISTINCT experiment_id FROM registered) r LEFT JOIN codes USING (experiment_id) GROUP BY r.experiment_id""",
)
def f18(spark, sf):
    frozen = load_view(spark, sf, "frozen_sources")
    registered = frozen.select("experiment_id").distinct().select(
        "experiment_id", F.explode(F.array(*[F.lit(m) for m in ("clicks", "views", "leads")])).alias("metric")
    )
    out = ex.measurement_contract(frozen, load_view(spark, sf, "supplied_sources"), registered)
    return out.withColumn("issues", F.array_join("issues", ","))


@query(
    "f19_replay_differences",
    EST
    + """SELECT experiment_id, unit_id AS item, CASE WHEN u % 7 = 0 THEN 'group' END AS differing FROM (SELECT *, split_part(unit_id, '-', 2)::BIGINT AS u FROM assigned) a WHERE u % 7 = 0
    UNION ALL SELECT experiment_id, metric, 'did' FROM estimates WHERE metric = 'views' AND did IS NOT NULL""",
)
def f19(spark, sf):
    """Stored results with known tampering (every seventh group, one metric's estimate) against a recomputation."""
    assigned = cut_lineage(_assigned(spark, sf), "assignments")
    number = F.substring_index("unit_id", "-", -1).cast("bigint")
    flipped = F.when(F.col("group") == "treatment", F.lit("control")).otherwise(F.lit("treatment"))
    stored = assigned.withColumn("group", F.when(number % 7 == 0, flipped).otherwise(F.col("group")))
    units = ex.replay_differences(stored, assigned, ["experiment_id", "unit_id"], ["group"], [])
    estimated = cut_lineage(_estimates(spark, sf).select("experiment_id", "metric", "did", "standard_error"), "estimates")
    kept = estimated.withColumn("did", F.when(F.col("metric") == "views", F.col("did") + 1e-6).otherwise(F.col("did")))
    metrics = ex.replay_differences(kept, estimated, ["experiment_id", "metric"], [], ["did", "standard_error"])
    shown = F.array_join("differing", ",").alias("differing")
    return units.select("experiment_id", F.col("unit_id").alias("item"), shown).unionByName(
        metrics.select("experiment_id", F.col("metric").alias("item"), shown)
    )


BALANCE = ("treatment_units", "control_units", "treatment_mean", "control_mean", "absolute_difference", "standardized_difference")
RESULT = ("did", "standard_error", "ci_lower", "ci_upper", "t_units", "c_units")


@query(
    "f19_leaf_differences",
    EST
    + """SELECT experiment_id, 'assignments.' || unit_id || '.group' AS path, 'changed' AS issue FROM (SELECT *, split_part(unit_id, '-', 2)::BIGINT AS u FROM assigned) a WHERE u % 7 = 0
    UNION ALL SELECT experiment_id, 'estimates.' || metric || '.did', 'changed' FROM estimates WHERE metric = 'views' AND did IS NOT NULL
    UNION ALL SELECT DISTINCT experiment_id, 'balance.errors.treatment_mean', 'changed' FROM assigned WHERE "group" = 'treatment'
    UNION ALL SELECT DISTINCT experiment_id, 'balance.clicks.control_units', 'not_stored' FROM assigned
    UNION ALL SELECT DISTINCT experiment_id, 'balance.clicks.note', 'not_recomputed' FROM assigned""",
)
def f19_leaves(spark, sf):
    """Stored documents and assignments with known changes against a recomputation of balance, estimates and assignments."""
    specs, units = _specs(spark, sf), _units(spark, sf)
    assigned = cut_lineage(ex.assign_units(units, specs), "assignments")
    balance = cut_lineage(ex.balance(units, assigned, METRICS), "balance")
    estimated = cut_lineage(_estimates(spark, sf).select("experiment_id", "metric", *RESULT), "estimates")
    number = F.substring_index("unit_id", "-", -1).cast("bigint")
    flipped = F.when(F.col("group") == "treatment", F.lit("control")).otherwise(F.lit("treatment"))
    kept = assigned.withColumn("group", F.when(number % 7 == 0, flipped).otherwise(F.col("group")))
    clicks = F.col("metric") == "clicks"
    held = balance.withColumns(
        {"treatment_mean": F.col("treatment_mean") + F.when(F.col("metric") == "errors", 1e-6).otherwise(0.0), "control_units": F.when(~clicks, F.col("control_units")), "note": F.when(clicks, F.lit("as agreed"))}
    )
    moved = estimated.withColumn("did", F.col("did") + F.when(F.col("metric") == "views", 1e-6).otherwise(0.0))

    def document(rows, name, fields):
        # one entry a metric, so an experiment's document is small
        entry = F.struct(F.col("metric"), F.struct(*fields))
        return rows.groupBy("experiment_id").agg(F.map_from_entries(F.collect_list(entry)).alias(name))

    documents = document(held, "balance", [*BALANCE, "note"]).join(document(moved, "estimates", RESULT), "experiment_id", "full")
    stored = cut_lineage(documents.select("experiment_id", F.to_json(F.struct("balance", "estimates")).alias("text")), "stored")
    stored = replay.document_leaves(stored.withColumn("v", F.parse_json("text")), "v").unionByName(replay.table_leaves(kept, "assignments", ["unit_id"], ["group"]))
    again = replay.table_leaves(balance, "balance", ["metric"], BALANCE).unionByName(replay.table_leaves(estimated, "estimates", ["metric"], RESULT))
    again = again.unionByName(replay.table_leaves(assigned, "assignments", ["unit_id"], ["group"]))
    return replay.leaf_differences(stored, again).select("experiment_id", "path", "issue")


# the normal density integrated by Simpson's rule: what lies outside of z standard errors around the registered effect
POWERS = f"""powers AS (SELECT *, CASE WHEN se > 0 AND mde > 0 THEN 1 - (2 * z / 2000) / 3 / sqrt(2 * pi()) * list_sum(list_transform(range(0, 2001),
      lambda k: (CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * exp(-power(k * 2 * z / 2000 - z - mde / se, 2) / 2))) WHEN se = 0 AND mde > 0 THEN 1 END AS p
    FROM (SELECT experiment_id, metric, standard_error AS se, mde_in_metric_units AS mde, ci_lower, ci_upper, CASE alpha WHEN 0.1 THEN {Z10!r} ELSE {Z05!r} END AS z
      FROM estimates JOIN exp_specs USING (experiment_id)) e)"""


@query(
    "f20_detectability",
    EST
    + f""", {POWERS} SELECT experiment_id, metric, se AS standard_error, mde AS mde_in_metric_units, round(p, 9) AS power,
    coalesce(p >= 0.8 AND ci_lower <= 0 AND ci_upper >= 0, FALSE) AS no_change_supported FROM powers""",
)
def f20(spark, sf):
    return ex.detectability(_estimates(spark, sf), _specs(spark, sf)).withColumn("power", F.round("power", 9))
