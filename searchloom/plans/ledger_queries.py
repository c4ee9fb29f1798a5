"""Change ledgers: stored chains, status histories and reviews."""

from statistics import NormalDist

from pyspark.sql import functions as F

from searchloom.operators import ledger
from searchloom.plans.compare_queries import issue_list
from searchloom.plans.registry import query
from searchloom.plans.tables import load_view, with_views
from searchloom.session import scratch_path
from searchloom.sources import files


def _field(name: str) -> str:
    return f"""json_extract_string(try_cast(line AS JSON), '$.{name}')"""


PARSED = f"""parsed AS (SELECT project_id, chain, line_number, line, CASE WHEN trim(line) = '' THEN 'blank_line' WHEN NOT starts_with(line, '{{') THEN 'not_a_json_object' END AS line_issue,
  CASE WHEN starts_with(line, '{{') THEN {_field("record_kind")} END AS record_kind, CASE WHEN starts_with(line, '{{') THEN {_field("project_sha256")} END AS project_sha256,
  CASE WHEN starts_with(line, '{{') THEN {_field("sequence")}::BIGINT END AS sequence, CASE WHEN starts_with(line, '{{') THEN {_field("previous_hash")} END AS previous_hash,
  CASE WHEN starts_with(line, '{{') THEN {_field("record_hash")} END AS record_hash, CASE WHEN starts_with(line, '{{') THEN {_field("status")} END AS status FROM ledger_lines)"""


@query(
    "a19_read_ledger",
    with_views("ledger_lines", extra=PARSED)
    + "SELECT coalesce(line_issue, 'ok') AS outcome, record_kind, status, count(*) AS rows, sum(sequence)::DOUBLE AS sequences FROM parsed WHERE line <> '' GROUP BY ALL",
)
def a19(spark, sf):
    """Lines written as a text log and read back; blank lines are what the gate reports, not the text writer."""
    path = scratch_path(spark, "ledger")
    load_view(spark, sf, "ledger_lines").filter("line <> ''").select(F.col("line").alias("value")).write.text(path)
    rows = files.read_ledger(spark, path)
    return rows.groupBy(F.coalesce("line_issue", F.lit("ok")).alias("outcome"), "record_kind", "status").agg(
        F.count("*").alias("rows"), F.sum("sequence").cast("double").alias("sequences")
    )


@query(
    "g1_chain_integrity",
    with_views("ledger_lines", extra=PARSED)
    + f"""SELECT project_id, chain, line_number, array_to_string(CASE WHEN line_issue IS NOT NULL THEN [line_issue] ELSE {issue_list(
        "CASE WHEN record_kind <> chain THEN 'wrong_record_kind' END",
        "CASE WHEN project_sha256 <> sha256(project_id) THEN 'project_digest_mismatch' END",
        "CASE WHEN sequence <> line_number THEN 'sequence_not_contiguous' END",
        f"CASE WHEN previous_hash IS DISTINCT FROM CASE WHEN line_number = 1 THEN '{ledger.GENESIS}' ELSE before END THEN 'previous_hash_broken' END",
        "CASE WHEN NOT regexp_matches(record_hash, '^[0-9a-f]{64}$') THEN 'record_hash_malformed' END",
        '''CASE WHEN record_hash <> sha256(regexp_replace(line, '"record_hash":"[^"]*",', '')) THEN 'record_hash_mismatch' END''',
    )} END, ',') AS issues FROM (SELECT *, lag(record_hash) OVER (PARTITION BY project_id, chain ORDER BY line_number) AS before FROM parsed) p""",
)
def g1(spark, sf):
    lines = files.ledger_fields(load_view(spark, sf, "ledger_lines"))
    return ledger.chain_issues(lines).withColumn("issues", F.array_join("issues", ","))


@query(
    "g2_unknown_heads",
    with_views("ledger_heads")
    + f"""SELECT project_id, chain, sequence FROM ledger_heads h WHERE other_head <> '{ledger.GENESIS}' AND NOT EXISTS (
      SELECT 1 FROM ledger_clean c WHERE c.project_id = h.project_id AND c.chain <> h.chain AND c.record_hash = h.other_head)""",
)
def g2(spark, sf):
    return ledger.unknown_heads(load_view(spark, sf, "ledger_heads"), load_view(spark, sf, "ledger_clean"))


MOVES = ", ".join(f"('{a}', '{b}')" for a, targets in ledger.LEGAL_MOVES.items() for b in targets)


@query(
    "g3_illegal_moves",
    with_views("change_events")
    + f"""SELECT * FROM (SELECT project_id, change_id, sequence, previous_status, status, CASE WHEN previous_status IS NULL THEN CASE WHEN status <> 'planned' THEN 'first_status_not_planned' END
        WHEN (previous_status, status) NOT IN ({MOVES}) THEN 'transition_not_allowed' END AS issue FROM (
      SELECT *, lag(status) OVER (PARTITION BY project_id, change_id ORDER BY sequence) AS previous_status FROM change_events) l) t WHERE issue IS NOT NULL""",
)
def g3(spark, sf):
    return ledger.illegal_moves(load_view(spark, sf, "change_events"), bucket_rows=1000)


@query(
    "g4_payload_gates",
    with_views("change_events")
    + f"""SELECT project_id, change_id, sequence, unnest({issue_list(
        "CASE WHEN status NOT IN (" + ", ".join(f"'{s}'" for s in ledger.STATUSES) + ") THEN 'status_unknown' END",
        "CASE WHEN status = 'reviewed' THEN 'reviewed_only_by_review' END",
        "CASE WHEN status = 'artifact_verified' AND NOT (coalesce(passed, FALSE) AND coalesce(trim(evidence), '') <> '') THEN 'artifact_verified_without_proof' END",
        "CASE WHEN status = 'implementation_failed' AND NOT (coalesce(NOT passed, FALSE) AND coalesce(trim(evidence), '') <> '') THEN 'implementation_failed_without_proof' END",
        "CASE WHEN registered_experiment IS NOT NULL AND status <> 'planned' THEN 'registration_outside_planned' END",
    )}) AS issue FROM change_events""",
)
def g4(spark, sf):
    return ledger.payload_issues(load_view(spark, sf, "change_events"))


STATES = """states AS (SELECT project_id, change_id, arg_max(status, sequence) AS status, arg_min(status, sequence) AS first_status FROM change_events GROUP BY ALL),
  firsts AS (SELECT project_id, change_id, registered_experiment FROM (SELECT *, row_number() OVER (PARTITION BY project_id, change_id ORDER BY sequence) AS k FROM change_events) f WHERE k = 1)"""
FLAGGED = """flagged AS (SELECT r.*, CASE WHEN r.sequence > min(r.sequence) OVER (PARTITION BY r.project_id, r.review_id) THEN 'review_id_repeated'
    WHEN s.status IS NULL THEN 'change_unknown' WHEN r.sequence > min(r.sequence) OVER (PARTITION BY r.project_id, r.change_id) THEN 'change_already_reviewed' END AS issue
  FROM reviews r LEFT JOIN states s USING (project_id, change_id))"""


@query(
    "g5_effective_state",
    with_views("change_events", "reviews", extra=f"{STATES}, {FLAGGED}")
    + """SELECT project_id, change_id, 'state' AS kind, CASE WHEN verdict = 'implementation-failed' THEN 'implementation_failed' WHEN verdict IS NOT NULL THEN 'reviewed' ELSE status END AS detail
      FROM states LEFT JOIN (SELECT project_id, change_id, verdict FROM flagged WHERE issue IS NULL) a USING (project_id, change_id)
    UNION ALL SELECT project_id, change_id, 'refused:' || review_id, issue FROM flagged WHERE issue IS NOT NULL""",
)
def g5(spark, sf):
    states = ledger.change_states(load_view(spark, sf, "change_events"))
    effective, refused = ledger.review_outcomes(states, load_view(spark, sf, "reviews"))
    keys = ["project_id", "change_id"]
    return effective.select(*keys, F.lit("state").alias("kind"), F.col("effective_status").alias("detail")).unionByName(
        refused.select(*keys, F.concat(F.lit("refused:"), "review_id").alias("kind"), F.col("issue").alias("detail"))
    )


def _power(mde: float, se: float) -> float:
    n = NormalDist()
    cut, shift = n.inv_cdf(0.975), mde / se
    return round(n.cdf(-cut - shift) + 1 - n.cdf(cut - shift), 12)


POWER = "CASE " + " ".join(
    f"WHEN mde = {m} AND standard_error = {s} THEN {_power(m, s)!r}" for m in (2.801, 2.802) for s in (1.0, 2.0)
) + " END"
G6_REASON = """CASE WHEN verdict = 'won' THEN 'verdict_unknown' WHEN gain AND experiment_id IS NULL THEN 'experiment_id_missing' WHEN gain AND counterfactual_method IS NULL THEN 'counterfactual_missing'
  WHEN flat AND preregistered_mde IS NULL THEN 'preregistered_mde_missing' WHEN flat AND claimed_power IS NULL THEN 'detectability_evidence_missing' WHEN flat AND experiment_id IS NULL THEN 'experiment_id_missing'
  WHEN strong AND integrity_status <> 'complete' THEN 'integrity_not_complete' WHEN strong AND integrity_issues > 0 THEN 'integrity_has_issues' WHEN strong AND trim(integrity_evidence) = '' THEN 'integrity_evidence_missing'
  WHEN strong AND first_status IS DISTINCT FROM 'planned' THEN 'planned_record_missing' WHEN strong AND registered_experiment IS DISTINCT FROM experiment_id THEN 'registration_mismatch'
  WHEN strong AND eligibility IS NULL THEN 'result_missing' WHEN strong AND eligibility <> 'eligible_incremental' THEN 'result_not_eligible' WHEN strong AND NOT artifact_passed THEN 'result_artifact_not_passed'
  WHEN strong AND NOT quality_passed THEN 'result_quality_not_passed' WHEN strong AND measurement_status <> 'complete' THEN 'result_measurement_incomplete'
  WHEN gain AND NOT (point_supports AND interval_supports) THEN 'direction_not_supported' WHEN flat AND claimed_power <> power THEN 'detectability_mismatch'
  WHEN flat AND power < 0.8 THEN 'power_below_threshold' WHEN flat AND preregistered_mde <> mde THEN 'preregistered_mde_mismatch' WHEN flat AND NOT (ci_lower <= 0 AND ci_upper >= 0) THEN 'interval_excludes_zero'
  WHEN failed AND NOT coalesce(current_status IN ('implemented', 'implementation_failed'), FALSE) THEN 'wrong_status_for_failure' WHEN failed AND NOT (NOT rpassed AND coalesce(trim(revidence), '') <> '') THEN 'failure_without_proof'
  WHEN NOT failed AND current_status IS DISTINCT FROM 'outcome_pending' THEN 'not_outcome_pending' END"""


@query(
    "g6_review_gate",
    with_views("change_events", "reviews", "results", extra=STATES)
    + f""", j AS (SELECT v.project_id, review_id, v.change_id, v.sequence, verdict, v.experiment_id, counterfactual_method, preregistered_mde, claimed_power, integrity_status, integrity_issues,
      integrity_evidence, v.passed AS rpassed, v.evidence AS revidence, s.status AS current_status, first_status, f.registered_experiment, r.* EXCLUDE (experiment_id), {POWER} AS power,
      verdict = 'incremental-positive' AS gain, verdict = 'no-detectable-change' AS flat, verdict IN ('incremental-positive', 'no-detectable-change') AS strong, verdict = 'implementation-failed' AS failed
      FROM reviews v LEFT JOIN states s USING (project_id, change_id) LEFT JOIN firsts f USING (project_id, change_id) LEFT JOIN results r ON r.experiment_id = v.experiment_id)
    SELECT project_id, review_id, change_id, sequence, verdict, reason, reason IS NULL AS allowed, CASE WHEN reason IS NULL THEN CASE WHEN failed THEN 'implementation_failed' ELSE 'reviewed' END END AS next_status
    FROM (SELECT *, {G6_REASON} AS reason FROM j) k""",
)
def g6(spark, sf):
    states = ledger.change_states(load_view(spark, sf, "change_events"))
    return ledger.review_gate(load_view(spark, sf, "reviews"), states, load_view(spark, sf, "results"))
