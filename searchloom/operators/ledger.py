"""Change ledgers: hash chains, status transitions, payload and review gates for many projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from searchloom.functions.normal import two_sided_power
from searchloom.operators.compare import code, issue_list
from searchloom.operators.skew import bucketed_lag

# Genesis hash, statuses, legal moves, verdicts.
GENESIS = "0" * 64
STATUSES = (
    "planned",
    "implemented",
    "artifact_verified",
    "outcome_pending",
    "reviewed",
    "implementation_failed",
    "rolled_back",
    "cancelled",
)
LEGAL_MOVES = {
    "planned": ("implemented", "cancelled"),
    "implemented": ("artifact_verified", "implementation_failed", "rolled_back", "cancelled"),
    "artifact_verified": ("outcome_pending", "rolled_back"),
    "outcome_pending": ("reviewed", "rolled_back"),
}
VERDICTS = (
    "implementation-failed",
    "not-yet-observable",
    "directional-positive",
    "incremental-positive",
    "no-detectable-change",
    "negative-or-regression",
    "inconclusive",
)
POWER_NEEDED = 0.8


def chain_issues(lines: DataFrame) -> DataFrame:
    """Integrity of every stored line.

    ``lines`` has ``project_id, chain, line_number`` and the parsed fields with the ``line`` as written.
    A line's predecessor is found by an equi-join on its position, so a very long chain is spread over
    the cluster and not sorted in one task. The digest is taken over the stored canonical text.
    """
    keys = ["project_id", "chain", "line_number"]
    body = F.regexp_replace("line", r'"record_hash":"[^"]*",', "")
    staged = lines.withColumn("_digest", F.sha2(body, 256))
    before = staged.select(
        "project_id", "chain", (F.col("line_number") + 1).alias("line_number"), F.col("record_hash").alias("_before")
    )
    joined = staged.join(before, keys, "left")
    expected = F.when(F.col("line_number") == 1, F.lit(GENESIS)).otherwise(F.col("_before"))
    readable = F.col("line_issue").isNull()
    issues = F.when(~readable, F.array("line_issue")).otherwise(
        issue_list(
            code(F.coalesce(F.col("record_kind") != F.col("chain"), F.lit(True)), "wrong_record_kind"),
            code(
                F.coalesce(F.col("project_sha256") != F.sha2("project_id", 256), F.lit(True)), "project_digest_mismatch"
            ),
            code(F.coalesce(F.col("sequence") != F.col("line_number"), F.lit(True)), "sequence_not_contiguous"),
            code(~F.col("previous_hash").eqNullSafe(expected), "previous_hash_broken"),
            code(~F.coalesce(F.col("record_hash").rlike("^[0-9a-f]{64}$"), F.lit(False)), "record_hash_malformed"),
            code(~F.col("record_hash").eqNullSafe(F.col("_digest")), "record_hash_mismatch"),
        )
    )
    return joined.select(*keys, issues.alias("issues"))


def unknown_heads(heads: DataFrame, records: DataFrame) -> DataFrame:
    """Records bound to a head that the other chain of their project does not contain."""
    known = records.select("project_id", F.col("chain").alias("_owner"), F.col("record_hash").alias("other_head"))
    other = F.when(F.col("chain") == "change", F.lit("review")).otherwise(F.lit("change"))
    return (
        heads.filter(F.col("other_head") != GENESIS)
        .withColumn("_owner", other)
        .join(known, ["project_id", "_owner", "other_head"], "left_anti")
        .select("project_id", "chain", "sequence")
    )


def illegal_moves(events: DataFrame, bucket_rows: int = 100_000) -> DataFrame:
    """Every status that its predecessor does not allow; the first status must be ``planned``."""
    bucket = F.floor(F.col("sequence") / bucket_rows)
    lagged = bucketed_lag(events, ["project_id", "change_id"], ["sequence"], bucket, "status", "previous_status")
    moves = [f"{a}>{b}" for a, targets in LEGAL_MOVES.items() for b in targets]
    step = F.concat("previous_status", F.lit(">"), "status")
    issue = F.when(
        F.col("previous_status").isNull(), code(F.col("status") != "planned", "first_status_not_planned")
    ).otherwise(code(~step.isin(*moves), "transition_not_allowed"))
    return lagged.select(
        "project_id", "change_id", "sequence", "previous_status", "status", issue.alias("issue")
    ).filter("issue IS NOT NULL")


def has_evidence(text: Column) -> Column:
    return F.coalesce(F.trim(text) != "", F.lit(False))


def payload_issues(events: DataFrame) -> DataFrame:
    """Gates on one record: known status, evidence where the status claims a verification."""
    status, passed = F.col("status"), F.col("passed")
    evidence = has_evidence(F.col("evidence"))
    issues = issue_list(
        code(~status.isin(*STATUSES), "status_unknown"),
        code(status == "reviewed", "reviewed_only_by_review"),
        code(
            (status == "artifact_verified") & ~(F.coalesce(passed, F.lit(False)) & evidence),
            "artifact_verified_without_proof",
        ),
        code(
            (status == "implementation_failed") & ~(F.coalesce(~passed, F.lit(False)) & evidence),
            "implementation_failed_without_proof",
        ),
        code(F.col("registered_experiment").isNotNull() & (status != "planned"), "registration_outside_planned"),
    )
    return events.select("project_id", "change_id", "sequence", F.explode(issues).alias("issue"))


def change_states(events: DataFrame) -> DataFrame:
    """Latest and first status of each change, with the experiment its first record registers."""
    first = F.min_by(F.struct("status", "registered_experiment"), "sequence")
    return (
        events.groupBy("project_id", "change_id")
        .agg(F.max_by("status", "sequence").alias("status"), first.alias("_f"))
        .select(
            "project_id",
            "change_id",
            "status",
            F.col("_f.status").alias("first_status"),
            F.col("_f.registered_experiment").alias("registered_experiment"),
        )
    )


def review_outcomes(states: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Effective state of every change, and the reviews refused for identity reasons."""
    by_id = reviews.groupBy("project_id", "review_id").agg(F.min("sequence").alias("_first_id"))
    by_change = reviews.groupBy("project_id", "change_id").agg(F.min("sequence").alias("_first_change"))
    checked = (
        reviews.join(by_id, ["project_id", "review_id"])
        .join(by_change, ["project_id", "change_id"])
        .join(
            states.select("project_id", "change_id", F.col("status").alias("change_status")),
            ["project_id", "change_id"],
            "left",
        )
    )
    issue = (
        F.when(F.col("sequence") > F.col("_first_id"), F.lit("review_id_repeated"))
        .when(F.col("change_status").isNull(), F.lit("change_unknown"))
        .when(F.col("sequence") > F.col("_first_change"), F.lit("change_already_reviewed"))
    )
    flagged = checked.withColumn("issue", issue)
    refused = flagged.filter("issue IS NOT NULL").select("project_id", "review_id", "change_id", "sequence", "issue")
    accepted = flagged.filter("issue IS NULL").select("project_id", "change_id", "verdict")
    effective = states.join(accepted, ["project_id", "change_id"], "left").select(
        "project_id",
        "change_id",
        F.when(F.col("verdict") == "implementation-failed", F.lit("implementation_failed"))
        .when(F.col("verdict").isNotNull(), F.lit("reviewed"))
        .otherwise(F.col("status"))
        .alias("effective_status"),
    )
    return effective, refused


def review_gate(reviews: DataFrame, states: DataFrame, results: DataFrame) -> DataFrame:
    """First reason a review may not be recorded, or the state it leads to.

    Strong verdicts need a registration in the planned record, an eligible and complete result for the
    same experiment, and for "no detectable change" a power equal to a recomputation.
    """
    powered = results.withColumn(
        "power", two_sided_power(F.col("mde"), F.col("standard_error"), F.col("alpha"))
    )
    facts = powered.select("experiment_id", F.struct(*[c for c in powered.columns if c != "experiment_id"]).alias("r"))
    joined = reviews.join(
        states.select(
            "project_id", "change_id", F.col("status").alias("current_status"), "first_status", "registered_experiment"
        ),
        ["project_id", "change_id"],
        "left",
    ).join(facts, "experiment_id", "left")
    verdict = F.col("verdict")
    gain, flat = verdict == "incremental-positive", verdict == "no-detectable-change"
    strong, failed = gain | flat, verdict == "implementation-failed"
    r = F.col("r")
    proof = F.coalesce(~F.col("passed"), F.lit(False)) & has_evidence(F.col("evidence"))
    claimed = F.col("claimed_power")
    reason = (
        F.when(~verdict.isin(*VERDICTS), F.lit("verdict_unknown"))
        .when(gain & F.col("experiment_id").isNull(), F.lit("experiment_id_missing"))
        .when(gain & F.col("counterfactual_method").isNull(), F.lit("counterfactual_missing"))
        .when(flat & F.col("preregistered_mde").isNull(), F.lit("preregistered_mde_missing"))
        .when(flat & claimed.isNull(), F.lit("detectability_evidence_missing"))
        .when(flat & F.col("experiment_id").isNull(), F.lit("experiment_id_missing"))
        .when(strong & (F.col("integrity_status") != "complete"), F.lit("integrity_not_complete"))
        .when(strong & (F.col("integrity_issues") > 0), F.lit("integrity_has_issues"))
        .when(strong & ~has_evidence(F.col("integrity_evidence")), F.lit("integrity_evidence_missing"))
        .when(strong & ~F.col("first_status").eqNullSafe(F.lit("planned")), F.lit("planned_record_missing"))
        .when(strong & ~F.col("registered_experiment").eqNullSafe(F.col("experiment_id")), F.lit("registration_mismatch"))
        .when(strong & r.isNull(), F.lit("result_missing"))
        .when(strong & (r["eligibility"] != "eligible_incremental"), F.lit("result_not_eligible"))
        .when(strong & ~r["artifact_passed"], F.lit("result_artifact_not_passed"))
        .when(strong & ~r["quality_passed"], F.lit("result_quality_not_passed"))
        .when(strong & (r["measurement_status"] != "complete"), F.lit("result_measurement_incomplete"))
        .when(gain & ~(r["point_supports"] & r["interval_supports"]), F.lit("direction_not_supported"))
        .when(flat & (claimed != r["power"]), F.lit("detectability_mismatch"))
        .when(flat & (r["power"] < POWER_NEEDED), F.lit("power_below_threshold"))
        .when(flat & (F.col("preregistered_mde") != r["mde"]), F.lit("preregistered_mde_mismatch"))
        .when(flat & ~((r["ci_lower"] <= 0) & (r["ci_upper"] >= 0)), F.lit("interval_excludes_zero"))
        .when(
            failed & ~F.coalesce(F.col("current_status").isin("implemented", "implementation_failed"), F.lit(False)),
            F.lit("wrong_status_for_failure"),
        )
        .when(failed & ~proof, F.lit("failure_without_proof"))
        .when(~failed & ~F.col("current_status").eqNullSafe(F.lit("outcome_pending")), F.lit("not_outcome_pending"))
    )
    target = F.when(failed, F.lit("implementation_failed")).otherwise(F.lit("reviewed"))
    return joined.withColumn("reason", reason).select(
        "project_id", "review_id", "change_id", "sequence", "verdict", "reason",
        F.col("reason").isNull().alias("allowed"),
        F.when(F.col("reason").isNull(), target).alias("next_status"),
    )
