import datetime as dt

import pytest
from pyspark.sql import functions as F

from searchloom.functions.normal import two_sided_power
from searchloom.operators import experiment as ex

METRICS = ("organic_clicks", "conversion_rate")


def _specs(spark, **changes):
    row = dict(
        experiment_id="e", design="randomized_page_holdout", primary_metric="organic_clicks", direction="increase", seed="s", treatment_fraction=0.5,
        baseline_start=dt.date(2026, 1, 1), baseline_end=dt.date(2026, 1, 5), observation_start=dt.date(2026, 2, 1), observation_end=dt.date(2026, 2, 5),
        mde_value=1.0, mde_scale="absolute", alpha=0.05, artifact_passed=True,
    )
    return spark.createDataFrame([{**row, **changes}])


def _panel(spark, treatment_gain, control_gain=1.0):
    rows, n = [], 0
    for unit in "abcd":
        group = "treatment" if unit in "ab" else "control"
        for month, gain in ((1, 0.0), (2, treatment_gain if group == "treatment" else control_gain)):
            for day in range(1, 6):
                n += 1
                applied = "true" if month == 2 and group == "treatment" else "false"
                rows.append((n, "e", unit, dt.date(2026, month, day), group, str(10 + gain), "0.2", "no", applied))
    return spark.createDataFrame(rows, "row_id bigint, experiment_id string, unit_id string, day date, group_text string, organic_clicks string, conversion_rate string, contaminated_text string, applied_text string")


def _assigned(spark, pairs=(None,) * 4):
    rows = [("e", u, p, "treatment" if u in "ab" else "control") for u, p in zip("abcd", pairs)]
    return spark.createDataFrame(rows, "experiment_id string, unit_id string, pair_id string, group string")


def _analyse(spark, gain, design="randomized_page_holdout", pairs=(None,) * 4, control_gain=1.0):
    specs, assigned = _specs(spark, design=design), _assigned(spark, pairs)
    panel = ex.typed_panel(_panel(spark, gain, control_gain), assigned, METRICS)
    estimated = ex.estimates(ex.unit_changes(panel, assigned, specs, METRICS), specs)
    rails = spark.createDataFrame([("e", "conversion_rate", "non_decrease", 0.01)], "experiment_id string, metric string, direction string, threshold double")
    issues = panel.select("experiment_id", F.explode("issues").alias("code"))
    verdict = ex.eligibility(specs, estimated, ex.guardrail_results(estimated, rails), issues).first()
    return estimated.filter("metric = 'organic_clicks'").first(), verdict


def test_golden_difference_in_differences(spark):
    e, v = _analyse(spark, 4.0)
    assert (e.treatment_baseline, e.treatment_current, e.treatment_change, e.control_change) == (10, 14, 4, 1)
    assert (e.did, e.relative_did, e.standard_error, e.ci_lower, e.ci_upper) == (3, 0.3, 0, 3, 3)
    assert v.eligibility == "eligible_incremental" and v.incremental_positive_allowed


def test_negative_effect_is_eligible_but_unsupported(spark):
    e, v = _analyse(spark, -4.0)
    assert e.did == -5 and v.eligibility == "eligible_incremental" and not v.point_supports and not v.incremental_positive_allowed


def test_matched_pairs_use_pair_differences(spark):
    e, _ = _analyse(spark, 4.0, "matched_page_did", ("p1", "p2", "p1", "p2"))
    assert (e.did, e.standard_error, e.inference_units) == (3, 0, 2)


@pytest.mark.parametrize(("mde", "reached"), [(2.801, False), (2.802, True)])
def test_power_boundary(spark, mde, reached):
    row = spark.createDataFrame([(mde, 1.0, 0.05)], "m double, s double, a double").select(two_sided_power("m", "s", "a").alias("p")).first()
    assert (row.p >= 0.8) is reached


def test_assignment_counts_and_repeatability(spark):
    units = spark.range(1001).select(F.lit("e").alias("experiment_id"), F.concat(F.lit("u"), "id").alias("unit_id"))
    specs = _specs(spark, treatment_fraction=0.3)
    first = ex.assign_randomized(units.repartition(7), specs)
    counts = {r.group: r["count"] for r in first.groupBy("group").count().collect()}
    assert counts == {"treatment": 300, "control": 701}
    assert first.exceptAll(ex.assign_randomized(units.repartition(3), specs)).count() == 0
    tiny = ex.assign_randomized(units.limit(2), _specs(spark, treatment_fraction=0.01))
    assert {r.group for r in tiny.collect()} == {"treatment", "control"}


def test_matched_assignment_splits_every_pair(spark):
    units = spark.range(40).select(F.lit("e").alias("experiment_id"), F.concat(F.lit("u"), "id").alias("unit_id"), F.expr("concat('p', id div 2)").alias("pair_id"))
    out = ex.assign_matched(units, _specs(spark, design="matched_page_did"))
    assert out.groupBy("pair_id").agg(F.countDistinct("group").alias("g")).filter("g <> 2").count() == 0


def test_panel_faults_are_listed(spark):
    rows = [
        (1, "e", "a", dt.date(2026, 1, 1), "treated", "1,0", "0.2", "no", "no"), (2, "e", "a", dt.date(2026, 1, 1), "test", "1", "0.2", "no", "no"),
        (3, "e", "z", dt.date(2026, 1, 1), "control", "", "0.2", "maybe", ""), (4, "e", " ", dt.date(2026, 1, 1), "control", "1", "0.2", "no", "no"),
        (5, "e", "c", dt.date(2026, 1, 1), "实验组", "1", "0.2", "是", "否"), (6, "e", "c", None, "control", "1", "0.2", "no", "no"),
    ]
    raw = spark.createDataFrame(rows, _panel(spark, 0.0).schema)
    issues = {r.row_id: list(r.issues) for r in ex.typed_panel(raw, _assigned(spark), METRICS).collect()}
    assert issues[1] == [] and issues[2] == ["duplicate_unit_date"] and issues[4] == ["missing_unit_id"] and issues[6] == ["invalid_dimension"]
    assert issues[3] == ["unknown_unit", "missing_or_invalid_metric:organic_clicks", "invalid_contamination_flag", "invalid_treatment_flag"]
    assert issues[5] == ["assignment_mismatch"]


def test_replay_lists_differing_fields(spark):
    a = spark.createDataFrame([("e", "a", "x", 1.0), ("e", "b", "x", None)], "experiment_id string, unit_id string, g string, v double")
    b = spark.createDataFrame([("e", "a", "y", 1.0 + 1e-13), ("e", "c", "x", None)], a.schema)
    out = {r.unit_id: list(r.differing) for r in ex.replay_differences(a, b, ["experiment_id", "unit_id"], ["g"], ["v"]).collect()}
    assert out == {"a": ["g"], "b": ["not_recomputed"], "c": ["not_stored"]}
