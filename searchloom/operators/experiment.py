"""Page experiments: specs, assignment, panel checks, difference-in-differences, eligibility.

All operators work on many experiments at once (``experiment_id`` everywhere).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from searchloom.functions.dates import utc_wall, wall_in
from searchloom.functions.normal import normal_quantile, two_sided_power
from searchloom.functions.numbers import clean
from searchloom.operators.compare import code, collection_issues, issue_list, quality_issue
from searchloom.operators.skew import bucketed_rank, tree_digest

# Accepted designs, group and flag spellings, roles, effect scales.
DESIGNS = ("randomized_page_holdout", "matched_page_did")
GROUP_ALIASES = {
    "treatment": "treatment",
    "treated": "treatment",
    "test": "treatment",
    "实验组": "treatment",
    "处理组": "treatment",
    "control": "control",
    "holdout": "control",
    "对照组": "control",
    "保留组": "control",
}
TRUE_VALUES = ("1", "true", "yes", "y", "是")
FALSE_VALUES = ("0", "false", "no", "n", "否")
PAID_ROLES = ("language_research", "search_term_research", "landing_page_experiment", "none")
MDE_SCALES = ("absolute", "relative_to_control_baseline")
POWER_NEEDED = 0.8

UNIT = ["experiment_id", "unit_id"]


def _r12(value: Column) -> Column:
    return clean(value, 12)


def spec_issues(specs: DataFrame) -> DataFrame:
    """Why a specification is refused; an empty list accepts it."""
    fraction, alpha, mde = F.col("treatment_fraction"), F.col("alpha"), F.col("mde_value")
    names = F.transform("guardrails", lambda g: g["metric"])
    issues = issue_list(
        code(F.trim(F.coalesce("experiment_id", F.lit(""))) == "", "experiment_id_blank"),
        code(~F.col("design").isin(*DESIGNS), "design_unsupported"),
        code(~F.col("direction").isin("increase", "decrease"), "direction_invalid"),
        code(F.trim(F.coalesce("seed", F.lit(""))) == "", "seed_blank"),
        code(~((fraction > 0) & (fraction < 1)), "treatment_fraction_out_of_range"),
        code((F.col("design") == "matched_page_did") & (F.abs(fraction - 0.5) > 1e-9), "matched_design_needs_half"),
        code(F.col("baseline_start") > F.col("baseline_end"), "baseline_window_reversed"),
        code(F.col("observation_start") > F.col("observation_end"), "observation_window_reversed"),
        code(F.col("baseline_end") >= F.col("observation_start"), "windows_overlap"),
        code(F.coalesce(mde <= 0, F.lit(True)), "mde_not_positive"),
        code(~F.col("mde_scale").isin(*MDE_SCALES), "mde_scale_invalid"),
        code(~((alpha > 0) & (alpha < 1)), "alpha_out_of_range"),
        code(F.col("paid_role").isNotNull() & ~F.col("paid_role").isin(*PAID_ROLES), "paid_role_invalid"),
        code(F.array_contains(names, F.col("primary_metric")), "guardrail_is_primary"),
        code(F.size(F.array_distinct(names)) < F.size(names), "guardrail_repeated"),
        code(F.exists("guardrails", lambda g: ~g["direction"].isin("non_decrease", "non_increase")), "guardrail_direction_invalid"),
        code(F.exists("guardrails", lambda g: g["threshold"] < 0), "guardrail_threshold_negative"),
    )
    return specs.select("experiment_id", issues.alias("issues"))


def baseline_units(rows: DataFrame, specs: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Per-unit baseline means, and the unit's issue when its days are incomplete or repeated.

    Rows of files without days (``dated`` false, where there is such a column) are aggregates of the window: one row a unit.
    """
    length = F.datediff("baseline_end", "baseline_start") + 1
    inside = F.col("day").between(F.col("baseline_start"), F.col("baseline_end"))
    one_day = F.col("day")
    if "dated" in rows.columns:
        length = F.when(F.col("dated"), length).otherwise(1)
        inside = ~F.col("dated") | F.coalesce(inside, F.lit(False))
        one_day = F.when(F.col("dated"), F.col("day")).otherwise(F.col("baseline_start"))
    units = (
        rows.join(specs.select("experiment_id", "baseline_start", "baseline_end"), "experiment_id")
        .groupBy(*UNIT, length.alias("expected_days"))
        .agg(
            *[_r12(F.avg(F.when(inside, F.col(m)))).alias(m) for m in metrics],
            F.count_if(inside).alias("source_rows"),
            F.count_if(~inside).alias("outside_rows"),
            # A unit's days are bounded by its window and its pairs by one, so sets stay small.
            F.size(F.collect_set(F.when(inside, one_day))).cast("bigint").alias("days"),
            F.collect_set("pair_id").alias("_pairs"),
        )
        .withColumns({"pair_id": F.array_max("_pairs"), "pairs": F.size("_pairs").cast("bigint")})
        .drop("_pairs")
    )
    issue = (
        F.when(F.col("outside_rows") > 0, F.lit("date_outside_baseline"))
        .when(F.col("source_rows") > F.col("days"), F.lit("duplicate_unit_date"))
        .when(F.col("days") < F.col("expected_days"), F.lit("missing_baseline_dates"))
        .when(F.col("pairs") > 1, F.lit("unit_in_several_pairs"))
    )
    return units.withColumn("issue", issue)


def unit_set_checks(units: DataFrame, specs: DataFrame) -> DataFrame:
    """Group-level gates: at least two units; matched designs need whole pairs and two of them."""
    pairs = units.groupBy("experiment_id", "pair_id").agg(F.count("*").alias("members"))
    per = pairs.groupBy("experiment_id").agg(
        F.sum("members").alias("units"),
        F.count("*").alias("pairs"),
        F.count_if(F.col("members") != 2).alias("broken_pairs"),
    )
    matched = F.col("design") == "matched_page_did"
    issue = (
        F.when(F.col("units") < 2, F.lit("fewer_than_two_units"))
        .when(matched & (F.col("broken_pairs") > 0), F.lit("pair_without_two_units"))
        .when(matched & (F.col("pairs") < 2), F.lit("fewer_than_two_pairs"))
    )
    return per.join(specs.select("experiment_id", "design"), "experiment_id").withColumn("issue", issue)


def _unit_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", *parts), 256)


def assign_randomized(units: DataFrame, specs: DataFrame) -> DataFrame:
    """Seeded order by hash; the first round(n * fraction) units, kept within [1, n-1], are treated.

    The rank is counted over hash-prefix buckets, so an experiment with most units still spreads out.
    """
    seeded = units.join(
        specs.filter("design = 'randomized_page_holdout'").select("experiment_id", "seed", "treatment_fraction"),
        "experiment_id",
    ).withColumn("_h", _unit_hash(F.col("seed"), F.col("unit_id")))
    ranked = bucketed_rank(seeded, ["experiment_id"], ["_h", "unit_id"], F.substring("_h", 1, 3))
    wanted = F.bround(F.col("n") * F.col("treatment_fraction")).cast("bigint")
    treated = F.greatest(F.lit(1).cast("bigint"), F.least(F.col("n") - 1, wanted))
    return ranked.select(
        *UNIT,
        F.lit(None).cast("string").alias("pair_id"),
        F.when(F.col("rank") <= treated, F.lit("treatment")).otherwise(F.lit("control")).alias("group"),
    )


def assign_matched(units: DataFrame, specs: DataFrame) -> DataFrame:
    """One of each pair, by the lower seeded hash; pairs have two members, so the window stays small."""
    seeded = units.join(
        specs.filter("design = 'matched_page_did'").select("experiment_id", "seed"), "experiment_id"
    ).withColumn("_h", _unit_hash(F.col("seed"), F.col("pair_id"), F.col("unit_id")))
    first = F.row_number().over(Window.partitionBy("experiment_id", "pair_id").orderBy("_h")) == 1
    return seeded.select(*UNIT, "pair_id", F.when(first, F.lit("treatment")).otherwise(F.lit("control")).alias("group"))


def assign_units(units: DataFrame, specs: DataFrame) -> DataFrame:
    return assign_randomized(units, specs).unionByName(assign_matched(units, specs))


def unpivot_metrics(rows: DataFrame, keep: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])
    return rows.select(*keep, F.inline(entries))


def balance(units: DataFrame, assignments: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Group means, their difference, and the difference in pooled standard deviations."""
    long = unpivot_metrics(units.join(assignments.select(*UNIT, "group"), UNIT), ["experiment_id", "group"], metrics)

    def arm(group: str) -> Column:
        return F.when(F.col("group") == group, F.col("value"))

    stats = long.groupBy("experiment_id", "metric").agg(
        F.count(arm("treatment")).alias("treatment_units"),
        F.count(arm("control")).alias("control_units"),
        F.avg(arm("treatment")).alias("tm"),
        F.avg(arm("control")).alias("cm"),
        F.var_samp(arm("treatment")).alias("tv"),
        F.var_samp(arm("control")).alias("cv"),
    )
    known = F.filter(F.array("tv", "cv"), lambda v: v.isNotNull() & ~F.isnan(v))
    pooled = F.sqrt(F.aggregate(known, F.lit(0.0), lambda a, v: a + v) / F.size(known))
    diff = F.col("tm") - F.col("cm")
    return stats.select(
        "experiment_id",
        "metric",
        "treatment_units",
        "control_units",
        _r12(F.col("tm")).alias("treatment_mean"),
        _r12(F.col("cm")).alias("control_mean"),
        _r12(diff).alias("absolute_difference"),
        F.when(F.size(known) > 0, F.when(pooled > 0, _r12(diff / pooled))).alias("standardized_difference"),
    )


def frozen_digests(units: DataFrame, assignments: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Digest of the frozen units, of the assignments, and of both together."""
    unit_rows = units.withColumn(
        "_d", F.sha2(F.concat_ws("|", "unit_id", *[F.round(F.col(m) * 1e6).cast("bigint").cast("string") for m in metrics]), 256)
    )
    given = assignments.withColumn("_d", F.sha2(F.concat_ws("|", "unit_id", "group"), 256))
    unit_digest = tree_digest(unit_rows, ["experiment_id"], "unit_id", "_d", "units_digest")
    group_digest = tree_digest(given, ["experiment_id"], "unit_id", "_d", "assignments_digest")
    return unit_digest.join(group_digest, "experiment_id").withColumn(
        "plan_digest", F.sha2(F.concat("experiment_id", "units_digest", "assignments_digest"), 256)
    )


def parse_group(text: Column) -> Column:
    key = F.lower(F.trim(text))
    aliases = F.create_map(*[F.lit(x) for pair in GROUP_ALIASES.items() for x in pair])
    return F.try_element_at(aliases, key)


def parse_flag(text: Column) -> Column:
    key = F.lower(F.trim(text))
    return F.when(key.isin(*TRUE_VALUES), F.lit(True)).when(key.isin(*FALSE_VALUES), F.lit(False))


def typed_panel(raw: DataFrame, assignments: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Typed unit-days with ``issues`` per row; repeats of a unit-day keep the first row only as data. A flag text that is NULL says that its file
    has no such column, which is no issue of the row.

    ``usable`` marks rows that enter estimates: a known unit-day, first of its kind.
    """
    number = lambda m: F.regexp_replace(F.col(m), ",", "").try_cast("double")
    parsed = raw.select(
        "row_id",
        "experiment_id",
        F.trim("unit_id").alias("unit_id"),
        "day",
        parse_group(F.col("group_text")).alias("group"),
        *[number(m).alias(m) for m in metrics],
        parse_flag(F.col("contaminated_text")).alias("contaminated"),
        parse_flag(F.col("applied_text")).alias("applied"),
        *[F.col(f"{n}_text").isNotNull().alias(f"_has_{n}") for n in ("contaminated", "applied")],
    )
    readable = F.coalesce((F.col("unit_id") != "") & F.col("day").isNotNull() & F.col("group").isNotNull(), F.lit(False))
    parsed = parsed.withColumn("_readable", readable)
    # unreadable rows, all those with a blank unit among them, take no part in finding the first row of a unit-day
    known = parsed.filter("_readable")
    firsts = known.groupBy(*UNIT, "day").agg(F.min("row_id").alias("_first"))
    numbered = known.join(firsts, [*UNIT, "day"]).unionByName(parsed.filter("NOT _readable").withColumn("_first", F.col("row_id")))
    joined = numbered.join(assignments.select(*UNIT, F.col("group").alias("assigned")), UNIT, "left")
    repeated = F.col("row_id") != F.col("_first")
    first = F.col("_readable") & ~repeated
    issues = F.when(F.col("unit_id") == "", F.array(F.lit("missing_unit_id"))).when(
        ~F.col("_readable"), F.array(F.lit("invalid_dimension"))
    ).when(repeated, F.array(F.lit("duplicate_unit_date"))).otherwise(
        issue_list(
            F.when(F.col("assigned").isNull(), F.lit("unknown_unit")).when(
                F.col("assigned") != F.col("group"), F.lit("assignment_mismatch")
            ),
            *[code(F.col(m).isNull(), f"missing_or_invalid_metric:{m}") for m in metrics],
            code(F.col("_has_contaminated") & F.col("contaminated").isNull(), "invalid_contamination_flag"),
            code(F.col("_has_applied") & F.col("applied").isNull(), "invalid_treatment_flag"),
        )
    )
    return joined.select(
        "row_id", *UNIT, "day", "group", "assigned", *metrics, "contaminated", "applied",
        F.col("_readable").alias("readable"), first.alias("usable"), issues.alias("issues"),
    )


def units_in_two_groups(panel: DataFrame) -> DataFrame:
    return (
        panel.filter("readable")
        .groupBy(*UNIT)
        .agg(F.countDistinct("group").alias("groups"))
        .filter("groups > 1")
    )


def with_period(panel: DataFrame, specs: DataFrame) -> DataFrame:
    windows = specs.select("experiment_id", "baseline_start", "baseline_end", "observation_start", "observation_end")
    day = F.col("day")
    period = F.when(day.between(F.col("baseline_start"), F.col("baseline_end")), F.lit("baseline")).when(
        day.between(F.col("observation_start"), F.col("observation_end")), F.lit("current")
    )
    return panel.join(windows, "experiment_id").withColumn("period", period)


def panel_completeness(panel: DataFrame, assignments: DataFrame, specs: DataFrame) -> DataFrame:
    """Per assigned unit and period: observed and missing days, with the first five missing ones as a sample.

    ``panel_gaps`` has every missing day.
    """
    sides = _panel_days(panel, assignments, specs)
    return sides.withColumn("missing_examples", F.slice("gaps", 1, 5)).drop("gaps")


def panel_gaps(panel: DataFrame, assignments: DataFrame, specs: DataFrame) -> DataFrame:
    """A row for every missing day of an assigned unit and period."""
    return _panel_days(panel, assignments, specs).select(*UNIT, "period", F.explode("gaps").alias("day"))


def _panel_days(panel: DataFrame, assignments: DataFrame, specs: DataFrame) -> DataFrame:
    """Day counts and missing days of each unit and period.

    A unit's day set is bounded by its window, so the gap list comes from a set difference and no
    unit x date table is built.
    """
    seen = (
        with_period(panel.filter("usable"), specs)
        .filter("period IS NOT NULL")
        .groupBy(*UNIT)
        .agg(
            F.collect_set(F.when(F.col("period") == "baseline", F.col("day"))).alias("b_days"),
            F.collect_set(F.when(F.col("period") == "current", F.col("day"))).alias("c_days"),
        )
    )
    base = assignments.select(*UNIT).join(seen, UNIT, "left").join(specs, "experiment_id")
    none = F.array().cast("array<date>")

    def side(name: str, days: str, start: str, end: str) -> Column:
        expected = F.sequence(F.col(start), F.col(end))
        have = F.coalesce(F.col(days), none)
        gaps = F.array_sort(F.array_except(expected, have))
        return F.struct(
            F.lit(name).alias("period"),
            F.size(expected).alias("expected_days"),
            F.size(have).alias("observed_days"),
            F.size(gaps).alias("missing_count"),
            gaps.alias("gaps"),
        )

    return base.select(
        *UNIT,
        F.inline(
            F.array(
                side("baseline", "b_days", "baseline_start", "baseline_end"),
                side("current", "c_days", "observation_start", "observation_end"),
            )
        ),
    )


def coverage_totals(completeness: DataFrame) -> DataFrame:
    return completeness.groupBy("experiment_id", "period").agg(
        F.sum("expected_days").alias("expected_unit_days"),
        F.sum("observed_days").alias("observed_unit_days"),
        F.count_if(F.col("observed_days") == 0).alias("units_without_period"),
        (F.sum("missing_count") == 0).alias("complete"),
    )


def adherence_issues(panel: DataFrame, specs: DataFrame) -> DataFrame:
    """Row issues of day and treatment: outside the windows, contaminated, wrongly (un)treated."""
    rows = with_period(panel.filter("usable"), specs)
    should = (F.col("period") == "current") & F.coalesce(F.col("assigned") == "treatment", F.lit(False))
    outside = F.col("period").isNull()
    issues = issue_list(
        code(outside, "outside_preregistered_windows"),
        code(~outside & F.col("contaminated"), "contamination_detected"),
        code(~outside & (F.col("applied") != should), "treatment_contamination"),
    )
    return rows.select("row_id", *UNIT, F.explode(issues).alias("code"))


def frozen_baseline_issues(panel: DataFrame, specs: DataFrame, frozen: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Panel baseline mean against the frozen mean, equal within 1e-9 relative or 1e-12 absolute."""
    means = (
        with_period(panel.filter("usable AND assigned IS NOT NULL"), specs)
        .filter("period = 'baseline'")
        .groupBy(*UNIT)
        .agg(*[F.avg(m).alias(m) for m in metrics])
    )
    observed = unpivot_metrics(means, UNIT, metrics).withColumnRenamed("value", "observed")
    expected = unpivot_metrics(frozen, UNIT, metrics).withColumnRenamed("value", "expected")
    gap = F.abs(F.col("observed") - F.col("expected"))
    close = gap <= F.greatest(1e-9 * F.greatest(F.abs("observed"), F.abs("expected")), F.lit(1e-12))
    return (
        expected.join(observed, [*UNIT, "metric"])
        .filter(F.col("observed").isNotNull() & ~close)
        .select(*UNIT, "metric", _r12(F.col("expected")).alias("expected"), _r12(F.col("observed")).alias("observed"))
    )


def maturity(specs: DataFrame) -> DataFrame:
    """Maturity of each experiment's data; ``as_of`` and ``now`` are inputs, never the clock.

    ``data_as_of`` is a day (complete through it) or an instant with offset.
    """
    text, zone = F.col("data_as_of"), F.col("source_timezone")
    is_day = text.rlike(r"^\d{4}-\d{2}-\d{2}$")
    instant = F.when(~is_day, text.try_cast("timestamp"))
    local = wall_in(instant, zone)
    end = F.col("observation_end")
    covers = F.when(is_day, text.try_cast("date") >= end).otherwise(local >= F.date_add(end, 1).cast("timestamp_ntz"))
    now = F.col("now_utc").cast("timestamp_ntz")
    today = F.convert_timezone(F.lit("UTC"), zone, now).cast("date")
    future = F.when(is_day, text.try_cast("date") >= today).otherwise(utc_wall(instant) > now)
    issues = issue_list(
        code(F.col("analysis_as_of") <= end, "observation_not_mature"),
        code(zone.isNotNull() & ~covers, "data_as_of_before_observation_end"),
        code(zone.isNotNull() & future, "data_as_of_in_future"),
    )
    return specs.select("experiment_id", issues.alias("issues"))


def unit_changes(panel: DataFrame, assignments: DataFrame, specs: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Unit means before and after, for units that have both."""
    rows = with_period(panel.filter("usable"), specs).filter("period IS NOT NULL")
    aggs = [
        F.avg(F.when(F.col("period") == p, F.col(m))).alias(f"{m}__{p}") for m in metrics for p in ("baseline", "current")
    ]
    wide = rows.groupBy(*UNIT).agg(*aggs).join(assignments, UNIT)
    entries = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"), F.col(f"{m}__baseline").alias("before"), F.col(f"{m}__current").alias("after")
            )
            for m in metrics
        ]
    )
    long = wide.select(*UNIT, "pair_id", "group", F.inline(entries)).filter("before IS NOT NULL AND after IS NOT NULL")
    return long.withColumn("change", F.col("after") - F.col("before"))


def estimates(changes: DataFrame, specs: DataFrame) -> DataFrame:
    """Arms, difference-in-differences, standard error, interval, detectable effect.

    The standard error is unpaired for randomised designs and of pair differences for matched ones.
    """

    def arm(group: str, name: str) -> Column:
        return F.when(F.col("group") == group, F.col(name))

    keys = ["experiment_id", "metric"]
    per = changes.groupBy(*keys).agg(
        *[
            agg
            for g, s in (("treatment", "t"), ("control", "c"))
            for agg in (
                F.count(arm(g, "change")).alias(f"{s}_units"),
                F.avg(arm(g, "before")).alias(f"{s}_before"),
                F.avg(arm(g, "after")).alias(f"{s}_after"),
                F.var_samp(arm(g, "change")).alias(f"{s}_var"),
            )
        ]
    )
    pairs = (
        changes.filter("pair_id IS NOT NULL")
        .groupBy(*keys, "pair_id")
        .agg(F.max(arm("treatment", "change")).alias("t"), F.max(arm("control", "change")).alias("c"))
        .filter("t IS NOT NULL AND c IS NOT NULL")
        .groupBy(*keys)
        .agg(F.var_samp(F.col("t") - F.col("c")).alias("pair_var"), F.count("*").alias("pairs"))
    )
    z = specs.select("experiment_id", "design", "alpha", "mde_value", "mde_scale").withColumn(
        "z", normal_quantile(1 - F.col("alpha") / 2)
    )
    joined = per.join(pairs, keys, "left").join(z, "experiment_id")
    matched = F.col("design") == "matched_page_did"
    enough = F.when(matched, F.col("pairs") >= 2).otherwise((F.col("t_units") >= 2) & (F.col("c_units") >= 2))
    variance = F.when(matched, F.col("pair_var") / F.col("pairs")).otherwise(
        F.col("t_var") / F.col("t_units") + F.col("c_var") / F.col("c_units")
    )
    t_change, c_change = (_r12(F.col(f"{s}_after") - F.col(f"{s}_before")) for s in ("t", "c"))
    base = _r12(F.col("c_before"))
    staged = joined.withColumns(
        {
            "did": t_change - c_change,
            "se": F.when(enough, F.sqrt(variance)),
            "mde_units": F.when(F.col("mde_scale") == "absolute", F.col("mde_value")).otherwise(
                F.when(base != 0, F.col("mde_value") * F.abs(base))
            ),
        }
    ).withColumn("half", F.col("z") * F.col("se"))
    return staged.select(
        *keys,
        "t_units",
        "c_units",
        _r12(F.col("t_before")).alias("treatment_baseline"),
        _r12(F.col("t_after")).alias("treatment_current"),
        t_change.alias("treatment_change"),
        base.alias("control_baseline"),
        _r12(F.col("c_after")).alias("control_current"),
        c_change.alias("control_change"),
        _r12(F.col("did")).alias("did"),
        F.when(base != 0, _r12(F.col("did") / F.abs(base))).alias("relative_did"),
        _r12(F.col("se")).alias("standard_error"),
        _r12(F.col("did") - F.col("half")).alias("ci_lower"),
        _r12(F.col("did") + F.col("half")).alias("ci_upper"),
        _r12(F.col("half")).alias("half_width"),
        F.when(F.col("se").isNotNull(), F.when(matched, F.col("pairs")).otherwise(F.col("t_units") + F.col("c_units")))
        .otherwise(F.lit(0))
        .cast("bigint")
        .alias("inference_units"),
        _r12(F.col("mde_units")).alias("mde_in_metric_units"),
        F.coalesce(F.col("half") <= F.col("mde_units"), F.lit(False)).alias("precision_sufficient"),
    )


def guardrail_results(estimated: DataFrame, guardrails: DataFrame) -> DataFrame:
    """``guardrails``: ``experiment_id, metric, direction, threshold``; NULL result = not estimable."""
    did = F.col("did")
    passed = F.when(F.col("direction") == "non_decrease", did >= -F.col("threshold")).otherwise(
        did <= F.col("threshold")
    )
    return guardrails.join(estimated.select("experiment_id", "metric", "did"), ["experiment_id", "metric"], "left").select(
        "experiment_id", "metric", "direction", "threshold", "did", passed.alias("passed")
    )


def eligibility(specs: DataFrame, estimated: DataFrame, guarded: DataFrame, issues: DataFrame) -> DataFrame:
    """What may be claimed, with ordered reasons. ``issues``: ``experiment_id, code`` of all checks."""
    codes = issues.groupBy("experiment_id").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    rails = guarded.groupBy("experiment_id").agg(
        F.count_if(~F.col("passed")).alias("breached"), F.count_if(F.col("passed").isNull()).alias("not_estimable")
    )
    main = specs.join(
        estimated.withColumnRenamed("metric", "primary_metric"), ["experiment_id", "primary_metric"], "left"
    )
    joined = main.join(codes, "experiment_id", "left").join(rails, "experiment_id", "left")
    none = F.array().cast("array<string>")
    reasons = F.array_distinct(
        F.concat(
            F.when(F.col("artifact_passed").isNull(), F.array(F.lit("artifact_verification_missing"))).otherwise(none),
            F.coalesce("codes", none),
            issue_list(
                code(F.col("did").isNull(), "primary_metric_not_estimable"),
                code(F.col("standard_error").isNull(), "confidence_interval_not_estimable"),
                code(~F.coalesce("precision_sufficient", F.lit(False)), "mde_precision_not_met"),
                code(F.coalesce("breached", F.lit(0)) > 0, "guardrail_breached"),
                code(F.coalesce("not_estimable", F.lit(0)) > 0, "guardrail_not_estimable"),
            ),
        )
    )
    failed = F.coalesce(~F.col("artifact_passed"), F.lit(False))
    all_reasons = F.when(failed, F.array(F.lit("artifact_verification_failed"))).otherwise(reasons)
    verdict = (
        F.when(failed, F.lit("implementation-failed"))
        .when(F.size(all_reasons) > 0, F.lit("inconclusive"))
        .otherwise(F.lit("eligible_incremental"))
    )
    up = F.col("direction") == "increase"
    point = F.coalesce(F.when(up, F.col("did") > 0).otherwise(F.col("did") < 0), F.lit(False))
    interval = F.coalesce(F.when(up, F.col("ci_lower") > 0).otherwise(F.col("ci_upper") < 0), F.lit(False))
    return joined.select(
        "experiment_id",
        verdict.alias("eligibility"),
        all_reasons.alias("reasons"),
        point.alias("point_supports"),
        interval.alias("interval_supports"),
        ((verdict == "eligible_incremental") & point & interval).alias("incremental_positive_allowed"),
    )


def measurement_contract(frozen: DataFrame, supplied: DataFrame, registered: DataFrame) -> DataFrame:
    """Measurement issues per experiment: sources, changed fields, metric mapping, day boundaries.

    ``frozen`` and ``supplied`` have one row per source; a NULL supplied field was not supplied. Only
    collection facts may change after preregistration.
    """
    keys = ["experiment_id", "source_id"]
    fixed = ("source_kind", "source_timezone", "metrics", "attribution_model")
    facts = (
        "data_as_of", "finality", "preliminary", "row_limit_hit", "pagination_complete",
        "sampling_rate", "thresholding", "declared_quality",
    )
    new = supplied.select(*keys, *[F.col(c).alias(f"n_{c}") for c in (*fixed, *facts)], F.lit(True).alias("is_supplied"))
    both = frozen.withColumn("is_frozen", F.lit(True)).join(new, keys, "full")
    kept = F.col("is_frozen").isNotNull()
    changed = [
        code(kept & F.col(f"n_{c}").isNotNull() & ~F.col(f"n_{c}").eqNullSafe(F.col(c)), f"source_{c}_changed_after_preregistration")
        for c in fixed
    ]
    merged = both.select(
        *keys,
        *fixed,
        *[F.coalesce(F.col(f"n_{c}"), F.col(c)).alias(c) for c in facts],
        kept.alias("kept"),
        F.when(~kept, F.array(F.lit("source_added_after_preregistration"))).otherwise(issue_list(*changed)).alias("drift"),
    )
    analytics = F.col("source_kind").rlike("(?i)ga4|analytics")
    business = F.col("source_kind").rlike("(?i)ga4|analytics|crm")
    own = issue_list(
        code(F.col("source_timezone").isNull(), "source_timezone_missing"),
        *collection_issues(),
        F.when(F.col("sampling_rate").isNull(), code(analytics, "sampling_rate_missing")).when(
            F.col("sampling_rate") < 1, F.lit("sampling_applied")
        ),
        F.when(F.col("thresholding").isNull(), code(analytics, "thresholding_status_missing")).when(
            F.col("thresholding"), F.lit("thresholding_applied")
        ),
        code(business & F.col("attribution_model").isNull(), "attribution_model_missing"),
        quality_issue(),
    )
    none = F.array().cast("array<string>")
    per_source = merged.select(
        "experiment_id", F.explode(F.concat("drift", F.when(F.col("kept"), own).otherwise(none))).alias("code")
    )
    held = merged.filter("kept")
    mapped = held.select("experiment_id", "source_id", F.explode(F.split("metrics", ",")).alias("metric"))
    counted = mapped.groupBy("experiment_id", "metric").agg(F.count("*").alias("sources"))
    status = counted.join(registered.withColumn("is_registered", F.lit(True)), ["experiment_id", "metric"], "full")
    mapping = status.select(
        "experiment_id",
        F.when(F.col("sources").isNull(), F.lit("metric_source_mapping_missing"))
        .when(F.col("is_registered").isNull(), F.lit("metric_source_mapping_unregistered"))
        .when(F.col("sources") > 1, F.lit("metric_source_mapping_ambiguous"))
        .alias("code"),
    ).filter("code IS NOT NULL")
    zones = (
        held.groupBy("experiment_id")
        .agg(
            F.count("*").alias("n"),
            F.countDistinct("source_timezone").alias("z"),
            F.count_if(F.col("source_timezone").isNull()).alias("unknown"),
        )
        .filter("n > 1 AND (z <> 1 OR unknown > 0)")
        .select("experiment_id", F.lit("source_day_boundary_mismatch").alias("code"))
    )
    codes = per_source.unionByName(mapping).unionByName(zones)
    per = codes.groupBy("experiment_id").agg(F.array_sort(F.collect_set("code")).alias("issues"))
    everyone = registered.select("experiment_id").distinct()
    return everyone.join(per, "experiment_id", "left").select(
        "experiment_id",
        F.coalesce("issues", none).alias("issues"),
        F.when(F.coalesce(F.size("issues"), F.lit(0)) > 0, F.lit("inconclusive"))
        .otherwise(F.lit("complete"))
        .alias("status"),
    )


def replay_differences(
    stored: DataFrame, recomputed: DataFrame, keys: Sequence[str], exact: Sequence[str], numeric: Sequence[str]
) -> DataFrame:
    """Rows whose stored values differ from a recomputation, with the differing field names."""
    left = stored.select(*keys, *[F.col(c).alias(f"s_{c}") for c in (*exact, *numeric)], F.lit(1).alias("_s"))
    right = recomputed.select(*keys, *[F.col(c).alias(f"r_{c}") for c in (*exact, *numeric)], F.lit(1).alias("_r"))
    both = left.join(right, list(keys), "full")
    differs = [code(~F.col(f"s_{c}").eqNullSafe(F.col(f"r_{c}")), c) for c in exact]
    for c in numeric:
        s, r = F.col(f"s_{c}"), F.col(f"r_{c}")
        near = F.abs(s - r) <= F.greatest(1e-12 * F.greatest(F.abs(s), F.abs(r)), F.lit(1e-12))
        differs.append(code(~F.coalesce(near, s.isNull() & r.isNull()), c))
    fields = (
        F.when(F.col("_s").isNull(), F.array(F.lit("not_stored")))
        .when(F.col("_r").isNull(), F.array(F.lit("not_recomputed")))
        .otherwise(issue_list(*differs))
    )
    return both.select(*keys, fields.alias("differing")).filter(F.size("differing") > 0)


def detectability(estimated: DataFrame, specs: DataFrame) -> DataFrame:
    """Power at the registered effect; "no detectable change" needs power and an interval around zero."""
    joined = estimated.join(specs.select("experiment_id", "alpha"), "experiment_id")
    powered = joined.withColumn(
        "power", two_sided_power(F.col("mde_in_metric_units"), F.col("standard_error"), F.col("alpha"))
    )
    around_zero = (F.col("ci_lower") <= 0) & (F.col("ci_upper") >= 0)
    return powered.select(
        "experiment_id",
        "metric",
        "standard_error",
        "mde_in_metric_units",
        "power",
        F.coalesce((F.col("power") >= POWER_NEEDED) & around_zero, F.lit(False)).alias("no_change_supported"),
    )
