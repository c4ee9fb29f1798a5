"""Bucketed forms against plain windows, with one key holding a third of the rows."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from searchloom.functions.dates import wall_in
from searchloom.operators import experiment, planning
from searchloom.operators.skew import bucketed_lag, bucketed_rank, tree_digest


@pytest.fixture(scope="module")
def rows(spark):
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 17).cast("string")))
    return spark.range(5000).select(key.alias("k"), F.expr("(id * 7919) % 5003").alias("at"), F.col("id").alias("v"))


@pytest.mark.parametrize("width", [1, 37, 10_000])
def test_rank_and_lag_match_plain_windows(rows, width):
    w = Window.partitionBy("k").orderBy("at")
    bucket = F.floor(F.col("at") / width)
    ranked = bucketed_rank(rows, ["k"], ["at"], bucket).select("k", "at", "rank", "n")
    plain = rows.select("k", "at", F.row_number().over(w).cast("bigint").alias("rank"), F.count("*").over(Window.partitionBy("k")).alias("n"))
    assert ranked.exceptAll(plain).count() == 0 and ranked.count() == 5000
    lagged = bucketed_lag(rows, ["k"], ["at"], bucket, "v", "p").select("k", "at", "p")
    assert lagged.exceptAll(rows.select("k", "at", F.lag("v").over(w).alias("p"))).count() == 0


def test_digest_ignores_partitioning_and_sees_changes(rows):
    shaped = rows.withColumn("d", F.sha2(F.col("v").cast("string"), 256))
    one = tree_digest(shaped.repartition(9), ["k"], "at", "d", "digest")
    assert one.exceptAll(tree_digest(shaped.repartition(2), ["k"], "at", "d", "digest")).count() == 0
    changed = shaped.withColumn("d", F.when(F.col("v") == 3, F.lit("x")).otherwise(F.col("d")))
    assert one.exceptAll(tree_digest(changed, ["k"], "at", "d", "digest")).count() == 1


def test_quantiles_interpolate(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4)], "k string, value double")
    assert planning.quantiles(df, ["k"], "value", {"q": 0.75}).first().q == 3.25


def test_wall_clock_does_not_follow_the_session(spark):
    df = spark.createDataFrame([("1999-01-01T05:00:00Z",)], "t string")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            day = df.select(wall_in(F.to_timestamp("t"), "America/Los_Angeles").cast("date").cast("string")).first()[0]
            assert day == "1998-12-31"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_quantiles_of_one_large_group_are_exact(spark):
    rng = random.Random(4)
    rows = [("hot", rng.choice([-1, 1]) * rng.random() ** 3) for _ in range(3000)] + [("hot", 0.0)] * 50
    rows += [("one", 7.0), ("two", 1.0), ("two", 2.0), (None, 5.0), ("hot", None)]
    frame = spark.createDataFrame(rows, "k string, v double")
    points = {"q": 0.25, "m": 0.5, "p": 0.75, "lo": 0.0, "hi": 1.0}
    got = {r.k: r for r in planning.quantiles(frame, ["k"], "v", points).collect()}
    assert set(got) == {"hot", "one", "two", None}
    for key, row in got.items():
        values = sorted(v for k, v in rows if k == key and v is not None)
        assert row.samples == len(values)
        for name, p in points.items():
            at = (len(values) - 1) * p
            low, high = values[math.floor(at)], values[math.ceil(at)]
            assert abs(row[name] - (low * (1 - at % 1) + high * (at % 1))) < 1e-12


def test_blank_units_take_no_part_in_finding_first_rows(spark):
    rows = [(i, "e", "", None, "treatment") for i in range(400)] + [(500, "e", "u", "2024-01-01", "treatment"), (501, "e", "u", "2024-01-01", "treatment")]
    raw = spark.createDataFrame(rows, "row_id long, experiment_id string, unit_id string, d string, group_text string")
    raw = raw.selectExpr("row_id", "experiment_id", "unit_id", "cast(d as date) day", "group_text", "'1' m", "'no' contaminated_text", "'yes' applied_text")
    units = spark.createDataFrame([("e", "u", "treatment")], "experiment_id string, unit_id string, group string")
    got = {r.row_id: (r.usable, list(r.issues)) for r in experiment.typed_panel(raw, units, ["m"]).collect()}
    assert got[500] == (True, []) and got[501] == (False, ["duplicate_unit_date"])
    assert all(got[i] == (False, ["missing_unit_id"]) for i in range(400))
