import math
from statistics import NormalDist

from searchloom.functions.normal import normal_cdf, normal_quantile, two_sided_power

NORMAL = NormalDist()


def test_cdf_over_the_whole_range(spark):
    points = [i / 16 for i in range(-16 * 37, 16 * 37 + 1)] + [-1e-12, 1e-9, 1.9999999, 2.0, 2.0000001, float("inf"), float("-inf")]
    rows = spark.createDataFrame([(x,) for x in points], "x double").select("x", normal_cdf("x").alias("p")).collect()
    assert len(rows) == len(points)
    for x, p in rows:
        true = 0.5 * math.erfc(-x / math.sqrt(2))
        assert abs(p - true) <= 1e-15 + 2e-12 * true, (x, p, true)
    odd = spark.createDataFrame([(None,), (float("nan"),)], "x double").select(normal_cdf("x").alias("p")).collect()
    assert [r["p"] for r in odd] == [None, None]


def test_quantile_over_the_whole_range(spark):
    small = [m * 10.0**-e for e in range(1, 300, 7) for m in (1.0, 2.3, 4.9)]
    points = [i / 997 for i in range(1, 997)] + small + [0.5, 0.25, 0.975, 1 - 1e-9, 1 - 2.0**-53]
    rows = spark.createDataFrame([(p,) for p in points], "p double").select("p", normal_quantile("p").alias("x")).collect()
    for p, x in rows:
        true = NORMAL.inv_cdf(p)
        assert abs(x - true) <= 1e-12 * max(1.0, abs(true)), (p, x, true)
    outside = [(0.0,), (1.0,), (-0.1,), (1.5,), (float("nan"),), (None,)]
    assert [r["x"] for r in spark.createDataFrame(outside, "p double").select(normal_quantile("p").alias("x")).collect()] == [None] * 6


def test_power_against_the_distribution(spark):
    cases = [(m, s, a) for m in (1e-6, 0.3, 1.0, 2.8, 9.0, 1e9) for s in (1e-9, 0.5, 1.0, 40.0) for a in (0.001, 0.05, 0.5, 0.999)]
    rows = spark.createDataFrame(cases, "m double, s double, a double").select("*", two_sided_power("m", "s", "a").alias("p")).collect()
    for m, s, a, p in rows:
        cut, shift = NORMAL.inv_cdf(1 - a / 2), m / s
        true = min(1.0, NORMAL.cdf(-cut - shift) + 1 - NORMAL.cdf(cut - shift))
        assert abs(p - true) <= 2e-12, (m, s, a, p, true)
    nan = float("nan")
    empty = [(None, 1.0, 0.05), (1.0, None, 0.05), (1.0, 1.0, None), (0.0, 1.0, 0.05), (-1.0, 1.0, 0.05), (1.0, -1.0, 0.05), (nan, 1.0, 0.05), (1.0, nan, 0.05), (1.0, 1.0, 1.0), (1.0, 1.0, nan)]
    got = spark.createDataFrame([*empty, (1.0, 0.0, 0.05)], "m double, s double, a double").select(two_sided_power("m", "s", "a").alias("p")).collect()
    assert [r["p"] for r in got] == [None] * len(empty) + [1.0]


def test_no_python_worker(spark):
    plan = spark.range(3).select(two_sided_power("id", "id", "id"))
    assert "Python" not in plan._jdf.queryExecution().toString()
