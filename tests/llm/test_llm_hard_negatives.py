"""Hard negatives against sorting all scores in plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from vector_data import ODD, random_rows, table

from searchloom.llm import hard_negatives as mining


def brute(triples, positives=5, negatives=3, window=(50, 95)):
    usable = [
        (k, i, n, [math.floor(256 * x) for x in v]) for k, (i, v, n) in enumerate(triples)
        if n is not None and v and all(x is not None and math.isfinite(x) for x in v)
    ]
    lengths = Counter(len(v) for *_, v in usable)
    length = max(lengths, key=lambda n: (lengths[n], n), default=0)
    usable = [(k, i, (n + 1) % 10 if i is not None and i % 7 == 0 else n, v) for k, i, n, v in usable if len(v) == length]
    out = Counter()
    for k, i, n, v in usable:
        if i is None or i % 50:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), j is None, j or 0, m) for h, j, m, w in usable if h != k))
        for score, none, j, _ in [s for s in scored if s[3] == n][:positives]:
            kept = [s for s in scored if s[3] != n and -window[0] * score <= -100 * s[0] <= -window[1] * score][:negatives]
            for rank, (other, no_id, m, _) in enumerate(kept, 1):
                out[(i, None if none else j, rank, None if no_id else m, -score, -other)] += 1
    return out


def found(spark, triples, **more):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = mining.mined(table(spark, triples), F.col("vec_id") % 50 == 0, label=moved, **more)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return Counter(tuple(r) for r in got.collect())


def test_tables_and_planes_give_inner_products():
    rng = np.random.default_rng(5)
    for length, low, high in ((1, -1, 0), (8, -150, 149), (13, -3, 900), (64, 5, 6), (9, -(2**20), 2**20)):
        a, c = rng.integers(low, high + 1, (7, length)), rng.integers(low, high + 1, (11, length))
        planes = mining.planes_for(low, high, length)
        assert (mining.scores(mining.subset_sums(a), mining.plane_bytes(c, planes)) == c @ a.T).all()
    with pytest.raises(ValueError):
        mining.planes_for(-(2**40), 2**40, 64)


def test_against_all_pairs(spark):
    rows = random_rows(420, length=11, labels=4, seed=3)
    want = brute(rows)
    assert len(want) > 60
    assert found(spark, rows) == want
    # blocks and slices of any size give the same rows
    assert found(spark, rows, anchors_at_once=2, slice_rows=37) == want


def test_odd_rows(spark):
    want = brute(ODD)
    assert want
    assert found(spark, ODD) == want
    assert found(spark, ODD, slice_rows=5, anchors_at_once=1) == want
    assert not found(spark, [])
    assert not found(spark, [(50, None, 1), (100, [], None)])
    assert not found(spark, [(50, [1.0, 2.0], 1)])


def test_ties_and_one_large_label(spark):
    rng = random.Random(2)
    rows = [(i, [float(rng.randrange(2)), 1.0, float(rng.randrange(3))], 0 if i % 3 else rng.randrange(4)) for i in range(300)]
    rng.shuffle(rows)
    assert found(spark, rows, slice_rows=20) == brute(rows)


def test_windows_of_zero_and_negative_scores(spark):
    rows = [(50, [1.0, 0.0], 1), (51, [0.0, 1.0], 1), (52, [-1.0, 0.0], 1), (53, [0.0, 2.0], 2), (54, [-0.75, 0.0], 2), (55, [0.0, -1.0], 3)]
    assert found(spark, rows) == brute(rows)
