"""Whitening against a plain covariance and a library's eigenvectors."""

import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from vector_data import ODD, random_rows, table

from searchloom.llm import whitening


def clean(triples):
    kept = [(i, [math.floor(64 * x) + 1_000_000 for x in v]) for i, v, _ in triples if v and all(x is not None and math.isfinite(x) for x in v)]
    lengths = Counter(len(v) for _, v in kept)
    length = max(lengths, key=lambda n: (lengths[n], n), default=0)
    return [(i, v) for i, v in kept if len(v) == length]


def check(spark, triples, components=16):
    rows = clean(triples)
    fit = sorted({tuple(v) for _, v in rows})
    n, d = len(fit), len(fit[0])
    sums = [sum(v[k] for v in fit) for k in range(d)]
    centred = np.array([[float(Fraction(n * v[k] - sums[k], n)) for k in range(d)] for v in fit])
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = [k for k in range(min(d, components)) if values[k] > 1e-11 * values[0]]
    got = whitening.whitened(table(spark, triples)).collect()
    assert len(got) == len(rows) * len(kept)
    deviation = Counter((i, sum((n * x - s) ** 2 for x, s in zip(v, sums))) for i, v in rows)
    assert Counter((r["vec_id"], r["deviation"]) for r in got if r["component"] == 1) == deviation
    assert {r["n"] for r in got} == {n}
    assert max(r["identity_error"] for r in got) < 1e-9 and len({r["identity_error"] for r in got}) == 1
    signs = {}
    for k in kept:
        mine = [r for r in got if r["component"] == k + 1]
        assert all(abs(r["explained"] / (values[k] / np.trace(covariance)) - 1) < 1e-9 for r in mine)
        want = sorted((str(i), float((np.array([x - s / n for x, s in zip(v, sums)])) @ vectors[:, k] / math.sqrt(values[k]))) for i, v in rows)
        for sign in (1, -1):
            seen = sorted((str(r["vec_id"]), sign * r["whitened"]) for r in mine)
            if all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-6 for a, b in zip(seen, want)):
                signs[k] = sign
    assert set(signs) == set(kept)


def test_against_a_plain_covariance(spark):
    check(spark, random_rows(300, length=20, seed=4))
    check(spark, random_rows(200, length=3, seed=5, spread=0.1))


def test_odd_rows(spark):
    check(spark, ODD)


def test_fewer_vectors_than_dimensions(spark):
    check(spark, random_rows(6, length=12, seed=6))


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None, 0)], [(1, [1.0, 2.0], 0)], [(1, [1.0, 2.0], 0)] * 3):
        assert whitening.whitened(table(spark, rows)).collect() == []


def test_deviation_is_exact_or_refused():
    parts = whitening.Components(3_000_000_001, np.array([5]), np.array([1]), np.eye(1), np.ones(1), 1.0)
    assert parts.deviation(np.array([[6]])) == [3_000_000_000**2]
    with pytest.raises(OverflowError):
        np.array(parts.deviation(np.array([[10**6]])), dtype=np.int64)


@given(st.integers(1, 30), st.integers(0, 10**6), st.sampled_from(["spread", "equal", "flat", "clusters"]))
@settings(max_examples=60, deadline=None)
def test_eigenvectors(n, seed, kind):
    rng = np.random.default_rng(seed)
    q, _ = np.linalg.qr(rng.normal(size=(n, n)))
    values = {
        "spread": 10.0 ** rng.uniform(-6, 3, n), "equal": np.full(n, 3.0), "flat": np.where(np.arange(n) < n // 2, rng.uniform(1, 2, n), 0),
        "clusters": rng.integers(1, 3, n) + 1e-9 * rng.normal(size=n),
    }[kind]
    a = q @ np.diag(values) @ q.T
    a = (a + a.T) / 2
    found, vectors = whitening.eigen(a)
    size = np.abs(values).max(initial=1e-300)
    assert np.abs(found - np.sort(np.linalg.eigvalsh(a))[::-1]).max() < 1e-12 * size
    assert np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-12
    assert np.abs(a @ vectors - vectors * found).max() < 1e-11 * size


def test_polar_factor_is_the_sign():
    rng = np.random.default_rng(8)
    q, _ = np.linalg.qr(rng.normal(size=(12, 12)))
    values = np.array([5, 1, 0.1, 1e-6, 1e-10, 3, -4, -1, -0.3, -1e-5, -1e-9, -2.0])
    sign = whitening.polar_sign(q @ np.diag(values) @ q.T)
    assert np.abs(sign - q @ np.diag(np.sign(values)) @ q.T).max() < 1e-5
