"""Sharding: the permutation, the law of rows, and whole rows written and read back."""

import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_data import ODD, SCHEMA, empty, odd, rows

from searchloom.llm import sharding
from searchloom.llm.sharding import Shuffle


@given(st.integers(1, 700), st.text("ab1", max_size=3))
@settings(max_examples=30, deadline=None)
def test_shuffle_is_a_permutation_with_an_inverse(n, seed):
    shuffle = Shuffle(n, seed)
    places = [shuffle.place(i) for i in range(n)]
    assert sorted(places) == list(range(n))
    assert [shuffle.number(p) for p in places] == list(range(n))


def test_shuffle_of_large_numbers():
    shuffle = Shuffle(10**15 + 7)
    for number in (0, 1, 12345678901234, 10**15 + 6):
        assert shuffle.number(shuffle.place(number)) == number
    with pytest.raises(ValueError):
        shuffle.place(10**15 + 7)


@pytest.mark.parametrize("n", [1, 2, 3, 24, 25, 1000, 10**12 + 39])
def test_columns_follow_the_same_law(spark, n):
    shuffle = Shuffle(n)
    numbers = sorted({0, n // 2, n - 1, *range(min(n, 40))})
    frame = spark.createDataFrame([(i,) for i in numbers], "number long")
    got = {r["number"]: r["place"] for r in shuffle.placed(frame).collect()}
    assert got == {i: shuffle.place(i) for i in numbers}


def test_stragglers_go_round_until_they_are_in(spark, monkeypatch):
    # 12 pairs of digits for 11 numbers, and one walk in the expression, send some rows round the loop
    walked = Shuffle.walked
    monkeypatch.setattr(Shuffle, "walked", lambda self, number, walks=1: walked(self, number, 1))
    for seed in "abcd":
        shuffle = Shuffle(11, seed)
        frame = spark.createDataFrame([(i,) for i in range(11)], "number long")
        assert {r["number"]: r["place"] for r in shuffle.placed(frame).collect()} == {i: shuffle.place(i) for i in range(11)}


def held(found, docs, shards):
    counts = Counter(r["shard"] for r in found)
    assert max(counts.values(), default=0) - min((counts.get(s, 0) for s in range(shards)), default=0) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(counts[s]))
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == want


def test_numbers_follow_ids_and_shards_follow_numbers(spark):
    found = sharding.sharded(odd(spark), shards=5).collect()
    held(found, ODD, 5)
    shuffle = Shuffle(len(ODD))
    for r in found:
        place = shuffle.place(r["number"])
        assert (r["shard"], r["slot"], r["place"]) == (place % 5, place // 5, place)
    ids = [r["doc_id"] for r in sorted(found, key=lambda r: r["number"])]
    assert ids == sorted(ids, key=lambda i: (i is None, i or 0))
    assert sharding.sharded(empty(spark)).count() == 0


def test_layout_does_not_matter(spark):
    docs = rows([(i % 90, f"text {i % 45}", "s") for i in range(300)])
    state = lambda n: Counter(tuple(r) for r in sharding.sharded(spark.createDataFrame(docs, SCHEMA).repartition(n)).collect())
    assert state(1) == state(7)


def test_one_text_for_all_rows_is_dealt_evenly(spark):
    docs = [(None, "same", "s")] * 400
    held(sharding.sharded(spark.createDataFrame(rows(docs), SCHEMA)).collect(), docs, 24)


def test_whole_rows_written_and_read_back(spark):
    docs = odd(spark)
    path = sharding.write_shards(docs, shards=3)
    parts = [sharding.read_shard(docs, path, s) for s in range(3)]
    assert all(p.columns == docs.columns for p in parts)
    got = [p.collect() for p in parts]
    assert Counter(r for p in got for r in p) == Counter(docs.collect())
    by_place = {(r["shard"], r["slot"]): r["doc_id"] for r in sharding.sharded(docs, shards=3).collect()}
    for s, part in enumerate(got):
        assert [r["doc_id"] for r in part] == [by_place[(s, k)] for k in range(len(part))]
