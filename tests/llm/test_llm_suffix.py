import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from llm_data import ODD, empty, odd

from searchloom.llm import suffix_dedup as sd
from searchloom.llm.queries import QUERIES
from searchloom.llm.suffixes import common_prefixes, smaller_than_next, suffix_order, words_at


def naive(texts, window):
    raw = [(t or "").encode() for t in texts]
    times = Counter(r[i : i + window] for r in raw for i in range(len(r) - window + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - window + 1):
            if times[r[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        runs = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(r)))
        kept = bytes(c for c, g in zip(r, gone) if not g)
        out.append((len(r), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def results(frame):
    rows = frame.collect()
    return Counter((r["doc_id"], r["n_bytes"], sum(r["removed"][1::2]) - sum(r["removed"][::2]), len(r["removed"]) // 2, r["kept_sha256"]) for r in rows)


def test_suffix_order_and_prefixes():
    rng = random.Random(3)
    for n, letters in [(1, "a"), (50, "a"), (300, "ab"), (500, "abc\x00ÿ"), (400, "xyz")]:
        raw = "".join(rng.choice(letters) for _ in range(n)).encode("latin-1")
        text = np.frombuffer(raw, np.uint8)
        assert smaller_than_next(text).tolist() == [raw[i:] < raw[i + 1 :] for i in range(n)]
        order = suffix_order(text, 10**4)
        if b"\x00" not in raw:  # beyond the end stand zeros, which only matter beside zeros
            assert order.tolist() == sorted(range(n), key=lambda i: raw[i:])
        assert sorted(order.tolist()) == list(range(n))
        shared = common_prefixes(order, words_at(text), 24)
        for a, b, got in zip(order[:-1].tolist(), order[1:].tolist(), shared[1:].tolist()):
            if max(a, b) + 24 <= n:
                assert got == next((k for k in range(24) if raw[a + k] != raw[b + k]), 24)


def corpus(rng):
    passages = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(20, 120))) for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.4 else "".join(rng.choice("abcdefghé") for _ in range(rng.randint(0, 60))) for _ in range(4)]
        texts.append("".join(parts))
    return texts + [texts[0], texts[1], "ab" * 100, "zab" + "ab" * 60, "q" * 300, "0123456" * 20 + "9", "", None, "short", "short"]


@pytest.mark.parametrize("group", [2000, 2])
@pytest.mark.parametrize("window", [40, 64])
def test_random_corpus_with_and_without_crowded_names(spark, group, window):
    texts = corpus(random.Random(window))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = results(sd.repeated_bytes(frame, window=window, group=group))
    assert got == Counter((i, *w) for i, w in enumerate(naive(texts, window)))


def test_long_texts_are_hashed_in_slices(spark, monkeypatch):
    rng = random.Random(1)
    raw = bytes(rng.choice(b"abcd") for _ in range(5000))
    whole = sd.window_grams(np.frombuffer(raw, np.uint8), 400)
    monkeypatch.setattr(sd, "SLICE", 700)
    sliced = sd.window_grams(np.frombuffer(raw, np.uint8), 400)
    assert (sliced[0] == whole[0]).all() and (sliced[1] == whole[1]).all() and len(whole[0]) == 4601


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = Counter((d["doc_id"], *w) for d, w in zip(docs, naive([d["text"] for d in docs], 400)))
    got = QUERIES["op4_suffix_dedup"](spark, sf_dir).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want
    assert sum(r["n_removed"] for r in got) > 0


def test_odd_rows(spark):
    want = Counter((i, *w) for (i, _, _), w in zip(ODD, naive([t for _, t, _ in ODD], 400)))
    assert results(sd.repeated_bytes(odd(spark))) == want
    assert sd.repeated_bytes(empty(spark)).count() == 0
    out = sd.remove_repeats(odd(spark))
    assert out.columns == odd(spark).columns and out.count() == len(ODD)
    left = {r["doc_id"]: r["text"] for r in out.collect()}
    assert left[4] == "one" and left[6] in ("", "same id, other text " * 20) and left[1] is None


def test_remove_repeats_keeps_columns_of_any_name(spark):
    """Columns named as those the operator uses, and names with dots."""
    twice = "a passage that stands in two texts " * 20
    rows = [(i, text, f"b{i}", f"d{i}", f"x{i}") for i, text in enumerate([twice + "left", "right" + twice, None, "", "alone"])]
    frame = spark.createDataFrame(rows, "id long, `the.text` string, _body string, _digest string, text string")
    got = {r["id"]: tuple(r) for r in sd.remove_repeats(frame, text="the.text").collect()}
    assert {i: r[2:] for i, r in got.items()} == {i: (f"b{i}", f"d{i}", f"x{i}") for i in range(5)}
    kept = [got[i][1] for i in range(5)]
    assert kept[2:] == [None, "", "alone"]
    # a passage repeats inside itself as well, so all its windows go
    assert kept[0].endswith("left") and len(kept[0]) < 400 and kept[1].startswith("right") and len(kept[1]) < 400
