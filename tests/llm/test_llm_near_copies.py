"""The pipeline's near-duplicate stage against the exact Jaccard similarity of all pairs."""

import random
from collections import Counter

import corpus_pipeline
from llm_data import SCHEMA, empty, odd, rows

from searchloom.llm import near_copies


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def kept_ids(docs, similar=0.8):
    """docs: (id, text); the smallest id of every component over all pairs."""
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= similar * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sorted(least.values())


def test_stage_against_all_pairs(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]
    got = corpus_pipeline.one_of_each(spark, frame, sf_dir)
    assert got.columns == frame.columns
    assert sorted(r["doc_id"] for r in got.collect()) == kept_ids(docs)


def test_edited_copies_and_crowds(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(5000)}"
    docs = []
    for n in (60, 150, 400):
        for _ in range(12):
            base = [word() for _ in range(n)]
            docs.append(base)
            for edits in (1, 2, 3, n // 60, n // 45, n // 35, n // 12):
                copy = list(base)
                for at in rng.sample(range(n), edits):
                    copy[at] = word()
                docs.append(copy)
    crowd = [word() for _ in range(200)]
    docs += [[*crowd[:at], word(), *crowd[at + 1 :]] for at in range(0, 200, 2)]
    # a chain: neighbours are similar, the ends are not
    chain = [word() for _ in range(300)]
    docs += [chain[at : at + 200] for at in range(0, 100, 10)]
    docs = [(i, " ".join(d)) for i, d in enumerate(docs)]
    rng.shuffle(docs)
    frame = spark.createDataFrame(rows([(i, t, "s") for i, t in docs]), SCHEMA)
    got = sorted(r["doc_id"] for r in near_copies.keep_one(frame).collect())
    assert got == kept_ids(docs)
    assert 36 < len(got) < len(docs) / 2


def test_odd_rows(spark):
    kept = near_copies.keep_one(odd(spark))
    assert kept.columns == odd(spark).columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter({None: 1, 1: 1, 4: 1, 5: 1, 6: 2, 7: 1, 8: 1})
    assert near_copies.keep_one(empty(spark)).count() == 0
    nulls = spark.createDataFrame(rows([(None, "a b c d e f g h", "s"), (None, "A b c d e f g h", "s"), (None, " ".join("abcdefgh") + " i", "s")]), SCHEMA)
    assert near_copies.keep_one(nulls).count() == 1
