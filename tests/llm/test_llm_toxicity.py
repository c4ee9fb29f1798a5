import math
import re
import zlib
from collections import Counter

import numpy as np
from llm_data import ODD, empty, odd

from searchloom.llm import toxicity
from searchloom.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    """Area under the curve and precision on documents whose labels were not learned; needs more rows than the smallest tables have."""
    sf_dir = "/root/testdata/sf0.1"
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = QUERIES["op3_toxicity"](spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0.0 <= r["score"] <= 1.0 and r["predicted"] == (r["score"] >= 0.7)
    tested = sorted((r["score"], toxic[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in toxic)
    bad = [i for i, t in enumerate(tested) if t[1] == 1]
    good = len(tested) - len(bad)
    auc = (sum(bad) - len(bad) * (len(bad) - 1) / 2) / (len(bad) * good)
    caught = sum(t[2] for t in tested if t[1] == 1) / len(bad)
    wrong = sum(t[2] for t in tested if t[1] == 0) / good
    assert auc > 0.97 and caught > 0.85 and wrong < 0.005, (auc, caught, wrong)


def test_odd_rows(spark):
    model = toxicity.train(odd(spark), spark.createDataFrame([(4, 1), (4, 0), (6, 0), (7, None), (None, 1), (99, 1)], "doc_id long, toxic int"))
    got = toxicity.scores(odd(spark), model).collect()
    assert len(got) == len(ODD) and all(0.0 <= r["score"] <= 1.0 for r in got)
    blank = {r["score"] for r in got if r["doc_id"] in (1, 2, 3)}
    assert len(blank) == 1
    assert toxicity.scores(empty(spark), model).count() == 0
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.train(odd(spark), none).score("any text") < 1e-9
    assert toxicity.train(empty(spark), none).score(None) < 1e-9


def test_sample_is_bounded_and_leaves_the_held_out_part_alone(spark):
    docs = spark.range(900).selectExpr("id doc_id", "concat('text ', id) text")
    labels = spark.range(900).selectExpr("id doc_id", "cast(id % 2 as int) toxic")
    full = toxicity.labelled_sample(docs, labels, "doc_id", "text", "toxic", 10_000)
    ids = {int(r["body"].split()[1]) for r in full.collect()}
    assert ids == {i for i in range(900) if zlib.crc32(str(i).encode()) % 3 != 1}
    assert toxicity.labelled_sample(docs, labels, "doc_id", "text", "toxic", 50).count() == 50


def test_ngrams_are_whole_and_bounded_by_spaces():
    assert [len(g) for g in toxicity.ngrams("Ab, 1c")] == [4, 3, 2, 1]  # of " ab c "
    assert [g.tolist() for g in toxicity.ngrams("AB c")] == [g.tolist() for g in toxicity.ngrams("ab-2-C!")]
    assert not list(toxicity.ngrams(None)) or all(len(g) == 0 for g in toxicity.ngrams(None))


WORD64 = (1 << 64) - 1


def plain_grams(text):
    """Counts of hashed n-grams with Python's own integers, one n-gram at a time."""
    letters = "".join(c if c.isalpha() or (c.isalnum() and not re.match(r"[\W\d_]", c)) else " " for c in (text or "").lower())
    plain = f" {' '.join(re.sub(r'[\W\d_]+', ' ', letters).split(' ')).strip(' ')} " if text else " "
    counts = Counter()
    for n in range(3, 8):
        for i in range(len(plain) - n + 1):
            value = 0
            for c in plain[i : i + n]:
                value = (value * 0x9E3779B97F4A7C15 + ord(c) + 1) & WORD64
            counts[((value ^ (value >> 31)) * 0xD6E8FEB86659FD93 & WORD64) >> (64 - toxicity.BITS)] += 1
    return counts


def plain_scores(docs, labels, features):
    """Scores of all ``docs`` (id, text) by counting, choosing and fitting without Spark; labels: (id, toxic)."""
    known = {}
    for i, t in labels:
        if i is not None and t is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            known[i] = max(known.get(i, 0), t)
    grams = [plain_grams(t) for _, t in docs]
    learn = [(g, known[i]) for (i, _), g in zip(docs, grams) if i in known]
    sums = [Counter(), Counter()]
    for g, toxic in learn:
        sums[toxic].update(g)
    clean, toxic = (float(sum(s.values())) for s in sums)
    rank = []
    for h in set(sums[0]) | set(sums[1]):
        c0, c1 = sums[0][h], sums[1][h]
        expected = (c0 + c1) * toxic / (clean + toxic)
        gap = c1 - expected
        clear = (gap if gap > 0 else -gap / 2) / math.sqrt(expected + 1)
        ratio = math.log((c1 + 1) / (toxic + (1 << toxicity.BITS)) / ((c0 + 1) / (clean + (1 << toxicity.BITS))))
        rank.append((-round(clear, 9), h, ratio))
    chosen = {h: (k, ratio) for k, (_, h, ratio) in enumerate(sorted(rank)[:features])}

    def row(g):
        out = np.zeros(len(chosen))
        for h, n in g.items():
            if h in chosen:
                out[chosen[h][0]] = math.log1p(1000.0 * n / max(sum(g.values()), 50)) * chosen[h][1]
        return out

    x, y = np.array([row(g) for g, _ in learn]), np.array([t for _, t in learn], float)
    x1 = np.hstack([x, np.ones((len(x), 1))])
    weight, mean, square = (np.zeros(x1.shape[1]) for _ in range(3))
    keep = np.append(np.ones(x.shape[1]), 0)
    for step in range(1, 251):
        slope = x1.T @ (1 / (1 + np.exp(-x1 @ weight)) - y) / len(y) + 0.3 * keep * weight / len(y)
        mean += 0.1 * (slope - mean)
        square += 0.01 * (slope**2 - square)
        weight -= 0.02 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return [1 / (1 + math.exp(-(row(g) @ weight[:-1] + weight[-1]))) for g in grams]


def test_scores_against_plain_python(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if r["text"] is None or len(r["text"]) < 4000]
    labels = [(r["doc_id"], r["toxic"]) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()]
    frame = spark.createDataFrame([*docs, (None, None), (-1, "")], "doc_id long, text string")
    model = toxicity.train(frame, spark.createDataFrame(labels, "doc_id long, toxic int"), features=400)
    got = Counter((r["doc_id"], round(r["score"], 3)) for r in toxicity.scores(frame, model).collect())
    want = plain_scores([*docs, (None, None), (-1, "")], labels, 400)
    exact = {(i, round(s + e, 3)) for (i, _), s in zip([*docs, (None, None), (-1, "")], want) for e in (-2e-4, 0, 2e-4)}
    assert set(got) <= exact and sum(got.values()) == len(docs) + 2
    assert len({s for _, s in got}) > 20
