import re
from collections import Counter

from llm_data import ODD, empty, odd

from searchloom.llm import quality
from searchloom.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def naive(text):
    words = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_query_against_brute_force(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = QUERIES["op1_quality_rules"](spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        want = naive(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r["base_failed"] == failed and r["kept"] == (not failed and not r["host_rejected"])


def test_odd_rows(spark):
    got = quality.measures_by_id(odd(spark)).select("doc_id", "m.*").collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    want = [(i, *naive(t)) for i, t, _ in ODD]
    assert sorted([tuple(r)[:6] for r in got], key=key) == sorted(want, key=key)
    assert quality.measures_by_id(empty(spark)).count() == 0
    assert quality.keep_good(empty(spark)).count() == 0
    kept = quality.keep_good(odd(spark))
    assert kept.columns == odd(spark).columns
    assert kept.count() == 0  # all are short or repeat themselves


def test_bad_host_takes_its_good_documents_along(spark):
    good = " ".join(f"w{i}" for i in range(80))
    rows = [(i, "too short", "bad") for i in range(195)] + [(900, good, "bad")]
    rows += [(1000 + i, good + f" {i}", "fine") for i in range(200)] + [(2000, good, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r["doc_id"] for r in quality.keep_good(docs).collect()} == {*range(1000, 1200), 2000}


def test_beta_prior_by_moments():
    # two hosts of 100 documents with rates 0.2 and 0.4: mean 0.3, variance 0.01
    mean, weight = quality.beta_prior(200, 60, 20 * 20 / 100 + 40 * 40 / 100, (2.0, 1000.0))
    assert abs(mean - 0.3) < 1e-12 and abs(weight - 20.0) < 1e-9
    assert quality.beta_prior(0, 0, 0.0, (2.0, 1000.0)) == (0.0, 1000.0)
