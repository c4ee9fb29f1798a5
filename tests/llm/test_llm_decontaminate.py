import hashlib
import re

import pytest
from llm_data import ODD, empty, odd

from searchloom.llm import decontaminate
from searchloom.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def naive(text, items, size=10):
    words = words_of(text)
    hit, found = set(), set()
    for item_id, item in items:
        own = words_of(item)
        for i in range(max(1, len(own) - size + 1)) if own else ():
            window = own[i : i + size]
            for p in range(len(words) - len(window) + 1):
                if words[p : p + len(window)] == window:
                    hit.update(range(p, p + len(window)))
                    found.add(str(item_id) if item_id is not None else "null")
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    got = {r["doc_id"]: r for r in QUERIES["op10_decontamination"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    # a naive search of all windows is slow: words of windows that cannot be there are skipped by a join of strings
    lined = {i: " " + " ".join(words_of(t)) + " " for i, t in items}
    for d in docs:
        text = " " + " ".join(words_of(d["text"])) + " "
        near = [(i, t) for i, t in items if any(" " + " ".join(w) + " " in text for w in windows(lined[i].split()))]
        r = got[d["doc_id"]]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) == naive(d["text"], near)
        assert r["contaminated"] == (r["n_hit"] > 0)


def windows(words, size=10):
    return [words[i : i + size] for i in range(max(1, len(words) - size + 1))] if words else []


ITEMS = [
    (1, "one two three"), (2, "ONE, two! Three one two three one two three one two three one"), (3, None), (4, ""), (5, "tail"),
    (5, "tail"), (6, "wörds and"), (None, "line line"), (7, "nowhere to be found at all in any of these short texts"),
]


@pytest.mark.parametrize("block", [100_000, 2])
def test_odd_rows_in_one_block_and_in_many(spark, block):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.contamination(odd(spark), items, block=block).select("doc_id", "s.*").collect()
    want = sorted((str(i), *naive(t, ITEMS)) for i, t, _ in ODD if i != 7)
    assert sorted((str(r[0]), *r[1:]) for r in got if r[0] != 7) == want
    kept = decontaminate.keep_clean(odd(spark), items, block=block)
    assert kept.columns == odd(spark).columns
    clean = sorted(str(i) for i, t, _ in ODD if naive(t if i != 7 else "tail", ITEMS)[1] == 0)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == clean


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.contamination(empty(spark), items).count() == 0
    got = decontaminate.contamination(odd(spark), none).select("s.n_hit", "s.n_words").collect()
    assert len(got) == len(ODD) and not any(r["n_hit"] for r in got) and max(r["n_words"] for r in got) > 1000
