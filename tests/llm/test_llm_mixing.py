import re
from collections import Counter, defaultdict

from llm_data import ODD, empty, odd

from searchloom.llm import mixing
from searchloom.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def naive_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    budget, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = budget - sum(fixed.values())
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            return fixed | {s: left * weight[s] / total for s in free}
        fixed |= {s: 2.0 * sizes[s] for s in over}


def check(rows, docs):
    """rows: (doc_id, size, source_size, target, taken) of the operator; docs: (doc_id, text, source)."""
    sizes, want = Counter(), Counter()
    for i, text, source in docs:
        n = len(WORD.findall(text or ""))
        sizes[source] += n
        want[(i, n, source)] += 1
    targets = naive_targets({s: sizes[s] for s in sizes})
    assert Counter((r["doc_id"], r["size"], r["source"]) for r in rows) == want
    taken = defaultdict(int)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - targets[r["source"]]) < 1e-5 * max(1, targets[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= 0.5 + 1e-6


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()
    source = {d["doc_id"]: d["source"] for d in docs}
    got = [r.asDict() | {"source": source[r["doc_id"]]} for r in QUERIES["op6_mixing"](spark, sf_dir).collect()]
    check(got, [tuple(d) for d in docs])
    again = QUERIES["op6_mixing"](spark, sf_dir).collect()
    assert {(r["doc_id"], r["taken"]) for r in again} == {(r["doc_id"], r["taken"]) for r in got}


def test_odd_rows(spark):
    check(mixing.mixture(odd(spark)).collect(), ODD)
    assert mixing.mixture(empty(spark)).count() == 0 and mixing.mixed(empty(spark)).count() == 0


def test_mixed_rows_are_whole_and_come_near_the_plan(spark):
    plan = mixing.mixture(odd(spark)).collect()
    out = mixing.mixed(odd(spark))
    assert out.columns == odd(spark).columns
    rows = out.collect()
    originals = Counter(tuple(r) for r in odd(spark).collect())
    assert all(tuple(r) in originals for r in rows)
    want, edge, got = Counter(), defaultdict(list), Counter()
    for r in plan:
        want[r["source"]] += r["taken"]
        if 0 < r["part"] < r["size"]:
            edge[r["source"]].append(r)
    for r in rows:
        got[r["source"]] += len(WORD.findall(r["text"] or ""))
    for s in want:
        assert len(edge[s]) <= 1
        assert abs(got[s] - want[s]) <= sum(r["size"] for r in edge[s]) / 2
    assert any(edge.values())


def test_many_rows_of_one_source_are_cut_into_buckets(spark):
    rows = spark.range(3000).selectExpr("id doc_id", "'s' source", "id % 7 size", "cast(null as long) _tie")
    out = mixing.taken_words(rows, rows, (1,), 1.25, 2.0, "seed", bucket_rows=10).collect()
    assert abs(sum(r["taken"] for r in out) - 1.25 * sum(r["size"] for r in out)) <= 0.5
    assert {r["taken"] / r["size"] for r in out if r["size"] and r["part"] in (0, r["size"])} == {1.0, 2.0}


def test_rows_without_id_are_spread_over_the_order(spark):
    rows = spark.createDataFrame([(None, f"text number {i} " * (i % 9 + 1), "s") for i in range(400)], "doc_id long, text string, source string")
    sized = rows.select(*mixing._sized(rows, "doc_id", "text", "source"))
    places = sized.select(mixing.seeded_order(sized["doc_id"], sized["_tie"], "mix-1").alias("o")).distinct().count()
    assert places == 400
    plan = mixing.mixture(rows).collect()
    again = mixing.mixture(rows.repartition(7)).collect()
    key = lambda r: (r["size"], r["taken"])
    assert sorted(map(key, plan)) == sorted(map(key, again)) and abs(sum(r["taken"] for r in plan) - 1.5 * sum(r["size"] for r in plan)) <= 0.5
