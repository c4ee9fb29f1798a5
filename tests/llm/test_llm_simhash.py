import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from llm_data import ODD, empty, odd

from searchloom.llm import simhash
from searchloom.llm.components import smallest_reachable
from searchloom.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def naive_print(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def naive_components(prints, distance=2):
    """prints: value -> smallest id; gives value -> smallest id reachable."""
    values = list(prints)
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= distance:
                root[find(a)] = find(b)
    best = {}
    for v in values:
        if prints[v] is not None:
            best[find(v)] = min(best.get(find(v), prints[v]), prints[v])
    return {v: best.get(find(v)) for v in values}


def expected(pairs):
    least = {}
    for doc_id, text in pairs:
        fp = naive_print(text)
        known = [x for x in (least.get(fp), doc_id) if x is not None]
        least[fp] = min(known, default=None)
    component = naive_components(least)
    return Counter((i, naive_print(t), component[naive_print(t)]) for i, t in pairs)


def test_query_against_all_pairs(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op7_simhash"](spark, sf_dir).collect()
    assert Counter((r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in got) == expected(docs)
    assert all(re.fullmatch("[0-9a-f]{16}", r["fingerprint"]) for r in got)


def test_odd_rows(spark):
    got = simhash.near_duplicates(odd(spark)).collect()
    assert Counter((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in got) == expected([(i, t) for i, t, _ in ODD])
    assert simhash.near_duplicates(empty(spark)).count() == 0
    kept = simhash.keep_one(odd(spark))
    assert kept.columns == odd(spark).columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter({None: 1, 1: 1, 4: 1, 5: 1, 6: 2, 7: 1, 8: 1})
    assert simhash.keep_one(empty(spark)).count() == 0


def ball(rng, centre, n, flips):
    out = {centre}
    while len(out) < n:
        v = centre
        for b in rng.sample(range(64), rng.randint(1, flips)):
            v ^= 1 << b
        out.add(v)
    return out


def signed(v):
    return v - (1 << 64) if v >> 63 else v


@pytest.mark.parametrize("blocks", [3, 5])
def test_crowded_blocks_lose_no_link(spark, blocks):
    rng = random.Random(5)
    values = ball(rng, rng.getrandbits(64), 900, 3) | ball(rng, rng.getrandbits(64), 300, 6)
    values |= {rng.getrandbits(64) for _ in range(300)}
    prints = {v: i for i, v in enumerate(sorted(values))}
    frame = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    edges = simhash.links(frame, 2, blocks)
    assert edges.where("bit_count(a ^ b) > 64").count() == 0
    reach = {r["node"]: r["root"] for r in smallest_reachable(edges).collect()}
    want = naive_components({signed(v): signed(v) for v in prints})
    # Hamming distance of signed values is that of their bits, as Python's ints extend the sign
    want = {a: b for a, b in naive_components({v: signed(v) for v in prints}).items()}
    groups = Counter(want.values())
    for v, least in want.items():
        assert reach.get(signed(v), signed(v)) == least or groups[least] == 1
    assert edges.count() < 12 * len(values)


def test_close_pairs_recursion_finds_every_component():
    rng = random.Random(9)
    values = np.array(sorted(ball(rng, 0, 1500, 2)), np.uint64)
    left, right = simhash.close_pairs(values, 2, 2**64 - 1)
    assert (np.bitwise_count(values[left] ^ values[right]) <= 2).all()
    found = {(min(a, b), max(a, b)) for a, b in zip(left.tolist(), right.tolist())}
    a, b = np.triu_indices(len(values), 1)
    near = np.bitwise_count(values[a] ^ values[b]) <= 2
    assert found == set(zip(a[near].tolist(), b[near].tolist()))


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(200)]
    star = [(1000, i) for i in range(1001, 1400)]
    got = {r["node"]: r["root"] for r in smallest_reachable(spark.createDataFrame(path + star, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {i: 1000 for i in range(1000, 1400)}
