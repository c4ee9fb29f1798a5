"""Redirects by doubling and click depth by buckets against plain walks."""

import random
import re

import pytest
from pyspark.sql import functions as F

from searchloom.operators import graph, planning


def walked(hops, url, limit=10):
    seen, at = [url], url
    while at in hops:
        at = hops[at]
        if at in seen:
            return at, len(seen), "loop"
        seen.append(at)
    return at, len(seen) - 1, "too_long" if len(seen) - 1 > limit else "resolved"


@pytest.mark.parametrize("seed", range(3))
def test_redirects_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    # every URL but a few has one target: trees that run into ends, and trees that run into circles
    hops = {f"u{i:02}": f"u{rng.randrange(70):02}" for i in rng.sample(range(70), (20, 55, 68)[seed])}
    frame = spark.createDataFrame(list(hops.items()), "url string, location string")
    got = {r["url"]: (r["final_url"], r["hops"], r["state"]) for r in graph.resolve_redirects(frame).collect()}
    assert got == {u: walked(hops, u) for u in hops}


def test_long_chains_take_few_rounds(spark, monkeypatch):
    n, rounds = 10_000, []
    cut = graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df, name: rounds.append(name) or cut(df, name))
    chain = spark.range(n).select(F.format_string("c%05d", "id").alias("url"), F.format_string("c%05d", F.col("id") + 1).alias("location"))
    got = graph.resolve_redirects(chain).where("url IN ('c00000', 'c09000', 'c09999')").collect()
    assert {(r["url"], r["final_url"], r["hops"], r["state"]) for r in got} == {
        ("c00000", f"c{n}", n, "too_long"), ("c09000", f"c{n}", 1000, "too_long"), ("c09999", f"c{n}", 1, "resolved"),
    }
    assert len(rounds) <= 18


def test_a_long_circle_with_a_long_way_in(spark):
    n = 300
    hops = {f"c{i:03}": f"c{(i + 1) % n:03}" for i in range(n)} | {f"t{i:03}": f"t{i + 1:03}" for i in range(99)} | {"t099": "c150", "a": "t050"}
    frame = spark.createDataFrame(list(hops.items()), "url string, location string")
    got = {r["url"]: (r["final_url"], r["hops"], r["state"]) for r in graph.resolve_redirects(frame).collect()}
    assert got == {u: walked(hops, u) for u in hops}


def test_paths_of_reported_chains(spark):
    hops = {"a": "b", "b": "c", "c": "d", "x": "y", "y": "x", "s": "s"}
    frame = spark.createDataFrame(list(hops.items()), "url string, location string")
    ends = graph.resolve_redirects(frame).where("url IN ('a', 'x', 's')")
    got = {}
    for r in graph.redirect_paths(frame, ends).orderBy("url", "step").collect():
        got.setdefault(r["url"], []).append(r["at"])
    assert got == {"a": ["a", "b", "c", "d"], "x": ["x", "y", "x"], "s": ["s", "s"]}
    assert graph.redirect_paths(frame, ends.limit(0)).count() == 0


def test_depth_of_random_graphs(spark):
    rng = random.Random(2)
    edges = {(rng.choice("st"), f"p{rng.randrange(40)}", f"p{rng.randrange(40)}") for _ in range(110)}
    frame = spark.createDataFrame(sorted(edges), "site_id string, source string, target string")
    roots = spark.createDataFrame([("s", "p0"), ("t", "p1"), ("t", "p2")], "site_id string, url string")
    want, front, depth = {}, {("s", "p0"), ("t", "p1"), ("t", "p2")}, 0
    while front:
        want |= dict.fromkeys(front, depth)
        front, depth = {(s, b) for s, a, b in edges if (s, a) in front} - set(want), depth + 1
    assert {(r["site_id"], r["url"]): r["depth"] for r in graph.click_depth(frame, roots).collect()} == want


def test_a_round_moves_the_found_pages_only(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, columns in (("round_edges", "site_id, source, target"), ("round_pages", "site_id, url, depth")):
            kind = ", ".join(f"{c.strip()} {'int' if 'depth' in c else 'string'}" for c in columns.split(","))
            key = columns.split(", ")[1]
            spark.createDataFrame([("s", "a", 1 if "depth" in columns else "b")], kind).write.bucketBy(8, "site_id", key).option("path", str(tmp_path / name)).saveAsTable(name)
        newest = spark.table("round_pages").where("depth = 1").select("site_id", F.col("url").alias("source"))
        found = spark.table("round_edges").join(newest, ["site_id", "source"]).select("site_id", F.col("target").alias("url"))
        plan = graph.next_pages(found, spark.table("round_pages"), 8)._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"\bExchange\b", plan)) == 1, plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS round_edges")
        spark.sql("DROP TABLE IF EXISTS round_pages")


def test_inventory_with_links_and_depth(spark):
    pages = spark.createDataFrame([("s", "https://h/l?a=1&b=2"), ("s", "https://h/l?b=2&a=1"), ("s", "https://h/l?b=2&a=1"), ("s", "https://h/l?c=")], "site_id string, url string")
    reach = spark.createDataFrame([("s", "https://h/l?a=1&b=2", 3, 4), ("s", "https://h/l?b=2&a=1", 2, None)], "site_id string, url string, inbound bigint, depth int")
    got = {r["parameters"]: (r["spellings"], r["inbound"], r["depth"]) for r in planning.parameter_inventory(pages, reach).collect()}
    assert got == {"a=1&b=2": (2, 5, 4), "c=": (1, 0, None)}
