"""Leaves of documents and tables, and their differences."""

from pyspark.sql import functions as F

from searchloom.operators import replay


def test_leaves_of_documents(spark):
    docs = spark.createDataFrame([("e", '{"a": {"b": [1, {"c": "x"}], "d": {}}, "n": null, "k": 2.5, "t": true}'), ("f", "3"), ("g", None)], "experiment_id string, text string")
    got = {(r["experiment_id"], r["path"]): (r["text"], r["number"]) for r in replay.document_leaves(docs.withColumn("v", F.parse_json("text")), "v").collect()}
    assert {k: v[0] for k, v in got.items()} == {
        ("e", "a.b.0"): "1", ("e", "a.b.1.c"): "x", ("e", "a.d"): "{}", ("e", "n"): None, ("e", "k"): "2.5", ("e", "t"): "true", ("f", ""): "3",
    }
    assert got[("e", "a.b.0")][1] == 1.0 and got[("e", "k")][1] == 2.5


def test_differences(spark):
    leaf = "experiment_id string, path string, text string, number double"
    stored = spark.createDataFrame([("e", "a", "1.0", 1.0), ("e", "b", "2", 2.0), ("e", "c", "x", None), ("e", "d", "y", None), ("e", "n", None, None), ("e", "big", "1e15", 1e15)], leaf)
    again = spark.createDataFrame([("e", "a", "1", 1.0 + 1e-13), ("e", "b", "2.1", 2.1), ("e", "c", "z", None), ("e", "m", "9", 9.0), ("e", "big", "1e15", 1e15 + 100), ("f", "a", None, None)], leaf)
    got = {(r["path"], r["issue"], r["stored"], r["recomputed"]) for r in replay.leaf_differences(stored, again).collect()}
    assert got == {("b", "changed", "2", "2.1"), ("c", "changed", "x", "z"), ("d", "not_recomputed", "y", None), ("m", "not_stored", None, "9")}


def test_leaves_of_tables(spark):
    rows = spark.createDataFrame([("e", "clicks", 1.5, 3, "t")], "experiment_id string, metric string, mean double, n int, label string")
    got = {(r["path"], r["text"], r["number"]) for r in replay.table_leaves(rows, "balance", ["metric"], ["mean", "n", "label"]).collect()}
    assert got == {("balance.clicks.mean", "1.5", 1.5), ("balance.clicks.n", "3", 3.0), ("balance.clicks.label", "t", None)}
