"""Report sink and site trees on disk."""

import hashlib
import os

from pyspark.sql import functions as F

from searchloom.sources import files


def stamps(path):
    return {f"{d}/{n}": os.stat(f"{d}/{n}").st_mtime_ns for d, _, names in os.walk(path) for n in names if n.startswith("part-")}


def report(spark, rows):
    return spark.createDataFrame(rows, "property_id string, country string, clicks double")


def test_reports_of_several_properties_share_a_path(spark, tmp_path):
    path = str(tmp_path / "r")
    read = lambda: sorted(tuple(r) for r in spark.read.schema("country string, clicks double, property_id string").json(path).select("property_id", "country", "clicks").collect())
    a, b = [("a", "x", 1.0), ("a", "y", None)], [("b", "x", 2.0)]
    assert files.write_report(report(spark, a), path, ["property_id"]) == 1
    assert files.write_report(report(spark, b), path, ["property_id"]) == 1
    assert read() == sorted(a + b, key=str)
    before = stamps(path)
    # the same again, in another order, writes nothing
    assert files.write_report(report(spark, (a + b)[::-1]), path, ["property_id"]) == 0
    assert stamps(path) == before
    # one property anew: the other stays as it is
    new = [("b", "x", 3.0), ("b", "z", 4.0)]
    assert files.write_report(report(spark, a + new), path, ["property_id"]) == 1
    assert read() == sorted(a + new, key=str)
    kept = {k: v for k, v in before.items() if "property_id=a" in k and "_manifest" not in k}
    assert kept.items() <= stamps(path).items()


def test_a_run_that_stopped_before_its_manifest_is_done_again(spark, tmp_path):
    path = str(tmp_path / "r")
    rows = report(spark, [("a", "x", 1.0)])
    rows.write.partitionBy("property_id").json(path)
    assert files.write_report(rows, path, ["property_id"]) == 1
    assert files.write_report(rows, path, ["property_id"]) == 0


def test_a_null_property_is_a_partition_of_its_own(spark, tmp_path):
    rows = report(spark, [(None, "x", 1.0), ("p", "x", 2.0)])
    path = str(tmp_path / "r")
    assert files.write_report(rows, path, ["property_id"], fmt="parquet") == 2
    assert files.write_report(rows, path, ["property_id"], fmt="parquet") == 0


def test_site_tree_round_trip(spark, tmp_path, monkeypatch):
    content = {"index.html": b"<p>home</p>", "d/about.html": b"x" * 3000, "d/e/logo.png": bytes(range(256)), "empty.css": b""}
    root = str(tmp_path / "site (1)")
    frame = spark.createDataFrame([(k, bytearray(v)) for k, v in content.items()], "path string, content binary")
    assert files.write_tree(frame, root) == 4
    # Spark's file sources pass over files without a byte
    want = {k: (len(v), hashlib.sha256(v).hexdigest()) for k, v in content.items() if v}
    assert {r["path"]: (r["length"], r["sha256"]) for r in files.scan_tree(spark, root).collect()} == want
    # large files are streamed, with the same digests
    monkeypatch.setattr(files, "CELL_BYTES", 100)
    assert {r["path"]: (r["length"], r["sha256"]) for r in files.scan_tree(spark, root).collect()} == want
    found = {r["url"]: r["kind"] for r in files.tree_urls(files.scan_tree(spark, root), F.lit("https://h")).collect()}
    assert found == {"https://h/": "page", "https://h/d/about.html": "page", "https://h/d/e/logo.png": "asset"}
