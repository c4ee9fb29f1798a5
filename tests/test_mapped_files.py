"""Review, baseline and panel files: mapped headers, refused ones, and what is wrong with rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from searchloom.operators import experiment
from searchloom.operators.gates import GateError
from searchloom.operators.landing_pages import UrlRules, url_map, with_landing_pages
from searchloom.sources import experiment_files, review_files
from searchloom.sources.review_files import ReviewColumns, read_review_csv

RULES = UrlRules("https://shop.example.com/")
SEARCH = ReviewColumns(
    "search", {"date": "Day", "landing_page": "Landing page", "country": "Country", "device": "Device"}, {"clicks": "Clicks", "impressions": "Impr."},
    source_timezone="America/Los_Angeles", values={"country": {"deu": "germany"}},
)


def file(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text, encoding="utf-8")
    return str(folder)


def test_review_rows(spark, tmp_path):
    file(tmp_path, "a.csv", "﻿Day,landing-page,COUNTRY,Device,Clicks,Impr.,CTR\n2026-06-01,/product/?utm_source=x, DEU ,Mobile,\"1,200\",2000,9%\n,,,,,5,\n")
    file(tmp_path, "b.csv", "Impr.;Clicks;Device;Country;Landing page;Day\n-1;x;;fr;mailto:a@b.c;2026-06-02T05:00:00Z\n7;;tablet;fr;/old-product/;bad\n1;2;3;4;/x;2026-06-03;extra\n")
    pairs = spark.createDataFrame([("/old-product", "/product/")], "source string, target string")
    got = {r["file"][-5] + str(k): r for k, r in enumerate(read_review_csv(spark, str(tmp_path), SEARCH, RULES, "UTC", pairs).orderBy("file", "at").collect())}
    a, blank, odd, mapped, long = got["a0"], got["a1"], got["b2"], got["b3"], got["b4"]
    assert (a["day"], a["landing_page"], a["country"], a["device"], a["clicks"], a["impressions"]) == (dt.date(2026, 6, 1), "https://shop.example.com/product", "germany", "mobile", 1200, 2000)
    assert (a["explicitly_mapped"], a["url_reason"], a["issues"], a["leads"]) == (False, None, [], None)
    assert (blank["day"], blank["temporal_grain"], blank["url_reason"], blank["clicks"], blank["issues"]) == (None, "unknown", "blank_landing_page", None, [])
    assert (odd["day"], odd["temporal_grain"], odd["url_reason"]) == (dt.date(2026, 6, 2), "timestamp", "invalid_landing_page")
    assert odd["issues"] == ["clicks_not_a_finite_number", "impressions_negative"]
    assert (mapped["landing_page"], mapped["explicitly_mapped"], mapped["issues"]) == ("https://shop.example.com/product", True, ["date_invalid"])
    assert long["issues"] == ["row_longer_than_header"]
    with pytest.raises(GateError, match="clicks_not_a_finite_number x 1"):
        review_files.require_clean(read_review_csv(spark, str(tmp_path), SEARCH, RULES, "UTC", pairs))


@pytest.mark.parametrize(
    "header",
    ["Day,Landing page,Country,Device,Clicks", "Day,Landing page,Country,Device,Clicks,Impr.,Region", "Day,Landing page,Country,Device,Clicks,Impr.,Search-Term",
     "Day,day,Landing page,Country,Device,Clicks,Impr.", "Day,Landing page,Country,Device,Clicks,Impr.,E-Mail", "Day,Landing page,Country,Device,Clicks,Impr.,"],
)
def test_refused_headers(spark, tmp_path, header):
    file(tmp_path, "good.csv", "Day,Landing page,Country,Device,Clicks,Impr.\n")
    path = file(tmp_path, "x.csv", header + "\n" + "," * header.count(",") + "\n")
    with pytest.raises(ValueError):
        read_review_csv(spark, path, SEARCH, RULES, "UTC")


def test_url_rules_and_maps(spark):
    rows = spark.createDataFrame([("HTTP://Shop.example.com:80//a//b/?q=1#f",), ("b/",), ("  ",), (None,), ("javascript:x",), ("https://shop.example.com",)], "u string")
    spelled = lambda **kw: [r["landing_page"] for r in with_landing_pages(rows, "u", UrlRules("https://shop.example.com/c/", **kw)).collect()]
    # the scheme is forced first, and 80 is no default of https
    assert spelled() == ["https://shop.example.com:80/a/b", "https://shop.example.com/c/b", None, None, None, "https://shop.example.com/"]
    assert spelled(force_https=False, trailing_slash="preserve", strip_query=False, strip_fragment=False)[0] == "http://shop.example.com/a/b/?q=1#f"
    assert spelled(trailing_slash="add")[:2] == ["https://shop.example.com:80/a/b/", "https://shop.example.com/c/b/"]
    pairs = lambda *p: spark.createDataFrame(list(p), "source string, target string")
    assert url_map(pairs(("/a", "/b"), ("/a/", "/b")), RULES).count() == 1
    for bad in ([("/a", "/b"), ("/a/", "/c")], [("mailto:x", "/b")], [("/a", "tel:1")]):
        with pytest.raises(GateError):
            url_map(pairs(*bad), RULES)


def test_baseline_files_with_and_without_days(spark, tmp_path):
    specs = spark.createDataFrame([("e", dt.date(2026, 1, 1), dt.date(2026, 1, 2))], "experiment_id string, baseline_start date, baseline_end date")
    text = "page,date,clicks\na,2026-01-01,1\na,2026-01-02,\"3,000\"\nb,2026-01-01,5\nc,2026-01-03,x\n ,2026-01-01,2\n"
    read = experiment_files.read_baseline_csv(spark, file(tmp_path / "d", "x.csv", text), ["clicks"], "page").withColumn("experiment_id", F.lit("e"))
    assert {(r["unit_id"], tuple(r["issues"])) for r in read.where(F.size("issues") > 0).collect()} == {("c", ("missing_or_invalid_metric:clicks",)), ("", ("missing_unit_id",))}
    units = {r["unit_id"]: r for r in experiment.baseline_units(read, specs, ["clicks"]).collect()}
    assert (units["a"]["clicks"], units["a"]["issue"], units["b"]["issue"], units["c"]["issue"]) == (1500.5, None, "missing_baseline_dates", "date_outside_baseline")
    text = "page;clicks;pair_id\na;1;p\nb;2;p\nb;3;p\nc;4;\n"
    read = experiment_files.read_baseline_csv(spark, file(tmp_path / "u", "x.csv", text), ["clicks"], "page", matched=True).withColumn("experiment_id", F.lit("e"))
    assert [r["unit_id"] for r in read.where(F.array_contains("issues", "missing_pair_id")).collect()] == ["c"]
    units = {r["unit_id"]: (r["clicks"], r["expected_days"], r["issue"]) for r in experiment.baseline_units(read, specs, ["clicks"]).collect()}
    assert units == {"a": (1.0, 1, None), "b": (2.5, 1, "duplicate_unit_date"), "c": (4.0, 1, None)}
    for bad in ("page,date\na,2026-01-01\n", "page,clicks,clicks\na,1,2\n"):
        with pytest.raises(ValueError):
            experiment_files.read_baseline_csv(spark, file(tmp_path / f"bad{len(bad)}", "x.csv", bad), ["clicks"], "page")


def test_panel_files(spark, tmp_path):
    assigned = spark.createDataFrame([("e", "a", "treatment"), ("e", "b", "control")], "experiment_id string, unit_id string, group string")
    text = "page,date,group,clicks,treatment_applied,note\na,2026-01-05,Treated,1,yes,x\na,2026-01-05,test,2,no,\nb,2026-01-05,test,n/a,,\n,2026-01-05,test,1,1,\nz,2026-13-05,test,1,1,\n"
    read = experiment_files.read_panel_csv(spark, file(tmp_path / "p", "x.csv", text), ["clicks"], "page").withColumn("experiment_id", F.lit("e"))
    assert experiment_files.contamination_observable(read)
    got = [(r["unit_id"], r["usable"], r["issues"]) for r in experiment.typed_panel(read, assigned, ["clicks"]).orderBy("row_id").collect()]
    assert got == [
        ("a", True, []), ("a", False, ["duplicate_unit_date"]), ("b", True, ["assignment_mismatch", "missing_or_invalid_metric:clicks", "invalid_treatment_flag"]),
        ("", False, ["missing_unit_id"]), ("z", False, ["invalid_dimension"]),
    ]
    bare = experiment_files.read_panel_csv(spark, file(tmp_path / "q", "x.csv", "page,date,group,clicks\na,2026-01-05,test,1\n"), ["clicks"], "page")
    assert not experiment_files.contamination_observable(bare)
    with pytest.raises(ValueError):
        experiment_files.read_panel_csv(spark, file(tmp_path / "r", "x.csv", "page,date,clicks\na,2026-01-05,1\n"), ["clicks"], "page")
