import datetime as dt

import pytest
from pyspark.sql import functions as F

from searchloom.functions import dates
from searchloom.operators import compare, gates
from searchloom.operators.compare import DateWindow
from searchloom.sources import exports

MAY, JUNE = DateWindow("2026-05-01", "2026-05-31"), DateWindow("2026-06-01", "2026-06-30")
EXPORT = """Date,Page,Country,Device,Clicks,Impressions,CTR,Position
2026-05-05,https://example-industrial.test/products/,DEU,DESKTOP,6,60,99%,5
2026-05-19,https://example-industrial.test/products/,DEU,MOBILE,4,40,99%,5
2026-05-08,https://example-industrial.test/de/,DEU,DESKTOP,3,30,99%,8
2026-05-22,https://example-industrial.test/de/,DEU,MOBILE,1,20,99%,8
2026-06-05,https://example-industrial.test/products/,DEU,DESKTOP,10,100,1%,4
2026-06-19,https://example-industrial.test/products/,DEU,MOBILE,6,60,1%,4
2026-06-08,https://example-industrial.test/de/,DEU,DESKTOP,2,35,1%,7
2026-06-22,https://example-industrial.test/de/,DEU,MOBILE,1,25,1%,7
"""


def _rows(spark, data):
    schema = "day date, page string, query string, country string, device string, clicks double, impressions double, position double"
    return spark.createDataFrame(data, schema).withColumn("property_id", F.lit("p"))


def _read(spark, tmp_path, text):
    path = tmp_path / "export.csv"
    path.write_text(text, encoding="utf-8")
    return exports.read_search_csv(spark, str(path))


def test_shipped_export_recomputes_ratios(spark, tmp_path):
    typed = gates.typed_search_rows(_read(spark, tmp_path, "﻿" + EXPORT))
    assert typed.filter("issue IS NOT NULL").count() == 0
    rows = typed.withColumns({"property_id": F.lit("p"), "query": F.lit("")})
    labelled = compare.label_windows(rows, MAY, JUNE)
    total = compare.add_deltas(compare.overall_metrics(labelled)).first()
    assert (total.baseline_clicks, total.current_clicks) == (14, 19)
    assert total.baseline_ctr == pytest.approx(0.0933333333)
    assert total.current_ctr == pytest.approx(0.0863636364)
    assert total.delta_ctr_points == pytest.approx(-0.69696969)
    pages = {
        r.value: r.delta_clicks
        for r in compare.add_deltas(compare.cohort_metrics(labelled)).filter("dimension = 'page'").collect()
    }
    assert pages == {"https://example-industrial.test/products/": 6, "https://example-industrial.test/de/": -1}


def test_chinese_headers_and_separators(spark, tmp_path):
    text = '日期;查询;热门网页;点击次数;展示次数;平均排名\n2026年6月1日;泵;/a;"1,234";"5 000";3.5\n;;;;;\n'
    row = gates.typed_search_rows(_read(spark, tmp_path, text)).collect()
    assert len(row) == 1 and (row[0].clicks, row[0].impressions, row[0].position) == (1234, 5000, 3.5)
    assert row[0].day == dt.date(2026, 6, 1)


def test_long_and_short_rows_are_reported(spark, tmp_path):
    text = "Date,Clicks,Impressions\n2026-06-01,1,2\n2026-06-02,1,2,9\n2026-06-03,1,2,9,9\n2026-06-04,1\n"
    issues = [r.row_issue for r in _read(spark, tmp_path, text).orderBy("date").collect()]
    assert issues == [None, "row_longer_than_header", "row_longer_than_header", "row_shorter_than_header"]


def test_each_file_is_read_by_its_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,Clicks,Impressions\n2026-01-01,1,10\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("\n\ufeffDate;Impressions;Clicks;Page\n2026-01-02;20;2;/x\n", encoding="utf-8")
    rows = exports.read_search_csv(spark, str(tmp_path)).orderBy("date").collect()
    assert [(r.date, r.clicks, r.impressions, r.page, r.row_issue) for r in rows] == [
        ("2026-01-01", "1", "10", None, None), ("2026-01-02", "2", "20", "/x", None),
    ]
    (tmp_path / "c.csv").write_text("Date,Clicks,Impressions,Owner\n", encoding="utf-8")
    with pytest.raises(ValueError, match="unknown column"):
        exports.read_search_csv(spark, str(tmp_path))


def test_quotes_line_breaks_and_quoted_headers(spark, tmp_path):
    text = '"Date","Query",Clicks,"Impressions"\n2026-06-01,"say ""hi"", now",1,2\n2026-06-02,"two\nlines, one field",3,4\n2026-06-03,"a,b"\n'
    rows = _read(spark, tmp_path, text).orderBy("date").collect()
    assert [(r.query, r.clicks, r.impressions, r.row_issue) for r in rows] == [
        ('say "hi", now', "1", "2", None), ("two\nlines, one field", "3", "4", None), ("a,b", None, None, "row_shorter_than_header"),
    ]
    assert exports.split_header('"Date, local";Clicks;"a;b"') == (";", ["Date, local", "Clicks", "a;b"])


def test_malformed_as_of_is_an_issue_in_every_session_zone(spark):
    texts = ["2026-02-30", "2026-01-31T10:00:00", "2026-02-01T05:00:00Z", "soon", None]
    frame = spark.createDataFrame([(t, z) for t in texts for z in ("America/Los_Angeles", "Mars/Base")], "t string, z string")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            days = {(r.t, r.z): str(r.d) for r in frame.withColumn("d", dates.as_of_day(F.col("t"), F.col("z"))).collect()}
            assert {t: days[t, "America/Los_Angeles"] for t in texts} == dict(zip(texts, ["None", "2026-01-31", "2026-01-31", "None", "None"]))
            assert {days[t, "Mars/Base"] for t in texts} == {"None"}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize(
    "headers", [["Date", "Clicks"], ["Clicks", "Impressions", "Landing"], ["Clicks", "点击", "Impressions"], ["", "Clicks", "Impressions"]]
)
def test_header_faults(headers):
    with pytest.raises(ValueError):
        exports.canonical_headers(headers)


def test_review_headers_refuse_people_queries_and_extras():
    dims = {"date": "Day", "landing_page": "Page", "country": "Country"}
    metrics = {"leads": "Leads"}
    ok = exports.review_headers("crm", ["Day", "Page", "Country", "Leads"], dims, metrics)
    assert ok["leads"] == "Leads"
    for extra in ("Email", "Keyword", "Owner", "Region"):
        with pytest.raises(ValueError):
            exports.review_headers("crm", ["Day", "Page", "Country", "Leads", extra], dims, metrics)
    with pytest.raises(ValueError):
        exports.canonical_headers(["Date", "Clicks", "Impressions"], exports.AI_HEADERS, ("impressions",), exports.AI_FORBIDDEN_HEADERS)


def test_weighted_position_ignores_rows_without_impressions(spark):
    d = dt.date(2026, 6, 2)
    rows = _rows(spark, [(d, "alpha", "", "", "DESKTOP", 10.0, 100.0, 2.0), (d, "alpha", "", "", "MOBILE", 10.0, 300.0, 6.0), (d, "beta", "", "", "DESKTOP", 0.0, 0.0, 1.0)])
    m = compare.overall_metrics(compare.label_windows(rows, MAY, JUNE)).first()
    assert (m.current_clicks, m.current_impressions, m.current_ctr, m.current_position) == (20, 400, 0.05, 5)
    assert (m.current_position_rows, m.current_position_impressions) == (2, 400)


def test_zero_baseline_gives_nulls_and_cohorts_are_united(spark):
    b, c = dt.date(2026, 5, 2), dt.date(2026, 6, 2)
    rows = _rows(spark, [(b, "lost", "", "", "", 0.0, 0.0, None), (b, "a", "", "", "", 0.0, 0.0, None), (c, "a", "", "", "", 5.0, 10.0, 2.0), (c, "new", "", "", "", 0.0, 0.0, None)])
    labelled = compare.label_windows(rows, MAY, JUNE)
    m = compare.add_deltas(compare.overall_metrics(labelled)).first()
    assert m.baseline_ctr is None and m.relative_clicks is None and m.relative_impressions is None and m.delta_ctr_points is None
    cohorts = {r.value: r for r in compare.cohort_metrics(labelled).collect()}
    assert set(cohorts) == {"a", "lost", "new"} and cohorts["lost"].current_impressions == 0


def test_windows_must_be_ordered_and_disjoint():
    for pair in ((JUNE, MAY), (MAY, DateWindow("2026-05-31", "2026-06-10")), (DateWindow("2026-05-09", "2026-05-01"), JUNE)):
        with pytest.raises(ValueError):
            compare.check_windows(*pair)


def test_unaligned_dimensions_need_permission():
    with pytest.raises(ValueError):
        compare.shared_dimensions(["page", "device"], ["page"])
    assert compare.shared_dimensions(["page", "device"], ["page"], True) == (["page"], {"query": (True, True), "country": (True, True), "device": (False, True)})


def test_duplicate_grain_and_clicks_gate(spark):
    rows = spark.createDataFrame([("2026-06-01", "/a", "3", "2", ""), ("2026-06-01", "/a", "1", "2", "x")], "date string, page string, clicks string, impressions string, position string")
    typed = gates.typed_search_rows(rows)
    assert sorted(r.issue for r in typed.collect()) == ["clicks_above_impressions", "position_not_a_finite_number"]
    with pytest.raises(gates.GateError, match="1 duplicate grain groups over 2 rows"):
        gates.require_unique_grain(typed, ["day", "page"])


def test_ai_windows(spark):
    data = [("2026-05-02", "/a", "US", "DESKTOP", 10.0), ("2026-05-31", "/old", "DE", "MOBILE", 5.0), ("2026-06-01", "/a", "US", "DESKTOP", 20.0), ("2026-06-30", "/new", "FR", "MOBILE", 15.0), ("2026-07-01", "/outside", "US", "DESKTOP", 999.0)]
    rows = spark.createDataFrame(data, "day string, page string, country string, device string, impressions double").withColumns({"day": F.col("day").cast("date"), "property_id": F.lit("p")})
    labelled = compare.label_windows(rows, DateWindow("2026-05-02", "2026-05-31"), JUNE)
    t = compare.ai_deltas(compare.ai_totals(labelled)).first()
    assert (t.baseline_impressions, t.current_impressions) == (15, 35) and t.impressions_relative == pytest.approx(4 / 3)
    cohorts = {r.value: r.current_impressions for r in compare.ai_cohorts(labelled).filter("dimension = 'page'").collect()}
    assert cohorts == {"/a": 20, "/old": 0, "/new": 15}


def test_top_zero_keeps_all(spark):
    d = dt.date(2026, 6, 2)
    rows = _rows(spark, [(d, f"/{i}", "", "", "", 0.0, float(i), None) for i in range(5)])
    cohorts = compare.cohort_metrics(compare.label_windows(rows, MAY, JUNE))
    every = compare.top_cohorts(cohorts, 0).orderBy("rank").collect()
    assert [(r.rank, r.value, r.groups_total, r.groups_returned) for r in every] == [(i + 1, f"/{4 - i}", 5, 5) for i in range(5)]
    best = compare.top_cohorts(cohorts, 2).orderBy("rank").collect()
    assert [r.value for r in best] == ["/4", "/3"] and best[0].groups_total == 5
