"""Split CSV files against Python's reader on the whole file."""

import csv
import io
import random

import pytest

from searchloom.sources import csv_records, exports

SMALL_SPLITS = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "0"}
PIECES = ["a", "7", "", '"', '""', "\n", ",", ";", " ", "\r\n", "é漢", "x" * 40, '"\n"', "\n\n"]


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in SMALL_SPLITS}
    for k, v in SMALL_SPLITS.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def written(rows, delimiter, quoting, end="\n"):
    out = io.StringIO()
    csv.writer(out, delimiter=delimiter, quoting=quoting, lineterminator=end).writerows(rows)
    return out.getvalue()


def test_state_after_a_line():
    for line, outside, inside in [
        ("a,b", 0, 1), ('"a","b"', 0, 1), ('"a', 1, 0), ('a"', 0, 0), ('a"b,"c', 1, 1), ('5" pipe,2', 0, 0), ('""', 0, 1), ('"""', 1, 1),
        ('x"",y', 0, 1), ('end","new', 1, 1), ('"a""b', 1, 1), ("", 0, 1), ('"a"b"c,"d', 1, 0),
    ]:
        assert csv_records.state_after(line, 0, ",") == outside, line
    assert csv_records.state_after('text, more",2', 1, ",") == 0
    assert csv_records.state_after('text "" more', 1, ",") == 1


@pytest.mark.parametrize("seed", range(4))
def test_many_splits_give_the_rows_of_one_reader(small_splits, tmp_path, seed):
    spark, rng = small_splits, random.Random(seed)
    want = []
    # two kinds of files in one folder: other delimiter, other order of columns, other line ends
    for k, (delimiter, names, end) in enumerate([(",", ["Page", "Clicks", "Impressions"], "\n"), (";", ["Clicks", "Impressions", "Page"], "\r\n")]):
        rows = []
        for n in range(120):
            page = f"{k}-{n}" + "".join(rng.choice(PIECES) for _ in range(rng.randrange(6))).replace("\r\n", "\n")
            rows.append({"Page": page.strip() + "|", "Clicks": str(n), "Impressions": str(n + 5)})
        text = "﻿" + written([names], delimiter, csv.QUOTE_MINIMAL, end) + end
        text += written([[r[c] for c in names] for r in rows], delimiter, (csv.QUOTE_MINIMAL, csv.QUOTE_ALL)[seed % 2], end)
        (tmp_path / f"{k}.csv").write_text(text, encoding="utf-8", newline="")
        want += [(r["Page"], r["Clicks"], r["Impressions"], None) for r in rows]
    got = exports.read_search_csv(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    assert sorted(tuple(r[c] for c in ("page", "clicks", "impressions", "row_issue")) for r in got.collect()) == sorted(want)
    # fewer columns asked for, same rows
    assert got.select("clicks").count() == 240


def test_one_field_over_many_splits(small_splits, tmp_path):
    long = "\n".join(f"line {n}, with a comma" for n in range(60))
    rows = [["/a", "1", "10"], [long, "2", "20"], ["/b", "3", "30"], [long + '"', "4", "40"]]
    (tmp_path / "x.csv").write_text(written([["Page", "Clicks", "Impressions"], *rows], ",", csv.QUOTE_MINIMAL), encoding="utf-8", newline="")
    got = exports.read_search_csv(small_splits, str(tmp_path)).collect()
    assert sorted((r["page"], r["clicks"], r["impressions"]) for r in got) == sorted(map(tuple, rows))


def test_bare_quotes_short_and_long_rows(small_splits, tmp_path):
    text = 'Page,Clicks,Impressions\n5" pipe,1,10\n7" pipe,2,20\n\n  ,,\n/short,3\n/long,4,40,9\n/much,5,50,9,9\n'
    (tmp_path / "x.csv").write_text(text, encoding="utf-8")
    got = {(r["page"], r["clicks"], r["row_issue"]) for r in exports.read_search_csv(small_splits, str(tmp_path)).collect()}
    assert got == {
        ('5" pipe', "1", None), ('7" pipe', "2", None), ("/short", "3", "row_shorter_than_header"),
        ("/long", "4", "row_longer_than_header"), ("/much", "5", "row_longer_than_header"),
    }


def test_many_open_splits_meet_by_a_join(small_splits, tmp_path, monkeypatch):
    monkeypatch.setattr(csv_records, "SENT", 0)
    test_one_field_over_many_splits(small_splits, tmp_path)


def test_each_record_meets_the_parser_once(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Date,Top pages,Clicks,Impressions\n2024-01-01,"/a, b",1,2\n,,,\n')
    rows = exports.read_search_csv(spark, str(tmp_path))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    # one group of files, whose records come whole or from pieces at the edges of splits
    assert plan.count("from_csv(") + plan.count("csvtostructs(") <= 2
    assert [(r["page"], r["clicks"], r["row_issue"]) for r in rows.collect()] == [("/a, b", "1", None)]
