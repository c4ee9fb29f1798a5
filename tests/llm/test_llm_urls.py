import re

from searchloom.llm import url_filter
from searchloom.llm.queries import QUERIES

URLS = [
    None, "", "no scheme", "http://", "http://ORG", "http://org/", "http://a.example.ORG/es/x?q=/y#z", "https://example.org/en/1",
    "https://example.org/en/12", "https://example.org/en/2", "http://badexample.org/es/", "x://m.example.com/fr/", "x://m.example.com/de/1",
    "x://com/de", "http://example.net?://org/", "http://mirror.net/a", "http://sub.mirror.net", "http://mirror.net.de/", "a://b://org/",
]


def naive(url, rules, blocked):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = []
    for rule in rules:
        domain, _, tail = rule.partition("/")
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + tail):
            fits.append(rule)
    rule = max(fits, key=len, default=None)
    listed = any(host == b or host.endswith("." + b) for b in blocked)
    return host, path, rule, rules[rule] if rule else "block" if listed else "allow"


def test_rules_and_list(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumnRenamed("url", "url")
    blocked = spark.createDataFrame([("mirror.net",), (None,), ("mirror.net",)], "host string")
    got = {r["page_id"]: tuple(r["judged"]) for r in url_filter.judge(pages, blocked).collect()}
    assert got == {i: naive(u, url_filter.RULES, {"mirror.net"}) for i, u in enumerate(URLS)}
    none = spark.createDataFrame([], "host string")
    assert url_filter.judge(pages.limit(0), none).count() == 0
    assert url_filter.judge(pages, none, rules={}).where("judged.verdict = 'block'").count() == 0


def test_query_against_rules_one_by_one(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").collect()
    blocked = [r["host"] for r in url_filter.mirror_hosts(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in QUERIES["op8_url_filter"](spark, sf_dir).collect()}
    assert got == {p["page_id"]: naive(p["url"], url_filter.RULES, blocked) for p in pages}


def test_mirror_hosts_need_most_of_their_pages_elsewhere(spark):
    rows = [(f"http://copy.net/{i}", f"page {i}") for i in range(30)] + [(f"http://Origin.net/{i}", f"page {i % 40}") for i in range(100)]
    rows += [("http://small.net/1", "page 1"), (None, "page 2"), ("http://odd.net/", None)]
    frame = spark.createDataFrame(rows, "url string, html string")
    assert sorted(r["host"] for r in url_filter.mirror_hosts(frame).collect()) == ["copy.net", "origin.net"]


def test_colliding_keys_are_told_apart_by_the_strings(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter, "digest", lambda text: len(text))
    folder = url_filter.write_digest_array(iter([b"aa", b"ab", b"ba", b"abc", b"aa"]), str(tmp_path))
    array = url_filter.DigestArray(folder)
    found = array.find([b"ba", b"bb", b"aa", b"abc", b"xyz", b"", b"ab"])
    assert [array.string(i) if i >= 0 else None for i in found.tolist()] == [b"ba", None, b"aa", b"abc", None, None, b"ab"]


def test_long_lists_are_dealt_over_files(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "SHARD", 10)
    folders = url_filter.write_list(spark.range(95).selectExpr("concat('h', id, '.net') host"), "urls")
    assert len(folders) == 10
    hosts = ["h7.net", "a.h94.net", "h95.net", "", "net"]
    assert url_filter.on_list(folders, hosts) == [True, True, False, False, False]
