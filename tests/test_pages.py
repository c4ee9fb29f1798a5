import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from searchloom.functions import urls
from searchloom.functions.html_tokens import PIECE_BYTES, read_batches, read_page, srcset_urls
from searchloom.operators import graph, pages, robots, rules, sitemaps
from searchloom.plans import load_all
from searchloom.plans.tables import load_view

load_all()

from searchloom.plans import page_queries  # noqa: E402

SITE = "https://example.com"
HOME = """<!doctype html><html lang="en"><head><title>Pumps</title><meta name="description" content="d">
<link rel="canonical" href="/"><link rel="alternate" hreflang="de" href="/de/"><link rel="alternate" hreflang="en" href="/">
<script type="application/ld+json">{"@type":"Product",}</script></head>
<body><h1>Hi</h1><script>var x = '<a href="/not-a-link">';</script><a href="/products/?utm_source=x">Products</a><a href="/missing/">Gone</a><img src="/a.png"></body></html>"""
PRODUCTS = """<html lang="en"><head><title>Pumps</title><meta name="robots" content="noindex,follow"><link rel="canonical" href="https://other.example/p"></head><body><a href="/">Home</a><a>dead</a></body></html>"""
GERMAN = """<html><head><base href="https://example.com/de/"><title> </title></head><body><p>Text &amp; mehr</p><a href="sub">x</a></body></html>"""
ROBOTS = "User-agent: *\nDisallow: /\nAllow: /public/\nDisallow: /public/private/\nNoindex: /x\n"
SITEMAP = """<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:image="http://www.google.com/schemas/sitemap-image/1.1">
<url><loc>https://example.com/ghost/</loc><image:image><image:loc>https://example.com/i.png</image:loc></image:image></url><url><loc>https://example.com/products/</loc></url><url><loc>https://example.com/products/</loc></url></urlset>"""


@pytest.fixture(scope="module")
def site(spark):
    data = [(SITE, f"{SITE}/", HOME), (SITE, f"{SITE}/products/", PRODUCTS), (SITE, f"{SITE}/de/", GERMAN)]
    raw = spark.createDataFrame(data, "site_id string, url string, html string").selectExpr(
        "*", "200 AS status", "url AS requested_url", "url AS final_url", "0 AS redirect_hops", "CAST(NULL AS array<string>) AS x_robots_tag"
    )
    docs = sitemaps.read_documents(spark.createDataFrame([(SITE, f"{SITE}/sitemap.xml", SITEMAP), (SITE, f"{SITE}/bad.xml", "<urlset><url>")], "site_id string, doc_url string, xml string"))
    facts = pages.page_facts(raw).cache()
    return rules.Site(
        facts=facts,
        sites=spark.createDataFrame([(SITE, True)], "site_id string, production boolean"),
        fetches=spark.createDataFrame([(SITE, f"{SITE}/missing/", 404)], "site_id string, url string, status int"),
        sitemap=sitemaps.sitemap_locations(docs),
        sitemap_errors=sitemaps.sitemap_errors(docs),
        robots=robots.parse_robots(spark.createDataFrame([(SITE, ROBOTS)], "site_id string, text string")),
        assets=spark.createDataFrame([(SITE, f"{SITE}/b.png")], "site_id string, url string"),
        rendered=facts,
        static=True,
    )


def test_three_page_site_findings(site):
    codes = {r.code for r in rules.inspect_site(site).select("code").distinct().collect()}
    assert {
        "sitemap.parse-error", "sitemap.duplicate-url", "metadata.duplicate-title", "metadata.title-missing", "robots.noindex",
        "signals.noindex-cross-canonical", "structured-data.invalid-json", "links.broken-internal", "links.non-crawlable-control",
        "hreflang.return-link-missing", "sitemap.noindex-url", "sitemap.noncanonical-url", "sitemap.url-missing-artifact",
        "robots.unsupported-noindex", "robots.sitewide-block", "robots.blocks-sitemap-url", "images.alt-attribute-missing",
        "images.missing-local-asset", "canonical.target-outside-artifact", "canonical.not-explicit", "metadata.description-missing",
    } <= codes
    assert not codes & {"scope.no-html", "rendering.canonical-changed", "http.server-error"}


def test_page_facts(site):
    f = {r.url: r for r in site.facts.collect()}
    home = f[f"{SITE}/"]
    assert [link.target for link in home.links] == [f"{SITE}/products/", f"{SITE}/missing/"]
    assert home.canonicals == [f"{SITE}/"] and home.h1_count == 1 and home.html_lang == "en"
    assert f[f"{SITE}/products/"].noindex and not home.noindex
    assert f[f"{SITE}/de/"].links[0].target == f"{SITE}/de/sub"


def test_robots_longest_match_and_ties(spark):
    text = "User-agent: googlebot\nDisallow: /*?sort=*\nDisallow: /private$\nAllow: /tie\nDisallow: /tie\nUser-agent: *\nDisallow: /\n"
    rules_df = robots.rules_for_agent(robots.parse_robots(spark.createDataFrame([("s", text), ("t", ROBOTS)], "site_id string, text string")))
    wanted = [("s", "/a?sort=1", True), ("s", "/private", True), ("s", "/private/x", False), ("s", "/tie", False), ("s", "/b", False), ("t", "/", True), ("t", "/public/page", False), ("t", "/public/private/a", True)]
    df = spark.createDataFrame([(s, "https://h" + p, b) for s, p, b in wanted], "site_id string, url string, expected boolean")
    assert robots.blocked(df, rules_df).filter("blocked <> expected").count() == 0


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("https://EXAMPLE.com/products/?size=30mm&utm_source=ad&gclid=secret#spec", "https://example.com/products/?size=30mm"),
        ("https://example.com//a//b?b=1&a=&c", "https://example.com/a/b?b=1&a=&c="),
        ("https://example.com?q=a b*~", "https://example.com/?q=a+b%2A~"),
    ],
)
def test_crawl_form(spark, raw, expected):
    assert spark.createDataFrame([(raw,)], "u string").select(urls.crawl_form(F.col("u"))).first()[0] == expected


@pytest.mark.parametrize(
    ("ref", "expected"),
    [("../x", "https://h/a/x"), ("./y?q=1", "https://h/a/b/y?q=1"), ("//c/d", "https://c/d"), ("?z=1", "https://h/a/b/c?z=1"), ("/r/./s/../t", "https://h/r/t"), ("mailto:a@b.c", None), ("#f", None), ("  ", None)],
)
def test_links_resolve_like_the_reader(spark, ref, expected):
    got = spark.createDataFrame([(ref,)], "r string").select(urls.resolve_link(F.lit("https://h/a/b/c"), F.col("r"))).first()[0]
    assert got == expected


def test_srcset_and_text():
    assert srcset_urls("a.png 1x, b.png 2x,c.png, data:image/png;base64,AA 3x") == ["a.png", "b.png", "c.png", "data:image/png;base64,AA"]
    page = read_page("https://h/", "<body>A<script>no</script><noscript>no</noscript> B &amp; C</body>tail")
    assert page["visible_text"] == "A B & C"


def test_headings_count_where_they_begin():
    def heads(html):
        return [(e["tag"], e["text"]) for e in read_page("https://h/", html)["elements"] if e["tag"][0] == "h" and e["tag"] != "html"]

    assert heads("<body><h1>Open<p>text</p>") == [("h1", "")]
    assert heads("<h1>A<h1>B</h1><h2>C <b>d</b></h2>") == [("h1", ""), ("h1", "B"), ("h2", "C d")]
    assert heads("<h2><a href='/x'>linked</a></h2><h1>T</h1>") == [("h2", "linked"), ("h1", "T")]


def test_click_depth_and_redirects(spark):
    chain = spark.createDataFrame([("s", f"n{i}", f"n{i + 1}") for i in range(6)] + [("s", "n0", "n4"), ("s", "x", "n1")], "site_id string, source string, target string")
    depth = {r.url: r.depth for r in graph.click_depth(chain, spark.createDataFrame([("s", "n0")], "site_id string, url string")).collect()}
    assert depth == {"n0": 0, "n1": 1, "n4": 1, "n2": 2, "n5": 2, "n3": 3, "n6": 3}
    hops = [("a", "b"), ("b", "c"), ("l", "m"), ("m", "l"), ("s", "s")] + [(f"k{i}", f"k{i + 1}") for i in range(15)]
    out = {r.url: (r.final_url, r.hops, r.state) for r in graph.resolve_redirects(spark.createDataFrame(hops, "url string, location string")).collect()}
    assert out["a"] == ("c", 2, "resolved") and out["b"] == ("c", 1, "resolved") and out["l"][2] == "loop" and out["s"][2] == "loop"
    assert out["k0"] == ("k15", 15, "too_long") and out["k5"] == ("k15", 10, "resolved")


def test_deep_sitemap_indexes_and_long_chains_are_followed_to_the_end(spark):
    def index(i, child):
        return (SITE, f"{SITE}/s{i}.xml", f"<sitemapindex><sitemap><loc>{child}</loc></sitemap></sitemapindex>")

    docs = [index(i, f"{SITE}/s{i + 1}.xml") for i in range(25)] + [(SITE, f"{SITE}/s25.xml", f"<urlset><url><loc>{SITE}/p</loc></url></urlset>")]
    frame = spark.createDataFrame(docs, "site_id string, doc_url string, xml string")
    found, errors = sitemaps.reachable_documents(frame, spark.createDataFrame([(SITE, f"{SITE}/s0.xml")], "site_id string, doc_url string"))
    assert found.filter("loc IS NULL").count() == 26 and errors.count() == 0 and sitemaps.sitemap_locations(found).count() == 1
    chain = [(f"u{i}", f"u{i + 1}") for i in range(25)] + [("v0", "v1"), ("v1", "v2"), ("v2", "v1")]
    ends = {r.url: (r.final_url, r.hops, r.state) for r in graph.resolve_redirects(spark.createDataFrame(chain, "url string, location string")).collect()}
    assert ends["u0"] == ("u25", 25, "too_long") and ends["u24"] == ("u25", 1, "resolved") and ends["v0"][2] == "loop"


def test_sitemap_rows_of_texts_and_files(spark, tmp_path):
    entries = "".join(f"<url><loc>{SITE}/p{n}</loc><lastmod>2024-01-01</lastmod></url>" for n in range(12_000))
    texts = {
        "large.xml": f'<?xml version="1.0" encoding="ISO-8859-1"?>\n<urlset xmlns="http://x">{entries}</urlset>',
        "prefixed.xml": f"<s:urlset xmlns:s='http://x' xmlns:i='http://y'><s:url><s:loc> {SITE}/a &amp;\n b </s:loc><i:image><i:loc>no</i:loc></i:image></s:url><s:url/></s:urlset>",
        "index.xml": f"<sitemapindex><sitemap><loc>{SITE}/large.xml</loc></sitemap><url><loc>no</loc></url></sitemapindex>",
        "late.xml": f"<urlset>{entries}<url></urlset>", "feed.xml": "<feed><url><loc>x</loc></url></feed>", "empty.xml": "", "é.xml": f"<urlset><url><loc>{SITE}/é漢</loc></url></urlset>",
    }
    frame = spark.createDataFrame([(SITE, name, text) for name, text in texts.items()] + [(SITE, "null.xml", None)], "site_id string, doc_url string, xml string")
    rows = sitemaps.read_documents(frame)
    heads = {r["doc_url"]: (r["kind"], r["error"]) for r in rows.filter("loc IS NULL").collect()}
    assert heads == {
        "large.xml": ("urlset", None), "prefixed.xml": ("urlset", None), "index.xml": ("sitemapindex", None), "late.xml": ("urlset", "not_well_formed"),
        "feed.xml": ("feed", "unexpected_root:feed"), "empty.xml": ("", "not_well_formed"), "null.xml": ("", "not_well_formed"), "é.xml": ("urlset", None),
    }
    locs = {}
    for r in rows.filter("loc IS NOT NULL").collect():
        locs.setdefault(r["doc_url"], []).append(r["loc"])
    assert set(locs) == {"large.xml", "prefixed.xml", "index.xml", "é.xml"} and len(set(locs["large.xml"])) == 12_000
    assert locs["prefixed.xml"] == [f"{SITE}/a & b", ""] and locs["index.xml"] == [f"{SITE}/large.xml"] and locs["é.xml"] == [f"{SITE}/é漢"]
    # the same from files, which are read in small splits
    for name, text in texts.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        place = lambda df: df.withColumns({"site_id": F.lit(SITE), "doc_url": F.url_decode(F.element_at(F.split("file", "/"), -1))})
        read = {tuple(r) for r in sitemaps.read_files(spark, str(tmp_path), place).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    # an empty file has no piece and so no row
    assert read == {tuple(r) for r in rows.collect() if r["doc_url"] not in ("null.xml", "empty.xml")}


def test_content_only_in_the_rendered_page(spark, site):
    shell = spark.createDataFrame([(SITE, f"{SITE}/", "<html><body><div id='app'></div></body></html>")], "site_id string, url string, html string")
    source = pages.page_facts(shell.selectExpr("*", "CAST(NULL AS array<string>) AS x_robots_tag"))
    found = rules.RULES["rendering.content-client-only"](rules.Site(facts=source, sites=site.sites, rendered=site.facts))
    assert [r.url for r in found.collect()] == [f"{SITE}/"]


def test_a_large_batch_leaves_the_worker_in_small_ones():
    texts = [HOME, None, "", PRODUCTS * 100, GERMAN] * 240
    batch = pa.RecordBatch.from_pydict({"n": list(range(len(texts))), "url": [f"{SITE}/{n}" for n in range(len(texts))], "html": texts})
    out = list(read_batches(iter([batch, batch.slice(0, 0), batch.slice(7, 1)])))
    assert [n for piece in out for n in piece.column("n").to_pylist()] == [*range(len(texts)), 7]
    for piece in out:
        assert len(piece) <= PIECE_BYTES // 1024
        read = [len(texts[n] or "") for n in piece.column("n").to_pylist()]
        assert sum(read) <= PIECE_BYTES + max(read)
    row = next(piece.slice(i, 1) for piece in out for i, n in enumerate(piece.column("n").to_pylist()) if n == 604)
    wanted = read_page(f"{SITE}/604", GERMAN)
    assert {k: row.column(k)[0].as_py() for k in ("visible_text", "document_base", "json_ld_types")} == {k: wanted[k] for k in ("visible_text", "document_base", "json_ld_types")}


def test_html_goes_through_one_join(spark, tmp_path):
    rows = [(n, f"https://a{n % 3}.example.com/{n}#x", f"<html><head></head><body>{n}</body></html>") for n in range(40)]
    # repeated rows, one id with two addresses, one id and address with two texts, an address twice, an absent address
    rows += [rows[7], rows[7], (8, "https://a1.example.com/else", "other"), (9, rows[9][1], "second"), (41, rows[10][1], "later"), (50, None, "none")]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        lean, plain = (load(spark, str(tmp_path), "site_pages") for load in (page_queries.load_pages, load_view))
        assert lean.columns == plain.columns
        assert sorted(map(str, lean.collect())) == sorted(map(str, plain.collect()))
        shown = page_queries._input(spark, str(tmp_path), "site_pages")._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        )
        moved = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: (.*)", shown)
        assert sum("html#" in columns for columns in moved) == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
