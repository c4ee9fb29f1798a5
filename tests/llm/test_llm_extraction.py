import html
import re

from searchloom.llm import extraction
from searchloom.llm.queries import QUERIES

WORDS = "many more words of plain text that go on for a while and then stop " * 3


def article(page):
    """The supplied pages keep their text in one article element."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = [" ".join(html.unescape(re.sub(r"</?b>", "", p)).split()) for p in re.split(r"</?(?:p|br|h1)>", inner)]
    return " ".join(p for p in parts if p)


def test_query_gives_the_article(spark, sf_dir):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = QUERIES["op5_extraction"](spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r["text"] == article(pages[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"])
        assert r["url"] == pages[r["page_id"]]["url"]


PAGES = {
    None: "", "": "", "   ": "", "<p></p>": "", "<script>var a='<p>" + WORDS + "</p>'</script>": "",
    f"<article><p>A&amp;B &lt;x&gt;\u00a0 c<br>d</p><p>{WORDS}<!-- {WORDS} --></p></article>": f"A&B <x> c d {WORDS.strip()}",
    f"<body><NAV><a href='>'>x</a></NAV><article><p>{WORDS}<p>Two<b>Three</b> <i>four</i></article>": f"{WORDS.strip()} TwoThree four",
    f"<article><p>{WORDS}</p><div class='ad'>{WORDS}</div><p>yes</p><form>{WORDS}</form></article><div id=comments><p>{WORDS}</p></div>": f"{WORDS.strip()} yes",
    f"<article><p>{WORDS}</p><style>p{{}}</style>": WORDS.strip(),
    f"<aside>{WORDS}</aside><main><h1>T</h1>{WORDS}</main><div class='cookie-notice'>{WORDS}</div>": f"T {WORDS.strip()}",
    f"<header>{WORDS}</header><article><p>a < b and {WORDS}</p></article>": f"a < b and {WORDS.strip()}",
}


def test_written_pages(spark):
    rows = [(i, "u", page, "x") for i, page in enumerate(PAGES)] * 2
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = [(r["page_id"], r["main"]["text"]) for r in extraction.extract(frame).collect()]
    assert sorted(got) == sorted([(i, text) for i, text in enumerate(PAGES.values())] * 2)
    assert extraction.extract(frame.limit(0)).count() == 0


def test_tree_learns_its_table_and_uses_neighbours():
    rows, labels = extraction.labelled(extraction.EXAMPLES)
    tree = extraction.trained()
    assert (tree.decide(rows) == labels).mean() > 0.97
    used = {extraction.FEATURES[f] for f in tree.feature if f >= 0}
    assert {"links_before", "words_before", "links_after", "words_after"} <= used, used
    assert extraction.FEATURES[tree.feature[0]] == "links"
    found = extraction.blocks("<p>one two</p><p><a>three</a> four</p>")
    assert extraction.features(found)[:, :6].tolist() == [[2, 0, 0, 0, 2, 0.5], [2, 0.5, 2, 0, 0, 0]]


def unmarked(page):
    """The page with plain boxes in place of elements and classes that say what they hold."""
    page = re.sub(r"<(/?)(?:nav|article|footer|aside|section|header|main|form)\b[^>]*>", r"<\1div>", page)
    return re.sub(r"<(div|p|ul|li)\s+(?:class|id|role)=[^>]*>", r"<\1>", page)


def test_supplied_pages_without_marks(spark, sf_dir):
    """Only words, links, neighbours and headings are left to decide by."""
    tree, right, total = extraction.trained(), 0, 0
    for row in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        truth = [b.main and not b.aside for b in extraction.blocks(row["html"])]
        found = extraction.blocks(unmarked(row["html"]))
        assert len(found) == len(truth) and not any(b.aside or b.main for b in found)
        right += (tree.decide(extraction.features(found)) == truth).sum()
        total += len(truth)
    assert right / total > 0.98, right / total


def test_neighbours_decide_without_marks():
    """The same line is main text between paragraphs and none between links."""
    line, long, link = "<div>these are eight words of one short line</div>", f"<div>{WORDS}</div>", "<div><a href='x'>elsewhere</a></div>"
    tree = extraction.trained()
    between_text = extraction.main_blocks(f"<body>{link}<h1>Title of it</h1>{long}{line}{long}{line}{long}{link}</body>", tree)
    assert between_text.count("these are eight words of one short line") == 2 and "elsewhere" not in between_text
    assert extraction.main_blocks(f"<body>{link}{link}{line}{link}{line}{link}</body>", tree) == []


def test_many_open_tags_take_linear_time():
    page = "<div class=x><a href='" * 3000 + "<p>" * 20000
    assert extraction.main_blocks(page, extraction.trained()) is not None
