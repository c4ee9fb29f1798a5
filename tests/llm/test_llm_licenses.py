import random
import re

import duckdb
from llm_data import ODD, empty, odd

from searchloom.llm import licenses
from searchloom.llm.queries import ORACLES, QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def contained(text, templates, threshold=0.8):
    """Best containment per label over lines, by comparing every line with every template."""
    out = {}
    for line in (text or "").split("\n"):
        have = set(words_of(line))
        for label, notice in templates:
            own = set(words_of(notice))
            share = len(own & have) / len(own)
            if share >= threshold - 1e-9:
                out[label] = max(out.get(label, 0), share)
    return out


def check(rows, docs):
    texts = dict(docs)
    for doc_id, r in rows:
        words = words_of(texts[doc_id])
        places = [
            (i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()
        ]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert r["first_word"] == min((i for i, _ in places), default=None)
        assert r["last_word"] == max((i for i, _ in places), default=None)
        base = {label for _, label in places}
        assert r["base_labels"] == ",".join(sorted(base))
        found = contained(texts[doc_id], licenses.TEMPLATES)
        assert set(r["labels"].split(",")) - {""} >= base | set(found)
        if not places:
            assert abs(r["score"] - max(found.values(), default=0.0)) < 1e-9 or r["score"] > 0.8


def test_query_against_all_lines_and_templates(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = [(r["doc_id"], r) for r in QUERIES["op9_license_scan"](spark, sf_dir).collect()]
    assert len(got) == len(docs)
    check(got, docs)
    assert any(r["labels"] for _, r in got)


def test_odd_rows(spark):
    docs = [(i, t) for i, t, _ in ODD if i != 6]
    got = [(r["doc_id"], r["found"]) for r in licenses.scan(odd(spark)).collect() if r["doc_id"] != 6]
    check(got, docs)
    assert licenses.scan(empty(spark)).count() == 0


def test_filters_lose_no_match(spark):
    long_notice = next(t for _, t in licenses.TEMPLATES if len(set(words_of(t))) > 25)
    words = long_notice.split()
    texts = [
        "x\nLicensed under CC BY-NC 4.0.\ny", "RELEASED under MIT License", "mit license, Mit-License; apache\tlicense", long_notice,
        " ".join(words[: len(words) * 9 // 10]), " ".join(words[: len(words) // 3]),
        "\n".join(" ".join(words[i : i + 5]) for i in range(0, len(words), 5)), "the of is with a copy",
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [(r["doc_id"], r["found"]) for r in licenses.scan(frame).collect()]
    check(got, list(enumerate(texts)))
    found = dict(got)
    assert found[0]["labels"] == "cc-by-nc" and found[2]["n_base"] == 3 and found[2]["base_labels"] == "apache,mit"
    assert found[6]["labels"] == found[3]["labels"] != "" and found[5]["labels"] == "" and found[7]["score"] == 0.0
    assert [b["line"] for b in found[0]["blocks"]] == [1]


def scanned(text):
    ready = licenses.Templates.of(licenses.TEMPLATES, {}, licenses.THRESHOLD)
    return dict(zip(licenses.FOUND.names, licenses.scan_text(text, ready, {})))


def test_templates_wrapped_at_every_word():
    for label, notice in licenses.TEMPLATES:
        words = notice.split()
        broken = [" ".join(words[:i]) + "\n" + " ".join(words[i:]) for i in range(1, len(words))]
        broken += ["\n".join(" ".join(words[i : i + n]) for i in range(0, len(words), n)) for n in (1, 2, 3, 5)]
        for body in broken:
            for lead in ("", "# ", "rem "):
                text = "Some words before\n" + "\n".join(lead + line for line in body.split("\n")) + "\nand some after."
                got = scanned(text)
                assert label in got["labels"].split(",") and got["score"] == 1.0, text


def test_templates_with_strange_lines_between_all_words():
    for label, notice in licenses.TEMPLATES:
        got = scanned("Some words before\n" + "\nx\nx\n".join(notice.split()) + "\nand some after.")
        assert label in got["labels"].split(",") and got["score"] == 1.0, label


def test_short_templates_need_words_that_stand_together():
    apart = "Das ist mit.\nEiner im dem da.\nLicensed under the Apache License, Version 2.0"
    assert scanned(apart)["labels"] == "apache-2.0"
    far = "Licensed under CC\n" + "many other words stand here\n" * 20 + "BY-NC 4.0"
    assert scanned(far)["labels"] == "" and scanned("Licensed under CC\n\nBY-NC 4.0")["labels"] == ""


def brute_runs(held, templates, i):
    """Best containment per first line over every run of words that goes over a line end and is short enough."""
    flat = [(line, word) for line, words in enumerate(held) for word in words]
    own = {w for w, r in templates.rank.items() if r in templates.tokens[i]}
    best = {}
    for a in range(len(flat)):
        for b in range(a + 1, len(flat)):
            ends = flat[b][0] - flat[a][0]
            if ends and b - a + 1 <= templates.words[i] + ends and {flat[a][1], flat[b][1]} <= own:
                best[flat[a][0]] = max(best.get(flat[a][0], 0), len(own & {w for _, w in flat[a : b + 1]}) / len(own))
    return {line: c for line, c in best.items() if c >= licenses.THRESHOLD - 1e-9}


def test_runs_against_all_runs():
    rng = random.Random(7)
    ready = licenses.Templates.of([("a", "one two three two four five"), ("b", "six seven"), ("c", " ".join(f"w{k}" for k in range(20)))], {}, licenses.THRESHOLD)
    pool = [w.encode() for w in ("one two three four five six seven x y z " + " ".join(f"w{k}" for k in range(20))).split()]
    for _ in range(60):
        held = [[rng.choice(pool[:10] if rng.random() < 0.7 else pool) for _ in range(rng.randrange(1, 6))] for _ in range(rng.randrange(2, 12))]
        for i in range(3):
            assert dict(licenses.runs(held, ready, i)) == brute_runs(held, ready, i)


def test_lines_do_not_hide_what_several_lines_hold():
    got = scanned("Licensed under CC BY-NC 4\n0")
    assert [(b["line"], b["label"]) for b in got["blocks"]] == [(0, "cc-by-nc")] * 2 and got["score"] == 1.0
    notice = next(t for label, t in licenses.TEMPLATES if label == "bsd")
    words = notice.split()
    got = scanned(" ".join(words[:-2]) + "\n" + " ".join(words[-2:]))
    assert got["score"] == 1.0 and {b["containment"] for b in got["blocks"] if b["label"] == "bsd"} > {1.0}


def test_sql_has_the_same_rule(spark):
    short, long = "Licensed under CC BY-NC 4.0", next(t for label, t in licenses.TEMPLATES if label == "bsd")
    texts = [
        short.replace(" ", "\n"), short.replace(" ", "\nx\nx\n"), "Licensed under CC\n" + "many other words stand here\n" * 20 + "BY-NC 4.0", "Licensed under CC\n\nBY-NC 4.0",
        "Licensed under CC BY-NC 4\n0", long.replace(" ", "\n"), long.replace(" ", " many strange words here ").replace("source", "source\n"), None, "", "mit\nlicense",
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    found = con.execute(ORACLES["op9_license_scan"])
    names = [d[0] for d in found.description]
    want = sorted(tuple(r) for r in found.fetchall())
    got = sorted((r["doc_id"], *[r["found"][n] for n in names[1:]]) for r in licenses.scan(frame).collect())
    assert got == want and [bool(r[names.index("labels")]) for r in want] == [True, True, False, False, True, True, False, False, False, True]
