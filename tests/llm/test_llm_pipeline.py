"""The corpus pipeline against the same five steps in plain Python."""

import hashlib
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
from llm_data import empty, odd
from test_llm_decontaminate import windows, words_of
from test_llm_mixing import naive_targets
from test_llm_near_copies import kept_ids
from test_llm_quality import naive as measures
from tokenizers import Tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def good(docs):
    failed = {i: m[0] < 50 or 100 * m[4] > 50 * m[0] for i, m in ((i, measures(t)) for i, t, _ in docs)}
    # no host of the small tables comes near the limit: the rate of a host with more than 0.8 failures would have to be shrunk here
    rate = {s: np.mean([failed[i] for i, _, o in docs if o == s]) for _, _, s in docs}
    assert max(rate.values()) < 0.7
    return [d for d in docs if not failed[d[0]]]


def distinct(docs):
    """docs with ids of their own: the smallest of every group by the similarity of all pairs."""
    kept = set(kept_ids([d[:2] for d in docs]))
    return [d for d in docs if d[0] in kept]


def clean(docs, items):
    grams = {" " + " ".join(w) + " " for _, t in items for w in windows(words_of(t))}
    out = []
    for d in docs:
        text = " " + " ".join(words_of(d[1])) + " "
        if not any(g in text for g in grams):
            out.append(d)
    return out


def mix(docs):
    size = {i: len(WORD.findall(t)) for i, t, _ in docs}
    total = Counter()
    for i, _, s in docs:
        total[s] += size[i]
    target = naive_targets(total)
    out = []
    for s in total:
        taken = int(target[s] + 0.5)
        whole, rest = divmod(taken, total[s])
        for i, t, _ in sorted((d for d in docs if d[2] == s), key=lambda d: (hashlib.md5(f"mix-1{d[0]}".encode()).hexdigest(), d[0])):
            part = min(size[i], rest)
            rest -= part
            out += [(i, t)] * (whole + (part > 0 and 2 * part >= size[i]))
    return out


def tokens(rows):
    tokenizer, out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4")
        out[(i, len(ids), zlib.crc32(ids.tobytes()))] += 1
    return out


def test_pipeline_against_plain_python(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    kept = clean(distinct(good(docs)), items)
    assert 0 < len(kept) < len(docs)
    got = corpus_pipeline.run(spark, sf_dir).orderBy("start").collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == tokens(mix(kept))
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]


def test_stages_keep_the_columns_of_documents(spark, sf_dir):
    for docs in (odd(spark), empty(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, sf_dir).columns == docs.columns
            assert [f.dataType for f in stage(spark, docs, sf_dir).schema] == [f.dataType for f in docs.schema]
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()
