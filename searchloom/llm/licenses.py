"""License notices in text blocks by an exact set-similarity join with templates.

A text block is a line, or a run of consecutive words of a paragraph (lines up to one without a word) that goes over a line end. A run has at
most as many words as the template, and one more for each line end in it, for what may lead a line. So a notice is met however
it is broken over lines, and a long paragraph does not meet a short one by words that stand far apart. The rule is the
same for all templates. A block matches a template where at least ``threshold`` of the template's distinct tokens are among the
block's (containment). Tokens are ordered by their frequency in the corpus, rarest first. A match needs
ceil(threshold x size) common tokens, so one of the template's first size - needed + 1 tokens must be in the block (prefix
filter); the block must have as many tokens at all (length filter); and from a common prefix token on, enough tokens
must be left on both sides (positional filter). Runs are looked for in paragraphs that pass these filters as a whole. What is
left is counted exactly. Templates are a fixed bounded table and travel with the tasks; blocks never move.

Defined results: null and empty texts have no word and no block; repeated rows are judged one by one; ties in token frequency are
ordered by the token; texts are read whole, however long, in time that grows with their words; an empty table gives an empty result. Only the
two named columns are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from searchloom.llm.text import LONG, STRING, plain_words, record

THRESHOLD = 0.8

# Phrases and the label each one gives.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

# Public notices and the label each one gives. Several notices may give one label.
TEMPLATES = [
    ("mit-notice", "Released under the MIT License."),
    ("mit-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
        "on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
]


@dataclass
class Templates:
    """Template token sets as rank lists in the global order, and which templates each prefix token opens."""

    labels: list[str]
    tokens: list[list[int]]
    needed: list[int]
    rank: dict[bytes, int]
    opens: dict[int, list[tuple[int, int]]]
    prefix: set[bytes]
    words: list[int]

    @staticmethod
    def of(pairs: list[tuple[str, str]], counts: dict[bytes, int], threshold: float) -> Templates:
        sets = [(label, sorted(set(plain_words(text)))) for label, text in pairs]
        sets = [(label, tokens) for label, tokens in sets if tokens]
        lengths = [n for _, text in pairs if (n := len(plain_words(text)))]
        every = sorted({t for _, tokens in sets for t in tokens}, key=lambda t: (counts.get(t, 0), t))
        rank = {t: i for i, t in enumerate(every)}
        ranked = [sorted(rank[t] for t in tokens) for _, tokens in sets]
        needed = [math.ceil(threshold * len(r) - 1e-9) for r in ranked]
        opens: dict[int, list[tuple[int, int]]] = {}
        for i, (own, need) in enumerate(zip(ranked, needed)):
            for place, token in enumerate(own[: len(own) - need + 1]):
                opens.setdefault(token, []).append((i, place))
        return Templates([label for label, _ in sets], ranked, needed, rank, opens, {every[t] for t in opens}, lengths)

    def matches(self, words: set[bytes]) -> dict[int, float]:
        """Template number and containment of every template that a block with these words meets."""
        known = words & self.rank.keys()
        if not known:
            return {}
        block = sorted(self.rank[w] for w in known)
        found: dict[int, float] = {}
        refused: set[int] = set()
        whole = None
        for at, token in enumerate(block):
            for i, place in self.opens.get(token, ()):
                if i in found or i in refused:
                    continue
                own, need = self.tokens[i], self.needed[i]
                if len(block) < need or min(len(own) - place, len(block) - at) < need:
                    refused.add(i)  # this is the pair's first common token, so later ones leave even less
                    continue
                whole = set(block) if whole is None else whole
                common = sum(t in whole for t in own)
                if common >= need:
                    found[i] = common / len(own)
                else:
                    refused.add(i)
        return found


def phrase_places(words: list[bytes], phrases: dict[str, str]) -> list[tuple[int, str]]:
    """Start and label of every place where the words of a phrase stand one after another."""
    out = []
    for phrase, label in phrases.items():
        parts = phrase.encode().split()
        at = -1
        while True:
            try:
                at = words.index(parts[0], at + 1)
            except ValueError:
                break
            if words[at : at + len(parts)] == parts:
                out.append((at, label))
    return out


def token_counts(texts: DataFrame, pairs: list[tuple[str, str]]) -> dict[bytes, int]:
    """Occurrences of every template token in all ``texts`` (column ``body``): one row per token comes back."""
    wanted = {w for _, text in pairs for w in plain_words(text)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = dict.fromkeys(wanted, 0)
        for frame in batches:
            for body in frame["body"]:
                words = plain_words(body)
                for w in wanted.intersection(words):
                    sums[w] += words.count(w)
        yield pd.DataFrame([(w, n) for w, n in sums.items() if n], columns=["token", "n"])

    counted = texts.mapInPandas(count, "token binary, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    return {bytes(r["token"]): r["n"] for r in counted.collect()}  # bounded by the templates' vocabulary


SPAN = record(line=LONG, label=STRING, containment=T.DoubleType())
FOUND = record(
    n_words=LONG, n_base=LONG, first_word=LONG, last_word=LONG, base_labels=STRING, labels=STRING,
    score=T.DoubleType(), blocks=T.ArrayType(SPAN),
)


def scan_text(text: str | None, templates: Templates, phrases: dict[str, str]) -> tuple:
    """One value per field of ``FOUND``. ``blocks`` has the number of each matching line, or the first line of a matching run."""
    words = plain_words(text)
    places = phrase_places(words, phrases)
    blocks = []
    if not templates.prefix.isdisjoint(words):
        lines = text.split("\n")
        for number, line in enumerate(lines):
            blocks += [(number, templates.labels[i], c) for i, c in templates.matches(set(plain_words(line))).items()]
        if len(lines) > 1:
            blocks += wrapped(lines, templates)
    base = {label for _, label in places}
    starts = [at for at, _ in places]
    return (
        len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
        ",".join(sorted(base | {label for _, label, _ in blocks})),
        1.0 if places else max((c for _, _, c in blocks), default=0.0),
        [{"line": n, "label": label, "containment": c} for n, label, c in blocks],
    )


def wrapped(lines: list[str], templates: Templates) -> list[tuple[int, str, float]]:
    """Templates met by several lines of a paragraph together: the first line's number, label and containment."""
    out = []
    start, held = 0, []
    for number, line in enumerate([*lines, ""]):
        words = plain_words(line)
        if words:
            if not held:
                start = number
            held.append(words)
            continue
        if 1 < len(held):
            # what a run of words holds, its paragraph holds as well
            for i in templates.matches({w for words in held for w in words}):
                out += [(start + at, templates.labels[i], c) for at, c in runs(held, templates, i)]
        held = []
    return out


def runs(held: list[list[bytes]], templates: Templates, i: int) -> list[tuple[int, float]]:
    """Lines in which runs over line ends begin that meet a template, each with its best containment.

    A word costs one, the first of a line nothing, so costs rise along the paragraph and a run may go on as long as it costs less than the template
    has words: the longest run of every start is found by moving both ends forward only.
    """
    own, size = set(templates.tokens[i]), templates.words[i]
    flat = [(line, templates.rank.get(word)) for line, words in enumerate(held) for word in words]
    places = [(at - line, line, token) for at, (line, token) in enumerate(flat) if token in own]
    best: dict[int, int] = {}
    inside: Counter[int] = Counter()
    high = 0
    for cost, line, token in places:
        while high < len(places) and places[high][0] - cost < size:
            inside[places[high][2]] += 1
            high += 1
        if places[high - 1][1] > line:
            best[line] = max(best.get(line, 0), len(inside))
        inside[token] -= 1
        if not inside[token]:
            del inside[token]
    return [(line, n / len(own)) for line, n in best.items() if n >= templates.needed[i]]


def scan(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] | None = None,
    phrases: dict[str, str] | None = None, threshold: float = THRESHOLD,
) -> DataFrame:
    """``doc_id`` and ``found`` (fields of ``FOUND``) for every row."""
    pairs = TEMPLATES if templates is None else templates
    named = PHRASES if phrases is None else phrases
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("body"))
    ready = Templates.of(pairs, token_counts(rows.select("body"), pairs), threshold)

    @F.pandas_udf(FOUND)
    def scanned(bodies: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([scan_text(b, ready, named) for b in bodies], columns=FOUND.names)
        for name in ("first_word", "last_word"):
            out[name] = out[name].astype("Int64")
        return out

    return rows.select("doc_id", scanned("body").alias("found"))
