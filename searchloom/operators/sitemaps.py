"""Sitemap documents as rows: one row a document, one row a location, errors, and index recursion.

A pull parser hands on every location as it meets it, so no list of locations is ever one cell. Documents come as a column of text or as files; a
file is read in pieces between tags and fed to the parser piece by piece, so it is never one cell either.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchloom.functions import urls
from searchloom.session import cut_lineage

ROW = "site_id string, doc_url string, kind string, error string, loc string"
_ROW = pa.schema([(field.split()[0], pa.string()) for field in ROW.split(", ")])
_AT_ONCE = 5_000


class _Reader:
    """Locations of one document: ``loc`` of every ``url`` or ``sitemap`` entry below the root, blank where an entry has none."""

    def __init__(self) -> None:
        # the text is decoded already, whatever encoding the document declares
        self.parser = expat.ParserCreate("utf-8")
        self.parser.StartElementHandler, self.parser.EndElementHandler = self._start, self._end
        self.path: list[str] = []
        self.root, self.error = "", None
        self.found: list[str] = []
        self.loc: str | None = None

    def _start(self, name: str, _: dict) -> None:
        prefix, _, own = name.rpartition(":")
        if not self.path:
            self.root, self.prefix = own.lower(), prefix
        self.path.append(own if prefix == self.prefix else name)
        if len(self.path) == 3 and self.path[2] == "loc" and self.loc is None:
            self.loc = ""
            self.parser.CharacterDataHandler = self._text

    def _text(self, text: str) -> None:
        self.loc += text

    def _end(self, _: str) -> None:
        closed = self.path.pop()
        if len(self.path) == 2:
            self.parser.CharacterDataHandler = None
        elif len(self.path) == 1:
            if closed == ("sitemap" if self.root == "sitemapindex" else "url"):
                self.found.append(" ".join((self.loc or "").split()))
            self.loc = None

    def feed(self, text: str, last: bool = False) -> None:
        if self.error is None:
            try:
                self.parser.Parse(text.encode("utf-8", "surrogatepass"), last)
            except expat.ExpatError:
                self.error = "not_well_formed"
            if last and self.error is None and self.root not in ("urlset", "sitemapindex"):
                self.error = f"unexpected_root:{self.root}"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in zip(*rows)], schema=_ROW)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents that come as a column; a document is read through once before its locations are handed on."""
    for batch in batches:
        for site, url, xml in zip(*(batch.column(n) for n in ("site_id", "doc_url", "xml"))):
            key, text = (site.as_py(), url.as_py()), (xml.as_py() or "").lstrip("\ufeff \t\r\n")
            for rows in _document(key, text):
                yield _batch(rows)


def _document(key: tuple, text: str) -> Iterator[list[tuple]]:
    step = 1 << 16
    first = _Reader()
    for low in range(0, max(1, len(text)), step):
        first.feed(text[low : low + step], low + step >= len(text))
        first.found.clear()
    yield [(*key, first.root, first.error, None)]
    if first.error is not None:
        return
    again = _Reader()
    for low in range(0, len(text), step):
        again.feed(text[low : low + step], low + step >= len(text))
        if len(again.found) >= _AT_ONCE or low + step >= len(text):
            if again.found:
                yield [(*key, first.root, None, loc) for loc in again.found]
            again.found.clear()


def read_documents(documents: DataFrame) -> DataFrame:
    """``site_id, doc_url, kind, error, loc`` of ``documents`` (``site_id, doc_url, xml``).

    A document has one row without ``loc``; bad XML or a foreign root is its ``error``, and then it has no others. Without an error it has one row
    more for each location.
    """
    return documents.select("site_id", "doc_url", "xml").mapInArrow(_parsed, ROW)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of files that come as pieces between tags, in order, file by file."""
    key, reader, rows = None, None, []

    def finish() -> list[tuple]:
        reader.feed("", True)
        return [(*key, reader.root, None, loc) for loc in reader.found] + [(*key, reader.root, reader.error, None)]

    for batch in batches:
        for site, url, value in zip(*(batch.column(n).to_pylist() for n in ("site_id", "doc_url", "value"))):
            if (site, url) != key:
                if reader is not None:
                    rows += finish()
                key, reader, text = (site, url), _Reader(), value.lstrip("\ufeff \t\r\n")
            else:
                text = "<" + value
            reader.feed(text)
            if len(reader.found) >= _AT_ONCE:
                rows += [(*key, reader.root, None, loc) for loc in reader.found]
                reader.found.clear()
        if rows:
            yield _batch(rows)
            rows = []
    if reader is not None:
        yield _batch(finish())


def read_files(spark: SparkSession, path: str, place: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """As ``read_documents`` for XML files below ``path``; ``place`` adds ``site_id`` and ``doc_url`` to rows with a column ``file``.

    What a broken file gave before its fault is taken out again.
    """
    lines = spark.read.option("lineSep", "<").option("recursiveFileLookup", "true").text(path)
    named = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    ordered = place(named).repartition("file").sortWithinPartitions("file", "start", "at")
    rows = cut_lineage(ordered.select("site_id", "doc_url", "value").mapInArrow(_pieces, ROW), "sitemap-files")
    broken = rows.filter("error IS NOT NULL").select("site_id", "doc_url", F.lit(True).alias("_broken"))
    return rows.join(broken, ["site_id", "doc_url"], "left").filter("_broken IS NULL OR loc IS NULL").select(*rows.columns)


def reachable_documents(documents: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the documents found from ``roots`` (``site_id, doc_url``) by following index files, and index errors.

    Rounds go on until no document is new, however deep the index. Each joins the newly named documents by URL and drops
    those seen; every round is written to
    the shared folder, so a lost executor repeats one round only. Other-origin children are errors. ``documents`` are texts, or rows read already.
    """
    parsed = documents if "loc" in documents.columns else cut_lineage(read_documents(documents), "sitemap-docs")
    found = cut_lineage(roots.select("site_id", "doc_url").distinct(), "sitemap-round")
    frontier, errors = found, None
    while True:
        children = (
            parsed.filter("kind = 'sitemapindex' AND loc <> ''")
            .join(frontier, ["site_id", "doc_url"], "left_semi")
            .select("site_id", F.col("doc_url").alias("parent"), "loc")
            .withColumn("child", urls.join_url(F.col("parent"), F.col("loc")))
        )
        own = urls.is_http(F.col("child")) & (urls.origin(F.col("child")) == F.col("site_id"))
        outside = children.filter(~own).select("site_id", F.col("parent").alias("doc_url"), F.lit("child_not_same_origin").alias("error"))
        errors = outside if errors is None else errors.unionByName(outside)
        fresh = (
            children.filter(own)
            .select("site_id", F.col("child").alias("doc_url"))
            .distinct()
            .join(found, ["site_id", "doc_url"], "left_anti")
        )
        frontier = cut_lineage(fresh, "sitemap-round")
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return parsed.join(found, ["site_id", "doc_url"], "left_semi"), errors


def sitemap_locations(parsed: DataFrame) -> DataFrame:
    """``site_id, url, doc_url, n`` of page locations; ``n > 1`` marks a repeated location."""
    good = parsed.filter("kind = 'urlset' AND loc IS NOT NULL").filter(urls.is_http(F.col("loc")))
    return good.select("site_id", urls.normalized(F.col("loc")).alias("url")).groupBy("site_id", "url").agg(
        F.count("*").alias("n")
    )


def sitemap_errors(parsed: DataFrame) -> DataFrame:
    """Document errors and locations that are no absolute http(s) URL."""
    docs = parsed.filter("error IS NOT NULL").select("site_id", "doc_url", "error")
    locs = (
        parsed.filter("kind = 'urlset' AND loc IS NOT NULL")
        .filter(~urls.is_http(F.col("loc")))
        .select("site_id", "doc_url", F.lit("location_not_absolute").alias("error"))
    )
    return docs.unionByName(locs)
