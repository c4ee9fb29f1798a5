"""File trees as tables, ledger lines, digests and the report sink."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyarrow import fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from searchloom.functions import urls
from searchloom.session import cut_lineage


def read_site_tree(spark: SparkSession, root: str) -> DataFrame:
    """``(path, content)`` of every file below ``root``; bytes stay on the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(_below(root).alias("path"), "content")


def is_html_path(path: Column) -> Column:
    return F.lower(path).rlike(r"\.html?$")


def file_url(path: Column, base_url: Column) -> Column:
    """URL a static file answers to; ``index.html`` folds into its folder."""
    folded = F.regexp_replace(path, r"(^|/)index\.html$", "$1")
    return urls.normalized(urls.join_url(F.concat(F.regexp_replace(base_url, "/+$", ""), F.lit("/")), folded))


def tree_urls(files: DataFrame, base_url: Column) -> DataFrame:
    """HTML files as pages (with digest) and all other files as assets."""
    html = is_html_path(F.col("path"))
    plain = F.concat(F.regexp_replace(base_url, "/+$", ""), F.lit("/"), F.col("path"))
    return files.select(
        "*",
        F.when(html, F.lit("page")).otherwise(F.lit("asset")).alias("kind"),
        F.when(html, file_url(F.col("path"), base_url)).otherwise(urls.normalized(plain)).alias("url"),
    )


def with_digest(files: DataFrame, content: str = "content") -> DataFrame:
    return files.withColumn("sha256", F.sha2(F.col(content), 256))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """One row per ledger line with the line kept as written."""
    return ledger_fields(spark.read.text(path).withColumnRenamed("value", "line"))


def ledger_fields(lines: DataFrame) -> DataFrame:
    """Typed fields of each line; a line that is no JSON object gets NULLs and ``line_issue``."""
    schema = (
        "schema_version string, record_kind string, project_sha256 string, sequence bigint, previous_hash string, "
        "record_hash string, change_id string, status string"
    )
    parsed = F.from_json("line", schema, {"mode": "PERMISSIVE"})
    valid = F.try_parse_json("line").isNotNull() & F.trim("line").startswith("{")
    return lines.withColumn("_r", F.when(valid, parsed)).select(
        *lines.columns,
        "_r.*",
        F.when(F.trim("line") == "", F.lit("blank_line")).when(~valid, F.lit("not_a_json_object")).alias("line_issue"),
    )


def write_report(report: DataFrame, path: str, partition_by: Sequence[str], fmt: str = "json") -> int:
    """Report sink: a folder per partition value, never one file per report row; returns how many partitions were written.

    Only partitions of ``report`` that differ from what the manifest says of them are replaced, all others stay, so reports of several properties share a
    path and a repeated run writes nothing. The manifest (rows and digest of every partition, in ``_manifest``) is written last: a run
    that stops before it is done again by the next one.
    """
    keys = list(partition_by)
    ready = cut_lineage(report, "report")
    values = [F.col(f"`{c}`") for c in sorted(report.columns)]
    # sums of hashes of whole rows do not depend on their order
    content = F.xxhash64(F.to_json(F.struct(*values), {"ignoreNullFields": "false"}))
    stated = ready.groupBy(*keys).agg(F.count("*").alias("_rows"), F.sum(content.cast("decimal(38,0)")).cast("string").alias("_digest"))
    stated = cut_lineage(stated, "report-manifest")
    known = read_manifest(report.sparkSession, path, stated)
    same = known.withColumnsRenamed({c: f"_old_{c}" for c in known.columns})
    equal = [F.col(f"`{c}`").eqNullSafe(F.col(f"`_old_{c}`")) for c in stated.columns]
    changed = cut_lineage(stated.join(same, equal, "left_anti"), "report-changed")
    count = changed.count()
    if count:
        named = changed.select(*[F.col(f"`{k}`").alias(f"_key_{k}") for k in keys])
        moved = ready.join(named, [F.col(f"`{k}`").eqNullSafe(F.col(f"`_key_{k}`")) for k in keys], "left_semi")
        for rows, target, kind in ((moved, path, fmt), (changed, f"{path.rstrip('/')}/_manifest", "parquet")):
            rows.write.format(kind).option("partitionOverwriteMode", "dynamic").partitionBy(*keys).mode("overwrite").save(target)
    return count


def read_manifest(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Rows and digest of every partition of a written report; empty where there is none. ``like`` has its columns and types."""
    try:
        return spark.read.schema(like.schema).parquet(f"{path.rstrip('/')}/_manifest").select(*like.columns)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return like.limit(0)


# files up to this size are digested from one cell, larger ones piece by piece
CELL_BYTES = 64 << 20


def scan_tree(spark: SparkSession, root: str) -> DataFrame:
    """``path, length, sha256`` of every file below ``root`` that is not empty (Spark's file sources pass over empty ones).

    The listing reads no content. Small files are digested where Spark reads them; a file above ``CELL_BYTES`` is streamed through the digest in its
    task, so its size is not bounded by a cell; that needs a store that Arrow's file systems reach.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    small = listed.filter(F.col("length") <= CELL_BYTES).select("path", "length", F.sha2("content", 256).alias("sha256"))
    large = listed.filter(F.col("length") > CELL_BYTES).select("path", "length")
    return small.unionByName(large.mapInPandas(_digested, "path string, length bigint, sha256 string")).withColumn("path", _below(root))


def _below(root: str) -> Column:
    return F.regexp_replace("path", "^.*?" + re.escape(root.split(":", 1)[-1].strip("/")) + "/", "")


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system of a path or URI, and the path in it."""
    if re.match(r"^[A-Za-z][A-Za-z0-9+.-]*:", path):
        scheme, rest = path.split(":", 1)
        return (pafs.LocalFileSystem(), "/" + rest.lstrip("/")) if scheme == "file" else pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def _digested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        found = []
        for path in frame["path"]:
            store, name = _store(path)
            digest = hashlib.sha256()
            with store.open_input_stream(name) as file:
                while piece := file.read(1 << 20):
                    digest.update(piece)
            found.append(digest.hexdigest())
        yield frame.assign(sha256=found)


def write_tree(files: DataFrame, root: str) -> int:
    """Writes ``content`` (binary) of every row under its ``path`` below ``root``, in the tasks that hold the rows; returns the number of files."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _store(root)
        made: set[str] = set()
        for frame in batches:
            for path, content in zip(frame["path"], frame["content"]):
                folder = f"{base.rstrip('/')}/{path}".rpartition("/")[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(f"{base.rstrip('/')}/{path}") as out:
                    out.write(content or b"")
            yield pd.DataFrame({"n": [len(frame)]})

    written = files.select("path", "content").mapInPandas(write, "n bigint").agg(F.sum("n")).first()[0]
    return written or 0
