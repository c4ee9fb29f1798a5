"""Input tables and the projections that turn them into the library's input shapes.

A projection is plain SQL that both Spark and the checking database run unchanged (``VIEWS``), so a
query and its check start from the same rows; everything after the projection is written twice.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Mapping

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

# name -> (names of the views it reads, SQL body)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, body: str, needs: tuple[str, ...] = ()) -> None:
    VIEWS[name] = (needs, body.strip())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _closure(names: tuple[str, ...], given: Collection[str] = ()) -> list[str]:
    ordered: list[str] = []

    def visit(item: str) -> None:
        if item in given:
            return
        for need in VIEWS[item][0]:
            visit(need)
        if item not in ordered:
            ordered.append(item)

    for name in names:
        visit(name)
    return ordered


def with_views(*names: str, extra: str = "", recursive: bool = False, given: Collection[str] = ()) -> str:
    """``WITH`` clause defining the named views (and what they read, but for the ``given`` ones) for a check."""
    parts = [f"{name} AS (\n{VIEWS[name][1]}\n)" for name in _closure(names, given)]
    if extra:
        parts.append(extra.strip())
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"


def load_view(spark: SparkSession, sf_dir: str, name: str, given: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """The named projection as a DataFrame over the tables in ``sf_dir``; ``given`` holds projections on its way that are there already."""
    given = given or {}
    for item, rows in given.items():
        rows.createOrReplaceTempView(item)
    text = with_views(name, given=given).replace("sha256(", "searchloom_sha(")
    for item in TABLES:
        if re.search(rf"\b{item}\b", text):
            table(spark, sf_dir, item).createOrReplaceTempView(item)
    # the one function the two dialects name differently
    return spark.sql(_rename_sha(text) + f"SELECT * FROM {name}")


def _rename_sha(text: str) -> str:
    out, marker = [], "searchloom_sha("
    while marker in text:
        head, _, rest = text.partition(marker)
        depth, end = 1, 0
        while depth:
            depth += {"(": 1, ")": -1}.get(rest[end], 0)
            end += 1
        out.append(f"{head}sha2({rest[: end - 1]}, 256)")
        text = rest[end:]
    return "".join(out) + text
