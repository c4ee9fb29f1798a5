"""Word splitting shared by the operators of this subpackage.

All splitting works on UTF-8 bytes: the separators are ASCII, so multi-byte characters stay whole, and
``bytes.split`` and ``bytes.translate`` do the work without a pattern engine.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_UPPER = bytes(range(ord("A"), ord("Z") + 1))
# A-Z to a-z, everything else unchanged
LOWER = bytes.maketrans(_UPPER, _UPPER.lower())
# as LOWER, and ASCII outside [0-9a-z] becomes a space
PLAIN = bytes(
    0x20 if value < 0x80 and not chr(value).isalnum() else LOWER[value] for value in range(256)
)


LONG, STRING = T.LongType(), T.StringType()


def record(**fields: T.DataType) -> T.StructType:
    """A row type; unlike a DDL text it needs no session, so modules can be imported on executors."""
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


def space_words(text: str | None) -> list[bytes]:
    r"""Maximal runs of ``[^\x20\x09-\x0D]`` as UTF-8; none for a null text."""
    return text.encode().split() if text else []


def lower_space_words(text: str | None) -> list[bytes]:
    """``space_words`` after lower-casing A-Z."""
    return text.encode().translate(LOWER).split() if text else []


def plain_words(text: str | None) -> list[bytes]:
    r"""Maximal runs of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing A-Z."""
    return text.encode().translate(PLAIN).split() if text else []


def packed(df: DataFrame, *columns: Column) -> DataFrame:
    """The whole row in one column ``_row`` beside ``columns``, so that no column of ``df`` can clash."""
    return df.select(F.struct(*[F.col(f"`{name}`") for name in df.columns]).alias("_row"), *columns)


def unpacked(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns that ``packed`` put away."""
    return df.select(*[F.col("_row").getField(name).alias(name) for name in names])


def fresh(name: str) -> str:
    """A name no other run uses."""
    return f"{name}-{uuid.uuid4().hex}"
