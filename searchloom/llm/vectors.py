"""Usable vectors of a table, shared by the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """True for a vector that has entries, none of them null, NaN or infinite."""
    entry = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    wide = F.transform(vector, lambda x: x.cast("double"))
    return F.coalesce((F.size(vector) > 0) & F.forall(wide, lambda x: F.coalesce(entry(x), F.lit(False))), F.lit(False))


def scaled(vector: Column, factor: int, shift: int = 0) -> Column:
    """floor(``factor`` * entry) + ``shift`` of every entry, as long; entries are taken as doubles."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(factor))).cast("long") + F.lit(shift).cast("long"))


def commonest_length(rows: DataFrame, vector: str = "x") -> int:
    """Length that most vectors have, the larger of equal ones; 0 for no rows."""
    n = F.size(vector).alias("n")
    first = rows.groupBy(n).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("n")).first()
    return first["n"] if first else 0


def matrix(vectors: pd.Series, length: int) -> np.ndarray:
    """Rows of ``length`` 64-bit integers."""
    if not len(vectors):
        return np.empty((0, length), np.int64)
    return np.concatenate(vectors.to_numpy()).astype(np.int64, copy=False).reshape(len(vectors), length)
