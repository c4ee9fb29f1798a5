"""Whitening of vectors with eigenvectors found by spectral divide and conquer on polar decompositions.

Entries become integers, and each distinct vector is fitted once. Sums and products of centred entries are added as whole
numbers over all distinct vectors, in batches on the executors, so the covariance does not depend on how rows are dealt. It is a
dimension x dimension table, and only that comes to the driver. Its eigenvectors come from QDWH divide and conquer: the
unitary polar factor of the covariance shifted by a value inside its spectrum, computed by dynamically weighted Halley
iterations on QR factors, is the sign of the shifted matrix; half of (sign + identity) projects on the space of eigenvalues above
the shift; an orthonormal basis of that space and of its complement splits the matrix in two, which are split further until
single values are left. The chosen components are small and go to every row with the broadcast of the task.

Defined results: rows with a null or empty vector or an entry that is null or not finite are dropped, and so are vectors of another length
than the commonest; a null id stays null; repeated rows are whitened one by one and fitted once; components whose
variance is not above ``FLAT`` of the largest one's are none (equal vectors, fewer distinct vectors than dimensions), so a table
with one distinct vector, like an empty table, gives an empty result; among equal variances any basis of their space is right. Only the
two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchloom.llm.vectors import commonest_length, finite, matrix, scaled
from searchloom.session import cut_lineage

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
# share of the largest variance below which a direction counts as flat
FLAT = 1e-12
# whole numbers up to here are exact as doubles
EXACT = 1 << 53


def polar_sign(a: np.ndarray) -> np.ndarray:
    """Unitary polar factor of a symmetric matrix (its sign) by QDWH iterations on QR factors."""
    n = len(a)
    x = a / max(np.linalg.norm(a), np.finfo(float).tiny)
    # a lower bound of the smallest singular value; too small a one costs a round, not precision
    low = max(1.0 / (np.linalg.norm(np.linalg.pinv(x), 1) * np.sqrt(n)), 1e-16)
    for _ in range(60):
        square = low * low
        root = np.cbrt(4 * (1 - square) / square**2)
        a_k = np.sqrt(1 + root) + 0.5 * np.sqrt(8 - 4 * root + 8 * (2 - square) / (square * np.sqrt(1 + root)))
        b_k = (a_k - 1) ** 2 / 4
        c_k = a_k + b_k - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(c_k) * x, np.eye(n)]))
        nxt = (b_k / c_k) * x + (a_k - b_k / c_k) / np.sqrt(c_k) * q[:n] @ q[n:].T
        moved, x = np.linalg.norm(nxt - x), (nxt + nxt.T) / 2
        low = min(low * (a_k + b_k * square) / (1 + c_k * square), 1.0)
        if moved < 1e-14 * n and abs(low - 1) < 1e-14 or moved == 0:
            break
    return x


def _split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the spaces of ``a``'s eigenvalues above and below a shift; None if ``a`` is a multiple of the identity."""
    n = len(a)
    centre = np.trace(a) / n
    spread = np.linalg.norm(a - centre * np.eye(n))
    if spread <= 4 * np.finfo(float).eps * np.linalg.norm(a):
        return None
    # the median of the diagonal halves the spectrum as a rule; other shifts follow where it does not cut
    for shift in (float(np.median(np.diag(a))), centre, centre + spread / n, centre - spread / n):
        sign = polar_sign(a - shift * np.eye(n))
        rank = round((np.trace(sign) + n) / 2)
        if not 0 < rank < n:
            continue
        projector = (sign + np.eye(n)) / 2
        # columns of largest norm first; a second pass makes the basis precise
        order = np.argsort(-np.einsum("ij,ij->j", projector, projector), kind="stable")
        basis = projector[:, order]
        q, _ = np.linalg.qr(_independent(basis, rank))
        q, _ = np.linalg.qr(projector @ q)
        whole, _ = np.linalg.qr(np.hstack([q, np.eye(n)]))
        above, below = whole[:, :rank], whole[:, rank:n]
        if np.linalg.norm(above.T @ a @ below) <= 1e-12 * np.linalg.norm(a):
            return above, below
    raise ArithmeticError("no shift splits the spectrum")


def _independent(columns: np.ndarray, rank: int) -> np.ndarray:
    """``rank`` columns that span the space, by pivoting on what is left of each one."""
    rest, chosen = columns.copy(), []
    for _ in range(rank):
        at = int(np.argmax(np.einsum("ij,ij->j", rest, rest)))
        chosen.append(at)
        unit = rest[:, at] / np.linalg.norm(rest[:, at])
        rest -= np.outer(unit, unit @ rest)
    return columns[:, chosen]


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix by recursive splitting."""
    vectors, open_parts = [], [np.eye(len(a))]
    while open_parts:
        basis = open_parts.pop()
        part = basis.T @ a @ basis
        halves = _split((part + part.T) / 2) if basis.shape[1] > 1 else None
        if halves is None:
            vectors.append(basis)
        else:
            open_parts += [basis @ half for half in halves]
    found = np.hstack(vectors) if vectors else np.zeros((0, 0))
    found = refined(a, found)
    values = np.einsum("ij,ik,kj->j", found, a, found)
    order = np.argsort(-values, kind="stable")
    return values[order], found[:, order]


def refined(a: np.ndarray, vectors: np.ndarray, rounds: int = 2) -> np.ndarray:
    """Eigenvectors corrected to first order by what is left of ``a`` off the diagonal and of their products off the identity."""
    for _ in range(rounds):
        products, inside = vectors.T @ vectors, vectors.T @ a @ vectors
        rest, inside = np.eye(len(products)) - (products + products.T) / 2, (inside + inside.T) / 2
        values = np.diag(inside) / (1 - np.diag(rest))
        gap = values[None, :] - values[:, None]
        near = np.abs(gap) <= 1e-8 * max(np.abs(values).max(initial=0), np.finfo(float).tiny)
        moved = np.where(near, rest / 2, (inside + values[None, :] * rest) / np.where(near, 1, gap))
        vectors = vectors + vectors @ moved
    return vectors


@dataclass(frozen=True)
class Components:
    """What rows are whitened with: ``n`` fitted vectors with sums ``shift`` * n + ``rest``, and a column per component."""

    n: int
    shift: np.ndarray
    rest: np.ndarray
    vectors: np.ndarray
    variances: np.ndarray
    total: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.shift) - self.rest / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.variances))

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S)^2, exact; what does not fit a long raises."""
        y = x - self.shift
        most = self.n * int(np.abs(y).max(initial=0)) + int(np.abs(self.rest).max(initial=0))
        kind = np.int64 if most**2 * max(1, x.shape[1]) < 1 << 63 else object
        found = (self.n * y.astype(kind) - self.rest.astype(kind)) ** 2
        return found.sum(axis=1).tolist()


def _products(fit: DataFrame, length: int, rows_of, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``rows_of`` (x) and of its products, over all rows of ``fit``: vector and matrix of ``width``.

    A task hands on one row per entry of the upper triangle; they are added map-side and then by Spark.
    """
    upper = np.triu_indices(width)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, products = np.zeros(width), np.zeros((width, width))
        for frame in batches:
            y = rows_of(matrix(frame["x"], length))
            sums += y.sum(axis=0)
            products += y.T @ y
        i, j = np.concatenate([upper[0], np.arange(width)]), np.concatenate([upper[1], np.full(width, -1)])
        yield pd.DataFrame({"i": i, "j": j, "v": np.concatenate([products[upper], sums])})

    found = fit.select("x").mapInPandas(partial, "i bigint, j bigint, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    sums, products = np.zeros(width), np.zeros((width, width))
    i, j, v = found["i"].to_numpy(), found["j"].to_numpy(), found["v"].to_numpy()
    one = j < 0
    sums[i[one]] = v[one]
    products[i[~one], j[~one]] = v[~one]
    products[j[~one], i[~one]] = v[~one]
    return sums, products


def fitted(fit: DataFrame, length: int, components: int = COMPONENTS) -> Components | None:
    """Components of the distinct vectors ``fit`` (``x``); None where nothing varies.

    Entries are centred by the whole number nearest to their mean before they are multiplied; their sums and products are then small
    whole numbers, exact as doubles, and the remaining part of the mean, below a half, is taken out exactly.
    """
    sums = fit.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n"))
    found = {r["i"]: (int(r["s"]), r["n"]) for r in sums.collect()}
    if not found:
        return None
    n = found[0][1]
    shift = [(2 * found[i][0] + n) // (2 * n) for i in range(length)]
    rest = [found[i][0] - n * m for i, m in enumerate(shift)]
    middle = np.array(shift, np.int64)
    _, products = _products(fit, length, lambda x: (x - middle).astype(np.float64), length)
    t = np.array(rest, np.float64)
    if products.max(initial=0) < EXACT:  # whole numbers: n x products - rest x rest without rounding
        whole = products.astype(np.int64).astype(object) * n - np.outer(np.array(rest, object), np.array(rest, object))
        covariance = np.array([[float(v) for v in row] for row in whole]).reshape(length, length) / float(n) / float(n)
    else:
        covariance = products / n - np.outer(t / n, t / n)
    total = float(np.trace(covariance))
    if total <= 0:
        return None
    values, vectors = eigen(covariance)
    keep = np.flatnonzero(values[:components] > FLAT * values[0])
    return Components(n, middle, np.array(rest, np.int64), vectors[:, keep], values[keep], total)


def identity_error(fit: DataFrame, length: int, parts: Components) -> float:
    """Largest entry of the whitened vectors' covariance minus the identity."""
    width = len(parts.variances)
    sums, products = _products(fit, length, parts.whitened, width)
    return float(np.abs(products / parts.n - np.outer(sums / parts.n, sums / parts.n) - np.eye(width)).max())


def usable(rows: DataFrame, vec_id: str, vector: str, scale: int, shift: int) -> DataFrame:
    kept = rows.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{vector}`").alias("x")).where(finite(F.col("x")))
    return kept.select("vec_id", scaled(F.col("x"), scale, shift).alias("x"))


SCHEMA = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whitened(
    rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT
) -> DataFrame:
    """A row per usable vector and component: ``vec_id``, ``component`` (from 1), ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``."""
    entries = usable(rows, vec_id, vector, scale, shift)
    fit = cut_lineage(entries.select("x").distinct(), "llm-fit-list")
    length = commonest_length(entries)
    fit = fit.where(F.size("x") == length)
    parts = fitted(fit, length, components)
    if parts is None:
        return rows.sparkSession.createDataFrame([], SCHEMA)
    error, explained = identity_error(fit, length, parts), (parts.variances / parts.total).tolist()

    @F.pandas_udf("struct<deviation: bigint, whitened: array<double>>")
    def measured(vectors: pd.Series) -> pd.DataFrame:
        x = matrix(vectors, length)
        deviation = np.array(parts.deviation(x), dtype=np.int64)
        return pd.DataFrame({"deviation": deviation, "whitened": list(parts.whitened(x)) if len(x) else []})

    found = entries.where(F.size("x") == length).select("vec_id", measured("x").alias("m"))
    each = found.select("vec_id", "m.deviation", F.posexplode("m.whitened").alias("_at", "whitened"))
    share = F.element_at(F.array(*map(F.lit, explained)), F.col("_at") + 1)
    return each.select(
        "vec_id", (F.col("_at") + 1).cast("int").alias("component"), F.lit(parts.n).cast("long").alias("n"), "deviation", "whitened",
        share.alias("explained"), F.lit(error).alias("identity_error"),
    )
