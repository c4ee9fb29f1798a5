"""Toxicity scores from a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

Texts are lower-cased, everything but letters becomes one space, and the character n-grams of 3 to 7 code points, spaces
included, are hashed into 2**18 features. A feature's value in a document is log(1 + 1000 x its share of the document's
n-grams), scaled by the log ratio of its smoothed count shares in the two classes. The ``FEATURES`` features whose counts
in toxic texts are farthest from what the size of that class lets expect enter a logistic regression with an L2 penalty.

Learning uses at most ``FIT_ROWS`` labelled rows, those first in an order by hash of their id; the bound keeps the fit on the
driver small (about 30 MB) whatever the corpus. Counts, selection and feature values are computed by Spark; every document is scored whole.

Defined results: a null text is an empty one and gets the score of no n-grams; a null id is not held out and has no label; a
document labelled twice is toxic if one label says so; null labels are not used; without labels of both kinds every score is the
share of toxic labels (0 without any); repeated rows are scored one by one; very long texts are read whole; texts of fewer than 50
n-grams are weighed as if they had 50, so that one word does not decide alone; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from searchloom.session import cut_lineage

BITS = 18
SIZES = range(3, 8)
FEATURES = 2000
FIT_ROWS = 20_000
_OTHER = re.compile(r"[\W\d_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def ngrams(text: str | None) -> Iterator[np.ndarray]:
    """Hashed n-grams of a text, one array for each size."""
    plain = f" {_OTHER.sub(' ', text.lower()).strip()} " if text else " "
    codes = np.frombuffer(plain.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    value = np.zeros(len(codes), np.uint64)
    for k in range(min(SIZES[-1], len(codes))):
        value = value[: len(codes) - k] * _BASE + codes[k:]
        if k + 1 in SIZES:
            mixed = value ^ (value >> np.uint64(31))
            mixed *= _MIX
            yield (mixed >> np.uint64(64 - BITS)).astype(np.int64)


def shares(text: str | None, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Selected features of a text and log(1 + 1000 x share); ``place`` gives a feature's number or -1."""
    total, found = 0, []
    for grams in ngrams(text):
        total += len(grams)
        at = place[grams]
        found.append(at[at >= 0])
    if not found:
        return np.empty(0, np.int64), np.empty(0)
    features, counts = np.unique(np.concatenate(found), return_counts=True)
    return features, np.log1p(1000.0 * counts / max(total, 50))


@dataclass
class Model:
    """``place``: feature number by hash, or -1; ``weight``: log-count ratio times learned weight."""

    place: np.ndarray
    weight: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        features, values = shares(text, self.place)
        return float(1.0 / (1.0 + np.exp(-(values @ self.weight[features] + self.bias))))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, rows: int) -> DataFrame:
    """``body`` and ``toxic`` of at most ``rows`` labelled documents outside the held-out part.

    The chosen ids are few by construction (about 20 bytes each), so they go to the documents and no text moves.
    """
    known = labels.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{label}`").cast("int").alias("toxic"))
    known = known.where(F.col("_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("_id")))
    chosen = known.groupBy("_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    texts = docs.select(F.col(f"`{doc_id}`").alias("_doc"), F.col(f"`{text}`").cast("string").alias("body"))
    sample = texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select("body", (F.col("toxic") > 0).cast("int").alias("toxic"))
    return cut_lineage(sample, "llm-labelled")


def feature_ratios(sample: DataFrame, features: int) -> pd.DataFrame:
    """``hash`` and ``ratio`` of the features whose toxic counts are farthest from the expected ones, in standard errors.

    A feature that is rarer than expected counts half: absence of words tells less.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, 1 << BITS), np.int64)  # clean, toxic
        for frame in batches:
            for body, toxic in zip(frame["body"], frame["toxic"]):
                grams = list(ngrams(body))
                if grams:
                    found, times = np.unique(np.concatenate(grams), return_counts=True)
                    sums[toxic][found] += times
        at = np.flatnonzero(sums[0] + sums[1])
        yield pd.DataFrame({"hash": at, "c0": sums[0][at], "c1": sums[1][at]})

    summed = sample.mapInPandas(count, "hash bigint, c0 bigint, c1 bigint").groupBy("hash").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    summed = cut_lineage(summed, "llm-ngrams")
    clean, toxic = (float(n or 0) for n in summed.agg(F.sum("c0"), F.sum("c1")).first())
    share = [(F.col(c) + 1) / F.lit(n + (1 << BITS)) for c, n in (("c0", clean), ("c1", toxic))]
    expected = (F.col("c0") + F.col("c1")) * F.lit(toxic / max(clean + toxic, 1.0))
    gap = F.col("c1") - expected
    clear = F.when(gap > 0, gap).otherwise(-gap / 2) / F.sqrt(expected + 1)
    ranked = summed.select("hash", F.log(share[1] / share[0]).alias("ratio"), F.round(clear, 9).alias("clear"))
    return ranked.orderBy(F.desc("clear"), "hash").limit(features).toPandas()


def design(sample: DataFrame, place: np.ndarray) -> pd.DataFrame:
    """Labels, features and values of the sample; bounded by its rows."""
    sent = sample.sparkSession.sparkContext.broadcast(place)

    def values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            pairs = [shares(body, sent.value) for body in frame["body"]]
            yield pd.DataFrame(
                {"toxic": frame["toxic"].to_numpy(), "at": [p[0].astype(np.int32) for p in pairs], "value": [p[1].astype(np.float32) for p in pairs]}
            )

    return sample.mapInPandas(values, "toxic int, at array<int>, value array<float>").toPandas()


def fit(rows: pd.DataFrame, ratios: np.ndarray, penalty: float = 0.3, steps: int = 250) -> tuple[np.ndarray, float]:
    """Weights (ratio included) and bias of the logistic regression, by full-batch gradient steps of adaptive size."""
    n = len(rows)
    sizes = np.fromiter(map(len, rows["at"]), np.int64, n)
    row = np.repeat(np.arange(n), sizes)
    at = np.concatenate([np.asarray(a, np.int64) for a in rows["at"]])
    value = np.concatenate([np.asarray(v, np.float64) for v in rows["value"]]) * ratios[at]
    label = rows["toxic"].to_numpy(np.float64)
    k = len(ratios)
    weight, mean, square = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1)  # the bias is last
    for step in range(1, steps + 1):
        z = np.bincount(row, value * weight[at], n) + weight[k]
        error = (1.0 / (1.0 + np.exp(-z)) - label) / n
        slope = np.append(np.bincount(at, value * error[row], k) + penalty * weight[:k] / n, error.sum())
        mean += 0.1 * (slope - mean)
        square += 0.01 * (slope * slope - square)
        weight -= 0.02 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return weight[:k] * ratios, float(weight[k])


def train(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
    features: int = FEATURES, fit_rows: int = FIT_ROWS,
) -> Model:
    """The classifier learned from the labelled documents outside the held-out part."""
    sample = labelled_sample(docs, labels, doc_id, text, label, fit_rows)
    place = np.full(1 << BITS, -1, np.int32)
    sizes = dict(sample.groupBy("toxic").count().collect())
    if len(sizes) < 2:
        sure = 40.0 if sizes.get(1) else -40.0
        return Model(place, np.empty(0), sure)
    ratios = feature_ratios(sample, features).sort_values("hash")
    place[ratios["hash"].to_numpy()] = np.arange(len(ratios))
    return Model(place, *fit(design(sample, place), ratios["ratio"].to_numpy()))


def scores(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1, higher: more likely toxic) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def scored(bodies: pd.Series) -> pd.Series:
        return pd.Series([sent.value.score(body) for body in bodies], dtype="float64")

    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), scored(F.col(f"`{text}`").cast("string")).alias("score"))
