"""Odd rows for the operators on vectors."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.IntegerType()),
        # names that the operators use inside
        *[T.StructField(n, T.StringType()) for n in ("row", "x", "kind", "none", "slice", "block", "_all", "m")],
    ]
)
NAN, INF = float("nan"), float("inf")


def table(spark, triples):
    return spark.createDataFrame([(i, v, n) + ("x",) * (len(SCHEMA) - 3) for i, v, n in triples], SCHEMA)


def random_rows(count, length=5, labels=3, seed=1, spread=1.0):
    rng = random.Random(seed)
    return [(i, [round(rng.gauss(0, spread) * 64) / 64 for _ in range(length)], rng.randrange(labels)) for i in range(count)]


ODD = [
    *random_rows(60),
    (100, None, 1), (150, [], 1), (200, [1.0, None, 2.0, 3.0, 4.0], 1), (250, [1.0, NAN, 2.0, 3.0, 4.0], 0), (300, [INF, 1.0, 2.0, 3.0, 4.0], 0),
    (350, [1.0, 2.0], 2), (400, [0.0] * 5, None), (None, [0.5, 0.25, -0.5, 1.0, 0.0], 1), (None, [0.5, 0.25, -0.5, 1.0, 0.0], 1),
    *[(50, [0.5, 1.0, -1.0, 0.25, 0.0], 0)] * 2, *[(500, [0.5, 1.0, -1.0, 0.25, 0.0], 0)] * 2, (450, [0.5, 1.0, -1.0, 0.25, 0.0], 1), (451, [0.5, 1.0, -1.0, 0.25, 0.0], 1),
]
