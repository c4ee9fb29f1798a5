"""Small inputs shared by the tests of the training-text operators."""

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that the operators use inside
        *[T.StructField(n, T.StringType()) for n in ("_row", "body", "size", "fp", "m", "host", "digest", "kept", "n_words", "hits", "taken")],
    ]
)


def rows(pairs):
    return [(i, t, "en", s, len(t or "")) + ("x",) * (len(SCHEMA) - 5) for i, t, s in pairs]


LONG_TEXT = "Ünï ©öde wörds and more  <|endoftext|> it's 1234 don't\n\n\n  tail " * 3000
ODD = [
    (None, "null id here with some words", "a"),
    (1, None, "a"),
    (2, "", None),
    (3, " \t\r\n\x0b\x0c ", None),
    (4, "one", "b"),
    (5, "one two", "b"),
    (6, "one two three ONE TWO THREE one two three " * 30, "b"),
    (6, "one two three ONE TWO THREE one two three " * 30, "b"),
    (6, "same id, other text " * 20, "b"),
    (7, LONG_TEXT, "é"),
    (8, "line\nline\n\n \nline\nother # * $ % & | < >", "é"),
    (9, "line\nline\n\n \nline\nother # * $ % & | < >", "\U0001f600"),
]


def odd(spark):
    return spark.createDataFrame(rows(ODD), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
