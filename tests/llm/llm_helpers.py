"""Small tables for the tests of the corpus operators."""

from pyspark.sql import types as T

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())]
)
LONG = " ".join(f"word{n * 7919 % 10007}" for n in range(30_000))
#: Nulls in every column, empty and blank texts, a very long one, ties and repeated rows.
ODD = [
    (1, "One line of words here.\nAnother line, quite different.", "en", "a"),
    (1, "One line of words here.\nAnother line, quite different.", "en", "a"),
    (2, "one line of words here.\nAnother line, quite different.", "en", "a"),
    (3, "", "en", "b"),
    (4, None, None, None),
    (5, " \t\n\r\x0b\x0c", "de", "b"),
    (None, "No key, but a text of its own.", None, "c"),
    (None, None, None, None),
    (6, LONG, "en", "a"),
    (7, LONG + " end", "en", None),
    (8, "é ü 日本 🙂 token='abcdef12' <|endoftext|>", "fr", "c"),
    (9, "a b c d e f g a b c d e f g a b c d e f g", "en", "b"),
]


def docs(spark, rows=None):
    return spark.createDataFrame(ODD if rows is None else rows, DOCS).repartition(3)


def with_clashes(df, *names):
    """Further columns that have the names of results."""
    from pyspark.sql import functions as F

    for name in names:
        df = df.withColumn(name, F.lit("clash"))
    return df


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
