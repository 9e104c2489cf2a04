"""Documents with the awkward cases that every operator must take."""

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("fp", T.StringType()),
        T.StructField("size", T.StringType()),
        T.StructField("count", T.StringType()),
    ]
)


def documents(spark, rows):
    """rows: (doc_id, text[, source])."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 0, "x", "y", "z") for r in rows]
    return spark.createDataFrame(full, DOCS)


AWKWARD = [
    (1, None, None),
    (2, "", "a"),
    (3, "word", "a"),
    (4, "two words", "b"),
    (5, "Ünï ünï  wide \x0b tabs\tand\nlines  ", "b"),
    (6, "same text here, said twice over", "c"),
    (7, "same text here, said twice over", "c"),
    (7, "same text here, said twice over", "c"),
    (None, "no id at all", None),
    (9, "long " * 30000, "a"),
]
