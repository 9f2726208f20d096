"""Small awkward tables for the operators."""

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

TEXTS = [
    "one two three four five six seven eight nine ten eleven twelve thirteen fourteen",
    "one two three four five six seven eight nine ten eleven twelve thirteen fourteen",
    "  one\ttwo three four  five six seven eight nine ten eleven twelve thirteen fourteen ",
    "",
    None,
    " ",
    "\n\t ",
    "a",
    "a ",
    "é  à ü x",
    "word " * 3000,
    "x" * 50_000,
    "same same same same same same",
    "a▁b  c ▁ d   ",
    "</s> <unk> <0x0A>\n\nzz",
]


def docs(spark, texts=TEXTS, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, None, None, None) for i, t in zip(ids, texts, strict=True)], SCHEMA)
