import pytest
from pyspark.sql import types as T

TEXTS = [
    (1, None), (2, ""), (3, "   \n\t "), (None, "words of a row without an id that is long enough for things"),
    (4, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"),
    (5, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"),
    (5, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"),
    (6, "Ünï cödé ▁ 😀 \x00 tail\r\n<|endoftext|> </s> mail a.b@c.example.org +1 (988) 555-2485 10.0.0.255"),
    (7, "x" * 30_000), (8, "the same word " * 3_000), (9, "a b"), (10, "a b"),
    (11, "card 4041 8949 7460 8795 iban DE89 3704 0044 0532 0130 00 end"),
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing extra columns."""
    names = ["lang", "n_tokens", "score", "kept", "id", "text2", "h", "w", "k", "g", "cid", "found", "row"]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                           *[T.StructField(n, T.StringType()) for n in names]])
    rows = [(i, t, *([None if k % 2 else "x"] * len(names))) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def empty_docs(edge_docs):
    return edge_docs.limit(0)


@pytest.fixture(scope="session")
def small_docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
