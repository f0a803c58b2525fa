import pytest
from pyspark.sql import types as T

from corpusgraph.llm.registry import ready

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("score", T.StringType()), T.StructField("content", T.StringType()),
                     T.StructField("row", T.StringType()), T.StructField("kept", T.StringType())])


def prose(seed: int, n: int) -> str:
    """Invented words, the same for a seed."""
    import random
    r = random.Random(seed)
    return " ".join("".join(r.choice(["ba", "ro", "li", "tem", "us", "an", "do", "ki"]) for _ in range(r.randint(2, 5))) for _ in range(n))


@pytest.fixture(autouse=True)
def shipped(spark):
    ready(spark)


@pytest.fixture
def table(spark):
    """Rows (doc_id, text, lang, source) -> documents with extra columns that clash with the operators' own."""
    def make(rows):
        return spark.createDataFrame([(i, t, *(list(rest) + ["en", "src0"])[:2], "s", "c", "r", "k") for i, t, *rest in rows], DOCS)
    return make


@pytest.fixture
def odd(table):
    """Nulls, empty texts, a very long text, ties, repeated rows."""
    return table([(None, prose(1, 90)), (1, None), (2, ""), (3, " \n!? "), (4, prose(4, 60_000)), (5, prose(5, 80)), (5, prose(5, 80)),
                  (5, prose(6, 80)), (7, "x" * 300_000), (8, "one two"), (9, "one two", None, None), (10, prose(5, 80).upper())])
