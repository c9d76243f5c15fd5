import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

DATA = "/root/testdata/sf0.001"
DOCUMENTS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType())])


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.collect()}


@pytest.fixture
def docs_of(spark):
    """documents of (doc_id, text) pairs."""
    return lambda rows: spark.createDataFrame([(i, t, None, "host", len(t or "")) for i, t in rows], DOCUMENTS)


LONG = "word " * 60_000
#: Null and empty texts, ties, repeated rows, a null id, white space only, odd characters, and a very long text.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "same text here"), (4, "same text here"), (5, "same text here"), (None, "no id at all"), (6, "Ünïcödé ΑΒΓ 日本語 \x1c ½ '"), (7, LONG), (8, None)]


@pytest.fixture
def odd(docs_of):
    return docs_of(ODD)
