import pytest

#: Edge rows: null and empty texts, a null id, a repeated row, white space only, a long text, odd characters.
EDGES = [
    (1, None), (2, ""), (3, " \t\n"), (None, "a row without an id but with some words"), (4, "same row"), (4, "same row"),
    (5, "long " * 40_000), (6, "\u0001\u0002 ▁ ퟿ ﬁ ② 日本語 😀 \r\n"), (7, "x" * 5_000),
]


@pytest.fixture(scope="session")
def edges(spark):
    """Edge rows with extra columns whose names clash with those that operators make."""
    rows = [(i, t, "keep me", 7, "w", False) for i, t in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_words int, _words string, kept boolean")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").toPandas()
