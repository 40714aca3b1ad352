import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session", autouse=True)
def workers(spark):
    from codeatlas.llm.common import on_workers

    on_workers(spark)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, repeated rows and ids, a long text, ties."""
    long = "der lange Text mit vielen Worten " * 4000
    rows = [(1, "the quick brown fox jumps over the lazy dog", "en", "a", 43), (2, None, "en", "a", None),
            (3, "", None, None, 0), (4, " \t\n ", "de", "b", 4), (5, long, "de", "b", len(long)), (6, "ä" * 300, None, "b", 300),
            (1, "the quick brown fox jumps over the lazy dog", "en", "a", 43), (7, "one", "en", "c", 3),
            (7, "two other words here today", "en", "c", 26), (None, "no id at all but words", "en", "c", 22),
            (None, None, None, None, None), (8, "😀 emoji 漢字 text", "fr", "d", 16), (9, "12 34 !!", "en", "d", 8)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def clashing(odd_docs):
    """Extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    return odd_docs.withColumns({c: F.lit(i) for i, c in enumerate(
        ("fp", "key", "size", "shard", "th", "h1", "h2", "copies", "bucket", "range", "next", "sk", "__key", "__th", "p", "score", "cell"))})


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


@pytest.fixture(scope="session")
def sf(spark):
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
