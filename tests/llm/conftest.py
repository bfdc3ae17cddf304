import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    """doc_id to text, ascending."""
    return {r.doc_id: r.text for r in docs.orderBy("doc_id").collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and blank texts, repeated rows and ids, one long text, clashing extra columns."""
    rows = [
        (1, None, "en", "a", 0, 1.0, "x"), (2, "", None, None, 0, None, None), (3, " \n\t ", "en", "b", 4, 2.0, "y"), (None, "some words here", "en", "a", 15, 3.0, "z"),
        (4, "the same text of nine words in a row", "en", "a", 36, 1.0, "p"), (4, "the same text of nine words in a row", "en", "a", 36, 1.0, "p"), (5, "the same text of nine words in a row", "de", None, 36, 1.0, "p"),
        (6, "other text under one id", "de", "b", 23, 1.0, "p"), (6, "another text under one id", "de", "b", 25, 1.0, "p"), (7, "word " * 30000, "fr", "b", 150000, 1.0, "p"), (8, "12 34 !!", "fr", "c", 8, 1.0, "p"),
        (9, "élan <|endoftext|> 漢字  two  blanks\n \n🙂", None, "c", 40, 1.0, "p"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, _key string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
