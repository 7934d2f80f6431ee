import pytest

SF = "/root/testdata/sf0.001"

#: Null and empty texts, blank texts, ties and repeated rows, a long text, null in every column, an extra column.
ROWS = [
    (1, "The cat sat on the mat and looked at the moon for a while.", "en", "a", 10, "x"),
    (2, "The cat sat on the mat and looked at the moon for a while.", "en", "b", 10, "x"),
    (2, "The cat sat on the mat and looked at the moon for a while.", "en", "b", 10, "x"),
    (3, None, "en", "a", None, None),
    (4, "", None, None, 0, "x"),
    (5, "   \n\t ", "de", "c", 5, "x"),
    (None, "A row without an id has words all the same.", "en", "a", 3, "x"),
    (7, "word " * 20000, "en", "d", 100000, "x"),
    (8, "x" * 5000, "fr", "d", 5000, "x"),
    (9, "Ein Satz mit Wörtern, Zahlen 123 und Zeichen <|endoftext|> darin. 漢字 🙂", "de", "e", 60, "x"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
