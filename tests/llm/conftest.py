import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    def make(rows, extra=""):
        return spark.createDataFrame(rows, DOC + extra)

    return make


@pytest.fixture
def odd(documents):
    """Nulls in every column, empty and blank texts, repeated rows, a very long text, columns with clashing names."""
    long_ = "palabra " * 40000
    rows = [
        (1, "uno dos tres cuatro", "es", "a", 1, "x", 0), (1, "uno dos tres cuatro", "es", "a", 1, "x", 0), (2, None, None, None, None, None, None), (3, "", "en", "b", 0, "", 1),
        (4, " \n\t ", None, "b", 0, "y", 2), (None, "uno dos tres cuatro", "en", None, 3, "z", 3), (5, long_, "fr", "a", 9, "k", 4), (6, "UNO dos tres cuatro", "es", "c", 4, "h", 5), (7, "1234 !!", "de", "c", 4, "n", 6),
    ]
    return documents(rows, ", size string, part int")
