import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, repeated rows, equal texts, letters beyond ASCII."""
    prose = "the quick brown fox jumps over the lazy dog while seven wizards box quietly. "
    rows = [
        (1, prose * 3, "en", "a", 10),
        (2, prose * 3, "en", "a", 10),
        (2, prose * 3, "en", "a", 10),
        (3, None, None, None, None),
        (None, "Straße é 漢字 😀 " * 9, "de", "b", 5),
        (None, None, None, None, None),
        (4, "", "en", "", 0),
        (5, " \n\t ", "en", "a", 4),
        (6, "one", "en", "a", 3),
        (7, "x" * 5000, "en", "a", 5000),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def with_clashes(df):
    """``df`` with further columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    names = ["k1", "k2", "key", "row", "n", "sid", "start", "length", "found", "dropped", "data", "cell", "_class", "unit", "digest"]
    return df.withColumns({n: F.lit(1) for n in names})
