import pytest

ODD = "doc_id long, text string, lang string, source string, n_chars long, rep long, bucket string, component long, hash long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and blank texts, repeated rows, a long text, columns with clashing names."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(12000))
    rows = [(1, "", "en", "s"), (2, None, None, None), (None, "some words of no document", "en", "s"), (None, None, None, None), (3, " \t\n ", "en", "s"), (4, "one", "en", "s"), (5, long, "en", "s"), (6, long, "de", "s"), (7, "a b c d e f", "de", "s"), (7, "a b c d e f", "de", "s"), (8, "12 34 !!", "de", None)]
    return spark.createDataFrame([(*r, 0, 1, "x", 2, 3) for r in rows], ODD)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
