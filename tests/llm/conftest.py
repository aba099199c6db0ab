import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, ties, clashing extra columns."""
    long = " ".join(f"word{i % 97} thing{i}" for i in range(6000))
    same = "the quick brown fox jumps over the lazy dog and runs far away from the old grey barn near the river today"
    rows = [
        (0, same, "x"), (1, same, "x"), (1, same, "x"), (2, None, "y"), (3, "", None), (4, long, "z"), (5, long + " tail", "z"),
        (6, "one two", "q"), (None, same + " more", "n"), (7, "  \n\t \n", "w"), (8, "ünïcödé " * 30, "u"), (9, same.upper(), "x"),
        (10, "a  b   c \n  d " + same + "\n\n" + same, "x"),
    ]
    return spark.createDataFrame([(a, b, c, 1, "k", "b") for a, b, c in rows], "doc_id long, text string, source string, block int, key string, bucket string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
