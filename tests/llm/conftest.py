import pytest


def words(seed, n, stem="w"):
    return " ".join(f"{stem}{(seed * 7919 + k * 104729) % 1009}" for k in range(n))


@pytest.fixture
def corpus(spark):
    """Documents with nulls in every column, empty and very long texts, copies, near copies, repeated rows and a clashing column."""
    base = words(1, 120)
    shared = "this line stands in many documents and is long enough to count"
    rows = [
        (1, base, "en", "a", 10, "x"), (2, base, "en", "a", 10, "x"), (3, base + " end", "en", None, 10, "x"), (4, base.replace("w5", "v5"), "de", "b", None, None),
        (5, None, "en", "a", 0, "x"), (6, "", None, "b", 0, "x"), (7, " \t\n\x0b ", "en", "b", 5, "x"), (8, words(2, 40000), "fr", "c", 1, "x"), (8, words(2, 40000), "fr", "c", 1, "x"),
        (None, base, "en", "a", 1, "x"), (None, None, None, None, None, None), (9, "one two", "en", "é", 2, "x"), (10, "one two", "en", "a", 2, "x"), (11, "!!! 123 ---", "en", "a", 2, "x"),
        *((20 + k, f"{words(100 + k, 30)}\n  {shared.upper() if k % 2 else shared} \nshort\n", "en", "a", 1, "x") for k in range(6)),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string")


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, size string")
