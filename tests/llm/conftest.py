import pytest

EDGE = "doc_id long, text string, lang string, source string, n_chars long, digest string, label string, score double, _id string, _mark long, _batch int, _text string, _lang_pred string, fingerprint string, ids array<int>, `a.b` string"


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in any column, empty, letterless and very long texts, repeated rows, equal ids, extra
    columns whose names clash with those that the operators make."""
    long_text = " ".join(f"word{i % 977} filler" for i in range(30_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog and runs away from the old house", "en", "s", 1),
        (2, "the quick brown fox jumps over the lazy dog and runs away from the old house", "en", "s", 1),
        (2, "the quick brown fox jumps over the lazy dog and runs away from the old house", "en", "s", 1),
        (2, "Étranger, ça va? 日本語 \U0001f600 ﬁn", "fr", None, 1),
        (3, None, None, None, None),
        (None, "a row without an id", "en", "s", 1),
        (None, None, None, None, None),
        (4, "", "en", "s", 0),
        (5, "12 34 !!", "en", "s", 8),
        (6, long_text, "de", "s", 1),
        (7, "x" * 5000, "de", "s", 1),
        (8, " \n\t ", "de", "s", 1),
    ]
    return spark.createDataFrame([(*r, "d", "l", 0.5, "own", 7, 8, "t", "p", "f", [1], "dot") for r in rows], EDGE)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], EDGE)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
