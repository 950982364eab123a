import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = "doc_id long, text string, source string, digest string, __key int, point string, keys string, `a.b` int, set_id long, n_tokens string"


@pytest.fixture
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names an operator might use itself."""
    long_text = " ".join(f"word{i % 977} tail{i % 31}." for i in range(60_000))
    rows = [
        (1, "alpha beta gamma delta epsilon zeta", "s1"), (2, "alpha beta gamma delta epsilon zeta", "s1"), (2, "alpha beta gamma delta epsilon zeta", "s1"),
        (3, None, "s2"), (None, "alpha beta gamma delta epsilon zeta", None), (4, "", "s2"), (5, "   \n ", None), (6, long_text, "s3"), (7, "Licensed under the MIT License.\n\nAll rights reserved.", "s3"), (None, None, None),
    ]
    return spark.createDataFrame([(i, t, s, "x", 1, "p", "k", 5, 9, "n") for i, t, s in rows], ODD)


@pytest.fixture
def no_docs(odd_docs):
    return odd_docs.limit(0)
