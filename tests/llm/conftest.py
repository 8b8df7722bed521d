import pytest

#: Rows that every operator on documents must take: nulls, empty and blank texts, ties, repeats, long texts.
ODD = [
    (1, "The quick brown fox", "en"), (2, "the QUICK brown fox", None), (3, None, "en"), (4, "", "en"), (5, " \t\n ", "en"),
    (None, "the quick brown fox", "en"), (None, None, None), (1, "The quick brown fox", "en"), (6, "x " * 20000, "en"), (7, "ÀÉ à é   ß", "fr"), (6, "another text under a used id", "en"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Extra columns have names that clash with results and internals."""
    rows = [(i, t, l, "k", 7) for i, t, l in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string, `__id` long")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
