import pytest

EDGES = [
    (1, "the cat sat on the mat " * 30, "en", "a"), (2, "the cat sat on the mat " * 30, "en", "a"), (3, None, None, None), (4, "", "en", "b"), (5, " \n\t ", "fr", None),
    (6, "one", "de", "a"), (7, "ONE", "de", "a"), (8, "wörd " * 20000, "de", "a"), (9, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" idiot', "en", "b"), (9, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" idiot', "en", "b"), (None, "no id here", "en", "b"),
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and long texts, repeated rows, and a column whose name clashes."""
    return spark.createDataFrame([(*r, 0, "x") for r in EDGES], "doc_id long, text string, lang string, source string, n_chars long, score string")


@pytest.fixture(scope="session")
def no_docs(spark, edge_docs):
    return edge_docs.limit(0)
