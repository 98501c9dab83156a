import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """documents from (doc_id, text) or longer tuples, with an extra column whose name operators use."""
    def build(rows, schema=DOCS):
        n = len(schema.split(","))
        full = [tuple(r) + (None,) * (n - len(r)) + ("clash",) for r in rows]
        return spark.createDataFrame(full, schema + ", kept string")
    return build


ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "a b c d e f g"), (4, "word"), (5, "long " * 30_000 + "end"),
       (6, "é ü ñ 日本語 😀 \u2028 x"), (7, "same text here for all of us"), (8, "same text here for all of us"),
       (7, "same text here for all of us")]


@pytest.fixture(scope="session")
def odd(make):
    """Nulls, empty and very long texts, ties and repeated rows."""
    return make(ODD)


@pytest.fixture(scope="session")
def none(make):
    return make([])
