import pytest

from barograph.llm.common import reachable


@pytest.fixture(scope="session", autouse=True)
def workers_find_the_package(spark):
    reachable(spark)


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents from a list of texts or (doc_id, text[, source]) rows, with columns whose names clash with
    what operators make."""

    def make(rows):
        full = []
        for i, r in enumerate(rows):
            r = r if isinstance(r, tuple) else (i, r)
            full.append((r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), i, 1.0, "x", 2))
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, _size int, score double, component_id string, `a.b` int")

    return make


#: Cases that every operator on documents has to take.
ODD = [
    (0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "one"), (4, "one"), (None, "no id at all"), (5, "é ü 漢字 \U0001f600 İstanbul ΟΔΟΣ ﬁ"),
    (6, "word " * 70_000), (7, "x" * 300_000), (8, "a b\x0bc\x0cd\x85e\xa0f"), (9, "it's <|endoftext|> </s> a.b,c-- 12"),
]


@pytest.fixture(scope="session")
def odd_docs(docs_of):
    return docs_of(ODD)
