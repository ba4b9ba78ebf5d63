"""Small frames for the training-data operators; the session comes from the parent folder."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def make_docs(spark):
    """Documents from (doc_id, text) pairs, with extra columns whose names clash with the operators' own."""

    def build(pairs):
        rows = [(i, t, "en", "s", len(t or ""), 7, "x", -1) for i, t in pairs]
        return spark.createDataFrame(rows, DOCS + ", n_tokens int, ids string, component_id int")

    return build


@pytest.fixture(scope="session")
def sf_small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_mid():
    return "/root/testdata/sf0.01"
