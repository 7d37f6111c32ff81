import pytest


@pytest.fixture(scope="session")
def work(spark):
    from wordtally.llm.common import Work

    return Work(spark)


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table (with an extra, clashing column) from (doc_id, text, lang, source) rows."""

    def make(rows):
        rows = [(*r, len(r[1] or ""), "x", 7) for r in rows]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, words string, fp int")

    return make
