import pytest
from odd_texts import ODD


@pytest.fixture
def docs(spark):
    """rows (doc_id, text[, source]) to a table with columns whose names clash with the operators' own."""

    def make(rows):
        full = [(*r, "h") if len(r) == 2 else r for r in rows]
        return spark.createDataFrame([(d, t, "en", s, len(t or ""), 1, 2, "q", 5, "x") for d, t, s in full],
                                     "doc_id bigint, text string, lang string, source string, n_chars bigint, k int, n int, t string, g int, host string").repartition(3)

    return make


@pytest.fixture
def odd(docs):
    """Nulls, empty and long texts, ties, a repeated row and a row without id."""
    return docs([(i, t) for i, t in enumerate(ODD)] + [(8, ODD[8]), (None, "no id at all")])
