import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, class string, score string"


@pytest.fixture
def make(spark):
    """documents from (doc_id, text[, lang]) rows; further columns have names that operators use inside."""

    def of(*rows):
        rows = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or ""), "c", "x") for r in rows]
        return spark.createDataFrame(rows, SCHEMA)

    return of


@pytest.fixture
def odd(make):
    """Nulls, empty, blank and very long texts, repeated rows."""
    return make((1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "a null id"), (5, "a b c d e f"), (6, "long " * 60_000), (7, "é日本😀 \u00a0x"))
