import pytest

SPACE = "[\x20\x09-\x0d]"


@pytest.fixture(scope="session")
def make(spark):
    """Builds documents: rows of (doc_id, text[, source[, lang]])."""

    def build(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else "en") for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, source string, lang string")

    return build
