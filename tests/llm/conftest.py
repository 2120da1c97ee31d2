from __future__ import annotations

import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Documents from texts, or (doc_id, text) pairs, with columns whose names operators use themselves."""

    def make(texts, extra=True):
        pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        df = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in pairs], DOCUMENT)
        if not extra:
            return df
        names = ["score", "words", "n_words", "token", "tokens", "component", "node", "rep", "weight", "kept", "topic", "matches", "slot", "labels", "n_tokens"]
        return df.selectExpr("*", *(f"'x' AS {n}" for n in names))

    return make


@pytest.fixture
def empty(spark):
    """A table of the given columns without rows."""
    return lambda schema: spark.createDataFrame([], schema)
