from __future__ import annotations

import pytest

DOCUMENT = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"


@pytest.fixture
def documents(spark):
    """A frame of documents from (doc_id, text) pairs, with columns whose names operators use inside."""

    def make(rows):
        full = [(i, t, "en", "s", None if t is None else len(t), 1, "x", 2.0) for i, t in rows]
        return spark.createDataFrame(full, DOCUMENT + ", n INT, key STRING, found DOUBLE").repartition(3)

    return make


@pytest.fixture
def rows():
    def read(df, key="doc_id"):
        return sorted((r.asDict() for r in df.collect()), key=lambda r: (r[key] is not None, r[key] or 0))

    return read
