from __future__ import annotations

import pytest


@pytest.fixture
def docs(spark):
    """Documents with the columns of the driver's table, from (doc_id, text) rows."""

    def make(rows):
        data = [(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in rows]
        return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")

    return make
