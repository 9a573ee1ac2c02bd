from __future__ import annotations

import pytest


@pytest.fixture
def docs_of(spark):
    """A documents table with clashing extra columns from (doc_id, text) rows."""

    def build(rows, name: str = "text"):
        schema = f"doc_id long, {name} string, digest string, `found__` long, content string, n long"
        return spark.createDataFrame([(i, t, "x", 7, None, n) for n, (i, t) in enumerate(rows)], schema)

    return build
