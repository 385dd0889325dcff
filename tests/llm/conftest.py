from __future__ import annotations

import pytest
from corpus_rows import SF, edge_rows, table


@pytest.fixture(scope="session")
def edges(spark):
    return table(spark, edge_rows())


@pytest.fixture(scope="session")
def nothing(spark):
    return table(spark, [])


@pytest.fixture(scope="session")
def small(spark):
    """(rows, path) of the smallest documents table."""
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()], SF
