import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

#: Columns whose names clash with those that operators use inside.
EXTRA = "'x' AS id, 1 AS size, 2 AS region, 'y' AS rule, 3 AS block, 'z' AS host, 0 AS s, 'k' AS kind, 1 AS epoch, 1.0 AS score, 'q' AS word, 1 AS row"


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents-like rows of (doc_id, text), with clashing extra columns."""

    def make(rows):
        full = [(i, t, "en", "src_1", None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *EXTRA.split(", "))

    return make


@pytest.fixture(scope="session")
def docs(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
