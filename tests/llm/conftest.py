from __future__ import annotations

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, source]) rows, with columns that clash with results' names."""

    def make(rows, extra=True):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOC).repartition(3)
        return df.selectExpr("*", "'x' AS score", "1 AS n_tokens", "'y' AS component_id", "'z' AS spans", "0 AS size", "0 AS length", "0 AS h") if extra else df

    return make
