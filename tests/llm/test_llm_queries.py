"""The queries of the subpackage against their SQL in DuckDB, at the smallest scale."""

import duckdb
import pytest

from maskwright.llm import queries
from maskwright.llm.common import table


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    found = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(r[columns.index(c)] for c in sorted(columns)) for r in found.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in sorted(columns)) for r in df.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES) - {"pii_span_scores", "op13_main_text"}))
def test_rows(spark, sf, name):
    """A row a document, or more than one only for pieces."""
    df, docs = queries.QUERIES[name](spark, sf), table(spark, sf, "documents").count()
    rows = df.collect()
    assert len({r.doc_id for r in rows}) == docs
    assert len(rows) == docs or "piece" in df.columns
