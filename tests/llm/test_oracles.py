"""Queries with a DuckDB form give its rows; the pipeline and the others run over their whole tables."""

import binascii

import pytest

from quirelake.llm import queries
from tests.duck import rows, views


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, sf, name):
    got = queries.QUERIES[name](spark, sf).toPandas()
    want = views(sf).sql(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(n for n in queries.QUERIES if n not in queries.ORACLE_SQL))
def test_query_covers_documents(spark, sf, name):
    ids = [r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()]
    got = queries.QUERIES[name](spark, sf).toPandas()
    assert sorted(got.doc_id) == sorted(ids)
    if "held_out" in got:
        assert all(h == (binascii.crc32(str(d).encode()) % 4 == 2) for d, h in zip(got.doc_id, got.held_out, strict=True))
