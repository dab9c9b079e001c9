"""Every registered query of the search engine against its SQL."""

import zlib

import pytest

import __spark_entry__
from siltstone import queries

from .conftest import SF


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_checksums(spark):
    import pyarrow.parquet as pq

    table = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    want = {str(r["doc_id"]): f"{zlib.crc32(r['text'].encode()):08x}" for r in table}
    assert {r["document_id"]: r["crc32"] for r in queries.document_checksums(spark, SF).collect()} == want


def test_entry_and_registry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["document_id", "score"] and df.count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_reach_the_scan(spark):
    plan = queries.filter_conjunction(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan and "GreaterThanOrEqual(o_totalprice,200000.0)" in plan
    assert "o_orderpriority" not in plan.split("ReadSchema")[1] and "Exchange" not in plan


@pytest.mark.parametrize("name", ["bm25_match_or", "explain_terms", "match_field_restricted", "bool_full"])
def test_scores_and_statistics_share_a_scan(spark, name):
    df = queries.QUERIES[name](spark, SF)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in plan and plan.count("FileScan parquet") == 1


def test_no_shuffle_of_tokens(spark):
    plan = queries.inverted_index_postings(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan
