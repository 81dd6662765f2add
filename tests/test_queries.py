import os

import pytest

from skillmill.plans import queries
from tests.oracle import FOLDER, compare

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    compare(spark, queries.QUERIES[name], queries.SQL.get(name))


def test_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["doc_id", "canonical"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_filters_and_columns_reach_the_scan(spark):
    plan = queries.QUERIES["page_clean"](spark, FOLDER)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(Resume_str)]" in plan and "ReadSchema: struct<row_id:bigint,Resume_str:string>" in plan
    for name in ("keyword_match", "rule_match", "document_results"):
        joins = queries.QUERIES[name](spark, FOLDER)._jdf.queryExecution().toString()
        assert "NestedLoop" not in joins and "Cartesian" not in joins


def test_mentions_are_canonicalised_by_vector_too(spark):
    got = queries.QUERIES["canonicalise_mentions"](spark, FOLDER).cache()
    assert got.where("confidence > 0.99").count() > 0 and got.where("confidence > 0 and confidence < 0.99").count() > 0
    assert got.where("confidence is null").count() == 0


def test_document_results_have_model_answers(spark):
    got = queries.QUERIES["document_results"](spark, FOLDER).cache()
    assert got.where("model_skills <> ''").count() > 0 and got.where("embedding_skills <> ''").count() > 0
