"""Every named query of the library against its SQL on the smallest tables."""

import pytest

from tests.conftest import DATA
from tidemark.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_sql(name, same):
    same(catalog.QUERIES[name], catalog.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(name, spark):
    assert catalog.QUERIES[name](spark, f"{DATA}/sf0.001").count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["query_id", "rank", "ordinal", "score"]
    assert set(catalog.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_plans(spark):
    """Top-k by group is cut before its shuffle, filters and columns reach the scan."""
    text = catalog.QUERIES["lexical_topk"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in text and "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text
    text = catalog.QUERIES["content_dedup"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text
