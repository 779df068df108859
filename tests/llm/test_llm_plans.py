"""The native operators stay inside Spark; none forms products."""

import re

import pytest

from suitescope.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op1_source_mix", "op7_license_scan"])
def test_native(spark, name):
    plan = queries.QUERIES[name](spark, DATA)._jdf.queryExecution().toString()
    assert not re.search(r"Python|Pandas|MapInArrow|Scan ExistingRDD", plan)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_no_products(spark, name):
    plan = queries.QUERIES[name](spark, DATA)._jdf.queryExecution().toString()
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", plan)


def test_text_is_dealt_out_once(spark):
    """The three readings of documents by bucket share one exchange."""
    df = queries.QUERIES["op4_substring_dedup"](spark, DATA)
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()
