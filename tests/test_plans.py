"""Plans: what is pushed to the scans, what never occurs."""

import re

import pytest

from suitescope.plans import catalogue

DATA = "/root/testdata/sf0.001"
#: These read a few inline rows, or a git history, through Python on purpose.
PYTHON = {"suite_directories", "extract_fixture_tests", "extract_status", "extract_summary", "introducing_commits"}


def plan_of(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_no_products_and_no_python(spark, name):
    plan = plan_of(catalogue.QUERIES[name](spark, DATA))
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", plan)
    if name not in PYTHON:
        assert not re.search(r"PythonUDF|ArrowEvalPython|MapInPandas|MapInArrow", plan)


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(catalogue.filtered_projection(spark, DATA))
    assert "PushedFilters: [IsNotNull(c_mktsegment), EqualTo(c_mktsegment,BUILDING)" in plan
    assert "ReadSchema: struct<o_custkey:bigint,o_orderstatus:string,o_totalprice:double,o_orderdate:timestamp" in plan
    plan = plan_of(catalogue.descriptives_by_major(spark, DATA))
    scan = re.search(r"ReadSchema: struct<l_orderkey[^>]*>", plan)[0]
    assert scan.count(":") == 5  # the key and three metrics


def test_copies_meet_before_the_shuffle(spark):
    plan = plan_of(catalogue.descriptives_by_major(spark, DATA))
    assert "partial_count" in plan
    plan = plan_of(catalogue.representative_per_major(spark, DATA))
    assert "partial_max_by" in plan


def test_first_rows_meet_before_the_shuffle(spark):
    assert plan_of(catalogue.first_per_authored_key(spark, DATA)).count("WindowGroupLimit") >= 2


@pytest.mark.parametrize("name", ["descriptives_by_major", "mannwhitney_cliffs"])
def test_no_task_sorts_a_whole_group(spark, name):
    """Windows in order of value are cut to slices."""
    specs = re.findall(r"windowspecdefinition\(([^)]*)\)", plan_of(catalogue.QUERIES[name](spark, DATA)))
    assert specs and all("_slice" in s for s in specs if re.search(r"\bvalue#", s))
