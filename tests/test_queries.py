"""Every registered query against its SQL, and the shape of its plan."""

import re

import pytest

import __spark_entry__ as entry
from preflens.plans import ORACLE as SQL
from preflens.plans import QUERIES
from tests import oracle

SF = "/root/testdata/sf0.001"

# A query that SQL cannot repeat: an iterative fit.
ROWS_ONLY = {"rm_linear_fit"}


@pytest.fixture(scope="module")
def connection():
    return oracle.connect(SF)


def test_every_query_is_registered_and_has_its_sql():
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
    assert set(QUERIES) - set(SQL) == ROWS_ONLY and set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, connection, name):
    assert not oracle.compare(spark, SF, QUERIES[name], SQL[name], connection)


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_flagship_runs(spark):
    assert entry.entry(spark).count() == 27


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"rm_linear_fit"}))
def test_plans_hold_no_cross_joins(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_flagship_hashes_and_reads_two_columns(spark):
    plan = QUERIES["win_rate_summary"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
    assert set(re.findall(r"ReadSchema: struct<([^>]*)>", plan)) == {"doc_id:bigint", "doc_id:bigint,text:string"}


def test_paired_scores_do_not_carry_texts_through_the_shuffle(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES["score_verdict"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    lines = plan.split("\n")
    shuffled = [lines[i + 1] for i, line in enumerate(lines) if "Exchange hashpartitioning" in line]
    assert len(shuffled) == 2 and all("AS rm_score" in line for line in shuffled)
    assert not any("AS completion" in line for line in shuffled)
