"""Plan assertions on registered queries and edge cases of the semantic contract."""

import datetime as dt

import pytest

import __spark_entry__ as entry_mod
from strata.operators.analytics import table_sanity
from strata.operators.records import liveness
from strata.plans.medallion import bronze_to_silver, fresh_lake

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF")


def _plan(spark, data_dir, key):
    df = entry_mod.queries()[key](spark, data_dir)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", ["dq_report", "corpus_scan", "token_overlap", "majority_vote", "score_rounds",
                                 "chunk_documents", "sql_asof", "stream_sessions", "anomaly_zscore"])
def test_no_python_in_plans(spark, data_dir, key):
    plan = _plan(spark, data_dir, key)
    assert not any(n in plan for n in PYTHON_NODES)


@pytest.mark.parametrize("key", ["topk_per_group", "vector_topk", "sql_rank_window", "dq_failing_sample"])
def test_top_k_is_limited_before_the_shuffle(spark, data_dir, key):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert "WindowGroupLimit" in _plan(spark, data_dir, key)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_cross_rules_read_the_table_once(spark, data_dir):
    assert _plan(spark, data_dir, "dq_cross_rules").count("FileScan") == 1


def test_filters_reach_the_scan(spark, data_dir):
    plan = _plan(spark, data_dir, "ledger_filter")
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in plan


def test_empty_bronze_keeps_schema_in_silver(spark):
    lake = fresh_lake(spark, "t")
    lake.write(spark.createDataFrame([], "id int, name string"), "bronze", "empty")
    rows, _ = bronze_to_silver(lake, "empty")
    silver = lake.table("silver", "empty")
    assert rows == 0 and silver.columns == ["id", "name", "_ingested_at", "_source"]


def test_sanity_on_empty_table_has_no_findings(spark):
    assert table_sanity(spark.createDataFrame([], "a int, b string")).count() == 0


def test_ttl_boundary_is_alive(spark):
    hb = spark.createDataFrame([("a", dt.datetime(2024, 1, 1, 0, 0, 0), "idle")], "agent string, ts timestamp_ntz, state string")
    r = liveness(hb, "agent", "ts", "2024-01-01 00:00:30", 30, "state", "busy", "idle").first()
    assert r.alive and r.idle


def test_vector_search_has_no_join(spark, data_dir):
    """Exact search scores Arrow batches against a broadcast query matrix: no
    join node, and the only Python node is the batched scorer."""
    plan = _plan(spark, data_dir, "vector_topk_batch")
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
    assert "MapInPandas" in plan and "BatchEvalPython" not in plan


def test_hot_item_votes_are_combined_before_the_shuffle(spark):
    """A third of all votes on one item: the result is exact and the plan
    aggregates partially on the map side, so the hot item never travels as a list."""
    from pyspark.sql import functions as F

    from strata.operators.voting import majority_vote

    n = 30000
    votes = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("i"), (F.col("id") % 997).cast("string"))).alias("item"),
        F.when(F.col("id") % 5 == 0, F.lit("B")).otherwise(F.lit("A")).alias("vote"),
        F.lit(0.9).alias("conf"),
    )
    res = majority_vote(votes, "item", "vote", "conf")
    hot = res.where(F.col("item") == "hot").first()
    assert hot.voters == n // 3 and hot.majority_value == "A" and hot.agreement_ratio == 0.8
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = res._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    first_exchange = plan.rfind("Exchange")
    assert "partial_count" in plan[first_exchange:]  # combine happens below the first shuffle
