"""Layer pipeline behaviour of the reference tests (CSV ingest, listing, silver dedup)."""

import os
import tempfile

import pytest

from strata.plans.medallion import bronze_to_silver, build_analytics_views, fresh_lake, medallion_flow
from strata.sources import files as src


def _csv(text: str, name: str) -> str:
    d = tempfile.mkdtemp(prefix="strata-csv-")
    p = os.path.join(d, name)
    with open(p, "w") as f:
        f.write(text)
    return p


def test_csv_ingest_counts_rows(spark):
    lake = fresh_lake(spark, "t")
    assert src.ingest_csv(lake, "people", _csv("id,name\n1,alice\n2,bob\n", "people.csv")) == 2


def test_ingested_table_is_listed(spark):
    lake = fresh_lake(spark, "t")
    src.ingest_csv(lake, "mytable", _csv("x\n1\n2\n", "mytable.csv"))
    assert "mytable" in lake.tables("bronze")


def test_silver_dedup_and_quality(spark):
    lake = fresh_lake(spark, "t")
    src.ingest_csv(lake, "people", _csv("id,name\n1,alice\n2,bob\n1,alice\n", "people.csv"))
    rows, quality = bronze_to_silver(lake, "people", "people", [{"column": "id", "rule": "not_null"}])
    assert rows == 2
    assert quality is not None and quality.count() == 1
    cols = lake.table("silver", "people").columns
    assert "_ingested_at" in cols and "_source" in cols


def test_strict_ingest_refuses_existing_table(spark):
    lake = fresh_lake(spark, "t")
    path = _csv("id\n1\n", "t.csv")
    src.ingest_strict(lake, "once", path)
    with pytest.raises(Exception):
        src.ingest_strict(lake, "once", path)


def test_json_array_and_lines(spark):
    lake = fresh_lake(spark, "t")
    arr = _csv('[{"a": 1}, {"a": 2}, {"a": 3}]', "arr.json")
    lines = _csv('{"a": 1}\n{"a": 2}\n', "lines.json")
    assert src.ingest_json(lake, "arr", arr) == 3
    assert src.ingest_json(lake, "lines", lines) == 2


def test_identifier_guard(spark):
    lake = fresh_lake(spark, "t")
    with pytest.raises(ValueError):
        lake.table("bronze", "bad-name; drop")
    with pytest.raises(ValueError):
        lake.table("platinum", "x")


def test_gold_placeholder_when_no_silver(spark):
    lake = fresh_lake(spark, "t")
    views = build_analytics_views(lake)
    assert views[0][0] == "placeholder" and views[0][1].count() == 1


def test_medallion_flow_on_smoke_data(spark, data_dir):
    rep = {r.table_name: r for r in medallion_flow(spark, data_dir).collect()}
    assert rep["orders"].bronze_rows == rep["orders"].silver_rows > 0
    assert rep["lineitem"].checks_failed == 0


def test_demo_chain_generate_ingest_status_quality(spark, data_dir):
    """generate -> land as CSV -> three layers -> status -> quality sweep."""
    from pyspark.sql import functions as F

    from strata.operators.quality import null_counts
    from strata.session import scratch_path
    from strata.sources.datagen import generate_orders, generate_transactions

    orders = spark.read.parquet(f"{data_dir}/orders.parquet")
    customers = spark.read.parquet(f"{data_dir}/customer.parquet").select(F.col("c_custkey").alias("id"))
    products = spark.read.parquet(f"{data_dir}/part.parquet").select(
        F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"))
    gen = generate_orders(orders, "o_orderkey", customers, products)
    landing = scratch_path(spark, "demo")
    gen.write.option("header", True).csv(f"{landing}/gen_orders.csv")
    generate_transactions(gen).write.option("header", True).csv(f"{landing}/gen_transactions.csv")
    rep = {r.table_name: r for r in medallion_flow(spark, landing).collect()}
    assert rep["gen_orders"].silver_rows == orders.count()
    assert rep["gen_transactions"].checks_failed == 0
    assert all(r.passed for r in null_counts(gen).collect())


def test_partitioned_layers_prune_folders(spark, data_dir):
    from pyspark.sql import functions as F

    lake = fresh_lake(spark, "t")
    rep = medallion_flow(spark, data_dir, lake=lake, partition_by={"orders": ["o_orderstatus"]}).collect()
    assert {r.table_name for r in rep} >= {"orders"}
    silver = lake.table("silver", "orders").where(F.col("o_orderstatus") == "F")
    plan = silver._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(o_orderstatus" in plan
    assert silver.count() == spark.read.parquet(f"{data_dir}/orders.parquet").where("o_orderstatus = 'F'").count()
