"""Quality rules on the 5-row table and the clean table of the reference tests."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from strata.operators.quality import (
    Check,
    check_table,
    failing_sample,
    null_counts,
    silver_checks,
    summarize,
    unique_strict,
)

SCHEMA = "id int, name string, age int, salary double, date_col date"
ROWS = [
    (1, "alice", 30, 100.0, dt.date(2024, 1, 1)),
    (2, "bob", 25, 200.0, dt.date(2024, 1, 2)),
    (None, "charlie", -5, 300.0, dt.date(2099, 1, 1)),
    (4, None, 35, -50.0, dt.date(2023, 12, 31)),
    (5, "dave", 30, 150.0, dt.date(2024, 1, 1)),
]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def _result(df, column, rule):
    rows = [r for r in df.collect() if r.column_name == column and r.rule == rule]
    assert len(rows) == 1
    return rows[0]


def test_each_rule_on_the_test_table(table):
    checks = [
        Check("id", "not_null"),
        Check("age", "unique"),
        Check("salary", "positive"),
        Check("age", "non_negative"),
        Check("age", "in_range", {"min": 18, "max": 65}),
        Check("name", "in_set", {"values": ["alice", "bob", "dave"]}),
        Check("date_col", "no_future_dates", {"as_of": dt.date(2024, 6, 1)}),
        Check("id", "unique"),
        Check("id", "nonexistent"),
    ]
    res = check_table(table, checks)
    assert _result(res, "id", "not_null").failed_rows == 1
    assert not _result(res, "id", "not_null").passed
    assert _result(res, "age", "unique").failed_rows == 1  # age 30 appears twice
    assert _result(res, "salary", "positive").failed_rows == 1
    assert _result(res, "age", "non_negative").failed_rows == 1
    assert _result(res, "age", "in_range").failed_rows == 1
    in_set = _result(res, "name", "in_set")
    assert in_set.failed_rows == 1 and not in_set.passed  # charlie; NULL is not counted
    assert _result(res, "date_col", "no_future_dates").failed_rows == 1
    uid = _result(res, "id", "unique")
    assert uid.failed_rows == 0 and uid.passed  # a single NULL is no duplicate
    unknown = _result(res, "id", "nonexistent")
    assert not unknown.passed and "Unknown rule" in unknown.error


def test_clean_table_passes(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 30.0)], "id int, val double")
    res = check_table(df, [Check("id", "not_null"), Check("id", "unique"), Check("val", "positive")])
    assert all(r.passed for r in res.collect())
    s = summarize(res).first()
    assert (s.checks, s.passed, s.failed) == (3, 3, 0)


def test_row_rules_fuse_into_one_scan_without_python(table):
    res = check_table(table, [Check("age", "positive"), Check("salary", "non_negative"), Check("id", "not_null")])
    plan = res._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_in_range_with_one_bound_is_unbounded(spark):
    df = spark.createDataFrame([(1,), (100,), (-3,)], "x int")
    res = check_table(df, [Check("x", "in_range", {"min": 0}), Check("x", "in_range", {"max": 50})])
    got = sorted((r.failed_rows for r in res.collect()))
    assert got == [1, 1]


def test_in_set_empty_fails_non_null_only(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "x string")
    r = check_table(df, [Check("x", "in_set", {"values": []})]).first()
    assert r.failed_rows == 2


def test_valid_date_strings_and_typed_dates(spark):
    df = spark.createDataFrame(
        [("2024-01-05", dt.date(2024, 1, 5)), ("2024-1-5", None), ("2024-02-30", None), ("05/01/2024", None),
         ("2024-01-05x", None), (None, None)],
        "s string, d date",
    )
    res = check_table(df, [Check("s", "valid_date"), Check("d", "valid_date")])
    by = {r.column_name: r.failed_rows for r in res.collect()}
    assert by == {"s": 3, "d": 0}


def test_failing_sample_is_ordered_and_capped(spark):
    df = spark.range(20).select(F.col("id"), (F.col("id") - 15).alias("v"))
    s = failing_sample(df, [Check("v", "positive")], ["id"], limit=5).collect()
    assert [r.id for r in s] == [0, 1, 2, 3, 4]


def test_unique_strict_null_fails(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    r = unique_strict(df, ["x"]).first()
    assert (r.total, r.unique_values, r.passed) == (3, 2, False)


def test_null_counts(table):
    got = {r.column_name: r.null_count for r in null_counts(table).collect()}
    assert got == {"id": 1, "name": 1, "age": 0, "salary": 0, "date_col": 0}


def test_silver_checks_keyed_and_unknown_skipped(table):
    res = silver_checks(table, [{"column": "id", "rule": "not_null"}, {"column": "age", "rule": "unique"},
                                {"column": "age", "rule": "bogus"}, {"column": "nope", "rule": "not_null"}])
    got = {r.check_key: r.failed_rows for r in res.collect()}
    assert got == {"id.not_null": 1, "age.unique": 1}


def test_user_rule_registration(spark):
    from strata.functions.rules import rule

    @rule("even")
    def _even(c, params, dt=None):
        return c % 2 == 0

    df = spark.createDataFrame([(1,), (2,), (4,), (None,)], "x int")
    r = check_table(df, [Check("x", "even")]).first()
    assert (r.failed_rows, r.passed) == (1, False)
