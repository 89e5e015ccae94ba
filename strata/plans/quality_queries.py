"""Data-quality queries over the given tables.

The input tables hold no NULLs, so NULLs are injected with ``nullif`` on
values (all rows kept) identically in the query and in the oracle.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators.quality import (
    Check,
    check_table,
    cross_checks,
    failing_sample,
    null_counts,
    silver_checks,
    summarize,
    unique_strict,
)
from strata.plans.medallion import dedup_with_audit
from strata.plans.registry import load, query
from strata.plans.tables import union_sql

# ---------------------------------------------------------------- events with NULLs


def events_with_nulls(spark: SparkSession, data_dir: str) -> DataFrame:
    ev = load(spark, data_dir, "events")
    return ev.select(
        "event_id",
        "ts",
        F.expr("nullif(user_id, 0)").alias("user_id"),
        F.expr("nullif(event_type, 'signup')").alias("event_type"),
        "value",
        "props",
    )


EVENTS_WITH_NULLS_SQL = (
    "SELECT event_id, ts, nullif(user_id, 0) AS user_id, nullif(event_type, 'signup') AS event_type, "
    "value, props FROM events"
)

AS_OF = _dt.date(2024, 1, 15)

# (column, rule, params, severity, DuckDB failure condition or None for group/unknown rules)
DQ_REPORT_CHECKS = [
    ("event_id", "not_null", {}, "error", "NOT (event_id IS NOT NULL)"),
    ("user_id", "not_null", {}, "warning", "NOT (user_id IS NOT NULL)"),
    ("value", "positive", {}, "error", "NOT (value > 0)"),
    ("value", "non_negative", {}, "error", "NOT (value >= 0)"),
    ("value", "in_range", {"min": 1, "max": 40}, "warning", "NOT (value >= 1 AND value <= 40)"),
    ("value", "in_range", {"min": 5}, "info", "NOT (value >= 5)"),
    ("event_type", "in_set", {"values": ["view", "click", "purchase"]}, "error",
     "NOT (event_type IN ('view', 'click', 'purchase'))"),
    ("event_type", "in_set", {"values": []}, "info", "event_type IS NOT NULL"),
    ("props", "matches_regex", {"pattern": '"k": [0-9]{2}'}, "warning",
     "NOT regexp_matches(props, '\"k\": [0-9]{2}')"),
    ("ts", "no_future_dates", {"as_of": AS_OF}, "error", "NOT (CAST(ts AS DATE) <= DATE '2024-01-15')"),
    ("event_id", "unique", {}, "error", None),
    ("user_id", "unique", {}, "warning", None),
    ("value", "no_such_rule", {}, "error", None),
]


def _dq_oracle_row(table: str, col: str, rule: str, sev: str, cond: str | None) -> str:
    if rule == "unique":
        failed = f"(SELECT count(*) FROM (SELECT {col} FROM {table} GROUP BY {col} HAVING count(*) > 1))"
        return (
            f"SELECT '{col}' AS column_name, '{rule}' AS rule, '{sev}' AS severity, {failed} = 0 AS passed, "
            f"{failed} AS failed_rows, CAST(NULL AS VARCHAR) AS error"
        )
    if cond is None:
        return (
            f"SELECT '{col}' AS column_name, '{rule}' AS rule, '{sev}' AS severity, false AS passed, "
            f"CAST(0 AS BIGINT) AS failed_rows, 'Unknown rule: {rule}' AS error"
        )
    return (
        f"SELECT '{col}' AS column_name, '{rule}' AS rule, '{sev}' AS severity, "
        f"count(*) FILTER (WHERE {cond}) = 0 AS passed, "
        f"count(*) FILTER (WHERE {cond}) AS failed_rows, CAST(NULL AS VARCHAR) AS error FROM {table}"
    )


def _dq_report_oracle() -> str:
    rows = [_dq_oracle_row("ev", c, r, s, cond) for c, r, _p, s, cond in DQ_REPORT_CHECKS]
    # The first SELECT names the columns; later ones are positional.
    return f"WITH ev AS ({EVENTS_WITH_NULLS_SQL})\n" + union_sql(rows)


def _dq_report_df(spark: SparkSession, data_dir: str) -> DataFrame:
    ev = events_with_nulls(spark, data_dir)
    return check_table(ev, [Check(c, r, p, s) for c, r, p, s, _ in DQ_REPORT_CHECKS])


@query("dq_report", oracle=_dq_report_oracle())
def q_dq_report(spark: SparkSession, data_dir: str) -> DataFrame:
    """Every rule kind over events (NULLs injected); row rules fused in one scan."""
    return _dq_report_df(spark, data_dir)


@query(
    "dq_summary",
    oracle=f"WITH r AS ({_dq_report_oracle()}) SELECT count(*) AS checks, count(*) FILTER (WHERE r.passed) AS passed, "
    "count(*) FILTER (WHERE NOT r.passed) AS failed FROM r",
)
def q_dq_summary(spark: SparkSession, data_dir: str) -> DataFrame:
    return summarize(_dq_report_df(spark, data_dir))


_UNIQUE_COLS = ("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice")


@query(
    "dq_unique_groups",
    oracle=union_sql(
        [_dq_oracle_row("lineitem", c, "unique", "error", None) for c in _UNIQUE_COLS]
    ),
)
def q_dq_unique_groups(spark: SparkSession, data_dir: str) -> DataFrame:
    """Number of duplicated value groups per column (NULL is a group)."""
    li = load(spark, data_dir, "lineitem")
    return check_table(li, [Check(c, "unique") for c in _UNIQUE_COLS])


# ---------------------------------------------------------------- date strings


def order_date_strings(spark: SparkSession, data_dir: str) -> DataFrame:
    o = load(spark, data_dir, "orders")
    d = F.col("o_orderdate")
    text = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("x")))
        .when(F.col("o_orderpriority") == "2-HIGH", F.date_format(d, "yyyy/MM/dd"))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.date_format(d, "yyyy-M-d"))
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit(None).cast("string"))
        .when(F.dayofmonth(d) >= 29, F.concat(F.date_format(d, "yyyy"), F.lit("-02-"), F.date_format(d, "dd")))
        .otherwise(F.date_format(d, "yyyy-MM-dd"))
    )
    return o.select("o_orderkey", "o_orderdate", text.alias("order_date_text"))


ORDER_DATE_STRINGS_SQL = (
    "SELECT o_orderkey, o_orderdate, CASE "
    "WHEN o_orderpriority = '1-URGENT' THEN strftime(o_orderdate, '%Y-%m-%d') || 'x' "
    "WHEN o_orderpriority = '2-HIGH' THEN strftime(o_orderdate, '%Y/%m/%d') "
    "WHEN o_orderpriority = '3-MEDIUM' THEN strftime(o_orderdate, '%Y-%-m-%-d') "
    "WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL "
    "WHEN day(o_orderdate) >= 29 THEN strftime(o_orderdate, '%Y') || '-02-' || strftime(o_orderdate, '%d') "
    "ELSE strftime(o_orderdate, '%Y-%m-%d') END AS order_date_text FROM orders"
)


@query(
    "dq_valid_date",
    oracle=f"WITH d AS ({ORDER_DATE_STRINGS_SQL}) "
    "SELECT 'order_date_text' AS column_name, 'valid_date' AS rule, 'error' AS severity, "
    "count(*) FILTER (WHERE NOT (try_strptime(order_date_text, '%Y-%m-%d') IS NOT NULL OR order_date_text IS NULL)) = 0 AS passed, "
    "count(*) FILTER (WHERE NOT (try_strptime(order_date_text, '%Y-%m-%d') IS NOT NULL OR order_date_text IS NULL)) AS failed_rows, "
    "CAST(NULL AS VARCHAR) AS error FROM d "
    "UNION ALL SELECT 'o_orderdate', 'valid_date', 'error', true, 0, NULL",
)
def q_dq_valid_date(spark: SparkSession, data_dir: str) -> DataFrame:
    """Date strings with corruptions (junk suffix, slashes, 29-31 Feb); typed dates pass."""
    d = order_date_strings(spark, data_dir)
    return check_table(d, [Check("order_date_text", "valid_date"), Check("o_orderdate", "valid_date")])


# ---------------------------------------------------------------- silver checks

SILVER_CONFIG = [
    {"column": "o_orderkey", "rule": "not_null"},
    {"column": "o_orderkey", "rule": "unique"},
    {"column": "o_custkey", "rule": "unique"},
    {"column": "o_totalprice", "rule": "positive"},
    {"column": "o_custkey", "rule": "non_negative"},
    {"column": "o_orderdate", "rule": "valid_date"},
    {"column": "o_orderstatus", "rule": "not_a_rule"},
]


@query(
    "silver_quality",
    oracle=(
        "WITH s AS (SELECT DISTINCT * FROM orders) "
        "SELECT 'o_orderkey.not_null' AS check_key, count(*) FILTER (WHERE o_orderkey IS NULL) = 0 AS passed, "
        "count(*) FILTER (WHERE o_orderkey IS NULL) AS failed_rows FROM s "
        "UNION ALL SELECT 'o_orderkey.unique', n = 0, n FROM (SELECT count(*) AS n FROM (SELECT o_orderkey FROM s GROUP BY 1 HAVING count(*) > 1)) "
        "UNION ALL SELECT 'o_custkey.unique', n = 0, n FROM (SELECT count(*) AS n FROM (SELECT o_custkey FROM s GROUP BY 1 HAVING count(*) > 1)) "
        "UNION ALL SELECT 'o_totalprice.positive', count(*) FILTER (WHERE o_totalprice <= 0) = 0, count(*) FILTER (WHERE o_totalprice <= 0) FROM s "
        "UNION ALL SELECT 'o_custkey.non_negative', count(*) FILTER (WHERE o_custkey < 0) = 0, count(*) FILTER (WHERE o_custkey < 0) FROM s "
        "UNION ALL SELECT 'o_orderdate.valid_date', true, 0"
    ),
)
def q_silver_quality(spark: SparkSession, data_dir: str) -> DataFrame:
    """Silver rule set (keyed ``column.rule``) on the de-duplicated orders."""
    silver = dedup_with_audit(load(spark, data_dir, "orders"), "orders")
    return silver_checks(silver, SILVER_CONFIG)


# ---------------------------------------------------------------- failing samples

SAMPLE_CHECKS = [
    (Check("c_acctbal", "positive"), "NOT (c_acctbal > 0)"),
    (Check("c_acctbal", "in_range", {"min": -500, "max": 9000}), "NOT (c_acctbal >= -500 AND c_acctbal <= 9000)"),
    (Check("c_mktsegment", "in_set", {"values": ["BUILDING", "MACHINERY"]}),
     "NOT (c_mktsegment IN ('BUILDING', 'MACHINERY'))"),
    (Check("c_name", "matches_regex", {"pattern": "#0000000[0-9]$"}), "NOT regexp_matches(c_name, '#0000000[0-9]$')"),
]


def _sample_oracle() -> str:
    parts = [
        f"SELECT c_custkey, '{c.column}' AS column_name, '{c.rule}' AS rule, CAST({c.column} AS VARCHAR) AS value "
        f"FROM customer WHERE {cond}"
        for c, cond in SAMPLE_CHECKS
    ]
    return (
        f"WITH f AS ({union_sql(parts)}) SELECT * FROM ("
        "SELECT *, row_number() OVER (PARTITION BY column_name, rule ORDER BY c_custkey) AS sample_rank FROM f"
        ") WHERE sample_rank <= 5"
    )


@query("dq_failing_sample", oracle=_sample_oracle())
def q_dq_failing_sample(spark: SparkSession, data_dir: str) -> DataFrame:
    """First 5 failing customers (by key) per rule, from one scan."""
    cust = load(spark, data_dir, "customer")
    return failing_sample(cust, [c for c, _ in SAMPLE_CHECKS], ["c_custkey"], limit=5)


def _group_sample_oracle(column: str) -> str:
    return (
        f"SELECT l_orderkey, l_linenumber, '{column}' AS column_name, 'unique' AS rule, CAST({column} AS VARCHAR) AS value, "
        f"row_number() OVER (PARTITION BY {column} ORDER BY l_orderkey, l_linenumber) AS sample_rank FROM lineitem "
        f"WHERE {column} IN (SELECT {column} FROM lineitem GROUP BY {column} HAVING count(*) > 1 "
        f"ORDER BY count(*) DESC, CAST({column} AS VARCHAR) LIMIT 5) "
        f"QUALIFY row_number() OVER (PARTITION BY {column} ORDER BY l_orderkey, l_linenumber) <= 5"
    )


@query(
    "dq_failing_groups",
    oracle=union_sql(
        [
            _group_sample_oracle("l_partkey"),
            _group_sample_oracle("l_suppkey"),
            "SELECT * FROM (SELECT l_orderkey, l_linenumber, 'l_quantity' AS column_name, 'in_range' AS rule, CAST(l_quantity AS VARCHAR) AS value, "
            "row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS sample_rank FROM lineitem WHERE NOT l_quantity <= 49) WHERE sample_rank <= 5",
        ]
    ),
)
def q_dq_failing_groups(spark: SparkSession, data_dir: str) -> DataFrame:
    """Rows of the most frequent repeated values of two columns, beside a row rule's sample."""
    checks = [Check("l_partkey", "unique"), Check("l_suppkey", "unique"), Check("l_quantity", "in_range", {"max": 49})]
    return failing_sample(load(spark, data_dir, "lineitem"), checks, ["l_orderkey", "l_linenumber"], limit=5)


# ---------------------------------------------------------------- cross rules / sweeps

_CROSS_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_CROSS_RULES = {"not_null": "NOT ({c} IS NOT NULL)", "positive": "NOT ({c} > 0)", "non_negative": "NOT ({c} >= 0)"}


@query(
    "dq_cross_rules",
    oracle=union_sql(
        [
            f"SELECT '{c}' AS column_name, '{r}' AS rule, 'error' AS severity, "
            f"count(*) FILTER (WHERE {cond.format(c=c)}) = 0 AS passed, "
            f"count(*) FILTER (WHERE {cond.format(c=c)}) AS failed_rows, CAST(NULL AS VARCHAR) AS error FROM lineitem"
            for c in _CROSS_COLS
            for r, cond in _CROSS_RULES.items()
        ]
    ),
)
def q_dq_cross_rules(spark: SparkSession, data_dir: str) -> DataFrame:
    """Columns x rules over lineitem, all fused in one aggregate."""
    li = load(spark, data_dir, "lineitem")
    return check_table(li, cross_checks(_CROSS_COLS, list(_CROSS_RULES)))


def customer_with_nulls(spark: SparkSession, data_dir: str) -> DataFrame:
    c = load(spark, data_dir, "customer")
    return c.select(
        "c_custkey",
        "c_name",
        F.expr("nullif(c_nationkey, 0)").alias("c_nationkey"),
        "c_acctbal",
        F.expr("nullif(c_mktsegment, 'AUTOMOBILE')").alias("c_mktsegment"),
    )


CUSTOMER_WITH_NULLS_SQL = (
    "SELECT c_custkey, c_name, nullif(c_nationkey, 0) AS c_nationkey, c_acctbal, "
    "nullif(c_mktsegment, 'AUTOMOBILE') AS c_mktsegment FROM customer"
)
_CUST_COLS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@query(
    "quality_sweep",
    oracle=f"WITH c AS ({CUSTOMER_WITH_NULLS_SQL}) "
    + union_sql(
        [
            f"SELECT '{col}' AS column_name, count(*) FILTER (WHERE {col} IS NULL) AS null_count, "
            f"count(*) FILTER (WHERE {col} IS NULL) = 0 AS passed FROM c"
            for col in _CUST_COLS
        ]
    ),
)
def q_quality_sweep(spark: SparkSession, data_dir: str) -> DataFrame:
    """not_null over every column of a table in one aggregate."""
    return null_counts(customer_with_nulls(spark, data_dir))


_VALIDATE_COLS = ["event_id", "user_id", "event_type", "value"]


@query(
    "dq_validate",
    oracle=f"WITH ev AS ({EVENTS_WITH_NULLS_SQL}) "
    + union_sql(
        [
            f"SELECT '{col} NOT NULL' AS check_name, count(*) FILTER (WHERE {col} IS NULL) = 0 AS passed, "
            f"count(*) FILTER (WHERE {col} IS NULL) AS null_count FROM ev"
            for col in _VALIDATE_COLS
        ]
    ),
)
def q_dq_validate(spark: SparkSession, data_dir: str) -> DataFrame:
    """Null-count validation task (check name, passed, null count)."""
    res = null_counts(events_with_nulls(spark, data_dir), _VALIDATE_COLS)
    return res.select(F.concat(F.col("column_name"), F.lit(" NOT NULL")).alias("check_name"), "passed", "null_count")


@query(
    "dq_unique_strict",
    oracle=union_sql(
        [
            f"SELECT 'lineitem' AS table_name, '{c}' AS column_name, count(*) AS total, count(DISTINCT {c}) AS unique_values, "
            f"count(*) = count(DISTINCT {c}) AS passed FROM lineitem"
            for c in ("l_orderkey", "l_partkey")
        ]
        + [
            "SELECT 'orders', 'o_orderkey', count(*), count(DISTINCT o_orderkey), count(*) = count(DISTINCT o_orderkey) FROM orders",
            "SELECT 'events_nulls', 'user_id', count(*), count(DISTINCT user_id), count(*) = count(DISTINCT user_id) "
            f"FROM ({EVENTS_WITH_NULLS_SQL})",
        ]
    ),
)
def q_dq_unique_strict(spark: SparkSession, data_dir: str) -> DataFrame:
    """count(*) = count(DISTINCT col); a NULL makes the check fail."""
    li = unique_strict(load(spark, data_dir, "lineitem"), ["l_orderkey", "l_partkey"])
    o = unique_strict(load(spark, data_dir, "orders"), ["o_orderkey"])
    e = unique_strict(events_with_nulls(spark, data_dir), ["user_id"])
    return (
        li.select(F.lit("lineitem").alias("table_name"), "*")
        .unionByName(o.select(F.lit("orders").alias("table_name"), "*"))
        .unionByName(e.select(F.lit("events_nulls").alias("table_name"), "*"))
    )
