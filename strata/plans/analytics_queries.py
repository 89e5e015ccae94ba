"""Aggregate, anomaly, profile, sanity, schema, vote and top-k queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators.analytics import aggregate, profile, schema_check, table_sanity, zscore_anomalies
from strata.operators.distinct import column_counts, column_sketches, merge_sketches
from strata.operators.voting import majority_vote, top_k_per_group
from strata.plans.quality_queries import EVENTS_WITH_NULLS_SQL, events_with_nulls
from strata.plans.registry import load, query
from strata.plans.tables import TABLE_COLUMNS, union_sql
from strata.session import scratch_path

_MEASURES = [
    "count(*) AS n_lines",
    "sum(l_quantity) AS sum_qty",
    "CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS sum_price",
    "round(avg(l_discount), 6) AS avg_disc",
    "max(l_tax) AS max_tax",
    "count(DISTINCT l_orderkey) AS n_orders",
]


@query(
    "aggregate_generic",
    oracle=f"SELECT l_returnflag, l_linestatus, {', '.join(_MEASURES)} FROM lineitem GROUP BY l_returnflag, l_linestatus",
)
def q_aggregate_generic(spark: SparkSession, data_dir: str) -> DataFrame:
    return aggregate(load(spark, data_dir, "lineitem"), _MEASURES, ["l_returnflag", "l_linestatus"])


@query(
    "anomaly_zscore",
    oracle=(
        "WITH stats AS (SELECT avg(value) AS mean, stddev(value) AS std FROM events) "
        "SELECT event_id, user_id, event_type, value, round(mean, 6) AS mean, round(std, 6) AS std, "
        "round((value - mean) / nullif(std, 0), 6) AS zscore FROM events, stats "
        "WHERE abs((value - mean) / nullif(std, 0)) > 3.0"
    ),
)
def q_anomaly_zscore(spark: SparkSession, data_dir: str) -> DataFrame:
    ev = load(spark, data_dir, "events").select("event_id", "user_id", "event_type", "value")
    out = zscore_anomalies(ev, "value", 3.0)
    return out.select(
        "event_id", "user_id", "event_type", "value",
        F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), F.round("zscore", 6).alias("zscore"),
    )


# Spark type names of the profiled columns (events with NULLs injected).
_PROFILE_TYPES = {
    "event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint",
    "event_type": "string", "value": "double", "props": "string",
}


@query(
    "profile_table",
    oracle=f"WITH ev AS ({EVENTS_WITH_NULLS_SQL}) "
    + union_sql(
        [
            f"SELECT '{c}' AS column_name, '{t}' AS data_type, count(*) FILTER (WHERE {c} IS NULL) AS nulls, "
            f"count(DISTINCT {c}) AS distinct_values, "
            f"round(count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*), 1) AS null_pct, count(*) AS total_rows FROM ev"
            for c, t in _PROFILE_TYPES.items()
        ]
    ),
)
def q_profile_table(spark: SparkSession, data_dir: str) -> DataFrame:
    """Type, nulls, distinct values and null percent of every column in one aggregate."""
    return profile(events_with_nulls(spark, data_dir))


@query(
    "profile_sketches",
    oracle=union_sql([f"SELECT '{c}' AS column_name, count(*) AS rows, count(*) - count({c}) AS nulls, true AS close FROM orders" for c in TABLE_COLUMNS["orders"]]),
)
def q_profile_sketches(spark: SparkSession, data_dir: str) -> DataFrame:
    """Distinct values of orders from stored sketches, one for each order status, merged; close: within 3 % of the exact counts."""
    orders = load(spark, data_dir, "orders")
    path = scratch_path(spark, "sketches")
    column_sketches(orders, orders.columns, F.col("o_orderstatus")).write.partitionBy("part").parquet(path)
    merged = merge_sketches(spark.read.parquet(path))
    exact = column_counts(orders, orders.columns).select("column_name", F.col("distinct").alias("exact"))
    close = F.abs(F.col("distinct") - F.col("exact")) <= F.greatest(F.lit(1.0), 0.03 * F.col("exact"))
    return merged.join(exact, "column_name").select("column_name", "rows", "nulls", close.alias("close"))


def _orders_sanity_frame(spark: SparkSession, data_dir: str) -> DataFrame:
    o = load(spark, data_dir, "orders")
    return o.select(
        "*",
        F.expr("nullif(o_orderstatus, o_orderstatus)").alias("o_comment"),
        F.substring("o_orderpriority", 2, 1).alias("o_dash"),
    )


_SANITY_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority",
                "o_comment", "o_dash"]


def _sanity_oracle() -> str:
    base = ("SELECT *, nullif(o_orderstatus, o_orderstatus) AS o_comment, substr(o_orderpriority, 2, 1) AS o_dash "
            "FROM orders")
    parts = []
    for c in _SANITY_COLS:
        parts.append(
            f"SELECT '{c}' AS column_name, 'warning' AS severity, 'All values are NULL' AS message FROM t "
            f"HAVING count(*) FILTER (WHERE {c} IS NULL) = count(*) AND count(*) > 0"
        )
        parts.append(
            f"SELECT '{c}', 'info', 'Only one distinct value - check if meaningful' FROM t "
            f"HAVING count(DISTINCT {c}) = 1 AND count(*) > 1"
        )
    return f"WITH t AS ({base}) " + union_sql(parts)


@query("table_check", oracle=_sanity_oracle())
def q_table_check(spark: SparkSession, data_dir: str) -> DataFrame:
    """All-NULL and single-valued column findings (orders plus two derived columns)."""
    return table_sanity(_orders_sanity_frame(spark, data_dir))


EXPECTED_ORDERS_SCHEMA = {
    "o_orderkey": "int",
    "o_custkey": "BIGINT",
    "o_orderstatus": "VARCHAR",
    "o_totalprice": "DECIMAL",
    "o_orderdate": "timestamp",
    "o_clerk": "VARCHAR",
}


_DUCK_TO_SPARK = "CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' " \
    "WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'DATE' THEN 'date' ELSE lower(data_type) END"


def _schema_oracle() -> str:
    from strata.operators.analytics import TYPE_ALIASES

    exp = ", ".join(
        f"('{c}', '{t}', '{TYPE_ALIASES.get(t.lower(), t.lower())}')" for c, t in EXPECTED_ORDERS_SCHEMA.items()
    )
    return (
        f"WITH a AS (SELECT column_name, {_DUCK_TO_SPARK} AS actual_type FROM information_schema.columns "
        "WHERE table_name = 'orders'), "
        f"e AS (SELECT * FROM (VALUES {exp}) AS e(column_name, expected_type, expected_norm)), "
        "j AS (SELECT coalesce(e.column_name, a.column_name) AS column_name, expected_type, expected_norm, actual_type "
        "FROM e FULL OUTER JOIN a ON e.column_name = a.column_name) "
        "SELECT column_name, CASE WHEN actual_type IS NULL THEN 'error' WHEN expected_type IS NULL THEN 'warning' "
        "ELSE 'error' END AS severity, "
        "CASE WHEN actual_type IS NULL THEN 'Missing column: ' || column_name "
        "WHEN expected_type IS NULL THEN 'Unexpected column: ' || column_name "
        "ELSE 'Type mismatch: ' || column_name || ': expected ' || expected_type || ', got ' || actual_type END AS message "
        "FROM j WHERE actual_type IS NULL OR expected_type IS NULL OR NOT contains(lower(actual_type), expected_norm)"
    )


@query("schema_check", oracle=_schema_oracle())
def q_schema_check(spark: SparkSession, data_dir: str) -> DataFrame:
    """Missing / unexpected / mismatched columns of orders against an expected schema."""
    return schema_check(load(spark, data_dir, "orders"), EXPECTED_ORDERS_SCHEMA)


# ---------------------------------------------------------------- votes / top-k

_VOTES_SQL = (
    "SELECT l_orderkey, nullif(l_returnflag, 'N') AS vote, l_extendedprice / (l_extendedprice + 1000) AS conf FROM lineitem"
)


@query(
    "majority_vote",
    oracle=(
        f"WITH v AS ({_VOTES_SQL}), "
        "pv AS (SELECT l_orderkey, vote, count(*) AS n, sum(conf) AS conf_sum FROM v GROUP BY l_orderkey, vote), "
        "best AS (SELECT l_orderkey, vote AS best_vote, n AS best_n FROM ("
        "  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, vote) AS rn FROM pv WHERE vote IS NOT NULL"
        ") WHERE rn = 1), "
        "tot AS (SELECT l_orderkey, sum(n) AS voters, sum(CASE WHEN vote IS NOT NULL THEN conf_sum END) AS cs, "
        "  sum(CASE WHEN vote IS NOT NULL THEN n END) AS cn FROM pv GROUP BY l_orderkey), "
        "j AS (SELECT tot.*, best_vote, coalesce(best_n, 0) / voters AS ratio, "
        "  coalesce(cs, 0.0) / greatest(1, coalesce(cn, 0)) AS avg_conf FROM tot LEFT JOIN best USING (l_orderkey)) "
        "SELECT l_orderkey, voters, CASE WHEN ratio >= 0.6 AND voters >= 2 THEN best_vote END AS majority_value, "
        "round(ratio, 3) AS agreement_ratio, (ratio >= 0.6 AND voters >= 2) AS quorum_met, "
        "round(avg_conf, 4) AS confidence, (NOT (ratio >= 0.6 AND voters >= 2) OR avg_conf < 0.95) AS requires_approval "
        "FROM j"
    ),
)
def q_majority_vote(spark: SparkSession, data_dir: str) -> DataFrame:
    """Each lineitem line votes its return flag for its order ('N' = failed voter)."""
    li = load(spark, data_dir, "lineitem")
    votes = li.select(
        "l_orderkey",
        F.expr("nullif(l_returnflag, 'N')").alias("vote"),
        (F.col("l_extendedprice") / (F.col("l_extendedprice") + 1000)).alias("conf"),
    )
    return majority_vote(votes, "l_orderkey", "vote", "conf")


_TOPK_ORDER_SQL = "l_discount DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity"


@query(
    "topk_per_group",
    oracle=(
        "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount, rank, max_discount FROM ("
        f"SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_TOPK_ORDER_SQL}) AS rank, "
        "max(l_discount) OVER (PARTITION BY l_orderkey) AS max_discount FROM lineitem) WHERE rank <= 3"
    ),
)
def q_topk_per_group(spark: SparkSession, data_dir: str) -> DataFrame:
    """Top 3 lines per order by discount (all lines if 3 or fewer) and the order's max."""
    li = load(spark, data_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_extendedprice", "l_quantity"
    )
    order = [F.col("l_discount").desc(), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
    top = top_k_per_group(li, ["l_orderkey"], [F.col(o) if isinstance(o, str) else o for o in order], 3)
    # The rank-1 row holds the group maximum; the max over the kept rows is it,
    # computed without another shuffle (data is already partitioned by order).
    from pyspark.sql import Window

    return top.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "rank",
        F.max("l_discount").over(Window.partitionBy("l_orderkey")).alias("max_discount"),
    )
