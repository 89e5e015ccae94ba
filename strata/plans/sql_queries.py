"""SQL passthrough queries: one representative statement per relational
category, run by Spark SQL over temp views of the data folder. Where the two
dialects agree the oracle is the very same text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators.joins import asof_latest
from strata.plans.registry import load, query, register_views
from strata.plans.sqlrun import run_query

_DEC = "CAST(sum(CAST({c} AS DECIMAL(18,2))) AS DECIMAL(38,2))"

# key -> (Spark SQL, DuckDB SQL or None when identical)
STATEMENTS: dict[str, tuple[str, str | None]] = {
    "run_query": (
        "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, "
        + _DEC.format(c="l_extendedprice") + " AS sum_base_price, "
        "CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2)))) AS DECIMAL(38,4)) "
        "AS sum_disc_price, round(avg(l_quantity), 6) AS avg_qty, count(*) AS count_order "
        "FROM lineitem WHERE l_shipdate <= CAST('1998-09-02' AS TIMESTAMP) GROUP BY l_returnflag, l_linestatus",
        None,
    ),
    "sql_star_join": (
        "SELECT n_name, count(*) AS n_orders, " + _DEC.format(c="o_totalprice") + " AS revenue "
        "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
        None,
    ),
    "sql_left_join": (
        "SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey "
        "GROUP BY c_custkey",
        None,
    ),
    "sql_semi_anti": (
        "SELECT 'with_orders' AS kind, count(*) AS n FROM customer WHERE EXISTS "
        "(SELECT 1 FROM orders WHERE o_custkey = c_custkey) "
        "UNION ALL SELECT 'without_orders' AS kind, count(*) AS n FROM customer WHERE NOT EXISTS "
        "(SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
        None,
    ),
    "sql_range_join": (
        "SELECT o_orderpriority, count(*) AS n_lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey "
        "AND l_shipdate >= o_orderdate AND l_shipdate < o_orderdate + INTERVAL 90 DAY GROUP BY o_orderpriority",
        None,
    ),
    "sql_rollup": (
        "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty FROM lineitem "
        "GROUP BY ROLLUP (l_returnflag, l_linestatus)",
        None,
    ),
    "sql_cube": (
        "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
        None,
    ),
    "sql_grouping_sets": (
        "SELECT c_mktsegment, c_nationkey, CAST(grouping(c_mktsegment) AS INT) AS g_segment, "
        "CAST(grouping(c_nationkey) AS INT) AS g_nation, count(*) AS n FROM customer "
        "GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())",
        None,
    ),
    "sql_distinct_agg": (
        "SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, count(*) AS n FROM orders "
        "GROUP BY o_orderpriority",
        None,
    ),
    "sql_rank_window": (
        "SELECT c_nationkey, c_custkey, c_acctbal, CAST(rnk AS BIGINT) AS rnk, CAST(drnk AS BIGINT) AS drnk FROM ("
        "SELECT c_nationkey, c_custkey, c_acctbal, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS rnk, "
        "dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS drnk FROM customer) WHERE rnk <= 3",
        None,
    ),
    "sql_lag_lead": (
        "SELECT event_id, lag(value) OVER w AS prev_value, lead(value) OVER w AS next_value FROM events "
        "WINDOW w AS (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id)",
        None,
    ),
    "sql_rows_frame": (
        "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id "
        "ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS moving_avg FROM events",
        None,
    ),
    "sql_union": (
        "SELECT s_nationkey AS nationkey, 'supplier' AS kind FROM supplier UNION "
        "SELECT c_nationkey AS nationkey, 'customer' AS kind FROM customer",
        None,
    ),
    "sql_intersect": ("SELECT c_nationkey AS nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier", None),
    "sql_except": (
        "SELECT o_custkey, o_orderstatus FROM orders EXCEPT SELECT o_custkey, o_orderstatus FROM orders "
        "WHERE o_orderstatus = 'F'",
        None,
    ),
    "sql_subquery": (
        "SELECT c_custkey, c_nationkey FROM customer c WHERE c_acctbal > "
        "(SELECT avg(c2.c_acctbal) FROM customer c2 WHERE c2.c_nationkey = c.c_nationkey)",
        None,
    ),
    "sql_json_extract": (
        "SELECT event_type, CAST(sum(CAST(get_json_object(props, '$.k') AS INT)) AS BIGINT) AS k_sum, "
        "count(*) AS n FROM events GROUP BY event_type",
        "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS BIGINT) AS k_sum, "
        "count(*) AS n FROM events GROUP BY event_type",
    ),
    "sql_date_trunc": (
        "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start, count(*) AS n_orders, "
        + _DEC.format(c="o_totalprice") + " AS revenue FROM orders GROUP BY CAST(date_trunc('month', o_orderdate) AS DATE)",
        None,
    ),
}


def _register(key: str, spark_sql: str, duck_sql: str | None) -> None:
    @query(key, oracle=duck_sql or spark_sql)
    def _q(spark: SparkSession, data_dir: str, _sql: str = spark_sql) -> DataFrame:
        register_views(spark, data_dir, _sql)
        return run_query(spark, _sql)

    _q.__name__ = f"q_{key}"
    _q.__doc__ = f"SQL passthrough: {key}"


for _k, (_s, _d) in STATEMENTS.items():
    _register(_k, _s, _d)


@query(
    "sql_asof",
    oracle=(
        "SELECT p.event_id AS purchase_id, p.user_id, c.event_id AS click_id FROM "
        "(SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN "
        "(SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts"
    ),
)
def q_sql_asof(spark: SparkSession, data_dir: str) -> DataFrame:
    """For each purchase, the user's latest click at or before it (bucketed as-of join)."""
    ev = load(spark, data_dir, "events")
    purchases = ev.where(F.col("event_type") == "purchase").select("user_id", "ts", F.col("event_id").alias("purchase_id"))
    clicks = ev.where(F.col("event_type") == "click").select("user_id", "ts", F.col("event_id").alias("click_id"))
    out = asof_latest(purchases, clicks, "user_id", "ts", "purchase_id", "click_id", bucket="day", out_col="click_id")
    return out.select("purchase_id", "user_id", "click_id")


_PROPS_SQL = "CASE WHEN event_type = 'error' THEN substr(props, 1, length(props) - 1) WHEN event_type = 'signup' THEN '{\"j\": 1}' ELSE props END"


@query(
    "json_parse_fallback",
    oracle=(
        f"WITH p AS (SELECT event_id, {_PROPS_SQL} AS payload FROM events) "
        "SELECT event_id, CASE WHEN NOT json_valid(payload) THEN -1 "
        "ELSE TRY_CAST(json_extract_string(payload, '$.k') AS INTEGER) END AS k FROM p"
    ),
)
def q_json_parse_fallback(spark: SparkSession, data_dir: str) -> DataFrame:
    """Task payloads parsed as JSON: malformed ones (error events lose their closing
    brace) fall back to -1, well-formed ones without the field give NULL.
    (Spark's parser accepts trailing characters after a complete value, so a
    stray extra brace would not count as malformed.)"""
    from strata.functions.json import json_field

    ev = load(spark, data_dir, "events")
    payload = (
        F.when(F.col("event_type") == "error", F.expr("substring(props, 1, length(props) - 1)"))
        .when(F.col("event_type") == "signup", F.lit('{"j": 1}'))
        .otherwise(F.col("props"))
    )
    return ev.select("event_id", json_field(payload, "$.k", "int", -1).alias("k"))
