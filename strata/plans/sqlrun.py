"""SQL passthrough: run a statement (optionally parameterised) as a DataFrame,
or materialise it. Spark SQL is the dialect; no translation layer is built.

Differences met when moving statements from DuckDB (see README): write
``INTERVAL 90 DAY`` the same way in both; replace ``QUALIFY`` with a filtered
subquery, ``* EXCLUDE`` with ``* EXCEPT``, ``ASOF JOIN`` with
``strata.operators.joins.asof_latest``, ``list_*`` with array functions and
``json_extract_string`` with ``get_json_object``.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from strata.catalog import Lake, check_identifier


def run_query(spark: SparkSession, sql: str, args: dict[str, Any] | None = None) -> DataFrame:
    """Run a statement; named parameters (``:name``) are bound, never spliced."""
    return spark.sql(sql, args=args) if args else spark.sql(sql)


def transform(lake: Lake, sql: str, output_table: str, layer: str = "gold") -> int:
    """CTAS (create or replace); returns the row count observed on the write."""
    return lake.write(lake.spark.sql(sql), layer, check_identifier(output_table))


def read_jdbc(
    spark: SparkSession,
    url: str,
    table_or_query: str,
    partition_column: str | None = None,
    lower_bound: int | None = None,
    upper_bound: int | None = None,
    num_partitions: int = 64,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """Relational source over JDBC, read in parallel ranges of a numeric column.

    Without a partition column the read is a single task, so pass one for any
    large table. A query (not a table name) is wrapped as a derived table.
    Connection errors surface as exceptions; nothing falls back silently.
    """
    src = table_or_query
    if table_or_query.lstrip().lower().startswith("select"):
        src = f"({table_or_query}) AS q"
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", src)
    for k, v in (properties or {}).items():
        reader = reader.option(k, v)
    if partition_column:
        if lower_bound is None or upper_bound is None:
            raise ValueError("partitioned JDBC reads need lower_bound and upper_bound")
        reader = (
            reader.option("partitionColumn", partition_column)
            .option("lowerBound", str(lower_bound))
            .option("upperBound", str(upper_bound))
            .option("numPartitions", str(num_partitions))
        )
    return reader.load()
