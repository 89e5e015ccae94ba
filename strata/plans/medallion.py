"""Bronze -> silver -> gold pipeline.

* bronze: every source file of a landing folder becomes a table (schema
  inferred once here and stored with Parquet, so later layers never re-infer);
* silver: full-row de-duplication (audit columns excluded, NULL equals NULL),
  audit columns with ONE pinned run timestamp, and the table's quality checks,
  measured by the write; failures of severity error stop the job;
* gold: one analytics view per silver table.

De-duplication is a hash aggregate with map-side combine, so a row copied a
billion times costs one row per map task in the shuffle. Row counts come from
the writes (``Observation``).
"""

from __future__ import annotations

import datetime as _dt
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.catalog import Lake, check_identifier
from strata.functions.time import ntz_literal
from strata.operators.distinct import column_counts
from strata.operators.quality import row_condition, silver_rules, summarize
from strata.session import scratch_path
from strata.sources.files import ingest_all

# Audit column names added by the silver step.
AUDIT_COLUMNS = ("_ingested_at", "_source")
GROUP_RULES = ("unique",)
# A pinned run timestamp keeps reruns reproducible; callers pass their own.
DEFAULT_RUN_TS = _dt.datetime(2024, 1, 1, 0, 0, 0)


def fresh_lake(spark: SparkSession, tag: str = "m") -> Lake:
    """A lake with its own folder and database prefix (one per pipeline run)."""
    return Lake(spark, root=scratch_path(spark, "lake"), prefix=f"{tag}{uuid.uuid4().hex[:8]}")


def dedup_with_audit(df: DataFrame, source: str, run_ts: _dt.datetime = DEFAULT_RUN_TS) -> DataFrame:
    """Full-row de-duplication (audit columns excluded) plus the audit columns: one shuffle at every size."""
    cols = [c for c in df.columns if c not in AUDIT_COLUMNS]
    deduped = df.select(*cols).dropDuplicates(cols)
    # A wall-clock (NTZ) run timestamp: the same value whatever the session time zone.
    return deduped.withColumns({"_ingested_at": ntz_literal(run_ts), "_source": F.lit(source)})


class QualityError(RuntimeError):
    """Rows fail a check of severity ``error``; the silver table was not replaced."""

    def __init__(self, table: str, failed: dict[str, int]):
        super().__init__(f"{table}: " + ", ".join(f"{k} fails for {n} rows" for k, n in sorted(failed.items())))
        self.table, self.failed = table, failed


def bronze_to_silver(
    lake: Lake,
    source: str,
    target: str | None = None,
    checks: list[dict] | None = None,
    run_ts: _dt.datetime = DEFAULT_RUN_TS,
    partition_by: list[str] | None = None,
) -> tuple[int, DataFrame | None]:
    """De-duplicate, stamp and check one bronze table; returns (rows, quality results).

    Row rules are measured by the write itself, so silver is scanned again only
    for group rules (``unique``). A check's ``severity`` says what its failures do:

    * ``warning`` (default), ``info``: they are counted;
    * ``error``: the job fails with ``QualityError`` and the silver table stays
      as it was;
    * ``quarantine`` (row rules): failing rows go to ``<target>_quarantine``
      with the names of the rules they fail, the others to silver.
    """
    target = check_identifier(target or source)
    bronze = dedup_with_audit(lake.table("bronze", source), source, run_ts)
    if not checks:
        return lake.write(bronze, "silver", target, partition_by=partition_by), None
    valid = silver_rules(bronze, checks)
    rows = [c for c in valid if c.rule not in GROUP_RULES]
    split = [c for c in rows if c.severity == "quarantine"]
    metrics = {f"c{i}": F.count_if(~row_condition(bronze, c)) for i, c in enumerate(rows)}
    strict = split or any(c.severity == "error" for c in valid)
    if split:
        names = F.array(*[F.when(~row_condition(bronze, c), F.lit(f"{c.column}.{c.rule}")) for c in split])
        bronze = bronze.withColumn("failed_rules", F.concat_ws(",", F.filter(names, lambda x: x.isNotNull())))
    draft = f"{target}__draft" if strict else target
    measured = lake.write_observed(bronze, "silver", draft, metrics, partition_by=None if split else partition_by)
    failed = {f"{c.column}.{c.rule}": measured[f"c{i}"] for i, c in enumerate(rows)}
    groups = [c for c in valid if c.rule in GROUP_RULES]
    if groups:
        written = lake.table("silver", draft)
        counts = {r["column_name"]: r for r in column_counts(written, list(dict.fromkeys(c.column for c in groups))).collect()}
        failed |= {f"{c.column}.{c.rule}": counts[c.column]["repeated"] for c in groups}
    fatal = {f"{c.column}.{c.rule}": failed[f"{c.column}.{c.rule}"] for c in valid if c.severity == "error" and failed[f"{c.column}.{c.rule}"]}
    if fatal:
        lake.drop("silver", draft)
        raise QualityError(target, fatal)
    n = measured["rows"]
    if split:
        both = lake.table("silver", draft)
        n = lake.write(both.where("failed_rules = ''").drop("failed_rules"), "silver", target, partition_by=partition_by)
        lake.write(both.where("failed_rules <> ''"), "silver", f"{target}_quarantine")
        lake.drop("silver", draft)
    elif strict:
        lake.rename("silver", draft, target)
    found = [F.struct(F.lit(k).alias("check_key"), F.lit(n == 0).alias("passed"), F.lit(n).cast("long").alias("failed_rows")) for k, n in failed.items()]
    if not found:
        return n, lake.spark.createDataFrame([], "check_key string, passed boolean, failed_rows bigint")
    return n, lake.spark.range(1).select(F.inline(F.array(*found)))


def create_aggregation(lake: Lake, sql: str, view_name: str) -> DataFrame:
    """Drop-and-create ``gold.view_name`` from SQL; returns the view."""
    lake.create_view("gold", view_name, sql)
    return lake.table("gold", view_name)


def build_analytics_views(lake: Lake) -> list[tuple[str, DataFrame]]:
    """One ``<table>_analytics`` view per silver table (a placeholder if none)."""
    silver = lake.tables("silver")
    if not silver:
        return [("placeholder", create_aggregation(lake, "SELECT 1 AS placeholder", "placeholder"))]
    out = []
    for t in silver:
        view = f"{t}_analytics"
        out.append((view, create_aggregation(lake, f"SELECT * FROM {lake.name('silver', t)}", view)))
    return out


def default_checks(df: DataFrame) -> list[dict]:
    """Per-table default: every non-audit column must be non-NULL."""
    return [{"column": c, "rule": "not_null"} for c in df.columns if c not in AUDIT_COLUMNS]


def _table_report(
    lake: Lake, table: str, bronze_rows: int, checks: dict[str, list[dict]] | None, run_ts: _dt.datetime,
    partition_by: dict[str, list[str]] | None = None,
) -> DataFrame:
    spark = lake.spark
    table_checks = (checks or {}).get(table) or default_checks(lake.table("bronze", table))
    silver_rows, quality = bronze_to_silver(lake, table, table, table_checks, run_ts, (partition_by or {}).get(table))
    gold = create_aggregation(lake, f"SELECT * FROM {lake.name('silver', table)}", f"{table}_analytics")
    gold_rows = gold.count()
    head = [
        F.lit(table).alias("table_name"),
        F.lit(bronze_rows).cast("long").alias("bronze_rows"),
        F.lit(silver_rows).cast("long").alias("silver_rows"),
        F.lit(f"{table}_analytics").alias("gold_view"),
        F.lit(gold_rows).cast("long").alias("gold_rows"),
    ]
    if quality is None:
        return spark.range(1).select(*head, F.lit(0).cast("long").alias("checks"),
                                     F.lit(0).cast("long").alias("checks_failed"))
    # The one-row check summary carries the table's counts as literals.
    return summarize(quality).select(*head, F.col("checks"), F.col("failed").alias("checks_failed"))


def medallion_flow(
    spark: SparkSession,
    source_dir: str,
    lake: Lake | None = None,
    checks: dict[str, list[dict]] | None = None,
    run_ts: _dt.datetime = DEFAULT_RUN_TS,
    max_parallel: int = 8,
    partition_by: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Run the three layers over a landing folder; one report row per table.

    Columns: table_name, bronze_rows, silver_rows, gold_view, gold_rows,
    checks, checks_failed. Tables are independent, so their silver and gold
    steps are submitted concurrently from a small driver thread pool.
    ``partition_by`` maps a table to the columns its bronze and silver copies
    are partitioned by (e.g. an ingest-date column for large fact tables).
    """
    lake = lake or fresh_lake(spark)
    lake.prepare()
    bronze_counts = ingest_all(lake, source_dir, max_parallel, partition_by)
    tables = sorted(bronze_counts.items())
    with ThreadPoolExecutor(max_workers=max(1, min(max_parallel, len(tables)))) as pool:
        reports = list(pool.map(lambda tb: _table_report(lake, tb[0], tb[1], checks, run_ts, partition_by), tables))
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r)
    return out


def layer_trace(lake: Lake, table: str) -> DataFrame:
    """Rows and column count of one table in each layer where it exists."""
    spark = lake.spark
    parts = []
    for layer, name in (("bronze", table), ("silver", table), ("gold", f"{table}_analytics")):
        if lake.exists(layer, name):
            df = lake.table(layer, name)
            parts.append(
                df.agg(F.count(F.lit(1)).alias("rows")).select(
                    F.lit(layer).alias("layer"), F.col("rows"), F.lit(len(df.columns)).alias("n_columns")
                )
            )
    if not parts:
        return spark.createDataFrame([], "layer string, rows bigint, n_columns int")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


__all__ = [
    "AUDIT_COLUMNS",
    "QualityError",
    "bronze_to_silver",
    "build_analytics_views",
    "create_aggregation",
    "dedup_with_audit",
    "fresh_lake",
    "layer_trace",
    "medallion_flow",
]
