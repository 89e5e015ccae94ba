"""Data-quality engine.

All row rules over one table are evaluated in ONE scan: each rule becomes a
``count_if(NOT cond)`` inside a single global aggregate (partial aggregation on
every executor, one tiny final merge). Group rules (``unique``) need their own
aggregate over the column. Results are small DataFrames, one row per check,
never collected by the library.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.rules import get_rule
from strata.operators.distinct import as_text, column_counts, value_counts

RESULT_SCHEMA = "column_name string, rule string, severity string, passed boolean, failed_rows bigint, error string"


@dataclass
class Check:
    column: str
    rule: str
    params: dict[str, Any] = field(default_factory=dict)
    severity: str = "error"


def _dtype(df: DataFrame, column: str) -> T.DataType | None:
    for f in df.schema.fields:
        if f.name == column:
            return f.dataType
    return None


def row_condition(df: DataFrame, check: Check) -> Column:
    spec = get_rule(check.rule)
    if spec is None or spec.kind != "row":
        raise ValueError(f"Not a row rule: {check.rule}")
    return spec.build(F.col(check.column), check.params, _dtype(df, check.column))


def _result_row(column: str, rule: str, severity: str, failed: Column, error: str | None) -> Column:
    err = F.lit(error).cast("string")
    return F.struct(
        F.lit(column).alias("column_name"),
        F.lit(rule).alias("rule"),
        F.lit(severity).alias("severity"),
        ((failed == 0) & err.isNull()).alias("passed"),
        failed.cast("long").alias("failed_rows"),
        err.alias("error"),
    )


def duplicate_groups(df: DataFrame, column: str) -> DataFrame:
    """Number of values (NULL counts as a value) that occur more than once."""
    return column_counts(df, [column]).select(F.col("repeated").alias("failed_rows"))


def check_table(df: DataFrame, checks: list[Check]) -> DataFrame:
    """Evaluate ``checks`` on ``df``; one result row per check.

    Columns: column_name, rule, severity, passed, failed_rows, error.
    Unknown rules produce a failed row carrying an error message.
    """
    spark = df.sparkSession
    row_checks: list[tuple[int, Check]] = []
    group_checks: list[Check] = []
    parts: list[DataFrame] = []
    literal_rows: list[Column] = []
    for i, chk in enumerate(checks):
        spec = get_rule(chk.rule)
        if spec is None:
            literal_rows.append(
                _result_row(chk.column, chk.rule, chk.severity, F.lit(0), f"Unknown rule: {chk.rule}")
            )
        elif chk.column not in df.columns:
            literal_rows.append(
                _result_row(chk.column, chk.rule, chk.severity, F.lit(0), f"Unknown column: {chk.column}")
            )
        elif spec.kind == "row":
            row_checks.append((i, chk))
        else:
            group_checks.append(chk)
    if group_checks:
        # one scan and one shuffle for all of them
        counts = column_counts(df, list(dict.fromkeys(c.column for c in group_checks)))
        failed = {"unique": F.col("repeated"), "unique_strict": F.col("rows") - F.col("distinct")}
        found = F.array(*[F.when(F.col("column_name") == c.column, _result_row(c.column, c.rule, c.severity, failed[c.rule], None)) for c in group_checks])
        parts.append(counts.select(F.inline(F.filter(found, lambda x: x.isNotNull()))))
    if row_checks:
        aggs = [F.count_if(~row_condition(df, chk)).alias(f"_c{i}") for i, chk in row_checks]
        fused = df.agg(*aggs)
        parts.insert(
            0,
            fused.select(
                F.inline(
                    F.array(
                        *[_result_row(chk.column, chk.rule, chk.severity, F.col(f"_c{i}"), None) for i, chk in row_checks]
                    )
                )
            ),
        )
    if literal_rows:
        parts.append(spark.range(1).select(F.inline(F.array(*literal_rows))))
    if not parts:
        return spark.createDataFrame([], RESULT_SCHEMA)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def check_all(df: DataFrame, schema: dict[str, list[Check]]) -> DataFrame:
    """Column-keyed rule map over one table (all columns fused in one scan)."""
    flat = [c for checks in schema.values() for c in checks]
    return check_table(df, flat)


def cross_checks(columns: list[str], rules: list[str], severity: str = "error") -> list[Check]:
    """Every column paired with every rule."""
    return [Check(c, r, {}, severity) for c in columns for r in rules]


def summarize(results: DataFrame) -> DataFrame:
    """Passed / failed totals of a check result."""
    return results.agg(
        F.count(F.lit(1)).alias("checks"),
        F.count_if(F.col("passed")).alias("passed"),
        F.count_if(~F.col("passed")).alias("failed"),
    )


def failing_sample(df: DataFrame, checks: list[Check], order_by: list[str], limit: int = 5) -> DataFrame:
    """Failing rows of every check: order_by, column_name, rule, value, sample_rank.

    Row rules: up to ``limit`` rows for each, first by ``order_by``, from one
    scan: each row carries the list of rules it fails, the list is exploded, and
    a per-check ``row_number <= limit`` is planned as a WindowGroupLimit, so only
    ``limit`` rows per check and task are shuffled.

    ``unique``: up to ``limit`` of its most frequent repeated values (ties by
    value), and up to ``limit`` rows of each, ranked within the value. The
    values are found for all columns together; their rows are picked by a second
    scan against that short list.
    """
    known = [c for c in checks if get_rule(c.rule) is not None]
    rows = [c for c in known if get_rule(c.rule).kind == "row"]
    unique = list(dict.fromkeys(c.column for c in known if c.rule == "unique"))
    keys = [F.col(k) for k in order_by]
    parts = []
    if rows:
        fails = F.array(
            *[
                F.when(~row_condition(df, c), F.struct(F.lit(c.column).alias("column_name"), F.lit(c.rule).alias("rule"),
                                                     F.col(c.column).cast("string").alias("value"), F.lit(i).alias("_check")))
                for i, c in enumerate(rows)
            ]
        )
        exploded = df.select(*keys, F.filter(fails, lambda x: x.isNotNull()).alias("_f")).where(F.size("_f") > 0).select(*order_by, F.inline("_f"))
        w = Window.partitionBy("_check").orderBy(*keys)
        parts.append(exploded.withColumn("sample_rank", F.row_number().over(w)).where(F.col("sample_rank") <= limit).drop("_check"))
    if unique:
        by_count = Window.partitionBy("column_no").orderBy(F.col("n").desc(), F.col("value"))
        worst = value_counts(df, unique).where("n > 1").withColumn("_r", F.row_number().over(by_count)).where(F.col("_r") <= limit)
        worst = worst.select(F.col("column_no").alias("_c"), F.col("value").alias("_v"))  # limit rows for each column
        pairs = F.array(*[F.struct(F.lit(i).alias("column_no"), F.when(F.col(c).isNotNull(), as_text(df, c)).alias("value")) for i, c in enumerate(unique)])
        hit = df.select(*keys, F.inline(pairs)).join(F.broadcast(worst), (F.col("column_no") == F.col("_c")) & F.col("value").eqNullSafe(F.col("_v")))
        w = Window.partitionBy("column_no", "value").orderBy(*keys)
        hit = hit.withColumn("sample_rank", F.row_number().over(w)).where(F.col("sample_rank") <= limit)
        name = F.element_at(F.array(*[F.lit(c) for c in unique]), F.col("column_no") + 1)
        parts.append(hit.select(*order_by, name.alias("column_name"), F.lit("unique").alias("rule"), "value", "sample_rank"))
    if not parts:
        schema = T.StructType([*[df.schema[k] for k in order_by], *T.StructType.fromDDL("column_name string, rule string, value string, sample_rank int").fields])
        return df.sparkSession.createDataFrame([], schema)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def unique_strict(df: DataFrame, columns: list[str]) -> DataFrame:
    """Strict uniqueness: count(*) == count(DISTINCT col); any NULL fails."""
    out = column_counts(df, columns)
    return out.select("column_name", F.col("rows").alias("total"), F.col("distinct").alias("unique_values"), (F.col("rows") == F.col("distinct")).alias("passed"))


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Null count per column in one aggregate; columns: column_name, null_count, passed."""
    cols = columns or df.columns
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"_n{i}") for i, c in enumerate(cols)])
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(f"_n{i}").alias("null_count"),
            (F.col(f"_n{i}") == 0).alias("passed"),
        )
        for i, c in enumerate(cols)
    ]
    return one.select(F.inline(F.array(*rows)))


# The rule set of the silver step.
SILVER_RULES = ("not_null", "unique", "positive", "non_negative", "valid_date")


def silver_rules(df: DataFrame, checks: list[dict]) -> list[Check]:
    """The checks (column, rule, params, severity) that the silver step knows; unknown rules or columns are skipped."""
    return [
        Check(c["column"], c["rule"], c.get("params", {}), c.get("severity", "warning"))
        for c in checks
        if c.get("column") and c.get("rule") in SILVER_RULES and c["column"] in df.columns
    ]


def silver_checks(df: DataFrame, checks: list[dict]) -> DataFrame:
    """Silver-step checks keyed ``column.rule``; unknown rules or columns are skipped."""
    res = check_table(df, silver_rules(df, checks))
    return res.select(
        F.concat_ws(".", "column_name", "rule").alias("check_key"),
        "passed",
        "failed_rows",
    )
