"""Analytics operators: generic aggregate, z-score anomalies, column profile,
table sanity, schema check.

All of them are single aggregates (partial on executors, tiny final merge);
the z-score reads its statistics through a
scalar subquery (one global aggregate, computed once, no join).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators.distinct import column_counts, column_sketches, merge_sketches


def aggregate(df: DataFrame, measures: list[str] | None = None, group_by: list[str] | None = None) -> DataFrame:
    """Measures (SQL expressions, aliased with AS) with optional grouping.

    Grouping keys are always part of the output. The default measure is
    ``count(*) AS count``.
    """
    exprs = [F.expr(m) for m in (measures or ["count(*) AS count"])]
    if group_by:
        return df.groupBy(*[F.col(g) for g in group_by]).agg(*exprs)
    return df.agg(*exprs)


def zscore_anomalies(df: DataFrame, column: str, threshold: float = 3.0) -> DataFrame:
    """Rows whose |z| exceeds ``threshold`` (strict), with mean, std and zscore.

    mean and sample stddev come from one global aggregate; a zero stddev makes
    every z-score NULL, so a constant column has no anomalies.
    """
    # One global aggregate evaluated once as a scalar subquery: no join at all.
    stats = df.select(F.struct(F.avg(column).alias("mean"), F.stddev(column).alias("std"))).scalar()
    with_stats = df.withColumn("_stats", stats).withColumns(
        {"mean": F.col("_stats.mean"), "std": F.col("_stats.std")}
    ).drop("_stats")
    z = (F.col(column) - F.col("mean")) / F.expr("nullif(std, 0)")
    return with_stats.withColumn("zscore", z).where(F.abs(F.col("zscore")) > F.lit(float(threshold)))


def profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """Per column: type, nulls, distinct values, null percent (1 decimal).

    Exact distinct counts come from one scan and one shuffle of (column, value)
    pairs, added up inside the tasks first; ``approx=True`` takes one sketch for
    each column instead and shuffles no values.
    """
    cols = df.columns
    counts = merge_sketches(column_sketches(df, cols)) if approx else column_counts(df, cols)
    types = df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema.fields], "column_name string, data_type string")
    counts = types.join(counts, "column_name", "left").na.fill(0, ["rows", "nulls", "distinct"])
    pct = F.when(F.col("rows") > 0, F.round(F.col("nulls") * 100.0 / F.col("rows"), 1)).otherwise(F.lit(0.0))
    return counts.select("column_name", "data_type", "nulls", F.col("distinct").cast("long").alias("distinct_values"), pct.alias("null_pct"), F.col("rows").alias("total_rows"))


def table_sanity(df: DataFrame) -> DataFrame:
    """Findings: all-NULL column -> warning; one distinct value over >1 rows -> info.

    An empty table yields no findings (nothing is all-NULL in zero rows).
    """
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(cols):
        # one distinct value: the smallest is the largest, so no distinct count is needed
        one_value = (F.min(F.col(c)) == F.max(F.col(c))).alias(f"_same{i}")
        aggs += [F.count(F.col(c)).alias(f"_some{i}"), one_value]
    one = df.agg(*aggs)

    def finding(name: str, severity: str, message: str):
        return F.struct(F.lit(name).alias("column_name"), F.lit(severity).alias("severity"), F.lit(message).alias("message"))

    findings = []
    for i, c in enumerate(cols):
        findings += [
            F.when((F.col(f"_some{i}") == 0) & (F.col("_rows") > 0), finding(c, "warning", "All values are NULL")),
            F.when(F.col(f"_same{i}") & (F.col("_rows") > 1), finding(c, "info", "Only one distinct value - check if meaningful")),
        ]
    return one.select(F.inline(F.filter(F.array(*findings), lambda x: x.isNotNull())))


# Short type names accepted in expected schemas, mapped to the
# Spark type strings they stand for.
TYPE_ALIASES = {
    "integer": "int",
    "int4": "int",
    "bigint": "bigint",
    "int8": "bigint",
    "long": "bigint",
    "varchar": "string",
    "text": "string",
    "double": "double",
    "float8": "double",
    "real": "float",
    "float4": "float",
    "boolean": "boolean",
    "bool": "boolean",
    "timestamp": "timestamp",
}


def schema_check(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Missing (error), unexpected (warning) and mismatched (error) columns.

    A type matches when the expected name (after alias mapping) is a
    case-insensitive substring of the actual Spark type, so ``int`` accepts
    ``bigint``. The comparison is a full outer join of two (name, type) lists.
    """
    spark = df.sparkSession
    actual = spark.createDataFrame(
        [(f.name, f.dataType.simpleString()) for f in df.schema.fields], "column_name string, actual_type string"
    )
    exp = spark.createDataFrame(
        [(k, v, TYPE_ALIASES.get(v.lower(), v.lower())) for k, v in expected.items()],
        "column_name string, expected_type string, expected_norm string",
    )
    j = exp.join(actual, "column_name", "full_outer")
    issue = (
        F.when(F.col("actual_type").isNull(), F.struct(F.lit("error").alias("severity"),
                                                       F.concat(F.lit("Missing column: "), F.col("column_name")).alias("message")))
        .when(F.col("expected_type").isNull(), F.struct(F.lit("warning").alias("severity"),
                                                        F.concat(F.lit("Unexpected column: "), F.col("column_name")).alias("message")))
        .when(~F.lower(F.col("actual_type")).contains(F.col("expected_norm")),
              F.struct(F.lit("error").alias("severity"),
                       F.concat(F.lit("Type mismatch: "), F.col("column_name"), F.lit(": expected "),
                                F.col("expected_type"), F.lit(", got "), F.col("actual_type")).alias("message")))
    )
    return j.select("column_name", issue.alias("i")).where(F.col("i").isNotNull()).select(
        "column_name", F.col("i.severity").alias("severity"), F.col("i.message").alias("message")
    )
