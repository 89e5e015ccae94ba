"""Counts of the values of many columns at once, exact or as mergeable sketches.

Exact: every row becomes (column, value) pairs, which are added up inside each
task before the shuffle, so a value costs one row for each task however often it
occurs; a second aggregate folds them by column. All columns, and every rule
that needs value counts, share that one scan and one shuffle.

Sketched: one HyperLogLog sketch for each column and part of the table, in one
aggregate without any shuffle of values. Sketches are stored as bytes and
merged later, so adding a part does not read the others again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FLOATS = (T.FloatType, T.DoubleType)
_NESTED = (T.ArrayType, T.StructType, T.MapType, T.VariantType)


def as_text(df: DataFrame, column: str) -> Column:
    """A column's values as strings, equal exactly where the values are; nested types as JSON."""
    kind = df.schema[column].dataType
    c = F.col(f"`{column}`")
    if isinstance(kind, _FLOATS):
        return F.when(c == 0, "0.0").otherwise(c.cast("string"))  # 0.0 and -0.0 are one value
    if isinstance(kind, T.BinaryType):
        return F.hex(c)
    if isinstance(kind, _NESTED):
        return F.to_json(F.struct(c), {"ignoreNullFields": "false"})
    return c.cast("string")


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_no, value as text, n): how often every value of every column occurs; null is a value."""
    pairs = F.array(*[F.struct(F.lit(i).alias("column_no"), F.when(F.col(f"`{c}`").isNotNull(), as_text(df, c)).alias("value")) for i, c in enumerate(columns)])
    return df.select(F.inline(pairs)).groupBy("column_no", "value").agg(F.count(F.lit(1)).alias("n"))


def column_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each column: rows, nulls, distinct (without null) and repeated (values, null too, that occur more than once)."""
    names = df.sparkSession.createDataFrame(list(enumerate(columns)), "column_no int, column_name string")
    folded = value_counts(df, columns).groupBy("column_no").agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
        F.count("value").alias("distinct"),
        F.count_if(F.col("n") > 1).alias("repeated"),
    )
    out = names.join(folded, "column_no", "left")  # an empty table has no value
    return out.select("column_name", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("rows", "nulls", "distinct", "repeated")])


def column_sketches(df: DataFrame, columns: list[str], part: Column | None = None) -> DataFrame:
    """(part, column_name, rows, nulls, sketch): one row for each column and part, to be stored and merged."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        aggs += [F.hll_sketch_agg(as_text(df, c), F.lit(14)).alias(f"s{i}"), F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}")]
    one = df.groupBy((F.lit("") if part is None else part.cast("string")).alias("part")).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("rows"), F.col(f"n{i}").alias("nulls"), F.col(f"s{i}").alias("sketch")) for i, c in enumerate(columns)])
    return one.select("part", F.inline(rows))


def merge_sketches(sketches: DataFrame) -> DataFrame:
    """column_name, rows, nulls and the estimate of distinct values over all parts (standard error 0.6 %)."""
    out = sketches.groupBy("column_name").agg(F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.hll_union_agg("sketch").alias("sketch"))
    return out.select("column_name", "rows", "nulls", F.hll_sketch_estimate("sketch").alias("distinct"))
