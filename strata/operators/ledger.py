"""Decision-ledger operators: status filters and pivots, and consecutive ids.

Consecutive numbering of a large batch is done without a single-partition
window: the batch is range-partitioned on the ordering key and checkpointed
(so partition contents are fixed), each row gets its position inside its
partition from ``monotonically_increasing_id`` (no shuffle), and a prefix sum
over the per-partition counts (one row per partition) gives each partition's
offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.session import shared_root


def by_status(df: DataFrame, column: str, value: str) -> DataFrame:
    return df.where(F.col(column) == value)


def status_summary(df: DataFrame, column: str, statuses: list[str]) -> DataFrame:
    """Total and count per status value, one aggregate."""
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col(column) == s).alias(f"status_{s}") for s in statuses],
    )


def max_suffix(ids: DataFrame, column: str, prefix: str) -> DataFrame:
    """One-row frame: highest numeric suffix among ids with ``prefix`` (0 if none)."""
    suffix = F.expr(f"try_cast(substring({column}, {len(prefix) + 1}) AS BIGINT)")
    return ids.where(F.col(column).startswith(prefix)).agg(F.coalesce(F.max(suffix), F.lit(0)).alias("max_suffix"))


def sequence_numbers(df: DataFrame, order: list[Column], start: Column | int = 1, partitions: int | None = None) -> DataFrame:
    """Adds ``seq`` = start, start+1, ... following ``order`` (which must be total)."""
    spark = df.sparkSession
    shared_root(spark)  # checkpoints go to the cluster's shared folder
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ranged = ranged.withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True)
    local = ranged.withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))  # one row per partition
    start_col = start if isinstance(start, Column) else F.lit(start)
    return (
        local.join(F.broadcast(offsets), "_pid")
        .withColumn("seq", start_col + F.col("_off") + F.col("_pos"))
        .drop("_pid", "_pos", "_off")
    )


def assign_ids(batch: DataFrame, existing_ids: DataFrame, id_column: str, order: list[Column],
               prefix: str = "ADR-", width: int = 3) -> DataFrame:
    """Next sequential ids (``ADR-004`` ...) after the highest existing suffix."""
    top = max_suffix(existing_ids, id_column, prefix).scalar()  # one value, computed once
    with_start = batch.withColumn("max_suffix", top)
    numbered = sequence_numbers(with_start, order, start=F.col("max_suffix") + 1)
    return numbered.withColumn("new_id", F.format_string(f"{prefix}%0{width}d", F.col("seq"))).drop("max_suffix")
