"""As-of join that does not put a whole key's history into one task.

For every left row, find the latest right row with the same key and
``right.ts <= left.ts``. A plain window over the key would sort a hot key's
entire history in one task. Instead the time axis is cut into buckets:

1. inside a (key, bucket) the latest earlier right row is found by a window
   over that bucket only (a hot key is spread over all its buckets);
2. for left rows with no match in their own bucket, the answer is the last
   right row of the nearest earlier bucket: one row per (key, bucket) from a
   partial aggregate (max_by), carried forward by a window over that small
   per-bucket table, and joined on (key, bucket).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_latest(
    left: DataFrame,
    right: DataFrame,
    key: str,
    ts: str,
    left_id: str,
    right_value: str,
    bucket: str = "day",
    out_col: str = "match",
) -> DataFrame:
    """Left rows with ``out_col`` = ``right_value`` of the latest right row at or before them.

    Ties in time resolve to the right row (it counts as "at or before") and,
    among right rows, to the larger ``right_value``.
    """
    b = F.date_trunc(bucket, F.col(ts))
    lft = left.select(F.col(key), F.col(ts), F.col(left_id), b.alias("_b"), F.lit(1).alias("_side"),
                      F.lit(None).cast(right.schema[right_value].dataType).alias("_rv"))
    rgt = right.select(F.col(key), F.col(ts), F.lit(None).cast(left.schema[left_id].dataType).alias(left_id),
                       b.alias("_b"), F.lit(0).alias("_side"), F.col(right_value).alias("_rv"))
    both = lft.unionByName(rgt)
    w = (
        Window.partitionBy(key, "_b")
        .orderBy(F.col(ts), F.col("_side"), F.col("_rv"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    in_bucket = both.withColumn("_m", F.last("_rv", ignorenulls=True).over(w)).where(F.col("_side") == 1)

    # Last right row of each (key, bucket), carried forward to later buckets, also to those with left
    # rows only: one row per (key, bucket) from a partial aggregate, so its window stays small.
    right_row = F.when(F.col("_side") == 0, F.struct(F.col(ts), F.col("_rv")))
    per_bucket = both.groupBy(key, "_b").agg(F.max(right_row).alias("_last"))
    wb = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_bucket.select(key, "_b", F.last("_last", ignorenulls=True).over(wb)["_rv"].alias("_prev"))
    out = in_bucket.join(carry, [key, "_b"], "left")
    return out.select(
        F.col(left_id), F.col(key), F.col(ts), F.coalesce(F.col("_m"), F.col("_prev")).alias(out_col)
    )
