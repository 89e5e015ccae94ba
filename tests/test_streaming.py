"""Streaming jobs equal batch results; late rows are dropped by the watermark."""

import datetime as dt
import time

from pyspark.sql import functions as F

from strata.session import scratch_path
from strata.streaming import streams as ST

SCHEMA = "event_id long, ts timestamp_ntz, event_type string"


def _land(spark, batches):
    """One file per batch; writes are spaced so modification times order them."""
    root = scratch_path(spark, "t-landing")
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(root)
        time.sleep(1.2)
    return root


def test_counts_stream_equals_batch_in_order(spark):
    d = dt.datetime
    b1 = [(1, d(2024, 1, 1, 0, 5), "a"), (2, d(2024, 1, 1, 0, 30), "a"), (3, d(2024, 1, 1, 1, 10), "b")]
    b2 = [(4, d(2024, 1, 1, 2, 0), "a"), (5, d(2024, 1, 1, 3, 0), "a")]
    root = _land(spark, [b1, b2])
    src = ST.file_stream(spark, root, spark.createDataFrame([], SCHEMA).schema)
    got = {(r.window_start_us, r.event_type): r.n for r in ST.event_count_stream(spark, src, "ts", "event_type", "1 hour", "1 hour").collect()}
    assert sum(got.values()) == 5 and len(got) == 4


def test_late_rows_are_dropped(spark):
    d = dt.datetime
    # Late rows are filtered against the watermark of the previous batch, so
    # the late file must arrive at least two batches after the watermark moved.
    b1 = [(1, d(2024, 1, 10, 0, 0), "a"), (2, d(2024, 1, 10, 5, 0), "a")]
    b2 = [(4, d(2024, 1, 10, 6, 0), "a")]
    b3 = [(3, d(2024, 1, 1, 0, 0), "a")]  # far behind the watermark
    b4 = [(5, d(2024, 1, 10, 7, 0), "a")]
    root = _land(spark, [b1, b2, b3, b4])
    src = ST.file_stream(spark, root, spark.createDataFrame([], SCHEMA).schema)
    out = ST.dedup_stream(spark, src, "event_id", "ts", "1 hour")
    ids = sorted(r.event_id for r in out.collect())
    assert ids == [1, 2, 4, 5]


def test_dedup_drops_replays(spark):
    d = dt.datetime
    rows = [(1, d(2024, 1, 1, 0, 0), "a"), (2, d(2024, 1, 1, 1, 0), "b")]
    root = _land(spark, [rows, rows])
    src = ST.file_stream(spark, root, spark.createDataFrame([], SCHEMA).schema)
    out = ST.dedup_stream(spark, src, "event_id", "ts", "1 day")
    assert sorted(r.event_id for r in out.collect()) == [1, 2]
    assert out.where(F.col("event_id") == 1).count() == 1


def test_continuous_harvest_can_be_started_and_stopped(spark):
    d = dt.datetime
    root = _land(spark, [[(1, d(2024, 1, 1), "a"), (2, d(2024, 1, 1, 1), "b")]])
    src = ST.file_stream(spark, root, spark.createDataFrame([], SCHEMA).schema)
    out_root = scratch_path(spark, "t-harvest")
    q = ST.start_harvest(src, lambda b: b.select("event_id", "event_type"), out_root, interval="1 second")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = ST.read_harvest_store(spark, f"{out_root}/store", ["event_id"])
    assert sorted(r.event_id for r in got.collect()) == [1, 2]
