"""Versioned store, stored harvest, and streams whose sinks and state stay small."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from strata.operators import records as R
from strata.session import local_path, scratch_path
from strata.sources.store import Conflict, VersionedStore, names_in
from strata.streaming import streams as ST

ROWS = "id long, kind string, ver int, note string"


def _store(spark, buckets=2):
    schema = spark.createDataFrame([], ROWS).schema
    return VersionedStore(spark, scratch_path(spark, "t-store"), schema, ["kind", "id"], ["kind"], buckets)


def _rows(store):
    return sorted((tuple(r) for r in store.read().collect()), key=repr)


def test_merge_inserts_replaces_and_keeps(spark):
    s = _store(spark)
    assert s.read().count() == 0 and s.version() == 0
    first = spark.createDataFrame([(i, f"k/{i % 3} x", 1, None) for i in range(30)] + [(99, None, 1, "no kind")], ROWS)
    assert s.merge(first, "ver") == {"version": 1, "added": 31, "changed": 0}
    assert s.merge(first, "ver") == {"version": 1, "added": 0, "changed": 0}  # nothing new: no version
    older = first.where("id < 5").withColumn("ver", F.lit(0))
    assert s.merge(older, "ver")["changed"] == 0
    second = spark.createDataFrame([(3, "k/0 x", 2, "new"), (3, "k/0 x", 1, "old"), (100, "k/0 x", 1, None), (100, "k/0 x", 1, None), (99, None, 2, "still none")], ROWS)
    assert s.merge(second, "ver") == {"version": 2, "added": 1, "changed": 2}
    want = {(i, f"k/{i % 3} x", 1, None) for i in range(30)} - {(3, "k/0 x", 1, None)} | {(3, "k/0 x", 2, "new"), (100, "k/0 x", 1, None), (99, None, 2, "still none")}
    assert _rows(s) == sorted(want, key=repr)
    assert s.read(1).count() == 31  # the version before is still whole


def test_only_touched_partitions_are_rewritten_and_old_ones_go(spark):
    s = _store(spark, buckets=1)
    s.merge(spark.createDataFrame([(i, f"k{i % 3}", 1, None) for i in range(9)], ROWS), "ver")
    s.merge(spark.createDataFrame([(0, "k0", 2, "x")], ROWS), "ver")
    assert s.manifest()["folders"] == {"kind=k0/_bucket=0": 2, "kind=k1/_bucket=0": 1, "kind=k2/_bucket=0": 1}
    assert s.vacuum(keep=1) == 1 and s.read().count() == 9


def test_a_second_writer_of_a_version_fails_and_changes_nothing(spark):
    s = _store(spark)
    s.merge(spark.createDataFrame([(1, "a", 1, None)], ROWS), "ver")
    with pytest.raises(Conflict):
        s._publish(1, {}, {})
    assert s.read().count() == 1 and not [n for n in names_in(spark, f"{s.root}/_versions") if n.endswith(".tmp")]


def test_partition_columns_must_be_keys(spark):
    with pytest.raises(ValueError):
        VersionedStore(spark, "x", spark.createDataFrame([], ROWS).schema, ["id"], ["kind"])


def test_stored_harvest(spark):
    d = dt.datetime
    schema = "id long, ts timestamp_ntz, category string, project_name string"
    day1 = [(1, d(2024, 1, 1), "a", "p"), (2, d(2024, 1, 2), "b", "p"), (3, d(2024, 1, 2), "a", "q"), (4, d(2024, 1, 2), "a", "idle")]
    day2 = [*day1, (5, d(2024, 1, 3), "a", "p"), (6, d(2023, 1, 1), "a", "p")]  # 6 is older than p's mark
    registry = spark.createDataFrame([("p", "active"), ("q", "active"), ("idle", "done"), ("empty", "active")], "project_name string, status string")
    root = scratch_path(spark, "t-harvest-store")
    rows = spark.createDataFrame(day1, schema)
    store = VersionedStore(spark, f"{root}/r", rows.schema, ["category", "project_name", "id"], ["category"])
    marks = VersionedStore(spark, f"{root}/m", R.WATERMARK_SCHEMA, ["project_name"])
    assert R.harvest_into(rows, registry, store, marks)["added"] == 3
    again = R.harvest_into(rows, registry, store, marks)
    assert (again["added"], again["changed"], again["version"]) == (0, 0, 1) and marks.version() == 1
    assert R.harvest_into(spark.createDataFrame(day2, schema), registry, store, marks)["added"] == 1
    assert sorted(r["id"] for r in store.read().collect()) == [1, 2, 3, 5]
    assert {r["project_name"]: (r["last_harvest"], r["learning_count"]) for r in marks.read().collect()} == {"p": (d(2024, 1, 3), 4), "q": (d(2024, 1, 2), 1)}


# ------------------------------------------------------------------ streams

EVENTS = "event_id long, ts timestamp_ntz, user_id long"


def _events(spark, n=400):
    start = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, start + dt.timedelta(minutes=37 * i + (i % 11)), i % 7) for i in range(n)], EVENTS)


def test_epochs_are_folded_while_the_stream_goes_on(spark):
    ev = _events(spark)
    root = scratch_path(spark, "t-fold")
    ST.land_slices(ev, "ts", f"{root}/in", slices=6, least_files=2)
    source = ST.file_stream(spark, f"{root}/in", ev.schema, files_per_trigger=1)
    got = ST.harvest_stream(spark, source, lambda b: b.select("event_id", "user_id"), ["user_id", "event_id"], f"{root}/out", ["user_id"], every=3)
    assert sorted(r["event_id"] for r in got.collect()) == list(range(400))
    store = ST.harvest_store(spark, source, lambda b: b.select("event_id", "user_id"), ["user_id", "event_id"], f"{root}/out", ["user_id"], every=3)
    assert store.folded() == 10
    assert len(names_in(spark, f"{root}/out/store/epochs")) <= 5  # 12 epochs were written; read: only those after the last fold
    assert store._after(store.folded()).select("batch_id").distinct().count() == 1
    store.compact(store.folded())  # nothing to do
    assert store.read().count() == 400


def test_a_replayed_epoch_replaces_itself(spark):
    ev = _events(spark, 20).select("event_id", "user_id")
    store = ST.EpochStore(spark, scratch_path(spark, "t-replay"), ev.schema, ["event_id"], every=2)
    assert store.read().count() == 0
    for epoch in (0, 0, 1, 1):
        store.write(ev, epoch)
    store.write(ev.withColumn("user_id", F.lit(-1).cast("long")).where("event_id < 5"), 2)
    got = {r["event_id"]: r["user_id"] for r in store.read().collect()}
    assert len(got) == 20 and [got[i] for i in range(6)] == [-1] * 5 + [5]


def test_sessions_leave_the_state(spark, monkeypatch):
    ev = _events(spark)
    root = scratch_path(spark, "t-sessions")
    seconds = ST.land_slices(ev, "ts", root, slices=5, least_files=2)
    ST.land_marker(ev, "ts", root, 30 * 86_400)
    finished = []
    plain = ST.run_available
    monkeypatch.setattr(ST, "run_available", lambda *a: finished.append(plain(*a)))
    source = ST.file_stream(spark, root, ev.schema, files_per_trigger=3)
    got = ST.session_stream(spark, source, "user_id", "ts", "2 hours", f"{seconds} seconds").collect()
    assert sum(r["n_events"] for r in got) == 400 and all(r["user_id"] is not None for r in got)
    state = [p.stateOperators[0].numRowsTotal for p in finished[0].recentProgress if p.stateOperators]
    assert state[-1] == 1 and max(state) < len(got)  # only the end marker is still open


def test_replayed_rows_go_by_deduplication(spark, monkeypatch):
    ev = _events(spark)
    root = scratch_path(spark, "t-dedup")
    seconds = ST.land_slices(ev, "ts", root, slices=4, least_files=3, again=F.col("user_id") < 3)
    finished = []
    plain = ST.run_available
    monkeypatch.setattr(ST, "run_available", lambda *a: finished.append(plain(*a)))
    out = ST.dedup_stream(spark, ST.file_stream(spark, root, ev.schema, files_per_trigger=4), "event_id", "ts", f"{2 * seconds} seconds")
    assert sorted(r["event_id"] for r in out.collect()) == list(range(400))
    late = sum(p.stateOperators[0].numRowsDroppedByWatermark for p in finished[0].recentProgress if p.stateOperators)
    dropped = sum(int(p.stateOperators[0].customMetrics.get("numDroppedDuplicateRows", 0)) for p in finished[0].recentProgress if p.stateOperators)
    assert late == 0 and dropped == ev.where("user_id < 3").count()


def test_empty_streams_give_empty_results(spark):
    ev = _events(spark).where("1 = 0")
    root = scratch_path(spark, "t-empty")
    ST.land_slices(ev, "ts", root)
    assert os.path.isdir(local_path(root))
    source = ST.file_stream(spark, root, ev.schema)
    assert ST.harvest_stream(spark, source, lambda b: b.select("event_id"), ["event_id"]).count() == 0
    assert ST.session_stream(spark, source, "user_id", "ts", "1 day", "1 day").count() == 0
    assert ST.event_count_stream(spark, source, "ts", "user_id", "1 hour", "1 hour").count() == 0
    assert ST.quality_split_stream(spark, source, [ST.Check("user_id", "not_null")]).count() == 0
    assert ST.dedup_stream(spark, source, "event_id", "ts", "1 day").count() == 0
