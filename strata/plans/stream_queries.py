"""Streaming queries: events land as files in slices of time, in no order within
a slice, and are consumed by Structured Streaming jobs run to completion
(availableNow), several files at a time; each returns the batch view of its sink
so it can be compared with the equivalent batch SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators.quality import Check
from strata.operators.records import classify_results
from strata.plans.quality_queries import EVENTS_WITH_NULLS_SQL, events_with_nulls
from strata.plans.record_queries import _K_SPARK, RECORDS_SQL, _results_exprs
from strata.plans.registry import load, query
from strata.session import scratch_path
from strata.sources.files import path_exists
from strata.streaming import streams as ST

_LANDINGS: dict[tuple, tuple[str, int]] = {}


def _landing(spark: SparkSession, df: DataFrame, tag: tuple, again=None, marker: bool = False) -> tuple[str, int]:
    """Arrival files of the stream and the seconds of a slice, written once per application and
    input; every run still gets its own checkpoint and sink."""
    key = (spark.sparkContext.applicationId, *tag)
    if key not in _LANDINGS or not path_exists(spark, _LANDINGS[key][0]):
        root = scratch_path(spark, "stream-landing")
        seconds = ST.land_slices(df, "ts", root, again=again)
        if marker:
            ST.land_marker(df, "ts", root, 30 * 86_400)
        _LANDINGS[key] = root, seconds
    return _LANDINGS[key]


def _source(spark: SparkSession, df: DataFrame, tag: tuple, again=None, marker: bool = False) -> tuple[DataFrame, int]:
    root, seconds = _landing(spark, df, tag, again, marker)
    return ST.file_stream(spark, root, df.schema, files_per_trigger=4), seconds


@query(
    "stream_harvest",
    oracle=f"SELECT id, category, project_name, CAST(confidence AS DOUBLE) AS confidence FROM ({RECORDS_SQL})",
)
def q_stream_harvest(spark: SparkSession, data_dir: str) -> DataFrame:
    """Micro-batch harvest of task results into an idempotent per-epoch store."""
    events = load(spark, data_dir, "events")

    def to_records(batch: DataFrame) -> DataFrame:
        return classify_results(batch.selectExpr(*_results_exprs(_K_SPARK))).drop("metadata")

    source, _ = _source(spark, events, ("events", data_dir))
    out = ST.harvest_stream(spark, source, to_records, ["category", "project_name", "id"], partition_by=["category"], every=2)
    return out.select("id", "category", "project_name", "confidence")


@query("stream_dedup", oracle="SELECT event_id, user_id, event_type FROM events")
def q_stream_dedup(spark: SparkSession, data_dir: str) -> DataFrame:
    """Event stream in which all error events arrive again a slice later, de-duplicated by id.

    The watermark delay of two slices covers the replay: it goes by de-duplication, not by lateness.
    """
    events = load(spark, data_dir, "events")
    source, seconds = _source(spark, events, ("events+replay", data_dir), again=F.col("event_type") == "error")
    out = ST.dedup_stream(spark, source, "event_id", "ts", f"{2 * seconds} seconds")
    return out.select("event_id", "user_id", "event_type")


@query(
    "stream_sessions",
    oracle=(
        "WITH o AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL "
        "OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 1 DAY THEN 1 ELSE 0 END AS new_s, "
        "event_id FROM events), "
        "g AS (SELECT *, sum(new_s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM o) "
        "SELECT user_id, epoch_us(min(ts)) AS session_start_us, epoch_us(max(ts) + INTERVAL 1 DAY) AS session_end_us, "
        "count(*) AS n_events FROM g GROUP BY user_id, sid"
    ),
)
def q_stream_sessions(spark: SparkSession, data_dir: str) -> DataFrame:
    """Per-user activity sessions (inactivity gap 1 day) from the event stream, closed by its end marker."""
    events = load(spark, data_dir, "events")
    source, seconds = _source(spark, events, ("events+marker", data_dir), marker=True)
    return ST.session_stream(spark, source, "user_id", "ts", "1 day", f"{seconds} seconds")


STREAM_CHECKS = [
    Check("user_id", "not_null"),
    Check("value", "in_range", {"min": 1, "max": 400}),
    Check("event_type", "in_set", {"values": ["view", "click", "purchase", "error"]}),
]


@query(
    "stream_quality_split",
    oracle=(
        f"WITH ev AS ({EVENTS_WITH_NULLS_SQL}), f AS (SELECT event_id, concat_ws(',', "
        "CASE WHEN NOT (user_id IS NOT NULL) THEN 'user_id.not_null' END, "
        "CASE WHEN NOT (value >= 1 AND value <= 400) THEN 'value.in_range' END, "
        "CASE WHEN NOT (event_type IN ('view', 'click', 'purchase', 'error')) THEN 'event_type.in_set' END) AS failed_rules "
        "FROM ev) SELECT event_id, CASE WHEN failed_rules = '' THEN 'pass' ELSE 'quarantine' END AS route, failed_rules FROM f"
    ),
)
def q_stream_quality_split(spark: SparkSession, data_dir: str) -> DataFrame:
    """Streaming ingest routed to pass / quarantine by row rules (NULLs injected)."""
    ev = events_with_nulls(spark, data_dir)
    source, _ = _source(spark, ev, ("events_nulls", data_dir))
    out = ST.quality_split_stream(spark, source, STREAM_CHECKS)
    return out.select("event_id", "route", "failed_rules")


@query(
    "stream_event_counts",
    oracle="SELECT epoch_us(date_trunc('hour', ts)) AS window_start_us, event_type, count(*) AS n "
    "FROM events GROUP BY ALL",
)
def q_stream_event_counts(spark: SparkSession, data_dir: str) -> DataFrame:
    """Hourly counts per event type, update mode with a watermark of one slice."""
    events = load(spark, data_dir, "events")
    source, seconds = _source(spark, events, ("events", data_dir))
    return ST.event_count_stream(spark, source, "ts", "event_type", "1 hour", f"{seconds} seconds", every=2)
