"""Record operators: task-result classification, harvest with per-project
watermarks, idempotent upsert, pruning, category rollups, liveness and
change-log folding.

Everything is a projection, an aggregate with partial (map-side) combine, or
an equi-join on a key; nothing collects a group into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.time import epoch_us, ntz_literal
from strata.operators.ledger import sequence_numbers

# Task type -> learning category, agent type -> domain, and the
# confidences assigned to error / non-empty / other results.
CATEGORY_BY_TASK = [
    ("agent_improvement", ["validate", "validate_all", "review_code", "audit_security"]),
    ("pattern_discovered", ["run_query", "run_medallion", "aggregate"]),
    ("workflow_optimization", ["check_health", "plan_project"]),
    ("kb_insight", ["ingest_file", "transform", "export"]),
    ("config_tuning", ["generate_dbt_model", "generate_pipeline"]),
]
DOMAIN_BY_AGENT = {
    "data-pipeline": "medallion",
    "analytics": "duckdb",
    "code-gen": "dbt",
    "reviewer": "data-quality",
    "orchestrator": "consensus",
}
DEFAULT_DOMAIN = "python"
CONFIDENCE_ERROR, CONFIDENCE_ROWS, CONFIDENCE_OTHER = 0.3, 0.8, 0.6
HIGH_VALUE_CONFIDENCE = 0.7
HIGH_VALUE_CATEGORIES = ("error_resolution", "pattern_discovered")
APPLIED_CATEGORIES = ("kb_insight", "agent_improvement", "error_resolution", "pattern_discovered")

RECORD_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("category", T.StringType()),
        T.StructField("domain", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("project_name", T.StringType()),
        T.StructField("source_agent", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)


def _category(task_type: Column, error: Column) -> Column:
    expr = F.when(error.isNotNull(), F.lit("error_resolution"))
    for cat, types in CATEGORY_BY_TASK:
        expr = expr.when(task_type.isin(types), F.lit(cat))
    return expr  # NULL: not noteworthy, dropped


def _domain(agent: Column) -> Column:
    expr = None
    for a, d in DOMAIN_BY_AGENT.items():
        expr = F.when(agent == a, F.lit(d)) if expr is None else expr.when(agent == a, F.lit(d))
    return expr.otherwise(F.lit(DEFAULT_DOMAIN))


def classify_results(
    results: DataFrame,
    id_col: str = "result_id",
    ts_col: str = "ts",
    task_type: str = "task_type",
    agent_type: str = "agent_type",
    project: str = "project_name",
    error: str = "error",
    rows: str = "rows",
    table: str = "table_name",
    details: tuple[str, ...] = ("view", "report", "description"),
) -> DataFrame:
    """Learning records from task results; results of unknown task types are dropped.

    Result fields are nullable columns: ``error`` (message), ``rows`` (count),
    ``table_name`` and ``details`` (further fields of the body, in this order,
    where ``results`` has them); a NULL means the field is absent from the
    result. Every field of a body is cut at 300 characters.
    """
    tt, ag, er, rw, tb = F.col(task_type), F.col(agent_type), F.col(error), F.col(rows), F.col(table)
    title = (
        F.when(er.isNotNull(), F.concat(F.lit("Error in "), tt, F.lit(": "), F.substring(er, 1, 80)))
        .when(rw.isNotNull(), F.concat(tt, F.lit(" produced "), rw.cast("string"), F.lit(" rows")))
        .when(tb.isNotNull(), F.concat(tt, F.lit(" on "), tb))
        .otherwise(F.concat(ag, F.lit(": "), tt, F.lit(" completed")))
    )
    body = F.when(
        er.isNotNull(), F.concat(F.lit("Task "), tt, F.lit(" by "), ag, F.lit(" failed: "), er)
    ).otherwise(
        F.concat_ws(
            "\n",
            F.concat(F.lit("Task: "), tt),
            F.concat(F.lit("Agent: "), ag),
            F.when(rw.isNotNull(), F.concat(F.lit("rows: "), F.substring(rw.cast("string"), 1, 300))),
            F.when(tb.isNotNull(), F.concat(F.lit("table: "), F.substring(tb, 1, 300))),
            *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), F.substring(F.col(c), 1, 300))) for c in details if c in results.columns],
        )
    )
    confidence = (
        F.when(er.isNotNull(), F.lit(CONFIDENCE_ERROR))
        .when(F.coalesce(rw, F.lit(0)) > 0, F.lit(CONFIDENCE_ROWS))
        .otherwise(F.lit(CONFIDENCE_OTHER))
    )
    out = results.select(
        F.col(id_col).alias("id"),
        F.col(ts_col).alias("ts"),
        _category(tt, er).alias("category"),
        _domain(ag).alias("domain"),
        title.alias("title"),
        body.alias("body"),
        confidence.alias("confidence"),
        F.col(project).alias("project_name"),
        ag.alias("source_agent"),
        F.create_map(F.lit("task_type"), tt).alias("metadata"),
    )
    return out.where(F.col("category").isNotNull())


def high_value(records: DataFrame) -> DataFrame:
    return records.where(
        (F.col("confidence") >= HIGH_VALUE_CONFIDENCE) | F.col("category").isin(*HIGH_VALUE_CATEGORIES)
    )


def high_value_top(records: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most confident high-value records (ties by id): TakeOrderedAndProject."""
    return high_value(records).orderBy(F.col("confidence").desc(), F.col("id")).limit(n)


def counts_by_axes(records: DataFrame) -> DataFrame:
    """Counts by category, by domain (empty domain skipped) and overall, in one pass."""
    agg = records.groupingSets([["category"], ["domain"], []], "category", "domain").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((F.col("confidence") >= HIGH_VALUE_CONFIDENCE) | F.col("category").isin(*HIGH_VALUE_CATEGORIES))
        .alias("n_high_value"),
        F.grouping_id().alias("_g"),
    )
    axis = F.when(F.col("_g") == 1, "category").when(F.col("_g") == 2, "domain").otherwise("total")
    key = F.when(F.col("_g") == 1, F.col("category")).when(F.col("_g") == 2, F.col("domain")).otherwise(F.lit("all"))
    out = agg.select(axis.alias("axis"), key.alias("key"), "n", "n_high_value")
    return out.where(~((F.col("axis") == "domain") & (F.coalesce(F.col("key"), F.lit("")) == "")))


def counts_by_project(records: DataFrame, registry: DataFrame, applied: Column) -> DataFrame:
    """Status per project plus a total row (project NULL).

    registered and active count projects of ``registry`` (project_name, status;
    one row each), harvested the project's records, applied those for which
    ``applied`` holds. Projects without records, and records without a
    registered project, have rows too.
    """
    per = records.groupBy("project_name").agg(F.count(F.lit(1)).alias("harvested"), F.count_if(applied).alias("applied"))
    known = registry.groupBy("project_name").agg(F.lit(1).alias("registered"), F.max((F.col("status") == "active").cast("int")).alias("active"))
    per = known.join(per, "project_name", "full")
    return per.rollup("project_name").agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("registered", "active", "harvested", "applied")])


def prune(records: DataFrame, applied_ids: DataFrame, key: str = "id") -> DataFrame:
    """Records not yet applied (left anti join on the id)."""
    return records.join(applied_ids.select(key), key, "left_anti")


def upsert_latest(existing: DataFrame, incoming: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Union of both sides, keeping the highest ``version`` per key.

    ``max_by`` over a struct is a hash aggregate with partial combine, so no
    per-key sort and no hot-key task holding all versions.
    """
    both = existing.unionByName(incoming)
    others = [c for c in both.columns if c not in keys]
    latest = both.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(version)).alias("_r"))
    return latest.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in others])


def project_registry(events: DataFrame, project: Column, ts: Column, before: str, min_records: int) -> DataFrame:
    """Per project: status (active when it has at least ``min_records``) and the
    previous harvest watermark (latest record before ``before``, NULL if none)."""
    return events.groupBy(project.alias("project_name")).agg(
        F.when(F.count(F.lit(1)) >= min_records, "active").otherwise("done").alias("status"),
        F.max(F.when(ts < F.lit(before).cast("timestamp_ntz"), ts)).alias("last_harvest"),
    )


def harvest(records: DataFrame, registry: DataFrame) -> DataFrame:
    """Records of active projects at or after their watermark (all if none yet)."""
    active = registry.where(F.col("status") == "active").select("project_name", "last_harvest")
    j = records.join(active, "project_name")
    return j.where(F.col("last_harvest").isNull() | (F.col("ts") >= F.col("last_harvest"))).drop("last_harvest")


def new_watermarks(harvested: DataFrame, records: DataFrame, marks: DataFrame) -> DataFrame:
    """(project_name, last_harvest, learning_count) after a harvest of ``records``.

    last_harvest is the latest harvested timestamp, or the old mark where
    nothing new came; rows at the mark are harvested again and merged away.
    learning_count is the number of all the project's records, not of the new ones.
    """
    latest = harvested.groupBy("project_name").agg(F.max("ts").alias("latest"))
    total = records.groupBy("project_name").agg(F.count(F.lit(1)).alias("learning_count"))
    old = marks.select("project_name", F.col("last_harvest").alias("old"))
    out = latest.join(total, "project_name", "left").join(old, "project_name", "left")
    return out.select("project_name", F.greatest("latest", "old").alias("last_harvest"), F.coalesce("learning_count", F.lit(0)).cast("long").alias("learning_count"))


WATERMARK_SCHEMA = T.StructType(
    [
        T.StructField("project_name", T.StringType()),
        T.StructField("last_harvest", T.TimestampNTZType()),
        T.StructField("learning_count", T.LongType()),
        T.StructField("harvest_no", T.LongType()),
    ]
)


def harvest_into(records: DataFrame, registry: DataFrame, store, marks) -> dict:
    """Harvest the records of active projects since their stored watermarks into a stored table.

    ``store`` (records, keyed) and ``marks`` (``WATERMARK_SCHEMA``, keyed by
    project) are versioned stores. Records are published before watermarks: a
    job lost in between harvests some records again, which changes nothing. A
    harvest without new records publishes no version of the records. Returns
    the store's version and the numbers of added and changed records.
    """
    active = registry.where(F.col("status") == "active").select("project_name", "status")
    old = marks.read()
    due = harvest(records, active.join(old.select("project_name", "last_harvest"), "project_name", "left"))
    result = store.merge(due, "ts")
    new = new_watermarks(due, records, old).join(old.select("project_name", F.col("last_harvest").alias("_t"), F.col("learning_count").alias("_n")), "project_name", "left")
    new = new.where(~(F.col("last_harvest").eqNullSafe(F.col("_t")) & F.col("learning_count").eqNullSafe(F.col("_n")))).drop("_t", "_n")
    marks.merge(new.withColumn("harvest_no", F.lit(marks.version() + 1).cast("long")), "harvest_no")
    return result


def apply_plan(records: DataFrame, min_confidence: float | None = None) -> DataFrame:
    """Dry-run plan: one row per record in the four applied categories.

    ``min_confidence`` leaves out less certain records (off by default).
    """
    if min_confidence is not None:
        records = records.where(F.col("confidence") >= min_confidence)
    return records.where(F.col("category").isin(*APPLIED_CATEGORIES)).select(
        "id",
        "category",
        "title",
        F.concat(F.lit("(dry run) "), F.col("domain"), F.lit("/"), F.col("title")).alias("target_file"),
        F.concat(F.lit("Would apply from "), F.col("project_name")).alias("description"),
    )


def ordered_catalog(entries: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Entries numbered within each ``key`` by ``order`` (entry_no from 1), and the key's number of entries (``<key>_entries``).

    Positions come from range partitions and their offsets, so a key with most
    of the entries is spread over many tasks; only its first position and its
    size, one row for each key, are joined back.
    """
    placed = sequence_numbers(entries, [F.col(c) for c in (key, *order)])
    firsts = placed.groupBy(key).agg(F.min("seq").alias("_first"), F.count(F.lit(1)).alias(f"{key}_entries"))
    return placed.join(firsts, key).withColumn("entry_no", F.col("seq") - F.col("_first") + 1).drop("seq", "_first")


def liveness(
    heartbeats: DataFrame,
    key: str,
    ts: str,
    as_of: str,
    ttl_seconds: int,
    state: str,
    capability: str,
    idle_state: str,
    tiebreak: str | None = None,
    capabilities: DataFrame | None = None,
) -> DataFrame:
    """Latest heartbeat per agent; alive when ``as_of - last <= ttl`` (total seconds).

    ``capabilities`` (key, array column ``capabilities``) lists what each agent
    can do; ``has_capability`` is membership of ``capability`` in that list
    (false without a list). Without the table the flag marks agents that ever
    reported ``capability`` as their state. ``idle`` are alive agents whose
    latest state is ``idle_state``. Times are wall-clock
    TIMESTAMP_NTZ values; ages are computed without the session time zone.
    """
    t_us = epoch_us(F.col(ts))
    order = F.struct(t_us, F.col(tiebreak)) if tiebreak else t_us
    agg = heartbeats.groupBy(key).agg(
        F.max(t_us).alias("last_seen_us"),
        F.max_by(F.col(state), order).alias("last_state"),
        F.max(F.col(state) == capability).alias("has_capability"),
    )
    if capabilities is not None:
        listed = capabilities.select(key, F.array_contains("capabilities", capability).alias("_listed"))
        agg = agg.join(listed, key, "left").withColumn("has_capability", F.coalesce("_listed", F.lit(False))).drop("_listed")
    alive = (epoch_us(ntz_literal(as_of)) - F.col("last_seen_us")) <= F.lit(ttl_seconds * 1_000_000)
    return agg.select(
        key,
        "last_state",
        "last_seen_us",
        alive.alias("alive"),
        F.col("has_capability"),
        (alive & (F.col("last_state") == idle_state)).alias("idle"),
    )


def fold_changes(log: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """Current state per key: last write of each field, version = number of updates."""
    o = F.struct(*[F.col(c) for c in order])
    return log.groupBy(key).agg(
        *[F.max_by(F.col(f), o).alias(f"last_{f}") for f in fields],
        F.count(F.lit(1)).alias("version"),
    )


def latest_change(changes: DataFrame, ts: str, key: str) -> DataFrame:
    """The most recent applied change (rollback target without an explicit id):
    one global ``max_by`` over (timestamp, id), a partial aggregate, no sort."""
    others = [c for c in changes.columns]
    return changes.agg(F.max_by(F.struct(*others), F.struct(F.col(ts), F.col(key))).alias("_c")).select("_c.*")
