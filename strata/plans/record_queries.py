"""Record, harvest, scoring, liveness and ledger queries.

Task results, learning records and scoring evidence are all derived from the
``events`` table (one result per event), so the work grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.text import slug
from strata.functions.time import epoch_us
from strata.operators import ledger as L
from strata.operators import records as R
from strata.operators import scoring as S
from strata.plans.registry import load, query
from strata.session import scratch_path
from strata.sources import files as src
from strata.sources.store import VersionedStore

# ---------------------------------------------------------------- derived inputs

_K_SPARK = "CAST(get_json_object(props, '$.k') AS INT)"
_K_DUCK = "CAST(json_extract_string(props, '$.k') AS INTEGER)"


def _results_exprs(k: str) -> list[str]:
    return [
        "event_id AS result_id",
        "ts",
        "'project-' || CAST(user_id AS STRING) AS project_name",
        "CASE event_type WHEN 'view' THEN 'analytics' WHEN 'click' THEN 'data-pipeline' WHEN 'purchase' THEN 'reviewer' "
        "WHEN 'signup' THEN 'orchestrator' ELSE 'code-gen' END AS agent_type",
        "CASE event_type WHEN 'view' THEN 'run_query' WHEN 'click' THEN 'transform' WHEN 'purchase' THEN 'validate' "
        "WHEN 'signup' THEN 'notify_user' ELSE 'ingest_file' END AS task_type",
        "CASE WHEN event_type = 'error' THEN 'failed with ' || props END AS error",
        f"CASE WHEN event_type = 'view' THEN {k} END AS rows",
        f"CASE WHEN event_type = 'click' THEN 't_' || CAST({k} AS STRING) END AS table_name",
        f"CASE WHEN event_type = 'view' AND {k} >= 50 THEN 'gold_' || CAST({k} AS STRING) END AS view",
        "CASE WHEN event_type = 'purchase' THEN repeat(props || ' ', 40) END AS report",
        "CASE WHEN event_type IN ('click', 'purchase') AND value > 20 THEN 'event of user ' || CAST(user_id AS STRING) END AS description",
    ]


def task_results(spark: SparkSession, data_dir: str) -> DataFrame:
    # props is parsed once per row; later expressions read the column.
    ev = load(spark, data_dir, "events").withColumn("_k", F.expr(_K_SPARK))
    return ev.selectExpr(*_results_exprs("_k"))


def records(spark: SparkSession, data_dir: str) -> DataFrame:
    return R.classify_results(task_results(spark, data_dir))


TASK_RESULTS_SQL = "SELECT " + ", ".join(_results_exprs(_K_DUCK)).replace("AS STRING", "AS VARCHAR") + " FROM events"

_CAT_SQL = (
    "CASE WHEN error IS NOT NULL THEN 'error_resolution' "
    "WHEN task_type IN ('validate', 'validate_all', 'review_code', 'audit_security') THEN 'agent_improvement' "
    "WHEN task_type IN ('run_query', 'run_medallion', 'aggregate') THEN 'pattern_discovered' "
    "WHEN task_type IN ('check_health', 'plan_project') THEN 'workflow_optimization' "
    "WHEN task_type IN ('ingest_file', 'transform', 'export') THEN 'kb_insight' "
    "WHEN task_type IN ('generate_dbt_model', 'generate_pipeline') THEN 'config_tuning' END"
)
_DOMAIN_SQL = (
    "CASE agent_type WHEN 'data-pipeline' THEN 'medallion' WHEN 'analytics' THEN 'duckdb' WHEN 'code-gen' THEN 'dbt' "
    "WHEN 'reviewer' THEN 'data-quality' WHEN 'orchestrator' THEN 'consensus' ELSE 'python' END"
)
RECORDS_SQL = (
    f"SELECT * FROM (SELECT result_id AS id, ts, {_CAT_SQL} AS category, {_DOMAIN_SQL} AS domain, "
    "CASE WHEN error IS NOT NULL THEN 'Error in ' || task_type || ': ' || substr(error, 1, 80) "
    "WHEN rows IS NOT NULL THEN task_type || ' produced ' || CAST(rows AS VARCHAR) || ' rows' "
    "WHEN table_name IS NOT NULL THEN task_type || ' on ' || table_name "
    "ELSE agent_type || ': ' || task_type || ' completed' END AS title, "
    "CASE WHEN error IS NOT NULL THEN 'Task ' || task_type || ' by ' || agent_type || ' failed: ' || error "
    "ELSE concat_ws(chr(10), 'Task: ' || task_type, 'Agent: ' || agent_type, "
    "CASE WHEN rows IS NOT NULL THEN 'rows: ' || substr(CAST(rows AS VARCHAR), 1, 300) END, "
    "CASE WHEN table_name IS NOT NULL THEN 'table: ' || substr(table_name, 1, 300) END, "
    "CASE WHEN view IS NOT NULL THEN 'view: ' || substr(view, 1, 300) END, "
    "CASE WHEN report IS NOT NULL THEN 'report: ' || substr(report, 1, 300) END, "
    "CASE WHEN description IS NOT NULL THEN 'description: ' || substr(description, 1, 300) END) END AS body, "
    "CASE WHEN error IS NOT NULL THEN 0.3 WHEN coalesce(rows, 0) > 0 THEN 0.8 ELSE 0.6 END AS confidence, "
    f"project_name, agent_type AS source_agent FROM ({TASK_RESULTS_SQL})) WHERE category IS NOT NULL"
)

_FIRST_HARVEST = "2024-01-15"
_REC_COLS = "id, category, domain, title, body, CAST(confidence AS DOUBLE) AS confidence, project_name, source_agent"


@query("classify_results", oracle=f"SELECT {_REC_COLS} FROM ({RECORDS_SQL})")
def q_classify_results(spark: SparkSession, data_dir: str) -> DataFrame:
    """Task results -> learning records (category, domain, title, body, confidence); unknown types dropped."""
    return records(spark, data_dir).select("id", "category", "domain", "title", "body", "confidence",
                                           "project_name", "source_agent")


@query(
    "records_scan",
    oracle=f"SELECT id, category, project_name, title, CAST(confidence AS DOUBLE) AS confidence "
    f"FROM ({RECORDS_SQL}) WHERE category = 'kb_insight'",
)
def q_records_scan(spark: SparkSession, data_dir: str) -> DataFrame:
    """Records written as a JSON store partitioned by category and appended to (plus a
    corrupt file), scanned back with a schema; the category filter prunes folders."""
    root = scratch_path(spark, "records")
    recs = records(spark, data_dir)
    early = F.col("ts") < F.lit(_FIRST_HARVEST).cast("timestamp_ntz")
    src.write_records(recs.where(early), root, mode="overwrite")
    src.write_records(recs.where(~early), root)
    # A malformed file inside the scanned category folder, next to good ones.
    spark.createDataFrame([("{not json",), ('{"id": "x", "category": ',)], "value string").coalesce(1).write.mode(
        "append"
    ).text(root + "/category=kb_insight")
    scanned = src.read_records(spark, root, R.RECORD_SCHEMA, category="kb_insight")
    return scanned.select("id", "category", "project_name", "title", "confidence")


@query(
    "records_high_value",
    oracle=f"SELECT id, category, CAST(confidence AS DOUBLE) AS confidence FROM ({RECORDS_SQL}) "
    "WHERE confidence >= 0.7 OR category IN ('error_resolution', 'pattern_discovered')",
)
def q_records_high_value(spark: SparkSession, data_dir: str) -> DataFrame:
    return R.high_value(records(spark, data_dir)).select("id", "category", "confidence")


@query(
    "records_high_value_top",
    oracle=f"SELECT id, title, category, CAST(confidence AS DOUBLE) AS confidence FROM ({RECORDS_SQL}) "
    "WHERE confidence >= 0.7 OR category IN ('error_resolution', 'pattern_discovered') "
    "ORDER BY confidence DESC, id LIMIT 10",
)
def q_records_high_value_top(spark: SparkSession, data_dir: str) -> DataFrame:
    """Top-10 high-value records by confidence (ties by id)."""
    return R.high_value_top(records(spark, data_dir), 10).select("id", "title", "category", "confidence")


@query(
    "records_by_category",
    oracle=(
        "SELECT CASE WHEN g = 1 THEN 'category' WHEN g = 2 THEN 'domain' ELSE 'total' END AS axis, "
        "CASE WHEN g = 1 THEN category WHEN g = 2 THEN domain ELSE 'all' END AS key, n, n_high_value FROM ("
        "SELECT category, domain, GROUPING(category, domain) AS g, count(*) AS n, "
        "count(*) FILTER (WHERE confidence >= 0.7 OR category IN ('error_resolution', 'pattern_discovered')) AS n_high_value "
        f"FROM ({RECORDS_SQL}) GROUP BY GROUPING SETS ((category), (domain), ())) "
        "WHERE NOT (g = 2 AND coalesce(domain, '') = '')"
    ),
)
def q_records_by_category(spark: SparkSession, data_dir: str) -> DataFrame:
    """Counts by category, by domain and in total (with high-value counts), one aggregate."""
    return R.counts_by_axes(records(spark, data_dir))


@query(
    "records_status",
    oracle=(
        "WITH p AS (SELECT 'project-' || CAST(user_id AS VARCHAR) AS project_name, "
        "CASE WHEN count(*) >= 60 THEN 1 ELSE 0 END AS active FROM events GROUP BY user_id), "
        f"r AS (SELECT project_name, count(*) AS harvested, count(*) FILTER (WHERE confidence >= 0.8 AND category IN "
        "('kb_insight', 'agent_improvement', 'error_resolution', 'pattern_discovered')) AS applied "
        f"FROM ({RECORDS_SQL}) GROUP BY project_name) "
        "SELECT project_name, count(p.active) AS registered, coalesce(sum(active), 0)::BIGINT AS active, "
        "coalesce(sum(harvested), 0)::BIGINT AS harvested, coalesce(sum(applied), 0)::BIGINT AS applied "
        "FROM p FULL JOIN r USING (project_name) GROUP BY ROLLUP (project_name)"
    ),
)
def q_records_status(spark: SparkSession, data_dir: str) -> DataFrame:
    """Registered and active projects, harvested and applied records: per project and in total."""
    applied = (F.col("confidence") >= 0.8) & F.col("category").isin(*R.APPLIED_CATEGORIES)
    return R.counts_by_project(records(spark, data_dir), _registry(spark, data_dir), applied)


@query(
    "records_prune",
    oracle=f"SELECT id, category FROM ({RECORDS_SQL}) r WHERE id NOT IN "
    f"(SELECT id FROM ({RECORDS_SQL}) WHERE confidence >= 0.8)",
)
def q_records_prune(spark: SparkSession, data_dir: str) -> DataFrame:
    """Records minus the applied ones (applied = confidence >= 0.8), by left anti join."""
    recs = records(spark, data_dir)
    applied = recs.where(F.col("confidence") >= 0.8).select("id")
    return R.prune(recs, applied).select("id", "category")


def _upsert_inputs(spark: SparkSession, data_dir: str):
    recs = records(spark, data_dir).select("id", "category", "project_name", "ts", "confidence")
    existing = recs.where(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")).withColumn("version", F.lit(1))
    incoming = recs.where(F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")).select(
        "id", "category", "project_name", "ts",
        F.round(F.least(F.lit(1.0), F.col("confidence") + 0.05), 2).alias("confidence"),
        F.lit(2).alias("version"),
    )
    return existing, incoming


@query(
    "records_upsert",
    oracle=(
        f"WITH r AS (SELECT id, category, project_name, ts, confidence FROM ({RECORDS_SQL})), "
        "u AS (SELECT id, category, project_name, confidence, 1 AS version FROM r WHERE ts < TIMESTAMP '2024-01-16' "
        "UNION ALL SELECT id, category, project_name, round(least(1.0, confidence + 0.05), 2), 2 FROM r "
        "WHERE ts >= TIMESTAMP '2024-01-10') "
        "SELECT id, category, project_name, CAST(confidence AS DOUBLE) AS confidence, version FROM ("
        "SELECT *, row_number() OVER (PARTITION BY category, project_name, id ORDER BY version DESC) AS rn FROM u) "
        "WHERE rn = 1"
    ),
)
def q_records_upsert(spark: SparkSession, data_dir: str) -> DataFrame:
    """Idempotent upsert by (category, project, id) into a stored table: a re-harvested slice
    replaces older versions, and merging it again changes nothing."""
    existing, incoming = _upsert_inputs(spark, data_dir)
    store = VersionedStore(spark, scratch_path(spark, "upsert"), existing.schema, ["category", "project_name", "id"], ["category"])
    for rows in (existing, incoming, incoming):
        store.merge(rows, "version")
    return store.read().select("id", "category", "project_name", "confidence", "version")


_REGISTRY_SQL = (
    "SELECT 'project-' || CAST(user_id AS VARCHAR) AS project_name, "
    "CASE WHEN count(*) >= 60 THEN 'active' ELSE 'done' END AS status, "
    "max(CASE WHEN ts < TIMESTAMP '2024-01-15' THEN ts END) AS last_harvest FROM events GROUP BY user_id"
)


def _registry(spark: SparkSession, data_dir: str) -> DataFrame:
    ev = load(spark, data_dir, "events")
    project = F.concat(F.lit("project-"), F.col("user_id").cast("string"))
    return R.project_registry(ev, project, F.col("ts"), "2024-01-15", 60)


@query(
    "incremental_harvest",
    oracle=(
        f"SELECT r.id, r.project_name, r.category, CAST(r.confidence AS DOUBLE) AS confidence FROM ({RECORDS_SQL}) r "
        f"JOIN ({_REGISTRY_SQL}) p ON r.project_name = p.project_name "
        "WHERE p.status = 'active' AND (p.last_harvest IS NULL OR r.ts >= p.last_harvest)"
    ),
)
def q_incremental_harvest(spark: SparkSession, data_dir: str) -> DataFrame:
    """Records of active projects since each project's previous watermark."""
    got = R.harvest(records(spark, data_dir), _registry(spark, data_dir))
    return got.select("id", "project_name", "category", "confidence")


RECORD_KEYS = ["category", "project_name", "id"]
_STORED = T.StructType([f for f in R.RECORD_SCHEMA.fields if f.name != "metadata"])


def _stored_harvest(spark: SparkSession, data_dir: str) -> tuple[VersionedStore, VersionedStore]:
    """Two harvests of growing sources into stored records and watermarks: the events up to a day, then all."""
    root = scratch_path(spark, "harvest-store")
    store = VersionedStore(spark, f"{root}/records", _STORED, RECORD_KEYS, ["category"])
    marks = VersionedStore(spark, f"{root}/watermarks", R.WATERMARK_SCHEMA, ["project_name"])
    registry = _registry(spark, data_dir).drop("last_harvest")
    recs = records(spark, data_dir).drop("metadata")
    for part in (recs.where(F.col("ts") < F.lit(_FIRST_HARVEST).cast("timestamp_ntz")), recs):
        R.harvest_into(part, registry, store, marks)
    return store, marks


_ACTIVE_SQL = "SELECT 'project-' || CAST(user_id AS VARCHAR) AS project_name FROM events GROUP BY user_id HAVING count(*) >= 60"


@query(
    "harvest_watermarks",
    oracle=(
        "SELECT project_name, epoch_us(max(ts)) AS last_harvest_us, count(*) AS learning_count "
        f"FROM ({RECORDS_SQL}) JOIN ({_ACTIVE_SQL}) USING (project_name) GROUP BY project_name"
    ),
)
def q_harvest_watermarks(spark: SparkSession, data_dir: str) -> DataFrame:
    """The stored watermark table after two harvests: latest harvested time and all records of each project."""
    _, marks = _stored_harvest(spark, data_dir)
    return marks.read().select("project_name", epoch_us(F.col("last_harvest")).alias("last_harvest_us"), "learning_count")


@query(
    "harvest_store",
    oracle=(
        "SELECT r.id, r.project_name, r.category, r.title, epoch_us(r.ts) AS ts_us, CAST(r.confidence AS DOUBLE) AS confidence "
        f"FROM ({RECORDS_SQL}) r JOIN ({_ACTIVE_SQL}) USING (project_name)"
    ),
)
def q_harvest_store(spark: SparkSession, data_dir: str) -> DataFrame:
    """The stored records after two harvests, the second from the first one's watermarks on."""
    store, _ = _stored_harvest(spark, data_dir)
    return store.read().select("id", "project_name", "category", "title", epoch_us(F.col("ts")).alias("ts_us"), "confidence")


@query(
    "apply_plan",
    oracle=(
        "SELECT id, category, title, '(dry run) ' || domain || '/' || title AS target_file, "
        f"'Would apply from ' || project_name AS description FROM ({RECORDS_SQL}) "
        "WHERE category IN ('kb_insight', 'agent_improvement', 'error_resolution', 'pattern_discovered')"
    ),
)
def q_apply_plan(spark: SparkSession, data_dir: str) -> DataFrame:
    return R.apply_plan(records(spark, data_dir))


@query(
    "apply_plan_confident",
    oracle=(
        "SELECT id, category, title, '(dry run) ' || domain || '/' || title AS target_file, "
        f"'Would apply from ' || project_name AS description FROM ({RECORDS_SQL}) "
        "WHERE category IN ('kb_insight', 'agent_improvement', 'error_resolution', 'pattern_discovered') AND confidence >= 0.7"
    ),
)
def q_apply_plan_confident(spark: SparkSession, data_dir: str) -> DataFrame:
    """The dry-run plan with a minimum confidence."""
    return R.apply_plan(records(spark, data_dir), min_confidence=0.7)


@query(
    "liveness_latest",
    oracle=(
        "SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_state, epoch_us(max(ts)) AS last_seen_us, "
        "epoch_us(TIMESTAMP '2024-01-30 12:00:00') - epoch_us(max(ts)) <= 21600000000 AS alive, "
        "list_contains(list(DISTINCT event_type) FILTER (WHERE value > 50), 'purchase') IS TRUE AS has_capability, "
        "(epoch_us(TIMESTAMP '2024-01-30 12:00:00') - epoch_us(max(ts)) <= 21600000000) "
        "AND arg_max(event_type, (ts, event_id)) = 'view' AS idle FROM events GROUP BY user_id"
    ),
)
def q_liveness_latest(spark: SparkSession, data_dir: str) -> DataFrame:
    """Latest heartbeat per agent (user), alive within a 6 h TTL, membership of a capability list, idle flag."""
    ev = load(spark, data_dir, "events")
    listed = ev.groupBy("user_id").agg(F.collect_set(F.when(F.col("value") > 50, F.col("event_type"))).alias("capabilities"))
    return R.liveness(ev, "user_id", "ts", "2024-01-30 12:00:00", 6 * 3600, "event_type", "purchase", "view",
                      tiebreak="event_id", capabilities=listed)


@query(
    "state_fold",
    oracle=(
        "SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_event_type, "
        "arg_max(value, (ts, event_id)) AS last_value, count(*) AS version FROM events GROUP BY user_id"
    ),
)
def q_state_fold(spark: SparkSession, data_dir: str) -> DataFrame:
    """Change log (events per user) folded into current state: last write per field, version."""
    ev = load(spark, data_dir, "events")
    return R.fold_changes(ev, "user_id", ["ts", "event_id"], ["event_type", "value"])


@query(
    "error_catalog",
    oracle=(
        "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_id, epoch_us(ts) AS ts_us, "
        "'user ' || CAST(user_id AS VARCHAR) || ': ' || props AS entry, "
        "count(*) OVER (PARTITION BY CAST(ts AS DATE)) AS day_entries FROM events WHERE event_type = 'error'"
    ),
)
def q_error_catalog(spark: SparkSession, data_dir: str) -> DataFrame:
    """Error entries per day, globally ordered by (day, ts); the per-day size comes from
    a partial aggregate, never from collecting a day into one task."""
    ev = load(spark, data_dir, "events").where(F.col("event_type") == "error")
    entries = ev.select(
        F.to_date("ts").cast("string").alias("day"),
        "event_id",
        epoch_us(F.col("ts")).alias("ts_us"),
        F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(": "), F.col("props")).alias("entry"),
    )
    sizes = entries.groupBy("day").agg(F.count(F.lit(1)).alias("day_entries"))
    return entries.join(sizes, "day").orderBy("day", "ts_us", "event_id")


@query(
    "error_catalog_domains",
    oracle=(
        "SELECT domain, id, row_number() OVER (PARTITION BY domain ORDER BY ts, id) AS entry_no, "
        "'### ' || title || chr(10) || chr(10) || substr(body, 1, 500) AS entry, "
        "count(*) OVER (PARTITION BY domain) AS domain_entries "
        f"FROM ({RECORDS_SQL}) WHERE category IN ('error_resolution', 'agent_improvement')"
    ),
)
def q_error_catalog_domains(spark: SparkSession, data_dir: str) -> DataFrame:
    """Catalog entries of each domain in order of time, numbered without one task for a domain."""
    recs = records(spark, data_dir).where(F.col("category").isin("error_resolution", "agent_improvement"))
    entry = F.concat(F.lit("### "), F.col("title"), F.lit("\n\n"), F.substring("body", 1, 500))
    return R.ordered_catalog(recs.select("domain", "ts", "id", entry.alias("entry")), "domain", ["ts", "id"]).select(
        "domain", "id", "entry_no", "entry", "domain_entries")


@query(
    "article_files",
    oracle=(
        "SELECT id, 'kb/' || domain || '/concepts/' || substr(regexp_replace(lower(title), '[ /]', '-', 'g'), 1, 40) || '.md' AS file "
        f"FROM ({RECORDS_SQL}) WHERE category = 'kb_insight'"
    ),
)
def q_article_files(spark: SparkSession, data_dir: str) -> DataFrame:
    """The article file that each insight goes to: its domain's folder, its title as a slug."""
    recs = records(spark, data_dir).where(F.col("category") == "kb_insight")
    return recs.select("id", F.concat(F.lit("kb/"), F.col("domain"), F.lit("/concepts/"), slug(F.col("title")), F.lit(".md")).alias("file"))


# ---------------------------------------------------------------- ledger


@query(
    "ledger_filter",
    oracle="SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderstatus = 'F'",
)
def q_ledger_filter(spark: SparkSession, data_dir: str) -> DataFrame:
    o = load(spark, data_dir, "orders")
    return L.by_status(o, "o_orderstatus", "F").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")


@query(
    "ledger_summary",
    oracle="SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS status_F, "
    "count(*) FILTER (WHERE o_orderstatus = 'O') AS status_O, count(*) FILTER (WHERE o_orderstatus = 'P') AS status_P "
    "FROM orders",
)
def q_ledger_summary(spark: SparkSession, data_dir: str) -> DataFrame:
    return L.status_summary(load(spark, data_dir, "orders"), "o_orderstatus", ["F", "O", "P"])


@query(
    "ledger_assign_ids",
    oracle=(
        "WITH ex AS (SELECT coalesce(max(o_orderkey), 0) AS mx FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'), "
        "nw AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn FROM orders "
        "WHERE o_orderdate >= TIMESTAMP '1998-01-01') "
        "SELECT o_orderkey, printf('ADR-%03d', mx + rn) AS new_id FROM nw, ex"
    ),
)
def q_ledger_assign_ids(spark: SparkSession, data_dir: str) -> DataFrame:
    """Orders before 1998 form the existing ledger (ids ADR-<orderkey>); later orders get
    the next consecutive ids in date order."""
    o = load(spark, data_dir, "orders")
    cutoff = F.lit("1998-01-01").cast("timestamp_ntz")
    existing = o.where(F.col("o_orderdate") < cutoff).select(F.format_string("ADR-%03d", F.col("o_orderkey")).alias("id"))
    batch = o.where(F.col("o_orderdate") >= cutoff).select("o_orderkey", "o_orderdate")
    out = L.assign_ids(batch, existing, "id", [F.col("o_orderdate"), F.col("o_orderkey")])
    return out.select("o_orderkey", "new_id")


# ---------------------------------------------------------------- scoring


def _evidence_exprs(k: str, hour: str) -> list[str]:
    return [
        "event_id AS id",
        "event_type || ' event for user ' || CAST(user_id AS STRING) AS description",
        "CASE event_type WHEN 'view' THEN 'run_query' WHEN 'click' THEN 'schema_change' WHEN 'purchase' "
        "THEN 'security_review' WHEN 'signup' THEN 'new_feature' ELSE 'refactor' END AS task_type",
        f"{k} >= 50 AS kb_found",
        "CASE WHEN value > 300 THEN 'disagrees' WHEN value > 30 THEN 'agrees' ELSE 'silent' END AS mcp_result",
        f"{hour} < 8 AS c_fresh",
        f"{hour} >= 20 AS c_stale",
        "event_type = 'error' AS c_breaking",
        f"{k} >= 70 AS c_prod",
        f"{k} < 20 AS c_noex",
        "value < 5 AS c_exact",
        "value >= 5 AND value < 10 AS c_tangential",
        "user_id < 50 AS c_multi",
        "true AS mcp_available",
        f"{k} >= 40 AS mcp_agrees",
        f"{k} >= 90 AS mcp_fresh",
        f"{k} >= 60 AND {k} < 70 AS mcp_prod",
        f"{k} < 5 AS mcp_breaking",
        "value > 1 AS web_found",
        "value > 100 AS web_prod",
    ]


def evidence(spark: SparkSession, data_dir: str) -> DataFrame:
    # props is parsed once per row; the flags read the parsed column.
    ev = load(spark, data_dir, "events").withColumns({"_k": F.expr(_K_SPARK), "_hour": F.hour("ts")})
    return ev.selectExpr(*_evidence_exprs("_k", "_hour"))


EVIDENCE_SQL = "SELECT " + ", ".join(_evidence_exprs(_K_DUCK, "hour(ts)")).replace("AS STRING", "AS VARCHAR") + " FROM events"


# The expected scores, written out by hand from the rules (nothing of the operator is used):
# one column for the score after every modifier, and a recursion over the research rounds.
_LABELLED_SQL = (
    f"e AS ({EVIDENCE_SQL}), "
    "c AS (SELECT *, lower(description || ' ' || task_type) AS words, "
    "CASE WHEN regexp_matches(words, 'security|auth|secret|credential|production_deploy|delete_data') THEN 'critical' "
    "WHEN regexp_matches(words, 'architecture|breaking_change|migration|schema_change|config_change') THEN 'important' "
    "WHEN regexp_matches(words, 'new_feature|refactor|pipeline|agent') THEN 'standard' ELSE 'advisory' END AS category FROM e), "
    "t AS (SELECT *, (CASE category WHEN 'critical' THEN 0.98 WHEN 'important' THEN 0.95 WHEN 'standard' THEN 0.90 ELSE 0.80 END)::DOUBLE AS threshold, "
    "CASE WHEN mcp_result = 'disagrees' THEN 'conflict' WHEN mcp_result = 'agrees' THEN if(kb_found, 'high', 'mcp_only') "
    "ELSE if(kb_found, 'medium', 'low') END AS agreement_level, "
    "(CASE agreement_level WHEN 'high' THEN 0.95 WHEN 'mcp_only' THEN 0.85 WHEN 'medium' THEN 0.75 ELSE 0.50 END)::DOUBLE AS base_score FROM c)"
)


def _scored_sql(base: str, fresh: str, stale: str, breaking: str, prod: str, noex: str, exact: str, tangential: str, multi: str, improved: str) -> str:
    """Columns s1 .. s9: the score after each modifier, kept between 0 and 1."""
    return (
        f"greatest(0, least(1, {base} + if({fresh}, 0.05::DOUBLE, 0))) AS s1, greatest(0, least(1, s1 - if({stale}, 0.05::DOUBLE, 0))) AS s2, "
        f"greatest(0, least(1, s2 - if({breaking}, 0.15::DOUBLE, 0))) AS s3, greatest(0, least(1, s3 + if({prod}, 0.05::DOUBLE, 0))) AS s4, "
        f"greatest(0, least(1, s4 - if({noex}, 0.05::DOUBLE, 0))) AS s5, greatest(0, least(1, s5 + if({exact}, 0.05::DOUBLE, 0))) AS s6, "
        f"greatest(0, least(1, s6 - if({tangential}, 0.05::DOUBLE, 0))) AS s7, greatest(0, least(1, s7 + if({multi}, 0.05::DOUBLE, 0))) AS s8, "
        f"greatest(0, least(1, s8 + if({improved}, 0.03::DOUBLE, 0))) AS s9"
    )


def _decided_sql(score: str, rounds: str) -> str:
    return (
        f"CASE WHEN {score} >= threshold THEN 'execute' "
        f"WHEN {rounds} < 3 AND (category IN ('standard', 'advisory') OR {score} >= threshold - 0.1::DOUBLE) THEN 'research' "
        "WHEN category = 'critical' THEN 'refuse' WHEN category = 'important' THEN 'ask_user' WHEN category = 'advisory' THEN 'disclaim' "
        f"WHEN {score} >= threshold - 0.1::DOUBLE THEN 'disclaim' ELSE 'ask_user' END"
    )


_SCORED_SQL = (
    f"WITH {_LABELLED_SQL}, s AS (SELECT *, "
    + _scored_sql("base_score", "c_fresh", "c_stale", "c_breaking", "c_prod", "c_noex", "c_exact", "c_tangential", "c_multi", "false")
    + f", round(s9, 4) AS final_score, {_decided_sql('final_score', '0')} AS decision FROM t) "
)


@query("score_records", oracle=_SCORED_SQL + "SELECT id, category, threshold, agreement_level, base_score, final_score FROM s")
def q_score_records(spark: SparkSession, data_dir: str) -> DataFrame:
    """Category, threshold, agreement level, base score and clamped modifier fold per evidence row."""
    return S.score(evidence(spark, data_dir)).select(
        "id", "category", "threshold", "agreement_level", "base_score", "final_score"
    )


@query("score_decisions", oracle=_SCORED_SQL + "SELECT id, final_score, decision FROM s")
def q_score_decisions(spark: SparkSession, data_dir: str) -> DataFrame:
    return S.score(evidence(spark, data_dir)).select("id", "final_score", "decision")


def _rounds_sql() -> str:
    # what a lookup in the knowledge base can tell, and a breaking change is not among it
    seen = "kb_found AND c_fresh AS fresh, kb_found AND c_stale AND NOT c_fresh AS stale, false AS breaking, kb_found AND c_prod AS prod, " \
        "kb_found AND c_noex AND NOT c_prod AS noex, kb_found AND c_exact AS exact, kb_found AND c_tangential AND NOT c_exact AS tangential, " \
        "kb_found AND c_multi AS multi, false AS improved"
    flags = "fresh, stale, breaking, prod, noex, exact, tangential, multi, improved"
    state = f"id, category, threshold, kb_found, mcp_available, mcp_agrees, mcp_fresh, mcp_prod, mcp_breaking, web_found, web_prod, {flags}"
    columns = "fresh stale breaking prod noex exact tangential multi improved".split()
    after = "(CASE WHEN told = 'agrees' THEN if(kb_found, 0.95, 0.85) WHEN told = 'disagrees' THEN 0.50 ELSE if(kb_found, 0.75, 0.50) END)::DOUBLE"
    return (
        f"WITH RECURSIVE {_LABELLED_SQL}, f AS (SELECT *, {seen} FROM t), "
        f"r(rounds, {state}, mcp_result, final_score, decision) AS ("
        f"SELECT 0, {state}, mcp_result, round(s9, 4) AS score, {_decided_sql('score', '0')} FROM (SELECT *, {_scored_sql('base_score', *columns)} FROM f) "
        "UNION ALL "
        f"SELECT n, {state}, told, round(s9, 4) AS score, {_decided_sql('score', 'n')} FROM (SELECT *, {_scored_sql(after, *columns)} FROM ("
        "SELECT rounds + 1 AS n, mcp_available AND mcp_result = 'silent' AS asked, web_found AND final_score < threshold - 0.05::DOUBLE AS web, "
        "id, category, threshold, kb_found, mcp_available, mcp_agrees, mcp_fresh, mcp_prod, mcp_breaking, web_found, web_prod, "
        "fresh OR (asked AND mcp_fresh) AS fresh, stale, breaking OR (asked AND mcp_breaking) AS breaking, "
        "prod OR (asked AND mcp_prod) OR (web AND web_prod) AS prod, noex, exact, tangential, multi, improved OR web AS improved, "
        "CASE WHEN asked THEN if(mcp_agrees, 'agrees', 'disagrees') ELSE r.mcp_result END AS told "
        "FROM r WHERE decision = 'research')) ) "
        "SELECT id, rounds, mcp_result, final_score, decision FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY rounds DESC) = 1"
    )


@query("score_rounds", oracle=_rounds_sql())
def q_score_rounds(spark: SparkSession, data_dir: str) -> DataFrame:
    """Up to 3 research rounds (second source, web evidence) as a fixed column recurrence."""
    out = S.score_with_research(evidence(spark, data_dir))
    return out.select("id", "rounds", F.col("mcp_result_r").alias("mcp_result"), "final_score", "decision")


@query(
    "rollback_target",
    oracle=(
        "SELECT id, category, title, ts_us FROM (SELECT id, category, title, epoch_us(ts) AS ts_us, "
        "row_number() OVER (ORDER BY ts DESC, id DESC) AS rn FROM (" + RECORDS_SQL + ") "
        "WHERE category IN ('kb_insight', 'agent_improvement', 'error_resolution', 'pattern_discovered')) "
        "WHERE rn = 1"
    ),
)
def q_rollback_target(spark: SparkSession, data_dir: str) -> DataFrame:
    """Latest applied change by timestamp (the default rollback target)."""
    recs = records(spark, data_dir).where(F.col("category").isin(*R.APPLIED_CATEGORIES))
    changes = recs.select("id", "category", "title", epoch_us(F.col("ts")).alias("ts_us"))
    return R.latest_change(changes, "ts_us", "id")
