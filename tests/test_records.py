"""Records, votes, ledger ids, scoring and drift."""

import datetime as dt

from pyspark.sql import functions as F

from strata.operators import ledger as L
from strata.operators import records as R
from strata.operators import scoring as S
from strata.operators.drift import manifest_diff
from strata.operators.joins import asof_latest
from strata.operators.voting import majority_vote

RES_SCHEMA = "result_id long, ts timestamp_ntz, task_type string, agent_type string, project_name string, " \
             "error string, rows int, table_name string"


def test_result_classification(spark):
    t = dt.datetime(2024, 1, 1)
    res = spark.createDataFrame(
        [
            (1, t, "run_query", "analytics", "p", "boom", None, None),
            (2, t, "run_query", "analytics", "p", None, 150, "t1"),
            (3, t, "unknown_type", "analytics", "p", None, None, None),
        ],
        RES_SCHEMA,
    )
    got = {r.id: (r.category, r.confidence, r.domain) for r in R.classify_results(res).collect()}
    assert got == {1: ("error_resolution", 0.3, "duckdb"), 2: ("pattern_discovered", 0.8, "duckdb")}


def _records(spark, rows):
    return spark.createDataFrame(rows, "id long, category string, confidence double, domain string, project_name string")


def test_high_value_rule_and_counts(spark):
    recs = _records(spark, [(1, "kb_insight", 0.8, "d", "p"), (2, "kb_insight", 0.8, "d", "p"),
                            (3, "kb_insight", 0.8, "d", "p"), (4, "error_resolution", 0.3, "d", "p")])
    assert R.high_value(recs).count() == 4
    axes = {(r.axis, r.key): r.n for r in R.counts_by_axes(recs).collect()}
    assert axes[("category", "kb_insight")] == 3 and axes[("category", "error_resolution")] == 1
    assert axes[("total", "all")] == 4


def test_harvest_skips_done_projects_and_respects_watermark(spark):
    t0, t1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 20)
    recs = spark.createDataFrame(
        [(1, t0, "a"), (2, t1, "a"), (3, t1, "b")], "id long, ts timestamp_ntz, project_name string"
    )
    registry = spark.createDataFrame(
        [("a", "active", dt.datetime(2024, 1, 10)), ("b", "done", None)],
        "project_name string, status string, last_harvest timestamp_ntz",
    )
    assert [r.id for r in R.harvest(recs, registry).collect()] == [2]


def test_upsert_keeps_latest_version(spark):
    old = spark.createDataFrame([(1, "a", 0.5, 1), (2, "a", 0.5, 1)], "id long, k string, c double, v int")
    new = spark.createDataFrame([(1, "a", 0.9, 2)], "id long, k string, c double, v int")
    got = {r.id: r.c for r in R.upsert_latest(old, new, ["id", "k"], "v").collect()}
    assert got == {1: 0.9, 2: 0.5}


def test_majority_vote_rules(spark):
    votes = spark.createDataFrame(
        [("i1", "A", 0.9), ("i1", "A", 0.9), ("i1", "B", 0.9),
         ("i2", "A", None), ("i2", "B", None),
         ("i3", None, 0.9), ("i3", None, 0.9), ("i3", "A", 0.9),
         ("i4", "A", 1.0)],
        "item string, vote string, conf double",
    )
    got = {r.item: r for r in majority_vote(votes, "item", "vote", "conf").collect()}
    assert got["i1"].majority_value == "A" and got["i1"].agreement_ratio == 0.667 and got["i1"].quorum_met
    assert got["i2"].majority_value is None and got["i2"].confidence == 0.5  # tie, missing confidence = 0.5
    assert got["i3"].majority_value is None  # NULL votes cannot win
    assert got["i4"].requires_approval  # fewer than 2 voters


def test_ledger_ids_continue_from_highest_suffix(spark):
    existing = spark.createDataFrame([("ADR-001",), ("ADR-007",), ("X-100",)], "id string")
    batch = spark.createDataFrame([(30,), (10,), (20,)], "k int")
    got = {r.k: r.new_id for r in L.assign_ids(batch, existing, "id", [F.col("k")]).collect()}
    assert got == {10: "ADR-008", 20: "ADR-009", 30: "ADR-010"}


def test_sequence_numbers_are_consecutive_across_partitions(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 3).alias("k"))
    got = sorted((r.k, r.seq) for r in L.sequence_numbers(df, [F.col("k")], start=1, partitions=5).collect())
    assert [s for _, s in got] == list(range(1, 1001))
    assert [k for k, _ in got] == [i * 3 for i in range(1000)]


def test_ledger_first_ids_and_summary(spark):
    empty = spark.createDataFrame([], "id string")
    batch = spark.createDataFrame([(1, "accepted"), (2, "proposed")], "k int, status string")
    got = sorted(r.new_id for r in L.assign_ids(batch, empty, "id", [F.col("k")]).collect())
    assert got == ["ADR-001", "ADR-002"]
    s = L.status_summary(batch, "status", ["accepted", "proposed"]).first()
    assert (s.total, s.status_accepted, s.status_proposed) == (2, 1, 1)


def _evidence(spark, rows):
    cols = ("id long, description string, task_type string, kb_found boolean, mcp_result string, "
            "c_fresh boolean, c_stale boolean, c_breaking boolean, c_prod boolean, c_noex boolean, "
            "c_exact boolean, c_tangential boolean, c_multi boolean")
    return spark.createDataFrame(rows, cols)


def test_scoring_matrix_modifiers_and_decisions(spark):
    f = False
    ev = _evidence(spark, [
        (1, "deploy auth service", "", True, "agrees", f, f, f, f, f, f, f, f),      # critical, high 0.95
        (2, "refactor module", "", True, "silent", True, f, f, True, f, f, f, f),   # standard, 0.75+0.05+0.05
        (3, "hello", "", False, "silent", f, f, True, f, f, f, f, f),               # advisory, low 0.5, breaking change -0.15
        (4, "migration plan", "", False, "disagrees", f, f, f, f, f, f, f, f),      # important, conflict 0.5
    ])
    got = {r.id: r for r in S.score(ev).collect()}
    assert (got[1].category, got[1].agreement_level, got[1].final_score, got[1].decision) == ("critical", "high", 0.95, "research")
    assert (got[2].category, got[2].final_score, got[2].decision) == ("standard", 0.85, "research")
    assert (got[3].category, got[3].final_score, got[3].decision) == ("advisory", 0.35, "research")
    assert (got[4].category, got[4].agreement_level, got[4].decision) == ("important", "conflict", "ask_user")


def test_modifier_clamp(spark):
    t = True
    ev = _evidence(spark, [(1, "x", "", True, "agrees", t, False, False, t, False, t, False, t)])
    # 0.95 + 0.05 clamps to 1.0 before the later modifiers apply
    assert S.score(ev).first().final_score == 1.0


def test_manifest_states(spark):
    t = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4"), ("e", "5")], "path string, sha256 string")
    s = spark.createDataFrame([("b", "2"), ("c", "0"), ("d", "4"), ("e", "0"), ("z", "9")], "path string, sha256 string")
    p = spark.createDataFrame([("b", "2"), ("c", "0"), ("d", "x"), ("e", "y")], "path string, sha256 string")
    got = {r.path: r.state for r in manifest_diff(t, s, p).collect()}
    assert got == {"a": "new", "b": "unchanged", "c": "updated", "d": "local_edit", "e": "conflict", "z": "removed"}


def test_asof_latest_across_buckets(spark):
    ts = dt.datetime
    left = spark.createDataFrame(
        [("u", ts(2024, 1, 3, 5), 100), ("u", ts(2024, 1, 1, 9), 101), ("v", ts(2024, 1, 1), 102)],
        "user string, ts timestamp_ntz, lid int")
    right = spark.createDataFrame(
        [("u", ts(2024, 1, 1, 8), 1), ("u", ts(2024, 1, 1, 10), 2), ("u", ts(2024, 1, 3, 5), 3)],
        "user string, ts timestamp_ntz, rid int")
    got = {r.lid: r.match for r in asof_latest(left, right, "user", "ts", "lid", "rid").collect()}
    assert got == {100: 3, 101: 1, 102: None}


def test_liveness_ttl_uses_total_seconds(spark):
    hb = spark.createDataFrame(
        [("a", dt.datetime(2024, 1, 1, 0, 0, 0), "idle"), ("b", dt.datetime(2023, 12, 31, 0, 0, 10), "busy")],
        "agent string, ts timestamp_ntz, state string")
    got = {r.agent: r.alive for r in R.liveness(hb, "agent", "ts", "2024-01-01 00:00:30", 30, "state", "busy", "idle").collect()}
    assert got == {"a": True, "b": False}


def test_latest_change_by_timestamp(spark):
    ch = spark.createDataFrame([("c9", 1), ("a1", 3), ("b2", 2)], "id string, ts long")
    assert R.latest_change(ch, "ts", "id").first().id == "a1"  # not the largest id


def test_slug():
    from strata.functions.text import slug
    from pyspark.sql import SparkSession

    s = SparkSession.getActiveSession()
    df = s.createDataFrame([("Use A/B Testing for " + "x" * 50,)], "t string")
    out = df.select(slug(F.col("t"))).first()[0]
    assert out.startswith("use-a-b-testing-for-") and len(out) == 40


def test_file_manifest_skips_ignored_folders(spark):
    import hashlib
    import os
    import tempfile

    from strata.sources.files import file_manifest, load_documents

    root = tempfile.mkdtemp(prefix="strata-tree-")
    kept = {"a.md": b"alpha", "sub/b.py": b"beta", ".env": b"e", "_posts/x y.md": b"\xffp", ".kb/c.md": b"k", "_config.yml": b"", "sub/uv.lock": b"l", ".gitlab-ci.yml": b"ci"}
    files = kept | {".git/c": b"x", "__pycache__/d.pyc": b"y", "sub/.venv/e.md": b"z", ".gitignore": b"i", "uv.lock": b"u", ".template-info.json": b"t"}
    for rel, data in files.items():
        os.makedirs(os.path.dirname(os.path.join(root, rel)), exist_ok=True)
        with open(os.path.join(root, rel), "wb") as f:
            f.write(data)
    got = {r.path.split(root)[-1].lstrip("/"): r.sha256 for r in file_manifest(spark, root).collect()}
    assert got == {rel: hashlib.sha256(data).hexdigest() for rel, data in kept.items()}
    docs = {r.path.split(root)[-1].lstrip("/"): r.text for r in load_documents(spark, root).collect()}
    assert docs == {"a.md": "alpha", "_posts/x y.md": "\ufffdp", ".kb/c.md": "k"}
    assert load_documents(spark, root + "/none").count() == 0


def test_ingest_passes_options_and_equal_stems_replace_in_order(spark):
    import os
    import tempfile

    from strata.catalog import Lake
    from strata.session import scratch_path
    from strata.sources.files import ingest_all, ingest_csv

    root = tempfile.mkdtemp(prefix="strata-land-")
    with open(os.path.join(root, "t.csv"), "w") as f:
        f.write('a,b\n1,"x\ny"\n2,z\n')
    lake = Lake(spark, scratch_path(spark, "lake"), prefix="stems")
    assert ingest_csv(lake, "lines", os.path.join(root, "t.csv"), multi_line=True, schema="a INT, b STRING") == 2
    with open(os.path.join(root, "t.json"), "w") as f:
        f.write('{"c": 5}\n')
    assert ingest_all(lake, root) == {"t": 1}
    assert lake.table("bronze", "t").columns == ["c"]


def _flagged_evidence(spark, **flags):
    row = {"id": 1, "description": "run", "task_type": "run_query", "kb_found": True, "mcp_result": "agrees", "mcp_available": False,
           "mcp_agrees": False, "mcp_fresh": False, "mcp_prod": False, "mcp_breaking": False, "web_found": False, "web_prod": False}
    row |= {c: False for c in ("c_fresh", "c_stale", "c_breaking", "c_prod", "c_noex", "c_exact", "c_tangential", "c_multi")}
    return spark.createDataFrame([row | flags])


def test_conditions_count_without_a_pattern(spark):
    from strata.operators.scoring import score

    assert score(_flagged_evidence(spark, kb_found=False, c_prod=True)).first()["final_score"] == 0.90


def test_lookup_pairs_exclude_each_other(spark):
    from strata.operators.scoring import score_with_research

    assert score_with_research(_flagged_evidence(spark, c_fresh=True, c_stale=True, c_breaking=True)).first()["final_score"] == 1.0
