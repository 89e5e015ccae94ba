"""Batch confidence scoring: agreement lookup, ordered clamped modifiers,
decision rules and bounded research rounds, over a table of evidence rows.

The per-row logic is written once as SQL expression text (CASE / greatest /
least / round / contains), which Spark evaluates through ``F.expr`` - plain
Catalyst expressions inside whole-stage codegen - and which the DuckDB oracle
runs unchanged. The agreement matrix is a 6-row constant table joined by
broadcast (size fixed by the matrix, not by the data).

Evidence columns: id, description, task_type, kb_found (bool), mcp_result
('agrees' / 'disagrees' / anything else = silent) and condition flags
c_fresh, c_stale, c_breaking, c_prod, c_noex, c_exact, c_tangential, c_multi.
Research rounds also read mcp_available, mcp_agrees, mcp_fresh, mcp_prod,
mcp_breaking, web_found, web_prod.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators.corpus import CATEGORY_KEYWORDS, CATEGORY_DEFAULT

# Modifiers in application order (condition, delta).
MODIFIERS = [
    ("fresh_info_lt_1_month", 0.05),
    ("stale_info_gt_6_months", -0.05),
    ("breaking_change_known", -0.15),
    ("production_examples_exist", 0.05),
    ("no_examples_found", -0.05),
    ("exact_use_case_match", 0.05),
    ("tangential_match", -0.05),
    ("multiple_kb_sources_agree", 0.05),
    ("research_round_improved_score", 0.03),
]
# Agreement matrix rows (kb key, mcp key, level, base score).
AGREEMENT = [
    ("kb_has_pattern", "mcp_agrees", "high", 0.95),
    ("kb_has_pattern", "mcp_disagrees", "conflict", 0.50),
    ("kb_has_pattern", "mcp_silent", "medium", 0.75),
    ("kb_silent", "mcp_agrees", "mcp_only", 0.85),
    ("kb_silent", "mcp_disagrees", "conflict", 0.50),
    ("kb_silent", "mcp_silent", "low", 0.50),
]
# Category thresholds and the research-round bound.
THRESHOLDS = {"critical": 0.98, "important": 0.95, "standard": 0.90, "advisory": 0.80}
MAX_ROUNDS = 3

# Condition name -> evidence flag column for the initial (knowledge-base) pass.
KB_FLAGS = {
    "fresh_info_lt_1_month": "c_fresh",
    "stale_info_gt_6_months": "c_stale",
    "breaking_change_known": "c_breaking",
    "production_examples_exist": "c_prod",
    "no_examples_found": "c_noex",
    "exact_use_case_match": "c_exact",
    "tangential_match": "c_tangential",
    "multiple_kb_sources_agree": "c_multi",
}


def _d(x: float) -> str:
    """A double literal (an unsuffixed literal would be DECIMAL in both dialects)."""
    return f"CAST({x!r} AS DOUBLE)"


def category_sql(description: str, task_type: str) -> str:
    text = f"lower({description} || ' ' || {task_type})"
    parts = []
    for label, kws in CATEGORY_KEYWORDS:
        parts.append("WHEN " + " OR ".join(f"contains({text}, '{k}')" for k in kws) + f" THEN '{label}'")
    return f"CASE {' '.join(parts)} ELSE '{CATEGORY_DEFAULT}' END"


def threshold_sql(category: str) -> str:
    return "CASE " + " ".join(f"WHEN {category} = '{c}' THEN {_d(t)}" for c, t in THRESHOLDS.items()) + " END"


def mcp_key_sql(mcp: str) -> str:
    return f"CASE WHEN {mcp} = 'agrees' THEN 'mcp_agrees' WHEN {mcp} = 'disagrees' THEN 'mcp_disagrees' ELSE 'mcp_silent' END"


def kb_key_sql(kb: str) -> str:
    return f"CASE WHEN {kb} THEN 'kb_has_pattern' ELSE 'kb_silent' END"


def agreement_table_sql() -> str:
    rows = ", ".join(f"('{a}', '{b}', '{lvl}', {_d(base)})" for a, b, lvl, base in AGREEMENT)
    return f"(VALUES {rows}) AS agreement(kb_key, mcp_key, agreement_level, base_score)"


def fold_sql(base: str, flags: dict[str, str]) -> str:
    """Apply MODIFIERS in order; each active one moves the score and clamps to [0, 1]."""
    expr = base
    for cond, delta in MODIFIERS:
        flag = flags.get(cond)
        if flag is None:
            continue
        expr = f"greatest({_d(0.0)}, least({_d(1.0)}, {expr} + CASE WHEN {flag} THEN {_d(delta)} ELSE {_d(0.0)} END))"
    return f"round({expr}, 4)"


def decide_sql(score: str, threshold: str, category: str, rounds: str) -> str:
    return (
        f"CASE WHEN {score} >= {threshold} THEN 'execute' "
        f"WHEN {rounds} < {MAX_ROUNDS} AND {category} IN ('standard', 'advisory') THEN 'research' "
        f"WHEN {rounds} < {MAX_ROUNDS} AND {score} >= {threshold} - {_d(0.1)} THEN 'research' "
        f"WHEN {category} = 'critical' THEN 'refuse' "
        f"WHEN {category} = 'important' THEN 'ask_user' "
        f"WHEN {category} = 'standard' AND {score} >= {threshold} - {_d(0.1)} THEN 'disclaim' "
        f"WHEN {category} = 'standard' THEN 'ask_user' "
        "ELSE 'disclaim' END"
    )


def initial_flags() -> dict[str, str]:
    """Every active condition counts, whether or not the knowledge base had a pattern."""
    return dict(KB_FLAGS)


# The second of each pair counts only without the first.
_EXCLUSIVE = {"c_stale": "c_fresh", "c_noex": "c_prod", "c_tangential": "c_exact"}


def lookup_flags() -> dict[str, str]:
    """Conditions that the knowledge-base lookup before the research rounds can set."""
    out = {}
    for cond, col in KB_FLAGS.items():
        if col == "c_breaking":  # only a research round learns of a breaking change
            out[cond] = "false"
        elif col in _EXCLUSIVE:
            out[cond] = f"(kb_found AND {col} AND NOT {_EXCLUSIVE[col]})"
        else:
            out[cond] = f"(kb_found AND {col})"
    return out


# ---------------------------------------------------------------- Spark side


def _agreement_frame(spark) -> DataFrame:
    return spark.createDataFrame(AGREEMENT, "kb_key string, mcp_key string, agreement_level string, base_score double")


def score(evidence: DataFrame, flags: dict[str, str] | None = None) -> DataFrame:
    """Adds category, threshold, agreement_level, base_score, final_score, decision (round 0)."""
    spark = evidence.sparkSession
    keyed = evidence.withColumns(
        {
            "category": F.expr(category_sql("description", "task_type")),
            "kb_key": F.expr(kb_key_sql("kb_found")),
            "mcp_key": F.expr(mcp_key_sql("mcp_result")),
        }
    ).withColumn("threshold", F.expr(threshold_sql("category")))
    joined = keyed.join(F.broadcast(_agreement_frame(spark)), ["kb_key", "mcp_key"], "left").drop("kb_key", "mcp_key")
    scored = joined.withColumn("final_score", F.expr(fold_sql("base_score", flags or initial_flags())))
    return scored.withColumn("decision", F.expr(decide_sql("final_score", "threshold", "category", "0")))


def round_exprs(r: int) -> list[tuple[str, str]]:
    """Column updates of research round ``r`` (applied only when the last decision was research)."""
    go = "decision = 'research'"
    new_mcp = "CASE WHEN mcp_available AND mcp_result_r = 'silent' THEN CASE WHEN mcp_agrees THEN 'agrees' ELSE 'disagrees' END ELSE mcp_result_r END"
    asked = "(mcp_available AND mcp_result_r = 'silent')"
    web = f"(web_found AND final_score < threshold - {_d(0.05)})"
    return [
        ("f_fresh", f"f_fresh OR ({go} AND {asked} AND mcp_fresh)"),
        ("f_prod", f"f_prod OR ({go} AND {asked} AND mcp_prod) OR ({go} AND {web} AND web_prod)"),
        ("f_breaking", f"f_breaking OR ({go} AND {asked} AND mcp_breaking)"),
        ("f_improved", f"f_improved OR ({go} AND {web})"),
        ("rounds", f"CASE WHEN {go} THEN {r} ELSE rounds END"),
        ("mcp_result_r", f"CASE WHEN {go} THEN {new_mcp} ELSE mcp_result_r END"),
        ("_go", go),
    ]


def rescore_exprs() -> list[tuple[str, str]]:
    flags = {
        "fresh_info_lt_1_month": "f_fresh",
        "stale_info_gt_6_months": "f_stale",
        "breaking_change_known": "f_breaking",
        "production_examples_exist": "f_prod",
        "no_examples_found": "f_noex",
        "exact_use_case_match": "f_exact",
        "tangential_match": "f_tangential",
        "multiple_kb_sources_agree": "f_multi",
        "research_round_improved_score": "f_improved",
    }
    base = (
        "CASE " + " ".join(
            f"WHEN ({kb_key_sql('kb_found')}) = '{a}' AND ({mcp_key_sql('mcp_result_r')}) = '{b}' THEN {_d(base)}"
            for a, b, _l, base in AGREEMENT
        ) + " END"
    )
    return [
        ("final_score", f"CASE WHEN _go THEN {fold_sql(base, flags)} ELSE final_score END"),
        ("decision", f"CASE WHEN _go THEN {decide_sql('final_score', 'threshold', 'category', 'rounds')} ELSE decision END"),
    ]


def init_round_exprs() -> list[tuple[str, str]]:
    out = [(f"f_{KB_FLAGS[cond][2:]}", flag) for cond, flag in lookup_flags().items()]
    out += [("f_improved", "false"), ("rounds", "0"), ("mcp_result_r", "mcp_result")]
    return out


def score_with_research(evidence: DataFrame) -> DataFrame:
    """Round 0 score, then up to MAX_ROUNDS research rounds as a fixed column recurrence."""
    df = score(evidence, lookup_flags())
    df = df.withColumns({k: F.expr(v) for k, v in init_round_exprs()})
    for r in range(1, MAX_ROUNDS + 1):
        df = df.withColumns({k: F.expr(v) for k, v in round_exprs(r)})
        # decision must see the new score, so the two updates are applied in order
        for k, v in rescore_exprs():
            df = df.withColumn(k, F.expr(v))
    return df.drop("_go")
