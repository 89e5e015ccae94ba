"""Corpus, vector and manifest queries over documents / embeddings / benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.text import WHITESPACE_CLASS
from strata.operators import corpus as C
from strata.operators import vector_index as V
from strata.operators.drift import manifest_diff
from strata.operators.vector_search import cosine_top_k, lsh_top_k
from strata.plans.registry import load, query
from strata.plans.tables import union_sql
from strata.session import scratch_path
from strata.sources import files as src

CHUNK_SIZE, CHUNK_OVERLAP = 1000, 100

# ---------------------------------------------------------------- chunks

_CHUNKS_SQL = (
    "SELECT doc_id, source, CAST(s // 900 AS INTEGER) AS chunk_no, substr(text, s + 1, 1000) AS chunk, "
    "CAST(length(substr(text, s + 1, 1000)) AS INTEGER) AS chunk_len "
    "FROM documents, generate_series(0, length(text) - 1, 900) AS g(s) WHERE length(text) > 0"
)


def _chunks(spark: SparkSession, data_dir: str) -> DataFrame:
    docs = load(spark, data_dir, "documents")
    return C.chunk_documents(docs, "text", ["doc_id", "source"], CHUNK_SIZE, CHUNK_OVERLAP)


@query("chunk_documents", oracle=f"SELECT doc_id, chunk_no, chunk, chunk_len FROM ({_CHUNKS_SQL})")
def q_chunk_documents(spark: SparkSession, data_dir: str) -> DataFrame:
    """Overlapping 1000-character windows, step 900, tail always kept."""
    return _chunks(spark, data_dir).select("doc_id", "chunk_no", "chunk", "chunk_len")


@query(
    "chunk_index",
    oracle=(
        f"WITH c AS ({_CHUNKS_SQL}) "
        "SELECT substr(sha256(c.source || '|' || CAST(c.doc_id AS VARCHAR) || '|' || CAST(c.chunk_no AS VARCHAR)), 1, 16) "
        "AS chunk_id, c.source, c.doc_id, c.chunk_no, c.chunk_len, CAST(len(e.embedding) AS INTEGER) AS dim "
        "FROM c JOIN embeddings e ON e.vec_id = c.doc_id"
    ),
)
def q_chunk_index(spark: SparkSession, data_dir: str) -> DataFrame:
    """Chunks with their document's vector attached; chunks without one are skipped."""
    chunks = _chunks(spark, data_dir)
    emb = load(spark, data_dir, "embeddings")
    idx = C.chunk_index(chunks, emb, "doc_id", "vec_id", "embedding")
    return idx.select(
        C.chunk_id(F.col("source"), F.col("doc_id"), F.col("chunk_no")).alias("chunk_id"),
        "source", "doc_id", "chunk_no", "chunk_len", F.size("embedding").alias("dim"),
    )


# ---------------------------------------------------------------- vectors


def _topk_oracle(query_filter: str, k: int = 5) -> str:
    sim = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.qe AS DOUBLE[]))"
    return (
        f"WITH q AS (SELECT vec_id AS query_id, embedding AS qe FROM embeddings WHERE {query_filter}) "
        "SELECT query_id, vec_id, label, round(score, 4) AS score, rank FROM ("
        f"SELECT q.query_id, e.vec_id, e.label, {sim} AS score, "
        f"row_number() OVER (PARTITION BY q.query_id ORDER BY {sim} DESC, e.vec_id) AS rank "
        f"FROM embeddings e, q) WHERE rank <= {k}"
    )


def _topk(spark: SparkSession, data_dir: str, queries: DataFrame, k: int = 5) -> DataFrame:
    emb = load(spark, data_dir, "embeddings")
    res = cosine_top_k(emb, "vec_id", "embedding", queries, "vec_id", "embedding", k)
    return res.select("query_id", "vec_id", "label", F.round("score", 4).alias("score"), "rank")


@query("vector_topk", oracle=_topk_oracle("vec_id = 0"))
def q_vector_topk(spark: SparkSession, data_dir: str) -> DataFrame:
    """Exact cosine top-5 for one query vector (vec_id 0) over all embeddings."""
    emb = load(spark, data_dir, "embeddings")
    return _topk(spark, data_dir, emb.where(F.col("vec_id") == 0))


@query("vector_topk_batch", oracle=_topk_oracle("vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label)"))
def q_vector_topk_batch(spark: SparkSession, data_dir: str) -> DataFrame:
    """Exact cosine top-5 for a query set: the first vector of every label."""
    emb = load(spark, data_dir, "embeddings")
    firsts = emb.groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    return _topk(spark, data_dir, emb.join(firsts.select("vec_id"), "vec_id", "left_semi"))


@query("vector_topk_lsh")
def q_vector_topk_lsh(spark: SparkSession, data_dir: str) -> DataFrame:
    """LSH candidates (random projections on unit vectors) re-ranked exactly."""
    emb = load(spark, data_dir, "embeddings")
    qv = emb.where(F.col("vec_id") == 0).select("embedding").first()[0]
    return lsh_top_k(emb, "vec_id", "embedding", [float(x) for x in qv], k=5)


_INDEXES: dict[tuple, V.VectorIndex] = {}


def _index(spark: SparkSession, data_dir: str) -> V.VectorIndex:
    """The inverted-file index of all embeddings, built once per application and input."""
    key = (spark.sparkContext.applicationId, data_dir)
    if key not in _INDEXES:
        emb = load(spark, data_dir, "embeddings")
        _INDEXES[key] = V.build_index(emb, "vec_id", "embedding", scratch_path(spark, "vector-index"), carry=("label",))
    return _INDEXES[key]


@query("vector_topk_ivf", oracle=_topk_oracle("vec_id % 100 = 0"))
def q_vector_topk_ivf(spark: SparkSession, data_dir: str) -> DataFrame:
    """Cosine top-5 of every hundredth vector from the cells that can hold them; exact by the cells' bounds."""
    queries = load(spark, data_dir, "embeddings").where("vec_id % 100 = 0")
    out = V.search(_index(spark, data_dir), queries, "vec_id", "embedding", 5, exact=True, carry=("label",))
    return out.select("query_id", "vec_id", "label", F.round("score", 4).alias("score"), "rank")


@query("vector_ivf_one", oracle=_topk_oracle("vec_id = 0", k=1))
def q_vector_ivf_one(spark: SparkSession, data_dir: str) -> DataFrame:
    """The nearest vector to vec_id 0, from one cell's folder only (the vector's own)."""
    queries = load(spark, data_dir, "embeddings").where("vec_id = 0")
    out = V.search(_index(spark, data_dir), queries, "vec_id", "embedding", 1, probes=1, carry=("label",))
    return out.select("query_id", "vec_id", "label", F.round("score", 4).alias("score"), "rank")


@query(
    "vector_ivf_recall",
    oracle="SELECT count(*) AS queries, 5 * count(*) AS wanted, true AS recall_ok FROM embeddings WHERE vec_id % 20 = 0",
)
def q_vector_ivf_recall(spark: SparkSession, data_dir: str) -> DataFrame:
    """Share of the exact top-5 that the index finds from 60 % of its cells, for every twentieth vector.

    The given vectors have no clusters; with clusters a few cells do (see the tests).
    """
    emb = load(spark, data_dir, "embeddings")
    queries, index = emb.where("vec_id % 20 = 0"), _index(spark, data_dir)
    found = V.search(index, queries, "vec_id", "embedding", 5, probes=-(-len(index.centres) * 6 // 10))
    exact = cosine_top_k(emb, "vec_id", "embedding", queries, "vec_id", "embedding", 5)
    both = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(True).alias("hit")), ["query_id", "vec_id"], "left")
    return both.agg(F.count_distinct("query_id").alias("queries"), F.count(F.lit(1)).alias("wanted"), (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("recall_ok"))


# ---------------------------------------------------------------- rule scans

# Rule-table rows with markers that occur in the corpus (alongside the review rules).
CORPUS_MARKER_RULES = [
    C.TextRule("token_marker", "warning", "Token-like marker", "contains", "token"),
    C.TextRule("email_address", "error", "Personal e-mail address", "regex",
               r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", hint="@"),
    C.TextRule("license_line", "info", "License text", "contains", "License"),
]
SCAN_RULES = C.REVIEW_RULES + CORPUS_MARKER_RULES


def _rule_sql(r: C.TextRule, t: str = "text") -> str:
    lo = f"lower({t})"
    builtin = {
        "print_without_logging": f"contains({t}, 'print(') AND NOT contains({t}, 'import logging')",
        "hardcoded_secret": f"(contains({lo}, 'password') OR contains({lo}, 'secret'))",
        "api_key_without_env": f"contains({lo}, 'api_key') AND NOT contains({t}, 'os.environ') AND NOT contains({t}, 'os.getenv')",
        "bare_except": f"contains({t}, 'except:')",
        "eval_exec": f"(contains({t}, 'eval(') OR contains({t}, 'exec('))",
        "wildcard_import": f"contains({t}, 'import *')",
    }
    for h in C.HARDCODED_HOSTS:
        builtin[f"hardcoded_host_{h}"] = f"contains({t}, '{h}') AND NOT contains({t}, 'HOST') AND NOT contains({lo}, 'config')"
    if r.kind == "builtin":
        return f"({builtin[r.name]})"
    if r.kind == "contains":
        return f"contains({t}, '{r.pattern}')"
    if r.kind == "contains_ci":
        return f"contains({lo}, '{r.pattern.lower()}')"
    return f"regexp_matches({t}, '{r.pattern}')"


@query(
    "corpus_scan",
    oracle=union_sql(
        [
            f"SELECT '{r.name}' AS rule, '{r.severity}' AS severity, count(*) FILTER (WHERE {_rule_sql(r)}) AS docs_hit "
            "FROM documents"
            for r in SCAN_RULES
        ]
    ),
)
def q_corpus_scan(spark: SparkSession, data_dir: str) -> DataFrame:
    """Documents hit per rule (review rules + corpus markers), every rule listed."""
    return C.scan_rule_counts(load(spark, data_dir, "documents"), "text", SCAN_RULES)


def _count_sql(sev: str) -> str:
    terms = [f"CAST({_rule_sql(r)} AS INTEGER)" for r in SCAN_RULES if r.severity == sev]
    return " + ".join(terms) if terms else "0"


@query(
    "corpus_scan_summary",
    oracle=(
        f"SELECT doc_id, {_count_sql('error')} AS errors, {_count_sql('warning')} AS warnings, "
        f"{_count_sql('info')} AS infos, {_count_sql('error')} + {_count_sql('warning')} + {_count_sql('info')} "
        f"AS total_issues, ({_count_sql('error')}) = 0 AS passed FROM documents"
    ),
)
def q_corpus_scan_summary(spark: SparkSession, data_dir: str) -> DataFrame:
    """Errors / warnings / infos per document and its pass flag."""
    return C.scan_summary(load(spark, data_dir, "documents"), "doc_id", "text", SCAN_RULES)


_FILES_SQL = (
    "SELECT 'repo/' || CASE WHEN source = 'src0' THEN '.venv/' WHEN source = 'src3' THEN '__pycache__/' ELSE '' END "
    "|| source || '/doc_' || CAST(doc_id AS VARCHAR) || CASE "
    "WHEN lang = 'en' THEN '.py' WHEN lang = 'de' AND source = 'src1' THEN '.example.env' "
    "WHEN lang = 'de' THEN '.env' WHEN lang = 'es' THEN '.json' ELSE '.md' END AS path, text AS content FROM documents"
)


def _virtual_files(spark: SparkSession, data_dir: str) -> DataFrame:
    d = load(spark, data_dir, "documents")
    folder = F.when(F.col("source") == "src0", ".venv/").when(F.col("source") == "src3", "__pycache__/").otherwise("")
    ext = (
        F.when(F.col("lang") == "en", ".py")
        .when((F.col("lang") == "de") & (F.col("source") == "src1"), ".example.env")
        .when(F.col("lang") == "de", ".env")
        .when(F.col("lang") == "es", ".json")
        .otherwise(".md")
    )
    path = F.concat(F.lit("repo/"), folder, F.col("source"), F.lit("/doc_"), F.col("doc_id").cast("string"), ext)
    return d.select(path.alias("path"), F.col("text").alias("content"))


def _secret_oracle() -> str:
    name = "regexp_extract(path, '[^/]*$')"
    keep = " AND ".join(f"NOT contains(regexp_extract(path, '^(.*)/', 1), '{d}')" for d in C.AUDIT_SKIP)
    suffix = " OR ".join(f"ends_with({name}, '{s}')" for s in C.AUDIT_SUFFIXES)
    return (
        f"WITH f AS ({_FILES_SQL}), k AS (SELECT * FROM f WHERE {keep} AND ({suffix})) "
        "SELECT path, 'error' AS severity, 'Possible hardcoded password' AS message FROM k "
        "WHERE contains(lower(content), 'password') AND NOT contains(content, 'os.environ') AND NOT contains(content, 'os.getenv') "
        f"UNION ALL SELECT path, 'warning', '.env file tracked in repo' FROM k "
        f"WHERE contains({name}, '.env') AND NOT contains(lower({name}), 'example')"
    )


@query("secret_audit", oracle=_secret_oracle())
def q_secret_audit(spark: SparkSession, data_dir: str) -> DataFrame:
    """Secret audit over a tree of real files (one per document, paths by source and language), hidden ones too."""
    root = _once(spark, "audit", data_dir, lambda: _virtual_files(spark, data_dir).select(F.col("path").alias("rel"), F.col("content").cast("binary").alias("content")))
    files = src.read_files(src.list_tree(spark, root))
    return C.secret_audit(files.select(F.col("rel").alias("path"), F.expr("make_valid_utf8(CAST(content AS STRING))").alias("content")))


# ---------------------------------------------------------------- rubric / classes


def _occ_sql(lit: str) -> str:
    return f"CAST((length(text) - length(replace(text, '{lit}', ''))) // {len(lit)} AS INTEGER)"


_DESIGN_SQL = (
    "(contains(lower(text), 'file manifest') AND contains(lower(text), 'adr') AND contains(lower(text), 'schema') AND contains(lower(text), 'flow'))"
)
_DEFINE_SQL = " + ".join(f"CASE WHEN contains(lower(text), '{c}') THEN 3 ELSE 0 END" for c in C.DEFINE_CRITERIA)


@query(
    "rubric_score",
    oracle=(
        f"SELECT doc_id, {_occ_sql('## Approach')} AS approach_sections, "
        f"({_occ_sql('## Approach')} >= 3 AND {_occ_sql('## Question')} >= 3 AND contains(lower(text), 'out of scope') "
        "AND (contains(lower(text), 'success') OR contains(lower(text), 'criteria'))) AS brainstorm_passed, "
        f"CAST({_DEFINE_SQL} AS INTEGER) AS define_score, ({_DEFINE_SQL}) >= 12 AS define_passed, "
        f"{_DESIGN_SQL} AS design_passed FROM documents"
    ),
)
def q_rubric_score(spark: SparkSession, data_dir: str) -> DataFrame:
    """Document gates: section counts, required phrases (3 points each, pass >= 12)."""
    return C.rubric(load(spark, data_dir, "documents"), "doc_id", "text")


@query(
    "rubric_total",
    oracle=(
        f"SELECT doc_id, CAST(CASE WHEN {_DESIGN_SQL} THEN 30 ELSE 0 END + CASE WHEN ({_count_sql('error')}) = 0 "
        f"THEN 70 ELSE 0 END AS INTEGER) AS score, "
        f"(CASE WHEN {_DESIGN_SQL} THEN 30 ELSE 0 END + CASE WHEN ({_count_sql('error')}) = 0 THEN 70 ELSE 0 END) >= 90 "
        "AS passed FROM documents"
    ),
)
def q_rubric_total(spark: SparkSession, data_dir: str) -> DataFrame:
    """Weighted gate total: design gate 30 + no error findings 70, pass >= 90."""
    docs = load(spark, data_dir, "documents").select("doc_id", "text")
    flagged = C.with_rule_flags(docs, "text", SCAN_RULES)
    design = C.rubric_columns(F.col("text"))["design_passed"]
    score, passed = C.rubric_total(design, C.severity_count(SCAN_RULES, "error") == 0)
    return flagged.select("doc_id", score.alias("score"), passed.alias("passed"))


def _first_match_sql(table, default) -> str:
    parts = []
    for label, kws in table:
        cond = " OR ".join(f"contains(lower(text), '{k}')" for k in kws)
        parts.append(f"WHEN {cond} THEN '{label}'")
    return f"CASE {' '.join(parts)} ELSE '{default}' END"


@query(
    "keyword_classify",
    oracle=(
        f"SELECT doc_id, {_first_match_sql(C.CATEGORY_KEYWORDS, C.CATEGORY_DEFAULT)} AS category, "
        f"{_first_match_sql(C.PATTERN_KEYWORDS, C.PATTERN_DEFAULT)} AS pattern, "
        f"{_first_match_sql(C.DOMAIN_KEYWORDS, C.DOMAIN_DEFAULT)} AS domain "
        "FROM documents"
    ),
)
def q_keyword_classify(spark: SparkSession, data_dir: str) -> DataFrame:
    """Category / workflow pattern / domain by first keyword match on the lower-cased text."""
    return C.classify_frame(load(spark, data_dir, "documents"), "doc_id", "text")


def _whole_word_sql(table: list, default: str) -> str:
    cases = " ".join(f"WHEN regexp_matches(lower(text), '(^|[^a-z0-9_])({'|'.join(kws)})([^a-z0-9_]|$)') THEN '{label}'" for label, kws in table)
    return f"CASE {cases} ELSE '{default}' END"


@query(
    "keyword_classify_words",
    oracle=(
        f"SELECT doc_id, {_whole_word_sql(C.CATEGORY_KEYWORDS, C.CATEGORY_DEFAULT)} AS category, "
        f"{_whole_word_sql(C.PATTERN_KEYWORDS, C.PATTERN_DEFAULT)} AS pattern, {_whole_word_sql(C.DOMAIN_KEYWORDS, C.DOMAIN_DEFAULT)} AS domain FROM documents"
    ),
)
def q_keyword_classify_words(spark: SparkSession, data_dir: str) -> DataFrame:
    """The same classes, keywords counting as whole words only."""
    return C.classify_frame(load(spark, data_dir, "documents"), "doc_id", "text", whole_words=True)


def _words_sql(key: str, table: str) -> str:
    return (
        f"SELECT DISTINCT {key}, w AS word FROM (SELECT {key}, "
        f"unnest(regexp_split_to_array(lower(text), '{WHITESPACE_CLASS}')) AS w FROM {table}) WHERE w <> ''"
    )


@query(
    "token_overlap",
    oracle=(
        f"WITH iw AS ({_words_sql('item_id', 'benchmark')}), dw AS ({_words_sql('source', 'documents')}) "
        "SELECT item_id, source, count(*) AS overlap FROM iw JOIN dw USING (word) "
        "GROUP BY item_id, source HAVING count(*) >= 3"
    ),
)
def q_token_overlap(spark: SparkSession, data_dir: str) -> DataFrame:
    """Benchmark items against per-source word indexes: hits share more than 2 distinct words."""
    return C.word_overlap(
        load(spark, data_dir, "benchmark"), "item_id", "text",
        load(spark, data_dir, "documents"), "source", "text",
        min_overlap=3,
    )


@query(
    "token_overlap_pairs",
    oracle=(
        f"WITH iw AS ({_words_sql('item_id', 'benchmark')}), dw AS ({_words_sql('doc_id', 'documents')}), "
        "m AS (SELECT item_id, count(*) AS item_words FROM iw GROUP BY item_id) "
        "SELECT item_id, doc_id, count(*) AS overlap, item_words FROM iw JOIN dw USING (word) JOIN m USING (item_id) "
        "GROUP BY item_id, doc_id, item_words HAVING count(*) >= greatest(3, ceil(item_words * 0.5))"
    ),
)
def q_token_overlap_pairs(spark: SparkSession, data_dir: str) -> DataFrame:
    """Benchmark items and the documents that share at least half of their distinct words."""
    return C.word_overlap_pairs(
        load(spark, data_dir, "benchmark"), "item_id", "text",
        load(spark, data_dir, "documents"), "doc_id", "text", share=0.5,
    )


# ---------------------------------------------------------------- files / manifests


_TREES: dict[tuple, str] = {}


def _once(spark: SparkSession, tag: str, data_dir: str, files) -> str:
    """A file tree, written once per application and input; ``files`` gives its (rel, content)."""
    key = (spark.sparkContext.applicationId, tag, data_dir)
    if key not in _TREES or not src.path_exists(spark, _TREES[key]):
        root = scratch_path(spark, tag)
        src.write_tree(files(), root)
        _TREES[key] = root
    return _TREES[key]


def _corpus_tree(spark: SparkSession, data_dir: str) -> str:
    """One text file per document in a folder for each source, copies of one source in folders that are skipped."""

    def files() -> DataFrame:
        docs = load(spark, data_dir, "documents")
        folder = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
        decoy = F.when(F.col("source") == "src0", F.array(F.lit(""), F.lit(".venv/"), F.lit("__pycache__/"))).otherwise(F.array(F.lit("")))
        content = F.concat(F.col("text"), F.lit("\n")).cast("binary")
        return docs.select(F.explode(decoy).alias("top"), folder.alias("rel"), content.alias("content")).select(F.concat("top", "rel").alias("rel"), "content")

    return _once(spark, "corpus", data_dir, files)


@query(
    "load_corpus",
    oracle="SELECT doc_id, CAST(length(text) AS INTEGER) AS n_chars, sha256(text) AS sha256 FROM documents",
)
def q_load_corpus(spark: SparkSession, data_dir: str) -> DataFrame:
    """Documents written as one text file each (plus some copies under skipped folders), loaded back."""
    loaded = src.load_documents(spark, _corpus_tree(spark, data_dir), "*.txt")
    text = src.strip_final_newline(F.col("text"))
    return loaded.select(
        F.regexp_extract("path", r"/([0-9]+)\.txt$", 1).cast("bigint").alias("doc_id"),
        F.length(text).alias("n_chars"),
        F.sha2(text, 256).alias("sha256"),
    )


_MPATH = "source || '/' || CAST(doc_id AS VARCHAR)"


@query(
    "content_manifest",
    oracle=f"SELECT {_MPATH} || '.' || lang || '.md' AS path, sha256(text) AS sha256 FROM documents",
)
def q_content_manifest(spark: SparkSession, data_dir: str) -> DataFrame:
    d = load(spark, data_dir, "documents")
    path = F.concat_ws("", F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang"), F.lit(".md"))
    return src.text_manifest(d.select(path.alias("path"), "text"), "path", "text")


def _drift_inputs(spark: SparkSession, data_dir: str):
    d = load(spark, data_dir, "documents")
    path = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    h = F.sha2(F.col("text"), 256)
    h_v0 = F.sha2(F.concat(F.col("text"), F.lit("v0")), 256)
    template = d.select(path.alias("path"), h.alias("sha256"))
    stored_h = F.when(F.col("lang") == "de", h_v0).otherwise(h)
    stored = d.where(F.col("lang") != "es").select(path.alias("path"), stored_h.alias("sha256")).unionByName(
        d.where(F.col("lang") == "fr").select(F.concat(path, F.lit(".bak")).alias("path"), h.alias("sha256"))
    )
    proj_h = F.when(F.col("source").isin("src1", "src2"), F.sha2(F.concat(F.col("text"), F.lit(" local")), 256)).otherwise(
        stored_h
    )
    project = d.where(F.col("lang") != "es").select(path.alias("path"), proj_h.alias("sha256"))
    return template, stored, project


@query(
    "manifest_diff",
    oracle=(
        f"WITH t AS (SELECT {_MPATH} || '.md' AS path, sha256(text) AS ht FROM documents), "
        f"s AS (SELECT {_MPATH} || '.md' AS path, CASE WHEN lang = 'de' THEN sha256(text || 'v0') ELSE sha256(text) END AS hs "
        f"FROM documents WHERE lang <> 'es' UNION ALL SELECT {_MPATH} || '.md.bak', sha256(text) FROM documents WHERE lang = 'fr'), "
        f"p AS (SELECT {_MPATH} || '.md' AS path, CASE WHEN source IN ('src1', 'src2') THEN sha256(text || ' local') "
        "WHEN lang = 'de' THEN sha256(text || 'v0') ELSE sha256(text) END AS hp FROM documents WHERE lang <> 'es'), "
        "j AS (SELECT coalesce(t.path, s.path, p.path) AS path, ht, hs, hp FROM t FULL OUTER JOIN s ON t.path = s.path "
        "FULL OUTER JOIN p ON coalesce(t.path, s.path) = p.path), "
        "r AS (SELECT path, CASE WHEN ht IS NOT NULL AND hp IS NULL THEN 'new' "
        "WHEN ht IS NULL AND hs IS NOT NULL THEN 'removed' "
        "WHEN ht IS NOT NULL AND hp = hs AND ht = hs THEN 'unchanged' "
        "WHEN ht IS NOT NULL AND hp = hs THEN 'updated' "
        "WHEN ht IS NOT NULL AND ht = hs THEN 'local_edit' "
        "WHEN ht IS NOT NULL THEN 'conflict' END AS state FROM j) "
        "SELECT path, state FROM r WHERE state IS NOT NULL"
    ),
)
def q_manifest_diff(spark: SparkSession, data_dir: str) -> DataFrame:
    """Template / stored / project manifests derived from documents, classified per path."""
    return manifest_diff(*_drift_inputs(spark, data_dir))


@query(
    "file_manifest",
    oracle="SELECT doc_id, sha256(text || chr(10)) AS sha256 FROM documents",
)
def q_file_manifest(spark: SparkSession, data_dir: str) -> DataFrame:
    """sha256 of every file of the document tree (binary content, skipped folders
    ignored); each file holds the text plus the sink's final newline."""
    man = src.file_manifest(spark, _corpus_tree(spark, data_dir), "*.txt")
    return man.select(F.regexp_extract("path", r"/([0-9]+)\.txt$", 1).cast("bigint").alias("doc_id"), "sha256")
