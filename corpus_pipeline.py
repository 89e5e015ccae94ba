"""Corpus pipeline: language, near duplicates, secrets, mixing, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written and read again as the next stage's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import load, owner, pick, release, save
from strata.llm.jaccard_join import near_duplicate_texts
from strata.llm.language import UNKNOWN, identify
from strata.llm.mixing import copies, draw, mix_plan, with_plan, words_in
from strata.llm.pieces import encode_texts
from strata.llm.secrets import mask_secrets
from strata.llm.slots import rows_of, stage_texts

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MIN_SCORE = 0.3  #: mean probability of the predicted language below which a document goes


def stage(run):
    """A stage deletes what earlier ones wrote below the shared folder and its ``docs`` does not read.

    One pipeline runs at a time in a session; its stages follow each other.
    """

    @functools.wraps(run)
    def staged_run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release("pipeline", docs)
        with owner("pipeline"):
            return run(spark, docs, sf_dir)

    return staged_run


@stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without a letter or with no likely language go.

    A missing lang becomes the predicted one.
    """
    out = identify(docs, keep=("lang", "source", "n_chars"), with_text=True)
    out = out.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MIN_SCORE))
    return out.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of each group of texts; rows without doc_id stay.

    Every row is judged by its own text, also where others share its doc_id. Of
    rows with one doc_id the first by text, lang, source and n_chars stays; texts
    without words group with equal rows of their doc_id only.
    """
    d = pick(docs, *COLUMNS)
    rest = d.where("doc_id IS NULL")
    rows = d.where("doc_id IS NOT NULL").withColumn("doc_id", F.col("doc_id").cast("long"))
    wordless = F.col("text").isNull() | ~F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    if rows.groupBy("doc_id").count().where("count > 1").limit(1).count():
        return _near_duplicates_of_repeated_ids(rows, wordless).unionByName(rest)
    staged, buckets = stage_texts(rows)
    judged = save(near_duplicate_texts(rows, staged=(staged, buckets)), "groups")
    kept = judged.where("n_shingles > 0 AND doc_id = component_id").select("doc_id")
    kept = save(staged.select("slot", "doc_id").join(kept, "doc_id").select("slot", "doc_id"), "kept")
    # the smallest id of a group is the first of the equal texts in its slot, which has the text
    return rows_of(staged, kept, COLUMNS).unionByName(rows.where(wordless)).unionByName(rest)


def _near_duplicates_of_repeated_ids(rows: DataFrame, wordless) -> DataFrame:
    """As near_duplicates, where different rows share a doc_id: they are numbered first."""
    rows = save(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    judged = save(near_duplicate_texts(rows, id_col="row").toDF("row", "n_shingles", "group"), "groups")
    least = rows.select("row", "doc_id").join(judged.where("n_shingles > 0"), "row").select("row", "doc_id", "group")
    least = save(least.join(least.groupBy("group").agg(F.min("doc_id").alias("doc_id")), ["group", "doc_id"]), "least")
    sized = least.groupBy("group").agg(F.count(F.lit(1)).alias("size"), F.min("row").alias("row"))
    kept = sized.where("size = 1").select("row")
    ties = sized.where("size > 1").select("group")
    if ties.limit(1).count():  # rows of one group and one doc_id: the first by text
        order = F.struct("text", "lang", "source", "n_chars", "row")
        kept = kept.unionByName(rows.join(least.join(ties, "group").select("row", "group"), "row").groupBy("group").agg(F.min(order).alias("x")).select("x.row"))
    blank = rows.where(wordless).join(judged.where("n_shingles = 0").select("row"), "row")
    blank = blank.groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars", "row")).alias("x")).select("x.row")
    kept = save(kept.unionByName(blank), "kept")
    return rows.join(kept, "row").select(*COLUMNS)


@stage
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked; n_chars follows the text."""
    out = mask_secrets(docs, keep=("doc_id", "lang", "source", "n_chars"))
    return out.withColumn("n_chars", F.when(F.col("n_secrets") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


@stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; its copies follow from its source's row of the plan."""
    d = pick(docs, *COLUMNS)
    d = with_plan(d.withColumn("size", words_in(F.col("text"))), mix_plan(d), "source")
    d = d.withColumn("copies", copies(draw(F.col("doc_id"), F.col("size")))).where("copies > 0")
    return d.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


@stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    out = encode_texts(docs, keep=("doc_id", "lang", "source"))
    return out.withColumn("n_tokens", F.size("ids"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("tokens", tokens)]
ORACLE_SQL = None  # the stages are models, hashes and a tokenizer: tested stage by stage


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, run_stage in STAGES:
        docs = run_stage(spark, docs, sf_dir)
        with owner("pipeline"):
            docs = save(docs, f"stage-{name}")
    return docs
