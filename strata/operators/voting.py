"""Majority vote with quorum, and top-k per group.

Votes are counted in two aggregates: (item, vote) counts, partially combined
on the map side, then per item. A hot item costs a handful of rows per map
task, never its whole vote list. Top-k per group is ``row_number() <= k``,
which Spark plans as a WindowGroupLimit on both sides of the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Default quorum, minimum voters, approval threshold and the
# confidence assumed for a vote that reports none.
DEFAULT_QUORUM = 0.6
MIN_VOTERS = 2
DEFAULT_APPROVAL_THRESHOLD = 0.95
MISSING_CONFIDENCE = 0.5


def majority_vote(
    votes: DataFrame,
    item: str,
    vote: str,
    confidence: str | None = None,
    quorum: float | None = None,
    threshold: float = DEFAULT_APPROVAL_THRESHOLD,
) -> DataFrame:
    """Per item: voters, majority value, agreement ratio, quorum flag, mean confidence.

    A NULL vote (failed voter) counts in the denominator but cannot win; ties
    go to the smallest value. Mean confidence is over non-NULL votes, with a
    missing confidence taken as 0.5. Fewer than 2 voters always needs approval.
    """
    q = quorum or DEFAULT_QUORUM
    conf = F.coalesce(F.col(confidence), F.lit(MISSING_CONFIDENCE)) if confidence else F.lit(MISSING_CONFIDENCE)
    per_vote = votes.groupBy(F.col(item).alias("item"), F.col(vote).alias("vote")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(conf.cast("double")).alias("conf_sum"),
    )
    # Highest count first, then the smallest value: min over (-n, vote).
    best = F.min(F.when(F.col("vote").isNotNull(), F.struct((-F.col("n")).alias("neg_n"), F.col("vote").alias("v"))))
    per_item = per_vote.groupBy("item").agg(
        F.sum("n").alias("voters"),
        best.alias("best"),
        F.sum(F.when(F.col("vote").isNotNull(), F.col("conf_sum"))).alias("conf_sum"),
        F.sum(F.when(F.col("vote").isNotNull(), F.col("n"))).alias("conf_n"),
    )
    ratio = F.coalesce(-F.col("best.neg_n"), F.lit(0)) / F.col("voters")
    avg_conf = F.coalesce(F.col("conf_sum"), F.lit(0.0)) / F.greatest(F.lit(1), F.coalesce(F.col("conf_n"), F.lit(0)))
    quorum_met = (ratio >= F.lit(q)) & (F.col("voters") >= MIN_VOTERS)
    return per_item.select(
        F.col("item").alias(item),
        F.col("voters"),
        F.when(quorum_met, F.col("best.v")).alias("majority_value"),
        F.round(ratio, 3).alias("agreement_ratio"),
        quorum_met.alias("quorum_met"),
        F.round(avg_conf, 4).alias("confidence"),
        ((~quorum_met) | (avg_conf < F.lit(threshold))).alias("requires_approval"),
    )


def top_k_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, rank_col: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group under ``order`` (groups with <= k rows keep all)."""
    w = Window.partitionBy(*[F.col(g) for g in group]).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)
