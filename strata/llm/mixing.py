"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, the exponential of its source's multiplier. The
multipliers solve the convex dual of the entropy problem

    minimise  sum size * (rate log rate - rate + 1)
    so that   sum of size * rate over a source = the source's target

by Newton steps; every step is one aggregate over the (source, size) cells of
all documents. Rates are then rounded into copies: the whole part for every
document, and one more for those whose hash lies below a threshold. The
threshold of a source is found by sums over 4096 hash ranges, three times finer
each time, so the words taken miss the target by at most one document, and no
task ever holds a source's documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import discard, load, pick, save

WEIGHTS = (1, 2, 3)  #: of the sources in code point order, repeating
MOST = 3  #: times a source's size that its target may reach, and copies of a document
TOLERANCE, STEPS = 1e-9, 60
SOURCES = 100_000  #: rows of the plan that are sent to every task
_FINE = 12  #: bits of the hash that each round of the threshold search resolves
_ROUNDS = 3


def words_in(text) -> F.Column:
    """Number of words [^\\x20\\x09-\\x0D]+; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple = WEIGHTS, most: float = MOST) -> DataFrame:
    """(k, source, source_size, target) for (source, source_size): one row for each source.

    Sources share all words by weight; a target above ``most`` times its source's
    size stops there and the rest is shared again. That is one water level c:
    target = min(weight * c, most * size), found from running sums over the
    sources in the order in which they fill up.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sources.withColumn("k", F.row_number().over(by_name))
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.expr(f"cast(pmod(k - 1, {len(weights)}) + 1 AS int)")))
    s = s.withColumn("cap", F.col("source_size") * float(most))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "k")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    s = s.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # the level holds from the first source that it does not fill
    holds = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "k", "level"))
    s = s.withColumn("c", F.min(holds).over(everything)["level"])
    return s.select("k", "source", "source_size", F.least(F.col("weight") * F.coalesce("c", F.lit(0.0)), "cap").alias("target"))


def balance(cells: DataFrame, goal: DataFrame, tolerance: float = TOLERANCE, steps: int = STEPS) -> DataFrame:
    """(k, rate): Newton on the dual. ``cells`` is (k, size, n), ``goal`` (k, target).

    The dual is separable: for each k, sum n*size*exp(m) - target*m. A step is
    limited to 2, which keeps Newton's method convergent from m = 0. Where
    nothing can be taken or is wanted, the rate is 0.
    """
    m = save(goal.withColumn("m", F.lit(0.0)), "multipliers")
    for _ in range(steps):
        # gradient and curvature of the dual, from all cells
        sums = cells.join(m, "k").groupBy("k").agg(F.sum(F.col("n") * F.col("size") * F.exp("m")).alias("h"))
        step = F.greatest(F.least((F.col("target") - F.col("h")) / F.col("h"), F.lit(2.0)), F.lit(-2.0))
        moves = (F.col("h") > 0) & (F.col("target") > 0)
        nxt = m.join(sums, "k", "left").select("k", "target", F.when(moves, F.col("m") + step).otherwise(F.lit(float("-inf"))).alias("m"),
                                               F.when(moves, F.abs(F.col("target") - F.col("h")) / F.col("target")).otherwise(0.0).alias("off"))
        nxt = save(nxt, "multipliers")
        off = nxt.agg(F.max("off")).collect()[0][0]
        m = nxt.drop("off")
        if off is None or off < tolerance:
            break
    return m.select("k", F.coalesce(F.exp("m"), F.lit(0.0)).alias("rate"))


def _thresholds(rest: DataFrame, need: DataFrame) -> DataFrame:
    """(k, cut): documents with hash below ``cut`` come nearest to ``need`` words.

    ``rest`` is (k, u, size) with u of _FINE * _ROUNDS bits, ``need`` (k, need).
    """
    state = need.select("k", "need", F.lit(0).cast("long").alias("path"))
    for r in range(_ROUNDS):
        shift = _FINE * (_ROUNDS - 1 - r)
        inside = rest.join(state, "k").where(F.shiftright("u", shift + _FINE) == F.col("path"))
        hist = inside.groupBy("k", "need", F.shiftright("u", shift).alias("b")).agg(F.sum("size").alias("s"))
        run = Window.partitionBy("k").orderBy("b")  # at most 4096 rows of a source
        hist = hist.withColumn("upto", F.sum("s").over(run)).withColumn("before", F.col("upto") - F.col("s"))
        # the first range that reaches the need, or else the last of all
        whole = Window.partitionBy("k")
        hist = hist.withColumn("at", F.coalesce(F.min(F.when(F.col("upto") >= F.col("need"), F.col("b"))).over(whole), F.max("b").over(whole)))
        cross = hist.where("b = at").select("k", (F.col("need") - F.col("before")).alias("need"), F.col("b").alias("path"), "s")
        state = save(cross, "threshold")
    return state.select("k", (F.col("path") + (F.col("need") * 2 >= F.col("s")).cast("long")).alias("cut"))


def mix_plan(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """What decides every document's copies: (source, source_size, target, rate, base, cut), one row for each source."""
    d = pick(docs, id_col, text_col, source_col).toDF("doc_id", "text", "source")
    d = save(d.select("source", words_in(F.col("text")).alias("size"), "doc_id"), "sizes")
    goal = save(targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "targets")
    placed = with_plan(d.withColumn("u", draw(F.col("doc_id"), F.col("size"))), goal, "source").select("k", "u", "size")
    placed = save(placed, "placed")
    rates = balance(placed.groupBy("k", "size").agg(F.count(F.lit(1)).alias("n")), goal.select("k", "target"))
    rates = rates.withColumn("rate", F.least("rate", F.lit(float(most)))).withColumn("base", F.floor(F.col("rate") + 1e-6))
    rates = save(rates, "rates")
    need = goal.join(rates, "k").where("base < rate").select("k", (F.col("target") - F.col("base") * F.col("source_size")).alias("need")).where("need > 0")
    # documents without words follow the threshold but do not move it
    cuts = _thresholds(placed.where("size > 0").select("k", "u", "size"), need)
    plan = goal.join(rates, "k").join(cuts, "k", "left").select("source", "source_size", "target", "rate", "base", F.coalesce("cut", F.lit(0)).cast("long").alias("cut"))
    plan = save(plan, "plan")
    discard(d, goal, placed, rates)
    return plan


def draw(doc_id: Column, size: Column) -> Column:
    """The documents' chance: a hash of _FINE * _ROUNDS bits."""
    return F.shiftrightunsigned(F.xxhash64(doc_id, size), 64 - _FINE * _ROUNDS)


def with_plan(docs: DataFrame, plan: DataFrame, source_col: str) -> DataFrame:
    """Rows of docs beside their source's row of the plan.

    One row for each source: up to SOURCES of them go to every task, so that no
    source's documents meet in one; more are joined by shuffle.
    """
    plan = plan.withColumnRenamed("source", "_of")
    few = plan.count() <= SOURCES
    return docs.join(F.broadcast(plan) if few else plan, docs[source_col].eqNullSafe(plan["_of"])).drop("_of")


def copies(u: Column, most: int = MOST) -> Column:
    """Copies of a document with chance ``u``, beside its source's row of the plan."""
    more = (u < F.col("cut")) & (F.col("base") < most)
    return (F.col("base") + more.cast("long")).cast("int")


def mix_sources(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source") -> DataFrame:
    """Copies of every document so that sources come near their target sizes.

    Returns doc_id, source, size (words), source_size, target, taken (size * copies),
    copies and rate, one row for each row of ``docs``. Null or empty texts have
    size 0 and take 0 words; a null source is a source of its own, the last;
    repeated rows are documents of their own that get equal copies if they
    share id and size. An empty table gives no rows. Reruns agree: the only
    chance is a hash of doc_id and size.
    """
    plan = mix_plan(docs, weights, most, id_col, text_col, source_col)
    d = pick(docs, id_col, text_col, source_col).toDF("doc_id", "text", "source")
    d = with_plan(d.select("doc_id", "source", words_in(F.col("text")).alias("size")), plan, "source")
    d = d.withColumn("copies", copies(draw(F.col("doc_id"), F.col("size")), most))
    return d.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "rate")


def op8_source_mixing(spark, sf_dir: str) -> DataFrame:
    """All ``documents``, sources weighing 1, 2, 3, repeating."""
    return mix_sources(load(spark, sf_dir, "documents"))
