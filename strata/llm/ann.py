"""Approximate nearest neighbours by shifted Hilbert curve orderings.

Every vector is projected onto a few random directions, shifted and put in
order along a Hilbert curve, several times over with other directions and
shifts. Rows are range-partitioned by (ordering, key), numbered, and cut into
blocks. A query meets the blocks that its window of neighbouring positions
touches, scores the vectors of the window there in double precision, and the
best of all its windows are merged.

Inner products become distances on a sphere by one more component,
sqrt(largest squared norm - squared norm), so near keys mean large products
also when norms differ.

Vectors without any cluster structure (all directions alike, as in the test
tables) have no locality that a curve could use: to reach a recall of 0.9 the
windows have to span a fixed share of the rows. ``window`` is that share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import load, pick, save, shuffle_width
from strata.llm.hilbert import hilbert_keys

ORDERINGS = 8  #: curves
WINDOW = 0.09  #: share of all rows that a window reaches to either side
DIMS, BITS = 4, 12  #: of the projected cells; DIMS * BITS < 64
BLOCK_BYTES = 16 << 20  #: of vectors in a block, which a task scores at a time
ASKING = 4096  #: queries that meet one copy of a block, about


def valid_vector(col: Column) -> Column:
    """Not null, not zero, every component finite."""
    finite = F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return col.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(col, lambda x: x != 0)


def usual_length(rows: DataFrame) -> int:
    """The commonest length of the vectors v (ties: the smaller); 0 without any."""
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    return sizes[0]["dim"] if sizes else 0


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v array<double>): valid vectors of the table's usual length, one row for each id.

    The usual length is the commonest among valid vectors (ties: the smaller).
    Of rows with one id, the smallest vector counts.
    """
    d = pick(vectors, id_col, vector_col).toDF("vec_id", "v").where("vec_id IS NOT NULL")
    d = d.select(F.col("vec_id").cast("long"), F.col("v").cast("array<double>"))
    d = d.where(valid_vector(F.col("v")))
    return d.where(F.size("v") == usual_length(d)).groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column):
    import numpy as np

    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _keys(biggest: float, orderings: int, dims: int, bits: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("v"))
            extra = np.sqrt(np.maximum(biggest - (x * x).sum(1), 0))
            x = np.column_stack([x, extra]) / np.sqrt(biggest)
            for o in range(orderings):
                rng = np.random.default_rng(1000 + o)
                directions = np.linalg.qr(rng.normal(size=(x.shape[1], min(dims, x.shape[1]))))[0]
                # a unit vector's projection has a standard deviation near 1/sqrt(d); cells span 4 of them
                z = x @ directions * np.sqrt(x.shape[1]) + rng.uniform(-0.5, 0.5, directions.shape[1])
                cells = np.clip((z + 4.5) / 9 * 2**bits, 0, 2**bits - 1).astype(np.int64)
                key = hilbert_keys(cells, bits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), o, np.int32)), pa.array(key), batch.column("vec_id"), batch.column("v"), batch.column("asks")],
                    names=["o", "key", "vec_id", "v", "asks"],
                )

    return run


def _score(k: int, reach: int, step: int = 64):
    """The ``k`` best rows of a block for every query, among rows at most ``reach`` positions away."""

    def run(_, left, right):
        import numpy as np
        import pyarrow as pa

        rows, queries = left.combine_chunks().sort_by("pos"), right.combine_chunks().sort_by("qpos")
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if rows.num_rows and queries.num_rows:
            x, ids, pos = _matrix(rows["v"].combine_chunks()), rows["vec_id"].to_numpy(), rows["pos"].to_numpy()
            q, qids, qpos = _matrix(queries["v2"].combine_chunks()), queries["q"].to_numpy(), queries["qpos"].to_numpy()
            parts = []
            for at in range(0, len(q), step):
                here = qpos[at:at + step]
                lo, hi = np.searchsorted(pos, here[0] - reach), np.searchsorted(pos, here[-1] + reach, "right")
                if lo == hi:
                    continue
                s = q[at:at + step] @ x[lo:hi].T
                # each query its own window: its answer does not depend on which others are asked
                s[np.abs(pos[lo:hi] - here[:, None]) > reach] = -np.inf
                cut = np.partition(s, max(s.shape[1] - k, 0), axis=1)[:, max(s.shape[1] - k, 0)]
                who, which = np.nonzero((s >= cut[:, None]) & (s > -np.inf))
                score, c = s[who, which], ids[lo:hi][which]
                order = np.lexsort((c, -score, who))  # ties at the cut: the smaller ids stay
                who, score, c = who[order], score[order], c[order]
                nth = np.arange(len(who)) - np.searchsorted(who, who)
                best = nth < k
                parts.append((qids[at:at + step][who[best]], c[best], score[best]))
            if parts:
                out = [np.concatenate(p) for p in zip(*parts, strict=True)]
        return pa.table({"q": pa.array(out[0], pa.int64()), "c": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
            orderings: int = ORDERINGS, window: float = WINDOW, dims: int = DIMS, bits: int = BITS, block: int | None = None,
            asking_bound: int = ASKING) -> DataFrame:
    """The ``k`` rows with the largest inner product found for every query row.

    ``is_query`` is a condition on ``vec_id``. Returns query_id, rank (from 1),
    vec_id, score; ties go to the smaller vec_id; a query is not its own
    neighbour. Vectors that are null, zero, of unusual length or hold null or
    non-finite components take no part; an empty table gives no rows. Equal
    vectors are searched once and expanded to their k + 1 smallest ids, so a
    vector repeated any number of times costs one position on a curve.
    """
    spark = vectors.sparkSession
    d = save(usable(vectors, id_col, vector_col), "vectors")
    top = d.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m"), F.max(F.size("v")).alias("dim")).collect()[0]
    same = Window.partitionBy("v").orderBy("vec_id")
    members = d.withColumn("rn", F.row_number().over(same)).where(F.col("rn") <= k + 1)
    members = members.withColumn("rep", F.first("vec_id").over(same))
    members = save(members.select("rep", "vec_id", "v", "rn"), "members")
    # every query with the class of its vector
    asking = d.where(is_query).join(members.where("rn = 1").select("v", "rep"), "v").select(F.col("vec_id").alias("query_id"), "rep")
    asking = save(asking, "asking")
    classes = members.where("rn = 1").select("vec_id", "v")
    wanted = asking.select(F.col("rep").alias("vec_id")).distinct().withColumn("asks", F.lit(True))
    classes = classes.join(wanted, "vec_id", "left").withColumn("asks", F.coalesce("asks", F.lit(False)))

    keyed = classes.mapInArrow(_keys(top["m"] or 1.0, orderings, dims, bits), "o int, key long, vec_id long, v array<double>, asks boolean")
    parts = max(shuffle_width(spark), orderings)
    placed = keyed.repartitionByRange(parts, "o", "key", "vec_id").sortWithinPartitions("o", "key", "vec_id")
    placed = save(placed.withColumn("p", F.spark_partition_id()).withColumn("i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "placed")
    # one row for each partition and ordering: bounded by the number of partitions
    sizes = placed.groupBy("o", "p").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("first"))
    before = Window.partitionBy("o").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("o", "p", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    placed = placed.join(F.broadcast(sizes), ["o", "p"]).withColumn("pos", F.col("i") - F.col("first") + F.col("before"))
    total = classes.count()
    if block is None:
        block = max(BLOCK_BYTES // (8 * max(top["dim"] or 1, 1)), 1)
    reach = max(int(window * total), 2 * k)
    blocks = placed.select("o", F.floor(F.col("pos") / block).alias("b"), "vec_id", "v", "pos")
    span = F.sequence(F.greatest(F.floor((F.col("pos") - reach) / block), F.lit(0)),
                      F.floor(F.least(F.col("pos") + reach, F.lit(max(total - 1, 0))) / block))
    meets = placed.where("asks").select("o", F.explode(span).alias("b"), "vec_id", "v", "pos").toDF("qo", "qb", "q", "v2", "qpos")
    # a block met by many queries is copied, so that a task's queries stay bounded however many rows a window spans
    copies = meets.groupBy("qo", "qb").agg(F.ceil(F.count(F.lit(1)) / asking_bound).cast("int").alias("copies"))
    meets = meets.join(copies, ["qo", "qb"]).select("qo", "qb", F.expr("pmod(xxhash64(q), copies)").cast("int").alias("qpart"), "q", "v2", "qpos")
    blocks = blocks.join(copies.toDF("o", "b", "copies"), ["o", "b"])
    blocks = blocks.select("o", "b", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("part"), "vec_id", "v", "pos")
    met = blocks.groupBy("o", "b", "part").cogroup(meets.groupBy("qo", "qb", "qpart"))
    found = met.applyInArrow(_score(k + 1, reach), "q long, c long, score double")

    best = Window.partitionBy("q").orderBy(F.desc("score"), "c")
    merged = found.groupBy("q", "c").agg(F.max("score").alias("score"))
    merged = merged.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    wide = merged.join(members.select(F.col("rep").alias("c"), "vec_id"), "c")
    each = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    wide = wide.withColumn("r", F.row_number().over(each)).where(F.col("r") <= k + 1).select("q", "vec_id", "score")
    final = asking.withColumnRenamed("rep", "q").join(wide, "q").where("vec_id <> query_id")
    ranked = final.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_hilbert_neighbours(spark, sf_dir: str) -> DataFrame:
    """Queries are the rows of ``embeddings`` whose vec_id is divisible by 20; candidates are all rows."""
    return nearest(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
