"""Cosine top-k search (exact) and an LSH candidate search with exact re-rank.

Exact search never materialises (query, vector) pairs as rows:

* the query set is counted first and only a bounded number of query vectors
  (``MAX_BROADCAST_QUERIES``) is shipped to the executors at a time, as one
  normalised matrix; larger query sets run in hash batches under the bound,
  so the answer stays exact;
* every Arrow batch of corpus vectors is scored against that matrix with one
  matrix product (numpy, inside the task); the task keeps its k best of each
  query from batch to batch and hands over just those;
* Spark ranks the candidates per query (``row_number() <= k``, a
  WindowGroupLimit), so each query's final group holds at most
  k x tasks rows, never the corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.vector import dot, normalize

# Upper bound on the number of query vectors shipped to the tasks at once.
MAX_BROADCAST_QUERIES = 2048
# Scores (rows x queries) that a task holds at a time.
SCORES = 1 << 21


def _unit_rows(vectors):
    import numpy as np

    mat = np.stack([np.asarray(v, dtype=np.float64) for v in vectors]) if len(vectors) else np.zeros((0, 0))
    norms = np.linalg.norm(mat, axis=1) if len(vectors) else np.zeros(0)
    ok = norms > 0
    mat[ok] = mat[ok] / norms[ok, None]
    return mat, ok


def _local_top_k(spark, corpus: DataFrame, id_col: str, vec_col: str, carry: list[str],
                 qids: list, qmat, k: int, schema: T.StructType) -> DataFrame:
    bc, scores = spark.sparkContext.broadcast((list(qids), qmat)), SCORES

    # Self-contained (no references to this module), so it is shipped to the
    # Python workers by value and executors need no copy of the package.
    def score_batches(batches):
        import numpy as np
        import pandas as pd

        ids_q, m = bc.value
        q_arr = np.asarray(ids_q, dtype=object)
        best, least = None, np.full(len(ids_q), -np.inf)
        step = max(1, scores // len(ids_q))
        for pdf in (whole.iloc[a:a + step] for whole in batches for a in range(0, len(whole), step)):
            pdf = pdf[pdf[vec_col].notna()]
            if pdf.empty:
                continue
            x = np.stack([np.asarray(v, dtype=np.float64) for v in pdf[vec_col]])
            norms = np.linalg.norm(x, axis=1)
            ok = norms > 0
            pdf, x = pdf[ok], x[ok] / norms[ok, None]
            if pdf.empty:
                continue
            s = x @ m.T  # rows x queries
            n = s.shape[0]
            hits = s >= least[None, :]
            if n > k and np.count_nonzero(hits) > 2 * k * len(ids_q):  # only the k best of these rows
                hits &= s >= np.partition(s, n - k, axis=0)[n - k]
            rows, cols = np.nonzero(hits)
            if not len(rows):
                continue
            part = pdf[[id_col, *carry]].iloc[rows].assign(_q=cols, _s=s[rows, cols])
            best = part if best is None else pd.concat([best, part])
            best = best.sort_values(["_q", "_s", id_col], ascending=[True, False, True]).groupby("_q").head(k)
            full = best.groupby("_q")["_s"].agg(["size", "min"])
            full = full[full["size"] == k]
            least[full.index.to_numpy()] = full["min"].to_numpy()
        if best is not None and len(best):
            out = pd.DataFrame({"query_id": q_arr[best["_q"].to_numpy()], id_col: best[id_col].to_numpy()})
            for c in carry:
                out[c] = best[c].to_numpy()
            out["score"] = best["_s"].to_numpy()
            yield out

    return corpus.select(id_col, vec_col, *carry).mapInPandas(score_batches, schema)


def cosine_top_k(
    corpus: DataFrame,
    id_col: str,
    vec_col: str,
    queries: DataFrame,
    qid_col: str,
    qvec_col: str,
    k: int = 5,
    max_broadcast: int = MAX_BROADCAST_QUERIES,
    carry: list[str] | None = None,
) -> DataFrame:
    """Top-k corpus rows per query by cosine similarity (ties by id).

    A query id counts once: of several rows with one id, the smallest vector.

    Output: query_id, id_col, carried corpus columns, score, rank.
    """
    spark = corpus.sparkSession
    carry = [c for c in corpus.columns if c not in (id_col, vec_col)] if carry is None else carry
    fields = {f.name: f for f in corpus.schema.fields}
    schema = T.StructType(
        [T.StructField("query_id", queries.schema[qid_col].dataType), fields[id_col]]
        + [fields[c] for c in carry]
        + [T.StructField("score", T.DoubleType())]
    )
    n_queries = queries.count()  # size check before anything is shipped
    if n_queries <= max_broadcast:
        groups = [queries]
    else:
        n_batches = -(-n_queries // max_broadcast) * 2
        tagged = queries.withColumn("_batch", F.pmod(F.xxhash64(F.col(qid_col)), F.lit(n_batches)))
        groups = [tagged.where(F.col("_batch") == b) for b in range(n_batches)]
    parts = []
    for g in groups:
        rows = g.select(qid_col, qvec_col).where(F.col(qvec_col).isNotNull()).collect()  # bounded above
        if not rows:
            continue
        rows = list({r[0]: r for r in sorted(rows, key=lambda r: list(r[1]), reverse=True)}.values())
        qmat, ok = _unit_rows([r[1] for r in rows])
        qids = [r[0] for r, keep in zip(rows, ok) if keep]
        if not qids:
            continue
        parts.append(_local_top_k(spark, corpus, id_col, vec_col, carry, qids, qmat[ok], k, schema))
    if not parts:
        return spark.createDataFrame([], schema.add("rank", T.IntegerType()))
    cands = parts[0]
    for p in parts[1:]:
        cands = cands.unionByName(p)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(id_col))
    return cands.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def lsh_top_k(
    corpus: DataFrame,
    id_col: str,
    vec_col: str,
    query_vector: list[float],
    k: int = 5,
    bucket_length: float = 0.5,
    num_tables: int = 4,
    candidates: int = 50,
    seed: int = 7,
) -> DataFrame:
    """Approximate top-k: random-projection LSH on unit vectors, exact cosine re-rank.

    Euclidean distance on unit vectors is monotone in cosine, so the LSH
    candidates are re-scored exactly and the best k kept.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    unit = corpus.select(F.col(id_col), normalize(F.col(vec_col)).alias("_u")).where(F.col("_u").isNotNull())
    feats = unit.select(F.col(id_col), F.col("_u"), array_to_vector(F.col("_u")).alias("features"))
    model = BucketedRandomProjectionLSH(
        inputCol="features", outputCol="hashes", bucketLength=bucket_length, numHashTables=num_tables, seed=seed
    ).fit(feats)
    qn = sum(x * x for x in query_vector) ** 0.5
    q = [x / qn for x in query_vector]
    cands = model.approxNearestNeighbors(feats, Vectors.dense(q), candidates)
    qcol = F.array(*[F.lit(float(x)) for x in q])
    scored = cands.select(F.col(id_col), dot(F.col("_u"), qcol).alias("score"))
    # At most ``candidates`` rows remain: a bounded final ordering.
    w = Window.orderBy(F.col("score").desc(), F.col(id_col))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
