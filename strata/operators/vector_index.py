"""Inverted-file index for cosine search: cells around centres, one folder for each.

Centres are fitted on a bounded sample (spherical k-means); every vector is then
put into the cell of its nearest centre, and the cell is the partition column of
the stored table. A search compares the query with the centres, reads only the
folders of the nearest cells, and ranks all their vectors exactly: nothing but
the choice of cells is approximate, and no number of candidates is capped.

Each cell also stores how far its members lie from the centre. By the triangle
inequality of angles that bounds the cosine any member can reach, so ``exact``
searches read a second time only those further cells that could still hold one
of the k best, and return what a full scan returns.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.vector import normalize
from strata.sources.store import publish_text, read_text

MAX_CELLS = 4096
SAMPLE_PER_CELL = 64  #: rows of the sample that the centres are fitted on, for each centre
ITERATIONS = 10
MAX_QUERIES = 2048  #: queries that one pass sends to the tasks
SCORES = 1 << 21  #: scores (rows x queries, or rows x cells) that a task holds at a time
SLACK = 1e-9


@dataclass
class VectorIndex:
    path: str
    id_col: str
    centres: np.ndarray  # cells x components, unit rows
    reach: np.ndarray  # largest angle between a cell's members and its centre
    sizes: np.ndarray
    stored: DataFrame  # id, unit, carried columns, cell


def _fit(sample: np.ndarray, cells: int) -> np.ndarray:
    """Spherical k-means; centres start as the first rows of the (shuffled) sample."""
    centres = sample[:cells].copy()
    step = max(1, SCORES // len(centres))
    for _ in range(ITERATIONS):
        near = np.concatenate([(sample[i:i + step] @ centres.T).argmax(axis=1) for i in range(0, len(sample), step)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        norm = np.linalg.norm(sums, axis=1)
        centres = np.where(norm[:, None] > 0, sums / np.maximum(norm, 1e-300)[:, None], centres)
    return centres


def build_index(corpus: DataFrame, id_col: str, vec_col: str, path: str, cells: int | None = None, carry: tuple[str, ...] = ()) -> VectorIndex:
    """Write the index of all vectors of ``corpus`` below ``path``.

    Null and zero vectors have no direction and are left out, as in the exact
    search. ``cells`` defaults to the square root of the number of vectors, at
    most ``MAX_CELLS``; the sample has about ``SAMPLE_PER_CELL`` rows for each, and
    only they are sent to the driver. A cell with many vectors is written by
    several tasks.
    """
    spark = corpus.sparkSession
    unit = corpus.select(F.col(id_col), normalize(F.col(vec_col)).alias("unit"), *carry).where("unit IS NOT NULL")
    n = unit.count()
    cells = min(cells or round(n**0.5), MAX_CELLS, n)
    # drawn by the tasks: an ordered limit would send that many rows of every task to the driver
    share = max(cells, 1) * SAMPLE_PER_CELL / max(n, 1)
    drawn = unit.select("unit") if share >= 1 else unit.sample(share, seed=7).select("unit")
    rows = drawn.toArrow().column("unit").combine_chunks() if cells else []
    sample = np.array(rows.flatten(), np.float64).reshape(len(rows), -1) if len(rows) else np.zeros((0, 0))
    sample = sample[np.random.default_rng(7).permutation(len(sample))]
    cells = min(cells, len(sample))
    centres = _fit(sample, cells) if cells else np.zeros((0, 0))
    bc, scores = spark.sparkContext.broadcast(centres), SCORES

    def assign(batches):
        import numpy as np

        for pdf in batches:
            step = max(1, scores // len(bc.value))
            for a in range(0, len(pdf), step):
                part = pdf.iloc[a:a + step].copy()
                s = np.stack(part["unit"].to_list()) @ bc.value.T
                part["cell"] = s.argmax(axis=1).astype(np.int32)
                part["_cos"] = s.max(axis=1)
                yield part

    schema = T.StructType([*unit.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("_cos", T.DoubleType())])
    placed = unit.mapInPandas(assign, schema) if cells else spark.createDataFrame([], schema)
    # ranges over (cell, hash) give a crowded cell to several tasks, small cells together to one
    placed = placed.repartitionByRange(F.col("cell"), F.xxhash64(id_col))
    placed.write.partitionBy("cell").parquet(f"{path}/vectors")
    spark.createDataFrame([(c, v.tolist()) for c, v in enumerate(centres)], "cell int, centre array<double>").write.parquet(f"{path}/centres")
    publish_text(spark, f"{path}/_schema", T.StructType([f for f in schema.fields if f.name != "cell"]).add("cell", T.IntegerType()).json())
    return open_index(spark, path, id_col)


def open_index(spark: SparkSession, path: str, id_col: str) -> VectorIndex:
    centres = spark.read.schema("cell int, centre array<double>").parquet(f"{path}/centres").orderBy("cell").collect()  # at most MAX_CELLS rows
    reach, sizes = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    schema = T.StructType.fromJson(json.loads(read_text(spark, f"{path}/_schema")))
    stored = spark.read.schema(schema).parquet(f"{path}/vectors")
    if centres:
        for r in stored.groupBy("cell").agg(F.min("_cos").alias("c"), F.count(F.lit(1)).alias("n")).collect():
            reach[r["cell"]], sizes[r["cell"]] = np.arccos(np.clip(r["c"], -1, 1)), r["n"]
    return VectorIndex(path, id_col, np.array([r["centre"] for r in centres], np.float64), reach, sizes, stored)


def _score(index: VectorIndex, stored: DataFrame, ids: list, queries: np.ndarray, asks: np.ndarray, k: int, carry: list[str]) -> DataFrame:
    """Each task's k best of every query among the cells it asks (``asks``: queries x cells)."""
    spark, id_col = stored.sparkSession, index.id_col
    bc, scores = spark.sparkContext.broadcast((np.asarray(ids, dtype=object), queries, asks)), SCORES

    def run(batches):
        import numpy as np
        import pandas as pd

        names, q, wanted = bc.value
        best, least = None, np.full(len(q), -np.inf)  # least: the k-th best score so far
        step = max(1, scores // len(q))
        for whole in batches:
            for a in range(0, len(whole), step):
                pdf = whole.iloc[a:a + step]
                s = np.stack(pdf["unit"].to_list()) @ q.T
                s[~wanted[:, pdf["cell"].to_numpy()].T] = -np.inf
                hits = (s >= least) & (s > -np.inf)
                if len(s) > k and np.count_nonzero(hits) > 2 * k * len(q):  # only the k best of these rows
                    hits &= s >= np.partition(s, len(s) - k, axis=0)[len(s) - k]
                rows, cols = np.nonzero(hits)
                if not len(rows):
                    continue
                part = pdf[[id_col, *carry]].iloc[rows].assign(query=cols, score=s[rows, cols])
                best = part if best is None else pd.concat([best, part])
                best = best.sort_values(["query", "score", id_col], ascending=[True, False, True]).groupby("query").head(k)
                full = best.groupby("query")["score"].agg(["size", "min"])
                full = full[full["size"] == k]
                least[full.index.to_numpy()] = full["min"].to_numpy()
        if best is not None and len(best):
            yield pd.DataFrame({"query_id": names[best["query"].to_numpy()], **{c: best[c].to_numpy() for c in (id_col, *carry)}, "score": best["score"].to_numpy()})

    cells = np.flatnonzero(asks.any(axis=0)).tolist()
    fields = [stored.schema[c] for c in (id_col, *carry)]
    kind = {int: T.LongType(), str: T.StringType()}.get(type(ids[0]), T.LongType())
    schema = T.StructType([T.StructField("query_id", kind), *fields, T.StructField("score", T.DoubleType())])
    read = stored.where(F.col("cell").isin(cells))  # the other cells' folders are not listed
    return read.select("cell", id_col, "unit", *carry).mapInPandas(run, schema)


def _best(found: DataFrame, id_col: str, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(id_col))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(index: VectorIndex, queries: DataFrame, qid_col: str, qvec_col: str, k: int = 5, probes: int = 8, exact: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """The k nearest vectors of every query: query_id, id, carried columns, score (cosine), rank; ties by id.

    ``probes`` cells are read for each query. With ``exact``, further cells are
    read where their bound says that they might hold one of the k best.
    Queries without direction have no rows; query ids count once (of several
    rows with one id, the smallest vector). Up to ``MAX_QUERIES`` queries go to
    the tasks at a time.
    """
    spark, stored = queries.sparkSession, index.stored
    q = queries.select(F.col(qid_col).alias("q"), normalize(F.col(qvec_col)).alias("v")).where("q IS NOT NULL AND v IS NOT NULL")
    q = q.groupBy("q").agg(F.min("v").alias("v"))
    carry, parts = list(carry), []
    rows = q.limit(MAX_QUERIES + 1).collect()
    groups = -(-q.count() // MAX_QUERIES) if len(rows) > MAX_QUERIES else 1
    for g in range(groups if len(index.centres) else 0):
        if groups > 1:
            rows = q.where(F.pmod(F.xxhash64("q"), F.lit(groups)) == g).collect()  # about MAX_QUERIES
        if not rows:
            continue
        ids, m = [r[0] for r in rows], np.array([r[1] for r in rows], np.float64)
        near = m @ index.centres.T
        asks = np.zeros(near.shape, bool)
        filled = np.where(index.sizes > 0, near, -np.inf)
        np.put_along_axis(asks, np.argsort(-filled, axis=1, kind="stable")[:, :probes], True, axis=1)
        asks &= index.sizes > 0
        found = _score(index, stored, ids, m, asks, k, carry)
        if exact:
            found = spark.createDataFrame(_best(found, index.id_col, k).drop("rank").collect(), found.schema)  # k rows for each query
            kth = {r["query_id"]: r["s"] for r in found.groupBy("query_id").agg(F.min("score").alias("s"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).collect()}
            least = np.array([kth.get(i, -np.inf) for i in ids])
            bound = np.cos(np.maximum(np.arccos(np.clip(near, -1, 1)) - index.reach, 0))
            more = (bound >= least[:, None] - SLACK) & ~asks & (index.sizes > 0)
            if more.any():
                found = found.unionByName(_score(index, stored, ids, m, more, k, carry))
        parts.append(found)
    if not parts:
        fields = [stored.schema[c] for c in (index.id_col, *carry)]
        return spark.createDataFrame([], T.StructType([queries.schema[qid_col], *fields, T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())])).withColumnRenamed(qid_col, "query_id")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _best(out, index.id_col, k)
