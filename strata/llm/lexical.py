"""Ranked lexical search: all documents scanned by an automaton of the items' terms.

There is no index of documents. The terms of the items (a bounded table, see
``ITEM_BYTES``) make one boundary-guarded Aho-Corasick automaton, which travels
to the tasks. A first scan counts the documents that hold each term and the
lengths; a second one counts term frequencies again, weighs them, adds them up
through the automaton's outputs (term -> items), and keeps each task's best
documents of every item. What is shuffled is one row for each term and task, and
k rows for each item and task. Between the scans nothing is stored, so a lost
executor costs its tasks only.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.automaton import Automaton, terms_of
from strata.llm.common import load, pick
from strata.llm.words import flat, runs

ITEM_BYTES = 32 << 20  #: bytes of items in one automaton; more items go through scans of their own
RUN_BYTES = 8 << 20
CELLS = 1 << 22  #: scores (documents x items) held at once

# Fixed values of the score.
SCALE, TF_SCALE, M_SCALE = 1000, 1_000_000_000, 8
LEAST, SPREAD = 10, 90  # a document's m is 100 - 90 at length 0, plus 90 at mean length


def _statistics(automaton: Automaton):
    """(term, n) rows of a task: documents that hold the term; -1: documents with terms; -2: all their terms."""

    def run(batches):
        held, documents, length = np.zeros(max(len(automaton.outputs), 1), np.int64), 0, 0
        for batch in batches:
            data, off = flat(batch.column("text"))
            for a, b in runs(off, RUN_BYTES):
                n, _, term, _ = automaton.counts(data[off[a]:off[b]], off[a:b + 1] - off[a])
                held += np.bincount(term, minlength=len(held))
                documents, length = documents + int((n > 0).sum()), length + int(n.sum())
        there = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2], there])), pa.array(np.concatenate([[documents, length], held[there]]))], names=["term", "n"])

    return run


class _Best:
    """The k best documents of every item seen so far: highest score, then smallest doc_id, null last."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.zeros(items, np.int64)
        self.item = self.score = self.doc = np.zeros(0, np.int64)
        self.null = np.zeros(0, bool)

    def add(self, scores: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        """``scores``: documents x items."""
        least = np.maximum(self.least, 1)
        if len(scores) > self.k:
            least = np.maximum(least, np.partition(scores, len(scores) - self.k, axis=0)[len(scores) - self.k])
        row, item = np.nonzero(scores >= least)
        if not len(row):
            return
        item, score = np.concatenate([self.item, item]), np.concatenate([self.score, scores[row, item]])
        doc, null = np.concatenate([self.doc, doc[row]]), np.concatenate([self.null, null[row]])
        order = np.lexsort((doc, null, -score, item))
        item = item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        keep = order[rank < self.k]
        self.least[item[rank == self.k - 1]] = score[order[rank == self.k - 1]]
        self.item, self.score, self.doc, self.null = item[rank < self.k], score[keep], doc[keep], null[keep]


def _ranked(automaton: Automaton, weight: np.ndarray, documents: int, length: int, at: np.ndarray, items: np.ndarray, n_items: int, k: int):
    """Each task's k best (item, doc_id, score); items[at[t]:at[t + 1]] are the items of term t."""

    def run(batches):
        best, degree = _Best(n_items, k), np.diff(at)
        step = max(1, CELLS // max(n_items, 1))
        for batch in batches:
            data, off = flat(batch.column("text"))
            ids = batch.column("doc_id")
            null = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            for a, b in runs(off, RUN_BYTES):
                n, doc, term, tf = automaton.counts(data[off[a]:off[b]], off[a:b + 1] - off[a])
                m = np.array([LEAST + SPREAD * x * documents // length for x in n.tolist()] if length else [LEAST] * len(n), np.int64)
                value = weight[term] * (TF_SCALE * tf // (SCALE * tf + M_SCALE * m[doc]))
                edges = np.searchsorted(doc, np.arange(0, b - a + step, step))
                for j, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    if lo == hi:
                        continue
                    rows = min(step, b - a - j * step)
                    t, each = term[lo:hi], degree[term[lo:hi]]
                    reach = np.repeat(at[t] - (np.cumsum(each) - each), each) + np.arange(each.sum())
                    scores = np.zeros(rows * n_items, np.int64)
                    np.add.at(scores, np.repeat((doc[lo:hi] - j * step) * n_items, each) + items[reach], np.repeat(value[lo:hi], each))
                    here = slice(a + j * step, a + j * step + rows)
                    best.add(scores.reshape(rows, n_items), ids[here], null[here])
        for x in range(0, len(best.item), 10_000):
            part = slice(x, x + 10_000)
            yield pa.RecordBatch.from_arrays([pa.array(best.item[part]), pa.array(best.doc[part], mask=best.null[part]), pa.array(best.score[part])], names=["item", "doc_id", "score"])

    return run


def _rank_group(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    spark = docs.sparkSession
    pooled: dict = {}
    for r in items.collect():  # at most about ITEM_BYTES
        pooled.setdefault(r["item_id"], set()).update(terms_of(r["text"]))
    names = sorted(pooled, key=lambda x: (x is None, x))
    terms = sorted(set().union(*pooled.values())) if pooled else []
    number = {t: i for i, t in enumerate(terms)}
    automaton = Automaton(terms)
    got = {r["term"]: r["n"] for r in docs.select("text").mapInArrow(_statistics(automaton), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    documents, length = got.get(-1, 0), got.get(-2, 0)
    weight = np.array([math.floor(SCALE * math.log((2 * documents + 2) / (2 * got.get(t, 0) + 1))) for t in range(len(terms))], np.int64)
    pairs = sorted((number[t], i) for i, name in enumerate(names) for t in pooled[name])
    owner = np.array([i for _, i in pairs], np.int64)
    at = np.searchsorted(np.array([t for t, _ in pairs], np.int64), np.arange(len(terms) + 1))
    best = docs.mapInArrow(_ranked(automaton, weight, documents, length, at, owner, len(names), k), "item long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named = spark.createDataFrame(list(enumerate(names)), f"item long, item_id {items.schema['item_id'].dataType.simpleString()}")
    return best.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The ``k`` highest-scoring documents of every item: item_id, rank, doc_id, score.

    ``docs``: doc_id long, text; ``items``: item_id, text. Every row of docs is a
    document of its own, also where rows repeat; null and empty texts have no
    terms and are in no count. Equal scores go by ascending doc_id, null last.
    Items are pooled by item_id, null among them; items without terms, or whose
    terms no document holds, have no rows. Empty tables give no rows. Weights are
    doubles rounded down, everything after them 64-bit integers; the mean length
    enters through unbounded integers. A text needs about 4 bytes of memory a
    byte, and 24 for each pair of a document and a term it holds.
    """
    docs, items = pick(docs, "doc_id", "text"), pick(items, "item_id", "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).collect()[0]["n"]
    groups = size // item_bytes + 1
    parts = [_rank_group(docs, items.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g) if groups > 1 else items, k) for g in range(groups)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def op13_lexical_search(spark, sf_dir: str) -> DataFrame:
    """The 10 best of all ``documents`` for each item of ``benchmark``."""
    return rank_documents(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


SEARCH_SQL = r"""
WITH d AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
len AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM len),
items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, total),
m AS (SELECT doc_id, 10 + (90 * n * docs) // terms AS m FROM len, total),
s AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM items JOIN tf USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""
