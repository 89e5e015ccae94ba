"""Text quality by a sparse rule ensemble.

Statistics of every whole text are counted in Arrow batches. Small trees are
grown on random halves of a bounded labelled sample, each on what the trees
before it left unexplained; every path from a root is a conjunctive rule. A
logistic model with a lasso penalty keeps few of the rules, and those are
compiled into Spark column expressions over the statistics.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import load, pick, save
from strata.llm.trees import bin_edges, binned, evaluate, grow, holds, paths, simplify
from strata.llm.words import flat, runs, word_hashes, word_spans

TRAIN_ROWS = 20_000  #: labelled rows that are learned from, at most
TREES, DEPTH = 40, 3
PENALTY = 2e-3
CUT = 0.3  #: score from which a text is predicted good

_CLASS = {
    "upper": range(0x41, 0x5B), "lower": range(0x61, 0x7B), "digit": range(0x30, 0x3A), "wide": range(0x80, 0x100),
    "newline": [0x0A], "bang": [0x21], "bar": [0x7C], "symbol": b"#$%&*@^~<>{}[]\\/=+_", "stop": b".,;:?'\"()-",
}
FEATURES = ["bytes", "words", "mean_word", "longest_word", "repeat", "distinct", "shouted", *_CLASS]


def statistics(column):
    """One row of FEATURES for each text; an empty text has zeros.

    bytes, words: log(1 + count); mean_word, longest_word: bytes, the latter as
    log(1 + x); repeat: share of words equal to the word before; distinct: share
    of distinct words; shouted: share of words with capitals and no small letter;
    the rest: share of bytes of each kind.
    """
    data, off = flat(column)
    for first, last in runs(off):
        part, o = data[off[first]:off[last]], off[first:last + 1] - off[first]
        n = last - first
        size = np.diff(o)
        starts, ends, doc = word_spans(part, o)
        h = word_hashes(part, starts, ends)
        words = np.bincount(doc, minlength=n)
        some, length = np.maximum(words, 1), ends - starts
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        order = np.lexsort((h, doc))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
        longest = np.zeros(n, np.int64)
        np.maximum.at(longest, doc, length)
        kinds = {}
        for name, codes in _CLASS.items():
            table = np.zeros(256, np.int32)
            table[list(codes)] = 1
            kinds[name] = np.concatenate([[0], np.cumsum(table[part])])
        caps = kinds["upper"][ends] - kinds["upper"][starts]
        small = kinds["lower"][ends] - kinds["lower"][starts]
        out = [np.log1p(size), np.log1p(words), np.bincount(doc, weights=length, minlength=n) / some, np.log1p(longest),
               np.bincount(doc, weights=again, minlength=n) / some, np.bincount(doc[order], weights=new, minlength=n) / some,
               np.bincount(doc, weights=(caps > 0) & (small == 0), minlength=n) / some]
        out += [(c[o[1:]] - c[o[:-1]]) / np.maximum(size, 1) for c in kinds.values()]
        yield from np.column_stack(out)


def _statistics(batches):
    for batch in batches:
        x = np.array(list(statistics(batch.column("text")))).reshape(batch.num_rows, len(FEATURES))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(np.ascontiguousarray(c)) for c in x.T]], names=["doc_id", *FEATURES])


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L1-penalised logistic regression, by accelerated proximal gradient."""
    w, b = np.zeros(r.shape[1]), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    v, c, t = w.copy(), b, 1.0
    # a bound of the curvature: a quarter of the largest eigenvalue of (r, 1)'(r, 1) / n
    full = np.column_stack([r, np.ones(len(r))])
    rate = 4 / np.linalg.eigvalsh(full.T @ full / len(r)).max()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(r @ v + c)))
        g, gb = r.T @ (p - y) / len(y), (p - y).mean()
        step = v - rate * g
        nw, nb = np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0), c - rate * gb
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, c = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, float(b)


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY, seed: int = 3):
    """(rules, weights, intercept): conjunctions of bounds on the columns of x with their logistic weights."""
    if not len(y) or y.min() == y.max():
        return [], np.zeros(0), (8.0 if len(y) and y[0] else 0.0 if not len(y) else -8.0)
    rng = np.random.default_rng(seed)
    edges = bin_edges(x)
    b = binned(x, edges)
    score, found = np.full(len(y), y.mean()), set()
    for _ in range(trees):
        rows = rng.permutation(len(y))[:max(len(y) // 2, 1)]
        tree = grow(b[rows], (y - score)[rows], edges, depth, rng, max(3, x.shape[1] // 2), max(5, len(y) // 500))
        score += 0.3 * evaluate(tree, x)
        found |= {simplify(p) for p in paths(tree)}
    rules = sorted(found)
    r = np.column_stack([holds(p, x) for p in rules]).astype(float) if rules else np.zeros((len(y), 0))
    w, c = lasso(r, y, penalty)
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    return [rules[k] for k in kept], w[kept], c


def compile_rules(rules, weights, intercept: float, names: list[str]) -> Column:
    """The logistic score as one column expression over the statistics."""
    def both(rule):
        parts = [F.col(names[f]) <= cut if sign == "<=" else F.col(names[f]) > cut for f, sign, cut in rule]
        return reduce(lambda a, b: a & b, parts)

    total = F.lit(float(intercept))
    for rule, w in zip(rules, weights, strict=True):
        total = total + F.when(both(rule), F.lit(float(w))).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def score_quality(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                  train_rows: int = TRAIN_ROWS, cut: float = CUT) -> DataFrame:
    """doc_id, score (0 to 1, higher: better) and predicted (score >= cut) for every row of ``docs``.

    Learns from labelled rows whose doc_id meets ``learn``: at most
    ``train_rows``, those with the smallest hash of doc_id. Null labels teach
    nothing; several labels of one doc_id count by their maximum. Null texts
    count as empty; without labels the score is 0.5, with labels of one kind
    near that kind. Repeated rows are rows of their own; an empty table gives no
    rows. Only the text enters a score.
    """
    texts = pick(docs, id_col, text_col).toDF("doc_id", "text")
    stats = save(texts.mapInArrow(_statistics, "doc_id {}, {}".format(texts.schema["doc_id"].dataType.simpleString(), ", ".join(f"{f} double" for f in FEATURES))), "statistics")
    known = pick(labels, id_col, label_col).toDF("doc_id", "y").where("y IS NOT NULL").where(learn)
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    # one row for each of the known doc_ids, however often it stands in the table
    rows = stats.join(known, "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct(*FEATURES)).alias("x"))
    rows = rows.select("doc_id", F.col("y").cast("double"), "x.*").toPandas().sort_values("doc_id")
    rules, weights, intercept = fit_rules(rows[FEATURES].to_numpy(float), rows["y"].to_numpy(float))
    out = stats.withColumn("score", compile_rules(rules, weights, intercept, FEATURES))
    return out.select("doc_id", "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def op2_rule_quality(spark, sf_dir: str) -> DataFrame:
    """All ``documents``, learned from ``labels.quality`` where crc32(doc_id as text) mod 5 is not 0."""
    rest = F.crc32(F.col("doc_id").cast("string")) % 5
    out = score_quality(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), rest != 0)
    return out.select("doc_id", F.coalesce(rest == 0, F.lit(False)).alias("held_out"), "score", "predicted")
