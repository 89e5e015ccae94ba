"""Vector operators at their defaults: recall, windows, few components, doubtful pairs, repeated rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.llm.ann import nearest
from strata.llm.vectors_dedup import near_duplicate_vectors


def table(spark, x, label=None):
    rows = [(i, [float(v) for v in r], int(i % 2) if label is None else label) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


@pytest.mark.parametrize("clusters", [0, 12])
def test_recall_at_the_defaults(spark, clusters):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(6000, 48)) if not clusters else rng.normal(size=(clusters, 48))[rng.integers(0, clusters, 6000)] + rng.normal(size=(6000, 48)) * 0.4
    asked = [i for i in range(6000) if i % 20 == 0]  # 300 queries: far more than one step of scoring
    got: dict = {}
    for r in nearest(table(spark, x), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = 0
    for q in asked:
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(got[q] & set(np.argsort(-s)[:20].tolist()))
    assert hit / (20 * len(asked)) >= 0.9


def test_an_answer_does_not_depend_on_the_other_queries(spark):
    x = np.random.default_rng(12).normal(size=(1500, 24))
    df = table(spark, x)

    def answers(every):
        return sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in nearest(df, F.col("vec_id") % every == 0, k=10).where("query_id % 300 = 0").collect())  # the last bit of a score may differ

    assert answers(20) == answers(300)


def links(x, label, threshold=0.93):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    link = (u @ u.T >= threshold) & (label[:, None] == label)
    np.fill_diagonal(link, False)
    comp = np.arange(len(x))
    while True:
        new = np.array([min([comp[i], *comp[np.flatnonzero(link[i])]]) for i in range(len(x))])
        if (new == comp).all():
            return link.sum(axis=1), comp
        comp = new


@pytest.mark.parametrize("dims", [1, 2, 3, 8, 40])
def test_any_number_of_components(spark, dims):
    rng = np.random.default_rng(dims)
    x = rng.normal(size=(90, dims))
    x[50:80] = x[:30] + rng.normal(size=(30, dims)) * 0.37 * np.linalg.norm(x[:30], axis=1)[:, None] / dims**0.5  # cosines around the threshold
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_duplicate_vectors(table(spark, x), block=16).collect()}
    n, comp = links(x, np.arange(90) % 2)
    assert got == {i: (int(n[i]), int(comp[i])) for i in range(90)}


def test_doubtful_pairs_are_settled_in_double_precision(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=(40, 16))
    a /= np.linalg.norm(a, axis=1)[:, None]
    side = rng.normal(size=(40, 16))
    side -= (side * a).sum(axis=1)[:, None] * a
    side /= np.linalg.norm(side, axis=1)[:, None]
    cos = 0.93 + np.where(np.arange(40) % 2, 1, -1) * 10.0 ** -rng.integers(3, 9, 40)
    x = np.concatenate([a, cos[:, None] * a + np.sqrt(1 - cos**2)[:, None] * side])
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_duplicate_vectors(table(spark, x, 1)).collect()}
    n, comp = links(x, np.ones(80, int))
    assert got == {i: (int(n[i]), int(comp[i])) for i in range(80)} and n.sum() >= 40


def test_of_repeated_ids_one_row_counts(spark):
    rows = [(1, [1.0, 0.0], 2), (1, [0.0, 1.0], 1), (1, [5.0, 5.0], None), (1, [0.0, 0.0], 0), (2, [1.0, 0.0], 2), (3, [0.0, 2.0], 1), (4, [0.0, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_duplicate_vectors(df).collect()}
    assert got == {1: (1, 1, True), 2: (0, 2, True), 3: (1, 1, False), 4: (0, 4, True)}
