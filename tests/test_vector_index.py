"""The inverted-file index against a full scan."""

import numpy as np
import pytest

from strata.operators import vector_index as V
from strata.session import scratch_path


def _clusters(spark, n=1200, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(15, 16))
    x = middle[rng.integers(0, 15, n)] + rng.normal(size=(n, 16)) * 0.25
    x[100:160] = x[100]  # equal vectors
    rows = [(i, [float(v) for v in r], int(i % 4)) for i, r in enumerate(x)]
    rows += [(5000, None, 0), (5001, [0.0] * 16, 0)]
    return spark.createDataFrame(rows, "id long, vec array<double>, label int"), x


def _want(x, queries, k):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    return {(q, r + 1): i for q in queries for r, (_, i) in enumerate(sorted((-s, i) for i, s in enumerate(np.round(u @ u[q], 12)))[:k])}


@pytest.fixture(scope="module")
def built(spark):
    df, x = _clusters(spark)
    return df, x, V.build_index(df, "id", "vec", scratch_path(spark, "t-ivf"), cells=20, carry=("label",))


def test_exact_search_equals_a_full_scan(built):
    df, x, index = built
    queries = list(range(0, 1200, 60))
    got = {(r["query_id"], r["rank"]): (r["id"], r["label"], r["score"]) for r in V.search(index, df.where("id % 60 = 0"), "id", "vec", 7, probes=1, exact=True, carry=("label",)).collect()}
    want = _want(x, queries, 7)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    assert set(got) == set(want)
    for (q, r), (i, label, score) in got.items():
        assert label == i % 4 and abs(score - u[q] @ u[i]) < 1e-9
        assert i == want[q, r] or abs(u[q] @ u[i] - u[q] @ u[want[q, r]]) < 1e-9


def test_few_cells_find_most_in_clustered_vectors(built):
    df, x, index = built
    queries = list(range(0, 1200, 20))
    got = {(r["query_id"], r["id"]) for r in V.search(index, df.where("id % 20 = 0"), "id", "vec", 5, probes=3).collect()}
    want = {(q, i) for (q, _), i in _want(x, queries, 5).items()}
    assert len(got & want) / len(want) >= 0.9


def test_queries_without_direction_repeated_ids_and_empty_tables(spark, built):
    df, _, index = built
    q = spark.createDataFrame([(1, None), (2, [0.0] * 16), (3, [1.0] * 16), (3, [1.0] * 16), (None, [1.0] * 16)], "q long, v array<double>")
    rows = V.search(index, q, "q", "v", 4, probes=20).collect()
    assert sorted((r["query_id"], r["rank"]) for r in rows) == [(3, i) for i in range(1, 5)]
    empty = V.build_index(df.where("1 = 0"), "id", "vec", scratch_path(spark, "t-ivf"))
    assert V.search(empty, df.where("id = 1"), "id", "vec").count() == 0
    assert V.search(index, df.where("1 = 0"), "id", "vec").count() == 0


def test_many_queries_go_in_groups(built, monkeypatch):
    df, x, index = built
    monkeypatch.setattr(V, "MAX_QUERIES", 16)
    got = V.search(index, df.where("id % 30 = 0"), "id", "vec", 3, probes=2, exact=True).collect()
    assert len(got) == 40 * 3


def test_only_probed_folders_are_read(built):
    df, _, index = built
    out = V.search(index, df.where("id = 7"), "id", "vec", 5, probes=2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan and " IN (" in plan.split("PartitionFilters")[1][:80]


def test_repeated_query_ids_get_k_rows(spark):
    from strata.operators.vector_search import cosine_top_k

    df, x = _clusters(spark, 400)
    q = spark.createDataFrame([(1, [1.0] * 16), (1, [1.0] * 16), (2, [0.5] * 16)], "q long, v array<double>")
    got = cosine_top_k(df.repartition(5), "id", "vec", q, "q", "v", 6).collect()
    assert sorted((r["query_id"], r["rank"]) for r in got) == [(i, k) for i in (1, 2) for k in range(1, 7)]
    s = (x / np.linalg.norm(x, axis=1)[:, None]) @ np.full(16, 0.25)
    assert [r["id"] for r in sorted(got, key=lambda r: (r["query_id"], r["rank"]))][:6] == sorted(range(400), key=lambda i: (-round(s[i], 12), i))[:6]
