"""Findings of round 3: whole words, merges, word overlap, index search, URL models."""

import re

from pyspark.sql import functions as F

from strata.operators import corpus as C


# ---------------------------------------------------------------- whole words


def test_whole_words_at_every_border(spark):
    borders = ["", " ", "\n", "-", "é", "\U0001f600", "_", "x", "7"]
    texts = [f"{a}{kw}{b}" for kw in ("ml", "auth", "real time", "full_stack") for a in borders for b in borders]
    texts += ["author auth", "authauth auth", "auth_ xauth auth", "html xml ml.", "mlml", "real  time", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {r["id"]: (r["category"], r["domain"]) for r in C.classify_frame(df, "id", "t", whole_words=True).collect()}

    def first(text, table, default):
        return next((label for label, kws in table if any(re.search(f"(^|[^a-z0-9_]){re.escape(k)}([^a-z0-9_]|$)", text) for k in kws)), default)

    assert got == {i: (first(t, C.CATEGORY_KEYWORDS, C.CATEGORY_DEFAULT), first(t, C.DOMAIN_KEYWORDS, C.DOMAIN_DEFAULT)) for i, t in enumerate(texts)}


def test_whole_words_look_for_the_literal_first(spark):
    """No text meets a pattern unless it holds the keyword, and patterns begin with their literal."""
    df = spark.createDataFrame([(1, "x")], "id long, t string")
    plan = C.classify_frame(df, "id", "t", whole_words=True)._jdf.queryExecution().optimizedPlan().toString()
    keywords = sum(len(kws) for table in (C.CATEGORY_KEYWORDS, C.PATTERN_KEYWORDS, C.DOMAIN_KEYWORDS) for _, kws in table)
    assert len(re.findall(r"Contains\(_lo#", plan)) == len(re.findall(r"RLIKE", plan)) == keywords
    assert C.whole_word("auth").startswith("auth")


# ---------------------------------------------------------------- URL models


def test_url_scores_do_not_depend_on_the_grams_held_in_memory(spark, monkeypatch):
    """A model too large for the tasks is asked for by slots: the same scores, no n-gram left out."""
    import random

    from strata.llm import url_models as U

    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefgé%") for _ in range(n))
    rows = [(i, f"http://{word(4)}.{rng.choice(['net', 'org', 'info'])}/{rng.choice(['fr', 'de'])}/{word(6)}") for i in range(400)]
    rows += [(400, None), (401, ""), (402, "no scheme"), (403, "http://long.info/" + "ab" * 400), (404, rows[0][1]), (405, rows[0][1])]
    pages = spark.createDataFrame(rows, "page_id long, url string").repartition(3)
    whole = {r["page_id"]: tuple(r) for r in U.judge_urls(pages).collect()}
    monkeypatch.setattr(U, "SLOT_BYTES", 300)
    for most in (0, 40):
        assert {r["page_id"]: tuple(r) for r in U.judge_urls(pages, max_grams=most).collect()} == whole
    assert len(whole) == len(rows) and len({r[5] for r in whole.values()}) > 100


# ---------------------------------------------------------------- index search


def _vectors(spark, n, dim=8, parts=4):
    import numpy as np

    rng = np.random.default_rng(3)
    return spark.createDataFrame([(i, rng.normal(size=dim).tolist()) for i in range(n)], "vec_id long, embedding array<double>").repartition(parts)


def test_unit_vectors_take_one_norm(spark):
    """The norm is a value where the components are divided, not computed again for each of them."""
    from strata.functions.vector import normalize

    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,), ([1.0, None],)], "v array<double>")
    out = df.select(normalize(F.col("v")).alias("u"))
    assert [r["u"] for r in out.collect()] == [[0.6, 0.8], None, None, None]
    assert "/ sqrt" not in out._jdf.queryExecution().optimizedPlan().toString().lower()


def test_searches_do_not_depend_on_the_scores_held(spark, tmp_path, monkeypatch):
    from strata.operators import vector_index as V
    from strata.operators import vector_search as S

    df = _vectors(spark, 600)
    queries = df.where("vec_id % 20 = 0")
    want = [tuple(r) for r in S.cosine_top_k(df, "vec_id", "embedding", queries, "vec_id", "embedding", 5).select("query_id", "rank", "vec_id", F.round("score", 9)).orderBy("query_id", "rank").collect()]
    monkeypatch.setattr(S, "SCORES", 100)
    monkeypatch.setattr(V, "SCORES", 100)
    again = S.cosine_top_k(df, "vec_id", "embedding", queries, "vec_id", "embedding", 5)
    index = V.build_index(df, "vec_id", "embedding", f"{tmp_path}/index")
    found = V.search(index, queries, "vec_id", "embedding", 5, exact=True)
    for got in (again, found):
        assert [tuple(r) for r in got.select("query_id", "rank", "vec_id", F.round("score", 9)).orderBy("query_id", "rank").collect()] == want
    assert int(index.sizes.sum()) == 600


def test_index_sample_reaches_the_driver_once(spark, tmp_path, monkeypatch):
    """The tasks draw the sample together; each does not send as many rows as the whole sample has."""
    from strata.operators import vector_index as V

    seen, kind = [], type(spark.range(1))
    ordered = lambda d: "TakeOrdered" in d._jdf.queryExecution().executedPlan().toString()
    for name in ("collect", "toArrow"):
        monkeypatch.setattr(kind, name, lambda self, f=getattr(kind, name): seen.append((ordered(self), len(out := f(self)))) or out)
    index = V.build_index(_vectors(spark, 3000, parts=8), "vec_id", "embedding", f"{tmp_path}/index", cells=4)
    assert not any(o for o, _ in seen) and max(n for _, n in seen) < 2 * 4 * V.SAMPLE_PER_CELL
    assert int(index.sizes.sum()) == 3000 and len(index.centres) == 4


# ---------------------------------------------------------------- merges


def test_large_folders_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    """A task sorts and writes a bounded number of rows, however many a partition has; versions read back whole."""
    from pyspark.sql import types as T

    from strata.sources import store as ST

    monkeypatch.setattr(ST, "PART_ROWS", 100)
    schema = T.StructType([T.StructField("cat", T.StringType()), T.StructField("id", T.LongType()), T.StructField("v", T.LongType())])
    store = ST.VersionedStore(spark, f"{tmp_path}/store", schema, ["cat", "id"], ["cat"])
    first = spark.range(3000).select(F.when(F.col("id") % 10 == 0, F.lit(None)).when(F.col("id") % 10 == 1, "rare").otherwise("often").alias("cat"), "id", F.lit(1).cast("long").alias("v"))
    again = first.where("id % 3 = 0").withColumn("v", F.lit(2).cast("long")).unionByName(spark.createDataFrame([("new", 9000, 1)], schema))
    assert store.merge(first, "v")["added"] == 3000
    often = spark.read.parquet(f"{tmp_path}/store/data/v=1").where("cat = 'often'")
    assert max(r["n"] for r in often.groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n")).collect()) < 300
    result = store.merge(again, "v")
    assert (result["added"], result["changed"]) == (1, 1000)
    assert store.merge(again, "v")["changed"] == 0
    got = {(r["cat"], r["id"]): r["v"] for r in store.read().collect()}
    assert len(got) == store.read().count() == 3001 and sum(v == 2 for v in got.values()) == 1000 and (None, 0) in got


# ---------------------------------------------------------------- word overlap


def test_overlap_pairs_split_the_texts_once(spark, tmp_path):
    """The texts are read in one stage; the pairs come from their words among the items'."""
    items = spark.createDataFrame([(1, "a b c d"), (2, "x y z"), (3, "p q r s t"), (4, None)], "i long, t string")
    texts = ["A b\x1cC zz", "a b", "x Y z x", "x y z　é", "p q r", None, "", "s t P", "a\x1fb\x1dc d"]
    spark.createDataFrame(list(enumerate(texts)), "d long, t string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    out = C.word_overlap_pairs(items, "i", "t", docs, "d", "t", share=0.5)
    assert {tuple(r) for r in out.collect()} == {(1, 0, 3, 4), (1, 8, 4, 4), (2, 2, 3, 3), (2, 3, 3, 3), (3, 4, 3, 5), (3, 7, 3, 5)}
    assert not any("/docs/" in f for f in out.inputFiles())
