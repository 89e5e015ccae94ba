"""The pipeline's stages on awkward tables, long words, and results that do not depend on partitions."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.llm.common import pick

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, DOC_ID string, extra int"


def rows():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(200)]
    out = [" ".join(rng.choice(words) for _ in range(rng.randint(6, 60))) for _ in range(60)]
    out += [out[0], out[0], out[1] + " and", out[2].upper(), None, "", "  \n", "one two", "password = hunter2abcXY9 " + " ".join(words[:30])]
    return [(i, t, "en" if i % 2 else "de", f"s{i % 3}" if i % 5 else None, len(t or ""), "clash", 1) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def saved(df, tmp_path, name):
    df.write.parquet(str(tmp_path / name))
    return df.sparkSession.read.parquet(str(tmp_path / name))


def test_near_duplicates_with_and_without_repeated_ids_agree(spark, docs):
    import corpus_pipeline as P

    plain = P.near_duplicates(spark, docs, "")
    assert plain.columns == P.COLUMNS
    one = sorted(map(tuple, plain.collect()), key=repr)
    same = P._near_duplicates_of_repeated_ids(pick(docs, *P.COLUMNS), F.col("text").isNull() | ~F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    assert one == sorted(map(tuple, same.collect()), key=repr)
    kept = {r[0] for r in one}
    assert {60, 61, 62, 63}.isdisjoint(kept) and {64, 65, 66, 67}.issubset(kept) and len(one) == 65


def test_near_duplicates_of_rows_that_share_an_id(spark, docs):
    import corpus_pipeline as P

    text = rows()[5][1]
    more = spark.createDataFrame([(5, text, "en", "s1", 1, "x", 1), (5, "other words that resemble nothing else in here", "en", "s1", 1, "x", 1), (None, text, "en", "s1", 1, "x", 1)], SCHEMA)
    got = P.near_duplicates(spark, docs.union(more), "").where("doc_id = 5 OR doc_id IS NULL").collect()
    assert sorted((r["doc_id"] or -1, r["text"] == text) for r in got) == [(-1, True), (5, False), (5, True)]


def test_stages_on_an_empty_table_and_with_clashing_columns(spark, docs, tmp_path):
    import corpus_pipeline as P

    empty = docs.where("1 = 0")
    for name, stage in P.STAGES:
        assert stage(spark, empty, "").count() == 0, name
    after = docs
    for k, (name, stage) in enumerate(P.STAGES):
        after = saved(stage(spark, after, ""), tmp_path, f"{k}-{name}")
        assert name == "tokens" or after.columns == P.COLUMNS
    masked = after.where("doc_id = 68")
    assert masked.count() >= 0 and after.where("n_tokens <> size(ids)").count() == 0


def test_stages_delete_scratch_of_the_stages_before(spark, docs, tmp_path):
    import corpus_pipeline as P
    from strata.llm import common

    first = saved(P.near_duplicates(spark, docs, ""), tmp_path, "first")
    assert [e for e in common._WRITTEN if e[2] == "pipeline"]
    second = P.secrets(spark, first, "")
    assert not [e for e in common._WRITTEN if e[2] == "pipeline"]
    assert second.count() == first.count()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("slots_")]


def test_a_stage_keeps_what_its_input_still_reads(spark, docs):
    import corpus_pipeline as P

    lazy = P.near_duplicates(spark, docs, "")  # not written: reads the scratch of its stage
    assert P.secrets(spark, lazy, "").count() == 65


def test_the_plan_gives_the_mix(spark, docs):
    from strata.llm import mixing as M

    plain = pick(docs, "doc_id", "text", "source")
    twice = plain.unionByName(plain.where("doc_id < 10"))
    per_row = {(r["doc_id"], r["size"]): r["copies"] for r in M.mix_sources(twice).collect()}
    sized = twice.withColumn("size", M.words_in(F.col("text")))
    planned = M.with_plan(sized, M.mix_plan(twice), "source").select("doc_id", "size", M.copies(M.draw(F.col("doc_id"), F.col("size"))).alias("copies")).collect()
    assert len(planned) == twice.count() and all(per_row[r["doc_id"], r["size"]] == r["copies"] for r in planned)
    assert M.mix_plan(twice).count() == 4  # one row for each source, null too


def test_transition_logs_do_not_depend_on_partitions(spark, docs):
    from strata.llm.secrets import find_secrets, transition_logs

    texts = docs.select("text")
    assert (transition_logs(texts.coalesce(1)) == transition_logs(texts.repartition(9))).all()
    one, many = ([tuple(r) for r in find_secrets(d).orderBy("doc_id", "start").collect()] for d in (docs.coalesce(1), docs.repartition(9)))
    assert one == many and one


def test_long_unbroken_words():
    import sentencepiece

    from strata.llm.pieces import MODEL, Encoder, Vocabulary

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    encoder = Encoder(Vocabulary.read(MODEL))
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60_000)), "a" * 30_000, "ab" * 9000, "x" * 2100 + " " + "y" * 4096,
             "é漢a€zq" * 3000, "w" * 33, "q" * 40 + " " + "r" * 70, "z" * 2048, "z" * 2049]
    began = time.time()
    got = encoder.encode(texts)
    assert time.time() - began < 60
    for ids, t in zip(got, texts, strict=True):
        assert ids.tolist() == model.encode(t)
        assert encoder.decode(ids.tolist()) == t


def test_pairs_merged_together_equal_pairs_merged_alone(monkeypatch):
    from strata.llm import pieces as P

    v = P.Vocabulary.read(P.MODEL)
    encoder = P.Encoder(v)
    rng = np.random.default_rng(2)
    known = np.array(list(v.id.values()))
    left, right = rng.choice(known, 1500), rng.choice(known, 1500)
    left[:100] = -1
    got = encoder._merge_pairs(left, right)
    for a, b, ok in zip(left.tolist(), right.tolist(), got.tolist(), strict=True):
        parts = ([v.pieces[a]] if a >= 0 else []) + [v.pieces[b]]
        assert ok == (encoder.merge("".join(parts)) == parts)
    monkeypatch.setattr(P, "WORDS", 64)  # a memory that is full all the time
    words = ["".join(rng.choice(list("abcde"), 6)) for _ in range(400)]
    small = P.Encoder(v)
    monkeypatch.setattr(P, "RUN_CHARS", 200)
    text = [" ".join(rng.choice(words, 9)) for _ in range(60)]
    assert [x.tolist() for x in small.encode(text)] == [x.tolist() for x in encoder.encode(text)]
    assert len(small.seen) <= 64


def test_crowds_are_contracted(spark, monkeypatch):
    from strata.llm import jaccard_join as J

    rng = random.Random(7)
    core = [f"c{i}" for i in range(200)]
    texts = []
    for _ in range(90):  # near copies of one text; two of them need not be similar
        w = list(core)
        for _ in range(3):
            w[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    texts.insert(70, " ".join(core))
    texts += [" ".join([*core[:100], *[f"u{k}_{i}" for i in range(100)]]) for k in range(20)]  # half in common only
    sets = [{tuple(t.split()[i:i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    comp = list(range(len(texts)))
    for _ in texts:
        new = [min([comp[i], *(comp[j] for j in range(len(texts)) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]))]) for i in range(len(texts))]
        if new == comp:
            break
        comp = new
    monkeypatch.setattr(J, "CROWD", 4)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in J.near_duplicate_texts(df).collect()}
    assert got == dict(enumerate(comp)) and len(set(comp)) < 60
