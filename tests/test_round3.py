"""Value counts and sketches, samples of group rules, severities, generators, word overlap."""

import pytest
from pyspark.sql import functions as F

from strata.operators import distinct as D
from strata.operators.analytics import profile
from strata.operators.corpus import word_overlap_pairs
from strata.operators.quality import Check, check_table, failing_sample
from strata.plans.medallion import QualityError, bronze_to_silver, fresh_lake


@pytest.fixture(scope="module")
def mixed(spark):
    return spark.sql(
        "SELECT * FROM VALUES (1, 'a', 0.0D, X'00', array(1, null), named_struct('x', 1)), (1, 'a', -0.0D, X'00', array(1, null), named_struct('x', 1)), "
        "(2, '', double('NaN'), X'01', array(1), named_struct('x', null)), (null, null, null, null, null, null), (3, 'null', 1.5D, X'', array(), null) "
        "AS t(i, s, f, b, a, r)")


def test_column_counts(spark, mixed):
    got = {r["column_name"]: (r["rows"], r["nulls"], r["distinct"], r["repeated"]) for r in D.column_counts(mixed, mixed.columns).collect()}
    for c in ("i", "s", "f", "b", "a"):
        want = mixed.agg(F.count(F.lit(1)), F.count_if(F.col(c).isNull()), F.count_distinct(c)).first()
        assert got[c][:3] == tuple(want), c
    assert got["i"][3] == 1 and got["r"][1:] == (2, 2, 2)  # the null is a repeated value of r
    empty = D.column_counts(mixed.where("1 = 0"), ["i", "s"]).collect()
    assert sorted(tuple(r) for r in empty) == [("i", 0, 0, 0, 0), ("s", 0, 0, 0, 0)]
    assert "Expand" not in D.column_counts(mixed, mixed.columns)._jdf.queryExecution().executedPlan().toString()


def test_sketches_of_parts_merge(spark):
    df = spark.range(20_000).select((F.col("id") % 7000).alias("v"), (F.col("id") % 3).alias("day"), F.lit(None).cast("string").alias("n"))
    parts = D.column_sketches(df, ["v", "n"], F.col("day"))
    assert parts.count() == 6
    got = {r["column_name"]: r for r in D.merge_sketches(parts).collect()}
    assert got["v"]["rows"] == 20_000 and abs(got["v"]["distinct"] - 7000) < 210
    assert (got["n"]["nulls"], got["n"]["distinct"]) == (20_000, 0)
    assert profile(df, approx=True).count() == 3


def test_group_rules_share_one_pass_and_have_samples(spark):
    df = spark.createDataFrame([(i, i % 3 if i < 9 else None, "x" if i < 2 else f"u{i}") for i in range(12)], "id long, g long, s string")
    checks = [Check("g", "unique"), Check("s", "unique"), Check("id", "unique_strict"), Check("g", "unique_strict"), Check("id", "positive")]
    res = {(r["column_name"], r["rule"]): r["failed_rows"] for r in check_table(df, checks).collect()}
    assert res == {("g", "unique"): 4, ("s", "unique"): 1, ("id", "unique_strict"): 0, ("g", "unique_strict"): 9, ("id", "positive"): 1}
    rows = failing_sample(df, checks, ["id"], limit=2).collect()
    got = sorted((r["column_name"], r["rule"], r["value"] or "", r["sample_rank"], r["id"]) for r in rows)
    assert got == [("g", "unique", "", 1, 9), ("g", "unique", "", 2, 10), ("g", "unique", "0", 1, 0), ("g", "unique", "0", 2, 3),
                   ("id", "positive", "0", 1, 0), ("s", "unique", "x", 1, 0), ("s", "unique", "x", 2, 1)]
    assert failing_sample(df, [Check("id", "no_such_rule")], ["id"]).count() == 0


def test_error_severity_fails_the_job_and_leaves_silver(spark):
    lake = fresh_lake(spark, "t")
    good = spark.createDataFrame([(1, 5.0), (2, 6.0), (2, 6.0)], "id long, amount double")
    lake.write(good, "bronze", "sales")
    checks = [{"column": "amount", "rule": "positive", "severity": "error"}, {"column": "id", "rule": "unique", "severity": "error"}, {"column": "id", "rule": "not_null"}]
    rows, quality = bronze_to_silver(lake, "sales", checks=checks)
    assert rows == 2 and {r["check_key"]: r["failed_rows"] for r in quality.collect()} == {"amount.positive": 0, "id.unique": 0, "id.not_null": 0}
    lake.write(good.unionByName(spark.createDataFrame([(2, -1.0)], good.schema)), "bronze", "sales")
    with pytest.raises(QualityError) as e:
        bronze_to_silver(lake, "sales", checks=checks)
    assert e.value.failed == {"amount.positive": 1, "id.unique": 1}
    assert lake.table("silver", "sales").count() == 2 and lake.tables("silver") == ["sales"]
    rows, _ = bronze_to_silver(lake, "sales", checks=[{"column": "amount", "rule": "positive"}])  # a warning only counts
    assert rows == 3


def test_quarantine_severity_splits_rows(spark):
    lake = fresh_lake(spark, "t")
    lake.write(spark.createDataFrame([(1, 5.0), (2, -6.0), (None, -1.0), (None, 3.0)], "id long, amount double"), "bronze", "sales")
    checks = [{"column": "amount", "rule": "positive", "severity": "quarantine"}, {"column": "id", "rule": "not_null", "severity": "quarantine"}]
    rows, quality = bronze_to_silver(lake, "sales", checks=checks)
    assert rows == 1 and lake.table("silver", "sales").first()["id"] == 1
    assert "failed_rules" not in lake.table("silver", "sales").columns
    held = sorted((r["id"] or 0, r["failed_rules"]) for r in lake.table("silver", "sales_quarantine").collect())
    assert held == [(0, "amount.positive,id.not_null"), (0, "id.not_null"), (2, "amount.positive")]
    assert {r["check_key"]: r["failed_rows"] for r in quality.collect()} == {"amount.positive": 2, "id.not_null": 2}


def test_silver_is_measured_by_its_write(spark):
    lake = fresh_lake(spark, "t")
    lake.write(spark.range(100).withColumn("v", F.when(F.col("id") % 4 > 0, F.col("id"))), "bronze", "t")
    jobs = []
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("silver", "silver")
    _, quality = bronze_to_silver(lake, "t", checks=[{"column": "v", "rule": "not_null"}])
    jobs = tracker.getJobIdsForGroup("silver")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert quality.first()["failed_rows"] == 25 and len(jobs) <= 2  # the shuffle and the write of one job under AQE


def test_generated_rows(spark):
    from strata.sources import datagen as G

    keys = spark.range(3000)
    customers, products = G.generate_customers(keys, "id"), G.generate_products(keys.limit(40), "id")
    orders = G.generate_orders(keys, "id", customers, products)
    paid = G.generate_transactions(orders, keys=keys.limit(500), key="id")
    c = customers.collect()
    assert len({r["email"] for r in c}) == 3000 and {r["segment"] for r in c} == {s for s, _ in G.SEGMENTS}
    assert all((r["city"], r["state"]) in G.CITIES for r in c)
    assert all(5 <= r["price"] <= 500 and 0 <= r["stock"] <= 500 and r["category"] in G.CATEGORIES for r in products.collect())
    assert orders.join(products.select(F.col("id").alias("product_id"), "price"), "product_id").where("abs(total - price * qty) > 0.006").count() == 0
    assert paid.join(orders.select(F.col("id").alias("order_id"), "total"), "order_id").where("amount = total").count() == 500
    days = orders.agg(F.min("created_at"), F.max("created_at")).first()
    assert str(days[0]) >= "2023-01-01" and str(days[1]) <= "2023-12-31"
    assert G.generate_orders(keys.where("1 = 0"), "id", customers, products).count() == 0


@pytest.mark.parametrize("hot", [1, 2000])
def test_word_overlap_pairs(spark, hot):
    texts = ["the quick brown fox", "The lazy dog the THE", "quick brown dog jumps over the lazy fox", "the", None, "", "a b c d e f", "the quick the quick", "x y z"]
    items = ["quick brown fox dog", "the lazy dog", "the", "a b c x", None, "nobody has these words", "the the quick brown"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "the quick brown fox")], "doc_id long, text string")
    asked = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = sorted((r["item_id"], r["doc_id"], r["overlap"], r["item_words"]) for r in word_overlap_pairs(asked, "item_id", "text", docs, "doc_id", "text", share=0.6, least=2, hot=hot).collect())
    want = []
    for i, x in enumerate(items):
        w = set((x or "").lower().split())
        for d, t in enumerate(texts):
            n = len(w & set((t or "").lower().split()))
            if w and n >= max(2, 0.6 * len(w)):
                want.append((i, d, n, len(w)))
    assert got == sorted(want) and got
    assert word_overlap_pairs(asked.where("1 = 0"), "item_id", "text", docs, "doc_id", "text").count() == 0


def test_a_big_folder_is_read_by_several_tasks(spark):
    from strata.session import scratch_path
    from strata.sources import files as src

    root = scratch_path(spark, "t-tree")
    rows = spark.range(3000).select(F.concat(F.lit("one/"), F.col("id").cast("string"), F.lit(".md")).alias("rel"), F.encode(F.col("id").cast("string"), "utf-8").alias("content"))
    assert src.write_tree(rows, root) == 3000
    assert src.write_tree(rows.where("id < 5"), root) == 5  # a task that runs again changes nothing
    read = src.read_files(src.list_tree(spark, root, "*.md")).withColumn("task", F.spark_partition_id())
    sizes = [r["count"] for r in read.groupBy("task").count().collect()]
    assert sum(sizes) == 3000 and len(sizes) > 4 and max(sizes) < 1000
    assert read.where("content <> encode(regexp_extract(rel, '([0-9]+)', 1), 'utf-8')").count() == 0
    assert src.list_tree(spark, root + "/missing").count() == 0


def test_csv_with_quoted_newlines_keeps_its_records(spark):
    import os

    from strata.session import local_path, scratch_path
    from strata.sources.files import read_csv

    root = local_path(scratch_path(spark, "t-csv"))
    os.makedirs(root)
    for name, text in (("plain.csv", 'id,note\n1,"a ""quoted"" word"\n2,b\n'), ("lines.csv", 'id,note\n1,"two\nlines, ""here"""\n2,b\n')):
        with open(f"{root}/{name}", "w") as f:
            f.write(text)
    assert [tuple(r) for r in read_csv(spark, f"{root}/plain.csv").orderBy("id").collect()] == [(1, 'a "quoted" word'), (2, "b")]
    assert [tuple(r) for r in read_csv(spark, f"{root}/lines.csv").orderBy("id").collect()] == [(1, 'two\nlines, "here"'), (2, "b")]
    assert read_csv(spark, f"{root}/lines.csv", multi_line=False).count() == 3


def test_catalog_numbers_follow_each_key(spark):
    from strata.operators.records import ordered_catalog

    rows = [("a", i % 7, i, f"e{i}") for i in range(200)] + [("b", 1, 500, "x"), ("c", 1, 501, "y"), ("c", 0, 502, "z")]
    got = ordered_catalog(spark.createDataFrame(rows, "domain string, ts int, id int, entry string"), "domain", ["ts", "id"]).collect()
    want = {}
    for key in "abc":
        mine = sorted((t, i) for d, t, i, _ in rows if d == key)
        want |= {i: (key, k + 1, len(mine)) for k, (_, i) in enumerate(mine)}
    assert {r["id"]: (r["domain"], r["entry_no"], r["domain_entries"]) for r in got} == want


def test_whole_word_keywords(spark):
    from strata.operators.corpus import classify_frame

    df = spark.createDataFrame([(1, "the author"), (2, "auth failed"), (3, "re-auth, now"), (4, "AUTH"), (5, "oauth_token")], "id int, t string")
    anywhere = {r["id"]: r["category"] for r in classify_frame(df, "id", "t").collect()}
    words = {r["id"]: r["category"] for r in classify_frame(df, "id", "t", whole_words=True).collect()}
    assert anywhere == dict.fromkeys(range(1, 6), "critical")
    assert words == {1: "advisory", 2: "critical", 3: "critical", 4: "critical", 5: "advisory"}
