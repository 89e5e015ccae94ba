"""Ranked search, periodic runs and URL models against brute force on small tables."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, TEXT_ string, rank int, item_id long"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


# ------------------------------------------------------------------ ranked search


def search_texts():
    rng = random.Random(4)
    words = ["alpha", "Beta", "gamma", "délta", "ÉTA", "x9", "of", "the", "ab", "abc", "bc", "漢字", "a\x00b", "snake_case"]
    out = [rng.choice([" ", ", ", "\n", "-"]).join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(80)]
    return [*out, None, "", " .,;\x00", out[0], out[0], "alphabet alphaalpha", "q" * 5000 + " alpha " + "the " * 3000, "É" * 70]


def ranked(texts, items, k=10):
    docs = {i: TERM.findall(lower(t)) for i, t in texts}
    n_docs, length = sum(bool(t) for t in docs.values()), sum(map(len, docs.values()))
    out = []
    for item in sorted({i for i, _ in items}):
        terms = {t for i, x in items if i == item for t in TERM.findall(lower(x))}
        df = {t: sum(t in d for d in docs.values()) for t in terms}
        scores = []
        for i, d in docs.items():
            m = 10 + 90 * len(d) * n_docs // length if length else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * d.count(t) // (1000 * d.count(t) + 8 * m)) for t in terms if t in d)
            if s > 0:
                scores.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return out


ITEMS = [(1, "Alpha the the gamma"), (2, "délta, éta! 漢字"), (3, "nothing-here zzz"), (4, None), (5, "abc bc"), (5, "x9"), (6, "q" * 5000), (7, "a b snake case É")]


@pytest.mark.parametrize("item_bytes", [1 << 20, 2000])
def test_ranked_search(spark, item_bytes):
    from strata.llm.lexical import rank_documents

    texts = list(enumerate(search_texts()))
    docs = spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in texts], DOCS).repartition(3)
    items = spark.createDataFrame([(i, t, "clash") for i, t in ITEMS], "item_id long, text string, doc_id string")
    got = sorted((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in rank_documents(docs, items, item_bytes=item_bytes).collect())
    assert got == ranked(texts, ITEMS)
    assert rank_documents(docs.where("1 = 0"), items).count() == 0
    assert rank_documents(docs, items.where("1 = 0")).count() == 0


def test_ranked_search_rows_without_id_and_repeated_rows(spark):
    from strata.llm.lexical import rank_documents

    docs = spark.createDataFrame([(None, "alpha"), (3, "alpha"), (3, "alpha"), (1, "alpha"), (9, "other words")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "alpha"), (None, "ALPHA")], "item_id long, text string")
    rows = sorted(rank_documents(docs, items, k=3).collect(), key=lambda r: r["rank"])
    assert [(r["item_id"], r["rank"], r["doc_id"]) for r in rows] == [(None, 1, 1), (None, 2, 3), (None, 3, 3)]


def test_automaton_blocks_lanes_and_long_words(monkeypatch):
    from strata.llm import automaton as A

    rng = np.random.default_rng(1)
    for trial in range(60):
        monkeypatch.setattr(A, "BLOCK", int(rng.integers(40, 400)))
        monkeypatch.setattr(A, "LANES", int(rng.integers(1, 50)))
        texts = ["".join(rng.choice(list("abAé  .1\x00"), int(rng.integers(0, 60)))) for _ in range(int(rng.integers(1, 12)))]
        texts += ["a" * 500 + " b " + "ab" * 300] if trial % 3 == 0 else []
        terms = sorted({w for t in texts for w in A.terms_of(t) if rng.random() < 0.5 and len(w) < 30} | {b"zz"})
        raw = [t.encode() for t in texts]
        off = np.cumsum([0, *[len(x) for x in raw]])
        n, doc, term, tf = A.Automaton(terms).counts(np.frombuffer(b"".join(raw), np.uint8), off)
        want = {}
        for i, t in enumerate(texts):
            for w in A.terms_of(t):
                if w in terms:
                    want[i, terms.index(w)] = want.get((i, terms.index(w)), 0) + 1
        assert n.tolist() == [len(A.terms_of(t)) for t in texts]
        assert dict(zip(zip(doc.tolist(), term.tolist(), strict=True), tf.tolist(), strict=True)) == want


# ------------------------------------------------------------------ periodic runs


def brute_runs(w, least=6, times=4):
    n, seen = len(w), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i:
                seen.setdefault((i, j + q - i), q)  # the smallest period of these words comes first
            i = j + 1
    return sorted((s, length, q) for (s, length), q in seen.items() if length >= max(least, times * q))


def brute_lyndon(s):
    out = []
    for i in range(len(s)):
        j = i + 1
        while j < len(s) and s[j:] > s[i:]:
            j += 1
        out.append(j - i)
    return out


def collapsed(w, runs):
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(x for i, x in enumerate(w) if i not in drop)


def periodic(rng, n, k):
    w = [rng.randrange(k) for _ in range(n)]
    if n > 3 and rng.random() < 0.6:
        a = rng.randrange(n)
        p = rng.randint(1, max(1, (n - a) // 3))
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_lyndon_arrays_and_runs():
    from strata.llm.word_runs import find_runs, lyndon_lengths

    rng = random.Random(5)
    for _ in range(1500):
        w = periodic(rng, rng.randint(0, 40), rng.randint(1, 4))
        number = {c: i for i, c in enumerate(sorted(set(w)))}
        s = [number[c] for c in w]
        assert lyndon_lengths(s) == brute_lyndon(s)
        assert find_runs(w) == brute_runs(w)
    w = [bin(i).count("1") % 2 for i in range(600)] + [0] * 30
    assert find_runs(w) == brute_runs(w)


def run_texts():
    rng = random.Random(6)
    out = [rng.choice([" ", "\n", "\t "]).join(f"w{c}" for c in periodic(rng, rng.randint(0, 120), rng.choice([1, 2, 5, 60]))) for _ in range(120)]
    return [*out, None, "", " \t\n ", "One one One one One one One one", "É é É é É é É é É", out[3], out[3], "z" * 3000, " ".join(["ha", "ho", "hi"] * 5000)]


def test_word_runs(spark):
    from strata.llm.word_runs import word_runs

    texts = run_texts()
    docs = spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in [*enumerate(texts), (None, "a a a a a a"), (0, texts[0])]], DOCS).repartition(3)
    rows = [(r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in word_runs(docs).collect()]
    assert len(rows) == len(texts) + 2 and (None, [(0, 6, 1)], "a") in rows
    for i, runs, text in rows:
        if i is not None:
            w = WORD.findall(texts[i] or "")
            want = brute_runs(w) if len(w) < 1000 else [(0, 15000, 3)]
            assert runs == want and text == collapsed(w, want)
    assert word_runs(docs.where("1 = 0")).count() == 0


def test_op11_query(spark, tmp_path):
    from strata.llm.word_runs import op11_word_runs

    rng = random.Random(7)
    texts = [" ".join(f"w{rng.randrange(9)}" for _ in range(rng.randint(0, 90))) for _ in range(300)] + [None, "  "]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: tuple(r) for r in op11_word_runs(spark, str(tmp_path)).collect()}
    some = 0
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        h, n = zlib.crc32(str(i).encode()), len(w)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[j if j < a else a + (j - a) % p] for j in range(n)]
        runs = brute_runs(w)
        some += bool(runs)
        best = min(((-length, s, q) for s, length, q in runs), default=None)
        head = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        assert got[i] == (i, len(runs), *head, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(w, runs).encode()).hexdigest())
    assert some > 10


# ------------------------------------------------------------------ URL models


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return lower(host), re.match(r"[^?#]*", rest[len(host):]).group()


def rule_of(url, rules):
    host, path = split_url(url)
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = ["http://a.example.net/en/1", "HTTPS://A.Example.NET/en/1?x=/de/", "http://net/", "http://net", "http://xnet/", "http://a.net:80/", "ftp://b.org/fr/2#top", "b.org/fr/2", "http://example.com/de/",
        "http://notexample.com/de/", "http://www.example.com/DE/", "http://u@example.net/en/", "x://y://example.net/en/", "http://é.org/fr/é", "http://a.net/\n/en/", "://net/", "", None, "http://", "http://x?://net/"]


def test_url_parts_and_rules(spark):
    from strata.llm.url_models import RULES, judge_urls

    pages = spark.createDataFrame([(i, u, "clash", "h") for i, u in enumerate([*URLS, URLS[0]])], "page_id long, url string, HOST string, rule string")
    got = {r["page_id"]: r for r in judge_urls(pages).collect()}
    assert len(got) == len(URLS) + 1
    for i, u in enumerate([*URLS, URLS[0]]):
        rule, verdict = rule_of(u, RULES)
        assert (got[i]["host"], got[i]["path"]) == split_url(u), u
        assert got[i]["rule"] == rule and (verdict is None or got[i]["verdict"] == verdict), u
        assert got[i]["verdict"] in ("allow", "block") and 0 <= got[i]["score"] <= 1
    assert judge_urls(pages.where("1 = 0")).count() == 0
    only = judge_urls(pages.where("page_id IN (4, 7)")).collect()  # no rule fits: nothing to learn from
    assert {(r["verdict"], r["score"]) for r in only} == {("allow", 0.5)}


def test_models_equal_a_plain_computation():
    from strata.llm import url_models as U

    urls = [b"abab", b"", b"abcabc", b"\xc3\xa9a"]
    blocked = [True, False, True, False]
    data, off = np.frombuffer(b"".join(urls), np.uint8), np.cumsum([0, *[len(u) for u in urls]])
    codes, at = U._grams(data, off)
    flat, mine = np.concatenate(codes), np.tile(np.repeat(blocked, np.diff(at)), U.ORDER + 1)
    code = np.unique(flat)
    counts = np.stack([[int(((flat == c) & (mine == side)).sum()) for c in code] for side in (True, False)])
    got = U.Models(code, counts).differences(data, off)

    def symbols(u):
        return [U._START] * U.ORDER + list(u) + [U._END]

    def probability(side, context, symbol):
        p = 1 / 257
        for k in range(U.ORDER + 1):
            c = context[len(context) - k:]
            seen = [s[i] for u, b in zip(urls, blocked, strict=True) if b == side for s in [symbols(u)] for i in range(U.ORDER, len(s)) if s[i - k:i] == c]
            if seen:
                p = (seen.count(symbol) + len(set(seen)) * p) / (len(seen) + len(set(seen)))
        return p

    for u, x in zip(urls, got, strict=True):
        s = symbols(u)
        want = [math.log(probability(True, s[i - U.ORDER:i], s[i]) / probability(False, s[i - U.ORDER:i], s[i])) for i in range(U.ORDER, len(s))]
        assert abs(x - sum(want) / len(want)) < 1e-9
    total = sum(probability(True, [U._START] * 3 + [97, 98], s) for s in range(257))
    assert abs(total - 1) < 1e-9


def test_url_models_learn_and_do_not_depend_on_partitions(spark):
    from strata.llm.url_models import judge_urls

    rng = random.Random(8)

    def url(bad):
        name = "".join(rng.choice(["win", "cash", "pill", "bonus"] if bad else ["news", "school", "garden", "library"]) for _ in range(3))
        host = f"{name}.example.{'net' if bad else 'org'}" if rng.random() < 0.5 else f"{name}.info"
        return f"http://{host}/{'de' if bad else 'fr'}/{rng.randrange(1000)}"

    rows = [(i, url(i % 2 == 0)) for i in range(1500)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    one = {r["page_id"]: tuple(r) for r in judge_urls(pages.coalesce(1)).collect()}
    many = {r["page_id"]: tuple(r) for r in judge_urls(pages.repartition(7)).collect()}
    assert one == many
    free = [r for r in one.values() if r[3] is None]
    assert len(free) > 500 and sum((r[4] == "block") == (r[0] % 2 == 0) for r in free) / len(free) > 0.97


def test_few_grams_still_judge(spark):
    from strata.llm.url_models import judge_urls

    rows = [(i, f"http://h{i}.net/en" if i % 2 else f"http://h{i}.org/fr/") for i in range(200)]
    got = judge_urls(spark.createDataFrame(rows, "page_id long, url string"), max_grams=40)
    assert got.where(F.col("rule").isNotNull() & ~F.col("verdict").isin("allow", "block")).count() == 0 and got.count() == 200
