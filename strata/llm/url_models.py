"""URL filter: host and path rules, and a ratio of character language models for the rest.

Two variable-order Markov models over bytes, one of accepted and one of rejected
URLs, are counted over all URLs that a rule decides. A symbol's probability
interpolates the orders 0 to ``ORDER`` (Witten-Bell: an order's share grows with
what its context was seen to be followed by). Every n-gram counts, also those seen
once. The difference of both log-likelihoods for each symbol is calibrated to a
probability by a logistic curve over held-out ruled URLs, both classes weighing
the same; from 0.5 up (exclusive) an undecided URL is blocked.

Counting, calibration and judging are jobs over all rows. Up to ``GRAMS``
n-grams travel to the tasks whole. More stay a table: the URLs are dealt into
slots of bounded size, each slot asks for the n-grams and contexts that occur in
it, and is judged with the answers, which gives the same scores. What reaches
the driver is that small model at most, and a histogram.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import load, pick, save
from strata.llm.words import flat, runs

ORDER = 5
GRAMS = 1 << 17  #: n-grams that travel to the tasks whole; more are asked for by slots
SLOT_BYTES = 1 << 18  #: bytes of URLs in a slot; a longer URL is alone
FOLDS = 5  #: one of so many ruled URLs (by crc32 of the URL) calibrates, the others are counted
BINS = 256  #: calibration bins for each unit of log-likelihood
REACH = 16  #: calibration goes from -16 to 16

_END, _START, _BITS = 256, 257, 9
_SYMBOLS = 257

#: (host, path, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty where there is none."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(host: str, path: str) -> Column:
    return ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)


def with_rules(pages: DataFrame, rules: list) -> DataFrame:
    """host, path, and rule and verdict of the longest rule that fits (ties: the longer host, then block)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2] == "block")):
        rule = F.when(_fits(host, path), host + path).otherwise(rule)
        verdict = F.when(_fits(host, path), says).otherwise(verdict)
    d = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    return d.withColumn("rule", rule).withColumn("verdict", verdict)


def _grams(data: np.ndarray, off: np.ndarray):
    """For every symbol of every URL, its end mark included: one code of context and symbol for each order.

    A code holds the symbol lowest, the context above it, and the order on top.
    """
    n = len(off) - 1
    length = np.diff(off)
    pad = ORDER + 1
    starts = off[:-1] + np.arange(n) * pad
    symbols = np.full(len(data) + n * pad, _START, np.int64)
    body = np.arange(len(data)) + np.repeat(np.arange(n) * pad + ORDER, length)
    symbols[body] = data
    symbols[starts + ORDER + length] = _END
    real = np.flatnonzero(symbols != _START)
    codes, code = [], np.zeros(len(real), np.int64)
    for k in range(ORDER + 1):
        code = code | (symbols[real - k] << (_BITS * k))
        codes.append(code | (k << 60))
    return codes, np.concatenate([[0], np.cumsum(length + 1)])


def _count(batches):
    """(code, blocked, allowed) sums of the batches' n-grams."""
    for batch in batches:
        data, off = flat(batch.column("url"))
        block = batch.column("block").to_numpy(zero_copy_only=False)
        for a, b in runs(off):
            codes, at = _grams(data[off[a]:off[b]], off[a:b + 1] - off[a])
            mine = np.repeat(block[a:b], np.diff(at))
            code, back = np.unique(np.concatenate(codes), return_inverse=True)
            both = [np.bincount(back[np.tile(mine, ORDER + 1) == c], minlength=len(code)) for c in (True, False)]
            for x in range(0, len(code), 50_000):
                part = slice(x, x + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(code[part]), pa.array(both[0][part]), pa.array(both[1][part])], names=["code", "blocked", "allowed"])


class Models:
    """Counts of n-grams under both classes, by sorted code."""

    def __init__(self, code: np.ndarray, counts: np.ndarray):
        order = np.argsort(code)
        self.code, self.counts = code[order], counts[:, order].astype(np.float64)
        context = self.code >> _BITS
        self.contexts, back = np.unique(context, return_inverse=True)
        size = len(self.contexts)
        self.seen = np.stack([np.bincount(back, weights=c, minlength=size) for c in self.counts])
        self.kinds = np.stack([np.bincount(back, weights=c > 0, minlength=size) for c in self.counts])

    def differences(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """(log-likelihood as rejected minus as accepted) for each symbol of every URL."""
        codes, at = _grams(data, off)
        p = np.full((2, len(codes[0])), 1 / _SYMBOLS)
        if len(self.code):
            for code in codes:
                i = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
                j = np.minimum(np.searchsorted(self.contexts, code >> _BITS), len(self.contexts) - 1)
                here, known = self.code[i] == code, self.contexts[j] == code >> _BITS
                for c in (0, 1):
                    kinds = self.kinds[c][j] * known
                    p[c] = np.where(kinds > 0, (self.counts[c][i] * here + kinds * p[c]) / np.maximum(self.seen[c][j] * known + kinds, 1), p[c])
        return np.add.reduceat(np.log(p[0]) - np.log(p[1]), at[:-1]) / np.diff(at) if len(at) > 1 else np.zeros(0)


class Answered(Models):
    """The same from the answers to a slot: its n-grams and contexts, as far as they were seen."""

    def __init__(self, answers: pa.Table):
        key = answers.column("key").to_numpy()
        values = np.stack([answers.column(c).to_numpy().astype(np.float64) for c in ("b", "a", "kinds_b", "kinds_a")])
        key, first = np.unique(key, return_index=True)
        grams, contexts = first[key >= 0], first[key < 0][::-1]  # contexts are stored as -1 - context
        # an entry that no symbol meets keeps both lists from being empty
        self.code = np.concatenate([[-1], key[key >= 0]])
        self.counts = np.concatenate([np.zeros((2, 1)), values[:2, grams]], axis=1)
        self.contexts = np.concatenate([[-1], -1 - key[key < 0][::-1]])
        self.seen = np.concatenate([np.zeros((2, 1)), values[:2, contexts]], axis=1)
        self.kinds = np.concatenate([np.zeros((2, 1)), values[2:, contexts]], axis=1)


def _with_ratio(table, models: Models):
    """The columns of a batch or table but url, and the ratio."""
    data, off = flat(table.column("url"))
    parts = [models.differences(data[off[a]:off[b]], off[a:b + 1] - off[a]) for a, b in runs(off)]
    rest = [c for c in table.schema.names if c not in ("url", "slot")]
    return type(table).from_arrays([*[table.column(c) for c in rest], pa.array(np.round(np.concatenate([*parts, np.zeros(0)]), 9))], names=[*rest, "ratio"])


def _judge(models: Models):
    def run(batches):
        for batch in batches:
            yield _with_ratio(batch, models)

    return run


def _slots(batches):
    """The rows with the number of their slot: SLOT_BYTES of URLs that follow each other in a task."""
    slot, used = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        _, off = flat(batch.column("url"))
        mine = np.zeros(batch.num_rows, np.int64)
        for i, n in enumerate(np.diff(off).tolist()):
            used += n + 1
            if used > SLOT_BYTES:
                slot, used = slot + 1, n + 1
            mine[i] = slot
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(mine)], names=[*batch.schema.names, "slot"])


def _asked(batches):
    """(key, slot): the n-grams and contexts of each slot's URLs."""
    for batch in batches:
        data, off = flat(batch.column("url"))
        slots = batch.column("slot").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(slots)) + 1).tolist(), len(slots)]
        for a, b in zip(edges, edges[1:], strict=False):
            if a < b:
                codes, _ = _grams(data[off[a]:off[b]], off[a:b + 1] - off[a])
                code = np.unique(np.concatenate(codes))
                key = np.concatenate([-1 - np.unique(code >> _BITS), code])
                for x in range(0, len(key), 50_000):
                    part = key[x:x + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(len(part), slots[a]))], names=["key", "slot_r"])


def _answer(rows: pa.Table, answers: pa.Table) -> pa.Table:
    return _with_ratio(rows, Answered(answers))


def with_ratio(d: DataFrame, models: Models | DataFrame) -> DataFrame:
    """The columns of ``d`` but url, and ratio; ``models`` are in memory, or a table of (code, blocked, allowed) of any size."""
    fields = ", ".join(f"`{c}` {d.schema[c].dataType.simpleString()}" for c in d.columns if c != "url") + ", ratio double"
    if isinstance(models, Models):
        return d.mapInArrow(_judge(models), fields)
    staged = save(d.mapInArrow(_slots, ", ".join(f"`{c}` {d.schema[c].dataType.simpleString()}" for c in d.columns) + ", slot long"), "url-slots")
    zero = F.lit(0).cast("long")
    grams = models.select(F.col("code").alias("key"), F.col("blocked").alias("b"), F.col("allowed").alias("a"), zero.alias("kinds_b"), zero.alias("kinds_a"))
    contexts = models.groupBy((-1 - F.shiftright("code", _BITS)).alias("key")).agg(
        F.sum("blocked").alias("b"), F.sum("allowed").alias("a"), F.count_if(F.col("blocked") > 0).alias("kinds_b"), F.count_if(F.col("allowed") > 0).alias("kinds_a")
    )
    # both sides grow with the URLs, and small files may hold many n-grams: none is broadcast
    answers = staged.select("url", "slot").mapInArrow(_asked, "key long, slot_r long").join(grams.unionByName(contexts).hint("merge"), "key")
    return staged.groupBy("slot").cogroup(answers.groupBy("slot_r")).applyInArrow(_answer, fields)


def _logistic(x: np.ndarray, blocked: np.ndarray, allowed: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(rejected | x), both classes weighing 1 in all, slope at least 0; Newton steps with a small ridge."""
    w = np.concatenate([blocked / blocked.sum(), allowed / allowed.sum()])
    z = np.stack([np.concatenate([x, x]), np.ones(2 * len(x))])
    y = np.concatenate([np.ones(len(x)), np.zeros(len(x))])
    beta, ridge = np.zeros(2), np.diag([1e-4, 0.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(beta @ z, -30, 30)))
        grad = z @ (w * (q - y)) + ridge @ beta
        step = np.linalg.solve((z * (w * np.maximum(q * (1 - q), 1e-9))) @ z.T + ridge, grad)
        beta = beta - step * min(1.0, 5 / max(abs(step).max(), 1e-12))
        if abs(step).max() < 1e-10:
            break
    return max(float(beta[0]), 0.0), float(beta[1])


def fit(ruled: DataFrame, max_grams: int = GRAMS) -> tuple[Models | DataFrame, float, float] | None:
    """Models (above ``max_grams`` n-grams their table), slope and offset from (url, block boolean); None if either class has no URL."""
    held = F.pmod(F.crc32(F.col("url").cast("binary")), F.lit(FOLDS)) == 0
    learn = ruled.where(~held)
    grams = learn.mapInArrow(_count, "code long, blocked long, allowed long").groupBy("code").agg(F.sum("blocked").alias("blocked"), F.sum("allowed").alias("allowed"))
    grams = save(grams, "url-grams")
    size = grams.agg(F.count(F.lit(1)), F.sum("blocked"), F.sum("allowed")).first()
    if not size[1] or not size[2]:
        return None
    models = grams
    if size[0] <= max_grams:
        got = grams.toArrow()
        models = Models(got.column("code").to_numpy(), np.stack([got.column("blocked").to_numpy(), got.column("allowed").to_numpy()]))
    bins = with_ratio(ruled.where(held), models)
    x = F.floor(F.greatest(F.least("ratio", F.lit(float(REACH))), F.lit(-float(REACH))) * BINS)
    bins = bins.groupBy(x.alias("x")).agg(F.count_if("block").alias("b"), F.count_if(~F.col("block")).alias("a")).orderBy("x").collect()
    b, a = np.array([r["b"] for r in bins], float), np.array([r["a"] for r in bins], float)
    if not len(bins) or not b.sum() or not a.sum():  # nothing to calibrate with: the bare ratio
        return models, 1.0, 0.0
    return models, *_logistic((np.array([r["x"] for r in bins]) + 0.5) / BINS, b, a)


def judge_urls(pages: DataFrame, rules: list = RULES, keep: tuple = ("page_id",), max_grams: int = GRAMS) -> DataFrame:
    """``keep``, host, path, rule, verdict (allow or block) and score (probability of rejection by the models).

    ``pages`` has url and the columns ``keep``; ``rules`` are at most 1000
    (host, path, verdict). A rule fits its host and its subdomains where the
    path starts with the rule's; the longest wins (ties: the longer host, then
    block) and gives the verdict. Other URLs are blocked if score > 0.5. A null
    URL, or one without ://, has an empty host and path and fits no rule; the
    models judge it as the text it is, null as the empty one. Every row counts,
    repeated rows too. Without URLs of both classes all scores are 0.5, so what
    no rule blocks is allowed. An empty table gives no rows. The scores do not
    depend on the order or partitioning of the rows, nor on ``max_grams``, which
    says how many n-grams may travel to the tasks whole.
    """
    if len(rules) > 1000:
        raise ValueError("at most 1000 rules")
    d = with_rules(pick(pages, *keep, "url").toDF(*[f"keep_{i}" for i in range(len(keep))], "url"), rules)
    ruled = d.where("rule IS NOT NULL").select("url", (F.col("verdict") == "block").alias("block"))
    model = fit(ruled, max_grams)
    kept = [f"keep_{i}" for i in range(len(keep))]
    if model is None:
        d = d.withColumn("score", F.lit(0.5))
    else:
        models, slope, offset = model
        d = with_ratio(d, models)
        d = d.withColumn("score", F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("ratio") * slope + offset))), 9))
    verdict = F.coalesce("verdict", F.when(F.col("score") > 0.5, "block").otherwise("allow"))
    return d.select(*[F.col(c).alias(n) for c, n in zip(kept, keep, strict=True)], "host", "path", "rule", verdict.alias("verdict"), "score")


def op12_url_filter(spark, sf_dir: str) -> DataFrame:
    """Verdicts on the URLs of all ``pages``."""
    return judge_urls(load(spark, sf_dir, "pages"))
