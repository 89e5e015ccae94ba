"""Periodic runs of words: Lyndon factors by Baier's grouping, extended to runs.

Every run holds an occurrence of its Lyndon root that is the longest Lyndon word
at its place under some order of the words or under the reverse order. Phase one
of Baier's suffix sorter groups the suffixes by exactly that longest Lyndon
prefix, so its group widths are the Lyndon array: one pass under either order
gives all roots. A root whose length stands again one root further on is
extended by the longest common extensions to both sides.

A run of q words and at least four times as many has all its word triples again q
words away. Places whose triple has no equal within a quarter of their stretch
can be in no run; hashes of triples remove them before any sorting, for all
texts of a batch at once, and only the stretches that remain are grouped, by the
words themselves.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import load, pick
from strata.llm.words import flat, mix, runs, word_hashes, word_spans

LEAST, TIMES = 6, 4  #: a run has so many words at least, and so many periods
GRAM = 3
_PLACE = np.random.default_rng(31).integers(1, 2**63, GRAM + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def lyndon_lengths(s: list[int]) -> list[int]:
    """Length of the longest Lyndon word at every place of s (numbers 0 .. m without gaps), by phase one of Baier's sorter.

    Groups of suffixes are taken from the highest down. A group's members point
    at the nearest place before them that is in a lower group; the places
    pointed at leave their groups for new ones just above, more pointers higher,
    and their Lyndon prefix grows by the group's for every pointer.
    """
    n, k = len(s), max(s, default=-1) + 1
    group, members = list(s), [[] for _ in range(k)]
    for i, c in enumerate(s):
        members[c].append(i)
    width, size = [1] * k, [len(m) for m in members]
    below, above = list(range(-1, k - 1)), [*range(1, k), -1]
    up = list(range(n + 1))  # up[i + 1]: the nearest place up to i that is not taken yet, plus 1
    lengths = [0] * n
    g = k - 1
    while g >= 0:
        w = width[g]
        here = [i for i in members[g] if group[i] == g]
        members[g] = []
        for i in here:
            up[i + 1] = i
            lengths[i] = w
        pointed: dict[int, int] = {}
        for i in here:
            r = i
            while up[r] != r:
                r = up[r]
            while up[i] != r:
                up[i], i = r, up[i]
            if r:
                pointed[r - 1] = pointed.get(r - 1, 0) + 1
        leave: dict[tuple[int, int], list[int]] = {}
        for j, times in pointed.items():
            leave.setdefault((-times, group[j]), []).append(j)
        for times, old in sorted(leave):
            moved = leave[times, old]
            wide = width[old] - times * w
            if len(moved) == size[old]:  # all that is left of the group: it stays where it is
                width[old] = wide
                continue
            new = len(width)
            width.append(wide)
            size.append(len(moved))
            size[old] -= len(moved)
            members.append(moved)
            for j in moved:
                group[j] = new
            top = above[old]
            below.append(old)
            above.append(top)
            above[old] = new
            if top >= 0:
                below[top] = new
        g = below[g]
    return lengths


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common prefix."""
    n, at, step = min(len(a), len(b)), 0, 16
    while at < n:
        differ = a[at:min(at + step, n)] != b[at:min(at + step, n)]
        if differ.any():
            return at + int(differ.argmax())
        at, step = at + step, step * 4
    return n


def find_runs(words: list, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least max(least, times * period) words, sorted; times >= 3."""
    number = {w: k for k, w in enumerate(sorted(set(words)))}
    s = [number[w] for w in words]
    a, n, found = np.array(s), len(s), set()
    for seq in (s, [len(number) - 1 - c for c in s]):
        length = np.array(lyndon_lengths(seq), np.int64)
        after = np.arange(n) + length
        # of at least three roots in a row, two have the root's length
        roots = np.flatnonzero((after < n) & (length[np.minimum(after, n - 1)] == length))
        reach: dict[int, int] = {}
        for i, q in zip(roots.tolist(), length[roots].tolist(), strict=True):
            if i + 2 * q <= reach.get(q, 0):
                continue
            end = i + q + _common(a[i:], a[i + q:])
            start = i - _common(a[:i][::-1], a[:i + q][::-1])
            reach[q] = end
            if end - start >= max(least, times * q):
                found.add((start, end - start, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _nearest_equal(key: np.ndarray) -> np.ndarray:
    """Distance from every place to the nearest equal key."""
    out = np.full(len(key), np.iinfo(np.int64).max)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    left, right = order[:-1][same], order[1:][same]
    gap = right - left
    out[right] = gap
    out[left] = np.minimum(out[left], gap)
    return out


def _stretches(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 word of the stretches that may hold runs; every run lies within one."""
    n = len(hashes) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = doc[:n].astype(np.uint64) * _PLACE[GRAM]
    for k in range(GRAM):
        key = key + hashes[k:n + k] * _PLACE[k]
    near = _nearest_equal(mix(key))
    place = np.flatnonzero((near < n) & (doc[:n] == doc[GRAM - 1:]))
    while len(place):
        cut = np.flatnonzero((np.diff(place) != 1) | (np.diff(doc[place]) != 0)) + 1
        first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(place)]])
        words = last - first + GRAM - 1
        keep = np.repeat(words >= LEAST, last - first) & (near[place] <= np.repeat(words // TIMES, last - first))
        if keep.all():
            return place[first], place[last - 1] + GRAM
        place = place[keep]
    return np.zeros(0, np.int64), np.zeros(0, np.int64)


def _texts_runs(raw: list[bytes], data: np.ndarray, off: np.ndarray):
    """For every text: its runs, and its words without the repeats."""
    starts, ends, doc = word_spans(data, off)
    if not len(starts):
        return [([], b"")] * len(raw)
    first, last = _stretches(word_hashes(data, starts, ends), doc)
    count = np.bincount(doc, minlength=len(raw))
    base = np.cumsum(count) - count
    mine = {}
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        mine.setdefault(int(doc[a]), []).append((a, b))
    out = []
    for i, text in enumerate(raw):
        words = text.split()
        found = []
        for a, b in mine.get(i, ()):
            at = a - int(base[i])
            found += [(at + s, length, q) for s, length, q in find_runs(words[at:at + b - a])]
        if found:
            found.sort(key=lambda r: (r[0], r[2]))
            change = Counter()
            for s, length, q in found:
                change[s + q] += 1
                change[s + length] -= 1
            kept, at, depth = [], 0, 0
            for p in sorted(change):
                if not depth:
                    kept += words[at:p]
                depth, at = depth + change[p], p
            words = kept + words[at:]
        out.append((found, b" ".join(words)))
    return out


RUNS = "array<struct<start:long,length:long,period:long>>"
_STRUCT = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _run(batches):
    for batch in batches:
        data, off = flat(batch.column("text"))
        for a, b in runs(off):
            part, o = data[off[a]:off[b]], off[a:b + 1] - off[a]
            raw = part.tobytes()
            done = _texts_runs([raw[x:y] for x, y in zip(o[:-1], o[1:], strict=True)], part, o)
            found = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r, _ in done]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], pa.array(found, _STRUCT), pa.array([t for _, t in done], pa.binary()).cast(pa.string())],
                                             names=["doc_id", "runs", "collapsed"])


def word_runs(docs: DataFrame) -> DataFrame:
    """doc_id, the runs of every whole text (by start, then period), and the text without repeats.

    Words are maximal runs of characters other than blanks (0x20, 0x09 to 0x0D).
    A run is a stretch of words with smallest period q, at least max(6, 4 q)
    words, that no neighbouring word extends. ``collapsed`` joins by one blank
    the words that no run contains after its first q words. Null, empty and
    blank texts have no runs and an empty ``collapsed``. Rows are judged each by
    itself, so repeated rows give equal rows; an empty table gives none. Nothing
    is shuffled. A very long text needs about 100 bytes of memory for each of
    its words.
    """
    return pick(docs, "doc_id", "text").mapInArrow(_run, f"doc_id long, runs {RUNS}, collapsed string")


def _repeated(words: Column, g: Column) -> Column:
    """Words from a = g % n on repeat the p = 1 + (n - a) div (3 + g % 8) words there."""

    def again(w):
        n = F.size(w).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        # a one-element array carries a and p into the inner function, so that they are computed once
        return F.transform(F.array(F.struct(a.alias("a"), p.alias("p"))), lambda x: F.array_join(
            F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, F.when(i < x["a"], i).otherwise(x["a"] + (i - x["a"]) % x["p"]).cast("int"))), " "))[0]

    return F.transform(F.array(words), again)[0]


def repeated_texts(docs: DataFrame) -> DataFrame:
    """doc_id and text; where crc32 of the decimal doc_id is divisible by 10, the text's end is made periodic."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    some = (h % 10 == 0) & F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    return pick(docs, "doc_id", "text").select("doc_id", F.when(some, _repeated(words, F.floor(h / 10).cast("long"))).otherwise(F.col("text")).alias("text"))


def op11_word_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of all whole texts of ``documents``, a tenth of them made periodic first."""
    out = word_runs(repeated_texts(load(spark, sf_dir, "documents")))
    # structs compare field by field: longest first, then smallest start, then period
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("short"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    out = out.withColumn("best", best)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.short")).alias("length"), F.col("best.period").alias("period"),
        F.expr("(1000 * -best.short) div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
