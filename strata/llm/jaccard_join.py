"""N-gram Jaccard self-join of texts under several global token orders.

Two sets whose Jaccard similarity is at least t share a token among the first
|s| - ceil(t |s|) + 1 tokens of each under ANY global token order. Each order
filters alone; a candidate has to pass all of them before its sets are compared.

- Texts with equal shingle sets form a class; classes stand for their members.
- Order 1 puts tokens of one text only first, then rare before frequent, then by
  hash. Counting needs no text numbers: every slot of texts sends its tokens as
  sorted 32-bit keys to buckets and gets their counts back (equal keys of
  different tokens share a count, which is still one order for all). A text
  whose prefix is all its own has no partner; most texts end here.
- Classes that survive are linked to the smallest class with an equal minimum
  token under a few hashes, if the exact similarity allows. That joins large
  groups of near copies by one comparison for each member.
- A token of order 1 then proposes pairs only if its classes lie in different
  components, and only pairs across components; in a crowd, first with one class
  after the other, until that links nothing more. Orders 2 and 3 (by other
  hashes) must confirm such a pair; then the sets are compared exactly.

Only connectivity is returned, so no link between different components is lost,
and no group's pairs are ever listed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import components, discard, load, pick, save
from strata.llm.slots import ANSWERS, KEYS, bucketed, distinct, emit, stage_texts
from strata.llm.words import mix, shingle_sets

THRESHOLD = 80  #: percent
LEADERS = 4  #: hashes whose smallest token finds a leader
CROWD = 64  #: classes with one prefix token, beyond which links are sought through single classes first
SPREAD = 1000  #: members compared with one copy of a leader's set
_ORDER = [np.uint64(x) for x in np.random.default_rng(5).integers(1, 2**63, LEADERS + 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)]


def prefix_length(n, percent: int):
    """|s| - ceil(t |s|) + 1, for a number or an array."""
    return n - (percent * n + 99) // 100 + 1


def digest(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        a, b = mix(s ^ _ORDER[0]).sum(dtype=np.uint64), mix(s ^ _ORDER[1]).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _signed(s: np.ndarray) -> np.ndarray:
    return s.view(np.int64)


def _members(batches):
    for batch in batches:
        rows = [(len(s), *digest(s)) for s in shingle_sets(batch.column("text"))]
        columns = np.array(rows, np.int64).reshape(-1, 3).T
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns)], names=["doc_id", "n", "d1", "d2"])


def _slot_sets(table):
    """The rows with a text, and their shingle sets, in a fixed order."""
    table = table.combine_chunks()
    own = np.flatnonzero(table["text"].is_valid().to_numpy())
    own = own[np.argsort(table["uid"].to_numpy()[own])]
    return table["uid"].to_numpy()[own], list(shingle_sets(table["text"].take(pa.array(own))))


def _slot_counts(sets: list, buckets: int):
    """The distinct keys of a slot in order: buckets, keys, in how many of its texts each stands (up to 255), and for
    every token of the sets the number of its key."""
    bucket, key, order = bucketed(mix(np.concatenate([*sets, np.zeros(0, np.uint64)])), buckets, 32)
    first = distinct(bucket, key)
    many = np.diff(np.append(first, len(key)))
    of = np.empty(len(key), np.int64)
    of[order] = np.repeat(np.arange(len(first)), many)
    return bucket[first], key[first], np.minimum(many, 255).astype(np.uint8), of


def _counts(_, table):
    """How many texts have each key of a bucket, up to 255; every slot sends a key once, with its own count behind the keys."""
    table = table.combine_chunks()
    raw = table["keys"].to_pylist()
    n = [len(x) // 5 for x in raw]
    keys = np.concatenate([np.frombuffer(x, np.uint32, k) for x, k in zip(raw, n, strict=True)])
    many = np.concatenate([np.frombuffer(x, np.uint8, k, 4 * k) for x, k in zip(raw, n, strict=True)])
    _, back = np.unique(keys, return_inverse=True)
    total = np.minimum(np.bincount(back, weights=many), 255).astype(np.uint8)
    parts = np.split(total[back], np.cumsum(n)[:-1])
    return table.drop_columns(["keys"]).append_column("bits", pa.array([p.tobytes() for p in parts], pa.binary()))


SETS = "cid long, n long, alone long, s binary, prefix array<long>, least array<long>"


def _survivors(buckets: int, percent: int):
    """Sets and prefixes of the classes whose prefix under order 1 holds a token of another text.

    ``answers`` has the counts (phase 1) and, of each class whose representative
    is in the slot, its doc_id and digest (phase 0).
    """

    def run(key, table, answers):
        uids, sets = _slot_sets(table)
        own = answers.filter(pc.equal(answers["phase"], 0))
        speaks = dict(zip(own["bucket"].to_pylist(), own["bits"].to_pylist(), strict=True))
        answers = answers.filter(pc.equal(answers["phase"], 1))
        ids: dict = {}
        for i, u in zip(table["doc_id"].to_pylist(), table["uid"].to_pylist(), strict=True):
            if i in speaks:
                ids.setdefault(u, []).append(i)
        bucket, _, _, of = _slot_counts(sets, buckets)
        got = dict(zip(answers["bucket"].to_pylist(), answers["bits"].to_pylist(), strict=True))
        ranked = [np.frombuffer(got[b], np.uint8) for b in np.unique(bucket).tolist()]
        count = np.concatenate([*ranked, np.zeros(0, np.uint8)])[of]
        cols: dict = {c.split()[0]: [] for c in SETS.split(", ")}
        at = 0
        for uid, s in zip(uids.tolist(), sets, strict=True):
            c = count[at:at + len(s)]
            at += len(s)
            p = prefix_length(len(s), percent)
            shared = np.flatnonzero(c > 1)
            room = p - (len(s) - len(shared))
            if room <= 0 or not len(shared) or uid not in ids:
                continue
            name = str(digest(s)[0]).encode()
            cid = [i for i in ids[uid] if speaks[i] == name]  # a doc_id may stand for another text elsewhere
            if not cid:
                continue
            first = shared[np.lexsort((s[shared], c[shared]))][:room]
            row = [cid[0], len(s), len(s) - len(shared), s.tobytes(), _signed(s[first]), [int(mix(s * m).min().astype(np.int64)) for m in _ORDER[:LEADERS]]]
            for column, value in zip(cols, row, strict=True):
                cols[column].append(value)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), *[pa.list_(pa.int64())] * 2]
        return pa.table({name: pa.array(v, k) for (name, v), k in zip(cols.items(), kinds, strict=True)})

    return run


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    at = np.minimum(np.searchsorted(b, a), max(len(b) - 1, 0))
    common = int((b[at] == a).sum()) if len(b) else 0
    return 100 * common >= percent * (len(a) + len(b) - common)


def _prefix_under(s: np.ndarray, order: np.uint64, percent: int) -> np.ndarray:
    o = np.sort(mix(s * order))
    return o[:prefix_length(len(s), percent)]


def _with_leader(percent: int, orders: tuple):
    """Rows come sorted so that a copy of the leader's set stands before its members.

    A member is compared if its prefixes under all ``orders`` meet the leader's.
    """

    def run(batches):
        head, s, prefixes = None, None, []
        for batch in batches:
            a, b = [], []
            for leader, part, cid, raw in zip(*[batch.column(c).to_pylist() for c in ("leader", "part", "cid", "s")], strict=True):
                x = np.frombuffer(raw, np.uint64)
                if cid == leader:
                    head, s = (leader, part), x
                    prefixes = [_prefix_under(s, o, percent) for o in orders]
                elif head == (leader, part) and all(np.isin(_prefix_under(x, o, percent), p).any() for o, p in zip(orders, prefixes, strict=True)):
                    if similar(s, x, percent):
                        a.append(cid)
                        b.append(leader)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def near_duplicate_texts(docs: DataFrame, percent: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", staged: tuple | None = None) -> DataFrame:
    """Components of texts linked by 100 * |A and B| >= percent * |A or B| over 5-word shingles.

    Returns doc_id, n_shingles and component_id (smallest doc_id reachable,
    itself included), one row for each doc_id. Texts without words (null, empty,
    blank) have no shingles and link with nothing. Repeated rows count once; of
    different texts with one doc_id the one with the smallest digest counts.
    Rows without doc_id are left out; an empty table gives no rows. ``staged`` is
    what ``stage_texts`` made of the rows with doc_id, if the caller has it.
    """
    texts = pick(docs, id_col, text_col).toDF("doc_id", "text").where("doc_id IS NOT NULL")
    texts = texts.select(F.col("doc_id").cast("long"), "text")
    rows = texts.mapInArrow(_members, "doc_id long, n long, d1 long, d2 long")
    members = rows.groupBy("doc_id").agg(F.min(F.struct("d1", "d2", "n")).alias("k"))
    members = save(members.select("doc_id", "k.d1", "k.d2", "k.n"), "members")
    classes = save(members.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("cid")), "classes")

    mine = staged is None
    staged, buckets = stage_texts(texts) if mine else staged

    def tokens(key, table):
        _, sets = _slot_sets(table)
        bucket, keys, many, _ = _slot_counts(sets, buckets)
        out = emit(key[0].as_py(), 1, bucket, keys, np.uint32)
        edges = np.flatnonzero(np.diff(bucket)) + 1
        behind = [m.tobytes() for m in np.split(many, edges)] if len(many) else []
        joined = [k + m for k, m in zip(out["keys"].to_pylist(), behind, strict=True)]
        return out.set_column(3, "keys", pa.array(joined, pa.binary()))

    own = staged.where("text IS NOT NULL")
    counts = own.groupBy("slot").applyInArrow(tokens, KEYS).groupBy("bucket").applyInArrow(_counts, ANSWERS)
    speaks = staged.select("slot", "doc_id").distinct().join(classes.select(F.col("cid").alias("doc_id"), "d1"), "doc_id")
    speaks = speaks.select("slot", F.lit(0).alias("phase"), F.col("doc_id").alias("bucket"), F.col("d1").cast("string").cast("binary").alias("bits"))
    answers = counts.unionByName(speaks).toDF("slot_r", "phase", "bucket", "bits")
    sets = save(staged.groupBy("slot").cogroup(answers.groupBy("slot_r")).applyInArrow(_survivors(buckets, percent), SETS), "sets")
    prefix = sets.select("cid", "n", "alone", F.posexplode("prefix").alias("i", "token")).select("token", "cid", "n", (F.col("alone") + F.col("i")).alias("at"))
    several = prefix.groupBy("token").agg(F.min("cid").alias("a"), F.max("cid").alias("b")).where("a <> b").select("token")
    prefix = save(prefix.join(several, "token"), "prefix")

    discard(*[staged] * mine)
    links = save(_cross_links(prefix, sets, _leader_links(sets, percent), percent), "links")
    discard(sets, prefix)
    component = components(links).toDF("cid", "component")
    of_class = classes.join(component, "cid", "left").select("d1", "d2", "n", F.coalesce("component", "cid").alias("component"))
    out = members.join(of_class, ["d1", "d2", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _leader_links(sets: DataFrame, percent: int) -> DataFrame:
    """Links of classes to the smallest class with an equal minimum token."""
    least = sets.select("cid", F.posexplode("least").alias("k", "m"))
    leaders = least.groupBy("k", "m").agg(F.min("cid").alias("leader"), F.max("cid").alias("last")).where("leader <> last")
    follow = least.join(leaders, ["k", "m"]).where("cid <> leader").select("cid", "leader").distinct()
    return _compare(save(follow, "follow"), sets, percent, ())


def _compare(pairs: DataFrame, sets: DataFrame, percent: int, orders: tuple) -> DataFrame:
    """The links among pairs (cid, leader); large groups meet several copies of their leader's set."""
    parts = pairs.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / SPREAD).cast("int").alias("parts"))
    raw = sets.select("cid", "s")
    member = pairs.join(parts, "leader").join(raw, "cid").select(
        "leader", F.expr("pmod(xxhash64(cid), parts)").cast("int").alias("part"), "cid", "s")
    head = parts.join(raw.withColumnRenamed("cid", "leader"), "leader").select(
        "leader", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("leader").alias("cid"), "s")
    met = member.unionByName(head).withColumn("follows", F.col("cid") != F.col("leader"))
    met = met.repartition("leader", "part").sortWithinPartitions("leader", "part", "follows")
    return save(met.mapInArrow(_with_leader(percent, orders), "a long, b long"), "compared")


def _mixed(prefix: DataFrame, component: DataFrame) -> DataFrame:
    """Rows of the tokens whose classes lie in different components."""
    rows = prefix.join(component.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    mixed = rows.groupBy("token").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("token")
    return save(rows.join(mixed, "token").select("token", "cid", "n", "at", "component"), "mixed")


def _cross_links(prefix: DataFrame, sets: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """``links``, and those between classes of different components that share prefix tokens under every order.

    While a token stands in many classes, each token's classes are first compared
    with one of them, another one every time, and what they link is contracted:
    as long as that finds links, the pairs of a crowd need not be looked at.
    """
    # the first common token stands first in both; what follows it bounds the common tokens.
    # Later ones have a smaller bound, so a pair passes exactly if one of its rows does.
    bound = f"least(n - at, n2 - at2) * {100 + percent} >= {percent} * (n + n2)"
    orders, turn = tuple(_ORDER[LEADERS:]), 0
    while True:
        component = components(links)
        rows = _mixed(prefix, component)
        crowds = rows.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.min_by("cid", F.struct(F.xxhash64("cid", F.lit(turn)), "cid")).alias("cid2")).where(f"size > {CROWD}")
        crowds = save(crowds.select("token", "cid2"), "crowds")
        if not crowds.limit(1).count():
            break
        head = rows.join(crowds, "token").where("cid = cid2").select("token", "cid2", F.col("n").alias("n2"), F.col("at").alias("at2"), F.col("component").alias("component2"))
        near = rows.join(head, "token").where(f"component <> component2 AND {bound}").select("cid", F.col("cid2").alias("leader")).distinct()
        found = _compare(save(near, "near"), sets, percent, orders)
        discard(rows, crowds)
        turn += 1
        if not found.limit(1).count():
            rows = _mixed(prefix, component)
            break
        links = links.unionByName(found)
    other = rows.toDF("token", "cid2", "n2", "at2", "component2")
    near = rows.join(other, "token").where(f"cid < cid2 AND component <> component2 AND {bound}")
    near = save(near.select(F.col("cid2").alias("cid"), F.col("cid").alias("leader")).distinct(), "near")
    discard(rows, component)
    return links.unionByName(_compare(near, sets, percent, orders))


def op5_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """All whole texts of ``documents`` at a similarity of 80 percent."""
    return near_duplicate_texts(load(spark, sf_dir, "documents"))
