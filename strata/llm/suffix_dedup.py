"""Removal of repeated byte strings by bucketed suffix sorting over a difference cover.

Only suffixes that can start a repeated string are sorted, bucket by bucket:

1. Sample. D is a difference cover modulo V: for any two positions there is a
   shift below V that brings both residues into D. Two occurrences of a string
   of LENGTH bytes therefore have sample positions at one shift below V, from
   where at least LENGTH - V + 1 bytes agree. Sample suffixes are ranked by
   those first bytes in buckets; a sample position is kept if its key repeats.
2. Suffixes. Only a position with a repeated sample position less than V bytes
   on can start a repeated string. These suffixes are sorted, again one bucket
   at a time, by a key of their first LENGTH bytes; equal keys are repeats.
   The sample thus decides the ties of all other suffixes without sorting them.
3. Bytes covered by a repeated string are removed from the texts.

Keys are 64-bit fingerprints (sample: 32 bits within a bucket, a filter only).
Texts are written once, hashed into slots, with equal texts of a slot kept once
(slots are salted, so a text repeated any number of times does not fill one);
keys travel as sorted binary arrays for each slot and bucket, answers as bits.
Slots and buckets are of bounded size whatever the size of the corpus.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import load, pick, save
from strata.llm.slots import ANSWERS, BUCKET_BYTES, KEYS, SLOT_BYTES, bucketed, emit, stage_texts
from strata.llm.words import flat, mix, powers

LENGTH = 200  #: bytes
# A perfect difference set; every residue modulo 133 is a difference of two of its elements.
V, COVER = 133, (1, 10, 11, 13, 27, 31, 68, 75, 83, 110, 115, 121)
_STEP = 1 << 20

_BASE = int(powers(2)[1])
_BYTE = np.random.default_rng(40).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def window_hashes(data: np.ndarray, length: int, at: np.ndarray) -> np.ndarray:
    """Fingerprints of data[i:i + length] for sorted positions ``at``; memory for one step of the data."""
    out = np.zeros(len(at), np.uint64)
    if not len(at):
        return out
    size = min(_STEP, len(data)) + length
    up = powers(size)
    down = np.full(size, pow(_BASE, -1, 2**64), np.uint64)
    down[:1] = 1
    down = np.multiply.accumulate(down)
    for start in range(0, len(data), _STEP):
        lo, hi = np.searchsorted(at, [start, start + _STEP])
        if lo == hi:
            continue
        part = data[start:start + _STEP + length]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * up[:len(part)], out=total[1:])
        i = at[lo:hi] - start
        out[lo:hi] = (total[i + length] - total[i]) * down[i]
    return mix(out)


class Slot:
    """The distinct texts of a slot in one array, with the positions that matter."""

    def __init__(self, table, length: int, v: int, cover: tuple, buckets: int):
        table = table.combine_chunks()
        own = np.flatnonzero(table["text"].is_valid().to_numpy()) if table.num_rows else np.zeros(0, int)
        order = own[np.argsort(table["uid"].to_numpy()[own])]
        self.uids = table["uid"].to_numpy()[order]
        self.data, self.off = flat(table["text"].take(pa.array(order)))
        self.length, self.v, self.buckets = length, v, buckets
        last = np.repeat(self.off[1:], np.diff(self.off))
        place = np.arange(len(self.data))
        self.fits = place + length <= last  # a whole string starts here inside its text
        residue = np.zeros(v, bool)
        residue[list(cover)] = True
        short = length - v + 1
        since = place - np.repeat(self.off[:-1], np.diff(self.off))
        self.sample = np.flatnonzero(residue[since % v] & (place + short <= last))
        self.short = short

    def sample_keys(self):
        return bucketed(window_hashes(self.data, self.short, self.sample), self.buckets, 32)

    def suffixes(self, repeated: np.ndarray) -> np.ndarray:
        """Starts of strings with a repeated sample position less than ``v`` bytes on."""
        mark = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(mark, np.maximum(repeated - self.v + 1, 0), 1)
        np.add.at(mark, repeated + 1, -1)
        return np.flatnonzero((np.cumsum(mark[:-1]) > 0) & self.fits)

    def suffix_keys(self, starts):
        return bucketed(window_hashes(self.data, self.length, starts), self.buckets, 64)


def _bits(slot: Slot, answers, phase: int, bucket) -> np.ndarray:
    """Answers of all buckets, in the sorted order of the slot's keys."""
    out = np.zeros(len(bucket), bool)
    for k, b, raw in zip(answers["phase"].to_pylist(), answers["bucket"].to_pylist(), answers["bits"].to_pylist(), strict=True):
        if k == phase:
            lo, hi = np.searchsorted(bucket, [b, b + 1])
            out[lo:hi] = np.unpackbits(np.frombuffer(raw, np.uint8), count=hi - lo).astype(bool)
    return out


def _repeats(_, table):
    """Which keys of a bucket occur more than once, in any slot."""
    table = table.combine_chunks()
    kind = np.uint32 if table["phase"][0].as_py() == 1 else np.uint64
    keys = [np.frombuffer(x, kind) for x in table["keys"].to_pylist()]
    everything = np.concatenate(keys)
    order = np.argsort(everything, kind="stable")
    ranked = everything[order]
    same = ranked[1:] == ranked[:-1]
    hit = np.zeros(len(ranked), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    parts = np.split(hit, np.cumsum([len(k) for k in keys])[:-1])
    return table.drop_columns(["keys"]).append_column("bits", pa.array([np.packbits(p).tobytes() for p in parts], pa.binary()))


def repeated_strings(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", v: int = V, cover: tuple = COVER,
                     slot_bytes: int = SLOT_BYTES, bucket_bytes: int = BUCKET_BYTES, with_text: bool = False) -> DataFrame:
    """Removes every byte covered by a ``length``-byte string that starts elsewhere, too.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if
    ``with_text``, kept (the remaining bytes). Matches stay inside a text;
    overlaps count; strings are judged on the input. Null texts are empty. Every
    row is a text of its own, so a repeated row is found elsewhere; rows without
    doc_id take part in matching and are returned. Empty tables give no rows.
    """
    if length <= v:
        raise ValueError("length must be larger than v")
    texts = pick(docs, id_col, text_col).toDF("doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    staged, buckets = stage_texts(texts, slot_bytes, bucket_bytes)

    def first(key, table):
        bucket, keys, _ = Slot(table, length, v, cover, buckets).sample_keys()
        return emit(key[0].as_py(), 1, bucket, keys, np.uint32)

    def second(key, table, answers):
        slot = Slot(table, length, v, cover, buckets)
        bucket, _, order = slot.sample_keys()
        starts = slot.suffixes(np.sort(slot.sample[order[_bits(slot, answers, 1, bucket)]]))
        return emit(key[0].as_py(), 2, *slot.suffix_keys(starts)[:2], np.uint64)

    def third(key, table, answers):
        slot = Slot(table, length, v, cover, buckets)
        bucket, _, order = slot.sample_keys()
        starts = slot.suffixes(np.sort(slot.sample[order[_bits(slot, answers, 1, bucket)]]))
        bucket, _, order = slot.suffix_keys(starts)
        repeated = starts[order[_bits(slot, answers, 2, bucket)]]
        mark = np.zeros(len(slot.data) + 1, np.int32)
        mark[repeated] += 1
        np.add.at(mark, repeated + length, -1)
        gone = np.cumsum(mark[:-1]) > 0
        results = {}
        ids, uids = table["doc_id"].to_pylist(), table["uid"].to_pylist()
        several = {}
        for u in uids:
            several[u] = several.get(u, 0) + 1
        out = {"doc_id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
        for k, u in enumerate(slot.uids.tolist()):
            lo, hi = int(slot.off[k]), int(slot.off[k + 1])
            g = np.ones(hi - lo, bool) if several[u] > 1 and hi - lo >= length else gone[lo:hi]
            kept = slot.data[lo:hi][~g].tobytes()
            spans = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum())
            results[u] = (hi - lo, int(g.sum()), spans, hashlib.sha256(kept).hexdigest(), kept)
        for i, u in zip(ids, uids, strict=True):
            for name_, value in zip(out, (i, *results[u]), strict=True):
                out[name_].append(value)
        kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        made = pa.table({c: pa.array(x, t) for (c, x), t in zip(out.items(), kinds, strict=True)})
        return made if with_text else made.drop_columns(["kept"])

    own = staged.where("text IS NOT NULL")
    answers = own.groupBy("slot").applyInArrow(first, KEYS).groupBy("bucket").applyInArrow(_repeats, ANSWERS)
    sample = save(answers, "sample")
    right = sample.toDF("slot_r", "phase", "bucket", "bits")
    answers = own.groupBy("slot").cogroup(right.groupBy("slot_r")).applyInArrow(second, KEYS).groupBy("bucket").applyInArrow(_repeats, ANSWERS)
    both = sample.unionByName(save(answers, "suffix")).toDF("slot_r", "phase", "bucket", "bits")
    columns = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return staged.groupBy("slot").cogroup(both.groupBy("slot_r")).applyInArrow(third, columns)


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """All whole texts of ``documents``, strings of 200 bytes."""
    return repeated_strings(load(spark, sf_dir, "documents"))
