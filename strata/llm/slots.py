"""Texts hashed into slots, and keys that travel between slots and buckets.

``stage_texts`` writes the texts once, bucketed by slot, so that later passes
group them by slot without another shuffle. Equal texts of a slot are kept
once; slots are salted, so that a text repeated any number of times does not
fill one. A pass over the slots sends its keys as one sorted binary array for
each bucket; the bucket's task answers key by key, in the same order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import shuffle_width, written
from strata.session import scratch_path

SLOT_BYTES = 1 << 20  #: mean text bytes in a slot
BUCKET_BYTES = 8 << 20  #: text bytes for each bucket of keys
SALTS = 64  #: slots among which equal texts are spread


def _keep_once(batches):
    """Rows come sorted by (slot, text key, text): equal texts follow each other; later ones lose their text."""
    last, uid = None, -1
    for batch in batches:
        slots = batch.column("slot").to_pylist()
        texts = batch.column("text").to_pylist()
        uids, kept = [], []
        for slot, text in zip(slots, texts, strict=True):
            if last == (slot, text):
                kept.append(None)
            else:
                last, uid = (slot, text), uid + 1
                kept.append(text)
            uids.append(uid)
        rest = [c for c in batch.schema.names if c not in ("slot", "doc_id", "text")]
        yield pa.RecordBatch.from_arrays([batch.column("slot"), batch.column("doc_id"), pa.array(uids, pa.int64()), pa.array(kept, pa.string()), *[batch.column(c) for c in rest]],
                                         names=["slot", "doc_id", "uid", "text", *rest])


def stage_texts(texts: DataFrame, slot_bytes: int = SLOT_BYTES, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, int]:
    """(slot, doc_id, uid, text, further columns) for (doc_id long, text, further columns), and the number of key buckets.

    A row whose text stands in its slot already has a null text and the uid of
    the row that has it; of equal texts the row with the smallest doc_id has it
    (null first). Null texts are empty.
    """
    spark = texts.sparkSession
    rest = [c for c in texts.columns if c not in ("doc_id", "text")]
    texts = texts.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *rest)
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).collect()[0]["n"]
    slots, buckets = total // slot_bytes + 1, total // bucket_bytes + 1
    parts = max(shuffle_width(spark), total // (16 << 20))
    texts = texts.withColumn("key", F.xxhash64("text"))
    texts = texts.withColumn("slot", F.pmod(F.xxhash64("key", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))), F.lit(slots)).cast("int"))
    ordered = texts.repartition(parts, "slot").sortWithinPartitions("slot", "key", "text", "doc_id").select("slot", "doc_id", "text", *rest)
    fields = "".join(f", {c} {texts.schema[c].dataType.simpleString()}" for c in rest)
    once = ordered.mapInArrow(_keep_once, f"slot int, doc_id long, uid long, text string{fields}")
    path = scratch_path(spark, "slots")
    name = "slots_" + path.rsplit("-", 1)[1]
    once.write.bucketBy(parts, "slot").sortBy("slot").option("path", path).option("compression", "zstd").saveAsTable(name)
    written(path, name)
    staged = spark.table(name)
    staged.scratch = path
    return staged, buckets


def _rows_of(columns: list[str]):
    def run(_, table, ids):
        table = table.combine_chunks()
        here = pc.and_(pc.is_in(table["doc_id"], value_set=ids["doc_id"].combine_chunks()), table["text"].is_valid())
        return table.filter(here).select(columns)

    return run


def rows_of(staged: DataFrame, ids: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of the staged rows with (slot, doc_id) among ``ids`` that have their text; the texts are not shuffled."""
    schema = ", ".join(f"{c} {staged.schema[c].dataType.simpleString()}" for c in columns)
    return staged.groupBy("slot").cogroup(ids.toDF("slot_r", "doc_id").groupBy("slot_r")).applyInArrow(_rows_of(columns), schema)


def bucketed(h: np.ndarray, buckets: int, bits: int):
    """Buckets and keys of 64-bit hashes in sorted order, and that order; 32-bit keys are the low half."""
    bucket = (h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    key = h if bits == 64 else (h & np.uint64(0xFFFFFFFF))
    order = np.lexsort((key, bucket))
    return bucket[order].astype(np.int64), key[order], order


def emit(slot: int, phase: int, bucket, key, kind):
    """One row for each bucket: its keys as bytes."""
    edges = np.flatnonzero(np.diff(bucket)) + 1
    groups = np.split(key, edges) if len(key) else []
    names = [int(bucket[0]), *bucket[edges].tolist()] if len(key) else []
    return pa.table({
        "slot": pa.array([slot] * len(names), pa.int32()), "phase": pa.array([phase] * len(names), pa.int32()),
        "bucket": pa.array(names, pa.int64()), "keys": pa.array([g.astype(kind).tobytes() for g in groups], pa.binary())})


def distinct(bucket: np.ndarray, key: np.ndarray) -> np.ndarray:
    """First places of the distinct (bucket, key) pairs, which are in order."""
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])
    return np.flatnonzero(first)


KEYS = "slot int, phase int, bucket long, keys binary"
ANSWERS = "slot int, phase int, bucket long, bits binary"
