"""Structured Streaming jobs: harvest, de-duplication, liveness sessions,
quality routing and windowed event counts.

Every job reads a file source, keeps its progress in a checkpoint under the
cluster's shared folder, and writes with an idempotent sink: ``foreachBatch``
overwrites the folder of its epoch, so a replayed epoch (after an executor or
driver loss) replaces its own output instead of duplicating it. Sinks that
update keys (harvest, counts) fold finished epochs into a versioned store every
few epochs, while the stream goes on; readers merge the store with the epochs
after it, so their cost does not grow with the number of epochs.

``run_available`` drives a query with ``trigger(availableNow=True)``: all data
present at start is processed (in several micro-batches), then it stops.
Event-time columns are cast to TIMESTAMP because watermarks reject
TIMESTAMP_NTZ.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.time import epoch_us, utc_instant
from strata.operators.quality import Check, row_condition
from strata.operators.records import upsert_latest
from strata.session import scratch_path
from strata.sources.store import VersionedStore, delete_path, names_in


ROWS_PER_FILE = 1_000_000


def land_slices(df: DataFrame, ts_col: str, directory: str, slices: int = 4, least_files: int = 3, again: Column | None = None) -> int:
    """Write ``df`` as it would arrive: one append for each of ``slices`` equal stretches of time, oldest first.

    A slice has as many files as its rows need (``least_files`` at least), and
    its rows are spread over them in no order, so a stream sees disorder of up
    to one slice. Rows for which ``again`` holds arrive a second time with the
    slice after theirs. Returns the length of a slice in seconds.
    """
    us = epoch_us(F.col(ts_col))
    lo, hi = df.agg(F.min(us), F.max(us)).collect()[0]
    if lo is None:
        df.limit(0).write.mode("append").parquet(directory)
        return 1
    width = (hi - lo) // slices + 1
    d = df.withColumn("_slice", F.floor((us - lo) / width))
    sizes = {r["_slice"]: r["count"] for r in d.groupBy("_slice").count().collect()}  # one row for each slice
    for k in range(slices + (again is not None)):
        part = d.where(F.col("_slice") == k)
        if again is not None:
            part = part.unionByName(d.where((F.col("_slice") == k - 1) & again))
        rows = sizes.get(k, 0) + (sizes.get(k - 1, 0) if again is not None else 0)
        if rows:
            part.drop("_slice").repartition(max(least_files, rows // ROWS_PER_FILE)).write.mode("append").parquet(directory)
    return width // 1_000_000 + 1


def land_marker(df: DataFrame, ts_col: str, directory: str, seconds: int) -> None:
    """Append one row with only a time, ``seconds`` after the latest: the end of a finite stream.

    The watermark passes everything before it, so all that is open is closed.
    """
    last = df.agg(F.max(ts_col).alias(ts_col)).select((F.col(ts_col) + F.expr(f"INTERVAL '{seconds}' SECOND")).alias(ts_col))
    row = last.select(*[F.col(ts_col) if f.name == ts_col else F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields])
    row.write.mode("append").parquet(directory)


def file_stream(spark: SparkSession, directory: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(directory)


def run_available(writer, checkpoint: str):
    """Run to completion; returns the finished query (its progress tells the state's size)."""
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return q


def start_every(writer, checkpoint: str, interval: str = "300 seconds"):
    """Start a long-running query with a processing-time trigger (the harvest
    cadence of a daemon); returns the StreamingQuery for the caller to manage."""
    return writer.option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def _epoch_writer(out_dir: str, fmt: str = "parquet") -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").format(fmt).save(f"{out_dir}/batch_id={epoch_id}")

    return write


def with_event_time(df: DataFrame, ts_col: str, as_col: str = "event_time") -> DataFrame:
    """Watermarks need TIMESTAMP; wall-clock NTZ values are read as UTC, so the
    result does not depend on the session time zone."""
    return df.withColumn(as_col, utc_instant(F.col(ts_col)))


def _read_epochs(spark: SparkSession, out_dir: str, schema: T.StructType) -> DataFrame:
    """All epochs of an append sink; no rows where no epoch was written."""
    if not names_in(spark, out_dir):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema.add("batch_id", T.LongType()) if "batch_id" not in schema.names else schema).parquet(out_dir).drop("batch_id")


class EpochStore:
    """Keyed rows from a stream: a folder for each epoch, folded into a versioned store as it grows.

    The last epoch's row of a key wins. ``write`` overwrites its own epoch only.
    ``compact`` merges epochs that can no longer be replayed into the store and
    publishes rows and the last folded epoch together; folders are deleted one
    compaction later, so that a reader of the version before still finds them.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, keys: list[str], partition_by: list[str] | None = None, buckets: int = 1, every: int = 8):
        self.spark, self.root, self.keys, self.every = spark, root, keys, every
        self.schema = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
        self.store = VersionedStore(spark, f"{root}/base", self.schema, keys, partition_by, buckets)

    def write(self, batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.root}/epochs/batch_id={epoch}")
        if self.every and epoch % self.every == self.every - 1:
            self.compact(epoch - 1)

    def _after(self, folded: int, upto: int | None = None) -> DataFrame:
        epochs = sorted(int(n.split("=")[1]) for n in names_in(self.spark, f"{self.root}/epochs"))
        paths = [f"{self.root}/epochs/batch_id={e}" for e in epochs if e > folded and (upto is None or e <= upto)]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("basePath", f"{self.root}/epochs").parquet(*paths).select(*self.schema.names)

    def folded(self) -> int:
        return self.store.manifest()["note"].get("folded", -1)

    def compact(self, upto: int) -> None:
        """Fold the epochs up to ``upto``; all of them must be committed."""
        folded = self.folded()
        if upto <= folded:
            return
        self.store.merge(self._after(folded, upto), "batch_id", {"folded": upto})
        for name in names_in(self.spark, f"{self.root}/epochs"):
            if int(name.split("=")[1]) <= folded:
                delete_path(self.spark, f"{self.root}/epochs/{name}")
        self.store.vacuum(keep=2)

    def read(self) -> DataFrame:
        version = self.store.version()
        rows = self._after(self.store.manifest(version)["note"].get("folded", -1))
        both = self.store.read(version).unionByName(rows)
        return upsert_latest(both.limit(0), both, self.keys, "batch_id").select(*self.schema.names).drop("batch_id")


# ---------------------------------------------------------------- R8 harvest


def harvest_store(spark: SparkSession, source: DataFrame, transform: Callable[[DataFrame], DataFrame], keys: list[str], root: str,
                  partition_by: list[str] | None = None, every: int = 8) -> EpochStore:
    schema = transform(spark.createDataFrame([], source.schema)).schema
    return EpochStore(spark, f"{root}/store", schema, keys, partition_by, every=every)


def _harvest_writer(source: DataFrame, transform: Callable[[DataFrame], DataFrame], store: EpochStore):
    return source.writeStream.foreachBatch(lambda batch, epoch: store.write(transform(batch), epoch))


def read_harvest_store(spark: SparkSession, store: str, keys: list[str]) -> DataFrame:
    """Current records of a harvest's ``store`` folder: the latest epoch of each key."""
    stored = spark.read.parquet(f"{store}/epochs").drop("batch_id")
    return EpochStore(spark, store, stored.schema, keys).read()


def start_harvest(source: DataFrame, transform: Callable[[DataFrame], DataFrame], root: str, interval: str = "300 seconds",
                  keys: list[str] | None = None, partition_by: list[str] | None = None, every: int = 8):
    """Continuous harvest every ``interval``; read results with ``read_harvest_store``.

    With ``keys``, finished epochs are folded into a keyed table every few
    epochs; without them, epochs pile up until a reader merges them.
    """
    store = harvest_store(source.sparkSession, source, transform, keys or [], root, partition_by, every if keys else 0)
    return start_every(_harvest_writer(source, transform, store), f"{root}/_checkpoint", interval)


def harvest_stream(
    spark: SparkSession,
    source: DataFrame,
    transform: Callable[[DataFrame], DataFrame],
    keys: list[str],
    root: str | None = None,
    partition_by: list[str] | None = None,
    every: int = 8,
) -> DataFrame:
    """Micro-batch harvest run to completion: each batch is transformed into
    records and stored by epoch; finished epochs are folded into a keyed table."""
    root = root or scratch_path(spark, "harvest")
    store = harvest_store(spark, source, transform, keys, root, partition_by, every)
    run_available(_harvest_writer(source, transform, store), f"{root}/_checkpoint")
    return store.read()


# ---------------------------------------------------------------- R9 de-duplication


def dedup_stream(
    spark: SparkSession, source: DataFrame, key: str, ts_col: str, delay: str, root: str | None = None
) -> DataFrame:
    """Drop repeated ``key`` values arriving within the watermark delay (append sink).

    Rows later than the delay are dropped by the watermark, also first ones, as
    in any stateful query; choose a delay that covers the disorder of arrival.
    """
    root = root or scratch_path(spark, "dedup")
    stream = with_event_time(source, ts_col).withWatermark("event_time", delay).dropDuplicatesWithinWatermark([key])
    writer = stream.drop("event_time").writeStream.format("parquet").outputMode("append").option("path", f"{root}/out")
    run_available(writer, f"{root}/_checkpoint")
    return spark.read.schema(source.schema).parquet(f"{root}/out")


# ---------------------------------------------------------------- R10 sessions


def session_stream(
    spark: SparkSession, source: DataFrame, key: str, ts_col: str, gap: str, delay: str, root: str | None = None
) -> DataFrame:
    """Activity sessions per key (a new session after a silence longer than ``gap``).

    Append mode: a session is written once, by the micro-batch after the
    watermark has passed its end, and leaves the state; what is kept is open
    sessions only. Sessions still open when the data end are not written (a
    finite stream ends with ``land_marker``). Rows without key are left out.
    """
    root = root or scratch_path(spark, "sessions")
    out = f"{root}/out"
    agg = (
        with_event_time(source, ts_col)
        .withWatermark("event_time", delay)
        .groupBy(F.col(key), F.session_window("event_time", gap).alias("session"))
        .agg(F.count(F.lit(1)).alias("n_events"))
        .select(
            key,
            F.unix_micros(F.col("session.start")).alias("session_start_us"),
            F.unix_micros(F.col("session.end")).alias("session_end_us"),
            "n_events",
        )
    )
    sink = _epoch_writer(out)
    # filtered in the sink: a filter on the key before it would be pushed below the watermark, which must see every row
    writer = agg.writeStream.outputMode("append").foreachBatch(lambda batch, epoch: sink(batch.where(F.col(key).isNotNull()), epoch))
    run_available(writer, f"{root}/_checkpoint")
    return _read_epochs(spark, out, agg.schema)


# ---------------------------------------------------------------- R11 quality routing


def quality_split_stream(
    spark: SparkSession, source: DataFrame, checks: list[Check], root: str | None = None
) -> DataFrame:
    """Route each arriving row to ``pass`` or ``quarantine`` by the row rules it fails.

    Both outputs are written per epoch; the returned frame is their union with
    a ``route`` column and the names of the failed rules.
    """
    root = root or scratch_path(spark, "split")
    names = F.array(*[F.when(~row_condition(source, c), F.lit(f"{c.column}.{c.rule}")) for c in checks])
    failed = F.filter(names, lambda x: x.isNotNull())
    routed = source.withColumn("failed_rules", F.concat_ws(",", failed)).withColumn(
        "route", F.when(F.size(failed) > 0, "quarantine").otherwise("pass")
    )

    def per_batch(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("route").parquet(f"{root}/out/batch_id={epoch_id}")

    run_available(routed.writeStream.foreachBatch(per_batch), f"{root}/_checkpoint")
    return _read_epochs(spark, f"{root}/out", routed.schema)


# ---------------------------------------------------------------- R12 windowed counts


def event_count_stream(
    spark: SparkSession,
    source: DataFrame,
    ts_col: str,
    key: str,
    width: str,
    delay: str,
    root: str | None = None,
    every: int = 8,
) -> DataFrame:
    """Counts per (tumbling window, key) in update mode; the latest emitted value
    of each window is kept, earlier ones are folded away every few epochs."""
    root = root or scratch_path(spark, "counts")
    agg = (
        with_event_time(source, ts_col)
        .withWatermark("event_time", delay)
        .groupBy(F.window("event_time", width).alias("w"), F.col(key))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.unix_micros(F.col("w.start")).alias("window_start_us"), key, "n")
    )
    store = EpochStore(spark, f"{root}/out", agg.schema, ["window_start_us", key], every=every)
    run_available(agg.writeStream.outputMode("update").foreachBatch(store.write), f"{root}/_checkpoint")
    return store.read()
