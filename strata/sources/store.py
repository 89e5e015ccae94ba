"""A keyed table with versions: merges rewrite only the partitions they touch.

Layout below the store's root::

    data/v=<n>/<partition columns>/part-*    rows that version n wrote
    _versions/<n>                            what version n consists of (JSON)

A merge writes the touched partitions anew under its own version, lists them
beside the untouched folders of the version before, and publishes that list by
one rename that fails if another writer came first. Readers always see one whole
version, a failed or repeated attempt leaves nothing behind that is read, and a
merge that changes no row publishes nothing. Partition columns are part of the
key, so a row never moves between partitions; a hash bucket of the key splits
each of them into parts of a bounded size.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.operators.records import upsert_latest

BUCKET = "_bucket"
MAX_FOLDERS = 100_000  #: folders a version may list; more would need larger partitions
PART_ROWS = 100_000  #: rows of a folder that one task sorts and writes; a folder with more has several files


class Conflict(RuntimeError):
    """Another writer published the version first."""


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def publish_text(spark: SparkSession, path: str, text: str) -> None:
    """Write ``text`` to a new file that appears whole or not at all; ``Conflict`` if it exists."""
    jvm = spark.sparkContext._jvm
    fs, final = _fs(spark, path)
    draft = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex[:12]}.tmp")
    stream = fs.create(draft, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    rename = getattr(jvm, "org.apache.hadoop.fs.Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.NONE  # never replaces a file that is there
    try:
        context.rename(fs.makeQualified(draft), fs.makeQualified(final), options)
    except Exception as e:
        fs.delete(draft, False)
        if fs.exists(final):
            raise Conflict(path) from e
        raise


def names_in(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(st.getPath().getName() for st in fs.listStatus(p)) if fs.exists(p) else []


def delete_path(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


class VersionedStore:
    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, keys: list[str], partition_by: list[str] | None = None, buckets: int = 1):
        partition_by = partition_by or []
        if not set(partition_by) <= set(keys):
            raise ValueError("partition columns must be key columns")
        self.spark, self.root, self.schema, self.keys = spark, root.rstrip("/"), schema, keys
        self.partitions, self.buckets = [*partition_by, BUCKET], buckets

    # ------------------------------------------------------------ versions

    def version(self) -> int:
        """The latest published version; 0 if there is none."""
        found = [int(n) for n in names_in(self.spark, f"{self.root}/_versions") if n.isdigit()]
        return max(found, default=0)

    def manifest(self, version: int | None = None) -> dict:
        """folders (partition folder -> version that wrote it) and note of a version."""
        version = self.version() if version is None else version
        if not version:
            return {"folders": {}, "note": {}}
        return json.loads(read_text(self.spark, f"{self.root}/_versions/{version:012d}"))

    def _publish(self, version: int, folders: dict, note: dict) -> None:
        if len(folders) > MAX_FOLDERS:
            raise ValueError(f"{len(folders)} partition folders; at most {MAX_FOLDERS}")
        publish_text(self.spark, f"{self.root}/_versions/{version:012d}", json.dumps({"folders": folders, "note": note}))

    # ------------------------------------------------------------ reading

    def _stored_schema(self) -> T.StructType:
        return T.StructType([*[f for f in self.schema.fields], T.StructField(BUCKET, T.IntegerType())])

    def _folders(self, folders: dict[str, int]) -> DataFrame:
        schema = self._stored_schema()
        if not folders:
            return self.spark.createDataFrame([], schema)
        out = None
        for v in sorted(set(folders.values())):
            base = f"{self.root}/data/v={v}"
            paths = [f"{base}/{name}" for name, at in folders.items() if at == v]
            part = self.spark.read.schema(schema).option("basePath", base).parquet(*paths).select(*schema.names)
            out = part if out is None else out.unionByName(part)
        return out

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of one version (the latest by default)."""
        return self._folders(self.manifest(version)["folders"]).drop(BUCKET)

    # ------------------------------------------------------------ writing

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _same_key(self, a: str, b: str) -> Column:
        same = F.col(f"{a}.{BUCKET}") == F.col(f"{b}.{BUCKET}")
        for k in self.keys:
            same = same & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
        return same

    def _same(self, a: str, b: str) -> Column:
        same = F.lit(True)
        for c in self.schema.names:
            same = same & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
        return same

    def merge(self, incoming: DataFrame, version: str, note: dict | None = None) -> dict:
        """Insert or replace rows by key; of several rows with one key the highest ``version`` column wins.

        Rows equal to what is stored change nothing; without any other row no
        version is published (unless the note changes). Returns the published
        version and the numbers of added and changed rows.
        """
        current = self.version()
        old = self.manifest(current)
        note, new = old["note"] | (note or {}), current + 1
        incoming = incoming.select(*self.schema.names)
        rows = upsert_latest(incoming.limit(0), incoming, self.keys, version).select(*self.schema.names).withColumn(BUCKET, self._bucket())
        if not old["folders"]:
            self._write(rows, f"{self.root}/data/v={new}")
            return self._close(current, old, {}, note, self._read(f"{self.root}/data/v={new}").count(), 0)
        drafts = f"{self.root}/_drafts/{uuid.uuid4().hex[:12]}"
        # incoming rows by partition: only the stored folders of those partitions are read
        self._write(rows, f"{drafts}/rows")
        touched = {f: v for f, v in old["folders"].items() if f in set(self._list_partitions(f"{drafts}/rows"))}
        a, b = self._read(f"{drafts}/rows").alias("a"), self._folders(touched).alias("b")
        known = a.join(b, self._same_key("a", "b"), "left").where(F.col(f"b.{BUCKET}").isNull() | (~self._same("a", "b") & (F.col(f"a.{version}") >= F.col(f"b.{version}"))))
        changed = known.select("a.*", F.col(f"b.{BUCKET}").isNull().alias("_added"))
        self._write(changed, f"{drafts}/changed", "_added")
        fresh = self._read(f"{drafts}/changed", "_added")
        counts = {r["_added"]: r["count"] for r in fresh.groupBy("_added").count().collect()}
        kept = old["folders"]
        if counts:
            hit = set(self._list_partitions(f"{drafts}/changed"))
            touched = {f: v for f, v in touched.items() if f in hit}
            kept = {f: v for f, v in kept.items() if f not in hit}
            a, b = self._folders(touched).alias("a"), fresh.select(*self.keys, BUCKET).alias("b")
            self._write(a.join(b, self._same_key("a", "b"), "left_anti").unionByName(fresh.drop("_added")), f"{self.root}/data/v={new}")
        result = self._close(current, old, kept, note, counts.get(True, 0), counts.get(False, 0))
        delete_path(self.spark, drafts)
        return result

    def _close(self, current: int, old: dict, kept: dict, note: dict, added: int, changed: int) -> dict:
        """Publish the version after ``current`` if rows or the note changed."""
        result = {"version": current, "added": added, "changed": changed}
        if added or changed:
            kept = kept | {f: current + 1 for f in self._list_partitions(f"{self.root}/data/v={current + 1}")}
        if added or changed or note != old["note"]:
            self._publish(current + 1, kept, note)
            result["version"] = current + 1
        return result

    def _write(self, rows: DataFrame, path: str, *more: str) -> None:
        """Rows by partition below ``path``; those of a large folder are dealt over several tasks by a hash of their key."""
        delete_path(self.spark, path)  # what an attempt that never published may have left
        rows = rows.select(*self._stored_schema().names, *more)
        sizes = rows.groupBy(*self.partitions).agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("_parts"))
        found = sizes.collect()  # one row for each folder, at most MAX_FOLDERS of them in a version
        total = sum(r["_parts"] for r in found)
        width = max(1, min(self.spark.sparkContext.defaultParallelism * 4, 4 * self.buckets))
        if total > width:  # many rows: about one task for each part
            same = F.lit(True)
            for c in self.partitions:
                same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}"))
            sizes = self.spark.createDataFrame(found, sizes.schema)
            rows = rows.alias("r").join(sizes.alias("s"), same).select("r.*", F.pmod(F.xxhash64(F.lit(PART_ROWS), *[F.col(f"r.{k}") for k in self.keys]), "_parts").alias("_part"))
            rows = rows.repartition(2 * total, *self.partitions, "_part").drop("_part")
        else:
            rows = rows.repartition(width, *self.partitions)
        rows.write.partitionBy(*self.partitions).parquet(path)

    def _read(self, path: str, *flags: str) -> DataFrame:
        schema = T.StructType([*self._stored_schema().fields, *[T.StructField(f, T.BooleanType()) for f in flags]])
        if not self._list_partitions(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path).select(*schema.names)

    def _list_partitions(self, path: str) -> list[str]:
        level = [""]
        for _ in self.partitions:
            level = [f"{p}/{n}" if p else n for p in level for n in names_in(self.spark, f"{path}/{p}") if "=" in n]
        return level

    def vacuum(self, keep: int = 2) -> int:
        """Delete folders that none of the last ``keep`` versions lists; returns how many."""
        last = self.version()
        used = {(f, v) for n in range(max(1, last - keep + 1), last + 1) for f, v in self.manifest(n)["folders"].items()}
        gone = 0
        for name in names_in(self.spark, f"{self.root}/data"):
            v = int(name.split("=")[1])
            if v > last:
                continue  # a merge that runs now
            base = f"{self.root}/data/{name}"
            for f in self._list_partitions(base):
                if (f, v) not in used:
                    delete_path(self.spark, f"{base}/{f}")
                    gone += 1
        for n in range(1, last - keep + 1):
            delete_path(self.spark, f"{self.root}/_versions/{n:012d}")
        return gone
