"""Helpers shared by the operators of this package.

Conventions: an operator takes DataFrames and reads only the columns it names
(``pick``), so extra columns, also with clashing names, never reach it. What a
job reuses or cuts lineage with is written below ``spark.checkpoint.dir``
(``save``), where every executor finds it again after a loss.
"""

from __future__ import annotations

import sys
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.session import scratch_path

# functions that run in tasks travel by value: executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules["strata.llm"])


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, even if others differ from them by case alone."""
    places = []
    for name in names:
        exact = [i for i, c in enumerate(df.columns) if c == name]
        near = [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
        if not (exact or near):
            raise ValueError(f"no column {name!r} among {df.columns}")
        places.append((exact or near)[0])
    plain = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"_c{i}").alias(n) for i, n in zip(places, names, strict=True)])


_WRITTEN: list[tuple[str, str | None, str]] = []  # folders that save() and stage_texts() wrote, tables over them, and for whom
_OWNER: ContextVar[str] = ContextVar("owner", default="")


@contextmanager
def owner(name: str):
    """Scratch written inside belongs to ``name``, for ``release``."""
    token = _OWNER.set(name)
    try:
        yield
    finally:
        _OWNER.reset(token)


def written(path: str, table: str | None = None) -> None:
    """Note a scratch folder, so that ``discard`` or ``release`` can delete it."""
    _WRITTEN.append((path, table, _OWNER.get()))


def save(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write to a fresh folder below the shared root and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.option("compression", "zstd").parquet(path)
    written(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def _delete(spark: SparkSession, path: str, table: str | None) -> None:
    if table:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(*frames: DataFrame) -> None:
    """Delete what ``save`` or ``stage_texts`` wrote for these frames: nothing reads them any more."""
    for f in frames:
        for entry in [e for e in _WRITTEN if e[0] == getattr(f, "scratch", None)]:
            _delete(f.sparkSession, *entry[:2])
            _WRITTEN.remove(entry)


def release(name: str, docs: DataFrame) -> None:
    """Delete the scratch of owner ``name`` that ``docs`` does not read."""
    mine = [e for e in _WRITTEN if e[2] == name]
    files = docs.inputFiles() if mine else []
    for entry in mine:
        folder = entry[0].rsplit("/", 1)[1]  # unique
        if not any(folder in f for f in files):
            _delete(docs.sparkSession, *entry[:2])
            _WRITTEN.remove(entry)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _contract(batches):
    """Replace the edges of a task by a spanning forest: same components, at most one edge a node."""
    import numpy as np
    import pyarrow as pa

    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = np.fromiter(parent, np.int64, len(parent))
    roots = np.fromiter((root(int(x)) for x in nodes), np.int64, len(nodes))
    keep = nodes != roots
    for k in range(0, int(keep.sum()), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[keep][k:k + 10_000]), pa.array(roots[keep][k:k + 10_000])], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a long, b long).

    Returns (node, component), component being the smallest node reachable.
    Each task first contracts its own edges to a spanning forest; then labels
    spread along the edges, every round followed by a jump to the label of the
    label, until no label changes. Every round is written to the shared folder.
    """
    spark = edges.sparkSession
    forest = edges.where("a <> b").mapInArrow(_contract, "a long, b long")
    both = save(forest.unionByName(forest.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "label")
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        spread = label.join(near, "node", "left").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        old, spread = label, save(spread, "spread")
        up = spread.select(F.col("node").alias("component"), F.col("component").alias("up"))
        jumped = spread.join(up, "component", "left").select("node", "old", F.coalesce("up", "component").alias("component"))
        jumped = save(jumped, "label")
        discard(old, spread)
        changed = jumped.where("component <> old").limit(1).count()
        label = jumped.select("node", "component")
        label.scratch = jumped.scratch
        if not changed:
            discard(both)
            return label
