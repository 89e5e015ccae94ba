"""Identifier and layer guards, and the layered table store (bronze/silver/gold).

A layer is a Spark database whose location is a folder under the shared root,
so tables written by one job are plain Parquet that any later job or engine can
read. Names are validated and never spliced into SQL text unquoted.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from strata.session import shared_root

# Identifier pattern and the closed set of layer names.
SAFE_IDENTIFIER = re.compile(r"^[a-zA-Z_][a-zA-Z0-9_]*$")
LAYERS = ("bronze", "silver", "gold", "main", "information_schema")


def check_identifier(name: str) -> str:
    if not isinstance(name, str) or not SAFE_IDENTIFIER.match(name):
        raise ValueError(f"Invalid SQL identifier: {name!r}")
    return name


def quote(name: str) -> str:
    return f"`{check_identifier(name)}`"


def check_layer(layer: str) -> str:
    if layer not in LAYERS:
        raise ValueError(f"Unknown schema/layer: {layer!r}")
    return layer


class Lake:
    """Three-layer table store backed by Spark databases.

    ``prefix`` namespaces the databases so independent pipelines (or tests)
    in one session cannot collide; the default keeps the plain layer names.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, prefix: str = ""):
        self.spark = spark
        self.root = (root or f"{shared_root(spark)}/lake").rstrip("/")
        if prefix:
            check_identifier(prefix)
        self.prefix = prefix
        self._ready: set[str] = set()

    def database(self, layer: str) -> str:
        check_layer(layer)
        return f"{self.prefix}_{layer}" if self.prefix else layer

    def _ensure(self, layer: str) -> str:
        db = self.database(layer)
        if db not in self._ready:
            self.spark.sql(
                f"CREATE DATABASE IF NOT EXISTS {quote(db)} LOCATION '{self.root}/{db}.db'"
            )
            self._ready.add(db)
        return db

    def prepare(self, *layers: str) -> None:
        """Create the layer databases up front (before concurrent writers start)."""
        for layer in layers or ("bronze", "silver", "gold"):
            self._ensure(layer)

    def name(self, layer: str, table: str) -> str:
        return f"{quote(self.database(layer))}.{quote(table)}"

    def table(self, layer: str, table: str) -> DataFrame:
        self._ensure(layer)
        return self.spark.table(self.name(layer, table))

    def exists(self, layer: str, table: str) -> bool:
        self._ensure(layer)
        return self.spark.catalog.tableExists(f"{self.database(layer)}.{table}")

    def write(
        self,
        df: DataFrame,
        layer: str,
        table: str,
        mode: str = "overwrite",
        partition_by: list[str] | None = None,
    ) -> int:
        """Write ``df`` as a layer table; the row count comes from the write itself."""
        return self.write_observed(df, layer, table, {}, mode, partition_by)["rows"]

    def write_observed(
        self,
        df: DataFrame,
        layer: str,
        table: str,
        metrics: dict[str, Column],
        mode: str = "overwrite",
        partition_by: list[str] | None = None,
    ) -> dict[str, int]:
        """Write ``df`` as a layer table; ``metrics`` (aggregates) and ``rows`` are measured by the write itself."""
        self._ensure(layer)
        check_identifier(table)
        obs = Observation(f"rows_{layer}_{table}")
        observed = df.observe(obs, F.count(F.lit(1)).alias("rows"), *[m.alias(name) for name, m in metrics.items()])
        writer = observed.write.mode(mode).format("parquet")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.saveAsTable(self.name(layer, table))
        return {name: int(n) for name, n in obs.get.items()}

    def rename(self, layer: str, table: str, to: str) -> None:
        """Give ``table`` the name ``to``, in place of a table that has it."""
        check_identifier(to)
        self.drop(layer, to)
        self.spark.sql(f"ALTER TABLE {self.name(layer, table)} RENAME TO {self.name(layer, to)}")

    def drop(self, layer: str, table: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name(layer, table)}")

    def create_view(self, layer: str, view: str, sql: str) -> None:
        self._ensure(layer)
        check_identifier(view)
        self.spark.sql(f"DROP VIEW IF EXISTS {self.name(layer, view)}")
        self.spark.sql(f"CREATE VIEW {self.name(layer, view)} AS {sql}")

    def tables(self, layer: str, include_views: bool = False) -> list[str]:
        db = self._ensure(layer)
        out = []
        for t in self.spark.catalog.listTables(db):
            if t.isTemporary:
                continue
            if t.tableType == "VIEW" and not include_views:
                continue
            out.append(t.name)
        return sorted(out)

    def columns(self, layer: str, table: str) -> list[tuple[str, str]]:
        return [(f.name, f.dataType.simpleString()) for f in self.table(layer, table).schema.fields]
