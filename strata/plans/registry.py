"""Query registry: key -> (callable(spark, data_dir) -> DataFrame, DuckDB oracle SQL or None).

Each themed module under ``strata.plans`` registers its queries with
``@query(key, oracle=...)``. Every query reads the given tables (or data Spark
derives from them) in full; nothing is sampled or capped unless the limit is
the feature itself (top-k, failing-row samples).
"""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}

# The tables of the data folder.
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

_MODULES = (
    "strata.plans.layers",
    "strata.plans.quality_queries",
    "strata.plans.analytics_queries",
    "strata.plans.text_queries",
    "strata.plans.record_queries",
    "strata.plans.stream_queries",
    "strata.plans.sql_queries",
)


def query(key: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if key in REGISTRY:
            raise ValueError(f"duplicate query key {key}")
        REGISTRY[key] = (fn, oracle)
        return fn

    return deco


def load(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{data_dir.rstrip('/')}/{name}.parquet")


def register_views(spark: SparkSession, data_dir: str, statement: str | None = None) -> None:
    """Temp views over the data folder for SQL passthrough: the tables a statement names, or all."""
    for n in TABLES:
        if statement is None or re.search(rf"\b{n}\b", statement):
            load(spark, data_dir, n).createOrReplaceTempView(n)


def all_queries() -> dict[str, tuple[QueryFn, str | None]]:
    for m in _MODULES:
        importlib.import_module(m)
    return dict(REGISTRY)
