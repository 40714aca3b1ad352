"""Access to the input tables (one parquet dataset per table name under a root folder)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                 "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Lazily read ``<root>/<name>.parquet``; projections and filters applied later are pushed
    into the parquet scan by Catalyst (column pruning, row-group skipping)."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")
