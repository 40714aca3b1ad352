"""Helpers that several operators of this package share."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

# ASCII white space that separates words: blank and \x09-\x0D, the set bytes.split() uses.
WORD_SQL = r"[^\x20\x09-\x0D]+"


def on_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (in jobs that were not
    submitted with it); later Python functions of the session carry the path."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared checkpoint folder of the session."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex[:12]}"


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, and what Python
    workers computed is computed once.  Every executor can read it, so a lost one costs nothing."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the session's shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that don't clash with any column of ``df`` (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def canonical(column: Column, kind: T.DataType) -> Column:
    """A form of ``column`` that can be hashed and compared: maps as entries sorted by key, variants as
    JSON, and so within arrays and structs."""
    if isinstance(kind, T.MapType):
        pairs = F.transform(F.map_entries(column), lambda e: F.struct(
            canonical(e["key"], kind.keyType).alias("key"), canonical(e["value"], kind.valueType).alias("value")))
        return F.array_sort(pairs, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda e: canonical(e, kind.elementType))
    if isinstance(kind, T.StructType):
        whole = F.struct(*[canonical(column[f.name], f.dataType).alias(f"f{i}") for i, f in enumerate(kind.fields)])
        return F.when(column.isNotNull(), whole)
    if isinstance(kind, T.VariantType):
        return F.to_json(column)
    return column


def word_blocks(data: bytes, block: int = 1 << 22) -> Iterator[list[bytes]]:
    """The words of ``data`` as lists, about ``block`` bytes of text each; no word is cut."""
    if len(data) <= block:
        yield data.split()
        return
    at = 0
    while at < len(data):
        end = min(len(data), at + block)
        while end < len(data) and data[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield data[at:end].split()
        at = end


def open_store(uri: str):
    """(file system, path) for a folder of any store that Arrow reaches (file, hdfs, s3, gs)."""
    from pyarrow import fs

    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)
