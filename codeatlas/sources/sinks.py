"""Sinks: partitioned tables and the exchange formats of the original pipeline."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir, spread
from .documents import document_name, write_documents
from .stores import listed, open_store, publish


def _gathered(df: DataFrame, cols) -> DataFrame:
    """Rows of one folder in few tasks, so few files; adaptive execution splits a hot folder's rows."""
    return df.hint("rebalance", *cols)


def write_jsonl(df: DataFrame, path: str, partition_cols=("instance_key",), mode: str = "overwrite") -> None:
    """One JSON object per line, one folder per instance."""
    _gathered(df, partition_cols).write.mode(mode).partitionBy(*partition_cols).json(path)


def write_table(df: DataFrame, path: str, partition_cols=("instance_key",), mode: str = "overwrite") -> None:
    """Columnar table partitioned by instance (the library's storage for every artefact)."""
    _gathered(df, partition_cols).write.mode(mode).partitionBy(*partition_cols).parquet(path)


def structure_json(elements: DataFrame, key_cols=("instance_key", "rel_path")) -> DataFrame:
    """Export form of the element table: per file ``node_key -> element`` as one JSON map,
    methods nested under their class.  One row per file (bounded by the file's elements)."""
    key_cols = list(key_cols)
    el = elements.select(*key_cols, "node_key", "ordinal", "parent_ordinal", "kind", F.struct(
        "signature", "content", "name", "parameters", "start_line", "end_line",
        F.col("has_return").alias("return")).alias("e"))
    methods = el.filter(F.col("parent_ordinal").isNotNull()).groupBy(*key_cols, F.col("parent_ordinal").alias("ordinal")) \
        .agg(F.array_sort(F.collect_list(F.struct(F.col("e.start_line").alias("s"), "e"))).alias("_m")) \
        .select(*key_cols, "ordinal", F.lit("class").alias("kind"),
                F.transform("_m", lambda x: x["e"]).alias("functions"))
    top = el.filter(F.col("node_key").isNotNull()).join(methods, [*key_cols, "ordinal", "kind"], "left")
    node = F.struct(F.col("e.*"), F.coalesce("functions", F.array()).alias("functions"))
    per_file = top.groupBy(*key_cols).agg(F.map_from_entries(F.collect_list(F.struct("node_key", node))).alias("m"))
    inst = key_cols[:-1]
    return per_file.select(*inst, F.to_json(F.create_map(F.col(key_cols[-1]), F.col("m"))).alias("json"))


def structure_pieces(elements: DataFrame, key_cols=("instance_key", "rel_path")) -> DataFrame:
    """A file's entry of its snapshot's structure document: (instance_key, section, pos, piece)."""
    per_file = structure_json(elements, key_cols)
    # The file's own object without its braces: one entry of the snapshot's.
    return per_file.select(F.col(key_cols[0]).alias("instance_key"), F.lit(0).alias("section"), F.lit(0).cast("long").alias("pos"),
                           F.expr("substring(json, 2, char_length(json) - 2)").alias("piece"))


def write_structure(elements: DataFrame, path: str) -> DataFrame:
    """K2: one JSON map ``file -> node_key -> element`` per snapshot, as ``<path>/<instance>.json``, streamed (see
    ``write_documents``); returns the manifest.  ``read_structure`` reads them back."""
    ensure_checkpoint_dir(elements.sparkSession)
    elements = elements.checkpoint()             # read for the methods and for the elements that own them
    return write_documents(structure_pieces(elements), path, [("{", ",\n", "}\n")])


def write_node_link(nodes: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    """K3: one graph ``{"nodes": [...], "links": [...]}`` per snapshot, as ``<path>/<instance>.json``, streamed;
    returns the manifest.  Nodes stand in order of their name, links in order of their ends.  A snapshot with nodes or
    edges has a document.  ``read_links`` and ``read_nodes`` read them back."""
    def pieces(df: DataFrame, section: int, *columns) -> DataFrame:
        return df.select("instance_key", F.lit(section).alias("section"), F.lit(0).cast("long").alias("pos"), F.to_json(F.struct(*columns)).alias("piece"))

    n = pieces(nodes, 0, F.col("node").alias("id"), "type")
    e = pieces(edges, 1, F.col("src_path").alias("source"), F.col("dst_path").alias("target"), F.lit("import").alias("type"))
    return write_documents(n.unionByName(e), path, [('{"nodes": [', ",\n", "],\n"), ('"links": [', ",\n", "]}\n")])


def commit_batch(df: DataFrame, path: str, batch_id: str, key_cols=("instance_key",)) -> bool:
    """Append ``df`` to the table at ``path`` as the batch ``batch_id``, once: False where that batch was committed
    before.

    The rows go to a folder of their own, which counts when a file that names it appears among the table's
    commits.  A try that fails leaves a folder that nobody reads, so a retry doubles nothing; of two writers of one
    batch the later commit's folder is the batch."""
    store, top = open_store(path)
    commit = f"{top}/commits/{document_name(batch_id)}.json"
    if store.get_file_info(commit).is_file:
        return False
    folder = f"batches/{uuid.uuid4().hex}"
    _gathered(df, key_cols).write.partitionBy(*key_cols).parquet(f"{path.rstrip('/')}/{folder}")
    note = json.dumps({"batch": batch_id, "folder": folder, "schema": df.schema.json()}).encode()
    publish(store, commit, uuid.uuid4().hex, lambda out: out.write(note))
    return True


def committed(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of all committed batches of a table, with ``batch_id``; None while there is none.  The driver reads one
    small note per batch."""
    store, top = open_store(path)
    out = None
    for name in listed(store, f"{top}/commits", ".json"):
        with store.open_input_stream(name, compression=None) as f:
            note = json.loads(f.read())
        schema = T.StructType.fromJson(json.loads(note["schema"]))
        rows = spark.read.schema(schema).parquet(f"{path.rstrip('/')}/{note['folder']}").select(*schema.names)
        rows = rows.withColumn("batch_id", F.lit(note["batch"]))
        out = rows if out is None else out.unionByName(rows)
    return out


def write_texts(df: DataFrame, path: str, key_cols=("instance_key",), batch_col: str | None = None,
                mode: str = "overwrite", batch_id: str | None = None) -> None:
    """K4, text artefacts by key.  With a ``batch_col`` several rows make up a key's text (``read_texts`` joins them in
    its order).  ``mode='append'`` commits the rows as one batch (``commit_batch``): a retry or a second run under
    the same ``batch_id`` adds nothing."""
    out = df if batch_col is None else df.withColumn(batch_col, F.col(batch_col).cast("long"))
    if mode == "append":
        commit_batch(out, path, batch_id or uuid.uuid4().hex, key_cols)
    else:
        _gathered(out, key_cols).write.mode(mode).partitionBy(*key_cols).parquet(path)


def read_texts(spark: SparkSession, path: str, key_cols=("instance_key",), batch_col: str = "batch_no",
               text_col: str = "text") -> DataFrame:
    """Concatenate the batches of each instance in batch order (bounded by the instance); of an appended table the
    committed ones."""
    t = committed(spark, path)
    t = spark.read.parquet(path) if t is None else t
    order = [c for c in (batch_col, "batch_id") if c in t.columns]
    g = t.groupBy(*key_cols).agg(F.array_sort(F.collect_list(F.struct(*order, text_col))).alias("_b"))
    return g.select(*key_cols, F.array_join(F.transform("_b", lambda s: s[text_col]), "").alias(text_col))


def write_statement(df: DataFrame, path: str, text_col: str = "problem_statement", key_cols=("instance_key",)) -> None:
    """Problem statements trimmed of surrounding whitespace, one per instance."""
    out = df.withColumn(text_col, F.regexp_replace(F.col(text_col), r"^\s+|\s+$", ""))
    _gathered(out, key_cols).write.mode("overwrite").partitionBy(*key_cols).parquet(path)


def write_files(df: DataFrame, path: str, name_col: str = "name", content_col: str = "content") -> DataFrame:
    """One file ``<path>/<name>`` per row, text as UTF-8 or bytes as they are; returns the manifest (name, bytes).  A file
    appears under its final name when it is whole and replaces an older one; rows without a name or content are left
    out, and of rows that share a name the last written stands.  The rows are dealt over all cores."""
    ensure_checkpoint_dir(df.sparkSession)
    rows = df.select(F.col(name_col).alias("name"), F.col(content_col).cast("binary").alias("content")).dropna()

    def write(batches):
        import pandas as pd
        from pyspark import TaskContext

        store, top = open_store(path)
        attempt, made = str(TaskContext.get().taskAttemptId()), set()
        for pdf in batches:
            for name, content in zip(pdf["name"], pdf["content"], strict=True):
                publish(store, f"{top}/{name}", attempt, lambda out, content=content: out.write(content), made)
            yield pd.DataFrame({"name": pdf["name"], "bytes": pdf["content"].map(len)})

    return spread(rows).mapInPandas(write, "name string, bytes long").checkpoint()
