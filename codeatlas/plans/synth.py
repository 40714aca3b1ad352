"""Deterministic derivations of code-and-issue shaped tables from the input tables.

Each function here has a SQL twin spelled out next to the query that uses it, so the registered
queries and their oracles start from identical inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERY_BUCKETS = 3          # queries per instance in the retrieval fixture
FILE_SPAN = 10             # consecutive vectors that make up one "file"


def retrieval_queries(emb: DataFrame) -> DataFrame:
    """Query vectors per instance (= label): the centroid of each of QUERY_BUCKETS interleaved
    slices of the instance's vectors.  Averages run per dimension as a normal aggregation."""
    parts = emb.select("label", (F.col("label").cast("long") * QUERY_BUCKETS + F.col("vec_id") % QUERY_BUCKETS)
                       .alias("query_id"), F.posexplode("embedding").alias("d", "x"))
    cent = parts.groupBy("label", "query_id", "d").agg(F.avg(F.col("x").cast("double")).alias("m"))
    # One row per query holding its 64 coordinates: bounded by the vector dimension.
    return (cent.groupBy("label", "query_id")
            .agg(F.array_sort(F.collect_list(F.struct("d", "m"))).alias("_s"))
            .select("label", "query_id", F.transform("_s", lambda s: s["m"]).alias("embedding")))


def retrieval_chunks(emb: DataFrame) -> DataFrame:
    """Chunks of the per-instance index: every vector, its file = run of FILE_SPAN ids."""
    return emb.select("label", F.col("vec_id").alias("chunk_id"),
                      F.concat(F.lit("file_"), F.floor(F.col("vec_id") / FILE_SPAN).cast("string")).alias("rel_path"),
                      "embedding")


def doc_path(doc_id, source, lang):
    """Path of a document seen as a source file: ``<source>[/latest]/<lang>/doc_<id><ext>``."""
    folder = F.when(source.endswith("3"), F.concat(source, F.lit("/latest"))).otherwise(source)
    ext = (F.when(lang == "en", ".js").when(lang == "de", ".ts").when(lang == "fr", ".tsx").otherwise(".css"))
    return F.concat(folder, F.lit("/"), lang, F.lit("/doc_"), doc_id.cast("string"), ext)


def snapshot_v1(docs: DataFrame) -> DataFrame:
    """Old snapshot: every document as a file."""
    return docs.select("doc_id", doc_path(F.col("doc_id"), F.col("source"), F.col("lang")).alias("rel_path"),
                       F.col("text").alias("content"))


def snapshot_v2(docs: DataFrame, labels: DataFrame, bench: DataFrame) -> DataFrame:
    """New snapshot: toxic-labelled files removed, quality-0 files edited, benchmark items added."""
    v1 = snapshot_v1(docs).join(labels.select("doc_id", "quality", "toxic"), "doc_id", "left")
    kept = v1.filter(F.coalesce(F.col("toxic"), F.lit(0)) == 0).select(
        "rel_path", F.when(F.col("quality") == 0, F.concat("content", F.lit(" (edited)"))).otherwise(F.col("content"))
        .alias("content"))
    added = bench.select(F.concat(F.lit("bench/new_"), F.col("item_id").cast("string"), F.lit(".js")).alias("rel_path"),
                         F.col("text").alias("content"))
    return kept.unionByName(added)


def snapshot_versions(docs: DataFrame, labels: DataFrame, bench: DataFrame) -> DataFrame:
    """Three snapshots per repository (repo = document source): 1 = every document, 2 = the
    edited snapshot of ``snapshot_v2``, 3 = snapshot 2 with quality-1 files edited as well.
    ``(repo, number, rel_path, content)``."""
    v1 = snapshot_v1(docs).join(docs.select("doc_id", "source"), "doc_id").select(
        F.col("source").alias("repo"), F.lit(1).alias("number"), "rel_path", "content")
    v2 = snapshot_v2(docs, labels, bench)
    repo = F.coalesce(F.regexp_extract("rel_path", r"^(src\d+)", 1), F.lit(""))
    repo = F.when(repo == "", F.lit("bench")).otherwise(repo)
    v2r = v2.select(repo.alias("repo"), F.lit(2).alias("number"), "rel_path", "content")
    q1 = snapshot_v1(docs).join(labels.filter(F.col("quality") == 1).select("doc_id"), "doc_id").select("rel_path")
    v3r = v2r.join(q1.withColumn("_e", F.lit(True)), "rel_path", "left").select(
        "repo", F.lit(3).alias("number"), "rel_path",
        F.when(F.col("_e"), F.concat("content", F.lit(" (v3)"))).otherwise(F.col("content")).alias("content"))
    return v1.unionByName(v2r).unionByName(v3r)
