"""Flagship pipeline: retrieve -> retrieved files -> budgeted context batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.packing import pack_batches
from ..operators.retrieval import topk_similar
from ..sources.tables import table
from .synth import retrieval_chunks, retrieval_queries

FILE_BUDGET = 100


def retrieve_and_pack(spark: SparkSession, root: str, k: int = 50, budget: int = FILE_BUDGET) -> DataFrame:
    """Per instance: top-k chunks per query, union to files ranked by best hit, then pack the
    files in rank order into batches whose total weight (10 per hit) stays under ``budget``."""
    emb = table(spark, root, "embeddings")
    hits = topk_similar(retrieval_chunks(emb), retrieval_queries(emb), ["label"], "chunk_id", "query_id", k=k)
    files = (hits.groupBy("label", "rel_path").agg(F.min("rank").alias("best_rank"), F.count(F.lit(1)).alias("hits"))
             .withColumn("weight", F.col("hits") * 10))
    packed = pack_batches(files, ["label"], ["best_rank", "rel_path"], "weight", budget=budget)
    return packed.select("label", "rel_path", F.col("best_rank").cast("long").alias("best_rank"),
                         F.col("hits").cast("long").alias("hits"), F.col("batch_no").cast("long").alias("batch_no"),
                         "oversize")
