"""Training-corpus pipeline: language ID, SimHash near-dedup, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
back as the next stage's ``docs``.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeatlas.llm import langid, mixing, packing, simhash
from codeatlas.llm.common import on_workers, write_table
from codeatlas.llm.queries import tokenizer_path
from codeatlas.session import ensure_checkpoint_dir
from codeatlas.sources.tables import table


def _ready(spark: SparkSession) -> None:
    ensure_checkpoint_dir(spark)
    on_workers(spark)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model, trained on ``docs``, doesn't reject."""
    _ready(spark)
    return langid.drop_rejected(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the one with the smallest doc_id."""
    _ready(spark)
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    _ready(spark)
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences, with their token ids."""
    _ready(spark)
    return packing.packed(docs, tokenizer_path())


STAGES = [("language ID", language_id), ("SimHash near-dedup", simhash_near_dedup),
          ("mixing sources to target weights", mix_sources), ("packing", pack_sequences)]

# Trained scores, XXH64, random rounding and BPE ids aren't SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last stage's rows."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = write_table(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
