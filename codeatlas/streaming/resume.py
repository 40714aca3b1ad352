"""Resume semantics (skip work whose output exists) as a Structured Streaming job.

Work items arrive as files in a folder.  Every micro-batch is anti-joined with the keys already in
the output table, the remaining items are processed, and the result is written to a folder named
after the batch id.  A retried batch overwrites its own folder, and the stream checkpoint records
which input files were consumed, so every item is processed once across restarts and lost
executors.  Run with ``available_now=True`` for a catch-up run that stops when the folder is
drained, or as a continuous stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir


def _done_keys(spark: SparkSession, done_path: str, keys: list[str], batch_id: int) -> DataFrame | None:
    """Keys that other batches have written.  What a failed try of this batch left doesn't count: the
    retry overwrites it."""
    try:
        done = spark.read.parquet(done_path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    # Materialised before the batch's own folder is replaced.
    return done.filter(F.col("batch_id") != batch_id).select(*keys).distinct().checkpoint()


def resume_stream(spark: SparkSession, work_dir: str, work_schema: T.StructType, done_path: str, keys: list[str],
                  process: Callable[[DataFrame], DataFrame], checkpoint_location: str, available_now: bool = True,
                  fmt: str = "parquet"):
    """Start the stream; returns the StreamingQuery (already finished when ``available_now``)."""

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        ensure_checkpoint_dir(spark)
        rest = [c for c in batch.columns if c not in keys]
        # Of rows with one key the smallest stays, so a retry takes the same one.
        todo = batch.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, "_r.*") if rest else batch.distinct()
        done = _done_keys(spark, done_path, keys, batch_id)
        if done is not None:
            todo = todo.join(done, keys, "left_anti")
        out = process(todo)
        out.write.mode("overwrite").parquet(f"{done_path.rstrip('/')}/batch_id={batch_id}")

    stream = spark.readStream.schema(work_schema).format(fmt).load(work_dir)
    writer = stream.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    q = writer.start()
    if available_now:
        q.awaitTermination()
    return q


def processed(spark: SparkSession, done_path: str) -> DataFrame:
    """Everything produced so far (all batches)."""
    return spark.read.parquet(done_path).drop("batch_id")
