"""Model-call logs: token roll-ups and retry-policy outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHAT_TRIES = 3
DOC_TRIES = 5


def usage_rollup(calls: DataFrame, stage_col: str, task_col: str, success: F.Column) -> DataFrame:
    """Prompt and completion tokens of successful calls per (stage, task), with per-stage and
    grand totals (``rollup``: a null column marks a total row)."""
    return (calls.filter(success).rollup(stage_col, task_col)
            .agg(F.sum("prompt_tokens").cast("long").alias("prompt_tokens"),
                 F.sum("completion_tokens").cast("long").alias("completion_tokens"),
                 F.count(F.lit(1)).alias("calls")))


def attempt_outcomes(attempts: DataFrame, task_cols: list[str], order_cols: list[str], status_col: str = "status",
                     max_try: int = CHAT_TRIES) -> DataFrame:
    """Per task, replay the retry policy over its logged attempts in order: a success ends the task
    with output, status 400 ends it without output, any other result uses one of ``max_try``
    tries.  One row per task: ``outcome`` (success / rejected / exhausted), ``attempts_used``,
    and the tokens of the successful attempt.  Aggregations only - no per-task sequential loop."""
    # The first ending attempt of each task; attempts up to it are counted, none is ranked.
    named = [f"_task{i}" for i in range(len(task_cols))]
    key = F.struct(*order_cols)
    ends = (attempts.filter(F.col(status_col).isin("ok", "400"))
            .groupBy(*[F.col(c).alias(n) for c, n in zip(task_cols, named)])
            .agg(F.min(F.struct(key.alias("at"), F.col(status_col).alias("s"), F.col("prompt_tokens").alias("p"))).alias("_end")))
    same = F.lit(True)
    for c, n in zip(task_cols, named):
        same = same & F.col(c).eqNullSafe(F.col(n))
    g = attempts.select(*task_cols, key.alias("_at")).join(ends, same, "left").groupBy(*task_cols).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count(F.when(F.col("_at") <= F.col("_end.at"), 1)).alias("_up"), F.max("_end").alias("_end"))
    g = g.select(*task_cols, "_n", F.when(F.col("_end").isNotNull(), F.col("_up")).alias("_t"),
                 F.col("_end.s").alias("_ts"), F.col("_end.p").alias("_tp"))
    within = F.col("_t").isNotNull() & (F.col("_t") <= max_try)
    outcome = F.when(within & (F.col("_ts") == "ok"), "success").when(within, "rejected").otherwise("exhausted")
    used = F.when(within, F.col("_t")).otherwise(F.least(F.col("_n"), F.lit(max_try)))
    tokens = F.when(within & (F.col("_ts") == "ok"), F.col("_tp")).otherwise(F.lit(0))
    return g.select(*task_cols, outcome.alias("outcome"), used.cast("long").alias("attempts_used"),
                    tokens.cast("long").alias("prompt_tokens"))
