"""Greedy token-budget packing of ordered context items (prompt batching).

Semantics (strict budget, as in the original): items are visited in order and added to the open
batch while ``batch_total + size < budget``; an item that does not fit opens the next batch and
is counted in it.  An item that is over budget on its own forms a batch flagged ``oversize``.
Every item lands in exactly one batch (the original loses the overflowing last item and can
emit an empty first batch; ``faithful`` reproduces those quirks on the result).

As a table job the rule is a ``block_fold`` whose state is the total of the open batch: a group is folded
block by block in parallel, and only blocks that were entered with another total than assumed are folded
again.  No step holds a whole group in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blockfold import block_fold

PROMPT_BUDGET = 128000


def pack_batches(items: DataFrame, group_cols: list[str], order_cols: list[str], size_col: str,
                 budget=PROMPT_BUDGET, faithful: bool = False) -> DataFrame:
    """Assign ``batch_no`` (1-based) to every item; adds ``idx``, ``batch_no``, ``oversize``.

    ``budget`` is a number or the name of a per-group column (e.g. budget minus base prompt and
    image tokens of the instance).  ``order_cols`` must be a total order inside the group.
    Null group values form groups of their own.
    """
    bud = F.col(budget) if isinstance(budget, str) else F.lit(budget)
    base = items.withColumns({"_sz": F.coalesce(F.col(size_col).cast("long"), F.lit(0).cast("long")), "_bud": bud.cast("long")})

    def fold(total, at, run):
        import numpy as np

        sizes, budgets = run.column("_sz").to_pylist(), run.column("_bud").to_pylist()
        batch, over, opened = [], [], 0
        for size, room in zip(sizes, budgets):
            fits = room is not None and (total or 0) + size < room
            if total is None:
                # The group's first item opens the first batch; only literally it counts just if it fits.
                opened, total = 1, size if fits or not faithful else 0
                over.append(not fits)
            elif fits:
                total += size
                over.append(False)
            else:
                opened += 1
                over.append(room is None or size >= room)
                total = 0 if faithful else size
            batch.append(opened)
        return total, opened, [at + np.arange(len(sizes)), batch, over]

    out = block_fold(base, group_cols, order_cols, fold,
                     {"idx": T.LongType(), "batch_no": T.LongType(), "oversize": T.BooleanType()}, "batch_no")
    if faithful:
        out = _literal_quirks(out, group_cols)
    return out.drop("_sz", "_bud")


def _join(left: DataFrame, right: DataFrame, cols: list[str]) -> DataFrame:
    """Inner join in which null keys equal each other."""
    named = right.withColumnsRenamed({c: f"_r_{c}" for c in cols})
    same = F.lit(True)
    for c in cols:
        same = same & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return left.join(named, same).drop(*[f"_r_{c}" for c in cols])


def _literal_quirks(packed: DataFrame, group_cols: list[str]) -> DataFrame:
    """Reproduce the original's losses: an item that overflows as the group's last item is never
    emitted, and a first item that overflows on its own leaves an empty batch in front."""
    ends = packed.groupBy(*group_cols).agg(
        F.max("idx").alias("_last"),
        F.max(F.when(F.col("idx") == 0, F.col("_sz") >= F.col("_bud"))).alias("_empty_first"))
    firsts = packed.groupBy(*group_cols, "batch_no").agg(F.min("idx").alias("_first"))
    p = _join(_join(packed, ends, group_cols), firsts, [*group_cols, "batch_no"])
    lost = (F.col("idx") == F.col("_last")) & (F.col("_first") == F.col("idx")) & (F.col("idx") > 0)
    shift = F.when(F.col("_empty_first"), 1).otherwise(0)
    return (p.filter(~lost).withColumn("batch_no", F.col("batch_no") + shift)
            .withColumn("oversize", F.lit(False)).drop("_last", "_first", "_empty_first"))


def batch_counts(packed: DataFrame, group_cols: list[str]) -> DataFrame:
    """Batches per group (the per-instance "prompt batches" report)."""
    return packed.groupBy(*group_cols).agg(F.countDistinct("batch_no").alias("n_batches"),
                                           F.count(F.lit(1)).alias("n_items"))
