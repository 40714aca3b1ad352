"""Incremental processing: union of splits, last-row-wins instance table, resume (work minus
done), readiness (work with upstream present)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import row_index, window_sum


def union_splits(dev: DataFrame, test: DataFrame, split_col: str = "split") -> DataFrame:
    """List form of the instance table: every row of dev then test, tagged with its split."""
    return (dev.withColumn(split_col, F.lit("dev"))
            .unionByName(test.withColumn(split_col, F.lit("test")), allowMissingColumns=True))


def load_instances(dev: DataFrame, test: DataFrame, key_cols: list[str], order_cols: list[str],
                   split_col: str = "split") -> DataFrame:
    """Dict form: one row per key, the last one in (dev rows, then test rows) order, so test
    overrides dev and a later row overrides an earlier one of the same split.

    ``order_cols`` give the row position inside a split.  Implemented as ``max_by`` over a
    struct, i.e. a hash aggregation with map-side partial aggregation: no sort of a whole
    key group and no window, so a key with many rows costs no more than a sum over it.
    """
    both = union_splits(dev, test, split_col)
    rank = F.when(F.col(split_col) == "test", 1).otherwise(0)
    payload = [c for c in both.columns if c not in key_cols]
    order = F.struct(rank.alias("_r"), *[F.col(c) for c in order_cols])
    best = both.groupBy(*key_cols).agg(F.max_by(F.struct(*payload), order).alias("_row"))
    return best.select(*key_cols, "_row.*")


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Resume: work items whose output does not exist yet."""
    return work.join(done.select(*keys), keys, "left_anti")


def ready_inputs(work: DataFrame, upstream: DataFrame, keys: list[str]) -> DataFrame:
    """Work items whose upstream artefact exists."""
    return work.join(upstream.select(*keys).distinct(), keys, "left_semi")


def pending_batched(work: DataFrame, done: DataFrame, instance_cols: list[str], batch_col: str,
                    literal: bool = False) -> DataFrame:
    """Resume for outputs written in batches, keyed on ``(instance, batch)``.

    ``literal=True`` keeps the original rule: an instance is skipped only when some output
    exists and it has fewer than 2 batches; instances with 2+ batches are redone entirely.
    """
    keys = [*instance_cols, batch_col]
    if not literal:
        return pending(work, done, keys)
    per_inst = done.groupBy(*instance_cols).agg(F.countDistinct(batch_col).alias("_nb"))
    skip = per_inst.filter(F.col("_nb") < 2).select(*instance_cols)
    return work.join(skip, instance_cols, "left_anti")


def version_pairs(versions: DataFrame, repo_cols: list[str], number_col: str = "number") -> DataFrame:
    """Consecutive snapshot pairs per repo in ascending numeric order, with the label
    ``repo: old -> new``.  The first snapshot pairs with null (full generation).

    One window over the distinct snapshot numbers of each repository.
    """
    v = versions.select(*repo_cols, F.col(number_col).cast("long").alias("new_id")).distinct()
    w = Window.partitionBy(*repo_cols).orderBy("new_id")
    out = v.withColumn("old_id", F.lag("new_id").over(w)) \
        .withColumn("_i", F.row_number().over(w).cast("long") - 1)
    repo = F.concat_ws("/", *[F.col(c).cast("string") for c in repo_cols])
    label = F.when(F.col("old_id").isNotNull(),
                   F.concat(repo, F.lit(": "), F.col("old_id").cast("string"), F.lit(" -> "),
                            F.col("new_id").cast("string")))
    return out.select(*repo_cols, "old_id", "new_id", F.col("_i").alias("version_no"), label.alias("label"))


def list_versions(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """``org/name/number/...`` paths -> distinct ``(repo, number)`` with integer numbers and the
    ascending position of each number inside its repo (rows, not a collected list)."""
    parts = F.split(F.col(path_col), "/")
    v = (paths.select(F.concat_ws("/", F.get(parts, 0), F.get(parts, 1)).alias("repo"),
                      F.get(parts, 2).try_cast("long").alias("number"))
         .filter(F.col("number").isNotNull()).distinct())
    return row_index(v, ["repo"], ["number"], "version_no", window_sum)
