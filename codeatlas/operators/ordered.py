"""Ordered scans that stay parallel when one group holds a large share of the rows.

Several operators of the library are sequential folds in their original form (greedy packing,
greedy overlap removal).  A Spark window partitioned by the group key would put a whole group into
one task, so a hot group would serialise the job.  ``running_sum`` avoids that for prefix sums: rows are
range-partitioned on ``(group, order)`` so a large group is spread over many tasks; every task sums its own
contiguous block (vectorised, Arrow batches; nulls form a group), a small table with one row per ``(task,
group)`` block gives each block its carry-in, and a join adds it back.  ``row_index`` numbers rows by it,
``window_sum`` gives the same sums by a window, for groups that are the lines of one text.  Folds with a state
of their own are in ``blockfold``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir


def _changes(col, n: int):
    """Where a sorted Arrow column differs from its row before (rows 1 to n - 1); nulls equal nulls."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    here, before = col.slice(1), col.slice(0, n - 1)
    if pa.types.is_nested(col.type):
        return np.fromiter((x != y for x, y in zip(here.to_pylist(), before.to_pylist())), bool, n - 1)
    none = pc.xor(pc.is_null(here, nan_is_null=True), pc.is_null(before, nan_is_null=True))
    both = pc.and_(pc.is_valid(here), pc.is_valid(before))
    if pa.types.is_floating(col.type):
        both = pc.and_(both, pc.and_(pc.fill_null(pc.invert(pc.is_nan(here)), False),
                                     pc.fill_null(pc.invert(pc.is_nan(before)), False)))
    other = pc.and_(both, pc.fill_null(pc.not_equal(here, before), False))
    return pc.or_(none, other).to_numpy(zero_copy_only=False)


def row_changes(columns: list, last: list | None):
    """Which rows of a sorted Arrow batch, given by its key ``columns``, differ from the row before; ``last`` are
    the keys of the row before the batch (None: the first row differs)."""
    import numpy as np
    import pyarrow as pa

    n = len(columns[0])
    new = np.zeros(n, bool)
    for k, col in enumerate(columns):
        new[1:] |= _changes(col, n)
        new[0] |= last is None or bool(_changes(pa.concat_arrays([last[k], col.slice(0, 1)]), 2)[0])
    return new


def _block_scan(group_cols: list[str], value_cols: list[str], out_cols: list[str]):
    """Per-partition running sums within each group; the input partition is sorted by group."""

    def scan(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        last, carry = None, {}
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            new = row_changes([b.column(c) for c in group_cols], last)
            first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            open_ = first == 0 if not new[0] else np.zeros(n, bool)      # rows that go on from the batch before
            columns, names = list(b.columns), list(b.schema.names)
            for v, o in zip(value_cols, out_cols):
                x = pc.fill_null(b.column(v), 0).to_numpy(zero_copy_only=False)
                sums = np.cumsum(x)
                sums = sums - (sums[first] - x[first])
                if open_.any():
                    sums = np.where(open_, sums + carry[v], sums)
                carry[v] = sums[-1]
                columns.append(pa.array(sums, b.column(v).type))
                names.append(o)
            last = [b.column(c).slice(n - 1, 1) for c in group_cols]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(n, pid, np.int32))], names=[*names, "_pid"])

    return scan


def _listed(cols) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def window_sum(df: DataFrame, group_cols: list[str], order_cols: list[str], value_cols, out_cols) -> DataFrame:
    """``running_sum`` as a plain window.  Only for groups made from one input cell (the lines of a
    file, the snapshots of a repository), which one task held before they were split."""
    w = Window.partitionBy(*group_cols).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df
    for v, o in zip(_listed(value_cols), _listed(out_cols)):
        t = df.schema[v].dataType
        out = out.withColumn(o, F.sum(F.coalesce(F.col(v), F.lit(0).cast(t))).over(w).cast(t))
    return out


def running_sum(df: DataFrame, group_cols: list[str], order_cols: list[str], value_cols, out_cols) -> DataFrame:
    """Inclusive running sums of ``value_cols`` within ``group_cols`` ordered by ``order_cols``.

    ``order_cols`` must make the order total inside a group (end it with a unique id).  Null group
    values form a group, null values count as 0.  Equivalent to
    ``sum(value) over (partition by group order by order rows unbounded preceding)``, whatever share
    of the rows one group holds: a task sums one range of ``(group, order)``, and the number of
    ranges is the shuffle setting, which adaptive execution may lower for small inputs.
    """
    value_cols, out_cols = _listed(value_cols), _listed(out_cols)
    spark = df.sparkSession
    keys = [*group_cols, *order_cols]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    types = [df.schema[v].dataType for v in value_cols]
    schema = T.StructType(df.schema.fields + [T.StructField(o, t) for o, t in zip(out_cols, types)]
                          + [T.StructField("_pid", T.IntegerType())])
    # Materialised once: both the block totals and the final join read it, and it cuts the lineage
    # so chains of scans keep small plans and recover from a lost executor without a re-scan.
    ensure_checkpoint_dir(spark)
    scanned = ranged.mapInArrow(_block_scan(group_cols, value_cols, out_cols), schema).checkpoint()
    blocks = scanned.groupBy("_pid", *group_cols).agg(*[F.sum(v).alias(f"_blk{i}") for i, v in enumerate(value_cols)])
    before = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("_pid", *group_cols, *[
        F.coalesce(F.sum(f"_blk{i}").over(before), F.lit(0)).cast(t).alias(f"_off{i}") for i, t in enumerate(types)])
    named = offsets.withColumnsRenamed({c: f"_r{i}" for i, c in enumerate(["_pid", *group_cols])})
    same = F.col("_pid") == F.col("_r0")
    for i, c in enumerate(group_cols, 1):
        same = same & F.col(c).eqNullSafe(F.col(f"_r{i}"))
    out = scanned.join(named, same).drop(*[f"_r{i}" for i in range(len(group_cols) + 1)])
    for i, o in enumerate(out_cols):
        out = out.withColumn(o, F.col(o) + F.col(f"_off{i}"))
    return out.drop("_pid", *[f"_off{i}" for i in range(len(out_cols))])


def row_index(df: DataFrame, group_cols: list[str], order_cols: list[str], out_col: str = "idx",
              sums=running_sum) -> DataFrame:
    """0-based position of each row inside its group (``row_number() - 1``); ``sums`` is ``running_sum``, or
    ``window_sum`` for groups made from one input cell."""
    out = sums(df.withColumn("_one", F.lit(1).cast("long")), group_cols, order_cols, "_one", out_col)
    return out.withColumn(out_col, F.col(out_col) - 1).drop("_one")
