"""Sequential folds over ordered groups, one block of rows per task.

A fold visits the rows of a group in order and carries a state (the last kept frame, the open batch's
total).  Rows are range-partitioned on ``(group, order)``, so a group that holds a large share of the rows
lies in many tasks, and a task doesn't know the state in which its first rows are reached.  It folds them
as if a group began there, and returns the state behind its last row.  Then every task whose true entry
state differs from the one it assumed is folded again, and so on until none differs.

A block's last state seldom depends on its first one (a later frame is kept from either, a batch closes at
the same item), so the second round is the last one as a rule; the result is exact whatever happens, after
at most as many rounds as a group has blocks.  The driver sees one entry and one exit state per task.  Rows
are read in order once a round, each round is checkpointed, and a lost task repeats its own block.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir
from .ordered import row_changes

# fold(state, at, run) -> (state, numbers, columns): ``run`` is an Arrow batch of rows of one group in order, the
# first of them the ``at``-th of its group (from 0); ``state`` is None where the group begins.  ``numbers`` is how far
# the group's numbering moved on, ``columns`` are numpy arrays or lists for the declared output columns.
Fold = Callable[[object, int, object], tuple[object, int, list]]


def _runs(batches, group_cols: list[str]):
    """(starts a new group, group values, batch) for each stretch of one group in sorted batches."""
    import numpy as np

    last = None
    for b in batches:
        if not b.num_rows:
            continue
        new = row_changes([b.column(c) for c in group_cols], last)
        last = [b.column(c).slice(b.num_rows - 1, 1) for c in group_cols]
        edges = [0, *(np.flatnonzero(new[1:]) + 1).tolist(), b.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            yield bool(new[lo]), b.slice(lo, hi - lo)


def _key(run, group_cols: list[str]) -> bytes:
    return pickle.dumps([run.column(c)[0].as_py() for c in group_cols])


def _ends(group_cols: list[str]):
    """Per task: its first and last group and their rows."""
    def scan(batches):
        import pyarrow as pa

        first = last = None
        n_first = n_last = runs = pid = 0
        for new, run in _runs(batches, group_cols):
            pid = run.column("_pid")[0].as_py()
            if new:
                last, n_last, runs = _key(run, group_cols), 0, runs + 1
                first = last if first is None else first
            n_last += run.num_rows
            n_first += run.num_rows if runs == 1 else 0
        if runs:
            yield pa.RecordBatch.from_pydict({"pid": [pid], "first": [first], "last": [last], "n_first": [n_first],
                                              "n_last": [n_last], "runs": [runs]},
                                             pa.schema([("pid", pa.int32()), ("first", pa.binary()), ("last", pa.binary()),
                                                        ("n_first", pa.int64()), ("n_last", pa.int64()), ("runs", pa.int64())]))

    return scan


def _folded(group_cols: list[str], fold: Fold, types: list, entries: dict[int, tuple[int, bytes]], number: str):
    """One round over the tasks of ``entries``.  The last row of a task carries its exit state."""
    def scan(batches):
        import numpy as np
        import pyarrow as pa

        pid, state, at, count, first_run, held = None, None, 0, 0, True, None

        def finish(last_state: bytes | None, n: int):
            rows = held.num_rows
            exits = [None] * (rows - 1) + [last_state]
            return pa.RecordBatch.from_arrays(
                [*held.columns, pa.array(exits, pa.binary()), pa.array([n] * rows, pa.int64())],
                names=[*held.schema.names, "_exit", "_moved"])

        for new, run in _runs(batches, group_cols):
            if pid is None:
                pid = run.column("_pid")[0].as_py()
                at, entry = entries[pid]
                state = pickle.loads(entry)
            elif new:
                state, at, count, first_run = None, 0, 0, False
            state, moved, columns = fold(state, at, run)
            at += run.num_rows
            if held is not None:
                yield finish(None, 0)
            arrays = []
            for (name, kind), values in zip(types, columns):
                values = np.asarray(values) + count if name == number else values
                arrays.append(pa.array(values, kind))
            count += moved
            held = pa.RecordBatch.from_arrays([*run.columns, *arrays, pa.array([first_run] * run.num_rows)],
                                              names=[*run.schema.names, *(n for n, _ in types), "_first"])
        if held is not None:
            yield finish(pickle.dumps(state), count)

    return scan


def block_fold(df: DataFrame, group_cols: list[str], order_cols: list[str], fold: Fold, columns: dict[str, T.DataType],
               number: str) -> DataFrame:
    """``df`` with the fold's ``columns``.  ``order_cols`` must be a total order inside the group; null group
    values form groups.  ``number`` names the column whose values the fold counts from the start of its
    run; it comes out counted from the start of the group."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    keys = [*group_cols, *order_cols]
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_pid", F.spark_partition_id()).checkpoint()
    ends = sorted(rows.mapInArrow(_ends(group_cols), "pid int, first binary, last binary, n_first long, n_last long, runs long").collect())
    # Rows of a task's first group that lie in the tasks before it, and the task it continues.
    before: dict[int, int] = {}
    onward: dict[int, int] = {}
    last = None
    for e in ends:
        goes_on = last is not None and e["first"] == last["last"]
        before[e["pid"]] = (before[last["pid"]] if last["runs"] == 1 else 0) + last["n_last"] if goes_on else 0
        if goes_on:
            onward[e["pid"]] = last["pid"]
        last = e
    single = {e["pid"] for e in ends if e["runs"] == 1}
    types = [(n, to_arrow_type(t)) for n, t in columns.items()]
    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, t) for n, t in columns.items()), T.StructField("_first", T.BooleanType()),
                           T.StructField("_exit", T.BinaryType()), T.StructField("_moved", T.LongType())])
    start = pickle.dumps(None)
    entries = {e["pid"]: (before[e["pid"]], start) for e in ends}
    todo, rounds, exits, valid = dict(entries), [], {}, {}
    while todo:
        own = rows if len(todo) == len(entries) else rows.filter(F.col("_pid").isin(list(todo)))
        done = own.mapInArrow(_folded(group_cols, fold, types, todo, number), schema).checkpoint()
        for r in done.filter("_exit is not null").select("_pid", "_exit", "_moved").collect():
            exits[r["_pid"]] = (bytes(r["_exit"]), r["_moved"])
            valid[r["_pid"]] = len(rounds)
        rounds.append(done)
        then = {p: (before[p], exits[q][0]) for p, q in onward.items()}
        todo = {p: e for p, e in then.items() if e != entries[p]}
        entries |= todo
    if not rounds:
        return df.withColumns({n: F.lit(None).cast(t) for n, t in columns.items()}).limit(0)
    moved: dict[int, int] = {}
    for e in ends:
        q = onward.get(e["pid"])
        moved[e["pid"]] = 0 if q is None else exits[q][1] + (moved[q] if q in single else 0)
    # One row per task.
    pick = F.broadcast(spark.createDataFrame([(p, r, moved[p]) for p, r in valid.items()], "_pid int, _round int, _offset long"))
    out = rounds[0].withColumn("_round", F.lit(0))
    for i, done in enumerate(rounds[1:], 1):
        out = out.unionByName(done.withColumn("_round", F.lit(i)))
    out = out.join(pick, ["_pid", "_round"])
    out = out.withColumn(number, F.when(F.col("_first"), F.col(number) + F.col("_offset")).otherwise(F.col(number)))
    return out.select(*df.columns, *columns)
