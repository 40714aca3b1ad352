"""Change-point sampling of ordered frame sequences (key frames).

Rule: take every ``step``-th frame; keep the first; keep a later frame when it differs enough from the
*last kept* frame; number the kept frames.  ``keyframes`` compares one number per frame, ``keyframes_vector`` a
feature vector.  Both are sequential in their original form and run here as a ``block_fold`` whose state is
the last kept value or vector, so a very long sequence is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blockfold import block_fold

FRAME_STEP = 2
SIMILARITY_THRESHOLD = 0.995
MEASURES = ("cosine", "abs")


def keyframes(frames: DataFrame, group_cols: list[str], order_cols: list[str], value_col: str,
              threshold: float, step: int = FRAME_STEP) -> DataFrame:
    """Kept frames: the frame's columns, ``idx`` (place among the taken frames) and ``kept_no`` (1-based).  A
    frame is kept when it differs from the last kept one by more than ``threshold``.  A frame without a value
    (null or NaN) counts for the step but is never kept nor compared with; null group values form
    sequences of their own."""
    def fold(state, at, run):
        import numpy as np

        taken = (at + np.arange(run.num_rows)) % step == 0
        values = run.column("_v").to_numpy(zero_copy_only=False).astype(np.float64)
        kept = np.zeros(run.num_rows, np.int64)
        n, last = 0, state
        usable = np.flatnonzero(taken & ~np.isnan(values))
        for i, v in zip(usable.tolist(), values[usable].tolist()):
            if last is None or abs(v - last) > threshold:
                n += 1
                last, kept[i] = v, n
        return last, n, [kept > 0, kept, (at + np.arange(run.num_rows)) // step]

    return _kept(frames.withColumn("_v", F.col(value_col).cast("double")), group_cols, order_cols, fold)


def keyframes_vector(frames: DataFrame, group_cols: list[str], order_cols: list[str], vector_col: str,
                     threshold: float = SIMILARITY_THRESHOLD, step: int = FRAME_STEP, measure: str = "cosine") -> DataFrame:
    """``keyframes`` over feature vectors: a frame is kept when its cosine with the last kept frame is below
    ``threshold`` (``cosine``), or when some component differs by more than it (``abs``).

    A vector that is null, empty or holds a null or non-finite component, and under ``cosine`` a zero
    one, counts for the step but is never kept nor compared with; a vector of another length than the
    last kept one is a change."""
    if measure not in MEASURES:
        raise ValueError(f"measure must be one of {MEASURES}")

    def usable(x) -> bool:
        import numpy as np

        return x.size > 0 and bool(np.isfinite(x).all()) and (measure == "abs" or bool(x.any()))

    def first_change(last, rows) -> int:
        """Index of the first of ``rows`` (equal lengths) that is a change, or their number."""
        import numpy as np

        if measure == "abs":
            hit = np.abs(rows - last).max(axis=1) > threshold
        else:
            norms = np.sqrt(np.einsum("ij,ij->i", rows, rows)) * np.sqrt(last @ last)
            hit = (rows * last).sum(axis=1) / norms < threshold
        return int(hit.argmax()) if hit.any() else len(rows)

    def fold(state, at, run):
        import numpy as np

        n_rows = run.num_rows
        taken = (at + np.arange(n_rows)) % step == 0
        vectors = run.column("_v").to_pylist()
        rows, places = [], []
        for i in np.flatnonzero(taken).tolist():
            x = np.array([np.nan if v is None else v for v in vectors[i] or ()], np.float64)
            if usable(x):
                rows.append(x)
                places.append(i)
        kept = np.zeros(n_rows, np.int64)
        last, n, i = state, 0, 0
        while i < len(rows):
            if last is None or len(rows[i]) != len(last):
                found = i
            else:
                # Look ahead in growing stretches: long still scenes cost few passes.
                found, reach = i, 8
                while found < len(rows) and len(rows[found]) == len(last):
                    stretch = rows[found:found + reach]
                    same = next((k for k, x in enumerate(stretch) if len(x) != len(last)), len(stretch))
                    k = first_change(last, np.stack(stretch[:same]))
                    found += k
                    if k < same:
                        break
                    reach = min(1024, reach * 2)
            if found >= len(rows):
                break
            n += 1
            last, kept[places[found]] = rows[found], n
            i = found + 1
        return last, n, [kept > 0, kept, (at + np.arange(n_rows)) // step]

    return _kept(frames.withColumn("_v", F.col(vector_col).cast("array<double>")), group_cols, order_cols, fold)


def _kept(frames: DataFrame, group_cols: list[str], order_cols: list[str], fold) -> DataFrame:
    out = block_fold(frames, group_cols, order_cols, fold,
                     {"_kept": T.BooleanType(), "kept_no": T.LongType(), "idx": T.LongType()}, "kept_no")
    return out.filter("_kept").drop("_kept", "_v")


def keyframe_counts(kept: DataFrame, frames: DataFrame, group_cols: list[str]) -> DataFrame:
    """Per sequence: frames saved and total frames (the original progress report)."""
    total = frames.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("total_frames"))
    saved = kept.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("saved_frames"))
    return total.join(saved, group_cols, "left").fillna(0, ["saved_frames"])
