"""Row filters of the catalog stage: minified twins and blocklists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import minified_twin

# Vendored bundles never catalogued.
BLOCKED_PATH_PARTS = ("mermaid.min.js", "video.min.js")


def drop_minified_twins(files: DataFrame, key_cols: list[str], path_col: str = "rel_path") -> DataFrame:
    """Drop ``x.min.js`` when ``x.js`` exists in the same snapshot (order-free: an anti-join of
    each minified file's twin name against the snapshot's paths)."""
    present = files.select(*key_cols, F.col(path_col).alias("_twin"))
    mins = files.withColumn("_twin", minified_twin(F.col(path_col)))
    doomed = mins.filter(F.col("_twin").isNotNull()).join(present, [*key_cols, "_twin"], "left_semi") \
        .select(*key_cols, path_col)
    return files.join(doomed, [*key_cols, path_col], "left_anti")


def drop_blocklisted(df: DataFrame, blocked_keys: DataFrame | None = None, key_cols: list[str] | None = None,
                     path_col: str | None = None, path_parts=BLOCKED_PATH_PARTS) -> DataFrame:
    """Remove rows whose key is in ``blocked_keys`` (anti-join; adaptive
    execution broadcasts the list when its measured size allows) and rows whose path contains one of the
    fixed ``path_parts`` (a single JVM-side predicate, pushed below the scan's projection)."""
    out = df
    if blocked_keys is not None:
        out = out.join(blocked_keys.select(*key_cols).distinct(), key_cols, "left_anti")
    if path_col is not None and path_parts:
        hit = F.lit(False)
        for p in path_parts:
            hit = hit | F.col(path_col).contains(p)
        out = out.filter(~hit)
    return out
