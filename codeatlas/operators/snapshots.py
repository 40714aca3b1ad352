"""Snapshot trees, snapshot diffs and carry-forward of derived docs between snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import is_supported_ext, is_test_path


def folders(files: DataFrame, key_cols: list[str], path_col: str = "rel_path") -> DataFrame:
    """Every folder that holds a file: all proper prefixes of each relative path, distinct."""
    parts = F.split(F.col(path_col), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1),
                           lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    has_dir = F.size(parts) > 1
    return (files.filter(has_dir).select(*key_cols, F.explode(prefixes).alias("folder")).distinct())


def scan_tree(files: DataFrame, key_cols: list[str], path_col: str = "rel_path") -> DataFrame:
    """``(key, kind, path)`` with kind ``file`` for every file and ``folder`` for every folder."""
    f = files.select(*key_cols, F.lit("file").alias("kind"), F.col(path_col).alias("path")).distinct()
    d = folders(files, key_cols, path_col).select(*key_cols, F.lit("folder").alias("kind"),
                                                  F.col("folder").alias("path"))
    return f.unionByName(d)


def snapshot_diff(old: DataFrame, new: DataFrame, path_col: str = "rel_path",
                  content_col: str = "content", key_cols: list[str] | None = None) -> DataFrame:
    """Folder- and file-level changes between snapshots.

    Folders: added / removed.  Supported source files: added / removed by path, and modified
    when the bytes differ (SHA-256 compare; null content equals null content and differs from any
    other).  Other files are ignored.  Rows
    ``key + (level, change, path)``; the presentation order added, removed, modified (each
    sorted) is ``orderBy(level, change_order, path)`` on the result.  ``key_cols`` (e.g. repo and
    pair id, see ``snapshot_pairs``) diff every pair of a whole fleet of repositories in one job:
    the full outer joins are keyed on ``key + path``.
    """
    k = list(key_cols or [])

    def fs(df):
        return (df.filter(is_supported_ext(F.col(path_col)))
                .select(*k, F.col(path_col).alias("path"), F.lit(True).alias("in"),
                        F.sha2(F.col(content_col).cast("binary"), 256).alias("h")))

    def side(df, s):
        return fs(df).withColumnsRenamed({"in": f"_in{s}", "h": f"_h{s}"})

    # A file without content exists all the same, so its presence is a flag of its own.
    j = side(old, "o").join(side(new, "n"), [*k, "path"], "full_outer")
    change = (F.when(F.col("_ino").isNull(), "added").when(F.col("_inn").isNull(), "removed")
              .when(~F.col("_ho").eqNullSafe(F.col("_hn")), "modified"))
    files = j.select(*k, F.lit("file").alias("level"), change.alias("change"), "path").filter(F.col("change").isNotNull())
    fo = folders(old, k, path_col).withColumn("_o", F.lit(True))
    fn = folders(new, k, path_col).withColumn("_n", F.lit(True))
    fj = fo.join(fn, [*k, "folder"], "full_outer")
    fchange = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed")
    dirs = (fj.select(*k, F.lit("folder").alias("level"), fchange.alias("change"), F.col("folder").alias("path"))
            .filter(F.col("change").isNotNull()))
    return dirs.unionByName(files)


def snapshot_pairs(files: DataFrame, pairs: DataFrame, repo_cols: list[str], number_col: str = "number"
                   ) -> tuple[DataFrame, DataFrame]:
    """Old and new sides for a batch diff: every file of snapshot ``old_id`` and of ``new_id``
    tagged with ``(repo, new_id)`` (``pairs`` as produced by ``version_pairs``).  Equi-joins only;
    each snapshot is read for the two pairs it belongs to."""
    p = pairs.filter(F.col("old_id").isNotNull()).select(*repo_cols, "old_id", "new_id")
    old = files.join(p.withColumnRenamed("old_id", number_col), [*repo_cols, number_col]).drop(number_col)
    new = files.join(p.drop("old_id").withColumn(number_col, F.col("new_id")), [*repo_cols, number_col]).drop(number_col)
    return old, new


def changed_paths(diff: DataFrame, key_cols: list[str] | None = None) -> DataFrame:
    """File paths removed or modified by a diff (the docs that can no longer be carried)."""
    return diff.filter((F.col("level") == "file") & F.col("change").isin("removed", "modified")) \
        .select(*(key_cols or []), "path")


def carry_forward(old_docs: DataFrame, diff: DataFrame, new_key: dict | None = None, path_col: str = "rel_path",
                  literal_substring: bool = False, key_cols: list[str] | None = None) -> DataFrame:
    """Docs of files that did not change are copied to the new snapshot (key columns replaced by
    ``new_key``).  Docs of removed or modified files are dropped, as are docs of test paths.

    ``literal_substring`` reproduces the original matching rule, which drops a doc when any
    changed path is a *substring* of its path (``a.js`` changed also drops ``a.jsx``);
    see ``contains_join``.
    """
    k = list(key_cols or [])
    docs = old_docs.filter(~is_test_path(F.col(path_col)))
    changed = changed_paths(diff, k)
    if literal_substring:
        kept = docs.join(_substring_hits(docs, changed, path_col, k), [*k, path_col], "left_anti")
    else:
        kept = docs.join(changed.withColumnRenamed("path", path_col), [*k, path_col], "left_anti")
    for k, v in (new_key or {}).items():
        kept = kept.withColumn(k, F.lit(v))
    return kept


def _substring_hits(docs: DataFrame, changed: DataFrame, path_col: str, key_cols: list[str]) -> DataFrame:
    """Doc paths that contain some changed path of the same pair as a substring (keyed equi-join)."""
    from .context import contains_join

    return contains_join(docs, changed.withColumnRenamed("path", "_needle"), key_cols, path_col, "_needle") \
        .select(*key_cols, path_col).distinct()


def to_regenerate(items: DataFrame, diff: DataFrame, path_col: str = "rel_path",
                  key_cols: list[str] | None = None) -> DataFrame:
    """Items (elements or files) of the new snapshot whose file was added or modified."""
    k = list(key_cols or [])
    changed = diff.filter((F.col("level") == "file") & F.col("change").isin("added", "modified")) \
        .select(*k, F.col("path").alias(path_col))
    return items.join(changed, [*k, path_col], "left_semi")


def content_runs(files: DataFrame, repo_cols: list[str], number_col: str = "number", path_col: str = "rel_path",
                 content_col: str = "content") -> DataFrame:
    """For every file of every snapshot the snapshot in which its present content began: ``repo + (number,
    rel_path, since)``.

    A run is a stretch of consecutive snapshots of the repository that hold the file with equal bytes (null
    content equals null content).  A file that was away, or that returns to an older content, begins a new
    run.  Gaps and islands over hashes: the window holds one file's versions."""
    numbers = files.select(*repo_cols, number_col).distinct()
    place = F.row_number().over(Window.partitionBy(*repo_cols).orderBy(number_col))
    at = numbers.withColumn("_v", place).withColumnsRenamed({c: f"_j{i}" for i, c in enumerate([*repo_cols, number_col])})
    same = F.lit(True)
    for i, c in enumerate([*repo_cols, number_col]):
        same = same & F.col(c).eqNullSafe(F.col(f"_j{i}"))
    rows = files.select(*repo_cols, number_col, path_col, F.coalesce(F.sha2(F.col(content_col).cast("binary"), 256), F.lit("")).alias("_h"))
    rows = rows.join(at, same)
    versions = Window.partitionBy(*repo_cols, path_col).orderBy("_v")
    begins = (F.lag("_v").over(versions).isNull() | (F.lag("_v").over(versions) < F.col("_v") - 1)
              | (F.lag("_h").over(versions) != F.col("_h")))
    rows = rows.withColumn("_since", F.when(begins, F.col(number_col)))
    since = F.last("_since", ignorenulls=True).over(versions.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.select(*repo_cols, number_col, path_col, since.alias("since"))
