"""Fenced-block readers for model answers: listed lines, (file, element) pairs, ranked files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines, strip

# Fixed values of the answer format.
FENCE_BLOCK = r"(?s)```(.*?)```"
FENCE_BODY = r"(?s)```(?:.*?\n)?(.*?)```"
NO_ELEMENTS_MARKER = "This file contains no relevant functions/classes"


def fenced_lines(text) -> Column:
    """Every non-blank stripped line of every fenced block, in order (language tags and quoted
    output inside fences count as lines, as in the original reader)."""
    t = F.col(text) if isinstance(text, str) else text
    blocks = F.regexp_extract_all(t, F.lit(FENCE_BLOCK), 1)
    per_block = F.transform(blocks, lambda b: F.filter(F.transform(lines(strip(b)), strip), lambda x: x != ""))
    return F.flatten(per_block)


def explode_fenced_lines(df: DataFrame, key_cols: list[str], text_col: str) -> DataFrame:
    """Rows ``key + (rank, line)``, rank 1-based in answer order (no window: the order is the
    array position inside the one answer row)."""
    return df.select(*key_cols, F.posexplode(fenced_lines(text_col)).alias("_p", "line")) \
        .select(*key_cols, (F.col("_p") + 1).alias("rank"), "line")


def ranked_files(df: DataFrame, key_cols: list[str], text_col: str, max_files: int | None = None) -> DataFrame:
    """Localised files in importance order: fenced lines that look like paths, ranked by position.
    ``max_files`` keeps the first n (the reader itself does not cap)."""
    paths = F.filter(fenced_lines(text_col), lambda x: x.contains("/") | x.contains("\\"))
    out = df.select(*key_cols, F.posexplode(paths).alias("_p", "rel_path")) \
        .select(*key_cols, (F.col("_p") + 1).alias("rank"), "rel_path")
    return out if max_files is None else out.filter(F.col("rank") <= max_files)


def _before_summary(text: Column) -> Column:
    """Lines up to the first one mentioning Summary/SUMMARY, minus marker lines, re-joined."""
    ls = lines(text)
    # A marker line is skipped before the stop test, so it never stops the reading.
    stop = F.array_position(F.transform(ls, lambda x: (x.contains("Summary") | x.contains("SUMMARY"))
                                        & ~x.contains(NO_ELEMENTS_MARKER)), True)
    # slice (not an index test inside the lambda): the stop position is computed once per row.
    head = F.slice(ls, 1, F.when(stop > 0, stop - 1).otherwise(F.size(ls)))
    return F.array_join(F.filter(head, lambda x: ~x.contains(NO_ELEMENTS_MARKER)), "\n")


def fenced_elements(df: DataFrame, key_cols: list[str], text_col: str) -> DataFrame:
    """``key + (rel_path, element)`` from answers listing a file then ``function: x`` lines.

    Reading stops at the first line mentioning Summary; in each fence the line with the opening
    fence is skipped; the first remaining line must contain a path separator and names the file
    (otherwise the block is ignored); every further line contributes the text after its last
    ``:``.  Per file the elements form a set; a file listed without elements gets one row with a
    null element.
    """
    blocks = F.regexp_extract_all(_before_summary(F.col(text_col)), F.lit(FENCE_BODY), 1)
    # The lines are made inside the explode, so no later step works them out again.
    listed = F.transform(blocks, lambda b: F.filter(F.transform(lines(b), strip), lambda x: x != ""))
    b = df.select(*key_cols, F.explode(listed).alias("_ls"))
    b = b.select(*key_cols, F.get("_ls", 0).alias("rel_path"),
                 F.transform(F.slice("_ls", 2, F.greatest(F.size("_ls") - 1, F.lit(0))),
                             lambda x: strip(F.element_at(F.split(x, ":", -1), -1))).alias("_els")) \
        .filter(F.col("rel_path").contains("/") | F.col("rel_path").contains("\\"))
    # One pass: the set of elements per (answer, file) - bounded by that answer's text - then
    # one row per element, or one row with a null element for a file listed without any.
    sets = b.groupBy(*key_cols, "rel_path").agg(F.array_distinct(F.flatten(F.collect_list("_els"))).alias("_set"))
    return sets.select(*key_cols, "rel_path", F.explode_outer("_set").alias("element"))
