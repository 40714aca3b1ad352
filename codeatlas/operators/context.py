"""Context assembly: path matching, doc attachment, dedup and pruning of file text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shuffled

# Characters of the substrings that long needles are looked up by.
GRAM = 8


def path_suffixes(path) -> F.Column:
    """Every ``/``-component suffix of a path: ``a/b/c`` -> ``a/b/c``, ``b/c``, ``c``."""
    parts = F.split(path if not isinstance(path, str) else F.col(path), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)),
                       lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "/"))


def _grams(text: str, width: F.Column) -> F.Column:
    """Distinct substrings of ``width`` characters of a column (none when it is shorter)."""
    last = F.char_length(text) - width + 1
    starts = F.when(last > 0, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(F.col(text), i, width)))


def contains_join(haystack: DataFrame, needles: DataFrame, scope_cols: list[str], hay_col: str,
                  needle_col: str) -> DataFrame:
    """Pairs (haystack row, needle row) with ``needle in hay`` inside the same scope.

    An equi-join on one substring of each needle.  A needle of at most ``GRAM`` characters is its own
    key and needs no further test.  A longer one keys on that of its ``GRAM``-character substrings which
    the fewest haystack texts of its scope hold, and ``contains`` settles the rest, so a shared folder
    prefix or a common file name draws no candidates while the needle has anything rarer.  Null texts
    and empty needles pair with nothing; null scopes match each other."""
    scope = F.struct(*scope_cols) if scope_cols else F.lit(0)
    hay = haystack.select(F.to_json(F.struct(scope.alias("s")), {"ignoreNullFields": "false"}).alias("_s"),
                          *scope_cols, F.col(hay_col).alias("_hay")).distinct().filter(F.col("_hay").isNotNull())
    ndl = needles.select(F.to_json(F.struct(scope.alias("s")), {"ignoreNullFields": "false"}).alias("_s"),
                         F.col(needle_col).alias("_needle")).distinct().filter(F.char_length("_needle") > 0)
    short = ndl.filter(F.char_length("_needle") <= GRAM).select("_s", "_needle", F.col("_needle").alias("_key"))
    # Only the lengths that short needles have are cut from the haystack.
    lengths = short.select("_s", F.char_length("_key").alias("_len")).distinct()
    pieces = hay.join(lengths, "_s").select("_s", *scope_cols, "_hay", F.explode(_grams("_hay", F.col("_len"))).alias("_key"))
    exact = pieces.join(short, ["_s", "_key"])
    long = ndl.filter(F.char_length("_needle") > GRAM)
    grams = hay.join(long.select("_s").distinct(), "_s", "left_semi") \
        .select("_s", *scope_cols, "_hay", F.explode(_grams("_hay", F.lit(GRAM))).alias("_key"))
    holders = grams.groupBy("_s", "_key").agg(F.count(F.lit(1)).alias("_n"))
    rare = long.select("_s", "_needle", F.explode(_grams("_needle", F.lit(GRAM))).alias("_key")).join(holders, ["_s", "_key"]) \
        .groupBy("_s", "_needle").agg(F.min_by("_key", F.struct("_n", "_key")).alias("_key"))
    tested = grams.join(rare, ["_s", "_key"]).filter(F.col("_hay").contains(F.col("_needle")))
    cols = [*scope_cols, F.col("_hay").alias(hay_col), F.col("_needle").alias(needle_col)]
    return exact.select(*cols).unionByName(tested.select(*cols))


def match_paths(needles: DataFrame, files: DataFrame, scope_cols: list[str], needle_col: str = "needle",
                path_col: str = "rel_path", mode: str = "suffix") -> DataFrame:
    """Files named by needles (retrieved / localised paths) inside the same scope.

    ``suffix`` (default): the needle equals a whole-component suffix of the file path - an
    equi-join on exploded suffixes.  ``substring``: the original ``needle in path`` test
    (``a.js`` also hits ``aa.jsx``), via ``contains_join``.  Duplicates removed."""
    if mode == "substring":
        return contains_join(files, needles, scope_cols, path_col, needle_col)
    suf = files.select(*scope_cols, path_col, F.explode(path_suffixes(path_col)).alias(needle_col))
    return suf.join(shuffled(needles.select(*scope_cols, needle_col).distinct()), [*scope_cols, needle_col]) \
        .select(*scope_cols, path_col, needle_col).distinct()


def attach_docs(items: DataFrame, docs: DataFrame, keys: list[str], doc_col: str = "doc",
                missing: str = "None") -> DataFrame:
    """Left join of docs with a literal for missing ones."""
    return items.join(docs.select(*keys, doc_col), keys, "left") \
        .withColumn(doc_col, F.coalesce(F.col(doc_col), F.lit(missing)))


def docs_for_file(docs: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """Docs of the elements of the listed files; a file listed twice counts once."""
    return docs.join(files.select(*keys), keys, "left_semi")


def attach_element_type(docs: DataFrame, meta: DataFrame, keys: list[str], order_col: str = "ordinal") -> DataFrame:
    """Type of each documented element from the metadata: none -> ``''``, several -> the last
    (``max_by`` over the metadata order, an aggregation rather than a window)."""
    last = meta.groupBy(*keys).agg(F.max_by("type", order_col).alias("type"))
    return docs.join(last, keys, "left").withColumn("type", F.coalesce(F.col("type"), F.lit("")))


def attach_instance(rows: DataFrame, instances: DataFrame, key_cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """``(joined, quarantine)``: rows with their instance record, and rows whose key is missing.

    The instances of a task are hashed and the rows stream past them, so a task sorts neither and holds
    no rows; adaptive execution still splits the rows of a hot instance."""
    joined = rows.join(instances.hint("shuffle_hash"), key_cols)
    return joined, rows.join(instances.select(*key_cols).hint("shuffle_hash"), key_cols, "left_anti")


def distinct_knowledge(df: DataFrame, cols: list[str], order_col: str) -> DataFrame:
    """Records deduplicated on ``cols``, keeping the first by ``order_col`` (hash aggregation)."""
    return df.groupBy(*cols).agg(F.min(order_col).alias(order_col))


def first_doc_wins(elements: DataFrame, keys: list[str], order_col: str, value_cols: list[str]) -> DataFrame:
    """For elements listed twice under the same key, only the first (by ``order_col``) counts."""
    best = elements.groupBy(*keys).agg(F.min_by(F.struct(order_col, *value_cols), F.col(order_col)).alias("_f"))
    return best.select(*keys, "_f.*")


def file_description(items: DataFrame, key_cols: list[str], order_col: str, text_col: str) -> DataFrame:
    """Per file: its element descriptions numbered ``1. ...``, ``2. ...`` in element order, each
    followed by a blank line.  One row per file; bounded by the file's own elements."""
    g = items.groupBy(*key_cols).agg(F.array_sort(F.collect_list(F.struct(order_col, text_col))).alias("_d"))
    numbered = F.transform("_d", lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s[text_col], F.lit("\n")))
    return g.select(*key_cols, F.array_join(numbered, "").alias("description"))


def prune_context(files: DataFrame, elements: DataFrame, key_cols: list[str], keep_col: str = "keep",
                  order_col: str = "ordinal", content_col: str = "content") -> DataFrame:
    """File text with the signature and the text of every element *not* kept removed - global
    string replacement, element by element in element order (an empty search string is a no-op).
    Elements are folded per file with ``aggregate``; the fold is bounded by the file."""
    drop = elements.filter(~F.col(keep_col)).groupBy(*key_cols).agg(
        F.array_sort(F.collect_list(F.struct(order_col, "signature", "text"))).alias("_e"))
    j = files.join(shuffled(drop), key_cols, "left")

    def rm(acc, s):
        return F.when(s == "", acc).otherwise(F.replace(acc, s, F.lit("")))

    folded = F.aggregate(F.col("_e"), F.col(content_col), lambda acc, e: rm(rm(acc, e["signature"]), e["text"]))
    return j.select(*key_cols, F.when(F.col("_e").isNull(), F.col(content_col)).otherwise(folded).alias("pruned"))


def element_diff(old: DataFrame, new: DataFrame, key_cols: list[str], content_col: str = "content") -> DataFrame:
    """Element-level diff: added / removed by key, modified when the text's SHA-256 differs.  Null
    content equals null content; an element without content exists all the same."""
    def side(df, s):
        return df.select(*key_cols, F.lit(True).alias(f"_in{s}"), F.sha2(F.col(content_col), 256).alias(f"_h{s}"))

    j = side(old, "o").join(side(new, "n"), key_cols, "full_outer")
    change = (F.when(F.col("_ino").isNull(), "added").when(F.col("_inn").isNull(), "removed")
              .when(~F.col("_ho").eqNullSafe(F.col("_hn")), "modified"))
    return j.select(*key_cols, change.alias("change")).filter(F.col("change").isNotNull())
