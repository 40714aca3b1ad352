"""Threshold-scaled sketches: every shingle hash below a fixed fraction of the hash space is kept."""

from __future__ import annotations

import json
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHINGLE_WORDS = 5
SCALE_BITS = 2          # kept: hashes whose top bits are zero, one in four
RANGE_BYTES = 1 << 28   # text bytes of a range of doc_id in which neighbours are looked up, about


def sketch(text: Column, shingle_words: int = SHINGLE_WORDS, scale_bits: int = SCALE_BITS) -> Column:
    """Sorted distinct hashes of the word shingles of ``text`` below 2^64 / 2^scale_bits.

    Fewer words than a shingle: the whole sequence is the one shingle; null or blank: no shingle.
    Sketches of the same parameters merge by union, and a sketch of a union is the union of sketches.
    """
    blank = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", " " * 5)

    def shingles(ws: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(ws) - shingle_words)
        long = F.transform(starts, lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(shingle_words)]))
        short = F.when(F.size(ws) > 0, F.array(F.xxhash64(F.array_join(ws, " ")))).otherwise(F.array().cast("array<bigint>"))
        return F.when(F.size(ws) >= shingle_words, long).otherwise(short)

    # The outer transform binds the split words once.
    hashes = F.get(F.transform(F.array(F.array_remove(F.split(blank, " "), "")), shingles), F.lit(0))
    return F.sort_array(F.array_distinct(F.filter(hashes, lambda h: F.shiftrightunsigned(h, 64 - scale_bits) == 0)))


def printed(text_hash: Column, sk: Column) -> Column:
    """The fingerprint as a string: hash of the whole text, then the sketch, in hexadecimal."""
    return F.concat(F.hex(text_hash), F.lit(":"), F.array_join(F.transform(sk, F.hex), ","))


def likeness(a: Column, b: Column, same: Column) -> Column:
    """Estimated Jaccard similarity of two sketches; 1 for equal texts, 0 when both are empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(same, 1.0).when(either == 0, 0.0).otherwise(both / either)


def containment(a: Column, b: Column, same: Column) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has; 1 for equal texts, 0 for an empty sketch."""
    return F.when(same, 1.0).when(F.size(a) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def range_of(value: Column, edges: list[int]) -> Column:
    """How many of the ascending ``edges`` are at or below ``value`` (null: none), by two short searches."""
    if not edges:
        return F.lit(0)
    step = isqrt(len(edges) - 1) + 1
    parts = [edges[i:i + step] for i in range(0, len(edges), step)]
    # Written as text: one literal instead of one per edge.
    first = F.from_json(F.lit(json.dumps([x[0] for x in parts])), "array<bigint>")
    all_ = F.from_json(F.lit(json.dumps(parts)), "array<array<bigint>>")
    part = F.size(F.filter(first, lambda x: x <= value))
    inner = F.size(F.filter(F.get(all_, part - 1), lambda x: x <= value))
    return F.when(part == 0, 0).otherwise((part - 1) * step + inner)


def with_next(docs: DataFrame, columns: list[str], ranges: int | None = None,
              derived: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, th, ...) -> the rows with ``next``: a struct of ``columns`` of the row that follows in
    descending doc_id (null ids last, ties by th); after the last row the first one.  ``derived``
    columns are computed on the way, once for each row.

    No global order is built: ids fall into ranges between quantiles (the driver gets those numbers
    only), a window runs within each range, and of each range a copy of its first row goes to the
    range before it.  There are as many ranges as the bytes of ``text`` ask for.
    """
    spark = docs.sparkSession
    n = ranges
    if not n:
        size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        n = max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-size // RANGE_BYTES))
    ids = docs.select(F.col("doc_id").cast("double").alias("d"))
    edges = sorted({int(x) for x in ids.approxQuantile("d", [i / n for i in range(1, n)], 0.25 / n)})
    rows = docs.withColumn("range", range_of(F.col("doc_id"), edges).cast("int"))
    order = F.struct(F.col("doc_id").isNull(), F.bitwise_not("doc_id"), F.col("th"))
    heads = rows.groupBy("range").agg(F.min(F.struct(order.alias("o"), "doc_id", "th")).alias("h"))
    # The range before, in descending order; the highest range's head follows the lowest range.
    up = Window.orderBy("range")
    heads = heads.select(F.coalesce(F.lead("range").over(up), F.first("range").over(up)).alias("to"),
                         F.col("h.doc_id").alias("hid"), F.col("h.th").alias("hth"))
    copies = (rows.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("hid")) & (F.col("th") == F.col("hth")))
              .dropDuplicates(["to"]).withColumn("range", F.col("to")).drop("to", "hid", "hth"))
    both = rows.withColumn("copy", F.lit(0)).unionByName(copies.withColumn("copy", F.lit(1)))
    both = both.withColumns(derived or {})
    w = Window.partitionBy("range").orderBy("copy", F.col("doc_id").desc_nulls_last(), "th")
    return (both.withColumn("next", F.lead(F.struct(*columns)).over(w)).where("copy = 0").drop("range", "copy"))


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, scale_bits: int = SCALE_BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, contained_edited, contained_next.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by as many from
    the start of the next document's text.  A null text counts as empty; an empty text, or one whose
    sketch is empty, is like an equal text only; rows that repeat follow one another; a single row
    follows itself; an empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    rows = (docs.select("doc_id", text.alias("text")).withColumn("th", F.xxhash64("text")))
    rows = with_next(rows, ["text", "th", "sk"], derived={"sk": sketch(F.col("text"), shingle_words, scale_bits)})
    half = F.floor(F.char_length("text") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.char_length("text") - half),
                                              F.substring("next.text", F.lit(1), half)))
    rows = rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "th", "sk", "edited",
                       F.col("next.th").alias("nth"), F.col("next.sk").alias("nsk"))
    rows = rows.withColumn("eth", F.xxhash64("edited")).withColumn("esk", sketch(F.col("edited"), shingle_words, scale_bits))
    c = F.col
    return rows.select(
        "doc_id", "n_chars", F.sha2(c("edited").cast("binary"), 256).alias("edited_sha256"),
        printed(c("th"), c("sk")).alias("fingerprint"), printed(c("eth"), c("esk")).alias("edited_fingerprint"),
        likeness(c("sk"), c("esk"), c("th") == c("eth")).alias("near_edited"),
        likeness(c("sk"), c("nsk"), c("th") == c("nth")).alias("near_next"),
        containment(c("sk"), c("esk"), c("th") == c("eth")).alias("contained_edited"),
        containment(c("sk"), c("nsk"), c("th") == c("nth")).alias("contained_next"))
