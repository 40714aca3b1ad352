"""Interaction of document filters: failure masks, with exact duplicates found by radix tries over texts that
are range-partitioned by adaptive prefixes."""

from __future__ import annotations

import hashlib
import json
import re
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, write_table

FILTERS = "ABCDE"                       # bits 1, 2, 4, 8, 16 of a mask
MIN_WORDS, MIN_DISTINCT, MOST_CAPITALS = 50, 65, 5        # words; percent of words; percent of characters
MARKS = re.compile(rb"[#$%&*|]")
PREFIXES = (16, 64, 256, 1024, 4096, 16_384, 65_536)      # code points; longer texts are told apart whole
WHOLE = len(PREFIXES)
TRIE_ROWS = 20_000                      # texts of one trie
TRIE_BYTES = 1 << 25
TASK_BYTES = 1 << 25
TASK_ROWS = 10 * TRIE_ROWS              # short and empty texts ask for tasks too
BROADCAST_ROWS = 500_000                # of (level, hash) rows; a longer list is joined by a shuffle


class Node:
    """A node of a compressed trie: the bytes on the edge to it, its children by first byte, and for a text that
    ends here its smallest id, its filter mask and its rows."""

    __slots__ = ("label", "kids", "low", "mask", "rows")

    def __init__(self, label: bytes):
        self.label, self.kids, self.low, self.mask, self.rows = label, {}, None, 0, None


def _shared(label: bytes, text: bytes, at: int) -> int:
    """How many bytes of ``label`` the text has from ``at`` on."""
    n = min(len(label), len(text) - at)
    other = np.frombuffer(label, np.uint8, n) != np.frombuffer(text, np.uint8, n, at)
    return int(other.argmax()) if other.any() else n


def insert(root: Node, text: bytes) -> Node:
    """The node at which ``text`` ends, made where it is new."""
    node, at = root, 0
    while at < len(text):
        kid = node.kids.get(text[at])
        if kid is None:
            kid = node.kids[text[at]] = Node(text[at:])
            return kid
        if text.startswith(kid.label, at):
            node, at = kid, at + len(kid.label)
            continue
        n = _shared(kid.label, text, at)
        fork = node.kids[text[at]] = Node(kid.label[:n])
        kid.label = kid.label[n:]
        fork.kids[kid.label[0]] = kid
        node, at = fork, at + n
    return node


def terminals(root: Node, spell: bool = False):
    """(node, its text or None) where texts end, parents first."""
    todo = [(root, b"" if spell else None)]
    while todo:
        node, text = todo.pop()
        if node.rows is not None:
            yield node, text
        todo.extend((kid, text + kid.label if spell else None) for kid in node.kids.values())


def text_mask(text: bytes, chars: int) -> int:
    """Bits of filters A to D that the text fails."""
    words = text.split()
    capitals = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return ((len(words) < MIN_WORDS) + 2 * (100 * len(set(words)) < MIN_DISTINCT * len(words))
            + 4 * (100 * capitals > MOST_CAPITALS * chars) + 8 * (MARKS.search(text) is not None))


def _levels(text: Column, chars: Column) -> list[Column]:
    """A text's prefix hash at each length that is shorter than it (else null), and that of the whole text."""
    return [F.when(chars > n, F.xxhash64(F.substring(text, 1, n))) for n in PREFIXES] + [F.xxhash64(text)]


def heavy_prefixes(docs: DataFrame) -> DataFrame:
    """(level, h, n, bytes) of the prefixes that more texts share than a trie may hold, counted over all texts."""
    t = F.coalesce("text", F.lit(""))
    size = F.octet_length(t).cast("long").alias("bytes")
    rows = docs.select(F.posexplode(F.array(*_levels(t, F.char_length(t)))).alias("level", "h"), size).where("h is not null")
    return cut(rows.groupBy("level", "h").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
               .where((F.col("n") > TRIE_ROWS) | (F.col("bytes") > TRIE_BYTES)))


def by_prefix(docs: DataFrame) -> DataFrame:
    """(doc_id, text, source) -> doc_id, part, text (bytes), chars, start, level, h, salt, range-partitioned and sorted by
    the last four.  A text's bucket is its shortest prefix that few enough texts share; equal texts share it, so
    one trie decides on them.  Where even the whole text is too frequent, its copies are salted over several."""
    heavy = heavy_prefixes(docs)
    levels = [r["level"] for r in heavy.select("level").distinct().collect()]       # at most 8
    small = heavy.count() <= BROADCAST_ROWS
    t = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), t.alias("text"), F.char_length(t).alias("chars"))
    level, h = F.lit(WHOLE), F.xxhash64("text")
    hashes = _levels(F.col("text"), F.col("chars"))
    rows = rows.withColumn("salts", F.lit(1).cast("long"))
    for k in sorted(levels):
        own = heavy.where(F.col("level") == k).select(
            F.col("h").alias(f"h{k}"), F.greatest(F.ceil(F.col("n") / TRIE_ROWS), F.ceil(F.col("bytes") / TRIE_BYTES)).alias(f"n{k}"))
        rows = rows.withColumn(f"h{k}", hashes[k]).join(F.broadcast(own) if small else own, f"h{k}", "left").drop(f"h{k}")
        if k == WHOLE:
            rows = rows.withColumn("salts", F.coalesce(f"n{k}", F.lit(1)))
    for k in reversed(range(WHOLE)):
        free = F.col("chars") > PREFIXES[k]
        if k in levels:
            free = free & F.col(f"n{k}").isNull()
        level, h = F.when(free, k).otherwise(level), F.when(free, hashes[k]).otherwise(h)
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), "salts")
    total, many = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)), F.count(F.lit(1))).first()
    tasks = max(1, -(-total // TASK_BYTES), -(-many // TASK_ROWS))
    keys = ["start", "level", "h", "salt"]
    rows = rows.select("doc_id", "part", F.col("text").cast("binary").alias("text"), "chars", F.substring("text", 1, PREFIXES[0]).alias("start"),
                       level.cast("int").alias("level"), h.alias("h"), salt.alias("salt"), (F.col("salts") > 1).alias("salted"))
    return rows.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)


def _masks(batches):
    """Sorted rows -> doc_id, part, mask, said, low.  A trie per bucket; ``said`` (the text's SHA-256) and ``low`` stand only
    where a salted text's smallest id of this trie may not be the smallest of all."""
    at, root, who, parts, salted = None, Node(b""), [], [], False

    def close() -> pa.RecordBatch:
        out: list[tuple] = []
        for node, text in terminals(root, salted):
            said = hashlib.sha256(text).hexdigest() if salted else None
            for r in node.rows:
                later = node.low is not None and who[r] is not None and who[r] > node.low
                open_ = salted and not later and who[r] is not None
                out.append((who[r], parts[r], node.mask + 16 * later, said if open_ else None, node.low if open_ else None))
        cols = list(zip(*out, strict=True)) or [()] * 5
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                          names=["doc_id", "part", "mask", "said", "low"])

    for b in batches:
        keys = zip(*(b.column(c).to_pylist() for c in ("start", "level", "h", "salt")), strict=True)
        cols = (b.column(c).to_pylist() for c in ("doc_id", "part", "text", "chars", "salted"))
        for key, doc_id, part, text, chars, many in zip(keys, *cols, strict=True):
            if key != at:
                if who:
                    yield close()
                at, root, who, parts, salted = key, Node(b""), [], [], many
            node = insert(root, text)
            if node.rows is None:
                node.rows, node.mask = [], text_mask(text, chars)
            node.rows.append(len(who))
            if doc_id is not None and (node.low is None or doc_id < node.low):
                node.low = doc_id
            who.append(doc_id)
            parts.append(part)
    if who:
        yield close()


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, text, source, ...) -> one row per row: doc_id, part (source; null: empty), mask of failed filters."""
    rows = write_table(by_prefix(docs).mapInArrow(_masks, "doc_id long, part string, mask int, said string, low long"), "masks")
    # Of a salted text each trie leaves the rows of its smallest id open: as many as it has salts, and their repeats.
    open_ = rows.where("said is not null")
    least = open_.groupBy("said").agg(F.min("low").alias("least"))
    closed = open_.join(least, "said").select(
        "doc_id", "part", F.when(F.col("doc_id") > F.col("least"), F.col("mask") + 16).otherwise(F.col("mask")).alias("mask"))
    return rows.where("said is null").select("doc_id", "part", "mask").unionByName(closed)


def _steps() -> str:
    """All orders and their steps: the step's filter and those before it, as bits."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for k, f in enumerate(order, 1):
            bit = 1 << FILTERS.index(f)
            out.append({"filter_order": "".join(order), "step": k, "bit": bit, "before": before})
            before |= bit
    return json.dumps(out)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, source) and (doc_id, quality, toxic) -> one row per part, order of the filters and step: part,
    filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley (times 120).

    A document's failures are five bits, counted per part and mask before anything is gathered, so an order
    costs at most 32 counts.  Null texts are empty; null sources form the part "" with empty ones; a null doc_id
    is no copy of a smaller one and none's original; rows that repeat an id and text are copies of neither;
    labels that repeat an id count by their largest values, null labels as 0; an empty table gives no rows;
    other columns are not read.
    """
    flags = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).cast("long").alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).cast("long").alias("toxic"))
    counts = masks(docs).join(flags, "doc_id", "left").groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    # At most 32 masks a part.
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("m"))
    steps = F.from_json(F.lit(_steps()), "array<struct<filter_order:string,step:int,bit:int,before:int>>")
    rows = parts.select("part", "m", F.inline(steps))

    def total(value, when) -> Column:
        return F.aggregate("m", F.lit(0).cast("long"), lambda acc, x: acc + F.when(when(x["mask"]), value(x)).otherwise(0))

    def fails(m):
        return m.bitwiseAND(F.col("bit")) != 0

    def before(m):
        return m.bitwiseAND(F.col("before")) != 0

    def here(m):
        return fails(m) & ~before(m)

    # Of the orders, a filter removes a document in those where it comes first of all that the document fails.
    share = lambda x: x["n"] * F.floor(F.lit(120) / F.greatest(F.bit_count(x["mask"]), F.lit(1)))       # noqa: E731
    return rows.select(
        "part", "filter_order", "step", total(lambda x: x["n"], lambda m: ~fails(m) & ~before(m)).alias("kept"),
        total(lambda x: x["n"], here).alias("removed"), total(lambda x: x["n"], lambda m: fails(m) & before(m)).alias("redundant"),
        total(lambda x: x["n"], lambda m: m == F.col("bit")).alias("unique_fails"), total(lambda x: x["good"], here).alias("good_lost"),
        total(lambda x: x["toxic"], here).alias("toxic_lost"), total(share, fails).alias("shapley"))
