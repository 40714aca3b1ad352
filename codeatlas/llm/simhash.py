"""SimHash near-duplicate groups through an inverted index over the bytes of the fingerprints."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, word_blocks
from .components import connected_components

SHINGLE_WORDS = 3
HASH_SEED = 42
MAX_BITS = 2
BYTES = 8
LIST_ROWS = 4096           # a longer posting list is split by further bytes


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of the lower-cased (A-Z) words of ``text``: bit i is set when over half of the
    shingles' XXH64 values have it set.  Fewer words than a shingle: the whole sequence is the one
    shingle; no words (or null): 0.  Long texts are walked in blocks."""
    if not text:
        return 0
    counts, n, carry = np.zeros(64, np.int64), 0, []
    h = xxhash.xxh64_intdigest
    for words in word_blocks(text.encode("utf-8", "surrogatepass").lower()):
        words = carry + words
        if len(words) >= shingle_words:
            joined = b" ".join(words)
            lens = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(lens + 1) - 1
            starts = (ends - lens)[:len(words) - shingle_words + 1].tolist()
            hashes = np.array([h(joined[a:b], HASH_SEED)
                               for a, b in zip(starts, ends[shingle_words - 1:].tolist(), strict=True)], np.uint64)
            counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
            n += len(hashes)
        carry = words[-(shingle_words - 1):] if shingle_words > 1 else []
    if not n:
        return h(b" ".join(carry), HASH_SEED) if carry else 0
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprint_udf(shingle_words: int = SHINGLE_WORDS):
    """Arrow-batched column function text -> signed 64-bit fingerprint."""

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        fps = np.fromiter((fingerprint(t, shingle_words) for t in texts), np.uint64, len(texts))
        return pd.Series(fps.view(np.int64))

    return simhash


def _signed(positions) -> int:
    """A signed 64-bit mask of byte positions."""
    m = sum(0xFF << (8 * b) for b in positions)
    return m - (1 << 64) if m >> 63 else m


def _lists(max_bits: int) -> list[tuple[int, list[int]]]:
    """The index's kinds of list: (mask of the bytes it is keyed by, masks that split a long one).

    Bits that differ spoil at most ``max_bits`` of the four byte pairs (of the eight bytes, from four bits on), so
    two linked fingerprints share the others and meet in one list at least.  A long list is split by the
    bytes that its members share beyond its key: all that are missing to the guaranteed minimum."""
    units = [(2 * i, 2 * i + 1) for i in range(4)] if max_bits < 4 else [(i,) for i in range(BYTES)]
    out = []
    for keep in combinations(units, len(units) - max_bits):
        key = [b for u in keep for b in u]
        rest = [b for b in range(BYTES) if b not in key]
        out.append((_signed(key), [_signed(x) for x in combinations(rest, max(0, BYTES - max_bits - len(key)))]))
    return out


def _tally(x: np.ndarray) -> np.ndarray:
    """Positional bytes that two fingerprints share, from their exclusive or."""
    return (np.ascontiguousarray(x).view(np.uint8).reshape(*x.shape, 8) == 0).sum(-1)


def linked_pairs(fps: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of one posting list whose tally of equal positional bytes reaches the guaranteed
    minimum and whose bits then differ in at most ``max_bits``; blocks of rows bound the memory."""
    left, right = [], []
    step = max(1, (1 << 20) // max(1, len(fps)))
    for a in range(0, len(fps), step):
        x = fps[a:a + step, None] ^ fps[None, :]
        i, j = np.nonzero(_tally(x) >= BYTES - max_bits)
        near = np.bitwise_count(x[i, j]) <= max_bits
        i, j = i[near], j[near]
        keep = i + a < j
        left.append(i[keep] + a)
        right.append(j[keep])
    return np.concatenate(left), np.concatenate(right)


def _spanning(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what is linked within one posting list, fewer than it has members."""
    i, j = linked_pairs(fps, max_bits)
    lab = np.arange(len(fps))
    while len(i):
        low = lab.copy()
        np.minimum.at(low, i, lab[j])
        np.minimum.at(low, j, lab[i])
        low = low[low]
        if (low == lab).all():
            break
        lab = low
    at = np.flatnonzero(lab != np.arange(len(fps)))
    return fps[at], fps[lab[at]]


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Distinct fingerprints (fp) -> edges (u, v) that connect exactly what chains of links connect.

    Two fingerprints within ``max_bits`` bits share at least ``8 - max_bits`` positional bytes.  Each fingerprint is
    posted to the lists of ``_lists``; within a list the bytes that a pair shares are tallied, pairs below that
    guaranteed minimum go, and the others' bits are compared.  A list above ``LIST_ROWS`` is split by
    further bytes, after which it holds at most 256 ** max_bits fingerprints whatever the corpus.
    Pairs leave a list as a spanning forest, not as pairs.
    """
    kinds = _lists(max_bits)
    posted = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m, _ in kinds])).alias("c", "key"))
    long = cut(posted.groupBy("c", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LIST_ROWS).drop("n"))
    parts = F.array(F.lit(0).cast("long"))
    if not long.isEmpty():
        posted = posted.join(long.withColumn("long", F.lit(True)), ["c", "key"], "left")
        for c, (_, more) in enumerate(kinds):
            split = F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(m)).alias("m")) for i, m in enumerate(more)])
            parts = F.when(F.col("long") & (F.col("c") == c), F.transform(split, lambda x: F.xxhash64(x["i"], x["m"]))).otherwise(parts)
    posted = (posted.withColumn("part", F.explode(parts)).groupBy("c", "key", "part").agg(F.collect_list("fp").alias("fps"))
              .where(F.size("fps") > 1).select("fps"))

    def verify(batches):
        for pdf in batches:
            lists = pdf["fps"].tolist()
            u, v = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
            twos = [x for x in lists if len(x) == 2]
            if twos:
                two = np.sort(np.asarray(twos, np.int64).view(np.uint64), axis=1)
                x = two[:, 0] ^ two[:, 1]
                near = (_tally(x) >= BYTES - max_bits) & (np.bitwise_count(x) <= max_bits)
                u.append(two[near, 1])
                v.append(two[near, 0])
            for x in lists:
                if len(x) > 2:
                    a, b = _spanning(np.sort(np.asarray(x, np.int64).view(np.uint64)), max_bits)
                    u.append(a)
                    v.append(b)
            yield pd.DataFrame({"u": np.concatenate(u).view(np.int64), "v": np.concatenate(v).view(np.int64)})

    return posted.mapInPandas(verify, "u long, v long")


def simhash_groups(docs: DataFrame, max_bits: int = MAX_BITS, shingle_words: int = SHINGLE_WORDS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text, ...) -> (rows, classes).

    ``rows``: every input row as (doc_id, fp).  ``classes``: one row per distinct fingerprint as
    (fp, component_id, best): the smallest doc_id reachable over links, and the row of the whole
    component that stands for it, as struct (none: doc_id is null, doc_id, fp, th: hash of its text).
    Null or empty texts have fingerprint 0 and link like any other; repeated rows share a class; a
    null doc_id is never the smallest one unless a component has no other (then component_id is
    null).  An empty table gives empty results.  Only doc_id and text are read.
    """
    rows = cut(docs.select("doc_id", F.xxhash64("text").alias("th"),
                           fingerprint_udf(shingle_words)("text").alias("fp")))
    one = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "th")
    low = cut(rows.groupBy("fp").agg(F.min(one).alias("best")))
    comp = connected_components(fingerprint_links(low.select("fp"), max_bits))
    rooted = (low.join(comp.select(F.col("node").alias("fp"), "root"), "fp", "left")
              .withColumn("root", F.coalesce("root", "fp")))
    best = rooted.groupBy("root").agg(F.min("best").alias("best"))
    classes = rooted.drop("best").join(best, "root").select("fp", F.col("best.doc_id").alias("component_id"), "best")
    return rows.select("doc_id", "fp"), classes


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 lower-case hex digits), component_id."""
    rows, classes = simhash_groups(docs, max_bits, shingle_words)
    return rows.join(classes.select("fp", "component_id"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, max_bits: int = MAX_BITS, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` without near-duplicates: of each component the row with the smallest doc_id stays
    (of rows that repeat it, one), with all columns unchanged."""
    _, classes = simhash_groups(docs, max_bits, shingle_words)
    th, at, none = fresh(docs, "__th", "__at", "__none")
    best = classes.where(F.col("fp") == F.col("best.fp")).select(
        F.col("best.th").alias(th), F.coalesce("best.doc_id", F.lit(0)).alias(at), F.col("best.none").alias(none))
    # The key holds the doc_id, so a large group of copies is spread over all tasks, and one exchange
    # of the texts serves the join and the removal of repeated rows.
    keyed = docs.withColumns({th: F.xxhash64("text"), at: F.coalesce("doc_id", F.lit(0)),
                              none: F.col("doc_id").isNull()})
    return keyed.join(best.distinct(), [th, at, none]).dropDuplicates([th, at, none]).select(*docs.columns)
