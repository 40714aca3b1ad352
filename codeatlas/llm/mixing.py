"""Mixing sources to target weights by pivotal dependent rounding with a distributed reduction tree."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_SQL, canonical, cut, fresh, write_table

WEIGHTS = (5.0, 2.0, 1.0)      # by the sources' order, repeating
SHARE = 1.5                    # words the mix takes, as a share of all words
CAP = 2.0                      # a source's target stops at this multiple of its size
ROWS_PER_BUCKET = 1024         # leaves of the reduction tree
FAN_IN = 64                    # residuals that meet in one node of it
FEW_SOURCES = 10_000           # source tables up to this many rows are broadcast, larger ones shuffled
SEED = 20_011
_WORD = 0xFFFFFFFFFFFFFFFF


def _uniform(a: int, b: int) -> float:
    """A number in [0, 1) fixed by two 64-bit keys (SplitMix64 finaliser)."""
    z = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + SEED) & _WORD
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _WORD
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _WORD
    return ((z ^ (z >> 31)) >> 11) / (1 << 53)


def pivotal(keys: list[int], sizes: list[int], fracs: list[float], level: int = 0) -> tuple[list[int | None], float | None]:
    """Round ``fracs`` (copy probabilities) pair by pair, largest document first: a document is paired with the
    pool of all smaller ones, and a random amount of *words* moves from one to the other until the document or
    a member of the pool is integral.  So the words that the group takes stay what they were, each document's
    expectation too, and what stays fractional in the end is the smallest document.  Returns 0 or 1 for each
    document and None for the one that stays fractional, and that one's fraction."""
    eps = 1e-12
    out: list[int | None] = [None] * len(keys)
    move = []
    for j, q in enumerate(fracs):
        if q < eps or q > 1 - eps:
            out[j] = int(q > 0.5)
        elif sizes[j] == 0:
            out[j] = int(_uniform(keys[j], level) < q)          # no words to move: rounded alone
        else:
            move.append(j)
    move.sort(key=lambda j: (-sizes[j], keys[j]))
    # Members whose fractions are equal stay so: a run of them is one entry (fraction, words, count, members).
    runs: dict[float, list] = {}
    for j in move:
        run = runs.setdefault(fracs[j], [fracs[j], 0, 0, []])
        run[1] += sizes[j]
        run[2] += 1
        run[3].append(j)
    run_of, pool = {j: run for run in runs.values() for j in run[3]}, list(runs.values())
    for draw, j in enumerate(move):
        if out[j] is not None:
            continue
        own, w = run_of[j], sizes[j]
        p = own[0]
        own[1] -= w
        own[2] -= 1
        pool = [run for run in pool if run[2]]
        turn = draw << 16
        while out[j] is None and pool:
            words = sum(run[1] for run in pool)
            up = min((1 - p) * w, min(run[0] for run in pool) * words)
            down = min(p * w, (1 - max(run[0] for run in pool)) * words)
            step = up if _uniform(keys[j] ^ level, turn) * (up + down) < down else -down
            p, turn = p + step / w, turn + 1
            for run in pool:
                run[0] -= step / words
                if run[0] < eps or run[0] > 1 - eps:
                    run[2] = 0
                    for i in run[3]:
                        if out[i] is None and i != j:
                            out[i] = int(run[0] > 0.5)
            pool = [run for run in pool if run[2]]
            if p < eps or p > 1 - eps:
                out[j] = int(p > 0.5)
        if out[j] is None:
            return out, p
    return out, None


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, size) -> one row per source: source, rank, rows, source_size, target.

    Sources in code-point order, null last, weigh ``weights`` in turn and share ``share`` of all
    words; a target stops at ``cap`` times its source's size and the excess goes to the others by
    weight until none is above.  With sources ordered by the weight share at which they fill up,
    that fixed point is a running sum.  The windows run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.array(*[F.lit(float(x)) for x in weights])
    per = per.withColumn("rank", rank).withColumn("w", F.element_at(w, (F.col("rank") % len(weights) + 1).cast("int")))
    per = per.withColumn("limit", F.col("source_size") * F.lit(float(cap))).withColumn("fills", F.col("limit") / F.col("w"))
    everything = Window.orderBy("fills", "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("fills", "rank").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("level", (F.sum("source_size").over(everything) * F.lit(float(share))
                                   - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
                         / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    per = per.withColumn("lambda", F.min(F.when(F.col("level") <= F.col("fills"),
                                                F.struct("fills", "rank", "level"))).over(everything)["level"])
    return per.select("source", "rank", "rows", "source_size",
                      F.least("limit", F.coalesce(F.col("lambda") * F.col("w"), F.col("limit"))).alias("target"))


def _round_groups(level: int):
    def fn(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in ("key", "key2", "size", "doc_id") if c in t.column_names])
        done, left = pivotal(t["key"].to_pylist(), t["size"].to_pylist(), t["p"].to_pylist(), level)
        p = np.where([d is None for d in done], left if left is not None else 0.0, 0.0)
        return (t.set_column(t.schema.get_field_index("p"), "p", pa.array(p, pa.float64()))
                .set_column(t.schema.get_field_index("copies"), "copies", pa.array(done, pa.int64())))
    return fn


def mixed(docs: DataFrame, key: F.Column | None = None, weights=WEIGHTS, share: float = SHARE, cap: float = CAP,
          key2: F.Column | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, copies, key and, where given, key2.

    A source's documents all expect target / source_size copies.  The whole part is given to each;
    the fraction is rounded by ``pivotal`` within hashed buckets of a source (a hot source has as
    many buckets as it needs), and what each bucket leaves fractional, at most one document and its smallest as
    a rule, meets others of its source in a tree of fan-in ``FAN_IN``.  Only the root's last document is rounded
    on its own, so a source takes its target up to a small document.  All draws are hashes of document
    keys, so reruns agree.  Null texts have size 0 and take 0 words; null sources form the last
    source; rows that repeat are separate documents; an empty table gives no rows.
    """
    key = F.xxhash64("doc_id", "text") if key is None else key
    more = [] if key2 is None else [key2.alias("key2")]
    sizes = cut(docs.select("doc_id", "source", key.alias("key"), *more,
                            F.coalesce(F.regexp_count("text", F.lit(WORD_SQL)), F.lit(0)).cast("long").alias("size")))
    targets = cut(source_targets(sizes, weights, share, cap))
    n, most = targets.agg(F.count(F.lit(1)), F.max("rows")).first()
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    side = targets.select(F.col("source").alias("s"), "rank", "rows", "source_size", "target",
                          F.floor(each).alias("base"), (each - F.floor(each)).alias("p"))
    side = F.broadcast(side) if n <= FEW_SOURCES else side
    rows = (sizes.join(side, F.col("source").eqNullSafe(F.col("s"))).drop("source", "s")
            .withColumn("bucket", F.pmod("key", F.ceil(F.col("rows") / ROWS_PER_BUCKET)))
            .withColumn("copies", F.lit(None).cast("long")).drop("rows"))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields])
    level, buckets, parts = 0, -(-(most or 0) // ROWS_PER_BUCKET), []
    while True:
        rows = write_table(rows.groupBy("rank", "bucket").applyInArrow(_round_groups(level), schema), f"mix{level}")
        parts.append(rows.where("copies is not null"))
        rows = rows.where("copies is null")
        if buckets <= 1:
            break
        buckets, level = -(-buckets // FAN_IN), level + 1
        rows = rows.withColumn("bucket", F.floor(F.col("bucket") / FAN_IN))
    last = F.udf(lambda k, p: int(_uniform(k, -1) < p), "long")     # one row per source
    parts.append(rows.withColumn("copies", last("key", "p")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    total = F.col("base") + F.col("copies")
    return out.select("doc_id", "size", "source_size", "target", (total * F.col("size")).alias("taken"),
                      total.alias("copies"), "key", *(["key2"] if more else []))


def mix(docs: DataFrame) -> DataFrame:
    """``docs`` with each row as often as the mix takes it (0, 1 or 2 times), columns unchanged.

    A row is known by two 64-bit hashes of all its columns in a canonical form, map and variant columns
    included, so rows that differ anywhere are separate documents."""
    key, key2, copies, k = fresh(docs, "__key", "__key2", "__copies", "__k")
    whole = [canonical(F.col(f"`{f.name}`"), f.dataType) for f in docs.schema.fields]
    one, two = F.xxhash64(F.lit(1), *whole), F.xxhash64(F.lit(2), *whole)
    took = (mixed(docs, one, key2=two).groupBy(F.col("key").alias(key), F.col("key2").alias(key2))
            .agg(F.sum("copies").alias(copies)).where(F.col(copies) > 0))
    # Rows equal in all columns share their keys: their copies are summed and given to one of them.
    kept = docs.withColumns({key: one, key2: two}).join(took, [key, key2]).dropDuplicates([key, key2])
    return kept.withColumn(k, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*[F.col(f"`{c}`") for c in docs.columns])
