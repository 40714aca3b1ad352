"""Histogram sort: shards of near equal bytes, from splitters refined by exact byte counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh

SHARDS = 40
OVERHEAD = 16          # bytes a row counts besides its text
TOLERANCE = 0.001      # of a shard's fair share: how near a splitter must come to its target
DIGIT = 12             # bits by which a round of probes refines a bracket: 4096 probes each
MOST_BROADCAST = 1000      # such groups up to which they and the cell counts are broadcast, else joined by a shuffle
HOT_ROWS = 100_000     # a group of equal texts above this is numbered in parts, too
TASK_BYTES = 1 << 28   # of a shard that one task writes
SLOT_BITS = 8          # a group that is cut over shards is numbered in 256 parts
_TOP = -(1 << 63)


def _digit(key: Column, k: int) -> Column:
    """The k-th digit of a 64-bit key, highest first; the sixth has the last four bits."""
    if k == 5:
        return key.bitwiseAND(F.lit(15))
    return F.shiftrightunsigned(key, 64 - DIGIT * (k + 1)).bitwiseAND(F.lit((1 << DIGIT) - 1))


def _prefix(key: Column, digits: int) -> Column:
    return F.shiftrightunsigned(key, 64 - DIGIT * digits) if digits else F.lit(0).cast("long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _refine(rows: DataFrame, key: str, goals: list[int], tolerance: float) -> list[tuple[int, int, int, int]]:
    """For each goal (bytes that should lie below): (from, to, bytes below from, bytes between), a
    bracket of unsigned keys.  Each round counts, in one aggregation over the rows whose key lies in
    an open bracket, the exact bytes below 4096 probes in each, until a bracket holds no more bytes
    than the tolerance or a single key.  The driver gets at most 4096 counts per open bracket."""
    done: dict[int, tuple[int, int, int, int]] = {}
    open_ = {g: (0, 0) for g in set(goals)}                       # goal -> (prefix, bytes below it)
    for k in range(6):
        if not open_:
            break
        parents = sorted({p for p, _ in open_.values()})
        prefix = _prefix(F.col(key), k)
        counts: dict[int, list] = {}
        for r in (rows.where(prefix.isin(parents)).groupBy(prefix.alias("p"), _digit(F.col(key), k).alias("d"))
                  .agg(F.sum("size").alias("bytes")).collect()):
            counts.setdefault(r["p"], []).append((r["d"], r["bytes"]))
        step, bits = (4, 64) if k == 5 else (DIGIT, DIGIT * (k + 1))
        then = {}
        for g, (p, below) in open_.items():
            cells = sorted(counts.get(p, []))
            for at, (d, n) in enumerate(cells):
                if below + n > g or at == len(cells) - 1:
                    child = (p << step) | d
                    if n <= tolerance or k == 5:
                        done[g] = (child << (64 - bits), (child + 1) << (64 - bits), below, n)
                    else:
                        then[g] = (child, below)
                    break
                below += n
        open_ = then
    return [done.get(g, (0, 0, 0, 0)) for g in goals]


def splitters(rows: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> tuple[list[tuple[int, int]], list[int]]:
    """(h1, h2, size) -> the ``shards - 1`` lower bounds (h1, h2) as unsigned keys, and the h1 values
    of groups that are cut.  A bound stands between groups of equal h1, at the nearer side of the one
    its goal falls into; only a group above a shard's fair share is cut, at bounds of h2."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    fair = total / shards
    goals = [total * s // shards for s in range(1, shards)]
    cuts: list[tuple[int, int]] = []
    hot: dict[int, list[int]] = {}
    for i, (a, b, below, n) in enumerate(_refine(rows, "h1", goals, tolerance * fair)):
        if n > fair and b - a == 1:
            hot.setdefault(a, []).append(i)
        cuts.append((a if goals[i] - below <= below + n - goals[i] else b, 0))
        if n > fair and b - a == 1:
            cuts[-1] = (a, below)
    for h, at in hot.items():
        group = rows.where(F.col("h1") == F.lit(_signed(h)))
        inner = [goals[i] - cuts[i][1] for i in at]
        for i, g, (a, b, below, n) in zip(at, inner, _refine(group, "h2", inner, tolerance * fair), strict=True):
            near = a if g - below <= below + n - g else b
            cuts[i] = (h, near) if near < 1 << 64 else (h + 1, 0)
    return cuts, list(hot)


def shard_of(cuts: list[tuple[int, int]], h1: str = "h1", h2: str = "h2") -> Column:
    """Number of bounds at or below a row's (h1, h2), as keys compare unsigned."""
    k1, k2 = (F.col(c).bitwiseXOR(F.lit(_TOP)) for c in (h1, h2))
    n = F.lit(0)
    for a, b in cuts:
        if a >= 1 << 64:
            continue
        at = F.lit(_signed(a ^ (1 << 63)))
        n = n + F.when((k1 >= at) if b == 0 else (k1 > at) | ((k1 == at) & (k2 >= F.lit(_signed(b ^ (1 << 63))))),
                       1).otherwise(0)
    return n


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the sort key: h1 hashes the text, h2 the doc_id."""
    return docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
                       F.coalesce(F.crc32("text"), F.lit(0).cast("long")).alias("text_crc32"),
                       F.xxhash64("text").alias("h1"), F.xxhash64("doc_id", F.lit("shard")).alias("h2"))


def shard(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law (``bytes``), shard, slot, grown_shard.

    Rows sort by (hash of text, hash of doc_id), so equal texts are neighbours and share a shard; only
    a group above a shard's fair share of bytes is spread over shards.  Splitters come from exact byte
    counts of the whole table (``splitters``); then one exchange numbers the rows: slots are the rows
    in earlier cells of the shard (4096 hash cells, a cut group or one of very many rows in 256 parts; the counts are bounded by
    these numbers and broadcast, or joined where there are very many such groups) plus the row's place in its cell.  A null text has no bytes and crc 0;
    null ids and repeated rows are ordinary rows; an empty table gives no rows.
    """
    rows = cut(keyed(docs))
    cuts, hot = splitters(rows, shards, tolerance)
    part = F.shiftrightunsigned("h2", 64 - SLOT_BITS)
    # Groups that are hot by rows but not by bytes (empty or very short texts): at most count / HOT_ROWS of them.
    many = cut(rows.groupBy("h1").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_ROWS).select("h1", F.lit(True).alias("many")))
    rows = rows.withColumn("shard", shard_of(cuts)).withColumn("cell", _digit(F.col("h1"), 0).cast("int"))
    split = F.col("h1").isin([_signed(h) for h in hot]) if hot else F.lit(False)
    n_many = many.count()
    if n_many:
        rows = rows.join(F.broadcast(many) if n_many <= MOST_BROADCAST else many, "h1", "left")
        split = split | F.coalesce("many", F.lit(False))
    rows = rows.withColumn("part", F.when(split, part).otherwise(0).cast("int"))
    cells = rows.groupBy("shard", "cell", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("cell", "part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy("shard", "cell", "part").orderBy("h1", "h2", "doc_id"))
    return (rows.withColumn("place", place).join(F.broadcast(cells) if n_many <= MOST_BROADCAST else cells, ["shard", "cell", "part"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("first") + F.col("place") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, tolerance: float = TOLERANCE,
                 partition: str = "shard") -> None:
    """Write ``docs`` (columns doc_id, text and any others, unchanged) as Parquet below ``path``/shard=N.
    A table that has a column of the partition's name is refused: name another ``partition``.  A shard
    is written by as many tasks as its bytes ask for."""
    if partition.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the table has a column {partition!r}; name another partition column")
    keys = cut(keyed(docs))
    cuts, _ = splitters(keys, shards, tolerance)
    total = keys.agg(F.sum("size")).first()[0] or 0
    parts = max(1, -(-total // (shards * TASK_BYTES)))
    h1, h2, salt = fresh(docs.withColumn(partition, F.lit(0)), "__h1", "__h2", "__salt")
    rows = docs.withColumns({h1: F.xxhash64("text"), h2: F.xxhash64("doc_id", F.lit("shard"))})
    rows = rows.withColumn(partition, shard_of(cuts, h1, h2)).withColumn(salt, F.pmod(h2, F.lit(parts)))
    (rows.repartition(shards * parts, partition, salt).drop(h1, h2, salt).write.partitionBy(partition).parquet(path))
