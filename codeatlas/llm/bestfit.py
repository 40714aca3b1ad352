"""Vector best-fit packing of tokenized documents under token, document-count and attention-cost capacities."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import write_table
from .tokens import encoder, groups

TOKENS = 2048
# Tokens, pieces and attention cost (sum of squared lengths) of a sequence.  The last two stand where tokens
# alone decide how few sequences are possible; tighter ones are parameters.
CAPACITY = (TOKENS, TOKENS, TOKENS * TOKENS)
WEIGHTS = (1.0, 0.02, 0.02)
END_ID = 0
GROUP_ITEMS = 8192             # pieces that are packed together
SCHEMA = T.StructType([T.StructField(n, t) for n, t in (
    ("doc_id", T.LongType()), ("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()),
    ("ids_crc32", T.LongType()), ("row", T.LongType()), ("ids", T.BinaryType()))])


def vector_best_fit(lengths: np.ndarray, capacity: tuple[int, int, int] = CAPACITY, rule: str = "norm",
                    weights: tuple[float, float, float] = WEIGHTS) -> np.ndarray:
    """Bin of each item, items given in the order they are placed (longest first packs best).

    An item asks for (length, 1, length squared) of a bin's residual capacities.  Of the bins where all three
    suffice it goes to the one with the smallest weighted norm of what would be left (``norm``) or the largest
    weighted product of its demand and the residuals (``dot``), capacities scaled to 1; ties go to the oldest
    bin.  Where none suffices it opens a bin, also if it exceeds the capacities by itself."""
    cap = np.asarray(capacity, np.float64)
    w = np.asarray(weights, np.float64)
    # The smallest demand of the items still to come: bins below it are closed.
    least = np.minimum.accumulate(lengths[::-1])[::-1] if len(lengths) else lengths
    size, names = 64, np.empty(64, np.int64)
    rooms = [np.empty(size) for _ in range(3)]                 # residual tokens, pieces, attention cost
    n = bins = 0
    out = np.empty(len(lengths), np.int64)
    for k, length in enumerate(lengths.tolist()):
        demand = (float(length), 1.0, float(length) * length)
        if k % 512 == 0 and n:
            keep = np.flatnonzero((rooms[0][:n] >= least[k]) & (rooms[1][:n] >= 1) & (rooms[2][:n] >= float(least[k]) ** 2))
            for r in (*rooms, names):
                r[:len(keep)] = r[keep]
            n = len(keep)
        fits = np.flatnonzero(rooms[0][:n] >= demand[0])
        for r, d in zip(rooms[1:], demand[1:], strict=True):
            if len(fits):
                fits = fits[r[fits] >= d]
        if len(fits):
            score = 0.0
            for r, d, c, x in zip(rooms, demand, cap.tolist(), w.tolist(), strict=True):
                score = score + (x * ((r[fits] - d) / c) ** 2 if rule == "norm" else -x * (r[fits] / c) * (d / c))
            at = fits[np.argmin(score)]
            for r, d in zip(rooms, demand, strict=True):
                r[at] -= d
            out[k] = names[at]
            continue
        if n == size:
            size *= 2
            rooms, names = [np.concatenate([r, np.empty_like(r)]) for r in rooms], np.concatenate([names, np.empty_like(names)])
        for r, d, c in zip(rooms, demand, cap.tolist(), strict=True):
            r[n] = c - d
        names[n], out[k] = bins, bins
        n, bins = n + 1, bins + 1
    return out


def pieces(docs: DataFrame, tokenizer: str, tokens: int = TOKENS, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, row (unique) and (``with_ids``) its ids.  A
    document of more than ``tokens`` ids is cut into pieces of that length, the first being the shorter one."""
    def run(batches):
        enc, end = encoder(tokenizer), int(end_id).to_bytes(4, "little")
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            texts, who = b.column("text").to_pylist(), b.column("doc_id").to_pylist()
            for lo, hi in groups(texts):
                cols: list[list] = [[] for _ in SCHEMA.fields]
                for w, x in zip(who[lo:hi], enc.encode(texts[lo:hi]), strict=True):
                    ids = x + end
                    n = len(ids) // 4
                    a, k = 0, 0
                    while a < n:
                        to = a + (n % tokens or tokens) if not k else a + tokens
                        part = ids[4 * a:4 * to]
                        for c, v in zip(cols, (w, k, a, to - a, zlib.crc32(part), row, part if with_ids else None), strict=True):
                            c.append(v)
                        a, k, row = to, k + 1, row + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (
                    pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.binary()), strict=True)], names=SCHEMA.names)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def packed(docs: DataFrame, tokenizer: str, capacity: tuple[int, int, int] = CAPACITY, rule: str = "norm",
           weights: tuple[float, float, float] = WEIGHTS, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and (``with_ids``) ids.

    Texts are tokenized where they lie; pieces that fill a sequence alone are done.  The others are dealt by
    a hash into groups of about ``GROUP_ITEMS``, each a fair mix of the whole table whatever its order, and a
    group is packed longest first by ``vector_best_fit``; only pieces travel, and a group leaves about one
    sequence half empty.  Null and empty texts are documents of the end id alone; rows that repeat are packed
    separately; null ids are ordinary; an empty table gives no rows; other columns are not read.
    """
    cut = write_table(pieces(docs, tokenizer, capacity[0], end_id, with_ids), "pieces")
    rest = cut.where(F.col("length") < capacity[0])
    parts = max(1, -(-rest.count() // GROUP_ITEMS))
    out = T.StructType([*SCHEMA.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def fit(key: tuple, t: pa.Table) -> pa.Table:
        t = t.drop_columns(["part"]).sort_by([("length", "descending"), ("row", "ascending")])
        lengths = t["length"].to_numpy()
        bins = vector_best_fit(lengths, capacity, rule, weights)
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(lengths[order])
        first = np.r_[True, bins[order][1:] != bins[order][:-1]]
        begin = (ends - lengths[order])[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
        offset = np.empty(len(order), np.int64)
        offset[order] = ends - lengths[order] - begin
        ids = ((key[0].as_py() << 32) + bins) * 2 + 1
        return t.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offset))

    fitted = (rest.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts))).groupBy("part").applyInArrow(fit, out))
    alone = cut.where(F.col("length") >= capacity[0]).withColumns(
        {"sequence_id": F.col("row") * 2, "offset": F.lit(0).cast("long")})
    both = fitted.unionByName(alone).drop("row")
    return both if with_ids else both.drop("ids")
