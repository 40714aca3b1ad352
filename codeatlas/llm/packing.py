"""Hierarchical multi-length packing of tokenized documents."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .tokens import encoder, groups

TIERS = (1024, 512, 256, 128)
END_ID = 0
BATCH_IDS = 1 << 20            # ids that are packed together
STEP_IDS = 1 << 17             # ids of a step group, about

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (
    ("doc_id", T.LongType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()),
    ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType()), ("tier", T.IntegerType()),
    ("step_group", T.LongType()), ("ids", T.BinaryType()))])


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Document lengths -> sequences as (tier, [(document, start, length)]), tiers being descending
    powers of two.

    A document fills windows of the longest tier; its rest is routed to the shortest tier that holds
    it.  Tier by tier from the longest, each window starts with the longest waiting rest of the tier;
    its gap takes the longest rest that fits, again and again, from this or a shorter tier, and when
    none fits, the shortest waiting one is cut to the gap.  So all windows are full but the last; that
    one is cut into sequences whose lengths are powers of two.  Every id lies in exactly one piece.
    """
    top = tiers[0]
    out: list[tuple[int, list[tuple[int, int, int]]]] = []
    waiting: list[list[tuple[int, int]]] = [[] for _ in range(top)]
    mask = 0                                   # bit n: a rest of n ids waits
    for d, n in enumerate(lengths):
        full = n // top * top
        out.extend((top, [(d, a, top)]) for a in range(0, full, top))
        if n > full:
            waiting[n - full].append((d, full))
            mask |= 1 << (n - full)

    def take(n: int) -> tuple[int, int]:
        nonlocal mask
        piece = waiting[n].pop()
        if not waiting[n]:
            mask ^= 1 << n
        return piece

    for t, tier in enumerate(tiers):
        floor = tiers[t + 1] if t + 1 < len(tiers) else 0
        while mask and (n := mask.bit_length() - 1) > floor:
            gap, window = min(tier, top), []
            while gap and mask:
                n = (mask & ((1 << (gap + 1)) - 1)).bit_length() - 1
                if n > 0:
                    window.append((*take(n), n))
                    gap -= n
                else:
                    n = (mask & -mask).bit_length() - 1
                    d, a = take(n)
                    window.append((d, a, gap))
                    waiting[n - gap].append((d, a + gap))
                    mask |= 1 << (n - gap)
                    gap = 0
            if not gap:
                out.append((tier, window))
                continue
            left = tier - gap                  # nothing waits any more
            while left:
                size = 1 << (left.bit_length() - 1)
                room, seq = size, []
                while room:
                    d, a, n = window.pop(0)
                    seq.append((d, a, min(n, room)))
                    if n > room:
                        window.insert(0, (d, a + room, n - room))
                    room -= min(n, room)
                out.append((size, seq))
                left -= size
    return out


def packed(docs: DataFrame, tokenizer: str, end_id: int = END_ID, tiers: tuple[int, ...] = TIERS,
           with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier,
    step_group and (``with_ids``) the piece's ids as little-endian unsigned 32-bit integers.

    Each input partition is tokenized and packed where it lies, ``BATCH_IDS`` ids at a time: no
    exchange, bounded memory, and a lost task repeats its own rows only.  Sequences are numbered by
    partition; a batch deals each tier's sequences out to its step groups in turn, so groups hold the
    same mix of lengths.  Null and empty texts are documents of the end id alone; rows that repeat
    are packed separately; an empty table gives no rows; other columns are not read.
    """
    def run(batches):
        enc, end = encoder(tokenizer), int(end_id).to_bytes(4, "little")
        pid, made, steps = TaskContext.get().partitionId(), 0, 0
        ids: list[bytes] = []
        names: list = []
        size = 0

        def flush():
            nonlocal made, steps, size
            seqs = pack([len(x) // 4 for x in ids], tiers)
            n_steps = max(1, round(size / 4 / STEP_IDS))
            turn: dict[int, int] = {}
            cols: list[list] = [[] for _ in SCHEMA.fields]
            for tier, pieces in seqs:
                group = turn[tier] = turn.get(tier, -1) + 1
                at = 0
                for d, a, n in pieces:
                    part = ids[d][4 * a:4 * (a + n)]
                    for c, v in zip(cols, (names[d], a, n, zlib.crc32(part), len(ids[d]) // 4, (pid << 36) + made, at,
                                           tier, (pid << 36) + steps + group % n_steps, part if with_ids else None), strict=True):
                        c.append(v)
                    at += n
                made += 1
            steps += n_steps
            ids.clear()
            names.clear()
            size = 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (
                *[pa.int64()] * 7, pa.int32(), pa.int64(), pa.binary()), strict=True)], names=SCHEMA.names)

        for b in batches:
            texts, who = b.column("text").to_pylist(), b.column("doc_id").to_pylist()
            for lo, hi in groups(texts):
                for w, x in zip(who[lo:hi], enc.encode(texts[lo:hi]), strict=True):
                    ids.append(x + end)
                    names.append(w)
                    size += len(x) + 4
                if size >= 4 * BATCH_IDS:
                    yield from flush()
        if ids:
            yield from flush()

    out = docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
    return out if with_ids else out.drop("ids")
