"""Token-id files: documents' ids in ascending doc_id order, coded in independent, checksummed blocks.

File: magic; blocks (idcoder.HEAD and payload); the index, a pair (doc_id, ids) of little-endian
64-bit integers per document, in order; the trailer (blocks, documents, position and crc32 of the index).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import idcoder
from .common import open_store, shared_folder, write_table
from .tokens import encoder, groups

MAGIC = b"IDBLOCK2"
TRAILER = "<QQQI4x"
TASK_BYTES = 256 << 20         # text bytes of a task, about
TASK_ROWS = 1 << 20            # and its documents
SLICE = 512                    # rows whose texts are Python strings at a time
END_ID = 2
NULL_ID = -(1 << 63)           # stands for a null doc_id in the index
GROUP = idcoder.BLOCK_IDS * idcoder.LANES
FILE_IDS = 4 * GROUP - GROUP // 32      # a task goes on in a further file beyond so many ids (its last blocks fill a group)
FILE_DOCS = 1 << 18            # or documents


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` (doc_id, text) below ``folder``; returns the manifest (file_no, path, ids, docs).

    One range exchange orders the documents, in as many ranges as their bytes or their number asks for; an id that
    very many rows share is cut by the text's hash.  Each task tokenizes its range, gathers ids for ``LANES``
    blocks, codes them in lockstep and goes on, in a further file after ``FILE_IDS`` ids or ``FILE_DOCS`` documents, so
    neither memory nor a file grows with a range.  A file gets its final name only when whole, so a
    repeated task replaces it."""
    size, rows = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)), F.count(F.lit(1))).first()
    ranges = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES), -(-rows // TASK_ROWS))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text").asc()]
    dealt = docs.select("doc_id", "text").repartitionByRange(int(ranges), *order).sortWithinPartitions(*order)

    def write(batches):
        store, top = open_store(folder)
        task, files = TaskContext.get(), 0
        out = None
        index: list[tuple[int, int]] = []
        waiting: list[np.ndarray] = []
        count = total = blocks = at = 0

        def start():
            nonlocal out, name, part, index, waiting, count, total, blocks, at
            store.create_dir(top, recursive=True)
            name = f"{top}/part-{task.partitionId():06d}-{files:05d}.idb"
            part = f"{name}.{task.taskAttemptId()}"
            out = store.open_output_stream(part, compression=None)
            out.write(MAGIC)
            index, waiting, count, total, blocks, at = [], [], 0, 0, 0, len(MAGIC)

        def flush(last: bool):
            nonlocal waiting, count, blocks, at
            ids = np.concatenate(waiting) if waiting else np.empty(0, np.uint32)
            waiting = []
            take = len(ids) if last else len(ids) // GROUP * GROUP
            step = idcoder.BLOCK_IDS
            for data in idcoder.encode_blocks([ids[k:min(take, k + step)] for k in range(0, take, step)]):
                out.write(data)
                at += len(data)
                blocks += 1
            waiting, count = [ids[take:].copy()], len(ids) - take

        def finish() -> pa.RecordBatch:
            nonlocal out, files
            flush(True)
            table = np.array(index, "<i8").tobytes()
            out.write(table)
            out.write(struct.pack(TRAILER, blocks, len(index), at, zlib.crc32(table)))
            out.close()
            store.move(part, name)
            out, files = None, files + 1
            return pa.RecordBatch.from_pydict(
                {"file_no": [(task.partitionId() << 32) + files - 1], "path": [name], "ids": [total], "docs": [len(index)]},
                pa.schema([("file_no", pa.int64()), ("path", pa.string()), ("ids", pa.int64()), ("docs", pa.int64())]))

        name = part = ""
        enc = encoder(tokenizer)
        for b in (batch.slice(k, SLICE) for batch in batches for k in range(0, batch.num_rows, SLICE)):
            texts, who = b.column("text").to_pylist(), b.column("doc_id").to_pylist()
            for lo, hi in groups(texts):
                for w, x in zip(who[lo:hi], enc.encode(texts[lo:hi]), strict=True):
                    if out is None:
                        start()
                    ids = np.append(np.frombuffer(x, "<u4"), np.uint32(end_id))
                    waiting.append(ids)
                    count, total = count + len(ids), total + len(ids)
                    index.append((NULL_ID if w is None else w, len(ids)))
                    if total >= FILE_IDS or len(index) >= FILE_DOCS:
                        yield finish()
                if count >= GROUP:
                    flush(False)
        if out is not None:
            yield finish()

    return write_table(dealt.mapInArrow(write, "file_no long, path string, ids long, docs long"), "ids-manifest")


def read_file(file):
    """Documents of one file in order, as (doc_id, [arrays of ids]); a group of blocks at a time."""
    size = file.size()
    file.seek(size - struct.calcsize(TRAILER))
    blocks, docs, at, crc = struct.unpack(TRAILER, file.read(struct.calcsize(TRAILER)))
    file.seek(at)
    table = file.read(16 * docs)
    if zlib.crc32(table) != crc:
        raise ValueError("damaged index")
    index = np.frombuffer(table, "<i8").reshape(-1, 2)
    file.seek(0)
    if file.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a token-id file")

    def ids():
        for lo in range(0, blocks, idcoder.LANES):
            group = []
            for _ in range(min(idcoder.LANES, blocks - lo)):
                head = struct.unpack(idcoder.HEAD, file.read(struct.calcsize(idcoder.HEAD)))
                group.append((head, file.read(2 * head[1])))
            yield np.concatenate(idcoder.decode_blocks(group)).astype("<u4")

    source, have, at = ids(), np.empty(0, "<u4"), 0
    for doc, n in index.tolist():
        parts = []
        while n:
            if at == len(have):
                have, at = next(source), 0
            parts.append(have[at:at + n])
            at += len(parts[-1])
            n -= len(parts[-1])
        yield (None if doc == NULL_ID else doc), parts


def read_ids(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32; a task per file."""
    first = F.coalesce(F.sum("ids").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    jobs = manifest.withColumn("first", first).select("path", "first")      # one row per file

    def read(batches):
        store, _ = open_store(folder)
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("first").to_pylist(), strict=True):
                cols: list[list] = [[], [], [], []]
                with store.open_input_file(path) as f:
                    for doc, parts in read_file(f):
                        crc = n = 0
                        for p in parts:
                            crc, n = zlib.crc32(p.tobytes(), crc), n + len(p)
                        for c, v in zip(cols, (doc, start, n, crc), strict=True):
                            c.append(v)
                        start += n
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                                 names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, manifest.count())
    return jobs.repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_and_read(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the ids of ``docs`` and read them back: doc_id, start, n_tokens, ids_crc32.

    Documents stand in ascending doc_id order, null ids last, rows that repeat an id by a hash of their
    text; a null or empty text is the end id alone; an empty table gives no file and no rows; columns
    besides doc_id and text are not read."""
    folder = folder or shared_folder(docs.sparkSession, "ids")
    return read_ids(write_ids(docs, folder, tokenizer, end_id), folder)
