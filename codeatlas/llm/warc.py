"""WARC archives written from and read into a chunked record table."""

from __future__ import annotations

import hashlib
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, open_store, shared_folder, write_table

CHUNK = 1 << 14              # payload bytes of a chunk row
CHUNK_BATCH = 4 << 20        # bytes of chunks that leave a task at once
FILE_BYTES = 32 << 20        # payload bytes of an archive file, about
REVISIT_BYTES = 100          # smaller payloads are stored each time
BLOCK = 1 << 16              # bytes read from an archive at once
DATE = "1970-01-01T00:00:00Z"  # reruns write equal archives

RECORD = T.StructType([T.StructField(n, t) for n, t in (
    ("page_id", T.LongType()), ("payload_bytes", T.LongType()), ("payload_digest", T.StringType()),
    ("record_type", T.StringType()), ("refers_to", T.LongType()))])


_CHUNKS = ("page_id long, digest string, copy long, n_bytes long, url string, chunk_no long, running string, chunk binary")


def chunk_table(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) -> the record table: page_id, digest (SHA-256 of the whole payload), copy,
    n_bytes, url, chunk_no, running (SHA-256 of the payload up to the end of this chunk), chunk.  A payload of n bytes
    gives max(1, ceil(n / CHUNK)) rows; chunks are cut one by one from the page's buffer, and the digest
    advances with them, so the last one's is the payload's.  ``copy`` tells rows with equal page_id and
    payload apart.  A null html is an empty payload."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"),
                        F.monotonically_increasing_id().alias("copy"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary())
    names = ("page_id", "digest", "copy", "n_bytes", "url", "chunk_no", "running", "chunk")

    def cut_up(batches):
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
            out.clear()
            return made

        held = 0
        for b in batches:
            payloads = b.column("payload")
            heads = zip(*(b.column(c).to_pylist() for c in ("page_id", "digest", "copy", "url")), strict=True)
            for i, (page, digest, copy, url) in enumerate(heads):
                payload, sha = payloads[i].as_buffer(), hashlib.sha256()
                for no in range(max(1, -(-payload.size // CHUNK))):
                    chunk = payload.slice(no * CHUNK, min(CHUNK, payload.size - no * CHUNK)).to_pybytes()
                    sha.update(chunk)
                    out.append((page, digest, copy, payload.size, url, no, sha.hexdigest(), chunk))
                    held += len(chunk)
                    if held >= CHUNK_BATCH:
                        yield batch()
                        held = 0
            if out:
                yield batch()
                held = 0

    return rows.mapInArrow(cut_up, _CHUNKS)


def originals(pages: DataFrame) -> DataFrame:
    """(page_id, digest, n_bytes) -> per distinct (page_id, digest): refers_to, ``first`` (its first copy
    is the response).  Payloads group by length and SHA-256; the smallest page_id, null last, responds."""
    each = pages.distinct()
    key = F.struct(F.col("page_id").isNull(), "page_id")
    low = each.where(F.col("n_bytes") >= REVISIT_BYTES).groupBy("digest").agg(F.min(key).alias("low"))
    low = low.select(F.col("digest").alias("d"), F.col("low.page_id").alias("low"))
    big = F.col("d").isNotNull()
    return (each.join(low, F.col("digest") == F.col("d"), "left")
            .select("page_id", "digest", F.when(big, F.col("low")).alias("refers_to"), big.alias("shared"),
                    (~big | F.col("page_id").eqNullSafe(F.col("low"))).alias("first")))


def _head(record: str, page: str, url: str | None, digest: str, size: int, refers: str | None, length: int, http: str) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {record}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Date: {DATE}",
             f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}",
             f"Content-Type: application/http; msgtype={record}", f"Content-Length: {length}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._')}")
    if refers is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers}>",
                  "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return ("\r\n".join(lines) + "\r\n\r\n" + http).encode()


def write_warc(pages: DataFrame, folder: str) -> DataFrame:
    """Write gzip WARC files below ``folder``; returns the manifest (path, records).

    Decisions (one row per record key) travel with the chunk rows through one exchange on the record
    key; a task sorts its rows by (record, chunk) and streams them, so it holds one chunk and one
    running SHA-256 at a time, whatever a record's size, and checks it against each chunk's.
    A file appears under its final name only when whole, so a repeated task replaces it.
    """
    rows = pages.select("page_id", F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("digest"),
                        F.coalesce(F.octet_length("html"), F.lit(0)).cast("long").alias("n_bytes"))
    rows = cut(rows)
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    files = max(pages.sparkSession.sparkContext.defaultParallelism, -(-total // FILE_BYTES))
    chunks = chunk_table(pages).withColumns({"refers_to": F.lit(None).cast("long"), "shared": F.lit(False), "first": F.lit(False)})
    told = originals(rows).select(
        "page_id", "digest", F.lit(-1).cast("long").alias("copy"), F.lit(0).cast("long").alias("n_bytes"),
        F.lit(None).cast("string").alias("url"), F.lit(-1).cast("long").alias("chunk_no"),
        F.lit(None).cast("string").alias("running"), F.lit(b"").alias("chunk"), "refers_to", "shared", "first")
    dealt = (told.unionByName(chunks).repartition(int(files), "page_id", "digest")
             .sortWithinPartitions("page_id", "digest", "copy", "chunk_no"))

    def write(batches):
        store, top = open_store(folder)
        name = f"{top}/part-{TaskContext.get().partitionId():05d}.warc.gz"
        out = part = None
        records = 0
        told = sha = packer = None
        copies, revisit = 0, False
        for b in batches:
            if out is None:
                store.create_dir(top, recursive=True)
                part = f"{name}.{TaskContext.get().taskAttemptId()}"
                out = store.open_output_stream(part, compression=None)
            cols = [b.column(c) for c in ("page_id", "digest", "n_bytes", "url", "chunk_no", "running",
                                          "chunk", "refers_to", "shared", "first")]
            for i in range(b.num_rows):
                page, digest, size, url, no, running, chunk, refers, shared, first = (c[i].as_py() for c in cols)
                if no < 0:
                    told, copies = (refers, shared, first), 0
                    continue
                name_of = "null" if page is None else str(page)
                if no == 0:
                    # The first copy of the smallest page_id responds; further copies revisit it.
                    revisit = told[1] and not (told[2] and copies == 0)
                    copies, sha = copies + 1, hashlib.sha256()
                    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                    if revisit:
                        http = "HTTP/1.1 200 OK\r\n\r\n"
                        to = "null" if told[0] is None else str(told[0])
                        out.write(packer.compress(_head("revisit", name_of, url, digest, size, to, len(http), http)))
                    else:
                        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
                        out.write(packer.compress(_head("response", name_of, url, digest, size, None, len(http) + size, http)))
                sha.update(chunk)
                if sha.hexdigest() != running:
                    raise ValueError(f"chunk {no} of page {page} is missing, misplaced or changed")
                if not revisit:
                    out.write(packer.compress(chunk))
                if no == max(0, -(-size // CHUNK) - 1):
                    if running != digest:
                        raise ValueError(f"payload of page {page} changed while it was written")
                    out.write(packer.compress(b"\r\n\r\n"))
                    out.write(packer.flush())
                    records += 1
        if out is not None:
            out.close()
            store.move(part, name)
            yield pa.RecordBatch.from_pydict({"path": [name], "records": [records]},
                                             pa.schema([("path", pa.string()), ("records", pa.int64())]))

    return write_table(dealt.mapInArrow(write, "path string, records long"), "warc-manifest")


def _members(stream):
    """Uncompressed blocks of the gzip members of a file, bounded in size; None after each member."""
    rest, z = b"", None
    while True:
        data = rest or stream.read(BLOCK)
        rest = b""
        if not data:
            if z is not None:
                raise ValueError("an archive ends within a record")
            return
        if z is None:
            z = zlib.decompressobj(31)
        out = z.decompress(data, BLOCK)
        yield out
        while not z.eof and (z.unconsumed_tail or len(out) == BLOCK):
            out = z.decompress(z.unconsumed_tail, BLOCK)
            yield out
        if z.eof:
            rest, z = z.unused_data, None
            yield None


def read_records(stream):
    """Records of one archive file as (page_id, payload_bytes, payload_digest, record_type, refers_to);
    lengths and digests of responses are those of the payload as read, block by block."""
    head, fields, sha, left, size, http = b"", None, None, 0, 0, True
    for block in _members(stream):
        if block is None:
            if fields is not None:
                revisit = fields["warc-type"] == "revisit"
                told = fields["warc-payload-digest"].removeprefix("sha256:")
                if left or not revisit and sha.hexdigest() != told:
                    raise ValueError("damaged WARC record")
                ident = [None if x in (None, "null") else int(x) for x in (
                    fields[k].strip("<>").removeprefix("urn:page:") if k in fields else None
                    for k in ("warc-record-id", "warc-refers-to"))]
                yield (ident[0], int(fields["x-payload-length"]) if revisit else size, told if revisit else sha.hexdigest(),
                       fields["warc-type"], ident[1])
            head, fields, http = b"", None, True
            continue
        if fields is None or http:
            head += block
            if fields is None and b"\r\n\r\n" in head:
                top, head = head.split(b"\r\n\r\n", 1)
                fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in top.decode().split("\r\n")[1:])}
                left, sha, size = int(fields["content-length"]), hashlib.sha256(), 0
            if fields is None or b"\r\n\r\n" not in head[:left]:
                continue
            top, block = head.split(b"\r\n\r\n", 1)
            left -= len(top) + 4
            head, http = b"", False
        part = block[:left]
        sha.update(part)
        size += len(part)
        left -= len(part)


def read_warc(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per record of the files of a manifest; a task streams one file at a time."""
    def read(batches):
        store, _ = open_store(folder)
        for b in batches:
            for path in b.column("path").to_pylist():
                with store.open_input_stream(path, compression=None) as f:
                    rows: list[tuple] = []
                    for r in read_records(f):
                        rows.append(r)
                        if len(rows) == 10_000:
                            yield _batch(rows)
                            rows = []
                    if rows:
                        yield _batch(rows)

    n = max(1, manifest.count())
    return manifest.select("path").repartition(n).mapInArrow(read, RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=RECORD.names)


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` as WARC files, read them back, and return what was read: page_id,
    payload_bytes, payload_digest, record_type, refers_to.

    Payloads of at least ``REVISIT_BYTES`` bytes that are equal are stored once, under their smallest
    page_id (null counts as largest); others revisit it, rows that repeat that page included.  A null
    html is an empty payload, a null url is left out, an empty table gives no file and no rows, and
    columns besides page_id, url and html are not read.
    """
    folder = folder or shared_folder(pages.sparkSession, "warc")
    return read_warc(write_warc(pages.select("page_id", "url", "html"), folder), folder)
