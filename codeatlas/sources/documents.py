"""JSON documents of one snapshot each, written and read piece by piece.

A snapshot's structure or graph is one file in the exchange format, however many elements it has.  ``write_documents``
streams sorted pieces into it; ``read_entries`` takes it apart again, an entry at a time.  Neither holds a
document in memory: a task holds a batch of pieces, or one entry.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .stores import listed, open_store, publish

BLOCK = 1 << 16
_MARK = re.compile(rb"[\"{}\[\],:]")
_STRING_END = re.compile(rb"[\"\\]")
# Whole strings, what else stands between brackets, and pairs of brackets up to four deep.
_PLAIN = rb"[^\"{}\[\]]++|\"(?:[^\"\\]++|\\.)*+\""
_NEST = _PLAIN
for _ in range(4):
    _NEST = _PLAIN + rb"|[{\[](?:" + _NEST + rb")*+[}\]]"
_FLAT = re.compile(rb"(?:" + _NEST + rb")*+", re.DOTALL)


def document_name(key: str | None) -> str:
    """File name of a snapshot's document; ``document_key`` takes it back."""
    return "_null" if key is None else "k" + quote(key, safe="")


def document_key(name: str) -> str | None:
    return None if name == "_null" else unquote(name[1:])


def write_documents(pieces: DataFrame, path: str, sections: list[tuple[str, str, str]]) -> DataFrame:
    """Pieces (instance_key, section, pos, piece) -> one file ``<path>/<instance>.json`` per instance; returns the
    manifest (instance_key, file, pieces).

    ``sections`` are (opening, separator, closing) texts in the document's order; a piece stands in the
    section of its number, in order of ``pos`` (a total order with the piece itself).  An instance's pieces
    are sorted into one task and streamed, so a document may exceed any memory; it appears under its final name
    when it is whole, and a repeated task replaces it.  Instances without pieces have no document."""
    spark = pieces.sparkSession
    ensure_checkpoint_dir(spark)
    rows = pieces.select("instance_key", F.col("section").cast("int").alias("section"), F.col("pos"), "piece")
    rows = rows.repartition("instance_key").sortWithinPartitions("instance_key", "section", "pos", "piece")

    def write(batches):
        import pandas as pd
        from pyspark import TaskContext

        store, top = open_store(path)
        attempt = str(TaskContext.get().taskAttemptId())
        todo = _runs(batches)
        made = []
        for key, rows_of in todo:
            name, n = f"{top}/{document_name(key)}.json", [0]

            def fill(out, rows_of=rows_of, n=n):
                at = -1
                for section, piece in rows_of:
                    while at < section:
                        if at >= 0:
                            out.write(sections[at][2].encode())
                        at += 1
                        out.write(sections[at][0].encode())
                        fresh = True
                    out.write(("" if fresh else sections[at][1]).encode() + piece.encode("utf-8", "surrogatepass"))
                    fresh = False
                    n[0] += 1
                for rest in range(at, len(sections)):
                    out.write(sections[rest][2].encode() if rest == at else (sections[rest][0] + sections[rest][2]).encode())

            publish(store, name, attempt, fill)
            made.append((key, name, n[0]))
        if made:
            yield pd.DataFrame(made, columns=["instance_key", "file", "pieces"])

    return rows.mapInPandas(write, "instance_key string, file string, pieces long").checkpoint()


def _runs(batches) -> Iterator[tuple[str | None, Iterator[tuple[int, str]]]]:
    """(instance, its rows) of sorted batches; an instance's rows are read as they are used."""
    from itertools import groupby

    def rows():
        for pdf in batches:
            keys = pdf["instance_key"].astype(object).where(pdf["instance_key"].notna(), None)
            yield from zip(keys, pdf["section"], pdf["piece"], strict=True)

    for key, run in groupby(rows(), key=lambda r: r[0]):
        yield key, ((section, piece) for _, section, piece in run)


class _Window:
    """A stretch of a stream, addressed by offsets from the stream's begin."""

    def __init__(self, blocks: Iterable[bytes]):
        self.blocks, self.data, self.base = iter(blocks), bytearray(), 0

    def find(self, pattern: re.Pattern, at: int, keep: int) -> tuple[int, bytes] | None:
        """(offset, text) of the next match from ``at`` on; what lies before ``keep`` may be dropped."""
        while True:
            m = pattern.search(self.data, max(0, at - self.base))
            if m is not None:
                return self.base + m.start(), bytes(m[0])
            at = max(at, self.base + len(self.data))
            if not self.more(keep):
                return None

    def more(self, keep: int) -> bool:
        """Read a block; False at the stream's end.  What lies before ``keep`` is dropped."""
        block = next(self.blocks, None)
        if block is None:
            return False
        drop = min(keep, self.base + len(self.data)) - self.base
        del self.data[:drop]
        self.base += drop
        self.data += block
        return True

    def flat_end(self, at: int, keep: int) -> int:
        """Offset of the next bracket from ``at`` on that closes what is open there, opens what ``_FLAT`` doesn't take
        whole, or of a string that the window cuts off, or the stream's end."""
        while True:
            at = self.base + _FLAT.match(self.data, at - self.base).end()
            if at < self.base + len(self.data) or not self.more(keep):
                return at

    def text(self, a: int, b: int) -> bytes:
        return bytes(self.data[a - self.base:b - self.base])

    def string_end(self, at: int, keep: int) -> int:
        """Offset behind the string whose quote stands at ``at``."""
        at += 1
        while (found := self.find(_STRING_END, at, keep)) is not None:
            if found[1] == b'"':
                return found[0] + 1
            at = found[0] + 2
        raise ValueError("the document ends within a string")


def entries(blocks: Iterable[bytes], arrays: tuple[str, ...] = ()) -> Iterator[tuple[str, bytes]]:
    """The entries of a JSON object as (key, text of the value), one at a time; where the value of a key in
    ``arrays`` is an array, its items instead.  Raises ValueError on a document that ends early."""
    text = _Window(blocks)
    depth = at = 0
    key: str | None = None
    value: int | None = None             # where the open value begins
    items = False                        # within an array that is given out by item
    while True:
        if value is not None and depth > 1 + items:
            at = text.flat_end(at, value)        # commas and colons within a value tell nothing
        found = text.find(_MARK, at, at if value is None else value)
        if found is None:
            break
        here, ch = found
        at = here + 1
        if ch == b'"':
            at = text.string_end(here, here if value is None else value)
            if depth == 1 and value is None:
                key = json.loads(text.text(here, at))
        elif ch == b":" and depth == 1:
            value = at
        elif ch in b"{[":
            depth += 1
            if ch == b"[" and depth == 2 and key in arrays:
                items, value = True, at
        elif ch in b"}],":
            if depth == 1 + items and value is not None:
                if whole := text.text(value, here).strip():
                    yield key, whole
                value = at if items and ch == b"," else None
            if ch != b",":
                depth -= 1
                if depth == 1 and items:
                    items = False
                if depth == 0:
                    return
    raise ValueError("the document ends early")


def read_entries(spark: SparkSession, path: str, arrays: tuple[str, ...] = (), suffix: str = ".json") -> DataFrame:
    """Entries of all documents below ``path``: (source, instance_key, key, value), the value as JSON text.

    The driver lists the files; a task opens its documents one after another and reads them in blocks, so
    a document of any size costs the memory of its largest entry."""
    store, top = open_store(path)
    names = listed(store, top, suffix)
    files = spark.createDataFrame([(n,) for n in names], "source string").repartition(max(1, len(names)))

    def read(batches):
        import pandas as pd

        store, _ = open_store(path)
        for pdf in batches:
            for name in pdf["source"]:
                who = document_key(name.rsplit("/", 1)[-1].removesuffix(suffix))
                with store.open_input_stream(name, compression=None) as f:
                    rows, size = [], 0
                    for key, value in entries(iter(lambda f=f: f.read(BLOCK) or None, None), arrays):
                        rows.append((name, who, key, value.decode("utf-8", "surrogatepass")))
                        size += len(value)
                        if size >= BLOCK * 16:
                            yield pd.DataFrame(rows, columns=["source", "instance_key", "key", "value"])
                            rows, size = [], 0
                    if rows:
                        yield pd.DataFrame(rows, columns=["source", "instance_key", "key", "value"])

    return files.mapInPandas(read, "source string, instance_key string, key string, value string")
