"""Files below a folder, listed and read by tasks: the driver never holds their names, and a task takes many of them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, spread
from .stores import open_store

LISTED = 10_000             # entries that a task lists below a folder before it hands the other folders on
BATCH_BYTES = 1 << 22       # content that leaves a task at once


def glob_regex(glob: str) -> str:
    """Regular expression of a file name pattern with ``*``, ``?``, ``[ab]``, ``[^a]`` and ``{a,b}``."""
    out, depth, i = "", 0, 0
    while i < len(glob):
        ch, end = glob[i], glob.find("]", i + 2)
        if ch == "[" and end > 0:
            body = glob[i + 1:end].replace("\\", "\\\\")
            out += f"[{'^' + body[1:] if body[0] in '!^' else body}]"
            i = end
        elif ch == "\\" and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        elif ch == "{" or ch in ",}" and depth:
            depth += (ch == "{") - (ch == "}")
            out += {"{": "(?:", ",": "|", "}": ")"}[ch]
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(ch, re.escape(ch))
        i += 1
    return out


def hidden(name: str) -> bool:
    """Names that Spark's readers pass over, files and folders."""
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def spark_listed(root: str) -> bool:
    """Whether only Spark's readers can list ``root``: a pattern, or a store that Arrow doesn't reach."""
    import pyarrow as pa

    if re.search(r"[*?{\[]", root):
        return True
    try:
        open_store(root)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
        return True
    return False


def _prefix(root: str, top: str) -> str:
    """What stands before a store's own path in the names that Spark gives its files."""
    return "file:" if root.startswith(("/", "file:")) else root.rstrip("/").removesuffix(top)


def list_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """``(path, length)`` of the files below ``root`` that hold something, whose names match ``glob``; as Spark's
    readers do, without hidden ones and with paths as they name them.

    Tasks list folders.  One that has met many entries hands on the folders it has not looked into, which
    are dealt over all cores in the next round; what a task holds is bounded by one folder's own entries."""
    if spark_listed(root):
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        return (reader.option("pathGlobFilter", glob) if glob else reader).load(root).select("path", "length")
    from pyarrow import fs

    ensure_checkpoint_dir(spark)
    store, top = open_store(root)
    if store.get_file_info(top).type == fs.FileType.NotFound:
        raise FileNotFoundError(f"no file or folder at {root}")
    prefix, match = _prefix(root, top), re.compile(glob_regex(glob or "*"), re.DOTALL).fullmatch

    def walk(batches):
        import pyarrow as pa

        store, _ = open_store(root)
        for b in batches:
            for first in b.column("path").to_pylist():
                waiting, seen = [store.get_file_info(first[len(prefix):])], 0
                while waiting and seen < LISTED:
                    at = waiting.pop()
                    found = store.get_file_info(fs.FileSelector(at.path)) if at.type == fs.FileType.Directory else [at]
                    seen += len(found)
                    shown = [f for f in found if not hidden(f.base_name) or f is at]
                    waiting += [f for f in shown if f.type == fs.FileType.Directory]
                    files = [f for f in shown if f.type == fs.FileType.File and f.size and match(f.base_name)]
                    for lo in range(0, len(files), LISTED):
                        some = files[lo:lo + LISTED]
                        yield pa.RecordBatch.from_pydict({"path": [prefix + f.path for f in some], "length": pa.array([f.size for f in some], pa.int64())})
                if waiting:
                    yield pa.RecordBatch.from_pydict({"path": [prefix + f.path for f in waiting], "length": pa.nulls(len(waiting), pa.int64())})

    most = 4 * spark.sparkContext.defaultParallelism
    folders, files = spark.range(1, numPartitions=1).select(F.lit(prefix + top).alias("path")), None
    while True:
        found = folders.mapInArrow(walk, "path string, length long").checkpoint()
        here = found.filter("length is not null")
        files = here if files is None else files.unionByName(here)
        folders = found.filter("length is null").select("path")
        n = folders.count()
        if n == 0:
            return files
        folders = folders.repartition(min(n, most))


def read_files(spark: SparkSession, root: str, glob: str | None = None, unpack: bool = False) -> DataFrame:
    """``(path, content)`` of the files of ``list_files``; ``unpack`` decompresses those whose names say so.  The files
    are dealt over all cores, and a task reads many, one at a time."""
    if spark_listed(root):
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        return (reader.option("pathGlobFilter", glob) if glob else reader).load(root).select("path", "content")
    skip = len(_prefix(root, open_store(root)[1]))

    def read(batches):
        import pyarrow as pa

        store, _ = open_store(root)
        for b in batches:
            names, texts, held = [], [], 0
            for path in b.column("path").to_pylist():
                with store.open_input_stream(path[skip:], compression="detect" if unpack else None) as f:
                    texts.append(f.read())
                names.append(path)
                held += len(texts[-1])
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pydict({"path": names, "content": pa.array(texts, pa.binary())})
                    names, texts, held = [], [], 0
            if names:
                yield pa.RecordBatch.from_pydict({"path": names, "content": pa.array(texts, pa.binary())})

    return spread(list_files(spark, root, glob).select("path")).mapInArrow(read, "path string, content binary")


def as_uri(path: str) -> Column:
    """A column of paths as the metadata of Spark's readers states them."""
    out = F.col(path)
    for ch in "%\t\n\r \"#<>?[\\]^`{|}":
        out = F.replace(out, F.lit(ch), F.lit(f"%{ord(ch):02X}"))
    return out
