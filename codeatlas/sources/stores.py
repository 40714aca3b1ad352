"""Folders of any store that Arrow reaches (file, hdfs, s3, gs), for files that Spark's own writers and readers
can't make or take piece by piece."""

from __future__ import annotations

import posixpath


def open_store(uri: str):
    """(file system, path) of a folder."""
    from pyarrow import fs

    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def publish(store, path: str, attempt: str, write, made: set[str] | None = None) -> None:
    """Make a file under its final name only once it is whole: ``write`` gets the stream of a file of its own.  ``made``
    remembers the folders of many files, so that each is made once."""
    folder = posixpath.dirname(path)
    if made is None or folder not in made:
        store.create_dir(folder, recursive=True)
        if made is not None:
            made.add(folder)
    part = f"{posixpath.dirname(path)}/.{posixpath.basename(path)}.{attempt}"
    with store.open_output_stream(part, compression=None) as out:
        write(out)
    store.move(part, path)


def listed(store, path: str, suffix: str) -> list[str]:
    """Paths of the files below a folder that end in ``suffix``; unfinished ones (a leading dot) don't count."""
    from pyarrow import fs

    found = store.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith(suffix) and not f.base_name.startswith("."))
