"""Column expressions for keys, paths and path predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The source extensions the catalog parses.
SUPPORTED_EXTS = (".js", ".jsx", ".ts", ".tsx")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def instance_key(repo, instance_id) -> Column:
    """``org/name`` + ``/`` + the last ``-`` separated part of the instance id."""
    return F.concat_ws("/", _c(repo), F.element_at(F.split(_c(instance_id), "-"), -1))


def normalize_path(path) -> Column:
    """Backslashes to forward slashes."""
    return F.translate(_c(path), "\\", "/")


def extension(path) -> Column:
    """Final extension including the dot (``''`` when none), as written."""
    return F.regexp_extract(_c(path), r"\.[^./]*$", 0)


def is_supported_ext(path, case_sensitive: bool = False) -> Column:
    """Extension in {.js,.jsx,.ts,.tsx}; lower-cased first unless ``case_sensitive``."""
    ext = extension(path)
    return (ext if case_sensitive else F.lower(ext)).isin(*SUPPORTED_EXTS)


def is_test_path(path, strict: bool = False) -> Column:
    """Literal rule: the path contains ``test`` anywhere (so ``latest/`` matches too).
    ``strict``: some folder component is exactly ``test``, ``tests`` or ``__tests__``."""
    p = normalize_path(path)
    if not strict:
        return p.contains("test")
    parts = F.split(p, "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.exists(folders, lambda s: s.isin("test", "tests", "__tests__"))


def minified_twin(path) -> Column:
    """The non-minified name of ``x.min.js`` (``x.js``); null for other paths."""
    p = _c(path)
    return F.when(p.endswith(".min.js"), F.regexp_replace(p, r"\.min\.js$", ".js"))


def basename(path) -> Column:
    """Last ``/`` separated part of a path or URL."""
    return F.element_at(F.split(_c(path), "/"), -1)


def rel_path(path, drop: int = 4) -> Column:
    """Path relative to a snapshot root: normalise separators, drop the first ``drop`` parts
    (``repo/org/name/number``)."""
    parts = F.split(normalize_path(path), "/")
    return F.array_join(F.slice(parts, drop + 1, F.greatest(F.size(parts) - drop, F.lit(0))), "/")


def element_type(node_key) -> Column:
    """Document type of a structure node: keys containing ``class`` are classes, all other
    nodes (functions, methods, type/interface nodes) are functions."""
    return F.when(_c(node_key).contains("class"), F.lit("Class")).otherwise(F.lit("Function"))


def flat_doc_key(path, element=None) -> Column:
    """Export name of a doc: path with ``/`` turned into ``_``, then ``_element`` if given."""
    flat = F.translate(normalize_path(path), "/", "_")
    return flat if element is None else F.concat_ws("_", flat, _c(element))


def parse_doc_key(key) -> tuple[Column, Column]:
    """Inverse of ``flat_doc_key`` for names whose path ends in a supported extension:
    returns ``(path, element)``; ``_`` inside the path comes back as ``/`` (lossy by design of
    the flat names), element is ``''`` for file-level names."""
    pat = r"^(.*?\.(?:jsx|js|tsx|ts))(?:_(.*))?$"
    flat = F.regexp_extract(_c(key), pat, 1)
    elem = F.regexp_extract(_c(key), pat, 2)
    return F.translate(flat, "_", "/"), elem


def move_first(arr, x) -> Column:
    """Move the first occurrence of ``x`` to the front; unchanged copy when absent."""
    a, v = _c(arr), _c(x)
    pos = F.array_position(a, v)
    rest = F.concat(F.slice(a, 1, F.greatest(pos - 1, F.lit(0))), F.slice(a, pos + 1, F.greatest(F.size(a) - pos, F.lit(0))))
    return F.when(pos > 0, F.concat(F.array(v), rest)).otherwise(a)


def mean_abs_diff(a, b) -> Column:
    """Mean absolute difference of two equal-length numeric arrays (signed arithmetic)."""
    diffs = F.zip_with(_c(a).cast("array<double>"), _c(b).cast("array<double>"), lambda x, y: F.abs(x - y))
    return F.aggregate(diffs, F.lit(0.0).cast("double"), lambda acc, x: acc + x) / F.size(_c(a))


def strip_lines_containing(text, needles) -> Column:
    """Drop every line of ``text`` that contains any of the strings in the array ``needles``."""
    lines = F.split(_c(text), "\n", -1)
    kept = F.filter(lines, lambda ln: ~F.exists(_c(needles), lambda n: ln.contains(n)))
    return F.array_join(kept, "\n")
