"""Import graph, call resolution and documentation scheduling over element tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import SUPPORTED_EXTS
from ..session import shuffled
from .elements import IDENT, KEYWORDS

IMPORT_SOURCE = r"""\bimport\s+(?:[\w$*{}\s,]+?\s+from\s+)?['"]([^'"\n]+)['"]"""


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def import_specs(files: DataFrame, key_cols: list[str], content_col: str = "content") -> DataFrame:
    """``key + (pos, spec)``: module sources of ``import ... from 'x'`` / ``import 'x'``
    statements in file order (``require`` and re-exports are not imports here)."""
    return files.select(*key_cols, F.posexplode(F.regexp_extract_all(F.col(content_col), F.lit(IMPORT_SOURCE), 1))
                        .alias("pos", "spec"))


def _dirname(p: Column) -> Column:
    parts = F.split(p, "/")
    return F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/")


def _join(d: Column, x: Column) -> Column:
    return F.when(d == "", x).otherwise(F.concat(d, F.lit("/"), x))


def resolve_import(src_path, spec) -> Column:
    """Target path of an import, or null when the edge is dropped.

    An extension other than .js/.jsx/.ts/.tsx drops the edge (``jquery.min`` has one); no
    extension gets the importing file's.  ``./x`` resolves in the importing folder, each leading
    ``../`` goes one folder up, anything else (a package name) is kept as written."""
    src, sp = _c(src_path), _c(spec)
    base = F.element_at(F.split(sp, "/"), -1)
    ext = F.regexp_extract(base, r"^\.*[^.].*(\.[^.]*)$", 1)
    src_ext = F.regexp_extract(F.element_at(F.split(src, "/"), -1), r"^\.*[^.].*(\.[^.]*)$", 1)
    full = F.when(ext == "", F.concat(sp, src_ext)).otherwise(sp)
    d = _dirname(src)
    ups = (F.char_length(F.regexp_extract(full, r"^(\.\./)*", 0)) / 3).cast("int")
    dparts = F.split(d, "/")
    popped = F.array_join(F.slice(dparts, 1, F.greatest(F.size(dparts) - ups, F.lit(0))), "/")
    popped = F.when(d == "", F.lit("")).otherwise(popped)
    rest = F.regexp_replace(full, r"^(\.\./)+", "")
    target = (F.when(full.startswith("./"), _join(d, F.substring(full, 3, 1 << 30)))
              .when(full.startswith("../"), _join(popped, rest))
              .otherwise(full))
    keep = (ext == "") | ext.isin(*SUPPORTED_EXTS)
    return F.when(keep, target)


def import_edges(files: DataFrame, key_cols: list[str], path_col: str = "rel_path",
                 content_col: str = "content") -> DataFrame:
    """Distinct ``(key..., src_path, dst_path)`` edges with the first position of each."""
    inst = [c for c in key_cols if c != path_col]
    specs = import_specs(files, key_cols, content_col)
    e = specs.select(*inst, F.col(path_col).alias("src_path"), "pos",
                     resolve_import(F.col(path_col), F.col("spec")).alias("dst_path")).filter(F.col("dst_path").isNotNull())
    return e.groupBy(*inst, "src_path", "dst_path").agg(F.min("pos").alias("pos"))


def graph_nodes(files: DataFrame, edges: DataFrame, inst_cols: list[str], path_col: str = "rel_path") -> DataFrame:
    """Every scanned file (type ``file``) plus every edge target that is not a file (untyped)."""
    f = files.select(*inst_cols, F.col(path_col).alias("node"), F.lit("file").alias("type"))
    t = edges.select(*inst_cols, F.col("dst_path").alias("node")).distinct() \
        .join(shuffled(f.select(*inst_cols, "node")), [*inst_cols, "node"], "left_anti") \
        .withColumn("type", F.lit(None).cast("string"))
    return f.unionByName(t)


def internal_imports(edges: DataFrame, files: DataFrame, inst_cols: list[str], path_col: str = "rel_path") -> DataFrame:
    """Edges whose target is a scanned file of the same snapshot."""
    targets = files.select(*inst_cols, F.col(path_col).alias("dst_path"))
    return edges.join(shuffled(targets), [*inst_cols, "dst_path"], "left_semi")


def imports_by_file(edges: DataFrame, inst_cols: list[str]) -> DataFrame:
    """Per source file: number of targets and the targets in import order (comma separated).
    One row per file; the list is bounded by the file's own import statements."""
    return edges.groupBy(*inst_cols, "src_path").agg(
        F.count(F.lit(1)).alias("n_imports"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "dst_path"))), lambda s: s["dst_path"]),
                     ",").alias("targets"))


_HEADERS = [
    (r"(?m)\bfunction\b(\s*\*?\s*)" + IDENT + r"\s*\(", r"function$1("),
    (r"\bnew\s+" + IDENT + r"(\s*\()", r"new _$1"),
    (r"(?m)^(\s*)(?:(?:static|async|get|set)\s+)*" + IDENT + r"(\s*\([^)]*\)\s*\{)", r"$1$2"),
]
_BLANK_ML = r"(?m)\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|/\*(?s:.*?)\*/|//.*$"


def call_names(content) -> Column:
    """Plain calls ``f(...)`` in an element's text in order, duplicates kept.  Member calls
    ``a.f()``, constructor calls ``new F()``, keywords and the element's own declaration and
    method headers are not calls."""
    t = F.regexp_replace(_c(content), _BLANK_ML, " ")
    for pat, rep in _HEADERS:
        t = F.regexp_replace(t, pat, rep)
    found = F.regexp_extract_all(t, F.lit(r"(?<![\w$.])(" + IDENT + r")\s*\("), 1)
    return F.filter(found, lambda x: ~x.isin(*KEYWORDS) & (x != "_"))


def element_calls(elements: DataFrame, key_cols: list[str]) -> DataFrame:
    """``key + (start_line, name, pos, call_name)`` one row per call occurrence."""
    return elements.select(*key_cols, "start_line", "name", F.posexplode(call_names(F.col("content")))
                           .alias("pos", "call_name"))


def callables(elements: DataFrame, key_cols: list[str]) -> DataFrame:
    """Names a file offers to callers: a class offers its methods' names (not its own), every
    other top-level element its own name.  ``key + (callee, callee_line)``."""
    top = elements.filter(F.col("node_key").isNotNull())
    own = top.filter(F.col("kind") != "class").select(*key_cols, F.col("name").alias("callee"),
                                                      F.col("start_line").alias("callee_line"))
    methods = elements.filter(F.col("parent_ordinal").isNotNull()).select(
        *key_cols, F.col("name").alias("callee"), F.col("start_line").alias("callee_line"))
    return own.unionByName(methods)


def callee_refs(calls: DataFrame, edges: DataFrame, offered: DataFrame, inst_cols: list[str],
                path_col: str = "rel_path") -> DataFrame:
    """Bag join: every call occurrence x every internal import of the calling file x every
    callable of the imported file with the called name (one hop)."""
    c = calls.withColumnRenamed(path_col, "src_path")
    e = edges.select(*inst_cols, "src_path", "dst_path")
    o = offered.select(*inst_cols, F.col(path_col).alias("dst_path"), F.col("callee").alias("call_name"), "callee_line")
    return c.join(shuffled(e), [*inst_cols, "src_path"]).join(shuffled(o), [*inst_cols, "dst_path", "call_name"])


def reference_context(refs: DataFrame, elements: DataFrame, docs: DataFrame, inst_cols: list[str],
                      path_col: str = "rel_path") -> DataFrame:
    """Per calling element the text of what it references: path, doc (``None`` where ``docs`` has none),
    signature and code of every resolved callee in reference order.

    ``refs`` as from ``callee_refs``; ``elements`` and ``docs`` are keyed by instance, path and
    ``start_line``.  Returns ``inst_cols + [src_path, start_line, n_refs, context]``, one row per caller,
    bounded by the calls in that element's own text."""
    keys = [*inst_cols, "dst_path", "callee_line"]
    at = [*inst_cols, F.col(path_col).alias("dst_path"), F.col("start_line").alias("callee_line")]
    # Texts stream past the keys of the callees, so a task sorts only those that are referenced.
    called = refs.select(*keys).distinct().hint("shuffle_hash")

    def needed(df: DataFrame, *texts) -> DataFrame:
        return shuffled(df.select(*at, *texts).join(called, keys, "left_semi"))

    j = refs.join(needed(elements, "signature", "content"), keys).join(needed(docs, "doc"), keys, "left")
    text = F.concat_ws("\n", "dst_path", F.coalesce("doc", F.lit("None")), "signature", "content", F.lit(""))
    g = j.groupBy(*inst_cols, "src_path", "start_line").agg(
        F.count(F.lit(1)).alias("n_refs"),
        F.array_sort(F.collect_list(F.struct("pos", "dst_path", "callee_line", text.alias("t")))).alias("_r"))
    return g.select(*inst_cols, "src_path", "start_line", "n_refs",
                    F.array_join(F.transform("_r", lambda s: s["t"]), "").alias("context"))


def docs_ready(elements: DataFrame, refs: DataFrame, documented: DataFrame, id_cols: list[str]) -> DataFrame:
    """Elements (not yet documented) all of whose callees already have docs: a universal
    condition as two anti-joins - refs to undocumented callees mark the caller unresolved."""
    dst = [f"dst_{c}" for c in id_cols]
    undone = refs.join(documented.select(*[F.col(c).alias(d) for c, d in zip(id_cols, dst)]), dst, "left_anti")
    blocked = undone.select(*[F.col(f"src_{c}").alias(c) for c in id_cols]).distinct()
    todo = elements.join(documented.select(*id_cols), id_cols, "left_anti")
    return todo.join(blocked, id_cols, "left_anti")


def doc_waves(elements: DataFrame, refs: DataFrame, id_cols: list[str], documented: DataFrame | None = None) -> DataFrame:
    """Documentation schedule: level 0 = elements without callees; level k = elements whose
    callees all sit on levels < k.  Callees in ``documented`` (docs carried from an earlier snapshot)
    count as done from the start.  Elements never reached (cycles, missing callees, or callees
    that depend on those) are ``forced``.

    Counting of open callees: a round joins only the elements finished in the round before to the
    reference table and subtracts from their callers' counts, so every reference is used once over
    all rounds.  Rounds are checkpointed; lineage stays one round deep."""
    from ..session import ensure_checkpoint_dir

    ensure_checkpoint_dir(elements.sparkSession)
    src, dst = [f"src_{c}" for c in id_cols], [f"dst_{c}" for c in id_cols]

    def named(df, cols):
        return df.select(*[F.col(c).alias(x) for c, x in zip(id_cols, cols)])

    nodes = elements.select(*id_cols).distinct()
    live = refs.select(*src, *dst).distinct().join(shuffled(named(nodes, src)), src, "left_semi")
    if documented is not None:
        live = live.join(shuffled(named(documented, dst)), dst, "left_anti")
    live = live.checkpoint()
    counts = live.groupBy(*[F.col(s).alias(c) for c, s in zip(id_cols, src)]).agg(F.count(F.lit(1)).alias("_open"))
    left = nodes.join(shuffled(counts), id_cols, "left").withColumn("_open", F.coalesce("_open", F.lit(0))).checkpoint()
    done, level = None, 0
    while True:
        ready = left.filter(F.col("_open") == 0).select(*id_cols)
        if ready.isEmpty():
            break
        wave = ready.withColumn("level", F.lit(level))
        done = wave if done is None else done.unionByName(wave)
        closed = (live.join(shuffled(named(ready, dst)), dst, "left_semi")
                  .groupBy(*[F.col(s).alias(c) for c, s in zip(id_cols, src)]).agg(F.count(F.lit(1)).alias("_closed")))
        left = (left.filter(F.col("_open") > 0).join(shuffled(closed), id_cols, "left")
                .withColumn("_open", F.col("_open") - F.coalesce("_closed", F.lit(0))).drop("_closed").checkpoint())
        level += 1
    forced = left.select(*id_cols).withColumn("level", F.lit(None).cast("int")).withColumn("forced", F.lit(True))
    return forced if done is None else done.withColumn("forced", F.lit(False)).unionByName(forced)
