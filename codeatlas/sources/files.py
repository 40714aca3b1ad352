"""File sources: repository snapshots, JSON artefacts, text documents, images.

Layout of snapshots on storage: ``<root>/<org>/<name>/<number>/<path inside the repo>``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import is_test_path, normalize_path
from ..operators.predicates import drop_minified_twins
from .documents import read_entries
from .listing import as_uri, list_files, read_files, spark_listed

SOURCE_GLOB = "*.{js,jsx,ts,tsx}"

ELEMENT_STRUCT = T.StructType([
    T.StructField("signature", T.StringType()), T.StructField("content", T.StringType()),
    T.StructField("name", T.StringType()), T.StructField("parameters", T.ArrayType(T.StringType())),
    T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType()),
    T.StructField("return", T.BooleanType()),
])
NODE_STRUCT = T.StructType(ELEMENT_STRUCT.fields + [T.StructField("functions", T.ArrayType(ELEMENT_STRUCT))])
STRUCTURE_SCHEMA = T.MapType(T.StringType(), T.MapType(T.StringType(), NODE_STRUCT))
LINKS_SCHEMA = T.StructType([
    T.StructField("nodes", T.ArrayType(T.StructType([T.StructField("id", T.StringType()),
                                                     T.StructField("type", T.StringType())]))),
    T.StructField("links", T.ArrayType(T.StructType([T.StructField("source", T.StringType()),
                                                     T.StructField("target", T.StringType()),
                                                     T.StructField("type", T.StringType())]))),
])
DOC_META_SCHEMA = T.StructType([
    T.StructField("file_name", T.StringType()),
    T.StructField("node_meta", T.ArrayType(T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("class_or_function", NODE_STRUCT),
        T.StructField("import", T.ArrayType(T.StructType([T.StructField("file", T.StringType()),
                                                          T.StructField("function", NODE_STRUCT)]))),
    ]))),
])


def _relative(path_col, root: str):
    """Path below ``root`` (scheme-insensitive), forward slashes."""
    r = re.sub(r"^[a-zA-Z][\w+.-]*:(//)?", "", root.rstrip("/"))
    p = normalize_path(path_col)
    return F.regexp_replace(F.regexp_replace(p, r"^[a-zA-Z][\w+.-]*:(//)?", ""), "^/*" + re.escape(r.lstrip("/")) + "/?", "")


def scan_source_files(spark: SparkSession, root: str, strict_test_dir: bool = False,
                      drop_minified: bool = True) -> DataFrame:
    """``(instance_key, rel_path, ext, content, sha256)`` for every .js/.jsx/.ts/.tsx file under
    ``<root>/<org>/<name>/<number>/``.  The extension filter is a glob applied while listing, which tasks do;
    test folders (folder path containing ``test``, or exactly test/tests with ``strict_test_dir``)
    and minified twins are removed.  Contents are decoded as UTF-8."""
    raw = read_files(spark, root, SOURCE_GLOB)
    rel = _relative(F.col("path"), root)
    parts = F.split(rel, "/")
    df = raw.select(
        F.array_join(F.slice(parts, 1, 3), "/").alias("instance_key"),
        F.array_join(F.slice(parts, 4, F.greatest(F.size(parts) - 3, F.lit(0))), "/").alias("rel_path"),
        F.col("content"))
    # The folder path (snapshot folders included) is tested, never the file name.
    folder = F.concat_ws("/", F.col("instance_key"), F.regexp_replace(F.col("rel_path"), "/?[^/]*$", ""))
    test = is_test_path(F.concat(folder, F.lit("/_")), strict=strict_test_dir)
    df = df.filter(~test).select(
        "instance_key", "rel_path", F.regexp_extract("rel_path", r"\.[^./]*$", 0).alias("ext"),
        F.col("content").cast("string").alias("content"), F.sha2(F.col("content"), 256).alias("sha256"))
    return drop_minified_twins(df, ["instance_key"]) if drop_minified else df


def read_doc_meta(spark: SparkSession, path: str) -> DataFrame:
    """Doc-metadata JSON lines with a declared schema (no inference pass)."""
    return spark.read.schema(DOC_META_SCHEMA).json(path)


def read_structure(spark: SparkSession, path: str) -> DataFrame:
    """S5: structure documents (``file -> node_key -> element`` per snapshot) as rows ``(source, instance_key,
    rel_path, node_key, element struct)``.  A document is read an entry (a file of the snapshot) at a time."""
    files = read_entries(spark, path).select("source", "instance_key", F.col("key").alias("rel_path"),
                                             F.from_json("value", STRUCTURE_SCHEMA.valueType).alias("nodes"))
    return files.select("source", "instance_key", "rel_path", F.explode("nodes").alias("node_key", "element"))


def _graph(spark: SparkSession, path: str, part: str) -> DataFrame:
    kind = LINKS_SCHEMA[part].dataType.elementType
    rows = read_entries(spark, path, ("nodes", "links")).filter(F.col("key") == part)
    return rows.select(F.col("source").alias("source_doc"), "instance_key", F.from_json("value", kind).alias("v")).select(
        "source_doc", "instance_key", "v.*")


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """S5: node-link graph documents -> edge rows ``(source_doc, instance_key, src_path, dst_path, type)``, read an edge
    at a time."""
    return _graph(spark, path, "links").withColumnsRenamed({"source": "src_path", "target": "dst_path"})


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Node rows ``(source_doc, instance_key, node, type)`` of node-link graph documents."""
    return _graph(spark, path, "nodes").withColumnRenamed("id", "node")


def read_text_docs(spark: SparkSession, root: str, glob: str = "*.txt") -> DataFrame:
    """Every matching file below ``root`` as one document ``(path, text)``."""
    if spark_listed(root):
        return (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
                .text(root, wholetext=True)
                .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))
    return read_files(spark, root, glob, unpack=True).select(as_uri("path").alias("path"), F.col("content").cast("string").alias("text"))


def _u(b, start, n: int, little: bool = False):
    """Unsigned integer of ``n`` bytes from the 1-based byte ``start`` (null behind the end)."""
    part = F.substr(b, start if isinstance(start, Column) else F.lit(start), F.lit(n))
    digits = F.hex(part)
    if little:
        digits = F.concat(*[F.substr(digits, F.lit(2 * i + 1), F.lit(2)) for i in reversed(range(n))])
    return F.when(F.octet_length(part) == n, F.conv(digits, 16, 10).cast("long"))


# Segments of a JPEG file that are walked before its frame header has to come.
JPEG_SEGMENTS = 256


def _jpeg_size(b) -> Column:
    """Size from a JPEG's frame header, found by walking the marker segments before it."""
    none = F.lit(None).cast("int")
    state = "struct<pos:int,width:int,height:int>"
    start = F.struct(F.lit(3).alias("pos"), none.alias("width"), none.alias("height")).cast(state)

    def step(s, _):
        at = s["pos"]
        mark = _u(b, at, 2)
        code = mark.bitwiseAND(F.lit(0xFF))
        frame = code.between(0xC0, 0xCF) & ~code.isin(0xC4, 0xC8, 0xCC)
        alone = code.between(0xD0, 0xD8) | (code == 0x01)
        found = F.struct(none.alias("pos"), _u(b, at + 7, 2).alias("width"), _u(b, at + 5, 2).alias("height")).cast(state)
        on = (F.when(code == 0xFF, at + 1).when(alone, at + 2)
              .when(~code.isin(0xD9, 0xDA), at + 2 + _u(b, at + 2, 2)))
        onward = F.struct(on.alias("pos"), none.alias("width"), none.alias("height")).cast(state)
        lost = F.struct(none.alias("pos"), none.alias("width"), none.alias("height")).cast(state)
        return F.when(at.isNull(), s).when(F.shiftright(mark, 8) != 0xFF, lost).when(mark.isNull(), lost).when(frame, found).otherwise(onward)

    return F.aggregate(F.sequence(F.lit(1), F.lit(JPEG_SEGMENTS)), start, step)


def header_size(content) -> Column:
    """``struct(width, height)`` as the header of a PNG, GIF, JPEG or WebP file states it; nulls for others."""
    b = content if isinstance(content, Column) else F.col(content)
    kind = F.hex(F.substring(b, 1, 4))
    form = F.hex(F.substring(b, 13, 4))
    webp = (kind == "52494646") & (F.hex(F.substring(b, 9, 4)) == "57454250")
    lossy = webp & (form == "56503820") & (F.hex(F.substring(b, 24, 3)) == "9D012A")
    lossless = webp & (form == "5650384C") & (F.hex(F.substring(b, 21, 1)) == "2F")
    extended = webp & (form == "56503858")
    bits = _u(b, 22, 4, True)
    jpeg = F.when(F.hex(F.substring(b, 1, 2)) == "FFD8", _jpeg_size(b))
    low14 = F.lit(0x3FFF)

    def pick(png, gif, name, lossy_at, shift, extended_at):
        return (F.when(F.hex(F.substring(b, 1, 8)) == "89504E470D0A1A0A", _u(b, png, 4)).when(kind == "47494638", _u(b, gif, 2, True))
                .when(lossy, _u(b, lossy_at, 2, True).bitwiseAND(low14))
                .when(lossless, F.shiftright(bits, shift).cast("int").bitwiseAND(low14) + 1)
                .when(extended, _u(b, extended_at, 3, True) + 1).otherwise(jpeg[name]))

    return F.struct(pick(17, 7, "width", 27, 0, 25).cast("int").alias("width"),
                    pick(21, 9, "height", 29, 14, 28).cast("int").alias("height"))


def read_images(spark: SparkSession, root: str, assets: DataFrame | None = None, name_col: str = "name") -> DataFrame:
    """Image files under ``root``: ``(instance_key, name, bytes, width, height, size_known)``.  The instance
    is the folder below ``root`` that holds the file; sizes come from the headers of PNG, GIF, JPEG and WebP files.

    With ``assets`` (a list of wanted names) the result is a left join from that list, by instance too
    when the list has ``instance_key``.  The list's own ``width`` and ``height`` count where the header
    gives none (another format, a damaged header).  A missing file keeps its row with null bytes; ``size_known`` is false where
    no size was found, which the token estimate counts as 0."""
    raw = read_files(spark, root)
    b = F.col("content")
    size = header_size(b)
    rel = _relative(F.col("path"), root)
    imgs = raw.select(F.regexp_replace(rel, "/?[^/]*$", "").alias("instance_key"),
                      F.element_at(F.split(rel, "/"), -1).alias(name_col), b.alias("bytes"),
                      size["width"].alias("width"), size["height"].alias("height"))
    if assets is not None:
        keys = [c for c in ("instance_key", name_col) if c in assets.columns]
        stated = [c for c in ("width", "height") if c in assets.columns]
        listed = assets.withColumnsRenamed({c: f"_{c}" for c in stated})
        found = listed.join(imgs if len(keys) == 2 else imgs.drop("instance_key"), keys, "left")
        imgs = found.withColumns({c: F.coalesce(c, f"_{c}") for c in stated}).drop(*[f"_{c}" for c in stated])
    return imgs.withColumn("size_known", F.col("width").isNotNull() & F.col("height").isNotNull())


def list_gifs(spark: SparkSession, root: str) -> DataFrame:
    """Paths of ``.gif`` files (any case) below ``root``; file contents are not read."""
    return list_files(spark, root).select("path").filter(F.lower("path").endswith(".gif"))
