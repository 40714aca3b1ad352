"""Sources and sinks: files, documents and batches derived from the tables, written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.elements import code_elements
from ..operators.graph import graph_nodes, import_edges
from ..session import ensure_checkpoint_dir
from ..sources import files as S
from ..sources import sinks as K
from .code_fixture import FILE_LINES_SQL, shape_files, source_files
from .registry import T, register, sql_of

KEY = ["instance_key", "rel_path"]


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


# Beside each file of the generated snapshots lie a style sheet, a test, and a bundle whose source is there.
@register("scan_source_files", f"""
with f as (select 'org/' || instance_key || '/1' as instance_key, rel_path, array_to_string(fl, chr(10)) as content from {FILE_LINES_SQL}),
b as (select instance_key, regexp_replace(rel_path, '[.][jt]s$', '.min.js') as rel_path, 'x()' as content from f where rel_path like '%.ts')
select instance_key, rel_path, regexp_extract(rel_path, '[.][^./]*$', 0) as ext, content, sha256(content) as sha256
from (select * from f union all select * from b)""")
def q_scan_source_files(spark, root):
    files = source_files(T(spark, root, "part")).select(F.concat(F.lit("org/"), "instance_key", F.lit("/1")).alias("instance_key"), "rel_path", "content")
    base = F.regexp_replace("rel_path", r"\.[jt]s$", "")
    more = files.select("instance_key", F.explode(F.array(
        F.struct(F.concat(base, F.lit(".css")).alias("rel_path"), F.lit("a {}").alias("content")),
        F.struct(F.concat(F.lit("tests/"), "rel_path").alias("rel_path"), F.col("content")),
        F.struct(F.concat(base, F.lit(".min.js")).alias("rel_path"), F.lit("x()").alias("content")))).alias("m")).select("instance_key", "m.*")
    path = _folder(spark, "snapshots")
    K.write_files(files.unionByName(more).withColumn("name", F.concat_ws("/", *KEY)), path)
    return S.scan_source_files(spark, path)


@register("read_doc_meta", """
select 'src/p_' || p_partkey || '.js' as file_name, 'Function' as type, p_name as name, p_size::int as start_line, p_size % 2 = 0 as has_return,
       p_brand as callee_file from part""")
def q_read_doc_meta(spark, root):
    element = F.struct(F.lit("").alias("signature"), F.lit("x").alias("content"), F.col("p_name").alias("name"), F.array(F.lit("a")).alias("parameters"),
                       F.col("p_size").cast("int").alias("start_line"), F.col("p_size").cast("int").alias("end_line"), (F.col("p_size") % 2 == 0).alias("return"))
    node = F.struct(F.lit("Function").alias("type"), element.alias("class_or_function"),
                    F.array(F.struct(F.col("p_brand").alias("file"), element.alias("function"))).alias("import"))
    path = _folder(spark, "meta")
    K.write_jsonl(T(spark, root, "part").select(F.lit("i").alias("instance_key"), F.concat(F.lit("src/p_"), "p_partkey", F.lit(".js")).alias("file_name"),
                                                F.array(node).alias("node_meta")), path)
    return S.read_doc_meta(spark, path).select("file_name", F.explode("node_meta").alias("n")).select(
        "file_name", "n.type", "n.class_or_function.name", "n.class_or_function.start_line",
        F.col("n.class_or_function.return").alias("has_return"), F.col("n.import")[0]["file"].alias("callee_file"))


@register("structure_documents", f"""
with e as ({sql_of("code_elements_shapes")})
select instance_key, rel_path, node_key, name, start_line::int as start_line, end_line::int as end_line, has_return,
       case when kind = 'class' then 2 else 0 end as n_functions
from e where node_key is not null""")
def q_structure_documents(spark, root):
    """Each snapshot's structure as one document, written and read in pieces."""
    path = _folder(spark, "structure")
    K.write_structure(code_elements(shape_files(T(spark, root, "part")), KEY), path)
    return S.read_structure(spark, path).select(*KEY, "node_key", "element.name", "element.start_line", "element.end_line",
                                                F.col("element.return").alias("has_return"), F.size("element.functions").alias("n_functions"))


@register("graph_documents", sql_of("job_import_graph"))
def q_graph_documents(spark, root):
    """Each snapshot's import graph as one document, written and read in pieces."""
    files = source_files(T(spark, root, "part")).checkpoint()
    edges = import_edges(files, KEY)
    path = _folder(spark, "graph")
    K.write_node_link(graph_nodes(files, edges, ["instance_key"]), edges, path)
    nodes, links = S.read_nodes(spark, path), S.read_links(spark, path)
    return nodes.select("instance_key", "node", "type", F.lit(None).cast("string").alias("target")).unionByName(
        links.select("instance_key", F.col("src_path").alias("node"), F.lit("edge").alias("type"), F.col("dst_path").alias("target")))


@register("read_text_docs", "select doc_id, text from documents where text <> ''")
def q_read_text_docs(spark, root):
    """Every document as a text file below a folder per source; empty files hold no document."""
    path = _folder(spark, "texts")
    d = T(spark, root, "documents")
    K.write_files(d.select(F.concat_ws("/", F.coalesce("source", F.lit("none")), F.concat(F.lit("doc_"), "doc_id", F.lit(".txt"))).alias("name"), "text"),
                  path, content_col="text")
    return S.read_text_docs(spark, path).select(F.regexp_extract("path", r"doc_(-?\d+)\.txt$", 1).cast("long").alias("doc_id"), "text")


_IMAGE_SQL = "['png', 'gif', 'jpg', 'webp'][p_partkey % 4 + 1]"


def _image_folder(spark, root) -> str:
    """An image file per part, with the header of its kind and the part's own size."""
    w, h = F.col("p_size") * 10, F.col("p_partkey") % 500 + 1

    def big(x, n):
        return F.lpad(F.hex(x.cast("long")), 2 * n, "0")

    def little(x):
        two = big(x, 2)
        return F.concat(F.substring(two, 3, 2), F.substring(two, 1, 2))

    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big(w, 4), big(h, 4), F.lit("0802000000"))
    gif = F.concat(F.lit("474946383961"), little(w), little(h), F.lit("000000"))
    jpg = F.concat(F.lit("FFD8FFE00004ABCDFFFFDB0003FFFFC2000B08"), big(h, 2), big(w, 2), F.lit("01011100FFD9"))
    webp = F.concat(F.lit("524946460000000057454250565038200A000000100000" + "9D012A"), little(w), little(h))
    at = (F.col("p_partkey") % 4 + 1).cast("int")
    name = F.concat(F.replace(F.col("p_brand"), F.lit("#"), F.lit("_")), F.lit("/1/img_"), "p_partkey", F.lit("."), F.element_at(F.array(*map(F.lit, ("png", "gif", "jpg", "webp"))), at))
    path = _folder(spark, "images")
    K.write_files(T(spark, root, "part").select(name.alias("name"), F.unhex(F.element_at(F.array(png, gif, jpg, webp), at)).alias("content")), path)
    return path


@register("read_images", f"""
select replace(p_brand, '#', '_') || '/1' as instance_key, 'img_' || p_partkey || '.' || {_IMAGE_SQL} as name, (p_size * 10)::int as width,
       (p_partkey % 500 + 1)::int as height, true as size_known from part""")
def q_read_images(spark, root):
    """Sizes of PNG, GIF, JPEG and WebP files from their headers."""
    return S.read_images(spark, _image_folder(spark, root)).select("instance_key", "name", "width", "height", "size_known")


@register("list_gifs", f"select 'img_' || p_partkey || '.gif' as name from part where {_IMAGE_SQL} = 'gif'")
def q_list_gifs(spark, root):
    return S.list_gifs(spark, _image_folder(spark, root)).select(F.element_at(F.split("path", "/"), -1).alias("name"))


@register("append_texts", """
select conv_id % 10 as instance_key, string_agg(text, '' order by conv_id, turn) as text from conversations group by conv_id % 10""")
def q_append_texts(spark, root):
    """Two batches of texts, the second one committed twice: it counts once."""
    path = _folder(spark, "batches")
    c = T(spark, root, "conversations").select((F.col("conv_id") % 10).alias("instance_key"), (F.col("conv_id") * 1000 + F.col("turn")).alias("batch_no"),
                                              "text", "turn")
    for batch, rows in (("early", c.filter("turn < 4")), ("late", c.filter("turn >= 4")), ("late", c.filter("turn >= 4"))):
        K.write_texts(rows.drop("turn"), path, batch_col="batch_no", mode="append", batch_id=batch)
    return K.read_texts(spark, path)


@register("write_statement", r"select source as instance_key, doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') as problem_statement from documents")
def q_write_statement(spark, root):
    path = _folder(spark, "statements")
    d = T(spark, root, "documents").select(F.col("source").alias("instance_key"), "doc_id", F.col("text").alias("problem_statement"))
    K.write_statement(d, path)
    return spark.read.schema(d.schema).parquet(path).select(*d.columns)
