"""Keys, path predicates, resume/readiness joins, instance tables, small array helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators.incremental import (load_instances, pending, pending_batched, ready_inputs,
                                     union_splits)
from ..operators.predicates import drop_blocklisted, drop_minified_twins
from .registry import T, register

# -- instance table: dev = orders, test = lineitem; instance key from the order key ------------

_DEV = "select 'shop/orders' as repo, 'shop__orders-' || o_orderkey as instance_id, o_orderstatus as base_commit, " \
       "cast(0 as bigint) as pos from orders"
_TEST = "select 'shop/orders' as repo, 'shop__orders-' || l_orderkey as instance_id, l_linestatus as base_commit, " \
        "cast(l_linenumber as bigint) as pos from lineitem"


def _splits(spark, root):
    dev = T(spark, root, "orders").select(
        F.lit("shop/orders").alias("repo"), F.concat(F.lit("shop__orders-"), F.col("o_orderkey")).alias("instance_id"),
        F.col("o_orderstatus").alias("base_commit"), F.lit(0).cast("long").alias("pos"))
    test = T(spark, root, "lineitem").select(
        F.lit("shop/orders").alias("repo"), F.concat(F.lit("shop__orders-"), F.col("l_orderkey")).alias("instance_id"),
        F.col("l_linestatus").alias("base_commit"), F.col("l_linenumber").cast("long").alias("pos"))
    key = K.instance_key("repo", "instance_id")
    return dev.withColumn("instance_key", key), test.withColumn("instance_key", key)


@register("instances", f"""
with u as (select *, 'dev' as split, 0 as r from ({_DEV}) union all select *, 'test' as split, 1 as r from ({_TEST})),
k as (select repo || '/' || string_split(instance_id, '-')[-1] as instance_key, * from u)
select instance_key, repo, instance_id, base_commit, pos, split from k
qualify row_number() over (partition by instance_key order by r desc, pos desc, base_commit desc) = 1""")
def q_instances(spark, root):
    dev, test = _splits(spark, root)
    return load_instances(dev, test, ["instance_key"], ["pos", "base_commit"]).select(
        "instance_key", "repo", "instance_id", "base_commit", "pos", "split")


@register("union_splits", f"""
select repo || '/' || string_split(instance_id, '-')[-1] as instance_key, split, count(*) as n_rows
from (select *, 'dev' as split from ({_DEV}) union all select *, 'test' as split from ({_TEST}))
group by all""")
def q_union_splits(spark, root):
    dev, test = _splits(spark, root)
    return union_splits(dev, test).groupBy("instance_key", "split").agg(F.count(F.lit(1)).alias("n_rows"))


# -- resume / readiness -----------------------------------------------------------------------

@register("pending", "select doc_id, source from documents where doc_id not in (select doc_id from labels)")
def q_pending(spark, root):
    return pending(T(spark, root, "documents").select("doc_id", "source"), T(spark, root, "labels"), ["doc_id"])


@register("ready_inputs", "select doc_id, lang from documents where doc_id in (select doc_id from labels)")
def q_ready_inputs(spark, root):
    return ready_inputs(T(spark, root, "documents").select("doc_id", "lang"), T(spark, root, "labels"), ["doc_id"])


_DONE = "select doc_id as conv_id, cast(quality as bigint) as turn from labels"


def _done(spark, root):
    return T(spark, root, "labels").select(F.col("doc_id").alias("conv_id"), F.col("quality").cast("long").alias("turn"))


@register("pending_batched", f"""
select conv_id, turn from conversations c
where not exists (select 1 from ({_DONE}) d where d.conv_id = c.conv_id and d.turn = c.turn)""")
def q_pending_batched(spark, root):
    work = T(spark, root, "conversations").select("conv_id", "turn")
    return pending_batched(work, _done(spark, root), ["conv_id"], "turn")


@register("pending_batched_literal", f"""
select conv_id, turn from conversations c
where conv_id not in (select conv_id from ({_DONE}) group by conv_id having count(distinct turn) < 2)""")
def q_pending_batched_literal(spark, root):
    work = T(spark, root, "conversations").select("conv_id", "turn")
    return pending_batched(work, _done(spark, root), ["conv_id"], "turn", literal=True)


# -- file-name predicates over file names derived from `part` --------------------------------

_PART_FILES_SQL = """
select p_brand as instance_key,
       case p_size % 5 when 0 then 'src/tests/' when 1 then 'src/latest/' else 'src/' end
       || lower(p_type) || '/' || replace(p_name, ' ', '_')
       || case p_size % 7 when 0 then '.js' when 1 then '.min.js' when 2 then '.ts' when 3 then '.JSX'
                          when 4 then '.tsx' when 5 then '.css' else '.jsx' end as rel_path
from part"""


def part_files(spark, root):
    p = T(spark, root, "part")
    folder = (F.when(F.col("p_size") % 5 == 0, "src/tests/").when(F.col("p_size") % 5 == 1, "src/latest/")
              .otherwise("src/"))
    ext = F.element_at(F.array(*[F.lit(e) for e in (".js", ".min.js", ".ts", ".JSX", ".tsx", ".css", ".jsx")]),
                       (F.col("p_size") % 7 + 1).cast("int"))
    return p.select(F.col("p_brand").alias("instance_key"),
                    F.concat(folder, F.lower("p_type"), F.lit("/"), F.regexp_replace("p_name", " ", "_"), ext)
                    .alias("rel_path"))


@register("supported_ext", f"""
select distinct instance_key, rel_path,
       lower(regexp_extract(rel_path, '\\.[^./]*$', 0)) in ('.js', '.jsx', '.ts', '.tsx') as supported,
       regexp_extract(rel_path, '\\.[^./]*$', 0) in ('.js', '.jsx', '.ts', '.tsx') as supported_cs
from ({_PART_FILES_SQL})""")
def q_supported_ext(spark, root):
    f = part_files(spark, root).distinct()
    return f.select("instance_key", "rel_path", K.is_supported_ext("rel_path").alias("supported"),
                    K.is_supported_ext("rel_path", case_sensitive=True).alias("supported_cs"))


@register("minified_twins", f"""
with f as (select distinct * from ({_PART_FILES_SQL}))
select instance_key, rel_path from f
where not (rel_path like '%.min.js' and exists (
  select 1 from f g where g.instance_key = f.instance_key and g.rel_path = regexp_replace(f.rel_path, '\\.min\\.js$', '.js')))""")
def q_minified_twins(spark, root):
    return drop_minified_twins(part_files(spark, root).distinct(), ["instance_key"])


@register("test_paths", f"""
select distinct rel_path, contains(rel_path, 'test') as is_test,
       list_contains(string_split(rel_path, '/')[1:-2], 'tests') or list_contains(string_split(rel_path, '/')[1:-2], 'test')
       or list_contains(string_split(rel_path, '/')[1:-2], '__tests__') as is_test_strict
from ({_PART_FILES_SQL})""")
def q_test_paths(spark, root):
    f = part_files(spark, root).select("rel_path").distinct()
    return f.select("rel_path", K.is_test_path("rel_path").alias("is_test"),
                    K.is_test_path("rel_path", strict=True).alias("is_test_strict"))


@register("blocklisted", f"""
select distinct instance_key, rel_path from ({_PART_FILES_SQL})
where instance_key not in ('Brand#1', 'Brand#13')
  and not contains(rel_path, 'mermaid.min.js') and not contains(rel_path, 'video.min.js')""")
def q_blocklisted(spark, root):
    blocked = spark.createDataFrame([("Brand#1",), ("Brand#13",)], "instance_key string")
    return drop_blocklisted(part_files(spark, root).distinct(), blocked, ["instance_key"], "rel_path")


# -- path / URL projections ------------------------------------------------------------------

@register("basename_rel_path", """
select page_id, string_split(url, '/')[-1] as base,
       array_to_string(string_split(replace(url, '\\', '/'), '/')[4:], '/') as rel
from pages""")
def q_basename_rel_path(spark, root):
    p = T(spark, root, "pages")
    return p.select("page_id", K.basename("url").alias("base"), K.rel_path("url", drop=3).alias("rel"))


# Needles per document (its own "asset" strings): its first word and the letter "é".
@register("strip_image_lines", """
select doc_id, array_to_string(list_filter(string_split(text, chr(10)),
         lambda l: not (contains(l, string_split(text, ' ')[1]) or contains(l, 'é'))), chr(10)) as statement
from documents""")
def q_strip_image_lines(spark, root):
    d = T(spark, root, "documents")
    needles = F.array(F.substring_index("text", " ", 1), F.lit("é"))   # cheap inside the per-line lambda
    return d.select("doc_id", K.strip_lines_containing("text", needles).alias("statement"))


@register("element_type", """
select p_partkey, node_key, case when contains(node_key, 'class') then 'Class' else 'Function' end as element_type
from (select p_partkey, case p_size % 3 when 0 then 'class_' when 1 then 'function_' else 'type_' end
             || p_partkey as node_key from part)""")
def q_element_type(spark, root):
    p = T(spark, root, "part")
    kind = F.when(F.col("p_size") % 3 == 0, "class_").when(F.col("p_size") % 3 == 1, "function_").otherwise("type_")
    return p.select("p_partkey", F.concat(kind, F.col("p_partkey")).alias("node_key")) \
        .select("p_partkey", "node_key", K.element_type("node_key").alias("element_type"))


@register("doc_keys", f"""
with f as (select distinct rel_path from ({_PART_FILES_SQL})),
k as (select rel_path, translate(rel_path, '/', '_') || '_fn_' || length(rel_path) as flat from f)
select rel_path, flat,
       translate(regexp_extract(flat, '^(.*?\\.(?:jsx|js|tsx|ts))(?:_(.*))?$', 1), '_', '/') as path_back,
       regexp_extract(flat, '^(.*?\\.(?:jsx|js|tsx|ts))(?:_(.*))?$', 2) as element
from k""")
def q_doc_keys(spark, root):
    f = part_files(spark, root).select("rel_path").distinct()
    k = f.withColumn("flat", K.flat_doc_key("rel_path", F.concat(F.lit("fn_"), F.char_length("rel_path"))))
    back, elem = K.parse_doc_key("flat")
    return k.select("rel_path", "flat", back.alias("path_back"), elem.alias("element"))


@register("move_first", """
select item_id, array_to_string(case when list_position(w, 'the') > 0
    then list_concat(['the'], list_filter(w, lambda x, i: i != list_position(w, 'the'))) else w end, ' ') as moved
from (select item_id, string_split(text, ' ') as w from benchmark)""")
def q_move_first(spark, root):
    b = T(spark, root, "benchmark")
    return b.select("item_id", F.array_join(K.move_first(F.split("text", " "), F.lit("the")), " ").alias("moved"))


@register("mean_abs_diff", """
select a.vec_id, round(list_sum(list_transform(list_zip(cast(a.embedding as double[]), cast(b.embedding as double[])),
                                              lambda p: abs(p[1] - p[2]))) / len(a.embedding), 6) as mad
from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""")
def q_mean_abs_diff(spark, root):
    e = T(spark, root, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("nxt"))
    return e.join(b, "vec_id").select("vec_id", F.round(K.mean_abs_diff("embedding", "nxt"), 6).alias("mad"))
