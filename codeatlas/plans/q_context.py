"""Context assembly queries: packing, path matching, doc attachment, dedup, pruning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.packing import batch_counts, pack_batches
from .registry import T, register

# Items = events of a user in (ts, event_id) order, size = floor(value), budget 100 (strict).
_PACK_SQL = """
with recursive it as (
  select user_id, event_id, cast(floor(value) as bigint) as sz,
         row_number() over (partition by user_id order by ts, event_id) - 1 as idx
  from events),
r as (
  select user_id, idx, event_id, sz, sz as cur, cast(1 as bigint) as batch_no from it where idx = 0
  union all
  select it.user_id, it.idx, it.event_id, it.sz,
         case when r.cur + it.sz < 100 then r.cur + it.sz else it.sz end,
         case when r.cur + it.sz < 100 then r.batch_no else r.batch_no + 1 end
  from r join it on it.user_id = r.user_id and it.idx = r.idx + 1),
b as (select user_id, batch_no, count(*) as n, max(sz) as mx from r group by user_id, batch_no)
"""


def _packed(spark, root):
    ev = T(spark, root, "events").select("user_id", "event_id", "ts", F.floor("value").cast("long").alias("size"))
    return pack_batches(ev, ["user_id"], ["ts", "event_id"], "size", budget=100)


@register("pack_batches", _PACK_SQL + """
select r.user_id, r.event_id, r.batch_no, (b.n = 1 and b.mx >= 100) as oversize
from r join b on r.user_id = b.user_id and r.batch_no = b.batch_no""")
def q_pack_batches(spark, root):
    return _packed(spark, root).select("user_id", "event_id", F.col("batch_no").cast("long").alias("batch_no"),
                                       "oversize")


_NULL_PACK_SQL = _PACK_SQL.replace("select user_id, event_id, cast(floor(value) as bigint) as sz,\n",
                                   "select nullif(user_id % 7, 0) as user_id, event_id, cast(floor(value) as bigint) as sz,\n") \
    .replace("partition by user_id order", "partition by nullif(user_id % 7, 0) order") \
    .replace("it.user_id = r.user_id", "it.user_id is not distinct from r.user_id")


@register("pack_batches_null", _NULL_PACK_SQL + """
select r.user_id as g, r.event_id, r.batch_no, (b.n = 1 and b.mx >= 100) as oversize
from r join b on r.user_id is not distinct from b.user_id and r.batch_no = b.batch_no""")
def q_pack_batches_null(spark, root):
    """Items without a group are packed as a group of their own."""
    ev = T(spark, root, "events").select(F.expr("nullif(user_id % 7, 0)").alias("g"), "event_id", "ts",
                                         F.floor("value").cast("long").alias("size"))
    return pack_batches(ev, ["g"], ["ts", "event_id"], "size", budget=100).select(
        "g", "event_id", F.col("batch_no").cast("long").alias("batch_no"), "oversize")


@register("batch_counts", _PACK_SQL + """
select user_id, count(distinct batch_no) as n_batches, count(*) as n_items from r group by user_id""")
def q_batch_counts(spark, root):
    return batch_counts(_packed(spark, root), ["user_id"])


# -- path matching, doc attachment, dedup, pruning, element diff ---------------------------------
from ..operators.context import (attach_docs, attach_element_type, attach_instance, distinct_knowledge, docs_for_file,  # noqa: E402
                                 element_diff, file_description, first_doc_wins, match_paths, prune_context)
from ..operators.elements import file_lines  # noqa: E402
from .code_fixture import FILE_UNITS  # noqa: E402
from .synth import snapshot_v1, snapshot_v2  # noqa: E402

_V1_PATHS = """(select case when source like '%3' then source || '/latest' else source end || '/' || lang || '/doc_'
        || doc_id || case lang when 'en' then '.js' when 'de' then '.ts' when 'fr' then '.tsx' else '.css' end as rel_path,
        doc_id from documents)"""


def _v1(spark, root):
    return snapshot_v1(T(spark, root, "documents"))


@register("match_paths", f"""
with n as (select distinct 'doc_' || doc_id || case quality when 1 then '.js' else '.ts' end as needle from labels),
s as (select rel_path, unnest(list_transform(range(1, len(string_split(rel_path, '/')) + 1),
        lambda i: array_to_string(string_split(rel_path, '/')[i:], '/'))) as needle from {_V1_PATHS})
select distinct s.rel_path, s.needle from s join n on s.needle = n.needle""")
def q_match_paths(spark, root):
    lab = T(spark, root, "labels")
    needles = lab.select(F.concat(F.lit("doc_"), F.col("doc_id"), F.when(F.col("quality") == 1, ".js").otherwise(".ts"))
                         .alias("needle"))
    return match_paths(needles, _v1(spark, root).select("rel_path"), [], "needle", "rel_path", mode="suffix")


@register("match_paths_substring", f"""
with n as (select distinct 'doc_' || doc_id as needle from labels)
select distinct f.rel_path, n.needle from {_V1_PATHS} f join n on contains(f.rel_path, n.needle)""")
def q_match_paths_substring(spark, root):
    needles = T(spark, root, "labels").select(F.concat(F.lit("doc_"), F.col("doc_id")).alias("needle"))
    return match_paths(needles, _v1(spark, root).select("rel_path"), [], "needle", "rel_path", mode="substring")


# Element docs and metadata derived from part: each part documents one element of its file.
_META_SQL = f"""(select 'src/mod_' || (p_partkey // {FILE_UNITS}) as rel_path,
     case when p_size % 4 = 1 then 'Part' || p_partkey else 'fn_' || p_partkey end as name,
     case when p_size % 4 = 1 then 'Class' else 'Function' end as type, p_partkey as ordinal from part
     union all select 'src/mod_' || (p_partkey // {FILE_UNITS}), 'make', 'Function', p_partkey from part where p_size % 4 = 1)"""
_DOCS_SQL = f"""(select 'src/mod_' || (p_partkey // {FILE_UNITS}) as rel_path,
     case when p_size % 5 = 0 then 'ghost_' || p_partkey when p_size % 4 = 1 then 'Part' || p_partkey
          else 'fn_' || p_partkey end as name, p_name || ' ' || p_type as doc from part where p_size % 3 <> 1)"""


def _meta(spark, root):
    p = T(spark, root, "part")
    path = F.concat(F.lit("src/mod_"), F.floor(F.col("p_partkey") / FILE_UNITS).cast("string"))
    cls = F.col("p_size") % 4 == 1
    m = p.select(path.alias("rel_path"),
                 F.when(cls, F.concat(F.lit("Part"), F.col("p_partkey"))).otherwise(F.concat(F.lit("fn_"), F.col("p_partkey")))
                 .alias("name"), F.when(cls, "Class").otherwise("Function").alias("type"),
                 F.col("p_partkey").alias("ordinal"))
    make = p.filter(cls).select(path.alias("rel_path"), F.lit("make").alias("name"), F.lit("Function").alias("type"),
                                F.col("p_partkey").alias("ordinal"))
    return m.unionByName(make)


def _docs(spark, root):
    p = T(spark, root, "part").filter(F.col("p_size") % 3 != 1)
    path = F.concat(F.lit("src/mod_"), F.floor(F.col("p_partkey") / FILE_UNITS).cast("string"))
    name = (F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("ghost_"), F.col("p_partkey")))
            .when(F.col("p_size") % 4 == 1, F.concat(F.lit("Part"), F.col("p_partkey")))
            .otherwise(F.concat(F.lit("fn_"), F.col("p_partkey"))))
    return p.select(path.alias("rel_path"), name.alias("name"), F.concat_ws(" ", "p_name", "p_type").alias("doc"))


@register("docs_for_file", f"""
with files as (select distinct 'src/mod_' || (p_partkey // {FILE_UNITS}) as rel_path from part where p_size > 40)
select d.rel_path, d.name, d.doc from {_DOCS_SQL} d join files f on d.rel_path = f.rel_path""")
def q_docs_for_file(spark, root):
    p = T(spark, root, "part").filter(F.col("p_size") > 40)
    files = p.select(F.concat(F.lit("src/mod_"), F.floor(F.col("p_partkey") / FILE_UNITS).cast("string"))
                     .alias("rel_path"))
    return docs_for_file(_docs(spark, root), files, ["rel_path"]).select("rel_path", "name", "doc")


@register("attach_element_type", f"""
with last as (select rel_path, name, arg_max(type, ordinal) as type from {_META_SQL} group by rel_path, name)
select d.rel_path, d.name, coalesce(l.type, '') as type from {_DOCS_SQL} d
left join last l on d.rel_path = l.rel_path and d.name = l.name""")
def q_attach_element_type(spark, root):
    return attach_element_type(_docs(spark, root), _meta(spark, root), ["rel_path", "name"]) \
        .select("rel_path", "name", "type")


@register("attach_docs", f"""
select m.rel_path, m.name, m.ordinal, coalesce(d.doc, 'None') as doc from {_META_SQL} m
left join {_DOCS_SQL} d on d.rel_path = m.rel_path and d.name = m.name""")
def q_attach_docs(spark, root):
    return attach_docs(_meta(spark, root).select("rel_path", "name", "ordinal"), _docs(spark, root),
                       ["rel_path", "name"]).select("rel_path", "name", "ordinal", "doc")


@register("attach_instance", """
select l.l_orderkey, l.l_linenumber, o.o_orderstatus from lineitem l join orders o on l.l_orderkey = o.o_orderkey""")
def q_attach_instance(spark, root):
    li = T(spark, root, "lineitem").select("l_orderkey", "l_linenumber")
    orders = T(spark, root, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    joined, _ = attach_instance(li, orders, ["l_orderkey"])
    return joined


@register("attach_instance_quarantine", """
select l_orderkey, l_linenumber from lineitem where l_orderkey not in (select o_orderkey from orders)""")
def q_attach_instance_quarantine(spark, root):
    li = T(spark, root, "lineitem").select("l_orderkey", "l_linenumber")
    orders = T(spark, root, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    _, quarantine = attach_instance(li, orders, ["l_orderkey"])
    return quarantine


@register("attach_instance_finished", """
select l.l_orderkey, l.l_linenumber, case when o.o_orderkey is null then 'no finished order' else 'found' end as status
from lineitem l left join orders o on l.l_orderkey = o.o_orderkey and o.o_orderstatus = 'F'""")
def q_attach_instance_finished(spark, root):
    """Only finished orders are listed, so both outputs have rows."""
    li = T(spark, root, "lineitem").select("l_orderkey", "l_linenumber")
    listed = T(spark, root, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    joined, quarantine = attach_instance(li, listed, ["l_orderkey"])
    return joined.withColumn("status", F.lit("found")).unionByName(quarantine.withColumn("status", F.lit("no finished order")))


@register("file_description", """
select conv_id, string_agg(rn || '. ' || text || chr(10), '' order by turn) as description
from (select conv_id, turn, text, row_number() over (partition by conv_id order by turn) as rn from conversations)
group by conv_id""")
def q_file_description(spark, root):
    c = T(spark, root, "conversations")
    return file_description(c, ["conv_id"], "turn", "text")


@register("distinct_knowledge", "select text, min(doc_id) as doc_id from documents group by text")
def q_distinct_knowledge(spark, root):
    return distinct_knowledge(T(spark, root, "documents"), ["text"], "doc_id")


@register("first_doc_wins", f"""
select rel_path, name, min(ordinal) as ordinal, arg_min(type, ordinal) as type from {_META_SQL} group by rel_path, name""")
def q_first_doc_wins(spark, root):
    return first_doc_wins(_meta(spark, root), ["rel_path", "name"], "ordinal", ["type"]) \
        .select("rel_path", "name", "ordinal", "type")


# Prune: a document is a file, its lines are its elements (empty signature); lines with "é" are kept.
@register("prune_context", """
with l as (select doc_id, text, unnest(string_split(text, chr(10))) as line,
                  unnest(range(1, len(string_split(text, chr(10))) + 1)) as line_no from documents),
e as (select doc_id, list({'s': '', 't': line} order by line_no) filter (where not contains(line, 'é')) as els
      from l group by doc_id)
select d.doc_id, case when e.els is null or len(e.els) = 0 then d.text
       else list_reduce(e.els, lambda acc, x: case when x.t = '' then acc else replace(acc, x.t, '') end, d.text) end
       as pruned
from documents d left join e on d.doc_id = e.doc_id""")
def q_prune_context(spark, root):
    d = T(spark, root, "documents").select("doc_id", "text")
    els = file_lines(d, ["doc_id"], "text").select(
        "doc_id", F.col("line_no").cast("long").alias("ordinal"), F.lit("").alias("signature"),
        F.col("line").alias("text"), F.col("line").contains("é").alias("keep"))
    return prune_context(d, els, ["doc_id"], "keep", "ordinal", "text")


@register("element_diff", """
with v1 as (select case when source like '%3' then source || '/latest' else source end || '/' || lang || '/doc_'
        || doc_id || case lang when 'en' then '.js' when 'de' then '.ts' when 'fr' then '.tsx' else '.css' end as rel_path,
        doc_id, text as content from documents),
v2 as (select v.rel_path, case when l.quality = 0 then v.content || ' (edited)' else v.content end as content
       from v1 v left join labels l on v.doc_id = l.doc_id where coalesce(l.toxic, 0) = 0
       union all select 'bench/new_' || item_id || '.js', text from benchmark),
o as (select rel_path, 'line_' || unnest(range(1, len(string_split(content, chr(10))) + 1)) as name,
             unnest(string_split(content, chr(10))) as content from v1),
n as (select rel_path, 'line_' || unnest(range(1, len(string_split(content, chr(10))) + 1)) as name,
             unnest(string_split(content, chr(10))) as content from v2)
select coalesce(o.rel_path, n.rel_path) as rel_path, coalesce(o.name, n.name) as name,
       case when o.name is null then 'added' when n.name is null then 'removed' else 'modified' end as change
from o full outer join n on o.rel_path = n.rel_path and o.name = n.name
where o.name is null or n.name is null or o.content <> n.content""")
def q_element_diff(spark, root):
    docs = T(spark, root, "documents")
    v1 = snapshot_v1(docs)
    v2 = snapshot_v2(docs, T(spark, root, "labels"), T(spark, root, "benchmark"))

    def els(v):
        return file_lines(v, ["rel_path"], "content").select(
            "rel_path", F.concat(F.lit("line_"), F.col("line_no")).alias("name"), F.col("line").alias("content"))

    return element_diff(els(v1), els(v2), ["rel_path", "name"])
