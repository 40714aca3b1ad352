"""Import graph, call resolution, reference context and documentation scheduling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.elements import code_elements, drop_overlaps
from ..operators.graph import (callables, callee_refs, doc_waves, docs_ready, element_calls, graph_nodes,
                               import_edges, import_specs, imports_by_file, internal_imports, reference_context, resolve_import)
from .code_fixture import UNITS_SQL, source_files
from .q_elements import _E_SQL
from .registry import T, register

KEY = ["instance_key", "rel_path"]
INST = ["instance_key"]

_SPECS_SQL = f"""
with u as (select * from {UNITS_SQL}),
files as (select distinct instance_key, rel_path, file_no,
                 case when file_no % 3 = 0 then '.ts' else '.js' end as ext from u),
specs as (
  select instance_key, rel_path, ext, 0 as pos, 'react' as spec, 'react' || ext as dst from files
  union all select instance_key, rel_path, ext, 1, './mod_' || file_no || '.css', null from files
  union all
  select instance_key, rel_path, case when file_no % 3 = 0 then '.ts' else '.js' end,
         1 + row_number() over (partition by rel_path order by pk),
         case when kind = 0 then './mod_' || (q // 40) || case when (q // 40) % 3 = 0 then '.ts' else '.js' end
              else '../lib/util_' || (pk % 5) end,
         case when kind = 0 then 'src/mod_' || (q // 40) || case when (q // 40) % 3 = 0 then '.ts' else '.js' end
              else 'lib/util_' || (pk % 5) || case when file_no % 3 = 0 then '.ts' else '.js' end end
  from u where kind in (0, 2)),
edges as (select instance_key, rel_path as src_path, dst as dst_path, min(pos) as pos from specs
          where dst is not null group by all),
internal as (select * from edges e where exists (select 1 from files f where f.instance_key = e.instance_key
                                                 and f.rel_path = e.dst_path))
"""


def _files(spark, root):
    # Materialised once: the generated files feed several branches of every code query.
    return source_files(T(spark, root, "part")).checkpoint()


def _edges(spark, root, files=None):
    return import_edges(files if files is not None else _files(spark, root), KEY)


@register("import_specs", _SPECS_SQL + "select rel_path, cast(pos as bigint) as pos, spec from specs")
def q_import_specs(spark, root):
    return import_specs(_files(spark, root), KEY).select("rel_path", F.col("pos").cast("long").alias("pos"), "spec")


@register("resolve_import", _SPECS_SQL + "select rel_path, spec, dst from specs")
def q_resolve_import(spark, root):
    s = import_specs(_files(spark, root), KEY)
    return s.select("rel_path", "spec", resolve_import(F.col("rel_path"), F.col("spec")).alias("dst"))


@register("import_edges", _SPECS_SQL + "select instance_key, src_path, dst_path, cast(pos as bigint) as pos from edges")
def q_import_edges(spark, root):
    return _edges(spark, root).select(*INST, "src_path", "dst_path", F.col("pos").cast("long").alias("pos"))


@register("graph_nodes", _SPECS_SQL + """
select instance_key, rel_path as node, 'file' as type from files
union all
select distinct instance_key, dst_path, cast(null as varchar) from edges e
where not exists (select 1 from files f where f.instance_key = e.instance_key and f.rel_path = e.dst_path)""")
def q_graph_nodes(spark, root):
    files = _files(spark, root)
    return graph_nodes(files, _edges(spark, root, files), INST)


@register("internal_imports", _SPECS_SQL + "select instance_key, src_path, dst_path from internal")
def q_internal_imports(spark, root):
    files = _files(spark, root)
    return internal_imports(_edges(spark, root, files), files, INST).select(*INST, "src_path", "dst_path")


@register("imports_by_file", _SPECS_SQL + """
select instance_key, src_path, count(*) as n_imports, string_agg(dst_path, ',' order by pos) as targets
from internal group by instance_key, src_path""")
def q_imports_by_file(spark, root):
    files = _files(spark, root)
    return imports_by_file(internal_imports(_edges(spark, root, files), files, INST), INST)


# -- calls and callee resolution ------------------------------------------------------------
_CALLS_SQL = f"""
calls as (
  select instance_key, rel_path, u0 + 1 + c as start_line, 0 as pos, 'fn_' || q as call_name from u where kind = 0
  union all select instance_key, rel_path, u0, 0, 'fn_' || q from u where kind = 1
  union all select instance_key, rel_path, u0 + 1 + 3 * c, 0, 'util' from u where kind = 2),
offered as (select instance_key, rel_path, name as callee, start_line as callee_line from ({_E_SQL} select * from e) x
            where (node_key is not null and kind <> 'class') or parent_ordinal is not null),
refs as (
  select c.instance_key, c.rel_path as src_path, c.start_line, c.pos, i.dst_path, c.call_name, o.callee_line
  from calls c join internal i on c.instance_key = i.instance_key and c.rel_path = i.src_path
  join offered o on o.instance_key = i.instance_key and o.rel_path = i.dst_path and o.callee = c.call_name)
"""


def _elements(spark, root, files=None):
    return code_elements(files if files is not None else _files(spark, root), KEY)


@register("call_names", _SPECS_SQL + "," + _CALLS_SQL + """
select rel_path, cast(start_line as bigint) as start_line, cast(pos as bigint) as pos, call_name from calls""")
def q_call_names(spark, root):
    c = element_calls(_elements(spark, root).filter(F.col("node_key").isNotNull()), KEY)
    return c.select("rel_path", F.col("start_line").cast("long").alias("start_line"),
                    F.col("pos").cast("long").alias("pos"), "call_name")


def _refs(spark, root):
    files = _files(spark, root)
    el = _elements(spark, root, files).checkpoint()
    calls = element_calls(el.filter(F.col("node_key").isNotNull()), KEY)   # a method's calls are its class's
    edges = internal_imports(_edges(spark, root, files), files, INST)
    offered = callables(drop_overlaps(el.drop("content", "signature"), KEY), KEY)
    return callee_refs(calls, edges, offered, INST), el


@register("callee_refs", _SPECS_SQL + "," + _CALLS_SQL + """
select instance_key, src_path, cast(start_line as bigint) as start_line, cast(pos as bigint) as pos, dst_path,
       call_name, cast(callee_line as bigint) as callee_line from refs""")
def q_callee_refs(spark, root):
    r, _ = _refs(spark, root)
    return r.select(*INST, "src_path", F.col("start_line").cast("long").alias("start_line"),
                    F.col("pos").cast("long").alias("pos"), "dst_path", "call_name",
                    F.col("callee_line").cast("long").alias("callee_line"))


# Reference context: callee path, doc ("None" when the callee has no doc; docs exist for elements
# that return a value), signature and code of every resolved callee, in reference order.
@register("reference_context", _SPECS_SQL + "," + _CALLS_SQL + f""",
el as ({_E_SQL} select * from e)
select r.instance_key, r.src_path, cast(r.start_line as bigint) as start_line, count(*) as n_refs,
       string_agg(r.dst_path || chr(10) || case when el.has_return then 'Doc of ' || el.name else 'None' end
                  || chr(10) || el.signature || chr(10) || el.content || chr(10), ''
                  order by r.pos, r.dst_path, r.callee_line) as context
from refs r join el on el.instance_key = r.instance_key and el.rel_path = r.dst_path and el.start_line = r.callee_line
group by r.instance_key, r.src_path, r.start_line""")
def q_reference_context(spark, root):
    r, el = _refs(spark, root)
    r = r.checkpoint()
    docs = el.filter(F.col("has_return")).select(*KEY, "start_line", F.concat(F.lit("Doc of "), F.col("name")).alias("doc"))
    return reference_context(r, el, docs, INST).withColumn("start_line", F.col("start_line").cast("long"))


# -- documentation scheduling over the part tree ---------------------------------------------
# refs: every key k >= 1 calls k div 2; keys of size 1 are also called back by k div 2 (cycles);
# keys of size 2 also call a key that does not exist (missing targets).
_WAVES_SQL = """
with recursive nodes as (select p_partkey as id from part),
refs as (select p_partkey as src, p_partkey // 2 as dst from part where p_partkey >= 1
         union select p_partkey // 2, p_partkey from part where p_size = 1 and p_partkey >= 1
         union select p_partkey, p_partkey + 100000000 from part where p_size = 2),
reach(src, dst) as (select src, dst from refs union select r.src, f.dst from reach r join refs f on r.dst = f.src),
bad as (select src as id from reach where src = dst
        union select src from refs where dst not in (select id from nodes)),
forced as (select id from bad union select r.src from reach r join bad b on r.dst = b.id),
ok_refs as (select * from refs where src not in (select id from forced)),
depth(id, d) as (select id, 0 from nodes where id not in (select src from refs)
                 union select r.src, d.d + 1 from ok_refs r join depth d on r.dst = d.id)
"""


def _tree(spark, root):
    p = T(spark, root, "part")
    nodes = p.select(F.col("p_partkey").alias("id"))
    up = p.filter(F.col("p_partkey") >= 1).select(F.col("p_partkey").alias("src_id"),
                                                  F.floor(F.col("p_partkey") / 2).cast("long").alias("dst_id"))
    back = p.filter((F.col("p_size") == 1) & (F.col("p_partkey") >= 1)).select(
        F.floor(F.col("p_partkey") / 2).cast("long").alias("src_id"), F.col("p_partkey").alias("dst_id"))
    missing = p.filter(F.col("p_size") == 2).select(F.col("p_partkey").alias("src_id"),
                                                    (F.col("p_partkey") + 100000000).alias("dst_id"))
    return nodes, up.unionByName(back).unionByName(missing).distinct()


@register("doc_waves", _WAVES_SQL + """
select id, cast(max(d) as bigint) as level, false as forced from depth group by id
union all select id, cast(null as bigint), true from forced where id in (select id from nodes)""")
def q_doc_waves(spark, root):
    nodes, refs = _tree(spark, root)
    w = doc_waves(nodes, refs, ["id"])
    return w.select("id", F.col("level").cast("long").alias("level"), "forced")


_CARRIED_SQL = _WAVES_SQL.replace("nodes as (select p_partkey as id from part),",
                                  "nodes as (select p_partkey as id from part where p_size <= 40),") \
    .replace("refs as (select p_partkey as src", "every as (select p_partkey as src") \
    .replace("reach(src, dst)", """refs as (select * from every where src in (select id from nodes)
         and dst not in (select p_partkey from part where p_size > 40)),
reach(src, dst)""")


@register("doc_waves_carried", _CARRIED_SQL + """
select id, cast(max(d) as bigint) as level, false as forced from depth group by id
union all select id, cast(null as bigint), true from forced where id in (select id from nodes)""")
def q_doc_waves_carried(spark, root):
    """Parts above size 40 play elements whose docs were carried over from the snapshot before."""
    _, refs = _tree(spark, root)
    part = T(spark, root, "part").select(F.col("p_partkey").alias("id"), "p_size")
    w = doc_waves(part.filter("p_size <= 40"), refs, ["id"], part.filter("p_size > 40").select("id"))
    return w.select("id", F.col("level").cast("long").alias("level"), "forced")


@register("docs_ready", """
with refs as (select p_partkey as src, p_partkey // 2 as dst from part where p_partkey >= 1
              union select p_partkey // 2, p_partkey from part where p_size = 1 and p_partkey >= 1
              union select p_partkey, p_partkey + 100000000 from part where p_size = 2),
documented as (select p_partkey as id from part where p_size > 25)
select p_partkey as id from part
where p_partkey not in (select id from documented)
  and not exists (select 1 from refs r where r.src = p_partkey and r.dst not in (select id from documented))""")
def q_docs_ready(spark, root):
    nodes, refs = _tree(spark, root)
    documented = T(spark, root, "part").filter(F.col("p_size") > 25).select(F.col("p_partkey").alias("id"))
    return docs_ready(nodes, refs, documented, ["id"])
