"""Code catalog queries over the generated source files (see code_fixture)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.elements import (class_members, code_elements, definitions, drop_overlaps, element_ordinals,
                                  file_lines)
from . import jobs
from .code_fixture import FILE_LINES_SQL, SHAPE_LINES, UNITS_SQL, shape_files, source_files
from .registry import T, register

KEY = ["instance_key", "rel_path"]

_E_SQL = f"""
with u as (select * from {UNITS_SQL}),
e0 as (
  select instance_key, rel_path, 'function' as kind, 'function' as decl, 'fn_' || pk as name,
         fun_before + 1 as ordinal, cast(null as bigint) as parent_ordinal, u0 + 1 + c as start_line,
         u0 + 3 + c + r as end_line, r = 1 as has_return,
         case when c = 1 then '// ' || p_name else '' end as signature, 'a,b' as params from u where kind = 0
  union all
  select instance_key, rel_path, 'class', 'class', 'Part' || pk, cls_before + 1, null, u0, u0 + 5, false, '', ''
  from u where kind = 1
  union all
  select instance_key, rel_path, 'function', 'method', 'get_' || pk, null, cls_before + 1, u0 + 1, u0 + 3, true, '', 'x'
  from u where kind = 1
  union all
  select instance_key, rel_path, 'function', 'method', 'make', null, cls_before + 1, u0 + 4, u0 + 4, true, '', ''
  from u where kind = 1
  union all
  select instance_key, rel_path, 'function', 'arrow', 'function_' || (fun_before + 1), fun_before + 1, null,
         u0 + 1 + 3 * c, u0 + 4 + 3 * c, true,
         case when c = 1 then '/* arrow ' || p_name || chr(10) || '* helper */' else '' end, 'a' from u where kind = 2
  union all
  select instance_key, rel_path, 'function', 'arrow', 'function_' || (fun_before + 2), fun_before + 2, null,
         u0 + 2 + 3 * c, u0 + 2 + 3 * c, false, '', 'y' from u where kind = 2
  union all
  select instance_key, rel_path, 'type', 'interface', 'Shape' || pk, cls_before + 1, null, u0, u0 + 2, false, '', ''
  from u where kind = 3
  union all
  select instance_key, rel_path, 'function', 'arrow', 'function_' || (fun_before + 1), fun_before + 1, null,
         u0 + 3, u0 + 3, false, '', 'z' from u where kind = 3),
e as (
  select e0.instance_key, e0.rel_path, kind, decl, name, cast(ordinal as bigint) as ordinal,
         cast(parent_ordinal as bigint) as parent_ordinal,
         case when parent_ordinal is null then kind || '_' || ordinal end as node_key,
         cast(start_line as bigint) as start_line, cast(end_line as bigint) as end_line, has_return, signature,
         case when e0.rel_path like '%.ts' then '' else params end as parameters,
         array_to_string(f.fl[start_line:end_line], chr(10)) as content
  from e0 join {FILE_LINES_SQL} f on e0.instance_key = f.instance_key and e0.rel_path = f.rel_path)
"""


def _files(spark, root):
    # Materialised once: the generated files feed several branches of every code query.
    return source_files(T(spark, root, "part")).checkpoint()


def _elements(spark, root):
    return code_elements(_files(spark, root), KEY)


def _out(el):
    return el.select(*KEY, "kind", "decl", "name", "ordinal", F.col("parent_ordinal").cast("long").alias("parent_ordinal"),
                     "node_key", F.col("start_line").cast("long").alias("start_line"),
                     F.col("end_line").cast("long").alias("end_line"), "has_return", "signature",
                     F.array_join("parameters", ",").alias("parameters"), "content")


@register("code_elements", _E_SQL + "select * from e")
def q_code_elements(spark, root):
    return _out(_elements(spark, root))


@register("class_members", _E_SQL + """
select m.instance_key, m.rel_path, c.name as class_name, m.name as member, m.start_line
from e m join e c on m.instance_key = c.instance_key and m.rel_path = c.rel_path and c.kind = 'class'
 and c.ordinal = m.parent_ordinal where m.parent_ordinal is not null""")
def q_class_members(spark, root):
    return class_members(_out(_elements(spark, root)), KEY)


@register("leading_comments", _E_SQL + "select rel_path, start_line, signature from e where signature <> ''")
def q_leading_comments(spark, root):
    el = _out(_elements(spark, root))
    return el.filter(F.col("signature") != "").select("rel_path", "start_line", "signature")


@register("has_return", _E_SQL + "select rel_path, start_line, name, has_return from e")
def q_has_return(spark, root):
    return _out(_elements(spark, root)).select("rel_path", "start_line", "name", "has_return")


@register("drop_overlaps", _E_SQL.replace("with u as", "with recursive u as", 1) + """,
f as (select rel_path, name, start_line, end_line,
             row_number() over (partition by rel_path order by start_line, end_line desc) as i
      from e where kind = 'function' and parent_ordinal is null),
r as (select rel_path, i, name, start_line, end_line, true as kept, end_line as last_end from f where i = 1
      union all
      select f.rel_path, f.i, f.name, f.start_line, f.end_line, f.start_line > r.last_end,
             case when f.start_line > r.last_end then f.end_line else r.last_end end
      from r join f on f.rel_path = r.rel_path and f.i = r.i + 1)
select rel_path, kind, name, start_line from e where not (kind = 'function' and parent_ordinal is null)
union all select rel_path, 'function', name, start_line from r where kept""")
def q_drop_overlaps(spark, root):
    el = _elements(spark, root)
    return drop_overlaps(el, KEY).select("rel_path", "kind", "name", F.col("start_line").cast("long").alias("start_line"))


@register("element_ordinals", _E_SQL + """
select rel_path, node_key, name, start_line, row_number() over (partition by rel_path, kind order by start_line) as kind_ordinal
from e where node_key is not null""")
def q_element_ordinals(spark, root):
    el = _elements(spark, root).filter(F.col("node_key").isNotNull())
    return element_ordinals(el, KEY).select("rel_path", "node_key", "name", F.col("start_line").cast("long").alias("start_line"),
                                            "kind_ordinal")


@register("definitions", _E_SQL + """
select rel_path, name, max(start_line) as start_line, arg_max(end_line, start_line) as end_line
from e where decl in ('function', 'class', 'method') group by rel_path, name""")
def q_definitions(spark, root):
    d = definitions(_elements(spark, root), KEY)
    return d.select("rel_path", "name", F.col("start_line").cast("long").alias("start_line"),
                    F.col("end_line").cast("long").alias("end_line"))


@register("lines", """
select doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line_no, unnest(string_split(text, chr(10))) as line
from documents""")
def q_lines(spark, root):
    d = T(spark, root, "documents")
    return file_lines(d, ["doc_id"], "text").select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line")


@register("code_elements_shapes", """
with s as (select 'repo' || p_partkey % 7 as instance_key, 'src/shape_' || p_partkey || '.js' as rel_path, p_partkey as pk from part),
e as (select *, unnest([
  {'kind': 'function', 'name': 'function_1', 'node_key': 'function_1', 'a': 2, 'b': 2, 'ret': false, 'params': 't', 'up': null},
  {'kind': 'function', 'name': 'live' || pk, 'node_key': 'function_2', 'a': 7, 'b': 7, 'ret': true, 'params': 's', 'up': null},
  {'kind': 'function', 'name': 'two' || pk, 'node_key': 'function_3', 'a': 7, 'b': 7, 'ret': false, 'params': 'c', 'up': null},
  {'kind': 'function', 'name': 'function_4', 'node_key': 'function_4', 'a': 8, 'b': 13, 'ret': true, 'params': 'u,v', 'up': null},
  {'kind': 'class', 'name': 'Box' || pk, 'node_key': 'class_1', 'a': 14, 'b': 14, 'ret': false, 'params': '', 'up': null},
  {'kind': 'function', 'name': 'm', 'node_key': null, 'a': 14, 'b': 14, 'ret': true, 'params': 'q', 'up': 1},
  {'kind': 'function', 'name': 'n', 'node_key': null, 'a': 14, 'b': 14, 'ret': false, 'params': '', 'up': 1}]) as x from s)
select instance_key, rel_path, x.kind as kind, x.name as name, x.node_key as node_key, x.a::bigint as start_line, x.b::bigint as end_line,
       x.ret as has_return, x.params as parameters, x.up::bigint as parent_ordinal from e""")
def q_code_elements_shapes(spark, root):
    el = _out(code_elements(shape_files(T(spark, root, "part")), KEY))
    return el.select(*KEY, "kind", "name", "node_key", "start_line", "end_line", "has_return", "parameters", "parent_ordinal")


@register("job_code_quarantine", f"""
select 'repo' || p_partkey % 7 as instance_key, 'src/shape_' || p_partkey || '.js' as rel_path,
       case when p_partkey % 11 = 0 then 'no content'
            else ['unclosed brace', 'unbalanced brace', 'open comment', 'open template'][p_partkey % 5] || ' in line {SHAPE_LINES + 1}' end as problem,
       0::bigint as n_elements
from part where p_partkey % 5 <> 0 or p_partkey % 11 = 0
union all
select 'repo' || p_partkey % 7, 'src/shape_' || p_partkey || '.js', null, 7 from part where p_partkey % 5 = 0 and p_partkey % 11 <> 0""")
def q_code_quarantine(spark, root):
    """Every file lies on one side: rejected with a reason, or with its elements."""
    elements, rejected = jobs.catalog_and_quarantine(shape_files(T(spark, root, "part"), broken=True), overlaps=True)
    counts = elements.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_elements"))
    return rejected.select(*KEY, "problem", F.lit(0).cast("long").alias("n_elements")).unionByName(
        counts.select(*KEY, F.lit(None).cast("string").alias("problem"), "n_elements"))
