"""Snapshot queries: trees, diffs, carry-forward, regeneration sets, versions, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keys import is_supported_ext, is_test_path
from ..operators.incremental import list_versions, version_pairs
from ..operators.ordered import row_index
from ..operators.snapshots import carry_forward, scan_tree, snapshot_diff, to_regenerate
from .registry import T, register
from .synth import snapshot_v1, snapshot_v2

_V1 = """(select doc_id, case when source like '%3' then source || '/latest' else source end || '/' || lang || '/doc_'
        || doc_id || case lang when 'en' then '.js' when 'de' then '.ts' when 'fr' then '.tsx' else '.css' end as rel_path,
        text as content from documents)"""
_V2 = f"""(select v.rel_path, case when l.quality = 0 then v.content || ' (edited)' else v.content end as content
        from {_V1} v left join labels l on v.doc_id = l.doc_id where coalesce(l.toxic, 0) = 0
        union all select 'bench/new_' || item_id || '.js', text from benchmark)"""
_SUP = "lower(regexp_extract(rel_path, '\\.[^./]*$', 0)) in ('.js', '.jsx', '.ts', '.tsx')"


def _folders_sql(src):
    return f"""(select distinct unnest(list_transform(range(1, len(string_split(rel_path, '/'))),
                 lambda i: array_to_string(string_split(rel_path, '/')[1:i], '/'))) as folder from {src})"""


_DIFF_SQL = f"""
with o as (select rel_path as path, content from {_V1} where {_SUP}),
     n as (select rel_path as path, content from {_V2} where {_SUP}),
files as (
  select 'file' as level,
         case when o.path is null then 'added' when n.path is null then 'removed'
              when o.content <> n.content then 'modified' end as change,
         coalesce(o.path, n.path) as path
  from o full outer join n on o.path = n.path),
fo as {_folders_sql(_V1)}, fn as {_folders_sql(_V2)},
dirs as (
  select 'folder' as level, case when fo.folder is null then 'added' when fn.folder is null then 'removed' end as change,
         coalesce(fo.folder, fn.folder) as path
  from fo full outer join fn on fo.folder = fn.folder),
diff as (select * from files where change is not null union all select * from dirs where change is not null)
"""


def _snapshots(spark, root):
    docs = T(spark, root, "documents")
    return snapshot_v1(docs), snapshot_v2(docs, T(spark, root, "labels"), T(spark, root, "benchmark"))


def _diff(spark, root):
    v1, v2 = _snapshots(spark, root)
    return snapshot_diff(v1, v2)


@register("snapshot_diff", _DIFF_SQL + "select level, change, path from diff")
def q_snapshot_diff(spark, root):
    return _diff(spark, root)


@register("sorted_lists", _DIFF_SQL + """
select level, change, path, row_number() over (partition by level, change order by path) - 1 as pos from diff""")
def q_sorted_lists(spark, root):
    return row_index(_diff(spark, root), ["level", "change"], ["path"], "pos")


@register("scan_tree", f"""
select distinct 'file' as kind, rel_path as path from {_V1}
union all select 'folder', folder from {_folders_sql(_V1)}""")
def q_scan_tree(spark, root):
    v1, _ = _snapshots(spark, root)
    return scan_tree(v1, [])


_OLD_DOCS = f"""(select rel_path, content as doc from {_V1}
                where {_SUP} and not contains(rel_path, 'test'))"""
_CHANGED = "(select path from diff where level = 'file' and change in ('removed', 'modified'))"
_REGEN = f"""(select rel_path, content as doc from {_V2}
             where {_SUP} and not contains(rel_path, 'test')
               and rel_path in (select path from diff where level = 'file' and change in ('added', 'modified')))"""


def _old_docs(spark, root):
    v1, _ = _snapshots(spark, root)
    return v1.filter(is_supported_ext("rel_path")).select("rel_path", F.col("content").alias("doc"))


def _carried(spark, root, literal=False):
    return carry_forward(_old_docs(spark, root), _diff(spark, root), {"instance_key": "v2"},
                         literal_substring=literal).select("instance_key", "rel_path", "doc")


@register("carry_forward", _DIFF_SQL + f"""
select 'v2' as instance_key, rel_path, doc from {_OLD_DOCS} where rel_path not in {_CHANGED}""")
def q_carry_forward(spark, root):
    return _carried(spark, root)


@register("carry_forward_literal", _DIFF_SQL + f"""
select 'v2' as instance_key, rel_path, doc from {_OLD_DOCS} d
where not exists (select 1 from {_CHANGED} c where contains(d.rel_path, c.path))""")
def q_carry_forward_literal(spark, root):
    return _carried(spark, root, literal=True)


def _regen(spark, root):
    _, v2 = _snapshots(spark, root)
    items = v2.filter(is_supported_ext("rel_path") & ~is_test_path("rel_path")) \
        .select("rel_path", F.col("content").alias("doc"))
    return to_regenerate(items, _diff(spark, root))


@register("to_regenerate", _DIFF_SQL + f"select rel_path from {_REGEN}")
def q_to_regenerate(spark, root):
    return _regen(spark, root).select("rel_path")


@register("merged_docs", _DIFF_SQL + f"""
select rel_path, doc, 'carried' as origin from {_OLD_DOCS} where rel_path not in {_CHANGED}
union all select rel_path, doc, 'regenerated' from {_REGEN}""")
def q_merged_docs(spark, root):
    carried = _carried(spark, root).select("rel_path", "doc", F.lit("carried").alias("origin"))
    regen = _regen(spark, root).select("rel_path", "doc", F.lit("regenerated").alias("origin"))
    return carried.unionByName(regen)


@register("set_difference", """
select 'only_documents' as side, doc_id from (select doc_id from documents except select doc_id from labels)
union all select 'only_labels', doc_id from (select doc_id from labels except select doc_id from documents)""")
def q_set_difference(spark, root):
    d = T(spark, root, "documents").select("doc_id")
    lab = T(spark, root, "labels").select("doc_id")
    return (d.exceptAll(lab).distinct().select(F.lit("only_documents").alias("side"), "doc_id")
            .unionByName(lab.exceptAll(d).distinct().select(F.lit("only_labels").alias("side"), "doc_id")))


@register("set_common", "select doc_id from documents intersect select doc_id from labels")
def q_set_common(spark, root):
    return T(spark, root, "documents").select("doc_id").intersect(T(spark, root, "labels").select("doc_id"))


@register("version_pairs", """
with v as (select distinct o_custkey as repo, o_orderkey as new_id from orders),
r as (select repo, new_id, row_number() over (partition by repo order by new_id) - 1 as version_no,
             lag(new_id) over (partition by repo order by new_id) as old_id from v)
select repo, old_id, new_id, version_no,
       case when old_id is not null then cast(repo as varchar) || ': ' || old_id || ' -> ' || new_id end as label
from r""")
def q_version_pairs(spark, root):
    o = T(spark, root, "orders").select(F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("number"))
    return version_pairs(o, ["repo"], "number")


@register("list_versions", """
with v as (select distinct 'cust/' || o_custkey as repo, o_orderkey as number from orders)
select repo, number, row_number() over (partition by repo order by number) - 1 as version_no from v""")
def q_list_versions(spark, root):
    o = T(spark, root, "orders")
    paths = o.select(F.concat(F.lit("cust/"), F.col("o_custkey"), F.lit("/"), F.col("o_orderkey"),
                              F.lit("/main.js")).alias("path"))
    return list_versions(paths, "path")


# -- every consecutive version pair of every repository, diffed in one job -------------------------
from ..operators.snapshots import snapshot_pairs  # noqa: E402
from .synth import snapshot_versions  # noqa: E402

_VERSIONS_SQL = f"""
v1 as (select regexp_extract(rel_path, '^(src\\d+)', 1) as repo, 1 as number, rel_path, content from {_V1}),
v2 as (select case when regexp_extract(rel_path, '^(src\\d+)', 1) = '' then 'bench'
                   else regexp_extract(rel_path, '^(src\\d+)', 1) end as repo, 2 as number, rel_path, content from {_V2}),
q1 as (select v.rel_path from {_V1} v join labels l on v.doc_id = l.doc_id where l.quality = 1),
v3 as (select repo, 3 as number, rel_path,
              case when rel_path in (select rel_path from q1) then content || ' (v3)' else content end as content from v2),
allv as (select * from v1 union all select * from v2 union all select * from v3),
pairs as (select distinct repo, number - 1 as old_id, number as new_id from allv where number > 1
          and repo in (select repo from allv a2 where a2.number = allv.number - 1)),
o as (select p.repo, p.new_id, a.rel_path as path, a.content from pairs p join allv a on a.repo = p.repo and a.number = p.old_id
      where {_SUP.replace('rel_path', 'a.rel_path')}),
n as (select p.repo, p.new_id, a.rel_path as path, a.content from pairs p join allv a on a.repo = p.repo and a.number = p.new_id
      where {_SUP.replace('rel_path', 'a.rel_path')}),
fo as (select distinct p.repo, p.new_id, unnest(list_transform(range(1, len(string_split(a.rel_path, '/'))),
          lambda i: array_to_string(string_split(a.rel_path, '/')[1:i], '/'))) as folder
       from pairs p join allv a on a.repo = p.repo and a.number = p.old_id),
fn as (select distinct p.repo, p.new_id, unnest(list_transform(range(1, len(string_split(a.rel_path, '/'))),
          lambda i: array_to_string(string_split(a.rel_path, '/')[1:i], '/'))) as folder
       from pairs p join allv a on a.repo = p.repo and a.number = p.new_id)
"""


@register("snapshot_diff_all", "with " + _VERSIONS_SQL + """
select coalesce(o.repo, n.repo) as repo, coalesce(o.new_id, n.new_id) as new_id, 'file' as level,
       case when o.path is null then 'added' when n.path is null then 'removed' else 'modified' end as change,
       coalesce(o.path, n.path) as path
from o full outer join n on o.repo = n.repo and o.new_id = n.new_id and o.path = n.path
where o.path is null or n.path is null or o.content <> n.content
union all
select coalesce(fo.repo, fn.repo), coalesce(fo.new_id, fn.new_id), 'folder',
       case when fo.folder is null then 'added' else 'removed' end, coalesce(fo.folder, fn.folder)
from fo full outer join fn on fo.repo = fn.repo and fo.new_id = fn.new_id and fo.folder = fn.folder
where fo.folder is null or fn.folder is null""")
def q_snapshot_diff_all(spark, root):
    files = snapshot_versions(T(spark, root, "documents"), T(spark, root, "labels"), T(spark, root, "benchmark"))
    pairs = version_pairs(files.select("repo", "number").distinct(), ["repo"], "number")
    old, new = snapshot_pairs(files, pairs, ["repo"])
    d = snapshot_diff(old, new, key_cols=["repo", "new_id"])
    return d.select("repo", F.col("new_id").cast("int").alias("new_id"), "level", "change", "path")


@register("regen_counts", "with " + _VERSIONS_SQL + """
select coalesce(o.repo, n.repo) as repo, coalesce(o.new_id, n.new_id) as new_id, count(*) as n_regenerate
from o full outer join n on o.repo = n.repo and o.new_id = n.new_id and o.path = n.path
where (o.path is null or o.content <> n.content) and not contains(n.path, 'test')
group by all""")
def q_regen_counts(spark, root):
    files = snapshot_versions(T(spark, root, "documents"), T(spark, root, "labels"), T(spark, root, "benchmark"))
    pairs = version_pairs(files.select("repo", "number").distinct(), ["repo"], "number")
    old, new = snapshot_pairs(files, pairs, ["repo"])
    d = snapshot_diff(old, new, key_cols=["repo", "new_id"])
    items = new.filter(is_supported_ext("rel_path") & ~is_test_path("rel_path")).select("repo", "new_id", "rel_path")
    regen = to_regenerate(items, d, key_cols=["repo", "new_id"])
    return regen.groupBy("repo", F.col("new_id").cast("int").alias("new_id")).agg(F.count(F.lit(1)).alias("n_regenerate"))


# Beside each file lies one whose path is longer by an x, so a changed path is a substring of another one.
@register("carry_forward_substrings", _DIFF_SQL + f""",
d as (select rel_path, doc from {_OLD_DOCS} union all select rel_path || 'x', doc from {_OLD_DOCS})
select 'v2' as instance_key, rel_path, doc from d where not exists (select 1 from {_CHANGED} c where contains(d.rel_path, c.path))""")
def q_carry_forward_substrings(spark, root):
    old = _old_docs(spark, root)
    both = old.unionByName(old.withColumn("rel_path", F.concat("rel_path", F.lit("x"))))
    return carry_forward(both, _diff(spark, root), {"instance_key": "v2"}, literal_substring=True).select("instance_key", "rel_path", "doc")


# Files without content on the old side (every third), on the new side (every fourth) or both.
@register("snapshot_diff_nulls", """
select 'file' as level, 'modified' as change, 'd_' || doc_id || '.js' as path from documents
where text is not null and (doc_id % 3 = 0) <> (doc_id % 4 = 0)""")
def q_snapshot_diff_nulls(spark, root):
    d = T(spark, root, "documents")
    side = lambda n: d.select(F.concat(F.lit("d_"), "doc_id", F.lit(".js")).alias("rel_path"),          # noqa: E731
                              F.when(F.col("doc_id") % n != 0, F.col("text")).alias("content"))
    return snapshot_diff(side(3), side(4))
