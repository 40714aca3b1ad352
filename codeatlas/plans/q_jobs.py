"""The composite jobs, each run as a whole over inputs derived from the tables, and a sink read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.elements import code_elements
from ..session import ensure_checkpoint_dir, spread
from ..sources import sinks
from . import jobs, q_media, q_retrieval, q_text  # noqa: F401 - their twins are built upon
from .q_elements import _E_SQL
from .q_graph import _CALLS_SQL, _SPECS_SQL, _files
from .q_media import _KF_SQL
from .registry import T, register, sql_of

INST = ["instance_key"]
KEY = ["instance_key", "rel_path"]
SUMMARY_BUDGET = 300       # tokens; some prompts of the fixture exceed it
CONTEXT_BUDGET = 1000
_TOKENS = r"cast(len(regexp_extract_all({}, '\w+|[^\w\s]')) as bigint)"


@register("job_code_catalog", sql_of("drop_overlaps"))
def q_code_catalog(spark, root):
    el = jobs.build_code_catalog(_files(spark, root))
    return el.select("rel_path", "kind", "name", F.col("start_line").cast("long").alias("start_line"))


@register("job_import_graph", _SPECS_SQL + """
select instance_key, rel_path as node, 'file' as type, cast(null as varchar) as target from files
union all
select distinct instance_key, dst_path, cast(null as varchar), cast(null as varchar) from edges e
where not exists (select 1 from files f where f.instance_key = e.instance_key and f.rel_path = e.dst_path)
union all select instance_key, src_path, 'edge', dst_path from edges""")
def q_import_graph(spark, root):
    nodes, edges = jobs.build_import_graph(_files(spark, root))
    return nodes.select(*INST, "node", "type", F.lit(None).cast("string").alias("target")).unionByName(
        edges.select(*INST, F.col("src_path").alias("node"), F.lit("edge").alias("type"), F.col("dst_path").alias("target")))


@register("job_doc_meta", _SPECS_SQL + "," + _CALLS_SQL + f""",
el as ({_E_SQL} select * from e),
kept as (select * from ({sql_of("drop_overlaps")}))
select el.instance_key, el.rel_path, el.start_line, el.name, case when el.kind = 'class' then 'Class' else 'Function' end as type,
       r.dst_path, r.call_name, cast(r.callee_line as bigint) as callee_line
from el semi join kept using (rel_path, start_line, name, kind)
left join refs r on r.instance_key = el.instance_key and r.src_path = el.rel_path and r.start_line = el.start_line
where el.node_key is not null""")
def q_doc_meta(spark, root):
    files = _files(spark, root)
    elements = jobs.build_code_catalog(files).checkpoint()
    _, edges = jobs.build_import_graph(files)
    return jobs.build_doc_meta(files, elements, edges).select(
        *KEY, F.col("start_line").cast("long").alias("start_line"), "name", "type", "dst_path", "call_name",
        F.col("callee_line").cast("long").alias("callee_line"))


@register("job_summarise_files", _E_SQL + f""",
n as (select *, row_number() over (partition by rel_path order by start_line) as i from e),
d as (select instance_key, rel_path,
             string_agg(i || '. **Code Description**: ' || name || chr(10) || chr(10), '' order by i) as description
      from n group by instance_key, rel_path),
p as (select *, 'Describe this ' || split_part(rel_path, '.', -1) || ' file.' || chr(10) || description as prompt from d)
select instance_key, rel_path, prompt, {_TOKENS.format("prompt")} as tokens,
       {_TOKENS.format("prompt")} > {SUMMARY_BUDGET} as over_budget from p""")
def q_summarise_files(spark, root):
    doc = F.concat(F.lit("Title\n**Code Description**: "), F.col("name"), F.lit("\n**Note**: none"))
    docs = code_elements(_files(spark, root), KEY).select(*KEY, "start_line", doc.alias("doc"))
    return jobs.summarise_files(docs, SUMMARY_BUDGET).select(*KEY, "prompt", "tokens", "over_budget")


_INDEXED = """from (select 'doc_' || doc_id || '.js' as doc_id,
  'Filename: doc_' || doc_id || '.js' || chr(10) || chr(10) || text as text from documents where text is not null)"""


@register("job_chunk_file_docs", f"""
select doc_id as rel_path, pos, chunk from ({sql_of("chunk_recursive").replace("from documents where text <> ''", _INDEXED)})""")
def q_chunk_file_docs(spark, root):
    d = _file_docs(spark, root)
    return jobs.chunk_file_docs(d).select("rel_path", F.col("pos").cast("long").alias("pos"), "chunk")


def _file_docs(spark, root):
    return T(spark, root, "documents").select(F.col("source").alias("instance_key"), F.concat(
        F.lit("doc_"), F.col("doc_id"), F.lit(".js")).alias("rel_path"), F.col("text").alias("doc"))


# Every third file has no doc; the issue names all files.
@register("job_file_contexts", f"""
with recursive t as (
  select source, 'doc_' || doc_id || '.js' as rel_path, {_TOKENS.format("'* `doc_' || doc_id || '.js`: ' || case when doc_id % 3 = 0 then 'None' else replace(coalesce(text, ''), '**', '') end")} as size
  from documents where source is not null),
o as (select *, row_number() over (partition by source order by rel_path) as i from t),
r as (select source, rel_path, i, size, size as total, cast(1 as bigint) as batch_no from o where i = 1
      union all
      select o.source, o.rel_path, o.i, o.size,
             case when r.total + o.size < {CONTEXT_BUDGET} then r.total + o.size else o.size end,
             case when r.total + o.size < {CONTEXT_BUDGET} then r.batch_no else r.batch_no + 1 end
      from r join o on o.source = r.source and o.i = r.i + 1)
select source as instance_key, rel_path, size as tokens, batch_no from r""")
def q_file_contexts(spark, root):
    docs = _file_docs(spark, root)
    number = F.regexp_extract("rel_path", r"(\d+)", 1).cast("long")
    described = docs.filter(number % 3 != 0).withColumn("doc", F.coalesce("doc", F.lit("")))
    return jobs.file_contexts(docs.select(*KEY), docs.select(*KEY), described, budget=CONTEXT_BUDGET).select(
        *KEY, "tokens", F.col("batch_no").cast("long").alias("batch_no"))


@register("job_media_budget", f"""
select instance_key, image_tokens, 128000 - image_tokens as text_budget
from ({sql_of("instance_image_tokens_shared")})""")
def q_media_budget(spark, root):
    """Gifs of all instances share one name."""
    assets, frames = q_media._shared(q_media.assets(spark, root), "name"), q_media._shared(q_media.frames(spark, root), "frame")
    return jobs.media_budget(assets, frames).select(*INST, "image_tokens", "text_budget")


# Each user's events are the frames of a gif; the gifs of ten instances share their names.
@register("job_sample_keyframes", _KF_SQL.replace("order by ts, event_id", "order by event_id") + """
select 'i' || user_id % 10 as instance_key, 'g' || user_id // 10 as gif, event_id as frame_no,
       cast(kept_no as bigint) as kept_no, count(*) over (partition by user_id) as saved_frames,
       (select count(*) from events e where e.user_id = k.user_id) as total_frames from k""")
def q_sample_keyframes(spark, root):
    gif = [*INST, "gif"]
    frames = T(spark, root, "events").select(
        F.concat(F.lit("i"), F.col("user_id") % 10).alias("instance_key"),
        F.concat(F.lit("g"), F.floor(F.col("user_id") / 10)).alias("gif"),
        F.col("event_id").alias("frame_no"), F.col("value").alias("feature"))
    kept, counts = jobs.sample_keyframes(frames, threshold=10.0)
    return kept.join(counts, gif).select(*gif, "frame_no", F.col("kept_no").cast("long").alias("kept_no"),
                                         "saved_frames", "total_frames")


# -- C6: letter counts stand for the vectors that a service would return --------------------
_LETTERS = "etaoinsr"
_VECTOR = "[" + ", ".join(f"length({{0}}) - length(replace({{0}}, '{x}', ''))" for x in _LETTERS) + "]::double[]"
_RETRIEVAL_SQL = f"""
with c as (select d.source as instance_key, j.rel_path, j.pos, j.chunk from ({sql_of("job_chunk_file_docs")}) j
           join documents d on 'doc_' || d.doc_id || '.js' = j.rel_path where d.source is not null),
cv as (select *, {_VECTOR.format("chunk")} as v from c where pos % 7 <> 3),
a as (select source, arg_min(text, doc_id) as t1, arg_max(text, doc_id) as t2 from documents where text is not null and source is not null group by source),
q as (select source as instance_key, 1 as ordinal, regexp_replace(split_part(t1, chr(10), 1), '^\\s+|\\s+$', '', 'g') as query from a
      union all select source, 2, regexp_replace(split_part(t2, chr(10), 1), '^\\s+|\\s+$', '', 'g') from a),
qv as (select *, {_VECTOR.format("query")} as v from q where query <> '' and not (ordinal = 2 and instance_key like '%7')),
"""


def _letters(text):
    return F.array(*[(F.char_length(text) - F.char_length(F.replace(F.col(text), F.lit(x), F.lit("")))).cast("double") for x in _LETTERS])


def _retrieval(spark, root):
    """Docs, the vectors of most of their chunks and of texts that have changed since, analyses and their vectors."""
    docs = _file_docs(spark, root).filter("instance_key is not null")
    made = jobs.index_chunks(docs).withColumn("embedding", _letters("chunk")).drop("chunk")
    old = made.filter("pos = 0").withColumn("text_hash", F.lit("of an older text"))
    d = T(spark, root, "documents").filter("text is not null and source is not null")
    ends = d.groupBy("source").agg(F.min_by("text", "doc_id").alias("a"), F.max_by("text", "doc_id").alias("b"))
    first = lambda c: F.element_at(F.split(c, "\n"), 1)                                                  # noqa: E731
    analyses = ends.select(F.col("source").alias("instance_key"), F.concat(
        F.lit("**Cause**: "), first("a"), F.lit("\nother\n**Summary**: "), first("b")).alias("analysis"))
    asked = jobs.issue_queries(analyses).withColumn("embedding", _letters("query"))
    asked = asked.filter(~((F.col("ordinal") == 2) & F.col("instance_key").endswith("7")))
    return jobs.retrieve_files(docs, made.filter("pos % 7 <> 3").unionByName(old), analyses, asked.drop("query"))


@register("job_retrieve_files", _RETRIEVAL_SQL + """
pairs as (select c.instance_key, ordinal, rel_path, pos, list_distance(c.v, q.v) as dist from cv c join qv q on q.instance_key = c.instance_key),
ranked as (select *, row_number() over (partition by instance_key, ordinal order by dist, rel_path, pos) as r from pairs),
files as (select instance_key, rel_path, min(r) as best from ranked where r <= 50 group by instance_key, rel_path)
select instance_key, string_agg(rel_path || chr(10), '' order by best, rel_path) as text from files group by instance_key""")
def q_retrieve_files(spark, root):
    """C6 whole: docs to chunks, vectors tied to them, files retrieved, the result committed and read back."""
    files, _ = _retrieval(spark, root)
    path = f"{ensure_checkpoint_dir(spark)}/retrieved-{uuid.uuid4().hex}"
    sinks.write_texts(jobs.retrieved_texts(files).withColumn("batch_no", F.lit(0)), path, batch_col="batch_no", mode="append", batch_id="run")
    return sinks.read_texts(spark, path)


@register("job_retrieve_report", _RETRIEVAL_SQL + """
n as (select instance_key, count(*) as chunks, count(*) filter (pos % 7 = 3) as chunks_without_vector, count(*) filter (pos = 0) as vectors_without_chunk
      from c group by instance_key),
m as (select instance_key, count(*) as questions, count(*) filter (ordinal = 2 and instance_key like '%7') as questions_without_vector
      from q where query <> '' group by instance_key)
select n.*, coalesce(questions, 0) as questions, coalesce(questions_without_vector, 0) as questions_without_vector, 0::bigint as vectors_without_question
from n left join m using (instance_key)""")
def q_retrieve_report(spark, root):
    _, report = _retrieval(spark, root)
    return report


# -- C4: three snapshots of four repositories, a file per part; a third of the files changes each time, a third
# never, a third changes and changes back, and some are away in the second snapshot ------------
def _history(spark, root):
    pk = F.col("p_partkey")
    q = F.floor(pk / 8) * 4 + pk % 4
    rows = T(spark, root, "part").select("p_partkey", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("number")) \
        .filter((pk % 10 != 7) | (F.col("number") != 2))
    value = F.when(pk % 3 == 0, F.col("number")).when((pk % 3 == 1) | (F.col("number") != 2), 1).otherwise(2)
    call = F.when(pk >= 8, F.concat(F.lit("f_"), q.cast("string"), F.lit("(a)"))).otherwise("a")
    head = F.when(pk >= 8, F.concat(F.lit("import { f_"), q.cast("string"), F.lit(" } from './m_"), q.cast("string"), F.lit(".js';\n"))).otherwise("")
    name = F.concat(F.lit("f_"), pk.cast("string"))
    files = rows.select(
        F.concat(F.lit("r"), (pk % 4).cast("string")).alias("repo"), "number", F.concat(F.lit("src/m_"), pk.cast("string"), F.lit(".js")).alias("rel_path"),
        F.concat(head, F.lit("function "), name, F.lit("(a) {\n  return "), call, F.lit(" + "), value.cast("string"), F.lit(";\n}")).alias("content"))
    docs = rows.filter("number < 3").select(
        F.concat(F.lit("r"), (pk % 4).cast("string")).alias("repo"), "number", F.concat(F.lit("src/m_"), pk.cast("string"), F.lit(".js")).alias("rel_path"),
        name.alias("name"), F.concat(F.lit("Doc of "), name, F.lit(" at "), F.col("number").cast("string")).alias("doc"))
    return jobs.refresh_history(files, docs)


_HISTORY_SQL = """
with recursive f as (
  select 'r' || p_partkey % 4 as repo, number, p_partkey as pk, (p_partkey // 8) * 4 + p_partkey % 4 as q,
         case when p_partkey % 3 = 0 then number when p_partkey % 3 = 1 or number <> 2 then 1 else 2 end as val,
         case when p_partkey % 3 <> 1 then number when p_partkey % 10 = 7 then number else 1 end as since
  from part, (select unnest([1, 2, 3]) as number) where p_partkey % 10 <> 7 or number <> 2),
"""


@register("job_refresh_docs_history", _HISTORY_SQL + """
x as (select 1)
select repo || '/' || number as instance_key, 'src/m_' || pk || '.js' as rel_path, 'f_' || pk as name, 'Doc of f_' || pk || ' at ' || since as doc, since
from f where since < 3""")
def q_refresh_docs_history(spark, root):
    """Every snapshot's docs, from the snapshot where the present content of their file began."""
    docs, _ = _history(spark, root)
    return docs


@register("job_refresh_docs", _HISTORY_SQL + """
code as (select *, 'function f_' || pk || '(a) {' || chr(10) || '  return ' || case when pk >= 8 then 'f_' || q || '(a)' else 'a' end
                   || ' + ' || val || ';' || chr(10) || '}' as code from f),
called as (select c.*, o.code as o_code, o.since as o_since, o.pk as o_pk from code c
           left join code o on c.pk >= 8 and o.pk = c.q and o.number = c.number),
new as (select * from called where since = number),
w as (select number, pk, 0 as level from new where o_pk is null or o_since <> number
      union all
      select n.number, n.pk, level + 1 from w join new n on n.number = w.number and n.o_pk = w.pk)
select repo || '/' || number as instance_key, 'src/m_' || pk || '.js' as rel_path, 'f_' || pk as name, level, false as forced,
       'Document the function `f_' || pk || '` of src/m_' || pk || '.js.' || chr(10) || chr(10) || chr(10) || code || chr(10) || chr(10) || 'It uses:' || chr(10)
       || case when o_pk is null then '' else 'src/m_' || o_pk || '.js' || chr(10)
          || case when o_since < 3 then 'Doc of f_' || o_pk || ' at ' || o_since else 'None' end
          || chr(10) || chr(10) || o_code || chr(10) end as prompt
from new join w using (number, pk)""")
def q_refresh_docs(spark, root):
    """The elements to document in each snapshot, in waves, with their prompts."""
    _, plan = _history(spark, root)
    return plan.select(*KEY, "name", "level", "forced", "prompt")


# -- C8: a file per document, two documented elements in it, one without a type; images leave less room for some --
_ELEMENT_BUDGET = 700
_SUMMARY = """array_to_string(list_transform(list_filter(list_transform(case when en > 0 then ls[1:en - 1] else ls end,
   lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), lambda x: x || chr(10)), '')"""
_ELEMENT_ITEMS_SQL = f"""
with recursive t as (select source, doc_id, string_split(text, chr(10)) as ls from documents where source is not null),
v as (select *, coalesce(list_position(list_transform(ls, lambda x: starts_with(x, '**Note**')), true), 0) as en from t),
i as (select source, 'doc_' || doc_id || '.js' as rel_path, '--- doc_' || doc_id || '.js ---' || chr(10) || chr(10)
         || '-- Function `f` --' || chr(10) || chr(10) || coalesce({_SUMMARY}, 'None') || chr(10) || chr(10)
         || '--  `g` --' || chr(10) || chr(10) || 'short' || chr(10) || chr(10) || chr(10) || chr(10) || chr(10) as item from v),
z as (select *, {_TOKENS.format("item")} as size, case when source like '%3' then 300 else {_ELEMENT_BUDGET} end as room,
             row_number() over (partition by source order by rel_path) as n from i),
r as (select source, rel_path, item, n, size, room, size as total, 1::bigint as batch_no from z where n = 1
      union all
      select z.source, z.rel_path, z.item, z.n, z.size, z.room, case when r.total + z.size < z.room then r.total + z.size else z.size end,
             case when r.total + z.size < z.room then r.batch_no else r.batch_no + 1 end
      from r join z on z.source = r.source and z.n = r.n + 1)
"""


def _element_contexts(spark, root):
    d = _file_docs(spark, root).filter("instance_key is not null")
    docs = d.select(*KEY, F.explode(F.array(F.struct(F.lit("f").alias("name"), F.concat(F.lit("head\n"), "doc").alias("doc")),
                                            F.struct(F.lit("g").alias("name"), F.lit("head\nshort\n**Note** end").alias("doc")))).alias("e")).select(*KEY, "e.*")
    meta = d.select(*KEY, F.lit("f").alias("name"), F.lit("Function").alias("type"), F.lit(1).alias("ordinal"))
    # The issue's answer lists all files of its instance by their folder, and a test.
    listed = d.groupBy("instance_key").agg(F.array_sort(F.collect_list("rel_path")).alias("_f"))
    files = d.select("instance_key", F.concat(F.lit("src/"), "rel_path").alias("path"))
    answer = listed.select("instance_key", F.concat(F.lit("Files:\n```\n"), F.array_join(F.transform("_f", lambda f: F.concat(F.lit("src/"), f)), "\n"),
                                                    F.lit("\nsrc/test/x.js\n```\n")).alias("answer"))
    budgets = listed.filter(F.col("instance_key").endswith("3")).select("instance_key", F.lit(300).alias("text_budget"))
    at = lambda df: df.withColumn("rel_path", F.concat(F.lit("src/"), "rel_path"))                          # noqa: E731
    return jobs.element_contexts(answer, files.withColumnRenamed("path", "rel_path"), at(docs), at(meta), budgets, _ELEMENT_BUDGET)


@register("job_element_contexts", _ELEMENT_ITEMS_SQL.replace("'doc_' || doc_id || '.js' as rel_path, '--- doc_'", "'src/doc_' || doc_id || '.js' as rel_path, '--- src/doc_'") + """
select source as instance_key, rel_path, size as tokens, batch_no, size >= room as oversize from r""")
def q_element_contexts(spark, root):
    return _element_contexts(spark, root).select(*KEY, "tokens", "batch_no", "oversize")


@register("job_element_prompts", _ELEMENT_ITEMS_SQL.replace("'doc_' || doc_id || '.js' as rel_path, '--- doc_'", "'src/doc_' || doc_id || '.js' as rel_path, '--- src/doc_'") + """
select source as instance_key, batch_no, 'Issue:' || chr(10) || 'broken ' || source || chr(10) || chr(10) || 'Which of these elements are at fault?'
       || chr(10) || chr(10) || string_agg(item, chr(10) order by n) as prompt
from r group by source, batch_no""")
def q_element_prompts(spark, root):
    issues = _file_docs(spark, root).select("instance_key").distinct().withColumn("problem_statement", F.concat(F.lit("broken "), "instance_key"))
    return jobs.element_prompts(_element_contexts(spark, root), issues)


# -- C9: a file per part with two functions, the answer names one of them; every seventh file has its patch ------
_REPAIR_TEXT = """'// head ' || p_partkey || chr(10) || 'function keep_' || p_partkey || '(a) {' || chr(10) || '  return a;' || chr(10) || '}' || chr(10) || chr(10)"""
_REPAIR_PROMPT_SQL = f"""'Issue:' || chr(10) || 'broken r' || p_partkey % 5 || chr(10) || chr(10) || 'Mend this file.' || chr(10) || chr(10)
       || '###src/m_' || p_partkey || '.js' || chr(10) || chr(10) || {_REPAIR_TEXT}"""


@register("job_repair_contexts", f"""
with p as (select 'r' || p_partkey % 5 as instance_key, 'src/m_' || p_partkey || '.js' as rel_path, {_REPAIR_TEXT} as pruned,
                  {_REPAIR_PROMPT_SQL} as prompt, case when p_partkey % 5 = 1 then 20 else 1000 end as room
           from part where p_partkey % 7 <> 0)
select instance_key, rel_path, pruned, prompt, {_TOKENS.format("prompt")} as tokens, {_TOKENS.format("prompt")} > room as over_budget from p""")
def q_repair_contexts(spark, root):
    pk = F.col("p_partkey")
    s = pk.cast("string")
    files = T(spark, root, "part").select(
        F.concat(F.lit("r"), (pk % 5).cast("string")).alias("instance_key"), F.concat(F.lit("src/m_"), s, F.lit(".js")).alias("rel_path"), pk.alias("pk"),
        F.concat(F.lit("// head "), s, F.lit("\nfunction keep_"), s, F.lit("(a) {\n  return a;\n}\nfunction drop_"), s, F.lit("(b) {\n  return b;\n}\n")).alias("content"))
    fences = files.withColumn("fence", F.concat(F.lit("```\n"), "rel_path", F.lit("\nfunction: keep_"), F.col("pk").cast("string"), F.lit("\n```\n")))
    answers = fences.groupBy("instance_key").agg(F.array_sort(F.collect_list("fence")).alias("_f")).select(
        "instance_key", F.concat(F.array_join("_f", ""), F.lit("Summary: the end\n```\nsrc/none.js\n```")).alias("answer"))
    nobody = spark.createDataFrame([("r9", "```\nsrc/m_1.js\nfunction: keep_1\n```")], answers.schema)
    issues = files.select("instance_key").distinct().withColumn("problem_statement", F.concat(F.lit("broken "), "instance_key"))
    budgets = spark.createDataFrame([("r1", 20)], "instance_key string, text_budget long")
    files = spread(files).checkpoint()
    return jobs.repair_contexts(answers.unionByName(nobody), files.drop("pk"), jobs.build_code_catalog(files.drop("pk")), files.filter("pk % 7 = 0").select(*KEY),
                                1000, issues, budgets)


@register("write_jsonl", "select doc_id, source as instance_key, lang, text from documents")
def q_write_jsonl(spark, root):
    """Documents written as JSON lines in a folder per source, and read back."""
    path = f"{ensure_checkpoint_dir(spark)}/jsonl-{uuid.uuid4().hex}"
    d = T(spark, root, "documents").select("doc_id", F.col("source").alias("instance_key"), "lang", "text")
    sinks.write_jsonl(d, path)
    return spark.read.schema(d.schema).json(path).select(*d.columns)
