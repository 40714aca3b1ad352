"""Text queries: issue fields, doc sections and summaries, fenced answers, prompts, token counts.

Artefact texts are built from `documents` rows; every line of every document is used."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.fences import explode_fenced_lines, fenced_elements, ranked_files
from .registry import T, register

_NL = "chr(10)"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


# -- analysis texts: line i of a document gets label number i % 5 ----------------------------
_LABELS = ("### Answer ", "**Wrong Behavior**: ", "**Cause**: ", "", "**Summary**: ")
_LABELS_SQL = "[" + ", ".join("'" + s + "'" for s in _LABELS) + "]"
_ANALYSES_SQL = f"""(select doc_id, array_to_string(list_transform(string_split(text, {_NL}),
        lambda l, i: {_LABELS_SQL}[(i - 1) % 5 + 1] || l), {_NL}) as analysis from documents)"""


def analyses(spark, root):
    d = T(spark, root, "documents")
    labs = F.array(*[F.lit(s) for s in _LABELS])
    t = F.array_join(F.transform(X.lines("text"), lambda ln, i: F.concat(F.element_at(labs, (i % 5 + 1).cast("int")), ln)),
                     "\n")
    return d.select("doc_id", t.alias("analysis"))


_LAB_CASE = """case when starts_with(l, '**Cause**') then '**Cause**'
                    when starts_with(l, '**Wrong Behavior**') then '**Wrong Behavior**'
                    when starts_with(l, '**Summary**') then '**Summary**' end"""


@register("issue_fields", f"""
with t as (select doc_id, list_filter(list_transform(string_split(analysis, {_NL}),
              lambda l: {{'lab': {_LAB_CASE}, 'l': l}}), lambda s: s.lab is not null) as fs from {_ANALYSES_SQL}),
u as (select doc_id, unnest(fs) as s, unnest(range(1, len(fs) + 1)) as ordinal from t)
select doc_id, ordinal, replace(s.lab, '*', '') as field, {_strip("replace(s.l, s.lab || ':', '')")} as value from u""")
def q_issue_fields(spark, root):
    a = analyses(spark, root)
    return a.select("doc_id", F.posexplode(X.issue_fields("analysis")).alias("_p", "_s")) \
        .select("doc_id", (F.col("_p") + 1).cast("long").alias("ordinal"), "_s.field", "_s.value")


# -- element docs: name line, parameters line, description (whole document), optional note ----
def element_docs(spark, root):
    d = T(spark, root, "documents")
    note = F.when(F.col("lang") != "es", F.concat(F.lit("\n**Note**: "), F.col("source"), F.lit("\nz"))).otherwise("")
    return d.select("doc_id", F.concat(F.lit("**fn_"), F.col("doc_id"), F.lit("**: "), F.col("source"),
                                       F.lit("\n**parameters**: "), F.col("lang"), F.lit("\n**Code Description**: "),
                                       F.col("text"), note).alias("doc"))


_ELEMENT_DOCS_SQL = f"""(select doc_id, '**fn_' || doc_id || '**: ' || source || {_NL} || '**parameters**: ' || lang
     || {_NL} || '**Code Description**: ' || text
     || case when lang <> 'es' then {_NL} || '**Note**: ' || source || {_NL} || 'z' else '' end as doc from documents)"""


@register("doc_section", f"""
with t as (select doc_id, string_split(doc, {_NL}) as ls from {_ELEMENT_DOCS_SQL}),
s as (select doc_id, ls, list_position(list_transform(ls, lambda x: starts_with(x, '**Code Description**:')), true) as st
      from t),
u as (select doc_id, st, ls[st:] as tail from s),
v as (select doc_id, st, tail, coalesce(list_position(list_transform(tail, lambda x: starts_with(x, '**Note**:')), true), 0) as en
      from u)
select doc_id, case when st is null or st = 0 then ''
       else array_to_string(list_transform(case when en > 0 then tail[1:en - 1] else tail end,
                                           lambda x: {_strip("x")} || {_NL}), '') end as section
from v""")
def q_doc_section(spark, root):
    return element_docs(spark, root).select("doc_id", X.doc_section("doc").alias("section"))


@register("doc_summary", f"""
with t as (select doc_id, string_split(doc, {_NL})[2:] as ls from {_ELEMENT_DOCS_SQL}),
v as (select doc_id, ls, coalesce(list_position(list_transform(ls, lambda x: starts_with(x, '**Note**')), true), 0) as en
      from t)
select doc_id, array_to_string(list_transform(list_filter(list_transform(
         case when en > 0 then ls[1:en - 1] else ls end, lambda x: {_strip("x")}), lambda x: x <> ''),
         lambda x: x || {_NL}), '') as summary
from v""")
def q_doc_summary(spark, root):
    return element_docs(spark, root).select("doc_id", X.doc_summary("doc").alias("summary"))


# -- file docs exist for labelled documents only; the others read as "None" ------------------
@register("file_summary_text", f"""
with f as (select d.doc_id, case when l.doc_id is not null then '**Summary of code description**: ' || d.text
                   || {_NL} || {_NL} || '**Conclusion**: ' || d.source end as doc
           from documents d left join labels l on d.doc_id = l.doc_id),
j as (select doc_id, doc, array_to_string(list_transform(list_filter(list_transform(string_split(doc, {_NL}),
         lambda x: {_strip("x")}), lambda x: x <> ''), lambda x: x || {_NL}), '') as joined from f)
select doc_id, coalesce({_strip("replace(replace(replace(joined, '**Conclusion**:', 'Summary:'), '**Summary of code description**:', 'Class/Function:'), '**', '')")}, 'None') as summary
from j""")
def q_file_summary_text(spark, root):
    d = T(spark, root, "documents")
    lab = T(spark, root, "labels").select("doc_id", F.lit(1).alias("_has"))
    f = d.join(lab, "doc_id", "left").select("doc_id", F.when(
        F.col("_has").isNotNull(), F.concat(F.lit("**Summary of code description**: "), F.col("text"),
                                            F.lit("\n\n**Conclusion**: "), F.col("source"))).alias("doc"))
    return f.select("doc_id", X.file_summary_text("doc").alias("summary"))


# -- fenced answers ------------------------------------------------------------------------------
def file_answers(spark, root):
    """Prose line, a fence (tagged for German documents) listing every line of the document with
    every third line replaced by a path, and for French documents a second fence of quoted output."""
    d = T(spark, root, "documents")
    body = F.array_join(F.transform(X.lines("text"), lambda ln, i: F.when(
        i % 3 == 0, F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/file_"), i.cast("string"), F.lit(".js")))
        .otherwise(ln)), "\n")
    tag = F.when(F.col("lang") == "de", "python").otherwise("")
    extra = F.when(F.col("lang") == "fr", F.lit("\nquoted:\n```\nerror output\n```")).otherwise("")
    return d.select("doc_id", F.concat(F.lit("Answer for "), F.col("source"), F.lit("\n```"), tag, F.lit("\n"), body,
                                       F.lit("\n```"), extra, F.lit("\ndone")).alias("answer"))


_FILE_ANSWERS_SQL = f"""(select doc_id, 'Answer for ' || source || {_NL} || '```' || case when lang = 'de' then 'python' else '' end
   || {_NL} || array_to_string(list_transform(string_split(text, {_NL}), lambda l, i:
        case when (i - 1) % 3 = 0 then source || '/' || lang || '/file_' || (i - 1) || '.js' else l end), {_NL})
   || {_NL} || '```' || case when lang = 'fr' then {_NL} || 'quoted:' || {_NL} || '```' || {_NL} || 'error output'
   || {_NL} || '```' else '' end || {_NL} || 'done' as answer from documents)"""

_FENCED_SQL = f"""(select doc_id, flatten(list_transform(regexp_extract_all(answer, '(?s)```(.*?)```', 1),
     lambda b: list_filter(list_transform(string_split({_strip("b")}, {_NL}), lambda x: {_strip("x")}), lambda x: x <> '')))
     as fl from {_FILE_ANSWERS_SQL})"""


@register("fenced_lines", f"""
select doc_id, unnest(range(1, len(fl) + 1)) as rank, unnest(fl) as line from {_FENCED_SQL}""")
def q_fenced_lines(spark, root):
    return explode_fenced_lines(file_answers(spark, root), ["doc_id"], "answer") \
        .select("doc_id", F.col("rank").cast("long").alias("rank"), "line")


@register("ranked_files", f"""
with p as (select doc_id, list_filter(fl, lambda x: contains(x, '/') or contains(x, '\\')) as ps from {_FENCED_SQL})
select doc_id, unnest(range(1, len(ps) + 1)) as rank, unnest(ps) as rel_path from p""")
def q_ranked_files(spark, root):
    return ranked_files(file_answers(spark, root), ["doc_id"], "answer") \
        .select("doc_id", F.col("rank").cast("long").alias("rank"), "rel_path")


def element_answers(spark, root):
    """A fence naming the document's file then one ``function: <line>`` per document line; English
    answers carry the no-elements marker; English and French answers then say Summary and repeat
    a fence that must be ignored; the others add a fence with a file and no elements."""
    d = T(spark, root, "documents")
    els = F.array_join(F.transform(X.lines("text"), lambda ln: F.concat(F.lit("function: "), ln)), "\n")
    marker = F.when(F.col("lang") == "en", F.lit("This file contains no relevant functions/classes\n")).otherwise("")
    tail = F.when(F.col("lang").isin("en", "fr"), F.lit("Summary\n```\nother/x.js\nclass: Late\n```\n")) \
        .otherwise(F.concat(F.lit("```\n"), F.col("source"), F.lit("/extra.ts\n```\n")))
    return d.select("doc_id", F.concat(F.lit("Analysis\n```\n"), F.col("source"), F.lit("/"), F.col("lang"),
                                       F.lit("/doc_"), F.col("doc_id"), F.lit(".js\n"), els, F.lit("\n```\n"),
                                       marker, tail).alias("answer"))


_ELEMENT_ANSWERS_SQL = f"""(select doc_id, 'Analysis' || {_NL} || '```' || {_NL} || source || '/' || lang || '/doc_' || doc_id
   || '.js' || {_NL} || array_to_string(list_transform(string_split(text, {_NL}), lambda l: 'function: ' || l), {_NL})
   || {_NL} || '```' || {_NL}
   || case when lang = 'en' then 'This file contains no relevant functions/classes' || {_NL} else '' end
   || case when lang in ('en', 'fr') then 'Summary' || {_NL} || '```' || {_NL} || 'other/x.js' || {_NL} || 'class: Late'
           || {_NL} || '```' || {_NL}
      else '```' || {_NL} || source || '/extra.ts' || {_NL} || '```' || {_NL} end as answer from documents)"""


_FENCED_ELEMENTS_SQL = f"""
with t as (select doc_id, string_split(answer, {_NL}) as ls from {_ELEMENT_ANSWERS_SQL}),
s as (select doc_id, ls, coalesce(list_position(list_transform(ls, lambda x: (contains(x, 'Summary') or contains(x, 'SUMMARY'))
          and not contains(x, 'This file contains no relevant functions/classes')), true), 0) as st from t),
k as (select doc_id, array_to_string(list_filter(ls, lambda x, i: (st = 0 or i < st)
          and not contains(x, 'This file contains no relevant functions/classes')), {_NL}) as body from s),
b as (select doc_id, unnest(regexp_extract_all(body, '(?s)```(?:.*?\\n)?(.*?)```', 1)) as blk from k),
c as (select doc_id, list_filter(list_transform(string_split(blk, {_NL}), lambda x: {_strip("x")}), lambda x: x <> '') as bl
      from b),
f as (select doc_id, bl[1] as rel_path, list_transform(bl[2:], lambda x: {_strip("string_split(x, ':')[-1]")}) as els
      from c where contains(bl[1], '/') or contains(bl[1], '\\')),
p as (select distinct doc_id, rel_path, unnest(els) as element from f)
select doc_id, rel_path, element from p
union all
select distinct doc_id, rel_path, cast(null as varchar) from f
where not exists (select 1 from p where p.doc_id = f.doc_id and p.rel_path = f.rel_path)"""


@register("fenced_elements", _FENCED_ELEMENTS_SQL)
def q_fenced_elements(spark, root):
    return fenced_elements(element_answers(spark, root), ["doc_id"], "answer")


# -- prompts, headers, token counts ---------------------------------------------------------------
_PROMPT = "Role: %s\nTurn: %s\n%s"


@register("render_prompt", f"""
select conv_id, turn, printf('Role: %s' || {_NL} || 'Turn: %s' || {_NL} || '%s', role, cast(turn as varchar), text) as prompt
from conversations""")
def q_render_prompt(spark, root):
    c = T(spark, root, "conversations")
    return c.select("conv_id", "turn", X.render_prompt(_PROMPT, "role", "turn", "text").alias("prompt"))


@register("with_filename_header", f"""
select doc_id, 'Filename: ' || source || '/doc_' || doc_id || '.txt' || {_NL} || {_NL} || text as indexed from documents""")
def q_with_filename_header(spark, root):
    d = T(spark, root, "documents")
    path = F.concat(F.col("source"), F.lit("/doc_"), F.col("doc_id"), F.lit(".txt"))
    return d.select("doc_id", X.with_filename_header(path, "text").alias("indexed"))


@register("token_count", r"""
select doc_id, cast(len(regexp_extract_all(text, '\w+|[^\w\s]')) as bigint) as tokens,
       len(regexp_extract_all(text, '\w+|[^\w\s]')) <= 50000 as within_cap from documents""")
def q_token_count(spark, root):
    d = T(spark, root, "documents")
    tok = X.token_count("text")
    return d.select("doc_id", tok.alias("tokens"), X.within_budget(tok, X.ELEMENT_TOKEN_CAP, strict=False).alias("within_cap"))


@register("buggy_file_counts", f"""
select doc_id, count(distinct rel_path) as n_files, count(element) as n_elements
from ({_FENCED_ELEMENTS_SQL}) x group by doc_id""")
def q_buggy_file_counts(spark, root):
    fe = fenced_elements(element_answers(spark, root), ["doc_id"], "answer")
    return fe.groupBy("doc_id").agg(F.countDistinct("rel_path").alias("n_files"), F.count("element").alias("n_elements"))
