"""A code-shaped fixture derived from `part`: one JavaScript/TypeScript unit per part row,
FILE_UNITS consecutive part keys per file, INSTANCE_FILES files per repository snapshot.

Unit kinds (p_size % 4), line by line:

0  ``import { fn_q } from './mod_<q div 40><ext>';`` / [``// <p_name>`` when p_size % 3 = 0] /
   ``function fn_<pk>(a, b) {`` / ``  const v = fn_q(a) + b;`` / [``  return v;`` when p_size even] / ``}``
1  ``class Part<pk> {`` / ``  get_<pk>(x) {`` / ``    return fn_q(x);`` / ``  }`` /
   ``  static make() { return new Part<pk>(); }`` / ``}``
2  ``import util from '../lib/util_<pk % 5>';`` / [``/* arrow <p_name>`` / `` * helper */`` / ``''`` when
   p_size % 3 = 0] / ``const arrow_<pk> = (a) => {`` / ``  const items = [a].map((y) => y + 1);`` /
   ``  return util(items);`` / ``};``
3  ``interface Shape<pk> {`` / ``  size: number;`` / ``}`` / ``const one_<pk> = (z) => z * 2;``

with q = max(pk - 40, 0) (the same slot in the previous file, imported with its extension).
A file is a 3-line header (comment, ``import React from 'react';``, an import
of its own stylesheet) followed by its units separated by blank lines.  The generator's arithmetic
gives the true elements, spans, comments, returns, calls and imports; the SQL twins of the code
queries are computed from that arithmetic, while the Spark queries parse the generated text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILE_UNITS = 40
INSTANCE_FILES = 10
HEADER_LINES = 3


def _units(part: DataFrame) -> DataFrame:
    pk = F.col("p_partkey")
    q = F.greatest(pk - FILE_UNITS, F.lit(0)).cast("long")
    q_file = F.floor(q / FILE_UNITS).cast("long")
    q_ext = F.when(q_file % 3 == 0, F.lit(".ts")).otherwise(F.lit(".js"))
    kind = (F.col("p_size") % 4).cast("int")
    c0 = F.col("p_size") % 3 == 0
    even = F.col("p_size") % 2 == 0
    s = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs])
    k0 = F.concat_ws("\n",
                     s("import { fn_", q, " } from './mod_", q_file, q_ext, "';"),
                     F.when(c0, s("// ", F.col("p_name"))),
                     s("function fn_", pk, "(a, b) {"),
                     s("  const v = fn_", q, "(a) + b;"),
                     F.when(even, F.lit("  return v;")),
                     F.lit("}"))
    k1 = F.concat_ws("\n", s("class Part", pk, " {"), s("  get_", pk, "(x) {"), s("    return fn_", q, "(x);"),
                     F.lit("  }"), s("  static make() { return new Part", pk, "(); }"), F.lit("}"))
    k2 = F.concat_ws("\n",
                     s("import util from '../lib/util_", pk % 5, "';"),
                     F.when(c0, s("/* arrow ", F.col("p_name"), "\n * helper */\n")),
                     s("const arrow_", pk, " = (a) => {"),
                     F.lit("  const items = [a].map((y) => y + 1);"),
                     F.lit("  return util(items);"),
                     F.lit("};"))
    k3 = F.concat_ws("\n", s("interface Shape", pk, " {"), F.lit("  size: number;"), F.lit("}"),
                     s("const one_", pk, " = (z) => z * 2;"))
    unit = F.when(kind == 0, k0).when(kind == 1, k1).when(kind == 2, k2).otherwise(k3)
    file_no = F.floor(pk / FILE_UNITS).cast("long")
    ext = F.when(file_no % 3 == 0, F.lit(".ts")).otherwise(F.lit(".js"))
    return part.select(
        F.concat(F.lit("repo"), F.floor(pk / (FILE_UNITS * INSTANCE_FILES)).cast("string")).alias("instance_key"),
        F.concat(F.lit("src/mod_"), file_no.cast("string"), ext).alias("rel_path"),
        file_no.alias("file_no"), pk.alias("pk"), unit.alias("unit"))


def source_files(part: DataFrame) -> DataFrame:
    """``(instance_key, rel_path, content)``: units of a file in key order after the header.
    Gathering a file's units is bounded by FILE_UNITS rows per file."""
    u = _units(part)
    files = u.groupBy("instance_key", "rel_path", "file_no").agg(
        F.array_sort(F.collect_list(F.struct("pk", "unit"))).alias("_u"))
    header = F.concat(F.lit("// module "), F.col("file_no").cast("string"), F.lit("\nimport React from 'react';\n"),
                      F.lit("import './mod_"), F.col("file_no").cast("string"), F.lit(".css';"))
    body = F.array_join(F.transform("_u", lambda x: x["unit"]), "\n\n")
    return files.select("instance_key", "rel_path", F.concat(header, F.lit("\n"), body).alias("content"))


# SQL twin of the fixture facts: one row per unit with its first line in the file.
UNITS_SQL = f"""
(select *, {HEADER_LINES} + 1 + coalesce(sum(ulen + 1) over (partition by rel_path order by pk
            rows between unbounded preceding and 1 preceding), 0) as u0,
        coalesce(sum(nfun) over (partition by rel_path order by pk rows between unbounded preceding and 1 preceding), 0)
          as fun_before,
        coalesce(sum(case when kind = 1 then 1 else 0 end) over (partition by rel_path order by pk
            rows between unbounded preceding and 1 preceding), 0) as cls_before
 from (select 'repo' || (p_partkey // {FILE_UNITS * INSTANCE_FILES}) as instance_key,
              'src/mod_' || (p_partkey // {FILE_UNITS}) || case when (p_partkey // {FILE_UNITS}) % 3 = 0 then '.ts'
                 else '.js' end as rel_path,
              p_partkey // {FILE_UNITS} as file_no,
              p_partkey as pk, greatest(p_partkey - {FILE_UNITS}, 0) as q, p_size % 4 as kind, p_name,
              case when p_size % 3 = 0 then 1 else 0 end as c, case when p_size % 2 = 0 then 1 else 0 end as r,
              case p_size % 4 when 0 then 4 + (case when p_size % 3 = 0 then 1 else 0 end)
                                          + (case when p_size % 2 = 0 then 1 else 0 end)
                              when 1 then 6
                              when 2 then 5 + (case when p_size % 3 = 0 then 3 else 0 end)
                              else 4 end as ulen,
              case p_size % 4 when 0 then 1 when 1 then 0 when 2 then 2 else 1 end as nfun
       from part))"""


def _unit_lines_sql() -> str:
    return """list_filter(case kind
      when 0 then ['import { fn_' || q || ' } from ''./mod_' || (q // 40)
                   || case when (q // 40) % 3 = 0 then '.ts' else '.js' end || ''';',
                   case when c = 1 then '// ' || p_name end,
                   'function fn_' || pk || '(a, b) {', '  const v = fn_' || q || '(a) + b;',
                   case when r = 1 then '  return v;' end, '}']
      when 1 then ['class Part' || pk || ' {', '  get_' || pk || '(x) {', '    return fn_' || q || '(x);', '  }',
                   '  static make() { return new Part' || pk || '(); }', '}']
      when 2 then ['import util from ''../lib/util_' || (pk % 5) || ''';',
                   case when c = 1 then '/* arrow ' || p_name end, case when c = 1 then ' * helper */' end,
                   case when c = 1 then '' end,
                   'const arrow_' || pk || ' = (a) => {', '  const items = [a].map((y) => y + 1);',
                   '  return util(items);', '};']
      else ['interface Shape' || pk || ' {', '  size: number;', '}', 'const one_' || pk || ' = (z) => z * 2;'] end,
      lambda x: x is not null)"""


# One row per file: its lines, exactly as the Spark generator lays them out.
FILE_LINES_SQL = f"""
(select instance_key, rel_path,
        ['// module ' || file_no, 'import React from ''react'';', 'import ''./mod_' || file_no || '.css'';']
        || (flatten(list(ul || [''] order by pk)))[1:-2] as fl
 from (select *, {_unit_lines_sql()} as ul from {UNITS_SQL}) group by instance_key, rel_path, file_no)"""


SHAPE_LINES = 14


def shape_files(part: DataFrame, broken: bool = False) -> DataFrame:
    """``(instance_key, rel_path, pk, content)``: one file per part row with the shapes that line rules miss: names in a
    template, a block comment and a regular expression, code within a template, parameters over lines and as a
    pattern, several declarations on a line.  ``broken``: four files of five end in an open or surplus
    bracket, comment or template, and every eleventh has no content."""
    pk = F.col("p_partkey").cast("string")
    text = F.concat(
        F.lit("const text = `\nclass Fake"), pk, F.lit(" { ${[1].map((t) => `x ${t}`)}\n`;\n/*\nfunction dead"), pk, F.lit("() {\n*/\nfunction live"), pk,
        F.lit("(s) { return /[{]/.test(s); } function two"), pk, F.lit("({a, b}, c) { }\nconst far = (\n  u,\n  v\n) => {\n  return u + v;\n};\nclass Box"), pk,
        F.lit(" { m(q) { return q; } n() { } }"))
    key = F.col("p_partkey")
    if broken:
        end = F.element_at(F.array(*[F.lit(x) for x in ("", "\nfunction open() {", "\n}", "\n/* open", "\nconst s = `open")]), (key % 5 + 1).cast("int"))
        text = F.when(key % 11 != 0, F.concat(text, end))
    return part.select(F.concat(F.lit("repo"), (key % 7).cast("string")).alias("instance_key"),
                       F.concat(F.lit("src/shape_"), pk, F.lit(".js")).alias("rel_path"), key.alias("pk"), text.alias("content"))
