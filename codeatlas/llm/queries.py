"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources.tables import table
from . import bestfit, chat, dialogue, filteraudit, fingerprints, langid, mixing, packing, sharding, simhash, tokenfiles, vectors, warc
from .common import on_workers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_checkpoint_dir(spark)
            on_workers(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run
    return deco


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_language_id")
def op1(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


@query("op3_pivotal_mixing")
def op3(spark, sf_dir):
    return mixing.mixed(table(spark, sf_dir, "documents")).drop("key")


@query("op7_packing")
def op7(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


@query("op8_simhash")
def op8(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op4_fingerprints")
def op4(spark, sf_dir):
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


@query("op10_sharding")
def op10(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"))


@query("op2_warc", """
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, cast(strlen(h) as bigint) as payload_bytes, sha256(h) as payload_digest from p),
m as (select *, min(page_id) over (partition by payload_digest) as low from d)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 100 and page_id <> low then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and page_id <> low then low end as refers_to
from m""")
def op2(spark, sf_dir):
    return warc.archive(table(spark, sf_dir, "pages"))


@query("op5_chat", r"""
with r as (
  select conv_id, turn, role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
o as (select *, lag(role) over w as before, row_number() over w as n, count(*) over (partition by conv_id) as last
      from r window w as (partition by conv_id order by turn, role, text)),
e as (select *, length(regexp_replace(replace(text, '\', '\\'),
        '([\[<])(SYS\]|/SYS\]|INST\]|/INST\]|s>|/s>|TURN\]|/TURN\]|AS\]|NONE\])', '\1\\\2', 'g')) as body,
      coalesce(case when n = 1 then role in ('system', 'user')
                    when before = 'system' or before = 'assistant' then role = 'user'
                    when before = 'user' then role = 'assistant' end, false) as allowed
      from o)
select conv_id, count(*) as n_turns,
       sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' order by n)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by n) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(body + case role when 'system' then 11 when 'user' then 13 when 'assistant' then 7
                else 17 + coalesce(length(role), 6) end) as bigint) as formatted_chars,
       bool_and(allowed) as valid,
       bool_and(allowed) and bool_or(n = last and role = 'assistant') as complete
from e group by conv_id""")
def op5(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.format_and_read(rows.unionByName(own))


@query("op9_vector_graph")
def op9(spark, sf_dir):
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op6_id_blocks")
def op6(spark, sf_dir):
    return tokenfiles.encode_and_read(table(spark, sf_dir, "documents"), tokenizer_path())


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage of op11, by crc32 of ``conv_id:turn`` (nulls: one space)."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(name) % 20
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
                                kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("copy"))


_CRC = "list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({}, ''), lambda x: ord(x)::bigint)), " \
       "lambda c, b: xor(c // 256, t[(xor(c, b) & 255) + 1]))"


@query("op11_dialogue_repair", f"""
with recursive crc as (select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
      lambda c, z: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) as t),
named as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
                 coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations),
kinds as (select named.*, xor({_CRC.format("k")}, 4294967295) % 20 as kind from named, crc),
dam as (select conv_id, turn, case when kind = 4 then 'user' else role end as role,
               case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
               unnest(range(case when kind = 3 then 2 else 1 end)) as copy from kinds where kind <> 0),
o as (select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn nulls first, role, text) as n from dam),
f as (select *, left(role, 1) as ini, lag(left(role, 1)) over (partition by conv_id order by n) as ini_before,
             case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'b'
                  when row_number() over (partition by conv_id, role, text order by n) > 1 then 'd'
                  when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 't' else '' end as fault from o),
start as (select {{'c': 0, 'a': ''}} as e, {{'c': 1000000000, 'a': ''}} as never),
s as (
  select distinct conv_id, 0::bigint as n, e as s0, never as s1, {{'c': 5, 'a': 'I'}} as s2, {{'c': 10, 'a': 'II'}} as s3
  from f, start
  union all
  select conv_id, n, e0, e1, m2, list_min([e3, {{'c': m2.c + 5, 'a': m2.a || 'I'}}])
  from (select *, list_min([e2, {{'c': e0.c + 5, 'a': e0.a || 'I'}}, {{'c': e1.c + 5, 'a': e1.a || 'I'}}, {{'c': e3.c + 5, 'a': e3.a || 'I'}}]) as m2
    from (select s.conv_id, f.n,
            {{'c': s0.c + 2, 'a': s0.a || 'D'}} as e0,
            list_min([{{'c': s1.c + 2, 'a': s1.a || 'D'}}, {{'c': s0.c + ks, 'a': s0.a || 'K'}}]) as e1,
            list_min([{{'c': s2.c + 2, 'a': s2.a || 'D'}}, {{'c': low.c + ku, 'a': low.a || 'K'}}, {{'c': low.c + re, 'a': low.a || 'R'}}]) as e2,
            list_min([{{'c': s3.c + 2, 'a': s3.a || 'D'}}, {{'c': s2.c + ka, 'a': s2.a || 'K'}}, {{'c': s2.c + re, 'a': s2.a || 'R'}}]) as e3
          from (select *, list_min([s0, s1, s3]) as low from s) s join (
            select *, case when fault in ('b', 'd') or ini <> 's' then 1000000000 when fault = 't' then 5 else 0 end as ks,
                   case when fault in ('b', 'd') or ini <> 'u' then 1000000000 when fault = 't' then 5 else 0 end as ku,
                   case when fault in ('b', 'd') or ini <> 'a' then 1000000000 when fault = 't' then 5 else 0 end as ka,
                   case when fault in ('b', 'd') then 1000000000 when fault = 't' then 6 else 1 end as re from f) f
            on f.conv_id is not distinct from s.conv_id and f.n = s.n + 1))),
best as (select conv_id, max_by(list_min([s0, s3]), n) as b from s group by conv_id),
edits as (select conv_id, unnest(string_split(b.a, '')) as e, unnest(range(1, length(b.a) + 1)) as p from best where b.a <> ''),
placed as (select *, count(*) filter (e <> 'I') over (partition by conv_id order by p) as n from edits),
outs as (select p.conv_id, p.p, p.e, f.role, f.text, f.ini from placed p left join f
         on f.conv_id is not distinct from p.conv_id and f.n = p.n and p.e <> 'I' where p.e <> 'D'),
roles as (select *, row_number() over w as q, first_value(case when e = 'K' and ini = 's' then 1 else 0 end) over w as sys
          from outs window w as (partition by conv_id order by p)),
fixed as (select conv_id, string_agg(case when e = 'K' then role when (q - sys) % 2 = 1 then 'user' else 'assistant' end || ':'
                 || case when e = 'I' then '' else text end, chr(10) order by q) as body from roles group by conv_id),
sums as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (fault = 'b') as blank,
                count(*) filter (fault = 'd') as duplicate, count(*) filter (fault = 't') as truncated,
                count(*) filter (ini_before is not null and ini_before || ini not in ('su', 'ua', 'au')) as illegal
         from f group by conv_id)
select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
       coalesce(illegal, 0) as illegal, coalesce(b.c, 0)::bigint as cost, coalesce(b.a, '') as audit, sha256(coalesce(body, '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join sums on sums.conv_id is not distinct from c.conv_id
left join best on best.conv_id is not distinct from c.conv_id left join fixed on fixed.conv_id is not distinct from c.conv_id""")
def op11(spark, sf_dir):
    return repair_report(table(spark, sf_dir, "conversations"))


def repair_report(conversations: DataFrame) -> DataFrame:
    """Damage, repair and the digest columns per original conv_id."""
    rows, found, fixed = dialogue.repair(damaged(conversations))
    span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    gaps = rows.groupBy("ck").agg(F.coalesce(span, F.lit(0)).cast("long").alias("gaps"))
    report = (conversations.select("conv_id").distinct().withColumn("ck", dialogue.conversation_key(F.col("conv_id")))
              .join(found.drop("rows"), "ck", "left").join(gaps, "ck", "left").join(dialogue.digests(fixed), "ck", "left"))
    empty = F.sha2(F.lit(""), 256)
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return report.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers],
                         F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))


@query("op12_vector_best_fit")
def op12(spark, sf_dir):
    return bestfit.packed(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


@query("op13_filter_audit", r"""
with w as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t,
                  regexp_extract_all(coalesce(text, ''), '[^ 	-]+') as ws,
                  min(doc_id) over (partition by coalesce(text, '')) as low from documents),
l as (select doc_id, coalesce(bool_or(quality = 1), false)::bigint as good, coalesce(bool_or(toxic = 1), false)::bigint as toxic
      from labels group by doc_id),
m as (select part, (len(ws) < 50)::int + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::int
             + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::int
             + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(w.doc_id > low, false)::int as mask,
             coalesce(good, 0) as good, coalesce(toxic, 0) as toxic from w left join l on l.doc_id = w.doc_id),
g as (select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from m group by part, mask),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) as f, unnest([1, 2, 4, 8, 16]) as bit),
p as (select a.f || b.f || c.f || d.f || e.f as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
      from x a join x b on b.f <> a.f join x c on c.f not in (a.f, b.f) join x d on d.f not in (a.f, b.f, c.f)
      join x e on e.f not in (a.f, b.f, c.f, d.f)),
s as (select filter_order, i::int as step, bits[i] as bit, coalesce(list_sum(bits[1:i - 1]), 0)::int as prior
      from p, (select unnest(range(1, 6)) as i)),
r as (select g.part, s.filter_order, s.step, s.bit,
             coalesce(sum(n) filter (mask & (prior | bit) = 0), 0)::bigint as kept,
             coalesce(sum(n) filter (mask & bit <> 0 and mask & prior = 0), 0)::bigint as removed,
             coalesce(sum(n) filter (mask & bit <> 0 and mask & prior <> 0), 0)::bigint as redundant,
             coalesce(sum(n) filter (mask = bit), 0)::bigint as unique_fails,
             coalesce(sum(good) filter (mask & bit <> 0 and mask & prior = 0), 0)::bigint as good_lost,
             coalesce(sum(toxic) filter (mask & bit <> 0 and mask & prior = 0), 0)::bigint as toxic_lost
      from g, s group by g.part, s.filter_order, s.step, s.bit)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) over (partition by part, bit)::bigint as shapley from r""")
def op13(spark, sf_dir):
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
