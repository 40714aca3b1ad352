"""Retrieval queries: top-k similarity join, retrieved files, chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.retrieval import chunk_fixed, chunk_recursive, retrieved_files, topk_candidates, topk_similar
from .registry import T, register
from .synth import QUERY_BUCKETS, retrieval_chunks, retrieval_queries

_Q_SQL = """
with parts as (
  select label, cast(label as bigint) * 3 + vec_id % 3 as query_id,
         unnest(range(0, len(embedding))) as d, unnest(embedding) as x
  from embeddings),
cent as (select label, query_id, d, avg(cast(x as double)) as m from parts group by label, query_id, d),
q as (select label, query_id, list(m order by d) as v from cent group by label, query_id),
pairs as (
  select q.label, q.query_id, e.vec_id as chunk_id,
         'file_' || cast(floor(e.vec_id / 10) as bigint) as rel_path,
         list_distance(cast(e.embedding as double[]), q.v) as dist
  from embeddings e join q on e.label = q.label),
ranked as (select *, row_number() over (partition by query_id order by dist, chunk_id) as rnk from pairs)
"""


def _hits(spark, root):
    emb = T(spark, root, "embeddings")
    return topk_similar(retrieval_chunks(emb), retrieval_queries(emb), ["label"], "chunk_id", "query_id", k=50)


@register("topk_similar", _Q_SQL + """
select label, query_id, chunk_id, cast(rnk as bigint) as rank from ranked where rnk <= 50""")
def q_topk_similar(spark, root):
    return _hits(spark, root).select("label", "query_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


@register("retrieved_files", _Q_SQL + """
select label, rel_path, cast(min(rnk) as bigint) as best_rank from ranked where rnk <= 50
group by label, rel_path""")
def q_retrieved_files(spark, root):
    return retrieved_files(_hits(spark, root), ["label"], "rel_path") \
        .select("label", "rel_path", F.col("best_rank").cast("long").alias("best_rank"))


@register("chunk_fixed", """
select doc_id, cast(s // 450 as bigint) as pos, cast(s + 1 as bigint) as start,
       substr(text, cast(s + 1 as bigint), 500) as chunk
from (select doc_id, text, unnest(range(0, greatest(length(text) - 51, 0) + 1, 450)) as s from documents)""")
def q_chunk_fixed(spark, root):
    docs = T(spark, root, "documents").select("doc_id", "text")
    return chunk_fixed(docs, "text").select("doc_id", F.col("pos").cast("long").alias("pos"),
                                            F.col("start").cast("long").alias("start"), "chunk")


# The next cut is sought behind the last one, up to a chunk's size from the chunk's begin.
_ROOM = "(greatest(cut - 50, 0) + 500 - cut)"
_REACH = f"substr(text, cut + 1, {_ROOM})"
_CUT = f"""cut + coalesce({", ".join(f"nullif(length(regexp_extract({_REACH}, '(?s)^(.*{b})', 1)), 0)" for b in (r"\n\n", r"\n", " "))},
                  {_ROOM})"""
_CHUNKS_SQL = f"""
with recursive d as (select doc_id, text from documents where text <> ''),
r as (select doc_id, 0::bigint as before, 0::bigint as cut, 0::bigint as pos, false as done from d
      union all
      select doc_id, cut, case when last then length(text) else {_CUT} end, pos + 1, last
      from (select r.*, d.text, greatest(cut - 50, 0) + 500 >= length(d.text) as last from r join d using (doc_id) where not done))
select doc_id, pos - 1 as pos, substr(text, greatest(before - 50, 0) + 1, cut - greatest(before - 50, 0)) as chunk
from r join d using (doc_id) where pos > 0"""


@register("chunk_recursive", _CHUNKS_SQL)
def q_chunk_recursive(spark, root):
    docs = T(spark, root, "documents").select("doc_id", "text")
    return chunk_recursive(docs, ["doc_id"], "text").select("doc_id", F.col("pos").cast("long").alias("pos"), "chunk")


_SHARED_SQL = _Q_SQL.replace("cast(label as bigint) * 3 + vec_id % 3 as query_id", "vec_id % 3 as query_id") \
    .replace("partition by query_id", "partition by label, query_id")


@register("topk_shared_ids", _SHARED_SQL + """
select label, query_id, chunk_id, cast(rnk as bigint) as rank from ranked where rnk <= 50""")
def q_topk_shared_ids(spark, root):
    """Every instance numbers its queries from 0."""
    emb = T(spark, root, "embeddings")
    queries = retrieval_queries(emb).withColumn("query_id", F.col("query_id") - F.col("label").cast("long") * QUERY_BUCKETS)
    hits = topk_similar(retrieval_chunks(emb), queries, ["label"], "chunk_id", "query_id", k=50)
    return hits.select("label", "query_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


@register("topk_candidates", _Q_SQL + """
select label, query_id, chunk_id, cast(rnk as bigint) as rank from ranked where rnk <= 20""")
def q_topk_candidates(spark, root):
    """The same ranks through the hash index, completed to the exact result."""
    emb = T(spark, root, "embeddings")
    hits = topk_candidates(retrieval_chunks(emb), retrieval_queries(emb), ["label"], "chunk_id", "query_id", k=20)
    return hits.select("label", "query_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


@register("topk_unsound", _Q_SQL.replace("list_distance(cast(e.embedding as double[]), q.v) as dist", "list_distance(cast(e.embedding as double[]), q.v) as dist, e.vec_id")
          .replace("from embeddings e join q on e.label = q.label", "from embeddings e join q on e.label = q.label where e.vec_id % 9 > 2") + """
select label, query_id, chunk_id, cast(rnk as bigint) as rank from ranked where rnk <= 50""")
def q_topk_unsound(spark, root):
    """A third of the chunks has no vector, a short one, or one with a null in it: none of them is a hit."""
    emb = T(spark, root, "embeddings")
    short, hole = F.slice("embedding", 1, 10), F.concat(F.slice("embedding", 1, 63), F.array(F.lit(None).cast("float")))
    bad = F.when(F.col("vec_id") % 9 == 1, short).when(F.col("vec_id") % 9 == 2, hole).when(F.col("vec_id") % 9 > 2, F.col("embedding"))
    chunks = retrieval_chunks(emb.withColumn("embedding", bad))
    hits = topk_similar(chunks, retrieval_queries(emb), ["label"], "chunk_id", "query_id", k=50)
    return hits.select("label", "query_id", "chunk_id", F.col("rank").cast("long").alias("rank"))
