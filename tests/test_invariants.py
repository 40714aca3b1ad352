"""Invariants from the test strategy: dense top-k ranks, snapshot coverage by carry + regenerate."""

from pyspark.sql import functions as F

from codeatlas.functions.keys import is_supported_ext, is_test_path
from codeatlas.operators.retrieval import topk_similar
from codeatlas.operators.snapshots import carry_forward, snapshot_diff, to_regenerate
from codeatlas.plans.synth import retrieval_chunks, retrieval_queries, snapshot_v1, snapshot_v2

SF = "/root/testdata/sf0.001"


def test_topk_ranks_dense(spark):
    emb = spark.read.parquet(f"{SF}/embeddings.parquet")
    chunks = retrieval_chunks(emb)
    hits = topk_similar(chunks, retrieval_queries(emb), ["label"], "chunk_id", "query_id", k=50)
    per_q = hits.groupBy("query_id", "label").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("lo"),
                                                   F.max("rank").alias("hi"), F.countDistinct("rank").alias("d"))
    cand = chunks.groupBy("label").agg(F.count(F.lit(1)).alias("c"))
    rows = per_q.join(cand, "label").collect()
    assert rows
    for r in rows:
        assert r["lo"] == 1 and r["hi"] == r["n"] == r["d"] == min(50, r["c"])


def test_carry_plus_regenerate_cover_new_snapshot_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    v1 = snapshot_v1(docs)
    v2 = snapshot_v2(docs, spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet"))
    diff = snapshot_diff(v1, v2)
    old_docs = v1.filter(is_supported_ext("rel_path")).select("rel_path", F.col("content").alias("doc"))
    carried = carry_forward(old_docs, diff, {"instance_key": "v2"}).select("rel_path")
    items = v2.filter(is_supported_ext("rel_path") & ~is_test_path("rel_path")).select("rel_path")
    regen = to_regenerate(items, diff).select("rel_path")
    both = [r["rel_path"] for r in carried.unionByName(regen).collect()]
    expect = sorted(r["rel_path"] for r in items.collect())
    assert sorted(both) == expect


def test_topk_per_instance_when_query_ids_repeat(spark):
    chunks = spark.createDataFrame([(i, c, [float(c)]) for i in (1, 2) for c in range(3)], "label int, chunk_id long, embedding array<float>")
    queries = spark.createDataFrame([(i, 0, [0.0]) for i in (1, 2)], "label int, query_id long, embedding array<float>")
    got = sorted((r["label"], r["chunk_id"]) for r in topk_similar(chunks, queries, ["label"], k=2).collect())
    assert got == [(1, 0), (1, 1), (2, 0), (2, 1)]


def test_media_of_instances_with_equal_gif_names(spark):
    from codeatlas.operators.media import frames_payload, instance_image_tokens

    gifs = spark.createDataFrame([("a", "x.gif", 1, 1), ("b", "x.gif", 1, 1)], "instance_key string, name string, height int, width int")
    frames = spark.createDataFrame([("a", "x.gif_1.png", 280, 280), ("b", "x.gif_2.png", 560, 560)],
                                   "instance_key string, frame string, height int, width int")
    assert {r["instance_key"]: r["image_tokens"] for r in instance_image_tokens(gifs, frames, ["instance_key"]).collect()} == {"a": 100, "b": 400}
    assert {r["instance_key"]: r["frames"] for r in frames_payload(gifs, frames, ["instance_key"]).collect()} == {"a": "x.gif_1.png", "b": "x.gif_2.png"}


def test_waves_with_carried_docs(spark):
    from codeatlas.operators.graph import doc_waves

    nodes = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id long")
    refs = spark.createDataFrame([(1, 2), (2, 9), (3, 8), (4, 4)], "src_id long, dst_id long")
    carried = spark.createDataFrame([(9,)], "id long")
    got = {r["id"]: (r["level"], r["forced"]) for r in doc_waves(nodes, refs, ["id"], carried).collect()}
    assert got == {2: (0, False), 1: (1, False), 3: (None, True), 4: (None, True)}


def test_gifs_of_one_name_meet_their_frames_once(spark):
    """Many gifs and frames of an instance share a name: counted and summed before the join, not paired."""
    from codeatlas.operators.media import instance_image_tokens

    gifs = spark.range(300000).selectExpr("'a' as instance_key", "'img.gif' as name", "28L as height", "28L as width")
    frames = spark.range(200000).selectExpr("'a' as instance_key", "concat('img.gif_', id, '.png') as frame", "56L as height", "56L as width")
    assert [tuple(r) for r in instance_image_tokens(gifs, frames, ["instance_key"]).collect()] == [("a", 300000 * 200000 * 4)]
