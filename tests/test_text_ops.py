"""Invariants of the recursive splitter and brute-force checks of the substring join."""

import random


from codeatlas.operators.context import contains_join, match_paths
from codeatlas.operators.retrieval import chunk_recursive

SF = "/root/testdata/sf0.001"


def test_chunk_recursive_invariants(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    chunks = chunk_recursive(docs, ["doc_id"], "text").toPandas()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert (chunks["chunk"].str.len() <= 500).all()
    for doc_id, g in chunks.sort_values(["doc_id", "pos"]).groupby("doc_id"):
        parts = list(g["chunk"])
        # A chunk begins 50 characters before the last cut, or where the text does.
        read = ""
        for part in parts:
            early = min(50, len(read))
            assert read.endswith(part[:early])
            read += part[early:]
        assert read == texts[doc_id]
        assert list(g["pos"]) == list(range(len(g)))
    assert set(chunks["doc_id"]) == {k for k, t in texts.items() if t}


def test_chunk_recursive_breaks_and_edges(spark):
    # Chunks of at most 6 characters that share one; what fits is one chunk.
    rows = [(1, "ab\n\ncdefgh"), (2, "abc de fghi"), (3, "x" * 10), (4, ""), (5, None), (6, "\U0001f600" * 8), (7, "a\nb cd efg"), (8, "short")]
    df = spark.createDataFrame(rows, "id int, text string")
    got = {}
    for r in sorted(chunk_recursive(df, ["id"], "text", size=6, overlap=1).collect(), key=lambda r: (r["id"], r["pos"])):
        got.setdefault(r["id"], []).append(r["chunk"])
    assert got == {1: ["ab\n\n", "\ncdefg", "gh"], 2: ["abc ", " de ", " fghi"], 3: ["x" * 6, "x" * 5],
                   6: ["\U0001f600" * 6, "\U0001f600" * 3], 7: ["a\n", "\nb cd ", " efg"], 8: ["short"]}


def test_contains_join_matches_brute_force(spark):
    rnd = random.Random(5)
    alpha = "ab/._"
    paths = ["".join(rnd.choice(alpha) for _ in range(rnd.randint(1, 14))) for _ in range(60)]
    needles = ["".join(rnd.choice(alpha) for _ in range(rnd.randint(1, 11))) for _ in range(40)]
    h = spark.createDataFrame([(p,) for p in paths], "rel_path string")
    n = spark.createDataFrame([(x,) for x in needles], "needle string")
    got = {(r["rel_path"], r["needle"]) for r in contains_join(h, n, [], "rel_path", "needle").collect()}
    want = {(p, x) for p in set(paths) for x in set(needles) if x in p}
    assert got == want


def test_match_paths_suffix_and_substring(spark):
    files = spark.createDataFrame([("i", "src/a.js"), ("i", "src/aa.jsx"), ("j", "lib/a.js")], "k string, rel_path string")
    needles = spark.createDataFrame([("i", "a.js"), ("i", "src/a.js")], "k string, needle string")
    suf = sorted((r["rel_path"], r["needle"]) for r in match_paths(needles, files, ["k"]).collect())
    sub = sorted((r["rel_path"], r["needle"]) for r in match_paths(needles, files, ["k"], mode="substring").collect())
    assert suf == [("src/a.js", "a.js"), ("src/a.js", "src/a.js")]
    assert sub == [("src/a.js", "a.js"), ("src/a.js", "src/a.js"), ("src/aa.jsx", "a.js")]


def test_instances_are_hashed_not_sorted(spark):
    """Rows stream past their instances: neither side is sorted, and null or repeated keys count as before."""
    from codeatlas.operators.context import attach_instance

    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (3, "e")], "k int, v string")
    instances = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (None, "n")], "k int, s string")
    joined, missing = attach_instance(rows, instances, ["k"])
    assert sorted(map(tuple, joined.collect())) == [(1, "a", "x"), (1, "a", "y"), (1, "b", "x"), (1, "b", "y"), (2, "c", "z")]
    assert sorted(map(tuple, missing.collect()), key=str) == [(3, "e"), (None, "d")]
    for df in (joined, missing):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "Sort " not in plan
