"""Worked examples for the scalar functions and small operators (see FIXTURES.md)."""

import pytest
from pyspark.sql import functions as F

from codeatlas.functions import keys as K
from codeatlas.functions import text as X
from codeatlas.functions.media import image_tokens, snapped_size
from codeatlas.operators.graph import doc_waves, resolve_import
from codeatlas.operators.snapshots import carry_forward, snapshot_diff
from codeatlas.operators.usage import attempt_outcomes


@pytest.mark.parametrize("w,h,snapped,tokens", [
    (1920, 1080, (1316, 728), 1222), (10, 10, (56, 56), 4), (70, 70, (56, 56), 4),
    (42, 14, (112, 56), 8), (640, 480, (644, 476), 391), (1003, 1001, (980, 980), 1225), (None, None, (0, 0), 0),
])
def test_image_tokens(spark, w, h, snapped, tokens):
    df = spark.createDataFrame([(w, h)], "w int, h int")
    hb, wb = snapped_size(F.col("h"), F.col("w"))
    r = df.select(hb.alias("hb"), wb.alias("wb"), image_tokens(F.col("h"), F.col("w")).alias("t")).first()
    assert (r["wb"], r["hb"]) == snapped and r["t"] == tokens


@pytest.mark.parametrize("src,spec,dst", [
    ("p/src/a.js", "./b", "p/src/b.js"), ("p/src/a.ts", "../lib/c", "p/lib/c.ts"),
    ("p/src/x/a.jsx", "../../d.ts", "p/d.ts"), ("p/src/a.js", "react", "react.js"),
    ("p/src/a.js", "./../z", "p/src/../z.js"), ("p/src/a.js", "./s.css", None), ("p/src/a.js", "jquery.min", None),
])
def test_resolve_import(spark, src, spec, dst):
    df = spark.createDataFrame([(src, spec)], "src string, spec string")
    assert df.select(resolve_import(F.col("src"), F.col("spec")).alias("d")).first()["d"] == dst


def test_keys(spark):
    df = spark.createDataFrame([("org/name", "org__name-1234", "r/o/n/7/src/a.js", "x.min.js")],
                               "repo string, iid string, p string, m string")
    r = df.select(K.instance_key("repo", "iid").alias("k"), K.rel_path("p").alias("rp"), K.basename("p").alias("b"),
                  K.minified_twin("m").alias("t"), K.is_test_path(F.lit("a/latest/x.js")).alias("lit"),
                  K.is_test_path(F.lit("a/latest/x.js"), strict=True).alias("strict")).first()
    assert r["k"] == "org/name/1234" and r["rp"] == "src/a.js" and r["b"] == "a.js" and r["t"] == "x.js"
    assert r["lit"] is True and r["strict"] is False


def test_doc_section_and_summary(spark):
    doc = "**f**: x\n**parameters**: p\n**Code Description**: d1\n  d2\n**Note**: n\nz"
    df = spark.createDataFrame([(doc,), (doc.replace("**Note**: n\n", ""),)], "doc string")
    rows = df.select(X.doc_section("doc").alias("s"), X.doc_summary("doc").alias("m")).collect()
    assert rows[0]["s"] == "**Code Description**: d1\nd2\n"
    assert rows[0]["m"] == "**parameters**: p\n**Code Description**: d1\nd2\n"
    assert rows[1]["s"].endswith("d2\nz\n")


def test_issue_fields(spark):
    t = "### Answer 1\n**Wrong Behavior**: w\n**Cause**: c **Summary**: kept\n**Summary**: s1\ncontinued"
    df = spark.createDataFrame([(t,)], "t string")
    got = [(r["field"], r["value"]) for r in df.select(F.inline(X.issue_fields("t"))).collect()]
    assert got == [("Wrong Behavior", "w"), ("Cause", "c **Summary**: kept"), ("Summary", "s1")]


def test_doc_waves_fixture(spark):
    refs = [(2, 1), (3, 2), (4, 2), (4, 3), (5, 6), (6, 5), (7, 99)]
    nodes = spark.createDataFrame([(i,) for i in range(1, 9)], "id long")
    r = spark.createDataFrame(refs, "src_id long, dst_id long")
    got = {row["id"]: (row["level"], row["forced"]) for row in doc_waves(nodes, r, ["id"]).collect()}
    assert got[1] == (0, False) and got[8] == (0, False) and got[2] == (1, False)
    assert got[3] == (2, False) and got[4] == (3, False)
    assert all(got[i][1] for i in (5, 6, 7))


def test_attempt_outcomes(spark):
    rows = [("a", 1, "ERROR", 5), ("a", 2, "ok", 7),
            ("b", 1, "ERROR", 1), ("b", 2, "ERROR", 1), ("b", 3, "ERROR", 1), ("b", 4, "ok", 9),
            ("c", 1, "400", 1), ("c", 2, "ok", 3)]
    df = spark.createDataFrame(rows, "task string, n long, status string, prompt_tokens long")
    got = {r["task"]: (r["outcome"], r["attempts_used"], r["prompt_tokens"])
           for r in attempt_outcomes(df, ["task"], ["n"], max_try=3).collect()}
    assert got == {"a": ("success", 2, 7), "b": ("exhausted", 3, 0), "c": ("rejected", 1, 0)}


def test_snapshot_diff_and_carry_forward(spark):
    old = spark.createDataFrame([("a.js", "1"), ("b.js", "1"), ("c.css", "1"), ("d/e.ts", "1")], "rel_path string, content string")
    new = spark.createDataFrame([("a.js", "2"), ("b.js", "1"), ("f/g.ts", "1")], "rel_path string, content string")
    diff = snapshot_diff(old, new)
    got = sorted((r["level"], r["change"], r["path"]) for r in diff.collect())
    assert got == [("file", "added", "f/g.ts"), ("file", "modified", "a.js"), ("file", "removed", "d/e.ts"),
                   ("folder", "added", "f"), ("folder", "removed", "d")]
    docs = spark.createDataFrame([("a.js", "A"), ("a.jsx", "AX"), ("b.js", "B")], "rel_path string, doc string")
    ours = sorted(r["rel_path"] for r in carry_forward(docs, diff, {"instance_key": "v2"}).collect())
    literal = sorted(r["rel_path"] for r in carry_forward(docs, diff, {"instance_key": "v2"}, literal_substring=True).collect())
    assert ours == ["a.jsx", "b.js"] and literal == ["b.js"]


def test_token_count_pluggable(spark):
    df = spark.createDataFrame([("a b c",), ("",), (None,)], "t string")
    counter = X.token_count_udf(str.split)
    got = [r["n"] for r in df.select(counter("t").alias("n")).collect()]
    assert got == [3, 0, 0]
    approx = [r["n"] for r in df.select(X.token_count("t").alias("n")).collect()]
    assert approx == [3, 0, 0]


def test_diffs_of_files_without_content(spark):
    from codeatlas.operators.context import element_diff

    rows = lambda **kv: spark.createDataFrame([(f"{k}.js", v) for k, v in kv.items()], "rel_path string, content string")
    old, new = rows(a=None, b=None, c="x", d=None), rows(a=None, b="y", c=None, e=None)
    want = {("b.js", "modified"), ("c.js", "modified"), ("d.js", "removed"), ("e.js", "added")}
    assert {(r["path"], r["change"]) for r in snapshot_diff(old, new).collect()} == want
    assert {(r["rel_path"], r["change"]) for r in element_diff(old, new, ["rel_path"]).collect()} == want


def test_unsound_vectors_are_not_hits(spark):
    from codeatlas.operators.retrieval import topk_similar

    nan = float("nan")
    chunks = spark.createDataFrame([("i", 1, None), ("i", 2, [1.0]), ("i", 3, [1.0, None]), ("i", 4, [nan, 1.0]), ("i", 5, []),
                                    ("i", 6, [0.0, 1.0]), ("i", 7, [0.0, 2.0]), (None, 8, [0.0, 1.0])], "k string, chunk_id long, embedding array<float>")
    q = spark.createDataFrame([("i", 1, [0.0, 1.0]), ("i", 2, None), ("i", 3, [nan, 0.0]), (None, 4, [0.0, 1.0])],
                              "k string, query_id long, embedding array<float>")
    got = topk_similar(chunks, q, ["k"], k=2).collect()
    assert [(r["query_id"], r["chunk_id"], r["dist"], r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 6, 0.0, 1), (1, 7, 1.0, 2)]


def test_candidates_completed_equal_the_exact_result(spark):
    import random

    from codeatlas.operators.retrieval import hit_recall, topk_candidates, topk_similar

    rng = random.Random(3)
    centres = [[rng.gauss(0, 4) for _ in range(8)] for _ in range(12)]
    rows = [(rng.choice(["a", "b", None]), i, [x + rng.gauss(0, .5) for x in rng.choice(centres)]) for i in range(900)]
    rows += [("a", 900 + i, rows[0][2]) for i in range(5)] + [("c", 950, [1.0, 2.0]), ("a", 951, None), ("a", 952, [float("nan")] * 8), ("a", 953, [])]
    asked = [(k, i, [x + rng.gauss(0, .5) for x in centres[i % 12]]) for i, k in enumerate(["a", "b", "c", None] * 5)]
    asked += [("c", 50, [1.0, 1.0]), ("a", 51, None), ("none", 52, centres[0])]
    chunks = spark.createDataFrame(rows, "key string, chunk_id long, embedding array<double>").withColumn("_k", F.lit(1)).withColumnRenamed("_k", "extra")
    queries = spark.createDataFrame(asked, "key string, query_id long, embedding array<double>")
    exact = topk_similar(chunks, queries, ["key"], k=7)
    cols = ["key", "query_id", "chunk_id", "rank", "extra"]
    want = sorted(map(tuple, exact.select(*cols).collect()))
    for width in (0.1, 0.5, 4.0):
        got = topk_candidates(chunks, queries, ["key"], k=7, width=width)
        assert sorted(got.columns) == sorted(exact.columns) and sorted(map(tuple, got.select(*cols).collect())) == want
    recall = hit_recall(topk_candidates(chunks, queries, ["key"], k=7, complete=False), exact, ["key"])
    print(f"candidates alone: recall {recall:.3f}")
    assert recall >= 0.9
    assert topk_candidates(chunks.where("false"), queries, ["key"]).count() == 0


def test_text_cuts():
    import random

    from codeatlas.operators.retrieval import text_cuts

    assert text_cuts("x" * 482) == [482] and text_cuts("x" * 500) == [500] and text_cuts("") == [0]
    assert text_cuts("p" * 98 + "\n\n" + "q" * 600) == [100, 550, 700]
    assert text_cuts("a b " * 300)[0] == 500 and text_cuts("w" * 499 + " " + "v" * 30)[0] == 500
    rng = random.Random(8)
    for _ in range(200):
        text = "".join(rng.choices(["word", " ", "\n", "\n\n", "\u00e9\u00e9"], [8, 4, 1, .3, 3], k=rng.randint(0, 400)))
        size, overlap = rng.choice([(50, 10), (20, 0), (30, 29)])
        cuts, last = text_cuts(text, size, overlap), 0
        for cut in cuts[:-1]:
            start = max(0, last - overlap)
            assert last < cut <= start + size < len(text)
            reach = text[last:start + size]
            best = next((reach.rindex(b) + len(b) for b in ("\n\n", "\n", " ") if b in reach), len(reach))
            assert cut - last == best
            last = cut
        assert cuts[-1] == len(text) and len(text) - max(0, last - overlap) <= size


def test_chunks_of_odd_documents(spark):
    from codeatlas.operators.retrieval import chunk_recursive

    docs = spark.createDataFrame([(1, None, 5), (2, "", 6), (3, "ab " * 400, 7), (None, "short", 8)], "id long, body string, pos int")
    got = chunk_recursive(docs.withColumnRenamed("pos", "n"), ["id", "n"], "body", 100, 20).collect()
    assert [(r["id"], r["pos"], r["chunk"]) for r in got if r["id"] is None] == [(None, 0, "short")]
    own = sorted((r["pos"], r["chunk"]) for r in got if r["id"] == 3)
    assert {r["id"] for r in got} == {3, None} and own[0][1] + "".join(c[20:] for _, c in own[1:]) == "ab " * 400
    assert all(len(c) <= 100 for _, c in own)
