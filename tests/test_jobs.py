"""Composite jobs on tiny inputs."""

from codeatlas.plans import jobs

SRC_A = "import { g } from './b';\nfunction f(x) {\n  return g(x);\n}\nfunction unused() {\n  return 0;\n}\n"
SRC_B = "export function g(y) {\n  return y;\n}\n"


def _files(spark):
    return spark.createDataFrame([("i", "src/a.js", SRC_A), ("i", "src/b.js", SRC_B)],
                                 "instance_key string, rel_path string, content string")


def test_catalog_graph_and_meta(spark):
    files = _files(spark)
    el = jobs.build_code_catalog(files)
    assert sorted((r["rel_path"], r["name"]) for r in el.collect()) == [("src/a.js", "f"), ("src/a.js", "unused"),
                                                                         ("src/b.js", "g")]
    nodes, edges = jobs.build_import_graph(files)
    assert [(r["src_path"], r["dst_path"]) for r in edges.collect()] == [("src/a.js", "src/b.js")]
    meta = jobs.build_doc_meta(files, el, edges)
    refs = [(r["name"], r["dst_path"], r["call_name"]) for r in meta.collect() if r["dst_path"]]
    assert refs == [("f", "src/b.js", "g")]


def test_repair_contexts_prunes_unlisted_elements(spark):
    files = _files(spark)
    el = jobs.build_code_catalog(files)
    answer = "Analysis\n```\nsrc/a.js\nfunction: f\n```\nSummary\n```\nsrc/b.js\nfunction: g\n```\n"
    answers = spark.createDataFrame([("i", answer)], "instance_key string, answer string")
    out = jobs.repair_contexts(answers, files, el).collect()
    assert len(out) == 1 and out[0]["rel_path"] == "src/a.js"
    assert "function f(x)" in out[0]["pruned"] and "unused" not in out[0]["pruned"]


def test_sample_keyframes(spark):
    frames = spark.createDataFrame([("a.gif", i, v) for i, v in enumerate([0.0, 0.1, 0.0, 0.5, 0.9, 0.2, 0.95])],
                                   "gif string, frame_no long, feature double")
    kept, counts = jobs.sample_keyframes(frames, threshold=0.3)
    assert sorted(r["frame_no"] for r in kept.collect()) == [0, 4]
    c = counts.first()
    assert (c["saved_frames"], c["total_frames"]) == (2, 7)


def test_refresh_summarise_and_media(spark):
    old = spark.createDataFrame([("i", "a.js", "1"), ("i", "b.js", "1")], "instance_key string, rel_path string, content string")
    new = spark.createDataFrame([("i", "a.js", "2"), ("i", "b.js", "1"), ("i", "c.js", "1")],
                                "instance_key string, rel_path string, content string")
    old_docs = spark.createDataFrame([("i", "a.js", "A"), ("i", "b.js", "B")], "instance_key string, rel_path string, doc string")
    elements = spark.createDataFrame([("i", "a.js", 1), ("i", "c.js", 2), ("i", "b.js", 3)],
                                     "instance_key string, rel_path string, element_id long")
    refs = spark.createDataFrame([(1, 2)], "src_element_id long, dst_element_id long")
    carried, todo, waves = jobs.refresh_docs(old_docs, old, new, elements, refs, "i2")
    assert [r["rel_path"] for r in carried.collect()] == ["b.js"]
    assert sorted(r["element_id"] for r in todo.collect()) == [1, 2]
    assert {r["element_id"]: r["level"] for r in waves.collect()} == {2: 0, 1: 1}

    docs = spark.createDataFrame([("i", "a.js", 2, "**Code Description**: two\n**Note**: x"),
                                  ("i", "a.js", 1, "**Code Description**: one")],
                                 "instance_key string, rel_path string, start_line int, doc string")
    s = jobs.summarise_files(docs).first()
    assert s["description"] == "1. **Code Description**: one\n\n2. **Code Description**: two\n\n"
    assert s["prompt"].startswith("Describe this js file.")

    assets = spark.createDataFrame([("i", "a.png", 480, 640)], "instance_key string, name string, height int, width int")
    frames = spark.createDataFrame([], "instance_key string, frame string, height int, width int")
    m = jobs.media_budget(assets, frames).first()
    assert (m["image_tokens"], m["text_budget"]) == (391, 128000 - 391)


def test_retrieval_and_context_jobs(spark):
    files = _files(spark)
    file_docs = spark.createDataFrame([("i", "src/a.js", "**Conclusion**: calls g"), ("i", "src/b.js", None)],
                                      "instance_key string, rel_path string, doc string")
    chunks = jobs.chunk_file_docs(file_docs.fillna({"doc": ""}))
    assert chunks.filter("chunk like 'Filename: src/a.js%'").count() == 1
    index = jobs.index_chunks(file_docs)
    analyses = spark.createDataFrame([("i", "x\n**Cause**: c\n**Summary**: s"), ("other", "**Cause**: c")], "instance_key string, analysis string")
    asked = jobs.issue_queries(analyses)
    assert sorted((r["instance_key"], r["ordinal"], r["query"]) for r in asked.collect()) == [("i", 1, "c"), ("i", 2, "s"), ("other", 1, "c")]
    from pyspark.sql import functions as F

    vectors = index.withColumn("embedding", F.array(F.lit(0.0), F.lit(1.0))).drop("chunk")
    vectors = vectors.unionByName(vectors.withColumn("text_hash", F.lit("old")))
    posed = asked.filter("ordinal = 1").withColumn("embedding", F.array(F.lit(0.1), F.lit(0.9))).drop("query")
    found, report = jobs.retrieve_files(file_docs, vectors, analyses, posed, k=1)
    assert [tuple(r) for r in found.select("instance_key", "rel_path", "best_rank").collect()] == [("i", "src/a.js", 1)]
    r = report.first().asDict()
    assert r == {"instance_key": "i", "chunks": 1, "chunks_without_vector": 0, "vectors_without_chunk": 1, "questions": 2,
                 "questions_without_vector": 1, "vectors_without_question": 0}
    assert [r["text"] for r in jobs.retrieved_texts(found).collect()] == ["src/a.js\n"]
    none, _ = jobs.retrieve_files(file_docs, vectors, analyses, posed, done=found)
    assert none.count() == 0
    retrieved = spark.createDataFrame([("i", "a.js"), ("i", "src/b.js")], "instance_key string, rel_path string")
    ctx = jobs.file_contexts(retrieved, files, file_docs, budget=1000).collect()
    assert sorted((r["rel_path"], r["batch_no"]) for r in ctx) == [("src/a.js", 1), ("src/b.js", 1)]
    assert {r["rel_path"]: r["summary"] for r in ctx}["src/b.js"] == "None"

    answers = spark.createDataFrame([("i", "```\nsrc/a.js\nsrc/b.js\n```")], "instance_key string, answer string")
    el_docs = spark.createDataFrame([("i", "src/a.js", "f", "**f**: x\nbody\n**Note**: n")],
                                    "instance_key string, rel_path string, name string, doc string")
    meta = spark.createDataFrame([("i", "src/a.js", "f", "Function", 1)],
                                 "instance_key string, rel_path string, name string, type string, ordinal long")
    ec = jobs.element_contexts(answers, files, el_docs, meta).collect()
    assert [(r["rel_path"], r["item"], r["batch_no"]) for r in ec] == [("src/a.js", "--- src/a.js ---\n\n-- Function `f` --\n\nbody\n\n\n\n\n", 1)]


def test_write_statement(spark, tmp_path):
    from codeatlas.sources import sinks as K

    df = spark.createDataFrame([("k", "  text \n")], "instance_key string, problem_statement string")
    K.write_statement(df, str(tmp_path / "st"))
    assert spark.read.parquet(str(tmp_path / "st")).first()["problem_statement"] == "text"


def test_repair_resumes_by_file(spark):
    files = _files(spark)
    el = jobs.build_code_catalog(files)
    answer = "A\n```\nsrc/a.js\nfunction: f\n```\n```\nsrc/b.js\nfunction: g\n```\n```\nend\n```\n"
    answers = spark.createDataFrame([("i", answer)], "instance_key string, answer string")
    every = {r["rel_path"] for r in jobs.repair_contexts(answers, files, el).collect()}
    done = spark.createDataFrame([("i", "src/a.js")], "instance_key string, rel_path string")
    left = {r["rel_path"] for r in jobs.repair_contexts(answers, files, el, done).collect()}
    assert "src/b.js" in every and left == every - {"src/a.js"}


def test_history_broadcasts_no_table_of_texts(spark):
    """Texts made from short keys look small to the planner; no table of them goes through the driver."""
    rows = spark.range(300).selectExpr("'r' as repo", "1 as number", "concat('src/m_', id, '.js') as rel_path", "concat('function f_', id, '(a) { return a; }') as content")
    docs = rows.selectExpr("repo", "number", "rel_path", "'f' as name", "'d' as doc")
    carried, plan = jobs.refresh_history(rows, docs)
    for df in (carried, plan):
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in text and "MapInArrow" not in text
        joins = [ln for ln in text.split("\n") if "BroadcastHashJoin" in ln]
        assert all("<=>" in ln or "_j0" in ln for ln in joins), joins


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_files_are_parsed_once_and_their_tables_not_broadcast(spark):
    from codeatlas.plans import jobs

    files = spark.createDataFrame([("i", f"src/f{n}.js", f"function keep(a) {{\n  return a;\n}}\nfunction drop{n}(b) {{\n  return b;\n}}\n") for n in range(4)],
                                  "instance_key string, rel_path string, content string")
    elements = jobs.build_code_catalog(files)
    assert "MapInArrow" not in _plan(elements)
    answers = spark.createDataFrame([("i", "".join(f"```\nsrc/f{n}.js\nfunction: keep\n```\n" for n in range(3))), ("none", "```\nsrc/f1.js\n```")],
                                    "instance_key string, answer string")
    out = jobs.repair_contexts(answers, files, elements, files.filter("rel_path = 'src/f0.js'").select("instance_key", "rel_path"))
    assert _plan(out).count("BroadcastHashJoin") <= 1          # the few instances that have files
    got = {r["rel_path"]: r["pruned"] for r in out.collect()}
    assert got == {f"src/f{n}.js": "function keep(a) {\n  return a;\n}\n\n" for n in (1, 2)}


def test_reference_context_sorts_only_texts_that_are_called(spark):
    from codeatlas.operators.graph import reference_context

    refs = spark.createDataFrame([("i", "a.js", 1, n, "b.js", "f", 5) for n in range(3)] + [("i", "a.js", 9, 0, "b.js", "g", 8)],
                                 "instance_key string, src_path string, start_line int, pos int, dst_path string, call_name string, callee_line int")
    elements = spark.createDataFrame([("i", "b.js", 5, "// f", "f()"), ("i", "b.js", 8, "", "g()"), ("i", "b.js", 20, "", "never")],
                                     "instance_key string, rel_path string, start_line int, signature string, content string")
    docs = spark.createDataFrame([("i", "b.js", 5, "Doc"), ("i", "b.js", 20, "no")], "instance_key string, rel_path string, start_line int, doc string")
    out = reference_context(refs, elements, docs, ["instance_key"])
    assert _plan(out).count("ShuffledHashJoin") == 2           # a semi join for the elements and one for the docs
    got = {r["start_line"]: (r["n_refs"], r["context"]) for r in out.collect()}
    assert got == {1: (3, "b.js\nDoc\n// f\nf()\n" * 3), 9: (1, "b.js\nNone\n\ng()\n")}
