"""Code element extraction on hand-written sources."""

from pyspark.sql import functions as F

from codeatlas.operators.elements import code_elements, drop_overlaps
from codeatlas.operators.graph import call_names

SRC = """// a

// b
// c

function f(x, y) {
  if (x) { return y; }
}
class K {
  m(a) {
    const g = (q) => q + 1;
    return helper(a);
  }
  static make() { return new K(); }
}
const h = (z) => {
  return z.map((w) => w * 2);
};
interface Shape {
  size: number;
}
"""


def _elements(spark, src=SRC):
    files = spark.createDataFrame([("i", "a.js", src)], "instance_key string, rel_path string, content string")
    return code_elements(files, ["instance_key", "rel_path"])


def test_elements_spans_and_names(spark):
    rows = {(r["name"], r["start_line"]): r for r in _elements(spark).collect()}
    f = rows[("f", 6)]
    assert f["end_line"] == 8 and f["has_return"] and f["signature"] == "// b\n// c" and f["parameters"] == ["x", "y"]
    k = rows[("K", 9)]
    assert k["kind"] == "class" and k["end_line"] == 15 and k["has_return"] is False and k["node_key"] == "class_1"
    m = rows[("m", 10)]
    assert m["parent_ordinal"] == 1 and m["end_line"] == 13
    # arrow inside a method belongs to the class; arrow functions are anonymous
    assert rows[("function_2", 11)]["parent_ordinal"] == 1
    assert rows[("make", 14)]["start_line"] == rows[("make", 14)]["end_line"]
    h = rows[("function_2", 16)]
    assert h["node_key"] == "function_2" and h["end_line"] == 18
    assert rows[("function_3", 17)]["ordinal"] == 3
    assert rows[("Shape", 19)]["kind"] == "type" and rows[("Shape", 19)]["node_key"] == "type_2"


def test_drop_overlaps_keeps_outer(spark):
    kept = {(r["name"], r["start_line"]) for r in drop_overlaps(_elements(spark), ["instance_key", "rel_path"]).collect()}
    assert ("function_3", 17) not in kept and ("function_2", 16) in kept and ("f", 6) in kept


def test_drop_overlaps_fixture(spark):
    els = spark.createDataFrame([("i", "a", "function", None, s, e, 0) for s, e in [(1, 5), (5, 9), (7, 8), (10, 12)]],
                                "instance_key string, rel_path string, kind string, parent_ordinal long, "
                                "start_line int, end_line int, col int")
    kept = sorted((r["start_line"], r["end_line"]) for r in drop_overlaps(els, ["instance_key", "rel_path"]).collect())
    assert kept == [(1, 5), (7, 8), (10, 12)]


def test_leading_comments_fixture(spark):
    files = spark.createDataFrame([("i", "a.js", "// a\n\n// b\n// c\n\nfunction f(){}")],
                                  "instance_key string, rel_path string, content string")
    el = code_elements(files, ["instance_key", "rel_path"]).collect()
    assert el[0]["signature"] == "// b\n// c"


def test_call_names(spark):
    df = spark.createDataFrame([("function f(a) {\n  g(a); obj.m(); new K(1); if (x) { h(2); }\n  // z(3)\n}",)], "c string")
    assert df.select(call_names("c").alias("x")).first()["x"] == ["g", "h"]


def test_unnamed_classes(spark):
    text = "export default class extends A {\n  run() { return 1; }\n}\nconst B = class {\n}\nclass Named extends A {\n}"
    files = spark.createDataFrame([("i", "a.js", text)], "instance_key string, rel_path string, content string")
    el = sorted((r["start_line"], r["end_line"], r["kind"], r["name"]) for r in code_elements(files, ["instance_key", "rel_path"]).collect())
    assert el == [(1, 3, "class", "class_1"), (2, 2, "function", "run"), (4, 5, "class", "class_2"), (6, 7, "class", "Named")]


def test_files_of_one_partition_are_parsed_in_many_tasks(spark):
    from codeatlas.operators.elements import parsed_files
    from codeatlas.operators.retrieval import chunk_recursive

    files = spark.range(400).coalesce(1).selectExpr("'i' as instance_key", "concat('f', id, '.js') as rel_path", "concat('function f', id, '() {}') as content")
    for df in (parsed_files(files), chunk_recursive(files, ["rel_path"], "content")):
        sizes = [r["count"] for r in df.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()]
        assert len(sizes) > 16 and sum(sizes) == 400


def test_elements_leave_a_task_in_bounded_batches(spark, monkeypatch):
    """A batch of files with many elements becomes several batches of elements."""
    from codeatlas.operators import elements as E

    files = spark.range(50).coalesce(1).selectExpr("'i' as instance_key", "concat('f', id, '.js') as rel_path", "repeat('function f() {}\\n', 40) as content")
    whole = E.code_elements(files).count()
    monkeypatch.setattr(E, "BATCH_CHARS", 1000)
    assert E.code_elements(files).count() == whole == 2000
