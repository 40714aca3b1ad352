"""Round trips for file sources and sinks in a scratch folder."""

import gzip
import json
import os
import re
import struct
import tempfile

import pytest

from codeatlas.operators.elements import code_elements
from codeatlas.operators.graph import graph_nodes, import_edges
from codeatlas.sources import files as S
from codeatlas.sources import sinks as K


def _write(root, rel, data):
    p = os.path.join(root, rel)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "wb") as fh:
        fh.write(data if isinstance(data, bytes) else data.encode())


def test_scan_source_files(spark):
    root = tempfile.mkdtemp(prefix="snap-")
    _write(root, "org/name/1/src/a.js", "import b from './b';\nfunction f() { return 1; }\n")
    _write(root, "org/name/1/src/a.min.js", "x")
    _write(root, "org/name/1/src/b.min.js", "x")
    _write(root, "org/name/1/src/latest/c.js", "x")
    _write(root, "org/name/1/tests/d.js", "x")
    _write(root, "org/name/1/src/e.css", "x")
    _write(root, "org/name/2/lib/g.tsx", "export const g = 1;\n")
    got = sorted((r["instance_key"], r["rel_path"]) for r in S.scan_source_files(spark, root).collect())
    assert got == [("org/name/1", "src/a.js"), ("org/name/1", "src/b.min.js"), ("org/name/2", "lib/g.tsx")]
    strict = sorted(r["rel_path"] for r in S.scan_source_files(spark, root, strict_test_dir=True).collect())
    assert "src/latest/c.js" in strict and "tests/d.js" not in strict
    files = S.scan_source_files(spark, root)
    edges = import_edges(files, ["instance_key", "rel_path"])
    assert [(r["src_path"], r["dst_path"]) for r in edges.collect()] == [("src/a.js", "src/b.js")]
    nodes = sorted((r["node"], r["type"]) for r in graph_nodes(files, edges, ["instance_key"]).collect())
    assert ("src/b.js", None) in nodes


def test_structure_and_links_round_trip(spark):
    out = tempfile.mkdtemp(prefix="struct-")
    files = spark.createDataFrame([("i1", "a.js", "class K {\n  m(x) {\n    return x;\n  }\n}\nfunction f() {}\n")],
                                  "instance_key string, rel_path string, content string")
    el = code_elements(files, ["instance_key", "rel_path"])
    assert [(r["instance_key"], r["pieces"]) for r in K.write_structure(el, out).collect()] == [("i1", 1)]
    back = S.read_structure(spark, out)
    got = sorted((r["rel_path"], r["node_key"], r["element"]["name"], len(r["element"]["functions"])) for r in back.collect())
    assert got == [("a.js", "class_1", "K", 1), ("a.js", "function_1", "f", 0)]
    edges = spark.createDataFrame([("i1", "a.js", "b.js")], "instance_key string, src_path string, dst_path string")
    nodes = spark.createDataFrame([("i1", "a.js", "file")], "instance_key string, node string, type string")
    link_dir = tempfile.mkdtemp(prefix="links-")
    K.write_node_link(nodes, edges, link_dir)
    assert json.load(open(os.path.join(link_dir, "ki1.json"))) == {
        "nodes": [{"id": "a.js", "type": "file"}], "links": [{"source": "a.js", "target": "b.js", "type": "import"}]}
    links = S.read_links(spark, link_dir).collect()
    assert [(r["src_path"], r["dst_path"], r["type"]) for r in links] == [("a.js", "b.js", "import")]


def test_doc_meta_jsonl_and_texts(spark):
    out = tempfile.mkdtemp(prefix="meta-")
    rec = {"file_name": "repo/o/n/1/a.js", "node_meta": [{"type": "Function", "class_or_function": {
        "signature": "", "content": "function f(){}", "name": "f", "parameters": [], "start_line": 1,
        "end_line": 1, "return": False}, "import": []}]}
    _write(out, "o/n/1.jsonl", json.dumps(rec) + "\n")
    meta = S.read_doc_meta(spark, os.path.join(out, "o/n/1.jsonl")).first()
    assert meta["node_meta"][0]["class_or_function"]["name"] == "f"
    tdir = tempfile.mkdtemp(prefix="texts-")
    df = spark.createDataFrame([("k1", 2, "b"), ("k1", 1, "a"), ("k2", 1, "z")], "instance_key string, batch_no int, text string")
    K.write_texts(df, os.path.join(tdir, "t"), batch_col="batch_no")
    back = {r["instance_key"]: r["text"] for r in K.read_texts(spark, os.path.join(tdir, "t")).collect()}
    assert back == {"k1": "ab", "k2": "z"}
    K.write_jsonl(df, os.path.join(tdir, "j"))
    assert spark.read.json(os.path.join(tdir, "j")).count() == 3
    docs_root = tempfile.mkdtemp(prefix="docs-")
    _write(docs_root, "x/a.txt", "hello\nworld")
    _write(docs_root, "x/y/b.txt", "second")
    _write(docs_root, "x/c.md", "skip")
    docs = sorted(r["text"] for r in S.read_text_docs(spark, docs_root).collect())
    assert docs == ["hello\nworld", "second"]


def test_images_and_gifs(spark):
    root = tempfile.mkdtemp(prefix="img-")
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", 640, 480) + b"\x08\x02\x00\x00\x00"
    gif = b"GIF89a" + struct.pack("<HH", 300, 200) + b"\x00\x00\x00"
    _write(root, "pic/a.png", png)
    _write(root, "pic/b.GIF", gif)
    _write(root, "pic/c.webp", b"RIFF....WEBP")
    assets = spark.createDataFrame([("a.png",), ("b.GIF",), ("missing.png",)], "name string")
    got = {r["name"]: (r["width"], r["height"]) for r in S.read_images(spark, root, assets).collect()}
    assert got == {"a.png": (640, 480), "b.GIF": (300, 200), "missing.png": (None, None)}
    assert [os.path.basename(r["path"]) for r in S.list_gifs(spark, root).collect()] == ["b.GIF"]


def test_images_of_instances_with_equal_names(spark):
    root = tempfile.mkdtemp(prefix="img-")
    for folder, width in (("org/one/1", 300), ("org/two/1", 100)):
        _write(root, f"{folder}/a.gif", b"GIF89a" + struct.pack("<HH", width, 50) + b"\x00\x00\x00")
    _write(root, "org/one/1/c.webp", b"RIFF....WEBP")
    assets = spark.createDataFrame([("org/one/1", "a.gif", None, None), ("org/two/1", "a.gif", 7, 7), ("org/one/1", "c.webp", 20, 30),
                                    ("org/two/1", "c.webp", None, None)], "instance_key string, name string, width int, height int")
    got = {(r["instance_key"], r["name"]): (r["width"], r["height"], r["size_known"])
           for r in S.read_images(spark, root, assets).collect()}
    assert got == {("org/one/1", "a.gif"): (300, 50, True), ("org/two/1", "a.gif"): (100, 50, True),
                   ("org/one/1", "c.webp"): (20, 30, True), ("org/two/1", "c.webp"): (None, None, False)}


def test_documents_of_many_instances(spark):
    out = tempfile.mkdtemp(prefix="docs-")
    keys = ["org/one/1", "a b%2F", "é", None, "_null"]
    nodes = spark.createDataFrame([(k, f"f{i:03}\n\"{k}", "file" if i % 2 else None) for k in keys for i in range(40)],
                                  "instance_key string, node string, type string")
    edges = spark.createDataFrame([(k, f"s{i}", "t,]}[{") for k in keys[:2] for i in range(30)], "instance_key string, src_path string, dst_path string")
    for _ in range(2):                       # a second run replaces the first
        manifest = K.write_node_link(nodes, edges, out).collect()
    assert {r["instance_key"]: r["pieces"] for r in manifest} == {k: 70 if k in keys[:2] else 40 for k in keys}
    order = lambda df, *c: sorted((tuple(r) for r in df.select("instance_key", *c).collect()), key=str)
    assert order(S.read_nodes(spark, out), "node", "type") == order(nodes, "node", "type")
    assert order(S.read_links(spark, out), "src_path", "dst_path") == order(edges, "src_path", "dst_path")
    assert all(len(json.load(open(os.path.join(out, f)))) == 2 for f in os.listdir(out))
    assert K.write_node_link(nodes.where("false"), edges.where("false"), tempfile.mkdtemp()).count() == 0
    assert S.read_nodes(spark, tempfile.mkdtemp()).count() == 0


def test_entries_match_a_whole_parse():
    import random

    from codeatlas.sources.documents import entries

    rng = random.Random(2)

    def value(depth):
        kind = rng.randint(0, 6 if depth else 3)
        if kind < 4:
            return rng.choice([1.5, -3, True, None, "", "a\"b", "\\", "é😀", "{[,:]}", "x" * 50])
        return [value(depth - 1) for _ in range(rng.randint(0, 4))] if kind == 4 else {f"k{i}\"": value(depth - 1) for i in range(rng.randint(0, 4))}

    for _ in range(300):
        doc = {f"key\\{i}": value(3) for i in range(rng.randint(0, 5))} | {"links": [value(2) for _ in range(rng.randint(0, 4))], "nodes": rng.choice([[], {}, 3])}
        text = json.dumps(doc, ensure_ascii=rng.random() < .5, indent=rng.choice([None, 1])).encode()
        size = rng.choice([1, 2, 7, 1000])
        blocks = lambda: (text[i:i + size] for i in range(0, len(text), size))  # noqa: E731, B023
        assert {k: json.loads(v) for k, v in entries(blocks())} == doc
        got = [(k, json.loads(v)) for k, v in entries(blocks(), ("links",)) if k == "links"]
        assert got == [("links", x) for x in doc["links"]]
        for bad in (text[:-1], text[:len(text) // 2], b""):
            try:
                list(entries([bad]))
                raise AssertionError(bad)
            except ValueError:
                pass


def test_entries_of_a_document_larger_than_memory_allows():
    import tracemalloc

    from codeatlas.sources.documents import entries

    entry = json.dumps({"class_1": {"content": "x" * 100_000}}).encode()

    def blocks(n=3000):
        yield b"{"
        for i in range(n):
            yield (b"," if i else b"") + json.dumps(f"file{i}").encode() + b":" + entry
        yield b"}"

    tracemalloc.start()
    total = sum(len(v) for _, v in entries(blocks()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == 3000 * len(entry) > 300_000_000 and peak < 2_000_000


def test_a_failed_append_leaves_nothing(spark):
    import pytest
    from pyspark.sql import functions as F

    path = os.path.join(tempfile.mkdtemp(prefix="commits-"), "t")
    rows = lambda *xs: spark.createDataFrame([(k, n, t) for k, n, t in xs], "instance_key string, batch_no int, text string")
    first = rows(("a", 1, "one "), ("b", 1, "x"))
    broken = rows(("a", 2, "two"), ("b", 2, "y")).withColumn("text", F.when(F.col("instance_key") == "a", F.col("text")).otherwise(F.raise_error(F.lit("lost")).cast("string")))
    assert K.committed(spark, path) is None
    K.write_texts(first, path, batch_col="batch_no", mode="append", batch_id="run/1")
    with pytest.raises(Exception, match="lost"):
        K.write_texts(broken, path, batch_col="batch_no", mode="append", batch_id="run/2")
    read = lambda: {r["instance_key"]: r["text"] for r in K.read_texts(spark, path).collect()}
    assert read() == {"a": "one ", "b": "x"}
    for _ in range(2):                       # the retry counts, a further one doesn't
        K.write_texts(rows(("a", 2, "two"), ("c", 2, "z")), path, batch_col="batch_no", mode="append", batch_id="run/2")
    assert read() == {"a": "one two", "b": "x", "c": "z"}
    assert not K.commit_batch(first, path, "run/1")


def _jpeg(width, height, before=b"", frame=0xC0):
    return b"\xff\xd8" + before + b"\xff" + bytes([frame]) + struct.pack(">HBHHB", 11, 8, height, width, 1) + b"\x01\x11\x00" + b"\xff\xda\x00\x02"


def test_sizes_of_jpeg_and_webp(spark):
    root = tempfile.mkdtemp(prefix="img-")
    app = b"\xff\xe1" + struct.pack(">H", 3000) + b"\xff\xc0" * 1499
    tables = b"\xff\xc4\x00\x05abc" + b"\xff\xff\xff\xdb\x00\x04ab" + b"\xff\x01"
    webp = lambda form, body: b"RIFF" + struct.pack("<I", 12 + len(body)) + b"WEBP" + form + struct.pack("<I", len(body)) + body
    images = {
        "plain.jpg": (_jpeg(640, 480), (640, 480)), "long.jpg": (_jpeg(1, 65535, app + tables + app, 0xC2), (1, 65535)),
        "cut.jpg": (_jpeg(9, 9, app)[:40], (None, None)), "noframe.jpg": (b"\xff\xd8\xff\xda\x00\x02", (None, None)), "soi.jpg": (b"\xff\xd8", (None, None)),
        "lossy.webp": (webp(b"VP8 ", b"\x10\x00\x00\x9d\x01\x2a" + struct.pack("<HH", 0x4000 | 550, 368)), (550, 368)),
        "lossless.webp": (webp(b"VP8L", b"\x2f" + struct.pack("<I", (16383) | (99 << 14) | (1 << 28))), (16384, 100)),
        "extended.webp": (webp(b"VP8X", b"\x10\x00\x00\x00" + struct.pack("<I", 69_999)[:3] + struct.pack("<I", 399)[:3]), (70_000, 400)),
        "bad.webp": (webp(b"VP8 ", b"\x10\x00\x00zzz\x00\x00\x00\x00"), (None, None)), "text.png": (b"hello", (None, None))}
    for name, (data, _) in images.items():
        _write(root, f"i/{name}", data)
    got = {r["name"]: (r["width"], r["height"]) for r in S.read_images(spark, root).collect()}
    assert got == {n: size for n, (_, size) in images.items()}


def test_values_are_passed_over_in_one_step(monkeypatch):
    """Nested values cost a step of the reader each, not one a comma, colon or string."""
    from codeatlas.sources import documents as D

    doc = {f"f{i}": {f"e{k}": {"content": "}{\"[", "parameters": ["a", "b"], "functions": [{"name": "m"}]} for k in range(20)} for i in range(50)}
    text = json.dumps(doc).encode()
    steps = []
    find = D._Window.find
    monkeypatch.setattr(D._Window, "find", lambda self, *a: steps.append(1) or find(self, *a))
    got = dict(D.entries(iter([text])))
    assert {k: json.loads(v) for k, v in got.items()} == doc
    assert len(steps) < 10 * len(doc)
    small = [text[i:i + 5] for i in range(0, len(text), 5)]
    assert dict(D.entries(iter(small))) == got


def test_files_are_listed_and_read_as_by_spark(spark, monkeypatch):
    """Many files make few tasks, hidden and empty ones are left out, and paths are those of Spark's readers."""
    from pyspark.sql import functions as F

    from codeatlas.sources import listing as L

    root = tempfile.mkdtemp(prefix="many-")
    for name, data in (("e.txt", b""), ("a b/c%20 d#é.txt", b"hi"), ("_hid/q.txt", b"h"), (".dot/q.txt", b"h"), ("_s.txt", b"h"), ("_k=v/z.txt", b"k"),
                       ("bad.txt", b"\xff\xfe"), ("g.txt.gz", gzip.compress(b"zipped"))):
        _write(root, name, data)
    for i in range(300):
        _write(root, f"d{i % 7}/sub/f{i}.js", b"x" * (i + 1))
    monkeypatch.setattr(L, "LISTED", 20)                   # so that folders are handed on
    for at in (root, f"file:{root}/", f"file://{root}", f"{root}/bad.txt"):
        old = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(at)
        key = lambda df: sorted(map(tuple, df.collect()))
        assert key(L.list_files(spark, at)) == key(old.select("path", "length"))
        assert key(L.read_files(spark, at).select("path", F.hex("content"))) == key(old.select("path", F.hex("content")))
    glob = "*.{txt,gz}"
    old = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root, wholetext=True)
    assert key(S.read_text_docs(spark, root, glob).select("path", F.hex("text"))) == key(old.select("_metadata.file_path", F.hex("value")))
    monkeypatch.undo()
    most = max(32, 4 * spark.sparkContext.defaultParallelism)
    for df in (S.read_images(spark, root), S.read_text_docs(spark, root, "*.js"), S.list_gifs(spark, root)):
        assert df.rdd.getNumPartitions() <= most
    with pytest.raises(FileNotFoundError):
        L.list_files(spark, f"{root}/none")


def test_name_patterns():
    from codeatlas.sources.listing import glob_regex

    for glob, hits, misses in (("*.{js,ts}", ["a.js", ".ts"], ["a.jsx", "ajs"]), ("a?[b-d]", ["axb", "a.d"], ["ab", "axe"]), ("[^a]x", ["bx"], ["ax"]),
                               ("\\*", ["*"], ["a"]), ("a,b}", ["a,b}"], ["a"])):
        assert all(re.fullmatch(glob_regex(glob), n) for n in hits) and not any(re.fullmatch(glob_regex(glob), n) for n in misses)
