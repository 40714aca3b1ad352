"""Lexical state over lines, declarations of real shapes, and files that are rejected."""

import random

import pytest

from codeatlas.functions.lexing import lex
from codeatlas.operators.elements import code_elements, file_elements, parsed_files, rejected_files

KEY = ["instance_key", "rel_path"]


def _found(text):
    rows, problem = file_elements(text)
    assert problem is None
    return [(r[0], r[1], r[3], r[4], r[2]) for r in rows]


@pytest.mark.parametrize("text,code", [
    ("a = 'x{' + \"}\"; // { \n/* {\n } */ b", "a =      +    ;      \n    \n      b"),
    ("t = `a ${f({b: 1}, `n ${q} }`)} }` + c", "t =      f({b: 1},      q    )     + c"),
    ("x = y / z / 2; r = /[/}]+\\//gi.test(x)", "x = y / z / 2; r =            .test(x)"),
    ("return /}/", "return    "),
    ("<p>Don't {x}</p>", "<p>Don't {x}</p>"),
    ("s = 'a\\'b' + \"\\\\\"", "s =        +     "),
    ("`a\n{b`", "  \n   "),
    ("'a\\\nb' + c", "   \n   + c"),
])
def test_masked_text(text, code):
    x = lex(text)
    assert (x.code, x.problem) == (code, None)
    assert all(text[k] in "([{" and text[c] in ")]}" and x.opens[c] == k for k, c in x.closes.items())


@pytest.mark.parametrize("text,problem", [
    ("a = `abc\n", (4, "open template")), ("a = `b ${c", (7, "open template")), ("a\n/* b", (2, "open comment")), ("s = 'abc\n'", (4, "open string")),
    ("f() }", (4, "unbalanced brace")), ("if (x) {\n", (7, "unclosed brace")), ("{ (} )", None)])
def test_problems(text, problem):
    assert lex(text).problem == problem


def test_around_matches_a_stack():
    rng = random.Random(1)
    for _ in range(200):
        x = lex("".join(rng.choice("()[]{}ab") for _ in range(40)))
        for at in range(len(x.code)):
            want = max((o for o, c in x.closes.items() if o < at <= c), default=None)
            assert x.around(at) == want


def test_names_in_literals_and_comments_are_no_elements():
    assert _found("const a = `\nclass Fake {}\nfunction ghost() {}\n`;\n/*\nfunction dead() {\n*/\nfunction live() {\n}") == [("function", "live", 8, 9, [])]
    assert _found("function g(s) {\n  return /[{]/.test(s);\n}\n") == [("function", "g", 1, 3, ["s"])]
    assert _found("const s = '{';\nfunction h() {\n  // }\n}") == [("function", "h", 2, 4, [])]


def test_parameters():
    assert _found("function f({a, b}, c) {}") == [("function", "f", 1, 1, ["c"])]
    assert _found("function f([a, b, x], c = 1, d, ...e) {}") == [("function", "f", 1, 1, ["d"])]
    assert _found("const f = (\n  a,\n  b, // the second\n) => {\n  return a;\n};") == [("arrow", "", 1, 6, ["a", "b"])]
    assert _found("function f(\n  a,\n  b\n) {\n  return b;\n}") == [("function", "f", 1, 6, ["a", "b"])]
    assert _found("x.map(async y => y)") == [("arrow", "", 1, 1, [])]


def test_several_declarations_of_a_line():
    assert _found("function a() { return 1; } function b(x) { } class C { m() {} n(q) {} }") == [
        ("function", "a", 1, 1, []), ("function", "b", 1, 1, ["x"]), ("class", "C", 1, 1, []), ("method", "m", 1, 1, []), ("method", "n", 1, 1, ["q"])]


def test_code_within_templates_counts():
    assert _found("const t = `a ${xs.map((x) => `<b>${x}</b>`)} c`;") == [("arrow", "", 1, 1, ["x"])]


def test_spans_of_arrows_and_methods():
    text = ("class K extends mixin({}) {\n  static async go(a, b) {\n    if (a) {\n    }\n  }\n  f = (x) =>\n    x\n      .y();\n"
            "  get size() { return 1 }\n}\nconst o = {\n  run(z) { },\n  go: (w) => w + 1,\n};\nexport default (q) => (\n  q\n);\n")
    assert _found(text) == [
        ("class", "K", 1, 10, []), ("method", "go", 2, 5, ["a", "b"]), ("arrow", "", 6, 8, ["x"]), ("method", "size", 9, 9, []),
        ("method", "run", 12, 12, ["z"]), ("arrow", "", 13, 13, ["w"]), ("arrow", "", 15, 17, ["q"])]


def test_types_are_no_arrows():
    text = ("export type F<T> = (a: T) => void;\ninterface I extends J {\n  f: (a) => void;\n}\nfunction g(cb: (x) => void): Promise<void> {\n}\n"
            "const h: (a) => number = (a): number => 1;\ntype U =\n  | 'a'\n  | 'b';\n")
    assert [(d, n, a, b) for d, n, a, b, _ in _found(text)] == [
        ("alias", "F", 1, 1), ("interface", "I", 2, 4), ("function", "g", 5, 6), ("arrow", "", 7, 7), ("alias", "U", 8, 10)]


def test_rejected_files(spark):
    rows = [("i", "a.js", "function a() {\n"), ("i", "b.js", "function b() {}"), ("i", "c.js", None), (None, "d.js", "x = `"), ("i", "e.js", "")]
    files = spark.createDataFrame(rows, "instance_key string, rel_path string, content string")
    parsed = parsed_files(files, KEY)
    assert sorted((r["rel_path"], r["problem"]) for r in rejected_files(parsed).collect()) == [
        ("a.js", "unclosed brace in line 1"), ("c.js", "no content"), ("d.js", "open template in line 1")]
    assert [(r["rel_path"], r["name"]) for r in code_elements(files, KEY).collect()] == [("b.js", "b")]


def test_key_columns_pass_through(spark):
    files = spark.createDataFrame([(5, "decl", "function a() {}", "x")], "problem long, decl_ string, body string, more string")
    assert [tuple(r)[:2] for r in code_elements(files.withColumnRenamed("problem", "n"), ["n", "decl_"], "body").collect()] == [(5, "decl")]


def test_long_lines_are_linear():
    import time

    text = "const a = {" + ",".join(f"k{i}: (x) => x + {i}" for i in range(20_000)) + "};" + "f(" * 3000 + ")" * 3000
    start = time.time()
    assert len(file_elements(text)[0]) == 20_000
    assert time.time() - start < 10
