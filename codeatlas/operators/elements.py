"""Code elements of JavaScript/TypeScript files as table jobs (no grammar).

A file arrives in one row, and its elements are found inside it: ``lexing.lex`` blanks strings, templates,
comments and regular expressions over the whole text and pairs its brackets; declarations are then
patterns over what is left, wherever lines break, and their parameters, bodies, owners and comments follow
from the bracket pairs.  ``parsed_files`` returns a row per element, or one row with the reason for a file
that has no lexical sense (a literal or comment left open, braces that don't balance, no content).  No rows
are shuffled; naming and numbering are expressions over the element rows.

Accuracy limits (part of the contract): types are told from arrow functions by their surroundings (an alias, an
interface body, an annotated parameter or variable), a regular expression by the character in front of its slash;
an arrow function without braces ends with its expression as punctuation shows it; computed and quoted
method names are not found.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lexing import Lexed, lex
from ..session import spread
from .ordered import row_index, window_sum

BATCH_CHARS = 1 << 22        # characters of elements that leave a task at once
ROW_CHARS = 256              # what an element's other fields count for
IDENT = r"[A-Za-z_$][\w$]*"
# Words that look like calls or method headers but are not.
KEYWORDS = ("if", "for", "while", "switch", "catch", "function", "return", "with", "typeof", "new",
            "await", "yield", "delete", "void", "super", "import", "else", "do", "try", "in", "of")
_BEGIN = r"(?<![\w$.])"
_DECL = {
    "class": re.compile(_BEGIN + rf"class\b(?:\s+(?!extends\b|implements\b)({IDENT}))?(?=[^;=)}}]*\{{)"),
    "interface": re.compile(_BEGIN + rf"interface\s+({IDENT})(?=[^;=)}}]*\{{)"),
    "alias": re.compile(rf"(?:^|(?<=[;{{}}]))[^\S\n]*(?:export\s+)?(?:declare\s+)?type\s+({IDENT})\s*(?:<[^=]*>)?\s*=(?![=>])", re.MULTILINE),
    "function": re.compile(_BEGIN + rf"function\b\s*\*?\s*({IDENT})?\s*(?:<[^(){{}}]*>)?\s*\("),
    "method": re.compile(rf"(?:^|(?<=[{{}};,]))[^\S\n]*(?:(?:static|async|get|set|public|private|protected|readonly|override)\s+)*\*?\s*"
                         rf"(#?{IDENT})\s*(?:<[^(){{}}]*>)?\s*\(", re.MULTILINE),
    "arrow": re.compile(r"=>"),
}
_RESULT_TYPE = re.compile(r"\s*(?::\s*[^{};=()]*)?\{")
_ARROW_TYPE = re.compile(r"\)\s*:[^(){};,=]*\Z")
_WORD_END = re.compile(rf"{IDENT}\Z")
_ANNOTATED = re.compile(rf"(?:const|let|var)\s+{IDENT}\s*:\s*\Z")
_RETURN = re.compile(_BEGIN + r"return(?![\w$])")
_GOES_ON = set(".?:&|+-*/%=<>,)")
_FIELDS = (("decl", T.StringType()), ("raw_name", T.StringType()), ("parameters", T.ArrayType(T.StringType())),
           ("start_line", T.IntegerType()), ("end_line", T.IntegerType()), ("col", T.IntegerType()), ("owner", T.LongType()),
           ("fun_n", T.LongType()), ("cls_n", T.LongType()), ("has_return", T.BooleanType()), ("content", T.StringType()),
           ("signature", T.StringType()), ("problem", T.StringType()))


def _skip_blank(code: str, at: int) -> int:
    """Offset of the first character from ``at`` that isn't blank."""
    while at < len(code) and code[at].isspace():
        at += 1
    return at


def _body_brace(x: Lexed, at: int) -> int | None:
    """The brace that opens the body after a header that ends at ``at``; bracketed parts of the header are passed."""
    while at < len(x.code):
        ch = x.code[at]
        if ch == "{":
            return at
        if ch in ";}":
            return None
        at = x.closes.get(at, at) + 1
    return None


def _expression_end(x: Lexed, at: int) -> int:
    """Offset behind an expression that begins at ``at``: before a separator or closing bracket, or at a line end
    that the next line doesn't continue."""
    last = at
    while at < len(x.code):
        ch = x.code[at]
        if ch in ",;)]}":
            break
        if at in x.closes:
            at = last = x.closes[at]
        elif ch == "\n":
            on = _skip_blank(x.code, at)
            if x.code[last:last + 1] not in _GOES_ON - {")"} and x.code[on:on + 1] not in _GOES_ON:
                break
            at = on - 1
        elif not ch.isspace():
            last = at
        at += 1
    return last + 1


def _parameters(x: Lexed, open_: int) -> list[str]:
    """Plain identifiers among the parameters of the bracket at ``open_`` (patterns, defaults and rests are none)."""
    close = x.closes.get(open_)
    if close is None:
        return []
    names, at, begin = [], open_ + 1, open_ + 1
    while at <= close:
        if at == close or x.code[at] == ",":
            names.append(x.code[begin:at].strip())
            begin = at + 1
        at = x.closes[at] + 1 if at != open_ and at in x.closes else at + 1
    return [n for n in names if re.fullmatch(IDENT, n)]


def _is_type(x: Lexed, types: list[tuple[int, int]], begin: int) -> bool:
    """Whether the arrow whose parameters begin at ``begin`` stands where only a type can."""
    if any(a <= begin < b for a, b in types):
        return True
    before = x.code[max(0, begin - 200):begin].rstrip()
    if not before.endswith(":"):
        return False
    around = x.around(begin)
    return (around is not None and x.code[around] == "(") or _ANNOTATED.search(x.code[max(0, begin - 200):begin]) is not None


def declarations(x: Lexed) -> list[tuple[int, int, str, str | None, list[str]]]:
    """(begin, end, kind, name, parameters) of every declaration, in order of their begin."""
    code, found, types = x.code, [], []
    for kind in ("class", "interface"):
        for m in _DECL[kind].finditer(code):
            brace = _body_brace(x, m.end())
            if brace is not None and brace in x.closes:
                found.append((m.start(), x.closes[brace] + 1, kind, m[1], []))
                if kind == "interface":
                    types.append((brace, x.closes[brace]))
    for m in _DECL["alias"].finditer(code):
        end = _expression_end(x, _skip_blank(code, m.end()))
        types.append((m.start(), end))
        found.append((_skip_blank(code, m.start()), end, "alias", m[1], []))
    for m in _DECL["function"].finditer(code):
        open_ = m.end() - 1
        close = x.closes.get(open_)
        if close is None:
            continue
        body = _RESULT_TYPE.match(code, close + 1)
        brace = body.end() - 1 if body else None
        end = x.closes[brace] + 1 if brace in x.closes else close + 1
        found.append((m.start(), end, "function", m[1], _parameters(x, open_)))
    for m in _DECL["method"].finditer(code):
        open_ = m.end() - 1
        close = x.closes.get(open_)
        body = _RESULT_TYPE.match(code, close + 1) if close is not None and m[1] not in KEYWORDS else None
        if body is not None and body.end() - 1 in x.closes:
            found.append((_skip_blank(code, m.start()), x.closes[body.end() - 1] + 1, "method", m[1], _parameters(x, open_)))
    for m in _DECL["arrow"].finditer(code):
        before = code[:m.start()].rstrip() if m.start() < 256 else code[m.start() - 256:m.start()].rstrip()
        shift = 0 if m.start() < 256 else m.start() - 256
        typed = _ARROW_TYPE.search(before)
        ends = shift + (typed.start() if typed else len(before) - 1)
        if ends < 0 or ends < len(code) and code[ends] == ")" and ends not in x.opens:
            continue
        if code[ends] == ")":
            begin, params = x.opens[ends], _parameters(x, x.opens[ends])
        else:
            word = _WORD_END.search(before)
            if word is None:
                continue
            begin, params = shift + word.start(), []
        if _is_type(x, types, begin):
            continue
        at = _skip_blank(code, m.end())
        end = x.closes[at] + 1 if code[at:at + 1] == "{" and at in x.closes else _expression_end(x, at)
        found.append((begin, max(end, m.end()), "arrow", "", params))
    return sorted(found, key=lambda d: (d[0], -d[1]))


def _comment_above(lines: list[str], line: int) -> str:
    """The block of comment lines right above a 0-based line, blank lines between allowed, each stripped."""
    block: list[str] = []
    for text in (lines[i].strip() for i in range(line - 1, -1, -1)):
        if text.startswith(("//", "/*", "*")):
            block.append(text)
        elif text or block:
            break
    return "\n".join(reversed(block))


def file_elements(text: str) -> tuple[list[tuple], str | None]:
    """Rows of ``_FIELDS`` for one file, or no rows and the reason why it is rejected."""
    x = lex(text)
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    if x.problem is not None:
        return [], f"{x.problem[1]} in line {bisect_right(starts, x.problem[0])}"
    lines = text.split("\n")
    returns = [m.start() for m in _RETURN.finditer(x.code)]
    out: list[tuple] = []
    classes: list[tuple[int, int]] = []                  # (end, number) of the classes around
    funs = seen = 0
    for begin, end, kind, name, params in declarations(x):
        while classes and classes[-1][0] <= begin:
            classes.pop()
        owner = classes[-1][1] if classes and kind not in ("class", "interface") else None
        first, last = bisect_right(starts, begin) - 1, bisect_right(starts, end - 1) - 1
        if kind == "class":
            seen += 1
            classes.append((end, seen))
        funs += kind not in ("class", "interface") and owner is None
        has_return = kind != "class" and bisect_right(returns, end - 1) > bisect_right(returns, begin)
        out.append((kind, name, params, first + 1, last + 1, begin - starts[first] + 1, owner, funs, seen, has_return,
                    "\n".join(lines[first:last + 1]), _comment_above(lines, first), None))
    return out, None


def parsed_files(files: DataFrame, key_cols: list[str] = ("instance_key", "rel_path"), content_col: str = "content") -> DataFrame:
    """``key_cols`` and the columns of ``_FIELDS``: a row per element of each file, or one with ``problem`` for a file
    that is rejected.  A sound file without elements has no row; null content is a problem."""
    key_cols = list(key_cols)
    own = files.select(*key_cols, F.col(content_col).alias("_text"))
    schema = T.StructType([*own.schema.fields[:-1], *(T.StructField(n, t) for n, t in _FIELDS)])

    def parse(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(t) for _, t in _FIELDS]
        for b in batches:
            texts, rows, of, held = b.column("_text"), [], [], 0
            for i in range(b.num_rows):
                text = texts[i].as_py()
                found, problem = file_elements(text) if text is not None else ([], "no content")
                if problem is not None:
                    found = [(*[None] * (len(_FIELDS) - 1), problem)]
                rows += found
                of += [i] * len(found)
                held += sum(len(r[-3] or "") + ROW_CHARS for r in found)
                if held >= BATCH_CHARS or i == b.num_rows - 1:
                    keys = b.drop_columns(["_text"]).take(pa.array(of, pa.int64()))
                    cols = list(zip(*rows)) or [()] * len(_FIELDS)
                    yield pa.RecordBatch.from_arrays([*keys.columns, *(pa.array(c, k) for c, k in zip(cols, kinds))], names=schema.names)
                    rows, of, held = [], [], 0

    return spread(own).mapInArrow(parse, schema)


def rejected_files(parsed: DataFrame, key_cols: list[str] = ("instance_key", "rel_path")) -> DataFrame:
    """Quarantine of ``parsed_files``: the files without lexical sense and why (``key + (problem)``)."""
    return parsed.filter("problem is not null").select(*key_cols, "problem")


def code_elements(files: DataFrame, key_cols: list[str] = ("instance_key", "rel_path"),
                  content_col: str = "content") -> DataFrame:
    """Element table: ``key + (kind, ordinal, name, node_key, parent_ordinal, signature, content,
    parameters, start_line, end_line, has_return)``.

    kind is ``class``, ``function`` (functions, methods, arrow functions, function expressions,
    type aliases) or ``type`` (interfaces).  Functions inside a class (any depth) carry the
    class's ordinal in ``parent_ordinal`` and no ordinal of their own; other functions are
    numbered in document order.  Arrow functions and nameless function expressions are named
    ``function_<n+1>`` with n the count of numbered functions before them; interfaces get
    ``type_<classes before + 1>``.  ``signature`` is the block of comment lines right above
    the element (blank lines allowed between it and the element), each line stripped.  Files that
    ``rejected_files`` names have no elements.
    """
    return elements_of(parsed_files(files, key_cols, content_col), key_cols)


def elements_of(parsed: DataFrame, key_cols: list[str] = ("instance_key", "rel_path")) -> DataFrame:
    """``code_elements`` from the rows of ``parsed_files``."""
    key_cols = list(key_cols)
    path_col = key_cols[-1]
    decl, name = F.col("decl"), F.col("raw_name")
    kind = F.when(decl == "class", "class").when(decl == "interface", "type").otherwise("function")
    free = (kind == "function") & F.col("owner").isNull()
    unnamed = name.isNull() | (name == "")
    before = F.col("fun_n") - F.when(free, 1).otherwise(0)
    named = (F.when(unnamed & (kind == "function"), F.concat(F.lit("function_"), (before + 1).cast("string")))
             .when(unnamed & (kind == "class"), F.concat(F.lit("class_"), F.col("cls_n").cast("string"))).otherwise(name))
    ordinal = F.when(kind == "class", F.col("cls_n")).when(kind == "type", F.col("cls_n") + 1).when(free, F.col("fun_n"))
    ts = F.col(path_col).endswith(".ts") | F.col(path_col).endswith(".tsx")
    params = F.when((kind == "function") & ~ts, F.col("parameters")).otherwise(F.array().cast("array<string>"))
    return parsed.filter("problem is null").select(
        *key_cols, kind.alias("kind"), "decl", ordinal.alias("ordinal"), named.alias("name"),
        F.when(ordinal.isNotNull(), F.concat(kind, F.lit("_"), ordinal.cast("string"))).alias("node_key"),
        F.col("owner").alias("parent_ordinal"), params.alias("parameters"), "start_line", "end_line", "col", "has_return",
        "content", "signature")


def class_members(elements: DataFrame, key_cols: list[str]) -> DataFrame:
    """``key + (class_name, member, start_line)``: the functions inside each class, at any depth."""
    members = elements.filter(F.col("parent_ordinal").isNotNull()).select(
        *key_cols, F.col("parent_ordinal").alias("ordinal"), F.col("name").alias("member"), "start_line")
    classes = elements.filter(F.col("kind") == "class").select(*key_cols, "ordinal", F.col("name").alias("class_name"))
    return members.join(classes, [*key_cols, "ordinal"]).select(*key_cols, "class_name", "member", "start_line")


def element_ordinals(elements: DataFrame, key_cols: list[str]) -> DataFrame:
    """``row_number() over (partition by file, kind order by start_line)`` without a window."""
    return row_index(elements, [*key_cols, "kind"], ["start_line", "col"], "kind_ordinal", window_sum) \
        .withColumn("kind_ordinal", F.col("kind_ordinal") + 1)


def drop_overlaps(elements: DataFrame, key_cols: list[str]) -> DataFrame:
    """Top-level functions in document order: keep one only if its start line is not inside a
    kept function's span (classes and types pass through).  A dropped span blocks nothing.

    A fold over the functions of one file, gathered in document order."""
    top = (F.col("kind") == "function") & F.col("parent_ordinal").isNull()
    rest = [c for c in elements.columns if c not in (*key_cols, "start_line", "col")]
    fun = F.struct("start_line", "col", *rest)
    per_file = elements.filter(top).groupBy(*key_cols).agg(F.array_sort(F.collect_list(fun)).alias("_f"))
    row = per_file.schema["_f"].dataType.elementType
    start = F.struct(F.lit(None).cast(row["end_line"].dataType).alias("end"),
                     F.array().cast(per_file.schema["_f"].dataType).alias("kept"))
    kept = F.aggregate("_f", start, lambda acc, f: F.when(
        acc["end"].isNull() | (f["start_line"] > acc["end"]),
        F.struct(f["end_line"].alias("end"), F.concat(acc["kept"], F.array(f)).alias("kept"))).otherwise(acc),
        lambda acc: acc["kept"])
    kept = per_file.select(*key_cols, F.inline(kept))
    return elements.filter(~top).unionByName(kept)


def definitions(elements: DataFrame, key_cols: list[str]) -> DataFrame:
    """Named function, class and method declarations; for a name declared twice in a file the
    last one wins (an aggregation keyed on (file, name), no window)."""
    named = elements.filter(F.col("decl").isin("function", "class", "method") & (F.col("name") != "")
                            & ~F.col("name").rlike(r"^function_\d+$"))
    best = named.groupBy(*key_cols, "name").agg(
        F.max_by(F.struct("start_line", "end_line", "content"), F.col("start_line")).alias("_d"))
    return best.select(*key_cols, "name", "_d.start_line", "_d.end_line", "_d.content")


def file_lines(files: DataFrame, key_cols: list[str], content_col: str = "content") -> DataFrame:
    """``key + (line_no, line)``: 1-based numbered lines of each text."""
    return files.select(*key_cols, F.posexplode(F.split(F.col(content_col), "\n", -1)).alias("_p", "line")) \
        .select(*key_cols, (F.col("_p") + 1).alias("line_no"), "line")
