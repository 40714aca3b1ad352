"""Column expressions over semi-structured text: labelled lines, sections, summaries, prompts and
an approximate token count.  All are JVM-side array / regex expressions on one row at a time,
so they scale with the number of rows and never gather text across rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of issue analyses, element docs and file docs.
ISSUE_LABELS = ("**Cause**", "**Wrong Behavior**", "**Summary**")
CODE_DESCRIPTION = "**Code Description**:"
NOTE = "**Note**"
CONCLUSION = "**Conclusion**:"
SUMMARY_OF_CODE = "**Summary of code description**:"
FILENAME_HEADER = "Filename: "
ELEMENT_TOKEN_CAP = 50000
TOKEN_PATTERN = r"\w+|[^\w\s]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x) -> Column:
    """Leading and trailing whitespace removed (spaces, tabs, CR/LF, form feeds)."""
    return F.regexp_replace(_c(x), r"^\s+|\s+$", "")


def lines(text) -> Column:
    """Lines of a text (split on LF, trailing empty line kept as in a plain split)."""
    return F.split(_c(text), "\n", -1)


def issue_fields(text) -> Column:
    """Array of ``struct(field, value)`` for lines that *start* with one of the issue labels, in
    line order; the value is the line without ``label:`` and stripped.  Other lines are ignored,
    so only the first line of a multi-line summary is kept."""
    def label(ln):
        lab = F.lit(None).cast("string")
        for name in reversed(ISSUE_LABELS):
            lab = F.when(ln.startswith(name), F.lit(name)).otherwise(lab)
        return lab

    tagged = F.transform(lines(text), lambda ln: F.struct(
        F.regexp_replace(label(ln), r"\*", "").alias("field"),
        strip(F.replace(ln, F.concat(label(ln), F.lit(":")), F.lit(""))).alias("value")))
    return F.filter(tagged, lambda s: s["field"].isNotNull())


def _terminated(items: Column) -> Column:
    """Each element followed by a newline, concatenated (``''`` for an empty array)."""
    return F.array_join(F.transform(items, lambda x: F.concat(x, F.lit("\n"))), "")


def _first_true(flags: Column) -> Column:
    """1-based position of the first true element, 0 when none."""
    return F.array_position(flags, True)


def doc_section(doc, start: str = CODE_DESCRIPTION, end: str = NOTE + ":") -> Column:
    """From the first line starting with ``start`` up to (excluding) the next line starting with
    ``end``: each line stripped and followed by a newline; ``''`` when ``start`` never occurs."""
    ls = lines(doc)
    s = _first_true(F.transform(ls, lambda x: x.startswith(start)))
    tail = F.slice(ls, F.greatest(s, F.lit(1)), F.size(ls))
    e = _first_true(F.transform(tail, lambda x: x.startswith(end)))
    body = F.when(e > 0, F.slice(tail, 1, e - 1)).otherwise(tail)
    out = _terminated(F.transform(body, strip))
    return F.when(s > 0, out).otherwise(F.lit(""))


def doc_summary(doc, stop: str = NOTE) -> Column:
    """Skip the first line, then keep non-blank stripped lines (each + newline) until a line
    starting with ``stop``."""
    ls = F.slice(lines(doc), 2, F.greatest(F.size(lines(doc)) - 1, F.lit(0)))
    e = _first_true(F.transform(ls, lambda x: x.startswith(stop)))
    body = F.when(e > 0, F.slice(ls, 1, e - 1)).otherwise(ls)
    kept = F.filter(F.transform(body, strip), lambda x: x != "")
    return _terminated(kept)


def file_summary_text(doc) -> Column:
    """Non-blank stripped lines joined with newlines, the two labels renamed to ``Summary:`` and
    ``Class/Function:``, ``**`` removed, stripped; a missing doc gives ``None``."""
    kept = F.filter(F.transform(lines(doc), strip), lambda x: x != "")
    joined = _terminated(kept)
    renamed = F.replace(F.replace(F.replace(joined, F.lit(CONCLUSION), F.lit("Summary:")),
                                  F.lit(SUMMARY_OF_CODE), F.lit("Class/Function:")), F.lit("**"), F.lit(""))
    return F.coalesce(strip(renamed), F.lit("None"))


def with_filename_header(path, doc) -> Column:
    """``Filename: <path>`` + blank line + doc, the form documents are indexed in."""
    return F.concat(F.lit(FILENAME_HEADER), _c(path), F.lit("\n\n"), _c(doc))


def render_prompt(template: str, *cols) -> Column:
    """Fill a ``%s`` template with column values, once (braces in values are inert)."""
    return F.format_string(template, *[_c(c) for c in cols])


def token_count(text, pattern: str = TOKEN_PATTERN) -> Column:
    """Approximate token count: number of words plus single punctuation marks."""
    return F.size(F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(pattern), 0)).cast("long")


def within_budget(tokens, budget: int, strict: bool = True) -> Column:
    """Budget test used before sending a prompt: ``tokens < budget`` (``<=`` when not strict)."""
    return (_c(tokens) < budget) if strict else (_c(tokens) <= budget)


def token_count_udf(encode):
    """Pluggable exact counter: wrap any ``encode(str) -> sequence`` (for example a BPE
    tokenizer's ``encode``) as an Arrow-batched pandas UDF returning the token count per row.
    Texts are encoded in batches inside the executors; nothing is gathered on the driver."""
    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(lambda t: len(encode(t))).astype("int64")

    return count
