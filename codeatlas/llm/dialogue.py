"""Conversation repair: weighted CYK interval parsing of role sequences.

The repaired sequence of role initials has to be in ``(s?(ua)+)?``.  That language has four states
(nothing yet, after a system, a user, an assistant turn), and the repair grammar in Chomsky normal form
has one nonterminal ``pq`` for each pair of them, "the rows of this span lead from p to q":

    pq -> pr rq                    for every state r
    pq -> row                      by Keep, Rerole or Delete of that row, at the edit's cost
    pq -> (nothing)                by Insert, closed over any number of them

A cell holds, for its span and each ``pq``, the cheapest (cost, audit), ties by the least audit.  Two audits
of a span that cost the same are never each other's prefix (a longer one would have more Inserts at the
same edits), so the least pair of a joint span is made of least pairs of its parts.  As every derivation
passes every place between two rows at some state, one split of a span suffices: spans are joined with
their neighbours by doubling length, inside a task up to ``SEGMENT`` rows and then in a tree of fan-in
``FAN_IN`` over segments, so a conversation that holds a third of all rows is parsed by many tasks.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, write_table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5        # costs; the last one adds to Keep and Rerole
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}      # (state, role initial) -> state
STATES, ENDS = 4, (0, 3)
LEGAL = ("su", "ua", "au")
SEGMENT = 4096
FAN_IN = 64
CACHED = 24                # longest span of codes whose cell a worker remembers
BLANKS = " \t\n\x0b\x0c\r"
Cell = tuple               # STATES * STATES entries (cost, audit), None where no derivation leads from p to q


def join(left: Cell, right: Cell) -> Cell:
    """The cell of two neighbouring spans."""
    out: list = [None] * (STATES * STATES)
    for p in range(STATES):
        for r in range(STATES):
            a = left[p * STATES + r]
            if a is None:
                continue
            for q in range(STATES):
                b = right[r * STATES + q]
                if b is not None:
                    both = (a[0] + b[0], a[1] + b[1])
                    at = p * STATES + q
                    if out[at] is None or both < out[at]:
                        out[at] = both
    return tuple(out)


def _insertions() -> Cell:
    """Cells of the empty span: Insert steps, closed."""
    out: list = [None] * (STATES * STATES)
    for p in range(STATES):
        out[p * STATES + p] = (0, "")
        for role in "ua":
            if (p, role) in STEPS:
                out[p * STATES + STEPS[p, role]] = (INSERT, "I")
    cell = tuple(out)
    while (more := tuple(min(x for x in (a, b) if x is not None) if a or b else None
                         for a, b in zip(cell, join(cell, cell), strict=True))) != cell:
        cell = more
    return cell


NOTHING = _insertions()


@lru_cache(maxsize=64)
def leaf(code: str) -> Cell:
    """The cell of one row and of Inserts behind it.  ``code``: a role initial (s, u, a, o for any other), as
    a capital where the row is truncated; x for a row that has to go."""
    out: list = [None] * (STATES * STATES)

    def offer(p: int, q: int, cost: int, edit: str) -> None:
        at = p * STATES + q
        if out[at] is None or (cost, edit) < out[at]:
            out[at] = (cost, edit)

    for p in range(STATES):
        offer(p, p, DELETE, "D")
        if code == "x":
            continue
        more = TRUNCATED if code.isupper() else 0
        if (p, code.lower()) in STEPS:
            offer(p, STEPS[p, code.lower()], KEEP + more, "K")
        for role in "ua":
            if (p, role) in STEPS:
                offer(p, STEPS[p, role], REROLE + more, "R")
    return join(tuple(out), NOTHING)


def joined(cells: list[Cell]) -> Cell:
    """Neighbours joined bottom-up, spans doubling in length."""
    while len(cells) > 1:
        cells = [join(*cells[i:i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0]


@lru_cache(maxsize=1 << 15)
def _remembered(codes: str) -> Cell:
    return joined([leaf(c) for c in codes])


def span(codes: str) -> Cell:
    """The cell of a run of rows (at least one)."""
    return joined([_remembered(codes[i:i + CACHED]) for i in range(0, len(codes), CACHED)])


def cheapest(cell: Cell | None) -> tuple[int, str]:
    """(cost, audit) of a whole conversation from the cell of its rows."""
    whole = NOTHING if cell is None else join(NOTHING, cell)
    return min(whole[q] for q in ENDS if whole[q] is not None)


def conversation_key(conv_id: Column) -> Column:
    """A string per conversation, the null id's included."""
    return F.coalesce(F.concat(F.lit("c"), conv_id.cast("string")), F.lit(""))


def numbered(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> ck, at, turn, role, text, materialised: ``at`` numbers all rows in the
    order of conversations, and of turn (nulls first), role and text within one.  Rows are range-partitioned
    on a bounded part of the text, so no conversation has to fit a task."""
    rows = rows.select(conversation_key(F.col("conv_id")).alias("ck"), "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                       F.coalesce("text", F.lit(" ")).alias("text"))
    dealt = (rows.repartitionByRange("ck", F.col("turn").asc_nulls_first(), "role", F.substring("text", 1, 32))
             .sortWithinPartitions("ck", F.col("turn").asc_nulls_first(), "role", "text"))
    kept = write_table(dealt.withColumn("at", F.monotonically_increasing_id()), "turns")
    # One row per task; its rows before are added, so numbers have no holes.
    task = F.shiftright("at", 33)
    sizes = kept.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return (kept.withColumn("task", task).join(F.broadcast(starts), "task")
            .withColumn("at", F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("task", "start"))


def faults(rows: DataFrame) -> DataFrame:
    """(ck, at, role, text) -> ck, at, initial, fault: a row's first of blank, duplicate, truncated, else null.
    A duplicate is found by the least number of its (conversation, role, text), an aggregation."""
    end = F.rtrim("text", F.lit(BLANKS))
    rows = rows.select("ck", "at", F.substring("role", 1, 1).alias("initial"), F.right(end, F.lit(1)).alias("end"),
                       F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("said"))
    first = rows.groupBy("ck", "said").agg(F.min("at").alias("first"))
    fault = (F.when(F.col("end") == "", "blank").when(F.col("at") > F.col("first"), "duplicate")
             .when(~F.col("end").isin(".", "!", "?"), "truncated"))
    return rows.join(first, ["ck", "said"]).select("ck", "at", "initial", fault.alias("fault"))


_SPAN = T.StructType([T.StructField(n, t) for n, t in (
    ("ck", T.StringType()), ("at", T.LongType()), ("n", T.LongType()), ("blank", T.LongType()), ("duplicate", T.LongType()),
    ("truncated", T.LongType()), ("illegal", T.LongType()), ("first", T.StringType()), ("last", T.StringType()),
    ("costs", T.ArrayType(T.LongType())), ("audits", T.ArrayType(T.StringType())))])
_COUNTS = ("n", "blank", "duplicate", "truncated", "illegal")


def _spans(batches):
    """Sorted rows -> one row per (conversation, segment)."""
    at: tuple | None = None
    codes: list[str] = []
    counts: dict = {}

    def close() -> dict:
        cell = span("".join(codes))
        return {"ck": at[0], "at": counts["at"], **{c: counts[c] for c in _COUNTS}, "first": counts["first"], "last": counts["last"],
                "costs": [x and x[0] for x in cell], "audits": [x and x[1] for x in cell]}

    schema = pa.schema([("ck", pa.string()), ("at", pa.int64()), *((c, pa.int64()) for c in _COUNTS), ("first", pa.string()),
                        ("last", pa.string()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))])
    for b in batches:
        out = []
        for ck, n, seg, initial, fault in zip(*(b.column(c).to_pylist() for c in ("ck", "at", "seg", "initial", "fault")), strict=True):
            if at != (ck, seg):
                if at is not None:
                    out.append(close())
                at, codes = (ck, seg), []
                counts = {"at": n, "first": initial, "last": None, **dict.fromkeys(_COUNTS, 0)}
            counts["n"] += 1
            if fault:
                counts[fault] += 1
            if counts["last"] is not None and counts["last"] + initial not in LEGAL:
                counts["illegal"] += 1
            counts["last"] = initial
            code = initial if initial in ("s", "u", "a") else "o"
            codes.append("x" if fault in ("blank", "duplicate") else code.upper() if fault else code)
        yield pa.RecordBatch.from_pylist(out, schema)
    if at is not None:
        yield pa.RecordBatch.from_pylist([close()], schema)


def _unite(t: pa.Table) -> pa.Table:
    parts = t.sort_by("at").to_pylist()
    one = {**parts[0], **{c: sum(p[c] for p in parts) for c in _COUNTS}, "last": parts[-1]["last"]}
    one["illegal"] += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(parts, parts[1:], strict=False))
    cell = joined([tuple((c, a) if c is not None else None for c, a in zip(p["costs"], p["audits"], strict=True)) for p in parts])
    one["costs"], one["audits"] = [x and x[0] for x in cell], [x and x[1] for x in cell]
    return pa.Table.from_pylist([one], t.schema)


def parsed(rows: DataFrame) -> DataFrame:
    """Numbered rows -> one row per conversation: ck, rows, blank, duplicate, truncated, illegal (neighbouring
    initials that no legal sequence has), cost, audit."""
    marked = faults(rows).withColumn("seg", F.floor(F.col("at") / SEGMENT))
    spans = cut(marked.repartition("ck", "seg").sortWithinPartitions("ck", "at").mapInArrow(_spans, _SPAN))
    last = spans.agg(F.max("at")).first()[0]
    size = SEGMENT
    while last is not None and last >= size:
        size *= FAN_IN
        block = F.floor(F.col("at") / size)
        alone = Window.partitionBy("ck", "block")
        counted = spans.withColumn("block", block).withColumn("parts", F.count(F.lit(1)).over(alone))
        many = counted.where("parts > 1")
        spans = cut(counted.where("parts = 1").drop("block", "parts").unionByName(
            many.drop("parts").groupBy("ck", "block").applyInArrow(
                lambda t: _unite(t.drop_columns(["block"])), _SPAN)))

    @F.pandas_udf("cost long, audit string")
    def best(costs, audits):
        import pandas as pd

        found = [cheapest(tuple((int(c), a) if a is not None else None for c, a in zip(cs, xs, strict=True)))
                 for cs, xs in zip(costs, audits, strict=True)]
        return pd.DataFrame(found, columns=["cost", "audit"])

    return spans.withColumn("best", best("costs", "audits")).select(
        "ck", F.col("n").alias("rows"), "blank", "duplicate", "truncated", "illegal", "best.cost", "best.audit")


_REPAIRED = "ck string, place long, turn long, role string, text string, edit string"


def _apply(batches):
    """Each conversation's audit and then its rows, in order -> its repaired rows."""
    ck, audit, at, state, place = None, "", 0, 0, 0
    out: list[tuple] = []

    def put(turn, role: str, text: str, edit: str) -> None:
        nonlocal state, place
        state = STEPS[state, role[:1]]
        out.append((ck, place, turn, role, text, edit))
        place += 1

    def wanted() -> str:
        return "assistant" if state == 2 else "user"

    def inserts() -> None:
        nonlocal at
        while audit[at:at + 1] == "I":
            put(None, wanted(), "", "I")
            at += 1

    def batch() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [()] * 6
        out.clear()
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                          names=["ck", "place", "turn", "role", "text", "edit"])

    for b in batches:
        for key, of, turn, role, text in zip(*(b.column(c).to_pylist() for c in ("ck", "audit", "turn", "role", "text")), strict=True):
            if of is not None:
                ck, audit, at, state, place = key, of, 0, 0, 0
                inserts()
                continue
            edit = audit[at]
            at += 1
            if edit != "D":
                put(turn, role if edit == "K" else wanted(), text, edit)
            inserts()
        yield batch()


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Numbered rows and (ck, audit) -> the repaired rows ck, place (from 0), turn (null: inserted), role, text,
    edit (K, R or I), in order within each partition and a conversation's all in one."""
    head = audits.select("ck", F.lit(-1).cast("long").alias("at"), "audit", F.lit(None).cast("long").alias("turn"),
                         F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    body = rows.select("ck", "at", F.lit(None).cast("string").alias("audit"), F.col("turn").cast("long"), "role", "text")
    return head.unionByName(body).repartition("ck").sortWithinPartitions("ck", "at").mapInArrow(_apply, _REPAIRED)


def digests(rows: DataFrame) -> DataFrame:
    """Repaired rows as ``repaired`` returns them -> ck, repaired_sha256 of ``role:text`` lines joined by a newline."""
    def run(batches):
        ck, sha = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"ck": [ck], "repaired_sha256": [sha.hexdigest()]})

        for b in batches:
            for key, role, text in zip(*(b.column(c).to_pylist() for c in ("ck", "role", "text")), strict=True):
                if key != ck:
                    if sha is not None:
                        yield done()
                    ck, sha = key, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
        if sha is not None:
            yield done()

    return rows.mapInArrow(run, "ck string, repaired_sha256 string")


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(conv_id, turn, role, text, ...) -> (numbered rows, one row per conversation as ``parsed``, repaired rows).

    Null roles and texts are one space, so such a row is blank or has no legal role; a null conv_id is a
    conversation of its own; null turns come first; rows of one turn stand by role, then text, so rows that repeat
    are neighbours and all but the first are duplicates; other columns are not read; an empty table gives
    empty results.  What one task streams is a conversation's rows on their way to its repaired rows (a digest
    over them is sequential); it holds that conversation's audit, a letter per row."""
    rows = numbered(conversations)
    found = cut(parsed(rows))
    return rows, found, repaired(rows, found)
