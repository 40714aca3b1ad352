"""Chat formatting: a finite-state machine over roles and a declarative template."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import write_table


@dataclass(frozen=True)
class Turn:
    opens: str
    closes: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Markers per role, the marker pair that carries any other role's name, and the turn order."""

    turns: dict[str, Turn] = field(default_factory=lambda: {
        "system": Turn("[SYS]", "[/SYS]"), "user": Turn("[INST]", "[/INST]"), "assistant": Turn("<s>", "</s>", loss=True)})
    other: Turn = Turn("[TURN]", "[/TURN]")
    name_ends: str = "[AS]"
    no_role: str = "[NONE]"           # stands for a null role
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    ends: tuple[str, ...] = ("assistant",)

    def controls(self) -> list[str]:
        """Every control string; each starts with [ or < and has neither further on, nor a backslash."""
        own = [s for t in (*self.turns.values(), self.other) for s in (t.opens, t.closes)]
        return [*own, self.name_ends, self.no_role]


LLAMA = Template()


def _escapes(t: Template):
    """(escape, unescape): a backslash is doubled, and one is put behind the first character of what
    reads as a control string.  So no control string is left in an escaped text, and none can form
    where it meets a marker."""
    look = "|".join(re.escape(c[1:]) for c in t.controls())
    starts = re.compile(rf"([\[<])(?={look})")
    back = re.compile(r"\\(\\?)")
    return (lambda s: starts.sub(r"\1\\", s.replace("\\", "\\\\")), lambda s: back.sub(r"\1", s))


def segments_of(role: str | None, text: str | None, t: Template, escape) -> list[tuple[str, bool]]:
    """A turn as (segment, loss flag): opening marker, escaped text, closing marker."""
    turn = t.turns.get(role, t.other) if role is not None else t.other
    head = turn.opens
    if turn is t.other:
        head += (t.no_role if role is None else escape(role)) + t.name_ends
    return [(head, False), (escape(text or ""), turn.loss), (turn.closes, False)]


def formatted(rows: DataFrame, t: Template = LLAMA) -> DataFrame:
    """(conv_id, turn, role, text) -> segments: conv_id, seg_no, segment, loss, state, valid.

    A conversation's rows in order of turn (null last; ties by role and text) run through the turn
    order of the template: ``state`` is the role the machine is in after the turn (``invalid`` from the
    first turn it doesn't allow), ``valid`` tells whether no turn broke it so far; all turns are
    formatted.  Concatenated by seg_no the segments are the formatted text.  A null text is empty; a
    null or unknown role is named by a marker; rows with null conv_id form one conversation; an empty
    table gives no segment.  Rows are dealt by conv_id and streamed in order: a task holds one row and
    the state of one conversation, so a very long conversation takes time in one task, not memory.
    """
    def run(batches):
        escape, _ = _escapes(t)
        at, state, seg = object(), "", 0
        for pdf in batches:
            out = []
            for conv, role, text in zip(pdf["conv_id"], pdf["role"], pdf["text"], strict=True):
                conv = None if pd.isna(conv) else int(conv)
                if conv != at:
                    at, state, seg = conv, "", 0
                if state != "invalid":
                    state = role if role in t.follows.get(state, ()) else "invalid"
                for s, loss in segments_of(role, text, t, escape):
                    out.append((conv, seg, s, loss, state, state != "invalid"))
                    seg += 1
            df = pd.DataFrame(out, columns=["conv_id", "seg_no", "segment", "loss", "state", "valid"])
            yield df.astype({"conv_id": "Int64"})

    ordered = (rows.select("conv_id", "turn", "role", "text").repartition("conv_id")
               .sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text"))
    # Nulls make pandas turn integers into floats; ids travel as text.
    return (ordered.select(F.col("conv_id").cast("string").alias("conv_id"), "role", "text")
            .mapInPandas(run, "conv_id long, seg_no long, segment string, loss boolean, state string, valid boolean"))


def read_back(segments: DataFrame, t: Template = LLAMA) -> DataFrame:
    """Segments -> per conversation what their formatted text says: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars, valid, complete.

    The text of a conversation is read as one stream, in order of seg_no; turns are found by their
    markers alone, the loss mask comes from the segments' flags.  Digests run along."""
    def run(batches):
        marks = re.compile("|".join(re.escape(c) for c in sorted(t.controls(), key=len, reverse=True)))
        unescape = _escapes(t)[1]
        by_open = {v.opens: r for r, v in t.turns.items()}
        closing = {v.closes for v in (*t.turns.values(), t.other)}
        at, st = object(), None

        def result():
            if st["rest"] or st["role"] is not _NO_TURN:
                raise ValueError(f"conversation {at}: text outside of turns")
            return (at, st["n"], st["turns"].hexdigest(), st["chars"], st["loss"].hexdigest(), st["all"], st["valid"],
                    st["valid"] and st["state"] in t.ends)

        def read():
            """Consume whole markers and the texts before them from what has been gathered."""
            buf, pos = "".join(st["rest"]), 0
            for m in marks.finditer(buf):
                body, mark, pos = buf[pos:m.start()], m[0], m.end()
                if mark in by_open:
                    st["role"] = by_open[mark]
                elif mark == t.other.opens:
                    st["role"], st["named"] = None, True
                elif mark == t.no_role:
                    st["named"] = False
                elif mark == t.name_ends:
                    st["role"] = unescape(body) if st["named"] else None
                elif mark in closing:
                    text = unescape(body)
                    role = st["role"]
                    st["turns"].update(f"{role if role is not None else ''}\n{text}\n".encode("utf-8", "surrogatepass"))
                    st["n"] += 1
                    st["role"] = _NO_TURN
            st["rest"] = [buf[pos:]] if pos < len(buf) else []

        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid", "complete"]
        for pdf in batches:
            out = []
            for conv, seg, loss, state, valid in zip(pdf["conv_id"], pdf["segment"], pdf["loss"], pdf["state"], pdf["valid"], strict=True):
                conv = None if pd.isna(conv) else int(conv)
                if conv != at:
                    if st is not None:
                        out.append(result())
                    at = conv
                    st = {"rest": [], "role": _NO_TURN, "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "chars": 0,
                          "all": 0, "valid": True, "state": "", "named": True}
                st["all"] += len(seg)
                st["state"], st["valid"] = state, valid
                if loss:
                    plain = unescape(seg)
                    st["loss"].update(plain.encode("utf-8", "surrogatepass"))
                    st["chars"] += len(plain)
                st["rest"].append(seg)
                if seg in closing:
                    read()
            yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})
        if st is not None:
            yield pd.DataFrame([result()], columns=names).astype({"conv_id": "Int64"})

    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "seg_no")
    return (ordered.select(F.col("conv_id").cast("string").alias("conv_id"), "segment", "loss", "state", "valid").mapInPandas(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
             "valid boolean, complete boolean"))


_NO_TURN = object()


def format_and_read(rows: DataFrame, t: Template = LLAMA) -> DataFrame:
    """Format, write the segments as a table, and read them back."""
    return read_back(write_table(formatted(rows, t), "chat"), t)
