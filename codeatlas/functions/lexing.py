"""Lexical state of JavaScript and TypeScript text: what is code, and which brackets belong together.

A character automaton with the states code, string, template, block comment, line comment and regular
expression.  ``${`` inside a template opens code again, to any depth; its closing brace returns to the
template.  Text outside code is blanked, line ends kept, so every offset stays what it was.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field
from functools import cached_property

_NEXT = re.compile(r"[\"'`/(){}\[\]]")
_STRING = {q: re.compile(rf"(?:[^{q}\\\n]|\\.)*{q}", re.DOTALL) for q in "\"'"}
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*(`|\$\{)", re.DOTALL)
_REGEX = re.compile(r"(?:[^\\\n/\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_WORD_BEFORE = re.compile(r"[\w$]+\Z")
_NOT_NEWLINE = re.compile(r"[^\n]")
_OPENS = {")": "(", "]": "[", "}": "{"}
# A slash after one of these begins a regular expression, after anything else it divides.
_BEFORE_REGEX = set("(,=:[!&|?{};+-*%~^>")
_WORDS_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "void", "delete", "throw", "new", "instanceof", "do", "else", "yield", "await"}


@dataclass
class Lexed:
    """``code``: the text with all but code blanked; ``closes``/``opens``: offset of each bracket's partner;
    ``problem``: (offset, reason) of the first error, or None."""

    code: str
    closes: dict[int, int] = field(default_factory=dict)
    opens: dict[int, int] = field(default_factory=dict)
    problem: tuple[int, str] | None = None

    @cached_property
    def _nest(self) -> tuple[list[int], list[int]]:
        """Offsets of all paired opening brackets, and of each the place of the one around it (-1: none)."""
        begins, outer, stack = sorted(self.closes), [], []
        for i, o in enumerate(begins):
            while stack and self.closes[begins[stack[-1]]] < o:
                stack.pop()
            outer.append(stack[-1] if stack else -1)
            stack.append(i)
        return begins, outer

    def around(self, at: int) -> int | None:
        """Offset of the innermost bracket that is open at ``at``."""
        begins, outer = self._nest
        i = bisect_left(begins, at) - 1
        while i >= 0 and self.closes[begins[i]] < at:
            i = outer[i]
        return begins[i] if i >= 0 else None


def _blank(text: str) -> str:
    return " " * len(text) if "\n" not in text else _NOT_NEWLINE.sub(" ", text)


def _starts_regex(text: str, at: int, before: str) -> bool:
    """Whether the slash at ``at`` begins a regular expression, ``before`` being the code in front of it."""
    follows = text[at + 1:at + 2]
    before = before.rstrip()
    if not before:
        return True
    if before[-1] == "<" or follows == ">":
        return False                              # a closing tag of markup within code
    if before[-1] in _BEFORE_REGEX:
        return True
    word = _WORD_BEFORE.search(before)
    return word is not None and word[0] in _WORDS_BEFORE_REGEX


def lex(text: str) -> Lexed:
    """Run the automaton over ``text``.  Brackets pair within code; a brace that closes leaves round and square
    ones that are still open unpaired (markup text may hold them), but braces themselves have to balance."""
    out: list[str] = []
    done = Lexed("")
    open_: list[tuple[str, int]] = []
    at = end = 0                                  # code up to `end` is in `out`

    def fail(offset: int, reason: str) -> None:
        if done.problem is None:
            done.problem = (offset, reason)

    def skip(to: int) -> None:
        nonlocal end, at
        out.append(_blank(text[end:to]))
        end = at = to

    def template(start: int) -> None:
        """From ``start`` within a template to its end or into its next code part."""
        m = _TEMPLATE.match(text, start)
        if m is None:
            fail(start - 1, "open template")
            skip(len(text))
            return
        if m[1] == "${":
            open_.append(("${", m.end() - 2))
        skip(m.end())

    while (m := _NEXT.search(text, at)) is not None:
        k, ch = m.start(), m[0]
        at = k + 1
        if ch in "([{":
            open_.append((ch, k))
        elif ch in ")]}":
            if ch == "}":
                while open_ and open_[-1][0] in "([":
                    open_.pop()
                if open_ and open_[-1][0] == "${":
                    open_.pop()
                    out.append(text[end:k])
                    end = k
                    template(k + 1)
                    continue
                if not open_:
                    fail(k, "unbalanced brace")
            if open_ and open_[-1][0] == _OPENS[ch]:
                _, begin = open_.pop()
                done.closes[begin], done.opens[k] = k, begin
        else:
            follows = text[k + 1:k + 2]
            if ch == "/" and follows not in ("/", "*"):
                before = "".join((*out[-2:], text[end:k]))[-64:]
                found = _REGEX.match(text, k + 1) if _starts_regex(text, k, before) else None
                if found is None:
                    continue
                to = found.end()
            elif ch == "/":
                to = text.find("\n", k) if follows == "/" else text.find("*/", k + 2) + 2
                if to < 2 and follows == "*":
                    fail(k, "open comment")
                if to < 2:
                    to = len(text)
            elif ch != "`":
                found = _STRING[ch].match(text, k + 1)
                if found is None:
                    if not text[k - 1:k].isalnum():              # an apostrophe within a word is text of markup
                        fail(k, "open string")
                    continue
                to = found.end()
            out.append(text[end:k])
            end = k
            if ch == "`":
                template(k + 1)
            else:
                skip(to)
    out.append(text[end:])
    for ch, k in open_:
        if ch == "${":
            fail(k, "open template")
        elif ch == "{":
            fail(k, "unclosed brace")
    done.code = "".join(out)
    return done
