"""Token ids of whole texts with a public tokenizer, cached by chunk."""

from __future__ import annotations

import json
import os
import re
import string
import struct

import numpy as np

CACHE_CHUNKS = 900_000
# White space other than blank and newline; texts with it are cut by the careful pattern below.
_ODD = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_ODD_ASCII = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
# A full stop or comma that doesn't follow a letter or digit, or that other punctuation follows.
_RUN = [re.compile(mark + r"(?:(?<![^\W_].)|(?=[^\w\s]|_))", re.DOTALL) for mark in (r"\.", ",")]
# Byte-level alphabets write printable Latin-1 bytes as themselves and the others from U+0100 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)).difference(_PLAIN)))}
_BLANK = _BYTE_CHARS[32]
_MARKS = string.punctuation.replace("'", "")
_ID = struct.Struct("<I").pack
_READY: dict[str, Encoder] = {}


class Encoder:
    """Ids as little-endian unsigned 32-bit integers.  Byte-level BPE never joins across a blank or
    newline that stands between non-blanks, nor a letter with a full stop or comma, so a text is cut
    there and each distinct chunk goes to the tokenizers library once.  Other kinds of tokenizer get
    whole texts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.cuts = (pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
                     and spec.get("normalizer") is None)
        self.added = [x["content"] for x in spec.get("added_tokens", [])]
        self.model = self.tok.model
        self.cache = _Cache(self.chunk)

    def _each(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> bytes:
        seen = piece.replace(" ", _BLANK) if piece.isascii() else piece.encode("utf-8").decode("latin-1").translate(_BYTE_CHARS)
        return b"".join([_ID(t.id) for t in self.model.tokenize(seen)])

    def chunk(self, key: str) -> bytes:
        """Ids of a chunk.  A word of letters, with or without the blank before it, is one piece for the model,
        and so is ASCII punctuation other than apostrophes, alone or after such a word; other chunks go
        through the whole tokenizer."""
        c = key[1:] if key[:1] == "\0" else " " + key
        if c.removeprefix(" ").isalpha():
            return self._piece(c)
        word = c.rstrip(_MARKS)
        if c and not word:
            return self._piece(c)
        if word.removeprefix(" ").isalpha():
            return self._piece(word) + self.cache["\0" + c[len(word):]]
        return self._each([c])[0]

    def _chunks(self, text: str) -> list[str] | None:
        """Keys of the cache: a chunk that follows a blank without it, others behind a NUL mark."""
        if not self.cuts or "\0" in text or any(a in text for a in self.added):
            return None
        odd = any(c in text for c in _ODD_ASCII) if text.isascii() else _ODD.search(text)
        if odd or "  " in text or " \n" in text or "\n " in text or "\n\n" in text:
            return ["\0" + c for c in _CUT.split(text)]
        text = text.replace("\n", " \0\n \0")
        if not any(run.search(text) for run in _RUN):
            text = text.replace(".", " \0.").replace(",", " \0,")
        parts = text.split(" ")
        parts[0] = "\0" + parts[0]
        return parts

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each whole text (null: none).  The cache is bounded; a chunk that isn't in it is
        encoded once per call."""
        out, get = [], self.cache.__getitem__
        for t in texts:
            chunks = self._chunks(t) if t else []
            out.append(self._each([t])[0] if chunks is None else b"".join(map(get, chunks)))
        self.cache.more.clear()
        return out


class _Cache(dict):
    """Ids by chunk, encoded when first asked for; beyond ``CACHE_CHUNKS`` kept in ``more`` for the call."""

    def __init__(self, encode):
        self.encode = encode
        self.more: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        ids = self.more.get(key)
        if ids is None:
            ids = self.encode(key)
            (self if len(self) < CACHE_CHUNKS else self.more)[key] = ids
        return ids


def encoder(path: str) -> Encoder:
    """The worker's encoder for ``path``; workers that Spark reuses keep it."""
    if path not in _READY:
        _READY[path] = Encoder(path)
    return _READY[path]


def groups(texts: list[str | None], chars: int = 1 << 20):
    """(from, to) ranges of ``texts`` of about ``chars`` characters each."""
    a = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= chars:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)
