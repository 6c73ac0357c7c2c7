"""Tokens of ordinary Rust files by one pass of a pattern; the exact lexer decides wherever this one is not sure."""

from __future__ import annotations

import re

from .base import Tokens
from .rs_lexer import _CHAR, _CLOSE, _CODES, _PUNCT, RESERVED, WEAK
from .rs_lexer import lex as lex_exact

_NEST = r"/\*(?:[^*/]+|\*(?!/)|/(?!\*))*+\*/"
for _ in range(2):
    _NEST = rf"/\*(?:[^*/]+|\*(?!/)|/(?!\*)|{_NEST})*+\*/"
_STRINGS = r"(?:b|c)?r(?:\"[^\"]*\"|\#\"[\s\S]*?\"\#(?!\#)|\#\#\"[\s\S]*?\"\#\#(?!\#))|[bc]?\"[^\"\\]*(?:\\[\s\S][^\"\\]*)*\""
_ALL = re.compile(
    r"\s+|[^\W\d]\w*+(?![\"']|\#)|[(),;\[\]]|//[^\n]*|" + _NEST + "|" + _STRINGS + "|b?" + _CHAR + r"|'(?:[^\W\d]|_)\w*+(?!')|r\#[^\W\d]\w*+(?![\"'])|[^\W\d]\w*+(?![\"']|\#+\")|\d\w*+(?:\.(?![.\w])|\.\d\w*+)?(?:(?<=[eE])[+-]\w*+)?|" + _PUNCT
)
_INT = r"(?:[iu](?:8|16|32|64|128|size))?"
_A_NUMBER = re.compile(rf"0x[0-9a-fA-F_]+{_INT}|0o[0-7_]+{_INT}|0b[01_]+{_INT}|\d[\d_]*(?:\.|\.\d[\d_]*)?(?:[eE][+-]?_*\d[\d_]*)?(?:[iuf](?:8|16|32|64|128|size))?")
_BRACKETS = frozenset("()[]{}")


class _Kinds(dict):
    """The class of a token from its text: kind and key character; None for blanks and comments, False for what the exact lexer must see."""

    LIMIT = 300_000

    def __missing__(self, w):
        c = w[0]
        if c.isspace() or w[:2] in ("//", "/*"):
            k = None
        elif c == "'":
            k = ("char", _CODES["char"]) if len(w) > 2 and w[-1] == "'" else ("life", _CODES["life"])
        elif c.isdigit():
            k = ("num", _CODES["num"]) if _A_NUMBER.fullmatch(w) else False
        elif w[-1] == '"' or (w[-1] == "#" and len(w) > 2):
            k = ("str", _CODES["str"])
        elif w[-1] == "'":
            k = ("char", _CODES["char"])
        elif c.isalpha() or c == "_":
            k = (w, _CODES[w]) if w in RESERVED else ("name", _CODES[w if w in WEAK else "name"])
        else:
            k = (w, _CODES[w])
        if len(self) >= self.LIMIT:
            self.clear()
        self[w] = k
        return k


_KIND_OF = _Kinds()


def lex_plain(src: str) -> Tokens | None:
    """The tokens, or None for a file with lexical faults or rare forms."""
    if src.startswith(("#!", "\ufeff")):
        return None
    words = _ALL.findall(src)
    if sum(map(len, words)) != len(src):
        return None
    t = Tokens()
    kind, start, end, keys = t.kind, t.start, t.end, []
    kind_add, start_add, end_add, key_add = kind.append, start.append, end.append, keys.append
    stack: list[tuple[str, int]] = []
    pairs = []
    pos = 0
    for w, k in zip(words, map(_KIND_OF.__getitem__, words)):
        e = pos + len(w)
        if k is None:
            pos = e
            continue
        if k is False:
            return None
        q = k[0]
        kind_add(q)
        start_add(pos)
        end_add(e)
        key_add(k[1])
        if q in _BRACKETS:
            if q in "([{":
                stack.append((q, len(kind) - 1))
            elif stack and stack[-1][0] == _CLOSE[q]:
                pairs.append((stack.pop()[1], len(kind) - 1))
            else:
                return None
        pos = e
    if stack:
        return None
    kind_add("eof")
    start_add(pos)
    end_add(pos)
    key_add(_CODES["eof"])
    t.match = [-1] * len(kind)
    for a, b in pairs:
        t.match[a], t.match[b] = b, a
    t.key = "".join(keys)
    return t


def lex(src: str) -> Tokens:
    """The tokens of a file."""
    return lex_plain(src) or lex_exact(src)
