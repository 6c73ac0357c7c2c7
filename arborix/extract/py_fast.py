"""Tokens of ordinary Python files by one pass of a pattern; the exact lexer decides wherever this one is not sure."""

from __future__ import annotations

import re

from .base import Tokens
from .py_lexer import _CODES, _NUM, _OPENER, _PUNCT, MAX_BRACKETS, MAX_INDENTS, RESERVED, SOFT, _f_end
from .py_lexer import lex as lex_exact

_NL = r"(?:\r\n|\n|\r)(?:[ \t\f]*(?:#[^\n\r]*)?(?:\r\n|\n|\r))*(?:[ \t\f]*(?:#[^\n\r]*)?\Z)?[ \t\f]*"
_FIELD = r"\{[^{}\"'\n\r\\]*\}"
_TRIPLE = r"\"\"\"[^\"\\]*(?:(?:\\[\s\S]|\"(?!\"\"))[^\"\\]*)*\"\"\"|'''[^'\\]*(?:(?:\\[\s\S]|'(?!''))[^'\\]*)*'''"
_SINGLE = r"\"[^\"\\\n\r]*(?:\\(?:\r\n|[\s\S])[^\"\\\n\r]*)*\"(?!\")|'[^'\\\n\r]*(?:\\(?:\r\n|[\s\S])[^'\\\n\r]*)*'(?!')"
_F_BODY = r"\\[^\n\rN]|\{\{|\}\}|" + _FIELD
_F_STRING = rf"(?:[fF][rR]?|[rR][fF])(?:\"(?:[^\"\\\n\r{{}}]+|{_F_BODY})*+\"(?!\")|'(?:[^'\\\n\r{{}}]+|{_F_BODY})*+'(?!'))"
_ALL = re.compile(
    r"[ \t]+|[^\W\d]\w*+(?![\"'])|[()\[\],.](?![.\d])|" + _NL + r"|\\\r?\n|\#[^\n\r]*|\d[\w.]*+(?:(?<=[eE])[+-]\w*+)?|\.\d[\w.]*+|(?:[rRuU]|[bB][rR]?|[rR][bB])?(?:" + _TRIPLE + "|" + _SINGLE + ")|" + _F_STRING + "|" + _PUNCT
)
_LEAD = re.compile(r"(?:[ \t\f]*(?:#[^\n\r]*)?(?:\r\n|\n|\r))*(?:[ \t\f]*(?:#[^\n\r]*)?\Z)?[ \t\f]*")
_A_NUMBER = re.compile(_NUM)
_F_HEAD = re.compile(r"[fFrR]+")
_BRACKETS = frozenset("()[]{}")


class _Kinds(dict):
    """The class of a token from its text: kind and key character; None for blanks and comments, False for what the exact lexer must see."""

    LIMIT = 300_000

    def __missing__(self, w):
        c = w[0]
        if c in "\n\r":
            k = ("newline", _CODES["newline"])
        elif c in " \t#\\":
            k = None
        elif c.isalpha() or c == "_":
            if w[-1] in "\"'":
                head = w[: min(w.find(x) for x in "\"'" if x in w)].lower()
                k = ("fstr", _CODES["str"]) if "f" in head else ("bytes", _CODES["bytes"]) if "b" in head else ("str", _CODES["str"])
            else:
                k = (w, _CODES[w]) if w in RESERVED else ("name", _CODES[w if w in SOFT else "name"])
        elif c in "\"'":
            k = ("str", _CODES["str"])
        elif c.isdigit() or (c == "." and len(w) > 1 and w[1].isdigit()):
            plain = w.replace("_", "")
            zeros = len(w) > 1 and c == "0" and plain.isdigit() and plain.strip("0")
            k = ("num", _CODES["num"]) if _A_NUMBER.fullmatch(w) and not zeros else False
        elif ord(c) > 127:
            k = False
        else:
            k = (w, _CODES[w])
        if len(self) >= self.LIMIT:
            self.clear()
        self[w] = k
        return k


_KIND_OF = _Kinds()


def _indent_of(text: str) -> str:
    return text[max(text.rfind("\n"), text.rfind("\r")) + 1 :]


def lex_plain(src: str) -> tuple[Tokens, list] | None:
    """The tokens, or None for a file with lexical faults or rare forms."""
    lead = _LEAD.match(src).end()
    words = _ALL.findall(src, lead)
    if sum(map(len, words)) != len(src) - lead:
        return None
    t = Tokens()
    kind, start, end, keys, holes, pairs = t.kind, t.start, t.end, [], [], []
    kind_add, start_add, end_add, key_add = kind.append, start.append, end.append, keys.append
    stack: list[tuple[str, int]] = []
    levels = [""]

    def add(k: str, a: int, b: int) -> None:
        kind_add(k)
        start_add(a)
        end_add(b)
        key_add(_CODES[k])

    def level(ind: str, at: int) -> bool:
        top = levels[-1]
        if ind == top:
            return True
        if "\t" in ind or "\f" in ind:
            return False
        if len(ind) > len(top):
            if len(levels) == MAX_INDENTS:
                return False
            levels.append(ind)
            add("indent", at, at)
            return True
        while len(levels[-1]) > len(ind):
            levels.pop()
            add("dedent", at, at)
        return levels[-1] == ind

    n, pos = len(src), lead
    if pos < n and not level(_indent_of(src[:lead]), pos):
        return None
    for w, k in zip(words, map(_KIND_OF.__getitem__, words)):
        e = pos + len(w)
        if k is None:
            pos = e
            continue
        if k is False:
            return None
        q = k[0]
        if q == "newline":
            if not stack:
                # only the line break itself is the token
                add(q, pos, pos + (2 if w[:2] == "\r\n" else 1))
                if e < n and not level(_indent_of(w), e):
                    return None
            pos = e
            continue
        if q == "fstr":
            head = _F_HEAD.match(w).end()
            if _f_end(src, pos + head + 1, w[head], "r" in w[:head].lower(), holes, False) != e:
                return None
            q = "str"
        kind_add(q)
        start_add(pos)
        end_add(e)
        key_add(k[1])
        if q in _BRACKETS:
            if q in "([{":
                if len(stack) == MAX_BRACKETS:
                    return None
                stack.append((q, len(kind) - 1))
            elif stack and stack[-1][0] == _OPENER[q]:
                pairs.append((stack.pop()[1], len(kind) - 1))
            else:
                return None
        pos = e
    if stack:
        return None
    if kind and kind[-1] not in ("newline", "indent", "dedent"):
        add("newline", n, n)
    for _ in levels[1:]:
        add("dedent", n, n)
    add("eof", n, n)
    t.match = [-1] * len(kind)
    for a, b in pairs:
        t.match[a], t.match[b] = b, a
    t.key = "".join(keys)
    return t, holes


def lex(src: str) -> tuple[Tokens, list]:
    """The tokens of a file and the replacement fields of its f-strings."""
    return lex_plain(src) or lex_exact(src)
