"""Tokens of Python 3 with line and block structure."""

from __future__ import annotations

import re

from .base import Tokens, code

# The reserved words of the language.
RESERVED = frozenset(
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda "
    "nonlocal not or pass raise return try while with yield".split()
)
# Words with a meaning in some places only.
SOFT = frozenset(["match", "case", "type", "_", "print", "exec"])
_NUM = r"0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:\d(?:_?\d)*\.(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*|\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?"
_PUNCT = r"\*\*=|//=|>>=|<<=|\.\.\.|!=|->|:=|\*\*|//|>>|<<|<=|>=|==|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|[()\[\]{},:;.=+\-*/%&|^~<>@]"
TOKEN = re.compile(
    rf"(?P<ws>[ \t\f]+|\\\r?\n)|(?P<nl>\r\n|\n|\r)|(?P<com>\#[^\n\r]*)|(?P<num>(?=[.\d])(?:{_NUM}))"
    r"|(?P<str>(?:[rRuU]|[bB][rR]?|[rR][bB])?(?:\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''|\"[^\"\\\n\r]*(?:\\(?:\r\n|[\s\S])[^\"\\\n\r]*)*\"(?!\"(?<=^\"\"\"))|'[^'\\\n\r]*(?:\\(?:\r\n|[\s\S])[^'\\\n\r]*)*'))"
    r"|(?P<f>(?:[fFtT][rR]?|[rR][fFtT])(?:\"\"\"|'''|\"|'))|(?P<name>[^\W\d]\w*)|(?P<p>" + _PUNCT + ")"
)
_OPEN_STR = re.compile(r"(?:[rRuU]|[bB][rR]?|[rR][bB])?(\"\"\"|'''|\"|')")
_BLANK = re.compile(r"([ \t\f]*)(?:#[^\n\r]*)?(?:\r\n|\n|\r|$)")
_SIMPLE_FIELD = re.compile(r"\{[A-Za-z_][\w.]*(?:![rsa])?(?::[^{}'\"\n]*)?\}")
# lines that begin like this stand in no brackets
_STATEMENT = re.compile(r"[ \t]*(?:def|class|return|import|while|try|raise|assert|del|global|nonlocal|pass|break|continue|finally|except|elif|with)\b")
_BLANKS = re.compile(r"[ \t]*")
_KINDS = {w: w for w in RESERVED} | {w: "name" for w in SOFT}
_OPENER = {")": "(", "]": "[", "}": "{"}


class _Codes(dict):
    """The key character of a token class, made when first needed."""

    def __missing__(self, k):
        c = self[k] = code("py " + k)
        return c


_CODES = _Codes()


def _f_end(src: str, pos: int, quote: str, raw: bool, holes: list, line_ok: bool, spec: bool = False) -> int:
    """The offset after an f-string's text from ``pos``; the replacement fields go to ``holes``. -1: it doesn't end."""
    n = len(src)
    while pos < n:
        c = src[pos]
        if not spec and src.startswith(quote, pos):
            return pos + len(quote)
        if c == "\\" and not raw:
            pos += 2
            if src[pos - 1 : pos] == "N" and src[pos : pos + 1] == "{":
                e = src.find("}", pos)
                pos = pos if e < 0 else e + 1
        elif c == "\\":
            pos += 2
        elif c in "\r\n" and not line_ok:
            return -1
        elif c == "{":
            if not spec and src.startswith("{{", pos):
                pos += 2
                continue
            m = _SIMPLE_FIELD.match(src, pos)
            if m and (line_ok or quote not in m.group()):
                pos = m.end()
                continue
            pos = _hole(src, pos, quote, raw, holes, line_ok)
            if pos < 0:
                return -1
        elif c == "}":
            if spec:
                return pos
            if src.startswith("}}", pos):
                pos += 2
            else:
                holes.append((pos, pos, "single '}'"))
                pos += 1
        else:
            if spec and src.startswith(quote, pos):
                return -1
            pos += 1
    return -1


def _hole(src: str, pos: int, quote: str, raw: bool, holes: list, line_ok: bool) -> int:
    """The offset after the replacement field at ``pos``."""
    a = pos + 1
    pos, n, stack = a, len(src), []
    while pos < n:
        c = src[pos]
        m = TOKEN.match(src, pos)
        if m and m.lastgroup == "str":
            pos = m.end()
        elif m and m.lastgroup == "f":
            q = m.group().lstrip("fFrRtT")
            pos = _f_end(src, m.end(), q, "r" in m.group().lower()[:2], holes, len(q) == 3)
            if pos < 0:
                return -1
        elif c == "\n" and not line_ok and not stack:
            return -1
        elif c in "([{":
            stack.append(c)
            pos += 1
        elif c in ")]}" and stack:
            stack.pop()
            pos += 1
        elif c == "}" or (not stack and (c == ":" or (c == "!" and src[pos + 1 : pos + 2] != "="))):
            body = src[a:pos]
            if body.rstrip().endswith("=") and not re.search(r"[=!<>]=\s*$", body):
                body = body.rstrip()[:-1]
            holes.append((a, a + len(body), None))
            if c == "!":
                m = re.compile(r"![rsa]\s*").match(src, pos)
                if not m:
                    holes.append((pos, pos, "bad conversion"))
                    return -1
                pos = m.end()
                c = src[pos : pos + 1]
            if c == ":":
                pos = _f_end(src, pos + 1, quote, raw, holes, line_ok, spec=True)
                if pos < 0:
                    return -1
            return pos + 1 if src[pos : pos + 1] == "}" else -1
        elif m and m.lastgroup == "ws":
            pos = m.end()
        elif m and m.lastgroup == "name":
            pos = m.end()
        elif c in "\"'" or (c == ")" or c == "]"):
            return -1
        else:
            pos += 1
    return -1


# The language's own limits of open brackets and of levels of indentation, the outermost among them.
MAX_BRACKETS, MAX_INDENTS = 200, 100


def lex(src: str) -> tuple[Tokens, list]:
    """Tokens up to ``eof``, with ``newline``, ``indent`` and ``dedent``, and the replacement fields of f-strings as (start, end, fault)."""
    t = Tokens()
    kind, start, end, match, keys, holes = t.kind, t.start, t.end, t.match, [], []
    stack: list[tuple[str, int]] = []
    levels: list[str] = [""]
    token, codes, kinds, skip, name_code = TOKEN.match, _CODES, _KINDS.get, _BLANKS.match, _CODES["name"]
    kind_add, start_add, end_add, key_add = kind.append, start.append, end.append, keys.append
    pairs: list[tuple[int, int]] = []

    def add(k, a, b, key=None):
        kind.append(k)
        start.append(a)
        end.append(b)
        keys.append(codes[key or k])

    def bad(a, b, what):
        t.bad.append((a, what))
        add("bad", a, b)

    pos, n = 1 if src.startswith("﻿") else 0, len(src)
    fresh = True  # at the start of a logical line
    while pos < n:
        if fresh:
            m = _BLANK.match(src, pos)
            if m and (m.end() > m.end(1) or m.end() == n):
                pos = m.end()
                if pos >= n:
                    break
                continue
            e = pos
            while e < n and src[e] in " \t\f":
                e += 1
            ind = src[pos:e].rpartition("\f")[2]
            top = levels[-1]
            if ind != top:
                if ind.startswith(top):
                    if len(levels) == MAX_INDENTS:
                        bad(e, e, "too many levels of indentation")
                    levels.append(ind)
                    add("indent", e, e)
                elif ind.expandtabs(8) != ind or any("\t" in x for x in levels):
                    while len(levels) > 1 and levels[-1] != ind and len(levels[-1].expandtabs(8)) > len(ind.expandtabs(8)):
                        levels.pop()
                        add("dedent", e, e)
                    if levels[-1] != ind:
                        bad(e, e, "inconsistent use of tabs and spaces")
                        levels[-1] = ind
                else:
                    while len(levels) > 1 and len(levels[-1]) > len(ind):
                        levels.pop()
                        add("dedent", e, e)
                    if levels[-1] != ind:
                        bad(e, e, "unindent matches no outer level")
            pos, fresh = e, False
            continue
        m = token(src, pos)
        if m is None:
            c = src[pos]
            o = _OPEN_STR.match(src, pos)
            if o:
                if len(o.group(1)) == 3:
                    bad(pos, n, "unterminated triple-quoted string")
                    pos = n
                else:
                    e = min([x for x in (src.find("\n", pos), src.find("\r", pos)) if x >= 0], default=n)
                    bad(pos, e, "unterminated string")
                    pos = e
            else:
                bad(pos, pos + 1, f"stray character {c!r}")
                pos += 1
            continue
        g, e = m.lastgroup, m.end()
        if g == "name":
            w = m.group()
            k = kinds(w)
            kind_add(k or "name")
            start_add(pos)
            end_add(e)
            key_add(name_code if k is None else codes[w])
            pos = skip(src, e).end()
            continue
        if g == "p":
            p = m.group()
            kind_add(p)
            start_add(pos)
            end_add(e)
            key_add(codes[p])
            if p in "([{":
                if len(stack) == MAX_BRACKETS:
                    t.bad.append((pos, "too many nested brackets"))
                    kind[-1] = "bad"
                    keys[-1] = codes["bad"]
                stack.append((p, len(kind) - 1))
            elif p in ")]}":
                i = len(kind) - 1
                if stack and stack[-1][0] == _OPENER[p]:
                    pairs.append((stack.pop()[1], i))
                else:
                    what = f"{p!r} closes nothing" if not stack else f"{p!r} does not match {stack[-1][0]!r}"
                    t.bad.append((pos, what))
                    kind[-1] = "bad"
                    keys[-1] = codes["bad"]
                    if stack:
                        stack.pop()
            pos = skip(src, e).end()
            continue
        if g == "ws" or g == "com":
            if g == "ws" and e == n and src[pos] == "\\":
                bad(pos, e, "unexpected end after a line continuation")
            pos = e
            continue
        if g == "nl":
            if stack and _STATEMENT.match(src, e):
                # no expression goes on like this: the bracket was never closed
                o, at = stack[0]
                bad(start[at], e, f"{o!r} was never closed")
                stack.clear()
            if not stack:
                add("newline", pos, e)
                fresh = True
            pos = e
            continue
        if g == "num":
            w = m.group()
            if e < n and (src[e] == "_" or src[e].isalnum()) and not re.compile(r"(?:and|else|for|if|in|is|not|or)\b").match(src, e):
                bad(pos, e, "bad number")
            elif len(w) > 1 and w[0] == "0" and w.replace("_", "").isdigit() and w.replace("_", "").strip("0"):
                bad(pos, e, "number with leading zeros")
            else:
                add("num", pos, e)
            pos = e
            continue
        if g == "str":
            w = m.group()
            q = w.lstrip("rRuUbB")
            if q in ('""', "''") and src[e : e + 1] == q[0]:
                # three quotes that never close
                bad(pos, n, "unterminated triple-quoted string")
                pos = n
                continue
            add("bytes" if w[:2].lower().find("b") >= 0 and w[0] not in "\"'" else "str", pos, e)
            pos = e
            continue
        if g == "f":
            w = m.group()
            q = w.lstrip("fFrRtT")
            e2 = _f_end(src, e, q, "r" in w.lower(), holes, len(q) == 3)
            if e2 < 0:
                e2 = n if len(q) == 3 else min([x for x in (src.find("\n", e), src.find("\r", e)) if x >= 0], default=n)
                bad(pos, e2, "unterminated f-string")
            else:
                add("str", pos, e2)
            pos = e2
            continue
    if stack:
        t.bad.append((start[stack[0][1]], f"{stack[0][0]!r} was never closed"))
        add("bad", start[stack[0][1]], n)
    if kind and kind[-1] not in ("newline",) and not fresh:
        add("newline", n, n)
    for _ in levels[1:]:
        add("dedent", n, n)
    add("eof", n, n)
    match.extend([-1] * len(kind))
    for a, b in pairs:
        match[a], match[b] = b, a
    t.key = "".join(keys)
    return t, holes
