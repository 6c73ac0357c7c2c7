"""Tokens of Rust 2021."""

from __future__ import annotations

import re

from .base import Tokens, code

# The strict and reserved words of the 2021 edition.
RESERVED = frozenset(
    "as break const continue crate else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true "
    "type unsafe use where while async await dyn abstract become box do final macro override priv typeof unsized virtual yield try".split()
)
# Words with a meaning in some places only.
WEAK = frozenset(["union", "default", "macro_rules", "auto", "raw", "safe", "gen"])
_PUNCT = r"<<=|>>=|\.\.\.|\.\.=|::|->|=>|==|!=|<=|>=|&&|\|\||\+=|-=|\*=|/=|%=|\^=|&=|\|=|<<|>>|\.\.|[-+*/%^!&|=<>@.,;:#$?~(){}\[\]]"
_CHAR = r"'(?:[^'\\\n\r\t]|\\(?:[nrt\\0'\"]|x[0-7][0-9a-fA-F]|u\{[0-9a-fA-F_]{1,8}\}))'"
TOKEN = re.compile(
    r"(?P<ws>[\s‎‏]+)|(?P<lc>//[^\n]*)|(?P<bc>/\*)"
    r"|(?P<rstr>(?:b|c)?r(?P<h>#*)\"[\s\S]*?\"(?P=h))|(?P<str>[bc]?\"[^\"\\]*(?:\\[\s\S][^\"\\]*)*\")|(?P<char>b?" + _CHAR + r")|(?P<life>'(?:[^\W\d]|_)\w*)"
    r"|(?P<num>0x[0-9a-fA-F_]+(?:[iu](?:8|16|32|64|128|size))?|0o[0-7_]+(?:[iu]\w+)?|0b[01_]+(?:[iu]\w+)?|\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?(?:[eE][+-]?_*\d[\d_]*)?(?:[iuf](?:8|16|32|64|128|size))?)"
    r"|(?P<name>r#[^\W\d]\w*|[^\W\d]\w*)|(?P<p>" + _PUNCT + ")"
)
_COMMENT = re.compile(r"/\*|\*/")
_CLOSE = {")": "(", "]": "[", "}": "{"}
_BLANKS = re.compile(r"\s*")
_RAW = frozenset(["r", "br", "b", "c", "cr"])


class _Codes(dict):
    """The key character of a token class, made when first needed."""

    def __missing__(self, k):
        c = self[k] = code("rs " + k)
        return c


_CODES = _Codes()


def lex(src: str) -> Tokens:
    t = Tokens()
    kind, start, end, match, keys = t.kind, t.start, t.end, t.match, []
    stack: list[tuple[str, int]] = []
    token, codes, skip = TOKEN.match, _CODES, _BLANKS.match
    kind_add, start_add, end_add, key_add = kind.append, start.append, end.append, keys.append
    pairs: list[tuple[int, int]] = []
    pos, n = 1 if src.startswith("﻿") else 0, len(src)
    if src.startswith("#!") and not re.match(r"#!\s*\[", src):
        pos = src.find("\n")
        pos = n if pos < 0 else pos

    def bad(a, b, what):
        t.bad.append((a, what))
        kind.append("bad")
        start.append(a)
        end.append(b)
        keys.append(_CODES["bad"])

    while pos < n:
        m = token(src, pos)
        if m is None:
            c = src[pos]
            bad(pos, n if c == '"' else pos + 1, "unterminated string" if c == '"' else f"stray character {c!r}")
            pos = n if c == '"' else pos + 1
            continue
        g, e = m.lastgroup, m.end()
        if g == "ws" or g == "lc":
            pos = e
            continue
        if g == "bc":
            deep = 1
            while deep:
                x = _COMMENT.search(src, e)
                if x is None:
                    break
                deep += 1 if x.group() == "/*" else -1
                e = x.end()
            if deep:
                bad(pos, n, "unterminated comment")
                e = n
            pos = e
            continue
        if g == "name":
            w = m.group()
            k = w if w in RESERVED else "name"
            key = w if w in WEAK else k
            nxt = src[e : e + 1] if w in _RAW else ""
            if nxt == "'" and w == "b" or (nxt == '"' and w in ("r", "br", "b", "c", "cr")) or (nxt == "#" and w in ("r", "br", "cr") and re.match(r'#+"', src[e : e + 300])):
                bad(pos, n, "unterminated string")
                pos = n
                continue
        elif g == "p":
            k = key = m.group()
        elif g == "num":
            k = key = "num"
            if e < n and (src[e].isalnum() or src[e] == "_"):
                # a suffix only macros would take
                while e < n and (src[e].isalnum() or src[e] == "_"):
                    e += 1
                bad(pos, e, "bad number")
                pos = e
                continue
        elif g == "life":
            k = key = "life"
            if src[e : e + 1] == "'":
                bad(pos, e + 1, "bad character literal")
                pos = e + 1
                continue
        else:
            k = key = "char" if g == "char" else "str"
        kind_add(k)
        start_add(pos)
        end_add(e)
        key_add(codes[key])
        if g == "p":
            if k in "([{":
                stack.append((k, len(kind) - 1))
            elif k in _CLOSE:
                i = len(kind) - 1
                if stack and stack[-1][0] == _CLOSE[k]:
                    pairs.append((stack.pop()[1], i))
                else:
                    for j in range(len(stack) - 1, -1, -1):
                        if stack[j][0] == _CLOSE[k]:
                            del stack[j:]
                            break
        pos = skip(src, e).end()
    kind.append("eof")
    start.append(n)
    end.append(n)
    match.extend([-1] * len(kind))
    for a, b in pairs:
        match[a], match[b] = b, a
    keys.append(_CODES["eof"])
    t.key = "".join(keys)
    return t
