"""Tokens of the JavaScript family: plain, with JSX, with TypeScript's types.

Whether ``/`` begins a regular expression and ``<`` an element follows from the token before it and, for closing brackets, from what opened
them; templates and elements nest through a stack of modes.
"""

from __future__ import annotations

import re

from .base import Tokens, code

# The reserved words of the language.
RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return "
    "super switch this throw try typeof var void while with null true false enum".split()
)
# Words with a meaning in some places only.
CONTEXTUAL = frozenset(
    "abstract accessor any as asserts async await boolean constructor declare from get global implements infer interface is keyof let module "
    "namespace never number object of out override package private protected public readonly require satisfies set static string symbol target meta type undefined "
    "unique unknown using yield assert bigint".split()
)
_ID = r"(?:[A-Za-z_$]|[^\W\d]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})[\w$‌‍]*(?:\\u(?:[0-9a-fA-F]{4}|\{[0-9a-fA-F]+\})[\w$‌‍]*)*"
_NUM = r"0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*n?|0[oO][0-7](?:_?[0-7])*n?|0[bB][01](?:_?[01])*n?|(?:\d(?:_?\d)*)n|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?"
_STR = r"\"[^\"\\\n\r]*(?:\\(?:\r\n|[\s\S])[^\"\\\n\r]*)*\"|'[^'\\\n\r]*(?:\\(?:\r\n|[\s\S])[^'\\\n\r]*)*'"
_PUNCT = r"\.\.\.|=>|===|!==|\*\*=|<<=|&&=|\|\|=|\?\?=|==|!=|<=|\*\*|<<|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|[{}()\[\];,<>+\-*/%&|^!~?:=.@#]"
TOKEN = re.compile(
    r"(?P<ws>[ \t\v\f ﻿  -   　]+)|(?P<nl>[\n\r  ]+)|(?P<lc>//[^\n\r  ]*)|(?P<bc>/\*[\s\S]*?\*/)"
    rf"|(?P<num>(?=[.\d])(?:{_NUM}))|(?P<name>{_ID})|(?P<str>{_STR})|(?P<tick>`)|(?P<p>{_PUNCT})"
)
_WORD = re.compile(r"[\w$\\]")
REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n\r]+|\\[^\n\r]|\[(?:[^\]\\\n\r]+|\\[^\n\r])*+\])++/[A-Za-z]*")
TEMPLATE = re.compile(r"(?:[^`\\$]+|\\[\s\S]|\$(?!\{))*+(`|\$\{)")
JSX_TEXT = re.compile(r"[^<{>}]+")
JSX_NAME = re.compile(r"[A-Za-z_$][\w$-]*(?:[:.][A-Za-z_$][\w$-]*)*")
JSX_STR = re.compile(r"\"[^\"]*\"|'[^']*'")
GENERIC_ARROW = re.compile(r"<\s*(?:const\s+)?[A-Za-z_$][\w$]*\s*(?:,|extends\s+[A-Za-z{\[(])")
SPACE = re.compile(r"(?:\s|//[^\n]*|/\*[\s\S]*?\*/)*")
JSX_SPACE = re.compile(r"(?:\s|//[^\n]*|/\*[\s\S]*?\*/)+")

# after these an operand is expected, so "/" is a regular expression and "<" an element
_OPERAND_WORDS = frozenset("return typeof instanceof in of new delete void throw case do else yield await extends default".split())
_ENDS = frozenset(["name", "num", "str", "regex", "tfull", "ttail", ")", "]", "}", "++", "--", "this", "super", "null", "true", "false", "jsxend"])
_OPENER = {")": "(", "]": "[", "}": "{"}
_BEFORE_STATEMENT = frozenset(["if", "while", "for", "with"])
_BEFORE_OBJECT = frozenset(["(", ",", "=", ":", "[", "?", "return", "&&", "||", "??", "+", "...", "thead", "tmid", "typeof", "in", "new", "default", "case", "+=", "==="])
# tokens after which an operand is expected and that open or close nothing
_PLAIN = frozenset([".", ",", ";", ":", "=", "=>", "?", "&&", "||", "??", "+", "-", "*", ">", "==", "===", "!=", "!==", "!", "+=", "-=", "*=", "...", "?.", "|", "&", "%", "**", "<=", "^", "~", "@", "#"])
_BLANKS = re.compile(r"[ \t]*")
_WORDS = {w: w for w in RESERVED | CONTEXTUAL | _OPERAND_WORDS}


class _Codes(dict):
    """The key character of a token class, made when first needed."""

    def __init__(self, suffix: str):
        super().__init__()
        self.suffix = suffix

    def __missing__(self, k):
        c = self[k] = code(k + self.suffix)
        return c


_CODES_SAME, _CODES_NL = _Codes(""), _Codes("+")


_EASY_NUM = rf"(?=[.\d])(?!\.\.|\.(?!\d)|0[\d_])(?:{_NUM})(?![\w$\\])"
_BLANK = r"[ \t\v\f ﻿]+|[\n\r]+[ \t]*|//[^\n\r  ]*|/\*[^*]*(?:\*(?!/)[^*]*)*\*/"


def _run_of(left_out: str) -> tuple[re.Pattern, re.Pattern]:
    """Patterns of a stretch of tokens that need no look at what is around them, and of one such token; ``left_out``: punctuation that does."""
    ops = [r"\.\.\.", "=>", "===", "!==", r"\*\*=", "&&=", r"\|\|=", r"\?\?=", "==", "!=", r"\*\*", "&&", r"\|\|", r"\?\?", r"\?\.(?!\d)", r"\+\+", "--", r"\+=", "-=", r"\*=", "%=", "&=", r"\|=", r"\^="]
    ops += [] if "<" in left_out else ["<<=", "<=", "<<"]
    singles = "".join("\\" + c for c in "{}()[];,<>+-*%&|^!~?:=.@#" if c not in left_out)
    # names and marks that begin nothing longer come before the rest, since most tokens are such
    alone = "".join("\\" + c for c in "()[];,{}" if c not in left_out)
    one = rf"{_BLANK}|{_ID}|[{alone}]|{_EASY_NUM}|{_STR}|{'|'.join(ops)}|[{singles}]"
    return re.compile(rf"(?>{one})*+"), re.compile(one)


#: By whether "<" may begin an element, and whether a brace may end a template's or an element's part.
_RUNS = {(j, b): _run_of(("<" if j else "") + ("{}" if b else "")) for j in (False, True) for b in (False, True)}


class _Kinds(dict):
    """The class of a token from its text: kind, key word and its codes; None for blanks, 1 for those with a line break."""

    LIMIT = 300_000

    def __missing__(self, w):
        c = w[0]
        if c in " \t\v\f ﻿" or w[:2] == "//":
            k = None
        elif c in "\n\r":
            k = 1
        elif w[:2] == "/*":
            k = 1 if "\n" in w else None
        elif c in "\"'":
            k = ("str", "str")
        elif c.isdigit() or (c == "." and len(w) > 1 and w[1].isdigit()):
            k = ("num", "num")
        elif c.isalpha() or c in "_$\\" or ord(c) > 127:
            k = (w, w) if w in RESERVED else ("name", w if w in CONTEXTUAL else "name")
        else:
            k = (w, w)
        if len(self) >= self.LIMIT:
            self.clear()
        if k not in (None, 1):
            k = (*k, _CODES_SAME[k[1]], _CODES_NL[k[1]])
        self[w] = k
        return k


_KIND_OF = _Kinds()
_MARKS = frozenset("()[]{}")
_OUTER = frozenset(["${", "<tag", "<kids"])
_NEVER_OPERAND = frozenset(["name", "num", "str", "regex", "tfull", "ttail", "this", "super", "null", "true", "false"])


def lex(src: str, jsx: bool, typed: bool) -> Tokens:
    """All tokens up to a final ``eof``; ``bad`` holds faults of the lexer, each also a token of kind ``bad``."""
    t = Tokens()
    kind, start, end, nls, match, keys = t.kind, t.start, t.end, t.nl, t.match, []
    stack: list[tuple[str, int, bool]] = []  # opener, token index, whether an operand may follow its closer
    pos, n, nl = 0, len(src), False
    kind_add, start_add, end_add, nl_add, key_add = kind.append, start.append, end.append, nls.append, keys.append
    codes_nl, codes_same, words, skip = _CODES_NL, _CODES_SAME, _WORDS, _BLANKS.match
    pairs: list[tuple[int, int]] = []
    operand = True  # whether the next token may begin an operand
    token = TOKEN.match

    def add(k, a, b, key=None):
        nonlocal nl
        kind.append(k)
        start.append(a)
        end.append(b)
        nls.append(nl)
        keys.append((codes_nl if nl else codes_same)[key or k])
        nl = False

    def bad(a, b, what):
        t.bad.append((a, what))
        add("bad", a, b)

    def nested(stack):
        """Whether a brace may lead back into a template or an element."""
        for x in stack:
            if x[0] in _OUTER:
                return True
        return False

    if src.startswith("#!"):
        pos = src.find("\n")
        pos = n if pos < 0 else pos
    while pos < n:
        mode = stack[-1][0] if stack else ""
        if mode == "<tag":  # inside a tag
            m = JSX_SPACE.match(src, pos)
            if m:
                pos = m.end()
                continue
            m = JSX_NAME.match(src, pos)
            if m:
                add("jsxname", pos, m.end())
                pos = m.end()
                continue
            c = src[pos]
            if c in "\"'":
                m = JSX_STR.match(src, pos)
                if not m:
                    bad(pos, n, "unterminated string in a tag")
                    pos = n
                    continue
                add("str", pos, m.end())
                pos = m.end()
                continue
            if c == "{":
                add("{", pos, pos + 1)
                stack.append(("{", len(kind) - 1, False))
                operand = True
                pos += 1
                continue
            if src.startswith("/>", pos):
                add("jsx/>", pos, pos + 2)
                pos += 2
                stack.pop()
                operand = False
                continue
            if c == ">":
                add("jsx>", pos, pos + 1)
                pos += 1
                _, at, closing = stack.pop()
                if closing:
                    if stack and stack[-1][0] == "<kids":
                        stack.pop()
                    operand = False
                else:
                    stack.append(("<kids", at, False))
                continue
            if c in "=.:<":
                add(c, pos, pos + 1)
                pos += 1
                if c == "<":
                    stack.append(("<tag", len(kind) - 1, False))
                    kind[-1] = "jsx<"
                continue
            bad(pos, pos + 1, f"stray {c!r} in a tag")
            pos += 1
            continue
        if mode == "<kids":
            m = JSX_TEXT.match(src, pos)
            if m:
                if m.group().strip():
                    add("jsxtext", pos, m.end())
                pos = m.end()
                continue
            c = src[pos]
            if c == "{":
                add("{", pos, pos + 1)
                stack.append(("{", len(kind) - 1, False))
                operand = True
                pos += 1
            elif c == "<":
                m = SPACE.match(src, pos + 1)
                if src.startswith("/", m.end()):
                    add("jsx</", pos, m.end() + 1)
                    pos = m.end() + 1
                    stack.append(("<tag", len(kind) - 1, True))
                else:
                    add("jsx<", pos, pos + 1)
                    pos += 1
                    stack.append(("<tag", len(kind) - 1, False))
            else:
                bad(pos, pos + 1, f"stray {c!r} in an element")
                pos += 1
            continue
        run, one = _RUNS[jsx, nested(stack)]
        e = run.match(src, pos).end()
        if e > pos:
            prev = kind[-1] if kind else ""
            k = None
            last = ""
            for w, k in zip(words_ := one.findall(src, pos, e), map(_KIND_OF.__getitem__, words_)):
                at = pos
                pos += len(w)
                if k is None:
                    continue
                if k == 1:
                    nl = True
                    continue
                q, key, same, fresh = k
                if (prev == "." or prev == "?.") and q in RESERVED:
                    q = key = "name"
                    if w in CONTEXTUAL:
                        key = w
                    same, fresh = codes_same[key], codes_nl[key]
                kind_add(q)
                start_add(at)
                end_add(pos)
                nl_add(nl)
                key_add(fresh if nl else same)
                nl = False
                if q in _MARKS:
                    if q in "([{":
                        if q == "{":
                            after = prev not in _BEFORE_OBJECT or (prev == ":" and len(kind) > 2 and kind[-3] == "default")
                        else:
                            after = q == "(" and prev in _BEFORE_STATEMENT
                        stack.append((q, len(kind) - 1, after))
                    else:
                        want = _OPENER[q]
                        if stack and stack[-1][0] == want:
                            o = stack.pop()
                            closed = o[2]
                            pairs.append((o[1], len(kind) - 1))
                        else:
                            closed = False
                            for i in range(len(stack) - 1, -1, -1):
                                if stack[i][0] == want:
                                    closed = stack[i][2]
                                    del stack[i:]
                                    break
                before, prev, last = prev, q, w
            if last:
                if prev in ")]}":
                    operand = closed
                elif prev == "name":
                    operand = last in _OPERAND_WORDS and before != "." and before != "?."
                elif prev in ("++", "--"):
                    operand = before not in _ENDS
                else:
                    operand = prev not in _NEVER_OPERAND
            continue
        m = token(src, pos)
        if m is None:
            c = src[pos]
            if c in "\"'":
                e = src.find("\n", pos)
                e = n if e < 0 else e
                bad(pos, e, "unterminated string")
                pos = e
            else:
                bad(pos, pos + 1, f"stray character {c!r}")
                pos += 1
            operand = False
            continue
        g, e = m.lastgroup, m.end()
        if g == "name":
            w = m.group()
            k = words.get(w)
            if k is None:
                # an ordinary name
                k = key = "name"
                operand = False
            else:
                prev = kind[-1] if kind else ""
                if prev == "." or prev == "?." or w not in RESERVED:
                    k, key = "name", (w if w in CONTEXTUAL else "name")
                    operand = w in _OPERAND_WORDS and prev != "." and prev != "?."
                else:
                    key = k = w
                    operand = w not in _ENDS
            kind_add(k)
            start_add(pos)
            end_add(e)
            nl_add(nl)
            key_add(codes_nl[key] if nl else codes_same[key])
            nl = False
            pos = skip(src, e).end()
            continue
        if g == "ws" or g == "lc":
            pos = e
            continue
        if g == "nl":
            nl = True
            pos = skip(src, e).end()
            continue
        if g == "bc":
            if "\n" in m.group():
                nl = True
            pos = e
            continue
        if g == "num":
            if e < n and _WORD.match(src[e]):
                bad(pos, e, "identifier right after a number")
            elif e - pos > 1 and src[pos] == "0" and src[pos + 1] in "0123456789_":
                bad(pos, e, "number with a leading zero")
            else:
                add("num", pos, e)
            operand = False
            pos = e
            continue
        if g == "str":
            add("str", pos, e)
            operand = False
            pos = e
            continue
        if g == "tick":
            m = TEMPLATE.match(src, e)
            if not m:
                bad(pos, n, "unterminated template")
                pos = n
                continue
            if m.group(1) == "`":
                add("tfull", pos, m.end())
                operand = False
            else:
                add("thead", pos, m.end())
                stack.append(("${", len(kind) - 1, False))
                operand = True
            pos = m.end()
            continue
        p = m.group()
        if p in _PLAIN:
            kind_add(p)
            start_add(pos)
            end_add(e)
            nl_add(nl)
            key_add(codes_nl[p] if nl else codes_same[p])
            nl = False
            operand = True
            pos = skip(src, e).end()
            continue
        if p in ("/", "/=") and operand:
            m = REGEX.match(src, pos)
            if m:
                add("regex", pos, m.end())
                pos = m.end()
                operand = False
                continue
            if src.startswith("/*", pos):
                bad(pos, n, "unterminated comment")
                pos = n
                continue
            bad(pos, e, "unterminated regular expression")
            pos = e
            continue
        if p == "/" and src.startswith("/*", pos):
            bad(pos, n, "unterminated comment")
            pos = n
            continue
        if p == "<" and operand and jsx and not (typed and GENERIC_ARROW.match(src, pos)) and (kind[-1] if kind else "") != "function":
            m = SPACE.match(src, e)
            if src.startswith("/", m.end()):
                bad(pos, e, "closing tag without an element")
                pos = m.end() + 1
                continue
            add("jsx<", pos, e)
            stack.append(("<tag", len(kind) - 1, False))
            pos = e
            continue
        if p == "}" and stack and stack[-1][0] == "${":
            _, at, _ = stack.pop()
            m = TEMPLATE.match(src, e)
            if not m:
                bad(pos, n, "unterminated template")
                pos = n
                continue
            if m.group(1) == "`":
                add("ttail", pos, m.end())
                operand = False
            else:
                add("tmid", pos, m.end())
                stack.append(("${", len(kind) - 1, False))
                operand = True
            pos = m.end()
            continue
        prev = kind[-1] if kind else ""
        add(p, pos, e)
        i = len(kind) - 1
        if p in "([{":
            if p == "(":
                after = prev in _BEFORE_STATEMENT
            elif p == "{":
                # a block is followed by a statement, an object by an operator
                after = not (operand and prev in _BEFORE_OBJECT)
                if prev == ":" and i > 1 and kind[i - 2] in ("default",):
                    after = True
            else:
                after = False
            stack.append((p, i, after))
            operand = True
        elif p in ")]}":
            want = _OPENER[p]
            if stack and stack[-1][0] == want:
                _, at, operand = stack.pop()
                pairs.append((at, i))
            else:
                # a wrong closer: close down to its opener if there is one, so that one fault does not hide the rest
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == want:
                        _, at, operand = stack[k]
                        del stack[k:]
                        break
                else:
                    operand = False
        elif p in ("++", "--"):
            operand = operand
        else:
            operand = True
        pos = e
    add("eof", n, n)
    match.extend([-1] * len(kind))
    for a, b in pairs:
        match[a], match[b] = b, a
    t.key = "".join(keys)
    return t
