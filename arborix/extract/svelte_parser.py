"""Parser of Svelte components: markup, blocks and expressions, with scripts as TypeScript."""

from __future__ import annotations

import re

from .base import Fault, Node, Parsed
from .js_parser import JsParser
from .js_parser import parse as parse_js

# Elements that have no end tag.
VOID = frozenset("area base br col command embed hr img input keygen link meta param source track wbr !doctype".split())
# Elements whose end tag may be left out.
OMITTED = frozenset("li dt dd p rt rp optgroup option thead tbody tfoot tr td th colgroup".split())
_TAG_NAME = re.compile(r"!?[A-Za-z][A-Za-z0-9_$.:-]*")
_ATTR_NAME = re.compile(r"[^\s=>\"'/{]+")
_SPACE = re.compile(r"\s*")
_SKIP = re.compile(r"\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'|//[^\n]*|/\*[\s\S]*?\*/")
_TEXT = re.compile(r"[^<{]+")
_RAW_END = {k: re.compile(rf"</{k}\s*>", re.I) for k in ("script", "style", "textarea")}
_UNQUOTED = re.compile(r"(?:/(?!>)|[^\s\"'=<>`/{])+")
_SIMPLE = re.compile(r"\s*[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*\s*$")
_KEYWORDS = frozenset("if else for while const class function return this null true false new typeof void var switch case".split())


def _js(text: str, at: int, faults: list, how: str = "expression") -> Node | None:
    """Parse embedded code; faults are moved to their place in the file."""
    if how == "expression" and _SIMPLE.match(text) and text.strip() not in _KEYWORDS:
        s = len(text) - len(text.lstrip())
        return Node("simple", at + s, at + len(text.rstrip()), (), text.strip())
    p = JsParser(text, typed=True)
    try:
        if how == "pattern":
            n = p.binding()
            if p.eat(":"):
                p.type()
        elif how == "params":
            n = Node("params", 0, 0, p.params())
        elif how == "const":
            b = p.binding()
            if p.eat(":"):
                p.type()
            p.need("=")
            n = Node("assign", 0, len(text), [b, p.expression()])
        else:
            n = p.expression()
        if p.K[p.i] != "eof":
            p.fail()
        faults.extend((at + a, w) for a, w in p.faults)
        if p.t.bad and not p.faults:
            faults.extend((at + a, w) for a, w in p.t.bad)
        return n
    except Fault as e:
        faults.append((at + e.at, e.what))
    except RecursionError:
        faults.append((at, "nested too deeply"))
    return None


class SvelteParser:
    def __init__(self, src: str, memo: bool = False):
        self.src, self.memo = src, memo
        self.faults: list[tuple[int, str]] = []
        self.scripts: list[tuple[int, str, Node]] = []
        self.expressions: list[tuple[int, int, Node | None]] = []

    def brace_end(self, pos: int) -> int:
        """The offset of the '}' that closes a '{' before ``pos``."""
        src, n, stack = self.src, len(self.src), []
        start = pos
        while pos < n:
            c = src[pos]
            if c in "\"'/":
                m = _SKIP.match(src, pos)
                pos = m.end() if m else pos + 1
                continue
            if c == "`":
                pos += 1
                while pos < n and src[pos] != "`":
                    if src[pos] == "\\":
                        pos += 2
                    elif src.startswith("${", pos):
                        pos = self.brace_end(pos + 2) + 1
                    else:
                        pos += 1
                pos += 1
                continue
            if c in "([{":
                stack.append(c)
            elif c in ")]}":
                if not stack:
                    if c == "}":
                        return pos
                    raise Fault(pos, f"unexpected {c!r}")
                if stack.pop() != {")": "(", "]": "[", "}": "{"}[c]:
                    raise Fault(pos, f"unexpected {c!r}")
            pos += 1
        raise Fault(start - 1, "'{' was never closed")

    def program(self) -> Parsed:
        kids: list[Node] = []
        try:
            self.markup(kids)
        except Fault as e:
            self.faults.append((e.at, e.what))
        return Parsed(sorted(self.faults), Node("program", 0, len(self.src), kids))

    def markup(self, kids):
        src, n, pos = self.src, len(self.src), 0
        stack: list[tuple[str, str, int]] = []  # ("element" | "block", name, offset)
        while pos < n:
            m = _TEXT.match(src, pos)
            if m:
                pos = m.end()
                continue
            try:
                pos = self.tag(pos, stack, kids) if src[pos] == "<" else self.mustache(pos, stack)
            except Fault as e:
                # panic mode: go on behind the next tag or brace
                self.faults.append((e.at, e.what))
                m = re.compile(r"[<{]").search(src, max(e.at, pos) + 1)
                pos = m.start() if m else n
        for kind, name, at in stack[:1]:
            self.faults.append((at, f"<{name}> was left open" if kind == "element" else f"{{#{name}}} was left open"))

    def tag(self, pos, stack, kids):
        src = self.src
        if src.startswith("<!--", pos):
            e = src.find("-->", pos + 4)
            if e < 0:
                raise Fault(pos, "unterminated comment")
            return e + 3
        if src.startswith("</", pos):
            m = _TAG_NAME.match(src, pos + 2)
            if not m:
                raise Fault(pos, "expected a tag name")
            e = _SPACE.match(src, m.end()).end()
            if not src.startswith(">", e):
                raise Fault(e, "expected '>'")
            name = m.group()
            if name in VOID:
                raise Fault(pos, f"<{name}> has no end tag")
            while stack and not (stack[-1][0] == "element" and stack[-1][1] == name):
                if stack[-1][0] != "element":
                    raise Fault(pos, f"</{name}> closes nothing")
                if not any(k == "element" and x == name for k, x, _ in stack):
                    break
                stack.pop()
            if not stack or stack[-1][1] != name:
                raise Fault(pos, f"</{name}> closes nothing")
            stack.pop()
            return e + 1
        m = _TAG_NAME.match(src, pos + 1)
        if not m:
            raise Fault(pos + 1, "expected a tag name")
        name, at, pos = m.group(), pos, m.end()
        while True:
            pos = _SPACE.match(src, pos).end()
            if pos >= len(src):
                raise Fault(at, f"<{name}> is not finished")
            c = src[pos]
            if c == ">":
                pos += 1
                break
            if src.startswith("/>", pos):
                return pos + 2
            if c == "{":
                e = self.brace_end(pos + 1)
                body = src[pos + 1 : e]
                b = pos + 1
                if body.lstrip().startswith("..."):
                    off = body.index("...") + 3
                    self.expression(body[off:], b + off)
                elif body.lstrip().startswith("@"):
                    mm = re.match(r"\s*@\w+\s", body)
                    off = mm.end() if mm else 1
                    self.expression(body[off:], b + off)
                elif body.lstrip().startswith("/*") or body.lstrip().startswith("//"):
                    pass
                else:
                    self.expression(body, b)
                pos = e + 1
                continue
            m = _ATTR_NAME.match(src, pos)
            if not m:
                raise Fault(pos, f"stray {c!r} in a tag")
            pos = m.end()
            e = _SPACE.match(src, pos).end()
            if src.startswith("=", e):
                pos = _SPACE.match(src, e + 1).end()
                pos = self.value(pos, at, name)
        low = name.lower()
        if low in ("script", "style", "textarea"):
            end = _RAW_END[low].search(src, pos)
            if not end:
                raise Fault(at, f"<{name}> was left open")
            if low == "script" and not any(s[0] == "element" for s in stack):
                body = src[pos : end.start()]
                out = parse_js(body, typed=True, memo=self.memo)
                self.faults.extend((pos + a, w) for a, w in out.faults)
                self.scripts.append((pos, body, out.tree))
            elif low == "style":
                self.style(src[pos : end.start()], pos)
            return end.end()
        if low not in VOID:
            stack.append(("element", name, at))
        return pos

    def style(self, css, at):
        body = re.sub(r"/\*[\s\S]*?\*/|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'", lambda m: " " * len(m.group()), css)
        deep = 0
        for m in re.finditer(r"[{}]", body):
            deep += 1 if m.group() == "{" else -1
            if deep < 0:
                break
        if deep or "/*" in body:
            self.faults.append((at, "braces of a style sheet do not match"))
        elif re.search(r"^(?:<{7}|={7}|>{7})", body, re.M):
            self.faults.append((at, "a conflict mark in a style sheet"))

    def value(self, pos, at, name):
        src = self.src
        if pos >= len(src):
            raise Fault(at, f"<{name}> is not finished")
        c = src[pos]
        if c in "\"'":
            q, pos = c, pos + 1
            while True:
                m = re.compile(rf"[^{q}{{]*").match(src, pos)
                pos = m.end()
                if pos >= len(src):
                    raise Fault(at, "unterminated attribute")
                if src[pos] == q:
                    return pos + 1
                e = self.brace_end(pos + 1)
                self.expression(src[pos + 1 : e], pos + 1)
                pos = e + 1
        n = 0
        while pos < len(src):
            if src[pos] == "{":
                e = self.brace_end(pos + 1)
                self.expression(src[pos + 1 : e], pos + 1)
                pos, n = e + 1, n + 1
                continue
            m = _UNQUOTED.match(src, pos)
            if not m:
                break
            pos, n = m.end(), n + 1
        if not n:
            raise Fault(pos, "expected a value")
        return pos

    def expression(self, text, at):
        if not text.strip():
            self.faults.append((at, "expected an expression"))
            return
        n = _js(text, at, self.faults)
        self.expressions.append((at, at + len(text), n))

    def mustache(self, pos, stack):
        src = self.src
        e = self.brace_end(pos + 1)
        body, at = src[pos + 1 : e], pos + 1
        lead = len(body) - len(body.lstrip())
        body, at = body[lead:], at + lead
        if body.startswith("#"):
            m = re.match(r"#(if|each|await|key|snippet)\b", body)
            if not m:
                raise Fault(at, "unknown block")
            kind = m.group(1)
            rest, off = body[m.end() :], at + m.end()
            if kind == "each":
                self.each(rest, off)
            elif kind == "await":
                mm = re.search(r"\s(then|catch)\b", rest)
                head = rest[: mm.start()] if mm else rest
                self.expression(head, off)
                if mm and rest[mm.end() :].strip():
                    _js(rest[mm.end() :], off + mm.end(), self.faults, "pattern")
            elif kind == "snippet":
                mm = re.match(r"\s*[A-Za-z_$][\w$]*(?:<[^(]*>)?\s*", rest)
                if not mm or not rest[mm.end() :].startswith("("):
                    raise Fault(off, "expected a name and parameters")
                _js(rest[mm.end() :], off + mm.end(), self.faults, "params")
            else:
                self.expression(rest, off)
            stack.append(("block", kind, pos))
        elif body.startswith(":"):
            m = re.match(r":(else\s+if|else|then|catch)\b", body)
            while stack and stack[-1][0] == "element" and any(k == "block" for k, _, _ in stack):
                raise Fault(stack[-1][2], f"<{stack[-1][1]}> was left open")
            if not m or not stack or stack[-1][0] != "block":
                raise Fault(at, "a branch outside a block")
            kind, name = m.group(1), stack[-1][1]
            rest = body[m.end() :]
            if kind.startswith("else") and name not in ("if", "each") or kind in ("then", "catch") and name != "await" or ("if" in kind[4:] and name != "if"):
                raise Fault(at, "a branch of another block")
            if "if" in kind[4:]:
                self.expression(rest, at + m.end())
            elif kind in ("then", "catch"):
                if rest.strip():
                    _js(rest, at + m.end(), self.faults, "pattern")
            elif rest.strip():
                raise Fault(at, "unexpected text after 'else'")
        elif body.startswith("/"):
            m = re.match(r"/(if|each|await|key|snippet)\s*$", body)
            if not m:
                if body.startswith(("/*", "//")):
                    return e + 1
                if re.match(r"/[^*/]", body):
                    # a regular expression
                    self.expression(body, at)
                    return e + 1
                raise Fault(at, "unknown block end")
            while stack and stack[-1][0] == "element" and any(k == "block" for k, _, _ in stack):
                _, name, left = stack.pop()
                if name not in OMITTED:
                    raise Fault(left, f"<{name}> was left open")
            if not stack or stack[-1][0] != "block" or stack[-1][1] != m.group(1):
                raise Fault(at, "the end of another block")
            stack.pop()
        elif body.startswith("@"):
            m = re.match(r"@(html|const|debug|render|attach)\b", body)
            if not m:
                raise Fault(at, "unknown tag")
            rest, off = body[m.end() :], at + m.end()
            if m.group(1) == "const":
                n = _js(rest, off, self.faults, "const")
                self.expressions.append((off, off + len(rest), n))
            elif m.group(1) != "debug" or rest.strip():
                self.expression(rest, off)
        else:
            self.expression(body, at)
        return e + 1

    def each(self, rest, off):
        """``expression as pattern, index (key)``: the last ' as ' from which the rest reads as a binding."""
        spots = [m for m in re.finditer(r"\sas\s", rest)]
        if not spots:
            m = re.match(r"([\s\S]*?),\s*[A-Za-z_$][\w$]*\s*$", rest)
            self.expression(m.group(1) if m else rest, off)
            return
        best = None
        for m in reversed(spots):
            trial: list = []
            head = rest[: m.start()]
            n = _js(head, off, trial)
            tail, t_off = rest[m.end() :], off + m.end()
            p = JsParser(tail, typed=True)
            key = None
            try:
                p.binding()
                if p.eat(","):
                    p.ident()
                if p.eat("("):
                    key = p.expression()
                    p.need(")")
                if p.K[p.i] != "eof":
                    p.fail()
                trial.extend((t_off + a, w) for a, w in p.faults)
            except Fault as e:
                trial.append((t_off + e.at, e.what))
            if not trial:
                self.expressions.append((off, off + len(head), n))
                if key is not None:
                    self.expressions.append((t_off + key.s, t_off + key.e, None))
                return
            best = best or trial
        self.faults.extend(best)


def parse(src: str, memo: bool = False) -> Parsed:
    return SvelteParser(src, memo).program()
