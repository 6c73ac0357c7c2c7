"""Parser of ES modules, with JSX and TypeScript's syntax on request."""

from __future__ import annotations

from .base import Fault, Memo, Node, Parsed, Shapes
from .js_lexer import RESERVED, lex

# Binding powers of the binary operators.
BINARY = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
ASSIGN = frozenset(["=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", "&=", "|=", "^=", "&&=", "||=", "??=", ">>=", ">>>=", ">="])
UNARY = frozenset(["!", "~", "+", "-", "typeof", "void", "delete"])
_BLOCKED = frozenset(["let", "static", "implements", "interface", "package", "private", "protected", "public", "yield"])
_MODIFIERS = frozenset(["public", "private", "protected", "readonly", "override", "abstract", "declare", "static", "accessor", "async", "export", "const", "in", "out"])
_SIMPLE = frozenset(["name", "num", "str", "(", "[", "const", "var", "return", "throw", "this", "super", "import", "export", "break", "continue", "++", "--", "!", "new", "thead", "tfull", "typeof", "void", "delete"])
_START = frozenset("const var function class if for while do switch try return throw import export break continue debugger".split())
_EXPR_FOLLOW = frozenset([")", "]", ":", ";", ",", ".", "?.", "==", "===", "!=", "!==", "&&", "||", "??", "^", "|", "&", "}", "eof", "?", "tfull", "thead", "(", "=", "=>", "tmid", "ttail", ">"])

_memos: dict[tuple, Memo] = {}
_shapes: dict[tuple, Shapes] = {}


class JsParser:
    def __init__(self, src: str, jsx: bool = False, typed: bool = False, memo: bool = False, calls: bool = False):
        self.src, self.jsx, self.typed = src, jsx, typed
        self.t = lex(src, jsx, typed)
        self.K, self.S, self.E, self.N, self.M, self.key = self.t.kind, self.t.start, self.t.end, self.t.nl, self.t.match, self.t.key
        self.i = 0
        self.faults: list[tuple[int, str]] = []
        self.memo = _memos.setdefault((jsx, typed), Memo()) if memo else None
        self.shapes = _shapes.setdefault((jsx, typed), Shapes()) if calls else None
        self.fn = self.is_async = self.gen = self.loop = self.switch = 0
        self.no_in = False
        self.no_arrow: set[int] = set()
        self.labels: list[str] = []

    # -- tokens -------------------------------------------------------------

    def text(self, i=None):
        i = self.i if i is None else i
        return self.src[self.S[i] : self.E[i]]

    def fail(self, what=None, i=None):
        i = self.i if i is None else i
        k = self.K[i]
        if k == "bad":
            for at, msg in self.t.bad:
                if at == self.S[i]:
                    raise Fault(at, msg)
        raise Fault(self.S[i], what or ("unexpected end" if k == "eof" else f"unexpected {self.text(i)[:20]!r}"))

    def eat(self, k):
        if self.K[self.i] == k:
            self.i += 1
            return True
        return False

    def need(self, k):
        if self.K[self.i] != k:
            self.fail(f"expected {k!r}" if self.K[self.i] != "bad" else None)
        self.i += 1

    def word(self, w, i=None):
        i = self.i if i is None else i
        return self.K[i] == "name" and self.src[self.S[i] : self.E[i]] == w

    def eat_word(self, w):
        if self.word(w):
            self.i += 1
            return True
        return False

    def need_word(self, w):
        if not self.eat_word(w):
            self.fail(f"expected {w!r}")

    def semicolon(self):
        k = self.K[self.i]
        if k == ";":
            self.i += 1
        elif not (k in ("}", "eof") or self.N[self.i]):
            self.fail("expected ';'" if k != "bad" else None)

    def ident(self, what="a name"):
        i = self.i
        if self.K[i] != "name":
            self.fail(f"expected {what}" if self.K[i] != "bad" else None)
        w = self.text()
        if w == "await" and (self.is_async or not self.fn) and not self.typed:
            self.fail("'await' is reserved")
        if w in _BLOCKED and not self.typed:
            self.fail(f"{w!r} is reserved")
        self.i = i + 1
        return Node("id", self.S[i], self.E[i], (), w)

    def close(self, node):
        node.e = self.E[self.i - 1]
        return node

    def node(self, t, a, kids=(), v=None, f=None):
        return Node(t, a, self.E[self.i - 1], kids, v, f)

    def gt_run(self):
        """The operator that begins with '>' here, and its number of tokens."""
        i, K, S, E = self.i, self.K, self.S, self.E
        op, n = ">", 1
        while n < 3 and K[i + n] == ">" and S[i + n] == E[i + n - 1]:
            op += ">"
            n += 1
        if K[i + n] == "=" and S[i + n] == E[i + n - 1]:
            return op + "=", n + 1
        return op, n

    # -- program and statements ----------------------------------------------

    def program(self) -> Parsed:
        kids = []
        self.statements(kids, "eof")
        root = Node("program", 0, len(self.src), kids)
        return Parsed(sorted(self.faults), root)

    def statements(self, kids, end):
        K = self.K
        while K[self.i] != end:
            if K[self.i] == "eof":
                self.fail("expected '}' before the end")
            before = self.i
            state = (self.fn, self.is_async, self.gen, self.loop, self.switch, len(self.labels), self.no_in)
            try:
                s = self.statement(top=end == "eof")
                if s is not None:
                    kids.append(s)
            except Fault as e:
                self.faults.append((e.at, e.what))
                self.fn, self.is_async, self.gen, self.loop, self.switch, n, self.no_in = state
                del self.labels[n:]
                self.recover(before, end)
            except RecursionError:
                if end != "eof":
                    raise
                self.faults.append((self.S[before], "nested too deeply"))
                self.fn, self.is_async, self.gen, self.loop, self.switch, n, self.no_in = state
                self.recover(before, end)

    def recover(self, before, end):
        """Skip to where a statement may begin again: after ';', at a '}' of this block, or at a line that starts with a statement word."""
        K, N = self.K, self.N
        i = max(self.i, before + 1)
        if self.i == before and K[before] == "eof":
            i = before
        deep = 0
        while K[i] != "eof":
            k = K[i]
            if k == "{":
                deep += 1
            elif k == "}":
                if deep == 0 and end == "}":
                    break
                deep = max(0, deep - 1)
                if deep == 0 and end != "}":
                    i += 1
                    break
            elif deep == 0 and k == ";":
                i += 1
                break
            elif deep == 0 and N[i] and k in _START:
                break
            i += 1
        self.i = i

    def statement(self, top=False, inline=False):
        K, i = self.K, self.i
        k = K[i]
        if (self.memo is not None or self.shapes is not None) and k in _SIMPLE:
            # a statement up to the ';' on its own level, if its shape is known, needs no parse
            j, M = i, self.M
            while True:
                q = K[j]
                if q == ";":
                    break
                if q in "([{":
                    j = M[j]
                    if j < 0:
                        break
                elif q in ("}", "eof", ")", "]", "bad") or q[:3] == "jsx" or j - i > 400:
                    j = -1
                    break
                j += 1
            if j > 0:
                # what the context allows is part of the key
                key = (self.key[i : j + 1], self.is_async > 0, self.fn > 0, self.gen > 0, self.loop > 0, self.switch > 0, top)
                if self.shapes is not None:
                    if (calls := self.shapes.seen.get(key)) is not None:
                        self.i = j + 1
                        return Shapes.node(calls, self.S, self.E, i, j)
                    n, width = len(self.faults), len(K)
                    s = self.statement2(top, inline)
                    if self.i == j + 1 and len(K) == width and len(self.faults) == n and not self.labels:
                        self.shapes.add(key, s, self.S, self.E, i, j)
                    return s
                if key in self.memo.seen:
                    self.i = j + 1
                    return None
                n = len(self.faults)
                s = self.statement2(top, inline)
                if self.i == j + 1 and len(self.faults) == n and not self.labels:
                    self.memo.add(key)
                return s
        return self.statement2(top, inline)

    def statement2(self, top=False, inline=False):
        K, i, a = self.K, self.i, self.S[self.i]
        k = K[i]
        h = getattr(self, "s_" + k, None) if k.isalpha() and k != "name" else None
        if h is not None:
            return h(a, top)
        if k == "{":
            return self.block()
        if k == ";":
            self.i += 1
            return None
        if k == "@":
            self.decorators()
            return self.statement2(top)
        if k == "name":
            w = self.text()
            if w == "async" and K[i + 1] == "function" and not self.N[i + 1]:
                self.i += 1
                return self.function(a, True, is_async=True)
            if w == "let" and (K[i + 1] in ("name", "[", "{")) and not (inline and self.N[i + 1]):
                return self.var(a)
            if w == "using" and K[i + 1] == "name" and not self.N[i + 1] and K[i + 2] == "=":
                return self.var(a)
            if self.typed and (s := self.ts_statement(a, w, top)) is not None:
                return s
            if K[i + 1] == ":":
                self.ident()
                self.i += 1
                self.labels.append(w)
                body = self.statement(inline=True)
                self.labels.pop()
                return self.node("label", a, [body] if body else [])
        e = self.expression()
        self.semicolon()
        return self.node("expr", a, [e])

    def block(self):
        a = self.S[self.i]
        self.need("{")
        kids = []
        self.statements(kids, "}")
        self.need("}")
        return self.node("block", a, kids)

    def s_const(self, a, top):
        if self.K[self.i + 1] == "enum" and self.typed:
            self.i += 1
            return self.enum(a)
        return self.var(a)

    def s_var(self, a, top):
        return self.var(a)

    def s_enum(self, a, top):
        if not self.typed:
            self.fail()
        return self.enum(a)

    def var(self, a, head=False):
        kind = self.text()
        self.i += 1
        kids = []
        while True:
            b = self.S[self.i]
            target = self.binding()
            if self.typed:
                if self.K[self.i] == "!" and self.K[self.i + 1] == ":":
                    self.i += 1
                if self.eat(":"):
                    self.type()
            init = None
            if self.eat("="):
                init = self.assign()
            elif not head and not (self.typed and self.ambient):
                if kind == "const" or target.t != "id":
                    self.fail("missing initializer")
            kids.append(self.node("declarator", b, [target] + ([init] if init else []), None, {"id": target, "init": init}))
            if not self.eat(","):
                break
        if not head:
            self.semicolon()
        return self.node("var", a, kids)

    ambient = False

    def binding(self):
        k, a = self.K[self.i], self.S[self.i]
        if k == "[":
            self.i += 1
            kids = []
            while self.K[self.i] != "]":
                if self.eat(","):
                    continue
                rest = self.eat("...")
                kids.append(self.binding())
                if not rest and self.eat("="):
                    kids.append(self.assign_in())
                if self.K[self.i] != "]":
                    self.need(",")
            self.i += 1
            return self.node("pattern", a, kids)
        if k == "{":
            self.i += 1
            kids = []
            while self.K[self.i] != "}":
                if self.eat("..."):
                    kids.append(self.binding())
                else:
                    if self.K[self.i] == "name" and self.K[self.i + 1] in (",", "}", "="):
                        kids.append(self.ident())
                    else:
                        self.prop_name()
                        self.need(":")
                        kids.append(self.binding())
                    if self.eat("="):
                        kids.append(self.assign_in())
                if self.K[self.i] != "}":
                    self.need(",")
            self.i += 1
            return self.node("pattern", a, kids)
        return self.ident()

    def assign_in(self):
        keep, self.no_in = self.no_in, False
        e = self.assign()
        self.no_in = keep
        return e

    def paren(self):
        self.need("(")
        e = self.expression_in()
        self.need(")")
        return e

    def expression_in(self):
        keep, self.no_in = self.no_in, False
        e = self.expression()
        self.no_in = keep
        return e

    def s_if(self, a, top):
        self.i += 1
        p = self.S[self.i]
        c = self.paren()
        cond = self.src[p : self.E[self.i - 1]]
        then = self.body()
        other = self.body() if self.eat("else") else None
        return self.node("if", a, [x for x in (c, then, other) if x], cond, {"cond": c, "then": then, "else": other})

    def body(self):
        """A statement in a place where no declaration may stand."""
        i = self.i
        k = self.K[i]
        if k in ("class", "const", "import", "export") or (k == "name" and self.text() == "let" and self.K[i + 1] in ("[",)):
            self.fail("a declaration cannot stand here")
        a = self.S[i]
        return self.statement(inline=True) or Node("empty", a, self.E[self.i - 1])

    def s_while(self, a, top):
        self.i += 1
        c = self.paren()
        self.loop += 1
        b = self.body()
        self.loop -= 1
        return self.node("while", a, [c, b])

    def s_do(self, a, top):
        self.i += 1
        self.loop += 1
        b = self.body()
        self.loop -= 1
        self.need("while")
        c = self.paren()
        self.eat(";")
        return self.node("do", a, [b, c])

    def s_for(self, a, top):
        self.i += 1
        aw = self.eat_word("await")
        self.need("(")
        kids = []
        b = self.S[self.i]
        k = self.K[self.i]
        if k == ";":
            self.i += 1
            return self.for_rest(a, kids)
        self.no_in = True
        if k in ("const", "var") or (self.word("let") and self.K[self.i + 1] in ("name", "[", "{") and not self.word("of", self.i + 1)) or (self.word("using") and self.K[self.i + 1] == "name" and not self.word("of", self.i + 1)):
            first = self.var(b, head=True)
        else:
            first = self.expression()
        self.no_in = False
        kids.append(first)
        if self.word("of") or (self.K[self.i] == "in" and not aw):
            of = self.word("of")
            if first.t == "var" and len(first.k) != 1:
                self.fail("one binding is allowed here")
            if first.t != "var":
                self.target(first)
            self.i += 1
            kids.append(self.assign() if of else self.expression())
            self.need(")")
            self.loop += 1
            kids.append(self.body())
            self.loop -= 1
            return self.node("for", a, kids)
        if aw:
            self.fail("expected 'of'")
        if first.t == "var":
            for d in first.k:
                if d.f["init"] is None and d.f["id"].t != "id":
                    self.fail("missing initializer")
        self.need(";")
        return self.for_rest(a, kids)

    def for_rest(self, a, kids):
        if self.K[self.i] != ";":
            kids.append(self.expression())
        self.need(";")
        if self.K[self.i] != ")":
            kids.append(self.expression())
        self.need(")")
        self.loop += 1
        kids.append(self.body())
        self.loop -= 1
        return self.node("for", a, kids)

    def s_with(self, a, top):
        self.fail("'with' is not allowed in a module")

    def s_switch(self, a, top):
        self.i += 1
        c = self.paren()
        self.need("{")
        kids = [c]
        self.switch += 1
        seen_default = False
        while not self.eat("}"):
            b = self.S[self.i]
            if self.eat("default"):
                if seen_default:
                    self.fail("a second 'default'", self.i - 1)
                seen_default = True
                v, test = None, None
            else:
                self.need("case")
                p = self.S[self.i]
                test = self.expression()
                v = self.src[p : self.E[self.i - 1]]
            self.need(":")
            body = []
            while self.K[self.i] not in ("case", "default", "}"):
                if self.K[self.i] == "eof":
                    self.fail("expected '}' before the end")
                s = self.statement()
                if s:
                    body.append(s)
            kids.append(self.node("case", b, ([test] if test else []) + body, v))
        self.switch -= 1
        return self.node("switch", a, kids)

    def s_try(self, a, top):
        self.i += 1
        kids = [self.block()]
        ok = False
        if self.eat("catch"):
            ok = True
            if self.eat("("):
                self.binding()
                if self.typed and self.eat(":"):
                    self.type()
                self.need(")")
            kids.append(self.block())
        if self.eat("finally"):
            ok = True
            kids.append(self.block())
        if not ok:
            self.fail("expected 'catch' or 'finally'")
        return self.node("try", a, kids)

    def s_return(self, a, top):
        if not self.fn:
            self.fail("'return' outside a function")
        return self.jump(a, "return")

    def s_throw(self, a, top):
        if self.N[self.i + 1]:
            self.fail("line break after 'throw'")
        self.i += 1
        e = self.expression()
        self.semicolon()
        return self.node("throw", a, [e])

    def jump(self, a, t):
        self.i += 1
        kids = []
        if self.K[self.i] not in (";", "}", "eof") and not self.N[self.i]:
            kids.append(self.expression())
        self.semicolon()
        return self.node(t, a, kids)

    def s_break(self, a, top):
        self.i += 1
        if self.K[self.i] == "name" and not self.N[self.i]:
            if self.text() not in self.labels:
                self.fail("unknown label")
            self.i += 1
        elif not (self.loop or self.switch):
            self.fail("'break' outside a loop", self.i - 1)
        self.semicolon()
        return None

    def s_continue(self, a, top):
        self.i += 1
        if not self.loop:
            self.fail("'continue' outside a loop", self.i - 1)
        if self.K[self.i] == "name" and not self.N[self.i]:
            if self.text() not in self.labels:
                self.fail("unknown label")
            self.i += 1
        self.semicolon()
        return None

    def s_debugger(self, a, top):
        self.i += 1
        self.semicolon()
        return None

    def s_function(self, a, top):
        return self.function(a, True)

    def s_class(self, a, top):
        return self.class_(a, True)

    def s_import(self, a, top):
        if self.K[self.i + 1] in ("(", "."):
            e = self.expression()
            self.semicolon()
            return self.node("expr", a, [e])
        if not top:
            self.fail("'import' below the top level")
        self.i += 1
        if self.eat("str"):
            self.attributes()
            self.semicolon()
            return self.node("import", a)
        if self.typed and self.word("type") and (self.K[self.i + 1] in ("{", "*") or (self.K[self.i + 1] == "name" and not (self.word("from", self.i + 1) and self.K[self.i + 2] == "str"))):
            self.i += 1
        more = True
        if self.K[self.i] == "name":
            self.ident()
            if self.typed and self.eat("="):
                if self.word("require") and self.K[self.i + 1] == "(":
                    self.i += 1
                    self.need("(")
                    self.need("str")
                    self.need(")")
                else:
                    self.ident()
                    while self.eat("."):
                        self.need("name")
                self.semicolon()
                return self.node("import", a)
            more = self.eat(",")
        if more:
            if self.eat("*"):
                self.need_word("as")
                self.ident()
            else:
                self.specifiers(True)
        self.need_word("from")
        self.need("str")
        self.attributes()
        self.semicolon()
        return self.node("import", a)

    def attributes(self):
        if self.K[self.i] == "with" or (self.word("assert") and not self.N[self.i]):
            self.i += 1
            self.object()

    def module_name(self):
        k = self.K[self.i]
        if k == "name" or k in RESERVED or k == "str":
            self.i += 1
            return k == "name"
        self.fail("expected a name")

    def specifiers(self, binds):
        self.need("{")
        plain = True
        while self.K[self.i] != "}":
            if self.typed and self.word("type") and self.K[self.i + 1] not in (",", "}") and not (self.word("as", self.i + 1) and self.K[self.i + 2] not in (",", "}", "name")):
                if not (self.word("as", self.i + 1) and self.K[self.i + 2] == "name" and not self.word("as", self.i + 2)):
                    self.i += 1
            name = self.module_name()
            if self.eat_word("as"):
                name = self.module_name() if binds else self.module_name() or True
            if binds and not name:
                self.fail("expected a name", self.i - 1)
            plain = plain and name
            if self.K[self.i] != "}":
                self.need(",")
        self.i += 1
        return plain

    def s_export(self, a, top):
        if not top and not self.ambient:
            self.fail("'export' below the top level")
        self.i += 1
        k = self.K[self.i]
        if k == "default":
            self.i += 1
            b = self.S[self.i]
            if self.K[self.i] == "function" or (self.word("async") and self.K[self.i + 1] == "function" and not self.N[self.i + 1]):
                is_async = self.eat_word("async")
                d = self.function(b, True, is_async=is_async, nameless=True)
            elif self.K[self.i] == "class":
                d = self.class_(b, True, nameless=True)
            elif self.K[self.i] == "@":
                self.decorators()
                d = self.class_(b, True, nameless=True)
            elif self.typed and self.word("abstract") and self.K[self.i + 1] == "class":
                self.i += 1
                d = self.class_(b, True, nameless=True)
            elif self.typed and self.word("interface") and self.K[self.i + 1] == "name":
                d = self.ts_statement(b, "interface", top)
            else:
                d = self.assign()
                self.semicolon()
            return self.node("export", a, [d] if d else [])
        if k == "*":
            self.i += 1
            if self.eat_word("as"):
                self.module_name()
            self.need_word("from")
            self.need("str")
            self.attributes()
            self.semicolon()
            return self.node("export", a)
        if self.typed and self.word("type") and self.K[self.i + 1] in ("{", "*"):
            self.i += 1
            if self.eat("*"):
                if self.eat_word("as"):
                    self.module_name()
                self.need_word("from")
                self.need("str")
                self.semicolon()
                return self.node("export", a)
            k = "{"
        if k == "{":
            plain = self.specifiers(False)
            if self.eat_word("from"):
                self.need("str")
                self.attributes()
            elif not plain:
                self.fail("expected 'from'")
            self.semicolon()
            return self.node("export", a)
        if self.typed:
            if k == "=":
                self.i += 1
                self.expression()
                self.semicolon()
                return self.node("export", a)
            if self.word("as") and self.word("namespace", self.i + 1):
                self.i += 2
                self.ident()
                self.semicolon()
                return self.node("export", a)
            if k == "import":
                d = self.s_import(a, top)
                return self.node("export", a, [d])
        ok = k in ("const", "var", "function", "class", "@") or self.word("let") or self.word("async") or (self.typed and k in ("name", "enum"))
        if not ok:
            self.fail("expected a declaration")
        d = self.statement2(True)
        if d is not None and d.t == "expr":
            self.fail("expected a declaration", self.i - 1)
        return self.node("export", a, [d] if d else [])

    def decorators(self):
        while self.eat("@"):
            if self.K[self.i] == "(":
                self.paren()
            else:
                self.module_name()
                while self.eat("."):
                    self.module_name()
                if self.typed and self.K[self.i] == "<":
                    self.type_args()
                if self.K[self.i] == "(":
                    self.args()
        if self.K[self.i] == "export":
            pass

    # -- functions and classes -------------------------------------------------

    def function(self, a, decl, is_async=False, nameless=False):
        self.need("function")
        gen = self.eat("*")
        name = None
        if self.K[self.i] == "name":
            if not decl and self.word("await") and not is_async:
                self.i += 1
            else:
                name = self.ident()
        elif decl and not nameless:
            self.fail("expected a name")
        return self.fn_rest("function", a, name, is_async, gen)

    def fn_rest(self, t, a, name, is_async=False, gen=False, method=False, bodiless=False):
        if self.typed and self.K[self.i] == "<":
            self.type_params()
        keep = (self.is_async, self.gen, self.loop, self.switch, self.labels, self.no_in, self.fn)
        self.is_async, self.gen, self.loop, self.switch, self.labels, self.no_in = int(is_async), int(gen), 0, 0, [], False
        self.fn += 1
        params = self.params(method)
        if self.typed and self.eat(":"):
            self.type(ret=True)
        body = None
        if self.K[self.i] == "{":
            body = self.block()
        elif self.typed and (self.K[self.i] == ";" or self.N[self.i] or self.K[self.i] in ("}", "eof")) and (bodiless or t == "function" or method):
            self.eat(";")
        else:
            self.fail("expected '{'" if self.K[self.i] not in ("bad",) else None)
        self.is_async, self.gen, self.loop, self.switch, self.labels, self.no_in, self.fn = keep
        return self.node(t, a, params + ([body] if body else []), name.v if name else None, {"name": name, "body": body, "params": params})

    def params(self, method=False):
        self.need("(")
        kids = []
        while self.K[self.i] != ")":
            if self.typed or method:
                self.decorators()
            if self.typed:
                while self.K[self.i] == "name" and self.text() in ("public", "private", "protected", "readonly", "override") and self.K[self.i + 1] in ("name", "{", "["):
                    self.i += 1
            rest = self.eat("...")
            if self.typed and self.K[self.i] == "this":
                self.i += 1
            else:
                kids.append(self.binding())
            if self.typed:
                self.eat("?")
                if self.eat(":"):
                    self.type()
            if not rest and self.eat("="):
                kids.append(self.assign_in())
            if self.K[self.i] != ")":
                if rest:
                    self.fail("a rest parameter must be last")
                self.need(",")
        self.i += 1
        return kids

    def class_(self, a, decl, nameless=False):
        self.need("class")
        name = None
        if self.K[self.i] == "name" and not (self.typed and self.word("implements")):
            name = self.ident()
        elif decl and not nameless:
            self.fail("expected a name")
        if self.typed and self.K[self.i] == "<":
            self.type_params()
        kids = []
        if self.eat("extends"):
            kids.append(self.lhs())
            if self.typed and self.K[self.i] == "<":
                self.type_args()
        if self.typed and self.eat_word("implements"):
            self.type()
            while self.eat(","):
                self.type()
        self.need("{")
        while not self.eat("}"):
            if self.eat(";"):
                continue
            if self.K[self.i] == "eof":
                self.fail("expected '}' before the end")
            before = self.i
            state = (self.fn, self.is_async, self.gen, self.loop, self.switch, self.labels)
            try:
                m = self.member()
                if m is not None:
                    kids.append(m)
            except Fault as e:
                self.faults.append((e.at, e.what))
                self.fn, self.is_async, self.gen, self.loop, self.switch, self.labels = state
                self.recover(before, "}")
        return self.node("class", a, kids, name.v if name else None)

    def member(self):
        K, a = self.K, self.S[self.i]
        self.decorators()
        is_async = gen = False
        getter = ""
        while K[self.i] == "name" or (self.typed and K[self.i] == "const"):
            w, nxt = self.text(), K[self.i + 1]
            ends = nxt in ("(", "=", ";", "}", "?", "!", ":", "<", ",", "eof")
            if ends:
                break
            if w == "static" and nxt == "{":
                self.i += 1
                keep = (self.fn, self.is_async, self.loop, self.switch)
                self.is_async = self.loop = self.switch = 0
                b = self.block()
                self.fn, self.is_async, self.loop, self.switch = keep
                return b
            if w in ("static", "accessor") or (self.typed and w in _MODIFIERS and w != "async"):
                self.i += 1
                continue
            if w == "async" and not self.N[self.i + 1]:
                self.i += 1
                is_async = True
                break
            if w in ("get", "set") and not (self.N[self.i + 1] and nxt == "*"):
                self.i += 1
                getter = w
                break
            break
        if self.eat("*"):
            gen = True
        if self.typed and K[self.i] == "[" and K[self.i + 1] == "name" and K[self.i + 2] == ":":
            self.i += 3
            self.type()
            self.need("]")
            if self.eat(":"):
                self.type()
            self.semicolon()
            return None
        name = self.prop_name(private=True)
        if self.typed:
            self.eat("?") or self.eat("!")
        if K[self.i] == "(" or (self.typed and K[self.i] == "<"):
            return self.fn_rest("method", a, name, is_async, gen, method=True, bodiless=True)
        if is_async or gen or getter:
            self.fail("expected '('")
        if self.typed and self.eat(":"):
            self.type()
        init = None
        if self.eat("="):
            keep = (self.fn, self.is_async)
            self.is_async = 0
            self.fn += 1
            init = self.assign_in()
            self.fn, self.is_async = keep
        self.semicolon()
        return self.node("field", a, [init] if init else [], name.v, {"name": name, "init": init})

    def prop_name(self, private=False):
        K, i = self.K, self.i
        k, a = K[i], self.S[i]
        if k == "[":
            self.i += 1
            e = self.assign_in()
            self.need("]")
            return self.node("computed", a, [e])
        if k == "#" and private and K[i + 1] in RESERVED | {"name"}:
            self.i += 2
            return Node("id", a, self.E[i + 1], (), self.src[a : self.E[i + 1]])
        if k == "name" or k in RESERVED or k == "num":
            self.i += 1
            return Node("id", a, self.E[i], (), self.text(i))
        if k == "str":
            self.i += 1
            return Node("id", a, self.E[i], (), self.text(i)[1:-1])
        self.fail("expected a property name" if k != "bad" else None)

    # -- expressions --------------------------------------------------------------

    def expression(self):
        a = self.S[self.i]
        e = self.assign()
        if self.K[self.i] == ",":
            kids = [e]
            while self.eat(","):
                kids.append(self.assign())
            return self.node("seq", a, kids)
        return e

    def assign(self):
        K, i = self.K, self.i
        k, a = K[i], self.S[i]
        if k == "name":
            w = self.src[a : self.E[i]]
            if w == "async" and not self.N[i + 1]:
                if K[i + 1] == "name" and K[i + 2] == "=>":
                    self.i += 1
                    return self.arrow(a, True)
                if K[i + 1] == "(" or (self.typed and K[i + 1] == "<"):
                    r = self.try_arrow(a, i + 1, True)
                    if r is not None:
                        return r
            elif w == "yield" and self.gen:
                self.i += 1
                if self.eat("*"):
                    return self.node("yield", a, [self.assign()])
                if self.N[self.i] or K[self.i] in (")", "]", "}", ",", ";", "eof", ":", "tmid", "ttail"):
                    return self.node("yield", a)
                return self.node("yield", a, [self.assign()])
            if K[i + 1] == "=>":
                return self.arrow(a, False)
        elif k == "(" or (k == "<" and self.typed):
            r = self.try_arrow(a, i, False)
            if r is not None:
                return r
        left = self.conditional()
        k = K[self.i]
        if k in ASSIGN or k == ">":
            op, n = (k, 1) if k != ">" else self.gt_run()
            if op not in ASSIGN or op == ">=":
                return left
            self.target(left, op == "=")
            self.i += n
            right = self.assign()
            return self.node("assign", a, [left, right], op, {"left": left, "right": right})
        return left

    def target(self, n, patterns=True):
        if n.t in ("id", "member", "index", "nonnull"):
            if n.v == "?.":
                raise Fault(n.s, "an optional chain cannot be assigned")
            return
        if n.t == "paren" and n.k[0].t not in ("array", "object"):
            return self.target(n.k[0], False)
        if n.t in ("as", "cast"):
            return self.target(n.k[0], False)
        if patterns and n.t == "array":
            for x in n.k:
                self.target(x.k[0] if x.t in ("spread",) or (x.t == "assign" and x.v == "=") else x)
            return
        if patterns and n.t == "object":
            for x in n.k:
                if x.t == "property" and x.f:
                    v = x.f["value"]
                    self.target(v.k[0] if v.t == "assign" and v.v == "=" else v)
                elif x.t == "spread":
                    self.target(x.k[0])
                elif x.t == "method":
                    raise Fault(x.s, "a method in a pattern")
            n.v = None
            self.pending_init.discard(n.s)
            return
        raise Fault(n.s, "cannot be assigned")

    @property
    def pending_init(self):
        p = self.__dict__.get("_pending")
        if p is None:
            p = self.__dict__["_pending"] = set()
        return p

    def try_arrow(self, a, i, is_async):
        """An arrow function whose parameters begin at token i, or None."""
        K, M = self.K, self.M
        if i in self.no_arrow:
            return None
        if K[i] == "(":
            j = M[i]
            if j < 0:
                return None
            nxt = K[j + 1]
            if nxt == "=>":
                self.i = i
                return self.arrow(a, is_async)
            if nxt != ":" or not self.typed:
                return None
        save, faults, st = self.i, len(self.faults), (self.fn, self.is_async, self.gen, self.loop, self.switch, self.labels, self.no_in)
        try:
            self.i = i
            return self.arrow(a, is_async)
        except Fault:
            self.i = save
            del self.faults[faults:]
            self.fn, self.is_async, self.gen, self.loop, self.switch, self.labels, self.no_in = st
            self.no_arrow.add(i)
            return None

    def arrow(self, a, is_async):
        if self.typed and self.K[self.i] == "<":
            self.type_params()
        keep = (self.is_async, self.gen, self.loop, self.switch, self.labels, self.fn)
        if self.K[self.i] == "name":
            params = [self.ident()]
        else:
            self.is_async = int(is_async)
            params = self.params()
            if self.typed and self.eat(":"):
                self.type(ret=True, arrow=True)
        if self.N[self.i]:
            self.fail("line break before '=>'")
        self.need("=>")
        self.is_async, self.gen, self.loop, self.switch, self.labels = int(is_async), 0, 0, 0, []
        self.fn += 1
        if self.K[self.i] == "{":
            keep_in, self.no_in = self.no_in, False
            body = self.block()
            self.no_in = keep_in
        else:
            body = self.assign()
        self.is_async, self.gen, self.loop, self.switch, self.labels, self.fn = keep
        return self.node("arrow", a, params + [body], None, {"body": body, "params": params})

    def conditional(self):
        a = self.S[self.i]
        c = self.binary(0)
        if self.K[self.i] == "?":
            self.i += 1
            keep, self.no_in = self.no_in, False
            x = self.assign()
            self.no_in = keep
            self.need(":")
            y = self.assign()
            return self.node("cond", a, [c, x, y])
        return c

    def binary(self, least):
        K, a = self.K, self.S[self.i]
        if K[self.i] == "#" and K[self.i + 1] == "name" and K[self.i + 2] == "in":
            self.i += 2
            left = Node("id", a, self.E[self.i - 1], (), "#")
        else:
            left = self.unary()
        while True:
            k = K[self.i]
            n = 1
            if k == ">":
                k, n = self.gt_run()
            elif k == "name" and self.typed and not self.N[self.i] and least < 8 and self.text() in ("as", "satisfies"):
                self.i += 1
                if not self.eat("const"):
                    self.type()
                left = self.node("as", a, [left])
                continue
            p = BINARY.get(k)
            if p is None or p <= least or (k == "in" and self.no_in):
                return left
            if k == "**":
                if left.t == "unary" or (left.t == "await"):
                    self.fail("ambiguous power of a unary expression")
                self.i += n
                right = self.binary(p - 1)
            else:
                self.i += n
                right = self.binary(p)
            if k == "??" and ("||" in (left.v, right.v) or "&&" in (left.v, right.v)) and (left.t == "binary" and left.v in ("||", "&&") or right.t == "binary" and right.v in ("||", "&&")):
                self.fail("'??' mixed with '||' or '&&'", self.i - 1)
            if k in ("||", "&&") and (left.t == "binary" and left.v == "??" or right.t == "binary" and right.v == "??"):
                self.fail("'??' mixed with '||' or '&&'", self.i - 1)
            left = self.node("binary", a, [left, right], k)

    def unary(self):
        k, a = self.K[self.i], self.S[self.i]
        if k in UNARY:
            self.i += 1
            e = self.unary()
            return self.node("unary", a, [e], k)
        if k in ("++", "--"):
            self.i += 1
            e = self.unary()
            self.target(e, False)
            return self.node("update", a, [e])
        if k == "name" and self.text() == "await" and (self.is_async or not self.fn):
            self.i += 1
            e = self.unary()
            return self.node("await", a, [e])
        if k == "<" and self.typed and not self.jsx:
            self.i += 1
            if not self.eat("const"):
                self.type()
            self.need(">")
            return self.node("cast", a, [self.unary()])
        e = self.lhs()
        if self.K[self.i] in ("++", "--") and not self.N[self.i]:
            self.target(e, False)
            self.i += 1
            return self.node("update", a, [e])
        return e

    def args(self):
        self.need("(")
        keep, self.no_in = self.no_in, False
        kids = []
        while self.K[self.i] != ")":
            b = self.S[self.i]
            if self.eat("..."):
                kids.append(self.node("spread", b, [self.assign()]))
            else:
                kids.append(self.assign())
            if self.K[self.i] != ")":
                self.need(",")
        self.i += 1
        self.no_in = keep
        return kids

    def lhs(self, calls=True):
        K, a = self.K, self.S[self.i]
        k = K[self.i]
        if k == "new":
            self.i += 1
            if self.eat("."):
                self.need_word("target")
                e = self.node("id", a, (), "new.target")
            else:
                callee = self.lhs(calls=False)
                if self.typed and K[self.i] == "<":
                    self.try_type_args()
                kids = self.args() if K[self.i] == "(" else []
                e = self.node("new", a, [callee] + kids)
        elif k == "super":
            self.i += 1
            if K[self.i] not in ("(", ".", "["):
                self.fail("expected '(' after 'super'")
            e = self.node("super", a)
        elif k == "import":
            self.i += 1
            if self.eat("."):
                self.need("name")
                e = self.node("id", a, (), "import.meta")
            else:
                if not calls or K[self.i] != "(":
                    self.fail("expected '('")
                e = self.node("id", a, (), "import")
        else:
            e = self.primary()
        chain = False
        while True:
            k = K[self.i]
            if k == ".":
                self.i += 1
                n = self.member_name()
                e = self.node("member", a, [e], "?." if chain else None, {"object": e, "name": n})
            elif k == "?.":
                if not calls:
                    self.fail("an optional chain after 'new'")
                chain = True
                self.i += 1
                if K[self.i] == "(":
                    kids = self.args()
                    e = self.node("call", a, [e] + kids, None, {"callee": e, "args": kids})
                elif K[self.i] == "[":
                    self.i += 1
                    x = self.expression_in()
                    self.need("]")
                    e = self.node("index", a, [e, x], "?.")
                elif self.typed and K[self.i] == "<":
                    self.type_args()
                    kids = self.args()
                    e = self.node("call", a, [e] + kids, None, {"callee": e, "args": kids})
                else:
                    n = self.member_name()
                    e = self.node("member", a, [e], "?.", {"object": e, "name": n})
            elif k == "[":
                self.i += 1
                x = self.expression_in()
                self.need("]")
                e = self.node("index", a, [e, x], "?." if chain else None)
            elif k == "(":
                if not calls:
                    return e
                kids = self.args()
                e = self.node("call", a, [e] + kids, None, {"callee": e, "args": kids})
            elif k in ("tfull", "thead"):
                if chain:
                    self.fail("a template in an optional chain")
                x = self.template()
                e = self.node("tagged", a, [e, x])
            elif k == "!" and self.typed and not self.N[self.i]:
                self.i += 1
                e = self.node("nonnull", a, [e], "?." if chain else None)
            elif k == "<" and self.typed:
                if not self.try_type_args():
                    return e
                if not calls:
                    return e
                if K[self.i] not in ("(", "tfull", "thead"):
                    e = self.node("instantiation", a, [e])
            else:
                return e

    def member_name(self):
        i, k = self.i, self.K[self.i]
        if k == "#":
            self.i += 1
            i, k = self.i, self.K[self.i]
        if k == "name" or k in RESERVED:
            self.i += 1
            return self.text(i)
        self.fail("expected a name after '.'" if k != "bad" else None)

    def template(self):
        a = self.S[self.i]
        if self.eat("tfull"):
            return self.node("template", a)
        self.need("thead")
        kids = []
        while True:
            kids.append(self.expression_in())
            if self.eat("ttail"):
                return self.node("template", a, kids)
            self.need("tmid")

    def primary(self):
        K, i = self.K, self.i
        k, a = K[i], self.S[i]
        if k == "name":
            return self.ident() if self.text() != "async" or K[i + 1] != "function" or self.N[i + 1] else self.async_function(a)
        if k in ("num", "str", "regex", "this", "null", "true", "false"):
            self.i += 1
            return Node(k, a, self.E[i])
        if k == "(":
            self.i += 1
            e = self.expression_in()
            self.need(")")
            return self.node("paren", a, [e])
        if k == "[":
            self.i += 1
            keep, self.no_in = self.no_in, False
            kids = []
            while K[self.i] != "]":
                if self.eat(","):
                    continue
                b = self.S[self.i]
                if self.eat("..."):
                    kids.append(self.node("spread", b, [self.assign()]))
                else:
                    kids.append(self.assign())
                if K[self.i] != "]":
                    self.need(",")
            self.i += 1
            self.no_in = keep
            return self.node("array", a, kids)
        if k == "{":
            return self.object()
        if k == "function":
            return self.function(a, False)
        if k == "class":
            return self.class_(a, False)
        if k == "@":
            self.decorators()
            return self.class_(a, False)
        if k in ("tfull", "thead"):
            return self.template()
        if k == "jsx<":
            return self.element()
        self.fail()

    def async_function(self, a):
        self.i += 1
        return self.function(a, False, is_async=True)

    def object(self):
        K, a = self.K, self.S[self.i]
        self.need("{")
        keep, self.no_in = self.no_in, False
        kids, shorthand = [], None
        while K[self.i] != "}":
            b = self.S[self.i]
            if self.eat("..."):
                kids.append(self.node("spread", b, [self.assign()]))
            else:
                is_async = gen = False
                getter = ""
                if K[self.i] == "name" and K[self.i + 1] not in (",", "}", ":", "(", "=", "<"):
                    w = self.text()
                    if w == "async" and not self.N[self.i + 1]:
                        self.i += 1
                        is_async = True
                    elif w in ("get", "set"):
                        self.i += 1
                        getter = w
                if self.eat("*"):
                    gen = True
                start = self.i
                name = self.prop_name()
                k = K[self.i]
                if k == "(" or (k == "<" and self.typed):
                    kids.append(self.fn_rest("method", b, name, is_async, gen))
                elif is_async or gen or getter:
                    self.fail("expected '('")
                elif k == ":":
                    self.i += 1
                    v = self.assign()
                    kids.append(self.node("property", b, [v], name.v, {"name": name, "value": v}))
                else:
                    if K[start] != "name":
                        self.fail("expected ':'" if k != "bad" else None)
                    self.i = start
                    v = self.ident()
                    if self.eat("="):
                        # only a pattern may have this; it is checked once it is known what the braces are
                        shorthand = shorthand or v
                        d = self.assign()
                        v = self.node("assign", b, [v, d], "=")
                    kids.append(self.node("property", b, [v], name.v, {"name": name, "value": v}))
            if K[self.i] != "}":
                self.need(",")
        self.i += 1
        self.no_in = keep
        n = self.node("object", a, kids)
        if shorthand is not None and K[self.i] not in ("=",) and not self.word("of") and K[self.i] not in (",", "]", "}", ")", "in", ":"):
            raise Fault(shorthand.e, "'=' in an object")
        return n

    # -- elements ----------------------------------------------------------------

    def element(self):
        K, a = self.K, self.S[self.i]
        self.need("jsx<")
        name = ""
        kids = []
        if K[self.i] == "jsxname":
            name = self.text()
            self.i += 1
            while K[self.i] not in ("jsx>", "jsx/>"):
                b = self.S[self.i]
                if K[self.i] == "{":
                    self.i += 1
                    self.need("...")
                    kids.append(self.assign_in())
                    self.need("}")
                    continue
                if K[self.i] != "jsxname":
                    self.fail("expected an attribute" if K[self.i] != "bad" else None)
                self.i += 1
                if self.eat("="):
                    if K[self.i] == "str":
                        self.i += 1
                    elif self.eat("{"):
                        if K[self.i] == "}":
                            self.fail("an empty attribute")
                        kids.append(self.node("attribute", b, [self.assign_in()]))
                        self.need("}")
                    elif K[self.i] == "jsx<":
                        kids.append(self.element())
                    else:
                        self.fail("expected a value")
            if self.eat("jsx/>"):
                return self.node("element", a, kids, name)
        self.need("jsx>")
        while K[self.i] != "jsx</":
            k = K[self.i]
            if k == "jsxtext":
                self.i += 1
            elif k == "{":
                self.i += 1
                if self.eat("..."):
                    kids.append(self.assign_in())
                elif K[self.i] != "}":
                    kids.append(self.expression_in())
                self.need("}")
            elif k == "jsx<":
                kids.append(self.element())
            else:
                self.fail(f"expected </{name}>" if k != "bad" else None)
        self.i += 1
        close = ""
        if K[self.i] == "jsxname":
            close = self.text()
            self.i += 1
        if close != name:
            self.fail(f"expected </{name}>", self.i - 1)
        self.need("jsx>")
        return self.node("element", a, kids, name)

    # -- types ----------------------------------------------------------------------

    def ts_statement(self, a, w, top):
        """A statement that only TypeScript has, or None."""
        K, i = self.K, self.i
        nxt, same = K[i + 1], not self.N[i + 1]
        if w == "type" and nxt == "name" and same:
            self.i += 1
            self.i += 1
            if K[self.i] == "<":
                self.type_params()
            self.need("=")
            self.type()
            self.semicolon()
            return self.node("type", a)
        if w == "interface" and nxt == "name" and same:
            self.i += 2
            if K[self.i] == "<":
                self.type_params()
            if self.eat("extends"):
                self.type()
                while self.eat(","):
                    self.type()
            self.object_type()
            return self.node("interface", a)
        if w in ("namespace", "module") and nxt in ("name", "str") and same:
            self.i += 2
            while self.eat("."):
                self.need("name")
            if K[self.i] == "{":
                keep, self.ambient = self.ambient, True
                b = self.block_top()
                self.ambient = keep
                return self.node("namespace", a, [b])
            self.semicolon()
            return self.node("namespace", a)
        if w == "abstract" and nxt == "class" and same:
            self.i += 1
            return self.class_(a, True)
        if w == "global" and nxt == "{":
            self.i += 1
            keep, self.ambient = self.ambient, True
            b = self.block_top()
            self.ambient = keep
            return self.node("namespace", a, [b])
        if w == "declare" and same and (nxt in ("const", "var", "function", "class", "enum") or (nxt == "name" and self.text(i + 1) in ("let", "type", "interface", "namespace", "module", "abstract", "global", "async"))):
            self.i += 1
            keep, self.ambient = self.ambient, True
            s = self.statement2(top)
            self.ambient = keep
            return s or self.node("declare", a)
        return None

    def block_top(self):
        a = self.S[self.i]
        self.need("{")
        kids = []
        self.statements(kids, "}")
        self.need("}")
        return self.node("block", a, kids)

    def enum(self, a):
        self.need("enum")
        self.ident()
        self.need("{")
        kids = []
        while self.K[self.i] != "}":
            self.prop_name()
            if self.eat("="):
                kids.append(self.assign_in())
            if self.K[self.i] != "}":
                self.need(",")
        self.i += 1
        return self.node("enum", a, kids)

    def type_params(self):
        self.need("<")
        while self.K[self.i] != ">":
            while self.K[self.i] in ("const", "in") or (self.K[self.i] == "name" and self.text() in ("out",) and self.K[self.i + 1] == "name"):
                self.i += 1
            self.need("name")
            if self.eat("extends"):
                self.type()
            if self.eat("="):
                self.type()
            if self.K[self.i] != ">":
                self.need(",")
        self.i += 1

    def type_args(self):
        self.need("<")
        self.type()
        while self.eat(","):
            self.type()
        self.need(">")

    def try_type_args(self):
        save, faults = self.i, len(self.faults)
        try:
            self.type_args()
            if self.K[self.i] in _EXPR_FOLLOW and not (self.K[self.i] == ">" and self.S[self.i] == self.E[self.i - 1]) or self.N[self.i]:
                return True
        except Fault:
            pass
        self.i = save
        del self.faults[faults:]
        return False

    def type(self, ret=False, arrow=False):
        """A type; ``ret`` also allows a type predicate."""
        if ret and self.K[self.i] in ("name", "this"):
            i = self.i
            if self.word("asserts") and self.K[i + 1] in ("name", "this") and not self.N[i + 1] and not self.word("is", i + 1):
                self.i += 2
                if self.eat_word("is"):
                    self.type()
                return
            if self.word("is", i + 1) and not self.N[i + 1]:
                self.i += 2
                self.type()
                return
        self.type_union()
        if self.K[self.i] == "extends" and not self.N[self.i] and not self.in_extends:
            self.i += 1
            keep, self.in_extends = self.in_extends, True
            self.type_union()
            self.in_extends = keep
            self.need("?")
            keep, self.in_extends = self.in_extends, False
            self.type()
            self.need(":")
            self.type()
            self.in_extends = keep

    in_extends = False

    def type_union(self):
        self.eat("|") or self.eat("&")
        self.type_op()
        while self.K[self.i] in ("|", "&"):
            self.i += 1
            self.type_op()

    def type_op(self):
        i = self.i
        if self.K[i] == "name":
            w = self.text()
            nxt = self.K[i + 1]
            if w in ("keyof", "unique", "readonly") and nxt in ("name", "(", "{", "[", "typeof", "this", "import", "void", "null", "str", "num"):
                self.i += 1
                return self.type_op()
            if w == "infer" and nxt == "name":
                self.i += 2
                if self.K[self.i] == "extends":
                    save = self.i
                    self.i += 1
                    try:
                        keep, self.in_extends = self.in_extends, True
                        self.type_union()
                        self.in_extends = keep
                        if self.K[self.i] == "?":
                            self.i = save
                    except Fault:
                        self.i = save
                return
            if w == "abstract" and nxt == "new":
                self.i += 1
        if self.K[self.i] == "new":
            self.i += 1
            return self.fn_type()
        if self.K[self.i] == "<":
            return self.fn_type()
        if self.K[self.i] == "(":
            j = self.M[self.i]
            if j >= 0 and self.K[j + 1] == "=>":
                return self.fn_type()
        self.type_primary()
        while True:
            if self.K[self.i] == "[" and not self.N[self.i]:
                self.i += 1
                if not self.eat("]"):
                    self.type()
                    self.need("]")
            else:
                return

    def fn_type(self):
        if self.K[self.i] == "<":
            self.type_params()
        self.params()
        self.need("=>")
        self.type(ret=True)

    def type_primary(self):
        K, i = self.K, self.i
        k = K[i]
        if k == "name":
            self.i += 1
            while K[self.i] == "." and (K[self.i + 1] == "name" or K[self.i + 1] in RESERVED):
                self.i += 2
            if K[self.i] == "<" and not self.N[self.i]:
                self.type_args()
            return
        if k in ("str", "num", "true", "false", "null", "void", "this", "tfull"):
            self.i += 1
            return
        if k == "-" and K[i + 1] == "num":
            self.i += 2
            return
        if k == "thead":
            self.i += 1
            while True:
                self.type()
                if self.eat("ttail"):
                    return
                self.need("tmid")
        if k == "typeof":
            self.i += 1
            if K[self.i] == "import":
                return self.type_primary()
            if K[self.i] not in ("name", "this"):
                self.fail("expected a name")
            self.i += 1
            while self.eat("."):
                self.member_name()
            if K[self.i] == "<" and not self.N[self.i]:
                self.type_args()
            return
        if k == "import":
            self.i += 1
            self.need("(")
            self.type()
            if self.eat(","):
                self.object()
            self.need(")")
            while self.eat("."):
                self.need("name")
            if K[self.i] == "<":
                self.type_args()
            return
        if k == "(":
            self.i += 1
            keep, self.in_extends = self.in_extends, False
            self.type()
            self.in_extends = keep
            self.need(")")
            return
        if k == "[":
            self.i += 1
            while K[self.i] != "]":
                self.eat("...")
                if K[self.i] == "name" and (K[self.i + 1] == ":" or (K[self.i + 1] == "?" and K[self.i + 2] == ":")):
                    self.i += 1
                    self.eat("?")
                    self.need(":")
                self.type()
                self.eat("?")
                if K[self.i] != "]":
                    self.need(",")
            self.i += 1
            return
        if k == "{":
            return self.object_type()
        self.fail("expected a type" if k not in ("bad", "eof") else None)

    def object_type(self):
        K = self.K
        self.need("{")
        # a mapped type
        i = self.i
        if K[i] in ("+", "-") and self.word("readonly", i + 1):
            i += 2
        elif self.word("readonly", i) and K[i + 1] == "[":
            i += 1
        if K[i] == "[" and K[i + 1] == "name" and K[i + 2] == "in":
            self.i = i + 3
            self.type()
            if self.eat_word("as"):
                self.type()
            self.need("]")
            self.eat("+") or self.eat("-")
            self.eat("?")
            if self.eat(":"):
                self.type()
            self.eat(";") or self.eat(",")
            self.need("}")
            return
        while K[self.i] != "}":
            while K[self.i] == "name" and self.text() in ("readonly", "get", "set", "static", "public", "private", "protected") and K[self.i + 1] not in ("(", ":", "?", "<", ";", ",", "}") and not self.N[self.i + 1]:
                self.i += 1
            if K[self.i] in ("(", "<"):
                self.sig()
            elif K[self.i] == "new" and K[self.i + 1] in ("(", "<"):
                self.i += 1
                self.sig()
            elif K[self.i] == "[" and K[self.i + 1] == "name" and K[self.i + 2] == ":":
                self.i += 3
                self.type()
                self.need("]")
                if self.eat(":"):
                    self.type()
            else:
                self.prop_name()
                self.eat("?")
                if K[self.i] in ("(", "<"):
                    self.sig()
                elif self.eat(":"):
                    self.type()
            if not (self.eat(";") or self.eat(",") or K[self.i] == "}" or self.N[self.i]):
                self.fail("expected ';'" if K[self.i] != "bad" else None)
        self.i += 1

    def sig(self):
        if self.K[self.i] == "<":
            self.type_params()
        self.params()
        if self.eat(":"):
            self.type(ret=True)


def parse(src: str, jsx: bool = False, typed: bool = False, memo: bool = False, calls: bool = False) -> Parsed:
    p = JsParser(src, jsx, typed, memo, calls)
    out = p.program()
    known = {at for at, _ in out.faults}
    if p.t.bad and not out.faults:
        out.faults.extend(b for b in p.t.bad if b[0] not in known)
    return out
