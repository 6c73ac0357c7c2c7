"""Parser of Python 3."""

from __future__ import annotations

from .base import Fault, Memo, Node, Parsed, Shapes
from .py_fast import lex
from .py_lexer import RESERVED

# Binding powers of the binary operators.
BINARY = {"|": 1, "^": 2, "&": 3, "<<": 4, ">>": 4, "+": 5, "-": 5, "*": 6, "/": 6, "//": 6, "%": 6, "@": 6}
COMPARE = frozenset(["<", ">", "==", ">=", "<=", "!=", "in", "not", "is"])
AUGMENTED = frozenset(["+=", "-=", "*=", "/=", "//=", "%=", "@=", "&=", "|=", "^=", ">>=", "<<=", "**="])
_COMPOUND = frozenset("if while for try with def class async @".split())
_OPERAND = frozenset(["name", "num", "str", "bytes", "(", "[", "{", "-", "+", "~", "not", "lambda", "await", "None", "True", "False", "...", "*", "yield"])

_memo, _shapes = Memo(), Shapes()


class PyParser:
    def __init__(self, src: str, memo: bool = False, calls: bool = False):
        self.src = src
        self.t, self.holes = lex(src)
        self.K, self.S, self.E, self.M, self.key = self.t.kind, self.t.start, self.t.end, self.t.match, self.t.key
        self.i = 0
        self.faults: list[tuple[int, str]] = []
        self.memo = _memo if memo else None
        self.shapes = _shapes if calls else None
        if memo or calls:
            # index of the newline that ends the line of each token
            nxt, last = [0] * len(self.K), len(self.K) - 1
            for j in range(len(self.K) - 1, -1, -1):
                if self.K[j] == "newline":
                    last = j
                nxt[j] = last
            self.line_end = nxt

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
        raise Fault(self.S[i], what or {"eof": "unexpected end", "newline": "unexpected end of line", "indent": "unexpected indent", "dedent": "unexpected unindent"}.get(k, f"unexpected {self.text(i)[:20]!r}"))

    def eat(self, k):
        if self.K[self.i] == k:
            self.i += 1
            return True
        return False

    def need(self, k):
        if self.K[self.i] != k:
            self.fail(f"expected {k!r}" if self.K[self.i] != "bad" else None)
        self.i += 1

    def node(self, t, a, kids=(), v=None, f=None):
        return Node(t, a, self.E[self.i - 1], kids, v, f)

    def name(self):
        i = self.i
        if self.K[i] != "name":
            self.fail("expected a name" if self.K[i] != "bad" else None)
        self.i += 1
        return Node("id", self.S[i], self.E[i], (), self.text(i))

    # -- statements -------------------------------------------------------------

    def program(self) -> Parsed:
        kids = []
        self.suite_body(kids, "eof")
        for a, b, what in self.holes if self.shapes is None else ():
            if what:
                self.faults.append((a, what))
            else:
                self.hole(a, b)
        if self.t.bad and not self.faults:
            self.faults.extend(self.t.bad)
        return Parsed(sorted(self.faults), Node("program", 0, len(self.src), kids))

    def hole(self, a, b):
        """An expression inside an f-string."""
        body = self.src[a:b]
        if not body.strip():
            self.faults.append((a, "an empty replacement field"))
            return
        p = PyParser("(" + body + "\n)")
        try:
            p.need("(")
            p.star_exprs() if p.K[p.i] != "yield" else p.yield_()
            p.need(")")
            self.faults.extend((a + at - 1, w) for at, w in p.faults)
        except Fault as e:
            self.faults.append((a + e.at - 1, e.what))

    def suite_body(self, kids, end):
        K = self.K
        while K[self.i] != end:
            if K[self.i] == "eof":
                return
            if K[self.i] == "newline":
                self.i += 1
                continue
            before = self.i
            try:
                s = self.statement()
                if s is not None:
                    kids.append(s)
            except Fault as e:
                self.faults.append((e.at, e.what))
                self.recover(before)
            except RecursionError:
                if end != "eof":
                    raise
                self.faults.append((self.S[before], "nested too deeply"))
                self.recover(before)

    def recover(self, before):
        """Skip the rest of the line and a block below it."""
        K = self.K
        i = max(self.i, before)
        if K[i] == "indent":
            i += 1
        while K[i] not in ("newline", "eof"):
            i += 1
        if K[i] == "newline":
            i += 1
        if K[i] == "indent":
            deep = 0
            while K[i] != "eof":
                deep += (K[i] == "indent") - (K[i] == "dedent")
                i += 1
                if not deep:
                    break
        if i == before and K[i] != "eof":
            i += 1
        self.i = i

    def statement(self):
        K, i = self.K, self.i
        k = K[i]
        if k == "indent":
            self.fail("unexpected indent")
        if k in _COMPOUND:
            return self.compound(k)
        if k == "name":
            w = self.text()
            if w == "match" and K[i + 1] not in ("newline", "=", ".", ",", ")", ":", "eof") and (m := self.try_match()) is not None:
                return m
        if self.memo is not None:
            j = self.line_end[i]
            key = self.key[i : j + 1]
            if key in self.memo.seen:
                self.i = j + 1
                return None
            n = len(self.faults)
            s = self.simple_line()
            if self.i == j + 1 and len(self.faults) == n:
                self.memo.add(key)
            return s
        if self.shapes is not None:
            j = self.line_end[i]
            key = self.key[i : j + 1]
            if (calls := self.shapes.seen.get(key)) is not None:
                self.i = j + 1
                return Shapes.node(calls, self.S, self.E, i, j)
            n = len(self.faults)
            s = self.simple_line()
            if self.i == j + 1 and len(self.faults) == n:
                self.shapes.add(key, s, self.S, self.E, i, j)
            return s
        return self.simple_line()

    def simple_line(self):
        a = self.S[self.i]
        kids = [self.simple()]
        while self.eat(";"):
            if self.K[self.i] == "newline":
                break
            kids.append(self.simple())
        self.need_line()
        return kids[0] if len(kids) == 1 else self.node("stmts", a, [k for k in kids if k])

    def need_line(self):
        if self.K[self.i] != "newline":
            self.fail("expected the end of the line" if self.K[self.i] not in ("bad", "eof") else None)
        self.i += 1

    def simple(self):
        k, a = self.K[self.i], self.S[self.i]
        h = getattr(self, "s_" + k, None) if k in RESERVED else None
        if h is not None:
            return h(a)
        if k == "name" and self.text() == "type" and self.K[self.i + 1] == "name":
            save = self.i
            self.i += 2
            if self.K[self.i] == "[":
                self.type_params()
            if self.eat("="):
                self.expr()
                return self.node("type", a)
            self.i = save
        return self.expr_stmt(a)

    def expr_stmt(self, a):
        e = self.star_exprs() if self.K[self.i] != "yield" else self.yield_()
        k = self.K[self.i]
        if k == ":":
            if e.t not in ("id", "attr", "sub", "paren"):
                self.fail("only a name can be annotated")
            if e.t == "paren":
                self.target(e)
            self.i += 1
            kids = [e, self.expr()]
            if self.eat("="):
                kids.append(self.yield_() if self.K[self.i] == "yield" else self.star_exprs())
            return self.node("assign", a, kids)
        if k in AUGMENTED:
            if e.t not in ("id", "attr", "sub") and not (e.t == "paren" and e.k[0].t in ("id", "attr", "sub")):
                raise Fault(e.s, "cannot be assigned")
            self.i += 1
            r = self.yield_() if self.K[self.i] == "yield" else self.star_exprs()
            return self.node("assign", a, [e, r])
        kids = [e]
        while self.eat("="):
            self.target(kids[-1])
            kids.append(self.yield_() if self.K[self.i] == "yield" else self.star_exprs())
        if len(kids) > 1:
            return self.node("assign", a, kids)
        if e.t == "star":
            raise Fault(e.s, "a starred expression cannot stand here")
        return self.node("expr", a, [e])

    def target(self, n):
        if n.t in ("id", "attr", "sub"):
            return
        if n.t in ("tuple", "list"):
            for x in n.k:
                self.target(x)
            if sum(x.t == "star" for x in n.k) > 1:
                raise Fault(n.s, "two starred targets")
            return
        if n.t == "star":
            return self.target(n.k[0])
        if n.t == "paren":
            return self.target(n.k[0])
        raise Fault(n.s, "cannot be assigned")

    def s_pass(self, a):
        self.i += 1
        return None

    s_break = s_continue = s_pass

    def s_return(self, a):
        self.i += 1
        kids = [] if self.K[self.i] in ("newline", ";") else [self.star_exprs()]
        return self.node("return", a, kids)

    def s_raise(self, a):
        self.i += 1
        kids = []
        if self.K[self.i] not in ("newline", ";"):
            kids.append(self.expr())
            if self.eat("from"):
                kids.append(self.expr())
        return self.node("raise", a, kids)

    def s_global(self, a):
        self.i += 1
        self.name()
        while self.eat(","):
            self.name()
        return None

    s_nonlocal = s_global

    def s_del(self, a):
        self.i += 1
        kids = []
        while True:
            e = self.expr()
            self.del_target(e)
            kids.append(e)
            if not self.eat(",") or self.K[self.i] in ("newline", ";"):
                break
        return self.node("del", a, kids)

    def del_target(self, e):
        if e.t in ("tuple", "list", "paren"):
            for x in e.k:
                self.del_target(x)
        elif e.t not in ("id", "attr", "sub"):
            raise Fault(e.s, "cannot be deleted")

    def s_assert(self, a):
        self.i += 1
        kids = [self.expr()]
        if self.eat(","):
            kids.append(self.expr())
        return self.node("assert", a, kids)

    def dotted(self):
        self.name()
        while self.eat("."):
            self.name()

    def s_import(self, a):
        self.i += 1
        while True:
            self.dotted()
            if self.eat("as"):
                self.name()
            if not self.eat(","):
                return self.node("import", a)

    def s_from(self, a):
        self.i += 1
        dots = False
        while self.K[self.i] in (".", "..."):
            self.i += 1
            dots = True
        if self.K[self.i] == "name" or not dots:
            self.dotted()
        self.need("import")
        if self.eat("*"):
            return self.node("import", a)
        par = self.eat("(")
        while True:
            self.name()
            if self.eat("as"):
                self.name()
            if not self.eat(","):
                break
            if par and self.K[self.i] == ")":
                break
            if not par and self.K[self.i] == "newline":
                self.fail("trailing comma")
        if par:
            self.need(")")
        return self.node("import", a)

    def header(self):
        """Skip to the colon of a header whose shape is known."""
        if self.memo is None:
            return False
        i = self.i
        j = self.line_end[i]
        if self.K[j - 1] == ":" and self.key[i : j + 1] in self.memo.seen:
            self.i = j - 1
            return True
        self.head_from = (i, len(self.faults))
        return False

    head_from = None

    def suite(self):
        self.need(":")
        a = self.S[self.i]
        if self.memo is not None and self.head_from is not None:
            i, n = self.head_from
            self.head_from = None
            if self.K[self.i] == "newline" and self.line_end[i] == self.i and len(self.faults) == n:
                self.memo.add(self.key[i : self.i + 1])
        if self.eat("newline"):
            if not self.eat("indent"):
                self.fail("expected an indented block" if self.K[self.i] != "bad" else None)
            kids = []
            self.suite_body(kids, "dedent")
            j = self.i - 1
            while self.K[j] in ("newline", "indent", "dedent"):
                j -= 1
            if not self.eat("dedent") and self.K[self.i] != "eof":
                self.fail("expected an unindent")
            return Node("block", a, self.E[j], kids)
        if self.K[self.i] in _COMPOUND and self.K[self.i] != "@":
            self.fail("a compound statement cannot stand here")
        s = self.simple_line()
        return Node("block", a, self.E[self.i - 1], [s] if s else [])

    def compound(self, k):
        a = self.S[self.i]
        if k == "@":
            while self.K[self.i] == "@":
                self.i += 1
                self.named()
                self.need_line()
                while self.eat("newline"):
                    pass
            if self.K[self.i] not in ("def", "class", "async") or (self.K[self.i] == "async" and self.K[self.i + 1] != "def"):
                self.fail("expected 'def' or 'class' after a decorator")
            d = self.compound(self.K[self.i])
            return Node("decorated", a, d.e, [d])
        if k == "async":
            if self.K[self.i + 1] not in ("def", "for", "with"):
                self.fail("expected 'def', 'for' or 'with' after 'async'", self.i + 1)
            self.i += 1
            k = self.K[self.i]
        return getattr(self, "c_" + k)(a)

    def c_if(self, a):
        first = self.S[self.i]
        cond = text = None
        if not self.header():
            self.i += 1
            cond = self.named()
            text = self.src[cond.s : cond.e]
        then = self.suite()
        alts = []
        _ = first
        while self.K[self.i] == "elif":
            b = self.S[self.i]
            c = t = None
            if not self.header():
                self.i += 1
                c = self.named()
                t = self.src[c.s : c.e]
            body = self.suite()
            alts.append(self.node("elif", b, [x for x in (c, body) if x], t, {"cond": c, "then": body}))
        if self.K[self.i] == "else":
            b = self.S[self.i]
            self.header() or self.skip()
            alts.append(Node("else", b, 0, [self.suite()]))
        return Node("if", a, (alts or [then])[-1].e, [x for x in (cond, then) if x] + alts, text, {"cond": cond, "then": then, "alts": alts})

    def skip(self):
        self.i += 1
        return True

    def c_while(self, a):
        kids = []
        if not self.header():
            self.i += 1
            kids.append(self.named())
        kids.append(self.suite())
        self.else_(kids)
        return self.node("while", a, kids)

    def else_(self, kids):
        if self.K[self.i] == "else":
            self.header() or self.skip()
            kids.append(self.suite())

    def c_for(self, a):
        kids = []
        if not self.header():
            self.i += 1
            t = self.targets()
            self.need("in")
            kids = [t, self.star_exprs()]
        kids.append(self.suite())
        self.else_(kids)
        return self.node("for", a, kids)

    def targets(self):
        a = self.S[self.i]
        kids = []
        comma = False
        while True:
            b = self.S[self.i]
            if self.eat("*"):
                e = self.node("star", b, [self.binary(0)])
            else:
                e = self.binary(0)
            self.target(e)
            kids.append(e)
            if not self.eat(","):
                break
            comma = True
            if self.K[self.i] in ("in", "="):
                break
        if kids[0].t == "star" and not comma:
            raise Fault(kids[0].s, "a starred target alone")
        return kids[0] if not comma else self.node("tuple", a, kids)

    def c_try(self, a):
        self.header() or self.skip()
        kids = [self.suite()]
        n = 0
        bare = False
        while self.K[self.i] == "except":
            n += 1
            if bare:
                self.fail("a bare 'except' must be last")
            if not self.header():
                self.i += 1
                self.eat("*")
                if self.K[self.i] == ":":
                    bare = True
                else:
                    kids.append(self.expr())
                    if self.K[self.i] == ",":
                        self.fail("several exception types need parentheses")
                    if self.eat("as"):
                        self.name()
            elif self.K[self.i - 1] == "except":
                bare = True
            kids.append(self.suite())
        if n and self.K[self.i] == "else":
            self.header() or self.skip()
            kids.append(self.suite())
        if self.K[self.i] == "finally":
            n += 1
            self.header() or self.skip()
            kids.append(self.suite())
        if not n:
            self.fail("expected 'except' or 'finally'" if self.K[self.i] != "bad" else None)
        return self.node("try", a, kids)

    def c_with(self, a):
        kids = []
        if not self.header():
            self.i += 1
            done = False
            if self.K[self.i] == "(":
                j = self.M[self.i]
                if j > 0 and self.K[j + 1] == ":":
                    save, n = self.i, len(self.faults)
                    try:
                        self.i += 1
                        while True:
                            kids.append(self.with_item())
                            if not self.eat(",") or self.K[self.i] == ")":
                                break
                        self.need(")")
                        done = self.K[self.i] == ":"
                    except Fault:
                        pass
                    if not done:
                        self.i = save
                        del self.faults[n:]
                        kids = []
            while not done:
                kids.append(self.with_item())
                if not self.eat(","):
                    break
        kids.append(self.suite())
        return self.node("with", a, kids)

    def with_item(self):
        e = self.expr()
        if self.eat("as"):
            if self.K[self.i] == "*":
                self.fail()
            t = self.binary(0)
            self.target(t)
        return e

    def type_params(self):
        self.need("[")
        while self.K[self.i] != "]":
            self.eat("*") or self.eat("**")
            self.name()
            if self.eat(":"):
                self.expr()
            if self.eat("="):
                self.eat("*")
                self.expr()
            if self.K[self.i] != "]":
                self.need(",")
        self.i += 1

    def c_def(self, a):
        name, params = None, []
        if not self.header():
            self.i += 1
            name = self.name()
            if self.K[self.i] == "[":
                self.type_params()
            self.need("(")
            params = self.params(")", True)
            self.need(")")
            if self.eat("->"):
                self.expr()
        body = self.suite()
        return Node("def", a, body.e, params + [body], name.v if name else None, {"name": name, "body": body})

    def params(self, end, annotated):
        kids, star, slash, default, kw, count = [], False, False, False, False, 0
        bare = False
        while self.K[self.i] != end:
            if kw:
                self.fail("a parameter after '**'")
            if self.eat("**"):
                if bare:
                    self.fail("a name must follow '*'", self.i - 1)
                kw = True
                self.name()
                if annotated and self.eat(":"):
                    self.expr()
            elif self.eat("*"):
                if star:
                    self.fail("a second '*'", self.i - 1)
                star = True
                if self.K[self.i] == ",":
                    bare = True
                else:
                    self.name()
                    if annotated and self.eat(":"):
                        self.eat("*")
                        self.expr()
                    if self.K[self.i] == "=":
                        self.fail("a default for '*'")
            elif self.eat("/"):
                if slash or star or not count:
                    self.fail("'/' cannot stand here", self.i - 1)
                slash = True
            else:
                bare = False
                self.name()
                count += 1
                if annotated and self.eat(":"):
                    self.expr()
                if self.eat("="):
                    default = True
                    kids.append(self.expr())
                elif default and not star:
                    self.fail("a parameter without a default after one with it", self.i - 1)
            if self.K[self.i] != end:
                self.need(",")
        if bare:
            self.fail("a name must follow '*'")
        return kids

    def c_class(self, a):
        name, kids = None, []
        if not self.header():
            self.i += 1
            name = self.name()
            if self.K[self.i] == "[":
                self.type_params()
            if self.eat("("):
                kids = self.args()
        body = self.suite()
        return Node("class", a, body.e, kids + [body], name.v if name else None, {"name": name, "body": body})

    def try_match(self):
        save, n, a = self.i, len(self.faults), self.S[self.i]
        j = self.i
        while self.K[j] not in ("newline", "eof"):
            j += 1
        if self.K[j - 1] != ":" or self.K[j + 1] != "indent":
            return None
        try:
            self.i += 1
            subject = self.star_exprs(named=True)
            if self.K[self.i] != ":" or self.i != j - 1:
                raise Fault(a, "")
        except Fault:
            self.i = save
            del self.faults[n:]
            return None
        self.i = j + 2
        kids = [subject]
        while self.K[self.i] != "dedent":
            if self.K[self.i] == "eof":
                break
            if self.eat("newline"):
                continue
            if not (self.K[self.i] == "name" and self.text() == "case"):
                self.fail("expected 'case'")
            b = self.S[self.i]
            self.i += 1
            p = self.S[self.i]
            self.patterns()
            v = self.src[p : self.E[self.i - 1]]
            guard = self.named() if self.eat("if") else None
            self.head_from = None
            body = self.suite()
            kids.append(Node("case", b, body.e, [x for x in (guard, body) if x], v))
        self.eat("dedent")
        return self.node("match", a, kids)

    def patterns(self):
        while True:
            self.eat("*")
            self.pattern()
            if not self.eat(",") or self.K[self.i] in (":", "if"):
                return

    def pattern(self):
        self.pattern_one()
        while self.eat("|"):
            self.pattern_one()
        if self.eat("as"):
            self.name()

    def pattern_one(self):
        k = self.K[self.i]
        if k in ("num", "-", "str", "bytes"):
            self.binary(4)
        elif k in ("None", "True", "False"):
            self.i += 1
        elif k == "name":
            self.dotted()
            if self.eat("("):
                while self.K[self.i] != ")":
                    if self.K[self.i] == "name" and self.K[self.i + 1] == "=":
                        self.i += 2
                    self.pattern()
                    if self.K[self.i] != ")":
                        self.need(",")
                self.i += 1
        elif k in ("(", "["):
            end = ")" if k == "(" else "]"
            self.i += 1
            while self.K[self.i] != end:
                self.eat("*")
                self.pattern()
                if self.K[self.i] != end:
                    self.need(",")
            self.i += 1
        elif k == "{":
            self.i += 1
            while self.K[self.i] != "}":
                if self.eat("**"):
                    self.name()
                else:
                    if self.K[self.i] == "name":
                        self.dotted()
                    else:
                        self.pattern_one()
                    self.need(":")
                    self.pattern()
                if self.K[self.i] != "}":
                    self.need(",")
            self.i += 1
        else:
            self.fail()

    # -- expressions --------------------------------------------------------------

    def star_exprs(self, named=False):
        a = self.S[self.i]
        e = self.star_or(named)
        if self.K[self.i] != ",":
            return e
        kids = [e]
        while self.eat(","):
            if self.K[self.i] not in _OPERAND:
                if self.K[self.i] == "bad":
                    self.fail()
                break
            if self.K[self.i] == "yield":
                self.fail()
            kids.append(self.star_or(named))
        return self.node("tuple", a, kids)

    def star_or(self, named):
        a = self.S[self.i]
        if self.eat("*"):
            return self.node("star", a, [self.binary(0)])
        return self.named() if named else self.expr()

    def named(self):
        i, a = self.i, self.S[self.i]
        if self.K[i] == "name" and self.K[i + 1] == ":=":
            n = self.name()
            self.i += 1
            return self.node("walrus", a, [n, self.expr()])
        return self.expr()

    def yield_(self):
        a = self.S[self.i]
        self.need("yield")
        if self.eat("from"):
            return self.node("yield", a, [self.expr()])
        if self.K[self.i] in ("newline", ")", "]", "}", ";", "=", "eof"):
            return self.node("yield", a)
        return self.node("yield", a, [self.star_exprs()])

    def expr(self):
        a = self.S[self.i]
        if self.K[self.i] == "lambda":
            self.i += 1
            kids = self.params(":", False)
            self.need(":")
            return self.node("lambda", a, kids + [self.expr()])
        e = self.or_()
        if self.K[self.i] == "if":
            self.i += 1
            c = self.or_()
            if not self.eat("else"):
                self.fail("expected 'else'" if self.K[self.i] != "bad" else None)
            return self.node("cond", a, [e, c, self.expr()])
        return e

    def or_(self):
        a = self.S[self.i]
        e = self.and_()
        while self.eat("or"):
            e = self.node("bool", a, [e, self.and_()])
        return e

    def and_(self):
        a = self.S[self.i]
        e = self.not_()
        while self.eat("and"):
            e = self.node("bool", a, [e, self.not_()])
        return e

    def not_(self):
        a = self.S[self.i]
        if self.eat("not"):
            return self.node("not", a, [self.not_()])
        e = self.binary(0)
        while self.K[self.i] in COMPARE:
            k = self.K[self.i]
            if k == "not":
                if self.K[self.i + 1] != "in":
                    self.fail()
                self.i += 2
            elif k == "is":
                self.i += 1
                self.eat("not")
            else:
                self.i += 1
            e = self.node("compare", a, [e, self.binary(0)])
        return e

    def binary(self, least):
        a = self.S[self.i]
        left = self.unary()
        while True:
            k = self.K[self.i]
            p = BINARY.get(k)
            if p is None or p <= least:
                return left
            self.i += 1
            left = self.node("binary", a, [left, self.binary(p)], k)

    def unary(self):
        k, a = self.K[self.i], self.S[self.i]
        if k in ("-", "+", "~"):
            self.i += 1
            e = self.node("unary", a, [self.unary()])
            return e
        if k == "await":
            self.i += 1
            e = self.node("await", a, [self.primary()])
        else:
            e = self.primary()
        if self.eat("**"):
            e = self.node("power", a, [e, self.unary()])
        return e

    def primary(self):
        K, a = self.K, self.S[self.i]
        e = self.atom()
        while True:
            k = K[self.i]
            if k == ".":
                self.i += 1
                n = self.name()
                e = self.node("attr", a, [e], n.v)
            elif k == "(":
                self.i += 1
                kids = self.args()
                e = self.node("call", a, [e] + kids, None, {"callee": e, "args": kids})
            elif k == "[":
                self.i += 1
                e = self.node("sub", a, [e] + self.subscript())
            else:
                return e

    def subscript(self):
        kids = []
        if self.K[self.i] == "]":
            self.fail("an empty subscript")
        while True:
            b = self.S[self.i]
            if self.eat("*"):
                kids.append(self.node("star", b, [self.binary(0)]))
            else:
                if self.K[self.i] != ":":
                    kids.append(self.named())
                if self.eat(":"):
                    if self.K[self.i] not in (":", "]", ","):
                        kids.append(self.expr())
                    if self.eat(":") and self.K[self.i] not in ("]", ","):
                        kids.append(self.expr())
            if not self.eat(",") or self.K[self.i] == "]":
                break
        self.need("]")
        return [self.node("slice", kids[0].s if kids else self.S[self.i - 1], kids)] if len(kids) > 1 else kids

    def args(self):
        """Arguments after '(' up to and with ')'."""
        K = self.K
        kids, keyword, double = [], False, False
        while K[self.i] != ")":
            b = self.S[self.i]
            if self.eat("**"):
                double = True
                kids.append(self.node("star", b, [self.expr()]))
            elif self.eat("*"):
                if double:
                    self.fail("'*' after '**'", self.i - 1)
                kids.append(self.node("star", b, [self.expr()]))
            elif K[self.i] == "name" and K[self.i + 1] == "=":
                n = self.name()
                self.i += 1
                keyword = True
                kids.append(self.node("keyword", b, [n, self.expr()]))
            else:
                e = self.named()
                if K[self.i] in ("for", "async"):
                    e = self.comp(e, b)
                    if kids or not (K[self.i] == ")" or (K[self.i] == "," and K[self.i + 1] == ")" and not kids)):
                        self.fail("a generator must be in parentheses", self.i - 1)
                elif keyword or double:
                    self.fail("a positional argument after a keyword argument", self.i - 1)
                elif K[self.i] == "=":
                    self.fail("a keyword must be a name")
                kids.append(e)
            if K[self.i] != ")":
                self.need(",")
        self.i += 1
        return kids

    def comp(self, e, a):
        kids = [e]
        if e.t == "star":
            raise Fault(e.s, "a starred item in a comprehension")
        while self.K[self.i] in ("for", "async"):
            if self.eat("async") and self.K[self.i] != "for":
                self.fail("expected 'for'")
            self.need("for")
            kids.append(self.targets())
            self.need("in")
            kids.append(self.or_() if self.K[self.i] != "lambda" else self.expr())
            while self.eat("if"):
                b = self.i
                if self.K[b] == "name" and self.K[b + 1] == ":=":
                    kids.append(self.named())
                else:
                    kids.append(self.or_())
        return self.node("comp", a, kids)

    def atom(self):
        K, i = self.K, self.i
        k, a = K[i], self.S[i]
        if k == "name":
            self.i += 1
            w = self.src[a : self.E[i]]
            if w in ("print", "exec") and K[self.i] in ("str", "name", "num"):
                self.fail(f"parentheses missing in the call to {w!r}")
            return Node("id", a, self.E[i], (), w)
        if k in ("num", "None", "True", "False", "..."):
            self.i += 1
            return Node(k, a, self.E[i])
        if k in ("str", "bytes"):
            while K[self.i] == k:
                self.i += 1
            if K[self.i] in ("str", "bytes"):
                self.fail("text and bytes mixed")
            return self.node("str", a)
        if k == "(":
            self.i += 1
            if self.eat(")"):
                return self.node("tuple", a)
            if K[self.i] == "yield":
                e = self.yield_()
                self.need(")")
                return self.node("paren", a, [e])
            b = self.S[self.i]
            e = self.star_or(True)
            if K[self.i] in ("for", "async"):
                e = self.comp(e, b)
                self.need(")")
                return self.node("gen", a, [e])
            if K[self.i] == ",":
                kids = [e]
                while self.eat(","):
                    if K[self.i] == ")":
                        break
                    kids.append(self.star_or(True))
                self.need(")")
                return self.node("tuple", a, kids)
            if e.t == "star":
                raise Fault(e.s, "a starred expression cannot stand here")
            self.need(")")
            return self.node("paren", a, [e])
        if k == "[":
            self.i += 1
            kids = []
            while K[self.i] != "]":
                b = self.S[self.i]
                e = self.star_or(True)
                if K[self.i] in ("for", "async"):
                    if kids:
                        self.fail()
                    e = self.comp(e, b)
                    self.need("]")
                    return self.node("listcomp", a, [e])
                kids.append(e)
                if K[self.i] != "]":
                    self.need(",")
            self.i += 1
            return self.node("list", a, kids)
        if k == "{":
            self.i += 1
            kids, form = [], None
            while K[self.i] != "}":
                b = self.S[self.i]
                if self.eat("**"):
                    if form == "set":
                        self.fail()
                    form = "dict"
                    kids.append(self.node("star", b, [self.binary(0)]))
                else:
                    e = self.star_or(True)
                    if form != "set" and e.t != "star" and K[self.i] == ":" and e.t != "walrus":
                        self.i += 1
                        form = "dict"
                        v = self.expr()
                        e = self.node("pair", b, [e, v])
                    elif form == "dict":
                        self.fail("expected ':'" if K[self.i] != "bad" else None)
                    else:
                        form = "set"
                    if K[self.i] in ("for", "async"):
                        if kids:
                            self.fail()
                        e = self.comp(e, b)
                        self.need("}")
                        return self.node("dictcomp", a, [e])
                    kids.append(e)
                if K[self.i] != "}":
                    self.need(",")
            self.i += 1
            return self.node(form or "dict", a, kids)
        self.fail()


def parse(src: str, memo: bool = False, calls: bool = False) -> Parsed:
    return PyParser(src, memo, calls).program()
