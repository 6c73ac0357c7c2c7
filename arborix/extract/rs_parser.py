"""Parser of Rust 2021. Arguments of macros are balanced token trees, as in the language."""

from __future__ import annotations

from .base import Fault, Memo, Node, Parsed, Shapes, code
from .rs_fast import lex

# Binding powers of the binary operators.
BINARY = {"*": 11, "/": 11, "%": 11, "+": 10, "-": 10, "<<": 9, ">>": 9, "&": 8, "^": 7, "|": 6, "==": 5, "!=": 5, "<": 5, ">": 5, "<=": 5, ">=": 5, "&&": 4, "||": 3}
ASSIGN = frozenset(["=", "+=", "-=", "*=", "/=", "%=", "^=", "&=", "|=", "<<=", ">>="])
_BLOCKY = frozenset(["if", "match", "loop", "while", "for", "block", "unsafe", "macro{"])
_ITEM = frozenset("fn struct enum impl trait mod use const static type extern pub".split())
_memo, _shapes = Memo(), Shapes()


class RsParser:
    def __init__(self, src: str, memo: bool = False, calls: bool = False):
        self.src = src
        self.t = lex(src)
        self.K, self.S, self.E, self.M, self.key = self.t.kind, self.t.start, self.t.end, self.t.match, self.t.key
        self.i = 0
        self.faults: list[tuple[int, str]] = []
        self.memo = _memo if memo else None
        self.shapes = _shapes if calls else None
        self.no_struct = False

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
            if self.split(k):
                self.i += 1
                return
            self.fail(f"expected {k!r}" if self.K[self.i] != "bad" else None)
        self.i += 1

    def split(self, k):
        """Take the first character of a longer operator as a token of its own (``>>`` at the end of types, ``&&`` of references...)."""
        q = self.K[self.i]
        if len(k) == 1 and len(q) > 1 and q[0] == k and not q[0].isalpha():
            i = self.i
            self.K[i] = k
            self.K.insert(i + 1, q[1:])
            self.S.insert(i + 1, self.S[i] + 1)
            self.E.insert(i + 1, self.E[i])
            self.E[i] = self.S[i] + 1
            self.M.insert(i + 1, -1)
            self.M[:] = [m + 1 if m > i else m for m in self.M]
            self.key = self.key[:i] + code("rs " + k) + code("rs " + q[1:]) + self.key[i + 1 :]
            return True
        return False

    def eat_split(self, k):
        if self.K[self.i] == k or self.split(k):
            self.i += 1
            return True
        return False

    def node(self, t, a, kids=(), v=None, f=None):
        return Node(t, a, self.E[self.i - 1], kids, v, f)

    def word(self, w, i=None):
        i = self.i if i is None else i
        return self.K[i] == "name" and self.src[self.S[i] : self.E[i]] == w

    def name(self):
        if self.K[self.i] != "name":
            self.fail("expected a name" if self.K[self.i] != "bad" else None)
        self.i += 1
        return Node("id", self.S[self.i - 1], self.E[self.i - 1], (), self.text(self.i - 1))

    # -- items --------------------------------------------------------------------

    def program(self) -> Parsed:
        kids = []
        self.items(kids, "eof")
        if self.t.bad and not self.faults:
            self.faults.extend(self.t.bad)
        return Parsed(sorted(self.faults), Node("program", 0, len(self.src), kids))

    def items(self, kids, end, one=None):
        K = self.K
        while K[self.i] != end:
            if K[self.i] == "eof":
                self.fail("expected '}' before the end")
            before = self.i
            try:
                s = (one or self.item)()
                if s is not None:
                    kids.append(s)
            except Fault as e:
                self.faults.append((e.at, e.what))
                self.no_struct = False
                self.recover(before, end)
            except RecursionError:
                if end != "eof":
                    raise
                self.faults.append((self.S[before], "nested too deeply"))
                self.no_struct = False
                self.recover(before, end)

    def recover(self, before, end):
        K = self.K
        i = max(self.i, before + 1)
        deep = 0
        while K[i] != "eof":
            k = K[i]
            if k == "{":
                deep += 1
            elif k == "}":
                if deep == 0 and end == "}":
                    break
                deep = max(0, deep - 1)
                if deep == 0:
                    i += 1
                    break
            elif deep == 0 and k == ";":
                i += 1
                break
            elif deep == 0 and k in _ITEM and self.src[self.src.rfind("\n", 0, self.S[i]) + 1 : self.S[i]].strip() == "":
                break
            i += 1
        self.i = i

    def tree(self):
        """One balanced token tree in brackets."""
        o = self.K[self.i]
        want = []
        if o not in ("(", "[", "{"):
            self.fail("expected '('" if o != "bad" else None)
        while True:
            k = self.K[self.i]
            if k in ("(", "[", "{"):
                want.append({"(": ")", "[": "]", "{": "}"}[k])
            elif k in (")", "]", "}"):
                if k != want[-1]:
                    self.fail(f"expected {want[-1]!r}")
                want.pop()
                if not want:
                    self.i += 1
                    return o
            elif k in ("eof", "bad"):
                self.fail(f"expected {want[-1]!r}" if k == "eof" else None)
            self.i += 1

    def attributes(self):
        a = self.i
        while self.K[self.i] == "#" and (self.K[self.i + 1] == "[" or (self.K[self.i + 1] == "!" and self.K[self.i + 2] == "[")):
            self.i += 1
            self.eat("!")
            if self.K[self.i + 1] not in ("name", "unsafe", "crate", "self", "super", "::"):
                self.fail("expected an attribute", self.i + 1)
            self.tree()
        return self.src[self.S[a] : self.E[self.i - 1]] if self.i > a else ""

    def visibility(self):
        if self.eat("pub"):
            if self.K[self.i] == "(" and self.K[self.i + 1] in ("crate", "self", "super", "in"):
                self.tree()
        elif self.K[self.i] == "crate" and self.K[self.i + 1] != "::":
            self.i += 1

    def item(self, where="mod"):
        a = self.S[self.i]
        first = self.i
        attrs = self.attributes()
        if self.K[self.i] == "eof" and attrs.lstrip("# ").startswith("!"):
            return None
        inner = attrs and "#!" in attrs.replace(" ", "") and self.K[self.i] in ("eof", "}")
        if inner:
            return None
        self.visibility()
        it = self.item_kind(a, where, attrs)
        if it is None:
            self.fail("expected an item" if self.K[self.i] not in ("bad", "eof") else None)
        _ = first
        return it

    def item_kind(self, a, where="mod", attrs=""):
        """An item after its attributes and visibility, or None if none begins here."""
        K, i = self.K, self.i
        k = K[i]
        if k == "name":
            w = self.text()
            if w in ("default", "safe") and K[i + 1] in ("fn", "impl", "unsafe", "const", "type", "async", "extern", "static"):
                self.i += 1
                return self.item_kind(a, where, attrs)
            if w == "union" and K[i + 1] == "name" and K[i + 2] in ("{", "<", "where"):
                return self.struct(a)
            if w == "auto" and K[i + 1] == "trait":
                self.i += 1
                return self.trait(a)
            if w == "macro_rules" and K[i + 1] == "!":
                self.i += 2
                self.name()
                if self.tree() != "{":
                    self.need(";")
                return self.node("macro", a)
            if self.macro_path() and where != "stmt":
                if self.tree() != "{":
                    self.need(";")
                return self.node("macro", a)
            return None
        if k in ("crate", "self", "super", "::") and where != "stmt" and self.macro_path():
            if self.tree() != "{":
                self.need(";")
            return self.node("macro", a)
        if k == "use":
            self.i += 1
            self.use_tree()
            self.need(";")
            return self.node("use", a)
        if k == "mod":
            self.i += 1
            n = self.name()
            if self.eat(";"):
                return self.node("mod", a, [], n.v, {"attrs": attrs})
            self.need("{")
            kids = []
            self.items(kids, "}")
            self.need("}")
            return self.node("mod", a, kids, n.v, {"attrs": attrs})
        if k == "struct":
            return self.struct(a)
        if k == "enum":
            self.i += 1
            self.name()
            self.generics()
            self.where()
            self.need("{")
            while K[self.i] != "}":
                self.attributes()
                self.visibility()
                self.name()
                if K[self.i] == "{":
                    self.fields()
                elif K[self.i] == "(":
                    self.tuple_fields()
                if self.eat("="):
                    self.expr()
                if K[self.i] != "}":
                    self.need(",")
            self.i += 1
            return self.node("enum", a)
        if k == "type":
            self.i += 1
            self.name()
            self.generics()
            if self.eat(":"):
                self.bounds()
            self.where()
            if self.eat("="):
                self.type()
                self.where()
            elif where == "mod":
                self.fail("expected '='")
            self.need(";")
            return self.node("type", a)
        if k == "trait" or (k == "unsafe" and K[i + 1] in ("trait",)) or (k == "unsafe" and self.word("auto", i + 1)):
            self.eat("unsafe")
            if self.word("auto"):
                self.i += 1
            return self.trait(a)
        if k == "impl" or (k == "unsafe" and K[i + 1] == "impl"):
            self.eat("unsafe")
            return self.impl(a)
        if k == "extern" and K[i + 1] == "crate":
            self.i += 2
            if not self.eat("self"):
                self.name()
            if self.eat("as"):
                self.name()
            self.need(";")
            return self.node("use", a)
        if k in ("extern", "unsafe") and K[i + (k == "unsafe")] == "extern":
            j = i + (k == "unsafe") + 1
            if K[j] == "str":
                j += 1
            if K[j] == "{":
                self.i = j + 1
                kids = []
                self.items(kids, "}", lambda: self.item("trait"))
                self.need("}")
                return self.node("extern", a, kids)
        if k == "static" or (k == "const" and K[i + 1] in ("name", "mut") and not (K[i + 1] == "name" and K[i + 2] == "!")) or (k == "unsafe" and K[i + 1] == "static"):
            if k == "static" and K[i + 1] in ("|", "||", "move"):
                return None
            self.eat("unsafe")
            self.i += 1
            self.eat("mut")
            if not (K[self.i] == "name"):
                self.fail("expected a name")
            self.i += 1
            self.generics()
            if self.eat(":"):
                self.type()
            elif k == "static" or where != "trait":
                self.fail("expected ':'" if K[self.i] != "bad" else None)
            e = self.expr() if self.eat("=") else None
            if e is None and where == "mod":
                self.fail("expected '='" if K[self.i] != "bad" else None)
            self.need(";")
            return self.node("const", a, [e] if e else [])
        # functions, with any qualifiers
        j = i
        while K[j] in ("const", "async", "unsafe", "extern", "str"):
            if K[j] == "str" and K[j - 1] != "extern":
                return None
            j += 1
        if K[j] == "fn":
            self.i = j
            return self.fn(a, where, attrs)
        return None

    def macro_path(self):
        """Skip ``path !`` before a token tree; False and unmoved if there is none."""
        j, K = self.i, self.K
        if K[j] == "::":
            j += 1
        while K[j] in ("name", "crate", "self", "super", "Self"):
            j += 1
            if K[j] == "::":
                j += 1
                continue
            break
        if K[j] == "!" and K[j + 1] in ("(", "[", "{"):
            self.i = j + 1
            return True
        return False

    def use_tree(self):
        self.eat("::")
        while True:
            if self.eat("*"):
                return
            if self.eat("{"):
                while self.K[self.i] != "}":
                    self.use_tree()
                    if self.K[self.i] != "}":
                        self.need(",")
                self.i += 1
                return
            if self.K[self.i] not in ("name", "crate", "self", "super"):
                self.fail("expected a path" if self.K[self.i] != "bad" else None)
            self.i += 1
            if self.eat("as"):
                self.name()
                return
            if not self.eat("::"):
                return

    def struct(self, a):
        self.i += 1
        n = self.name()
        self.generics()
        self.where()
        if self.K[self.i] == "{":
            self.fields()
        elif self.K[self.i] == "(":
            self.tuple_fields()
            self.where()
            self.need(";")
        else:
            self.need(";")
        return self.node("struct", a, [], n.v)

    def fields(self):
        self.need("{")
        while self.K[self.i] != "}":
            self.attributes()
            self.visibility()
            self.name()
            self.need(":")
            self.type()
            if self.K[self.i] != "}":
                self.need(",")
        self.i += 1

    def tuple_fields(self):
        self.need("(")
        while self.K[self.i] != ")":
            self.attributes()
            self.visibility()
            self.type()
            if self.K[self.i] != ")":
                self.need(",")
        self.i += 1

    def trait(self, a):
        self.need("trait")
        n = self.name()
        self.generics()
        if self.eat(":"):
            self.bounds()
        self.where()
        if self.eat("="):
            self.bounds()
            self.need(";")
            return self.node("trait", a, [], n.v)
        self.need("{")
        kids = []
        self.items(kids, "}", lambda: self.item("trait"))
        self.need("}")
        return self.node("trait", a, kids, n.v)

    def impl(self, a):
        self.need("impl")
        if self.K[self.i] == "<" and self.K[self.i + 1] in ("life", "name", "const", ">", "#") and not (self.K[self.i + 1] == "name" and self.K[self.i + 2] in ("::",)):
            self.generics()
        self.eat("const")
        self.eat("!")
        b = self.S[self.i]
        self.type()
        name = self.src[b : self.E[self.i - 1]]
        if self.eat("for"):
            b = self.S[self.i]
            self.type()
            name = self.src[b : self.E[self.i - 1]]
        self.where()
        self.need("{")
        kids = []
        while self.K[self.i] == "#" and self.K[self.i + 1] == "!":
            self.i += 2
            self.tree()
        self.items(kids, "}", lambda: self.item("impl"))
        self.need("}")
        return self.node("impl", a, kids, name)

    def generics(self):
        if self.K[self.i] != "<":
            return
        self.i += 1
        while self.K[self.i] != ">":
            self.attributes()
            if self.eat("life"):
                if self.eat(":"):
                    while self.eat("life"):
                        self.eat("+")
            elif self.eat("const"):
                self.name()
                self.need(":")
                self.type()
                if self.eat("="):
                    self.const_arg()
            else:
                self.name()
                if self.eat(":"):
                    self.bounds()
                if self.eat("="):
                    self.type()
            if self.K[self.i] != ">" and not self.split(">"):
                self.need(",")
        self.i += 1

    def where(self):
        if not self.eat("where"):
            return
        while self.K[self.i] not in ("{", ";", "=", "eof"):
            if self.eat("life"):
                self.need(":")
                while self.eat("life"):
                    self.eat("+")
            else:
                self.for_life()
                self.type()
                self.need(":")
                self.bounds()
            if not self.eat(","):
                break

    def for_life(self):
        if self.K[self.i] == "for" and self.K[self.i + 1] == "<":
            self.i += 1
            self.generics()

    def bounds(self):
        while self.K[self.i] not in (",", ">", "{", ";", "=", ")", "]", ">>", ">=", "where", "eof", "|", "=>", ">>="):
            if self.eat("life"):
                pass
            else:
                par = self.eat("(")
                self.eat("?")
                self.eat("~")
                if self.eat("async") or self.eat("const"):
                    pass
                self.for_life()
                if self.K[self.i] == "use" and self.K[self.i + 1] == "<":
                    self.i += 1
                    self.generics()
                else:
                    self.type_path()
                if par:
                    self.need(")")
            if not self.eat_split("+"):
                break

    def fn(self, a, where, attrs):
        self.need("fn")
        n = self.name()
        self.generics()
        self.need("(")
        first = True
        while self.K[self.i] != ")":
            self.attributes()
            if self.eat("..."):
                break
            if first and self.self_param():
                pass
            else:
                if where == "trait" and False:
                    pass
                self.pattern_no_top()
                self.need(":")
                if not self.eat("..."):
                    self.type()
            first = False
            if self.K[self.i] != ")":
                self.need(",")
        self.need(")")
        if self.eat("->"):
            self.type()
        self.where()
        body = None
        if self.K[self.i] == "{":
            keep, self.no_struct = self.no_struct, False
            body = self.block()
            self.no_struct = keep
        elif where in ("trait", "impl", "mod") and self.K[self.i] == ";" and where == "trait":
            self.i += 1
        else:
            self.fail("expected '{'" if self.K[self.i] not in ("bad",) else None)
        return self.node("fn", a, [body] if body else [], n.v, {"name": n, "body": body, "attrs": attrs})

    def self_param(self):
        j, K = self.i, self.K
        if K[j] == "&":
            j += 1
            if K[j] == "life":
                j += 1
        if K[j] == "mut":
            j += 1
        if K[j] != "self" or K[j + 1] == "::":
            return False
        self.i = j + 1
        if self.eat(":"):
            self.type()
        return True

    # -- statements ------------------------------------------------------------------

    def block(self):
        a = self.S[self.i]
        self.need("{")
        kids = []
        keep, self.no_struct = self.no_struct, False
        self.items(kids, "}", self.statement)
        self.no_struct = keep
        self.need("}")
        return self.node("block", a, kids)

    def statement(self):
        K, i = self.K, self.i
        if (self.memo is not None or self.shapes is not None) and K[i] in ("name", "let", "return", "self", "*", "(", "str", "num", "break", "continue"):
            j, M = i, self.M
            while True:
                q = K[j]
                if q == ";" or q in ("}", "eof", "bad", ")", "]") or j - i > 400:
                    break
                if q in "([{":
                    j = M[j]
                    if j < 0:
                        break
                j += 1
            if j > i and K[j] == ";":
                key = self.key[i : j + 1]
                if self.shapes is not None:
                    if (calls := self.shapes.seen.get(key)) is not None:
                        self.i = j + 1
                        return Shapes.node(calls, self.S, self.E, i, j)
                    n, width = len(self.faults), len(K)
                    s = self.statement2()
                    if self.i == j + 1 and len(K) == width and len(self.faults) == n:
                        self.shapes.add(key, s, self.S, self.E, i, j)
                    return s
                if key in self.memo.seen:
                    self.i = j + 1
                    return None
                n, width = len(self.faults), len(K)
                s = self.statement2()
                # a split operator moves the tokens behind it
                if self.i == j + 1 + len(K) - width and len(self.faults) == n:
                    self.memo.add(key)
                return s
        return self.statement2()

    def statement2(self):
        K, a = self.K, self.S[self.i]
        if self.eat(";"):
            return None
        attrs = self.attributes()
        if attrs and K[self.i] == "}":
            return None
        k = K[self.i]
        if k == "let":
            return self.let(a)
        if k == "pub" or k in ("fn", "struct", "enum", "trait", "impl", "mod", "use", "static", "const", "type", "extern", "unsafe", "async") or (k == "name" and self.text() in ("macro_rules", "union", "auto")):
            save = self.i
            self.visibility()
            it = self.item_kind(a, "stmt", attrs)
            if it is not None:
                return it
            self.i = save
            if k == "pub":
                self.fail("expected an item")
        e = self.expr(stmt=True)
        if self.eat(";"):
            return self.node("expr", a, [e])
        if K[self.i] == "}" or e.t in _BLOCKY:
            return e
        self.fail("expected ';'" if K[self.i] not in ("bad", "eof") else None)

    def let(self, a):
        self.need("let")
        self.pattern()
        if self.eat(":"):
            self.type()
        kids = []
        if self.eat("="):
            kids.append(self.expr())
            if self.eat("else"):
                kids.append(self.block())
        self.need(";")
        return self.node("let", a, kids)

    # -- expressions -----------------------------------------------------------------

    def expr(self, stmt=False, no_struct=None):
        keep = self.no_struct
        if no_struct is not None:
            self.no_struct = no_struct
        e = self.assignment(stmt)
        self.no_struct = keep
        return e

    def assignment(self, stmt=False):
        a = self.S[self.i]
        left = self.range(stmt)
        if stmt and left.t in _BLOCKY and self.blocky_end:
            return left
        k = self.K[self.i]
        if k in ASSIGN:
            self.i += 1
            right = self.assignment()
            return self.node("assign", a, [left, right], k)
        return left

    blocky_end = False

    def range(self, stmt=False):
        K, a = self.K, self.S[self.i]
        if K[self.i] in ("..", "..="):
            self.i += 1
            if K[self.i] in (")", "]", "}", ";", ",", "=>", "eof") or (K[self.i] == "{" and self.no_struct):
                return self.node("range", a)
            return self.node("range", a, [self.binary(0)])
        left = self.binary(0, stmt)
        if stmt and self.blocky_end and left.t in _BLOCKY:
            return left
        if K[self.i] in ("..", "..="):
            inc = K[self.i] == "..="
            self.i += 1
            if K[self.i] in (")", "]", "}", ";", ",", "=>", "eof") or (K[self.i] == "{" and self.no_struct):
                if inc:
                    self.fail("'..=' without an end", self.i - 1)
                return self.node("range", a, [left])
            return self.node("range", a, [left, self.binary(0)])
        return left

    def binary(self, least, stmt=False):
        a = self.S[self.i]
        left = self.unary(stmt)
        if stmt and left.t in _BLOCKY and self.blocky_end:
            return left
        compared = False
        while True:
            k = self.K[self.i]
            if k == "as":
                self.i += 1
                self.type_no_bounds()
                left = self.node("cast", a, [left])
                continue
            p = BINARY.get(k)
            if p is None or p <= least:
                return left
            if p == 5:
                if compared:
                    self.fail("comparisons cannot be chained")
                compared = True
            self.i += 1
            if k in ("&&", "||") and self.K[self.i] == "let":
                right = self.let_cond()
            else:
                right = self.binary(p)
            left = self.node("binary", a, [left, right], k)

    def let_cond(self):
        a = self.S[self.i]
        self.need("let")
        b = self.S[self.i]
        self.pattern()
        pat = self.src[b : self.E[self.i - 1]]
        self.need("=")
        v = self.binary(4)
        return self.node("letcond", a, [v], pat, {"value": v})

    def unary(self, stmt=False):
        k, a = self.K[self.i], self.S[self.i]
        if k in ("-", "*", "!"):
            self.i += 1
            return self.node("unary", a, [self.unary()])
        if k in ("&", "&&"):
            self.i += 1
            if self.word("raw") and self.K[self.i + 1] in ("const", "mut"):
                self.i += 2
            else:
                self.eat("mut")
            return self.node("unary", a, [self.unary()])
        return self.postfix(self.primary(), a, stmt)

    def postfix(self, e, a, stmt):
        K = self.K
        self.blocky_end = False
        if stmt and e.t in _BLOCKY:
            if K[self.i] not in (".", "?"):
                self.blocky_end = True
                return e
        while True:
            k = K[self.i]
            if k == "?":
                self.i += 1
                e = self.node("try", a, [e])
            elif k == ".":
                self.i += 1
                q = K[self.i]
                if q == "await":
                    self.i += 1
                    e = self.node("await", a, [e])
                elif q == "num":
                    self.i += 1
                    e = self.node("field", a, [e])
                elif q == "name":
                    n = self.name()
                    b = self.E[self.i - 1]
                    if K[self.i] == "::":
                        self.i += 1
                        if K[self.i] != "<":
                            self.fail("expected '<'")
                        self.generic_args()
                    if K[self.i] == "(":
                        args = self.args()
                        callee = Node("field", a, b, [e], n.v, {"object": e})
                        e = self.node("call", a, [callee] + args, None, {"callee": callee, "args": args})
                    else:
                        e = self.node("field", a, [e], n.v, {"object": e})
                else:
                    self.fail("expected a name after '.'" if q != "bad" else None)
            elif k == "(":
                args = self.args()
                e = self.node("call", a, [e] + args, None, {"callee": e, "args": args})
            elif k == "[":
                self.i += 1
                x = self.expr(no_struct=False)
                self.need("]")
                e = self.node("index", a, [e, x])
            else:
                return e

    def args(self):
        self.need("(")
        kids = []
        while self.K[self.i] != ")":
            self.attributes()
            kids.append(self.expr(no_struct=False))
            if self.K[self.i] != ")":
                self.need(",")
        self.i += 1
        return kids

    def condition(self):
        a = self.S[self.i]
        keep, self.no_struct = self.no_struct, True
        if self.K[self.i] == "let":
            e = self.let_cond()
            while self.K[self.i] in ("&&", "||"):
                op = self.K[self.i]
                self.i += 1
                r = self.let_cond() if self.K[self.i] == "let" else self.binary(4)
                e = self.node("binary", a, [e, r], op)
        else:
            e = self.expr()
        self.no_struct = keep
        return e

    def if_(self, a):
        self.need("if")
        c = self.condition()
        then = self.block()
        other = None
        if self.eat("else"):
            if self.K[self.i] == "if":
                other = self.if_(self.S[self.i])
            else:
                other = self.block()
        return self.node("if", a, [x for x in (c, then, other) if x], self.src[c.s : c.e], {"cond": c, "then": then, "else": other})

    def primary(self):
        K, i, a = self.K, self.i, self.S[self.i]
        k = K[i]
        if k in ("num", "str", "char", "true", "false"):
            self.i += 1
            return Node(k, a, self.E[i])
        if k == "(":
            self.i += 1
            if self.eat(")"):
                return self.node("tuple", a)
            self.attributes()
            kids = [self.expr(no_struct=False)]
            if self.eat(")"):
                return self.node("paren", a, kids)
            while self.eat(","):
                if K[self.i] == ")":
                    break
                kids.append(self.expr(no_struct=False))
            self.need(")")
            return self.node("tuple", a, kids)
        if k == "[":
            self.i += 1
            kids = []
            while K[self.i] != "]":
                self.attributes()
                kids.append(self.expr(no_struct=False))
                if self.eat(";"):
                    if len(kids) != 1:
                        self.fail("expected ','", self.i - 1)
                    kids.append(self.expr(no_struct=False))
                    break
                if K[self.i] != "]":
                    self.need(",")
            self.need("]")
            return self.node("array", a, kids)
        if k == "{":
            return self.block()
        if k == "if":
            return self.if_(a)
        if k == "match":
            return self.match(a)
        if k == "loop":
            self.i += 1
            return self.node("loop", a, [self.block()])
        if k == "while":
            self.i += 1
            c = self.condition()
            return self.node("while", a, [c, self.block()])
        if k == "for":
            if K[i + 1] == "<":
                self.for_life()
                return self.closure(self.S[self.i])
            self.i += 1
            self.pattern()
            self.need("in")
            e = self.expr(no_struct=True)
            return self.node("for", a, [e, self.block()])
        if k == "unsafe":
            self.i += 1
            b = self.block()
            return Node("block", a, b.e, b.k)
        if k == "const" and K[i + 1] == "{":
            self.i += 1
            return self.block()
        if k == "async":
            self.i += 1
            if K[self.i] in ("|", "||") or (K[self.i] == "move" and K[self.i + 1] in ("|", "||")):
                return self.closure(a)
            self.eat("move")
            return self.block()
        if k in ("|", "||", "move", "static"):
            return self.closure(a)
        if k == "life":
            self.i += 1
            self.need(":")
            q = K[self.i]
            if q not in ("loop", "while", "for", "{"):
                self.fail("expected a loop")
            return self.primary()
        if k in ("return", "break"):
            self.i += 1
            if k == "break":
                self.eat("life")
            kids = []
            if K[self.i] not in (")", "]", "}", ";", ",", "=>", "eof") and not (K[self.i] == "{" and self.no_struct):
                kids.append(self.expr())
            return self.node(k, a, kids)
        if k == "continue":
            self.i += 1
            self.eat("life")
            return self.node(k, a)
        if k == "let":
            return self.let_cond()
        if k in ("name", "self", "Self", "crate", "super", "::", "<"):
            if k != "<" and self.macro_path():
                o = self.tree()
                return self.node("macro{" if o == "{" else "macro", a)
            return self.path_expr(a)
        if k == "<<" and self.split("<"):
            return self.path_expr(a)
        self.fail()

    def path_expr(self, a):
        self.path(expr=True)
        e = self.node("path", a, (), self.src[a : self.E[self.i - 1]])
        if self.K[self.i] == "{" and not self.no_struct:
            return self.struct_lit(a, e)
        return e

    def struct_lit(self, a, path):
        self.need("{")
        kids = []
        while self.K[self.i] != "}":
            self.attributes()
            if self.eat(".."):
                if self.K[self.i] != "}":
                    kids.append(self.expr(no_struct=False))
                break
            if self.K[self.i] == "num":
                self.i += 1
                self.need(":")
                kids.append(self.expr(no_struct=False))
            else:
                n = self.name()
                if self.eat(":"):
                    kids.append(self.expr(no_struct=False))
                else:
                    kids.append(Node("path", n.s, n.e, (), n.v))
            if self.K[self.i] != "}":
                self.need(",")
        self.need("}")
        return self.node("struct_lit", a, kids)

    def closure(self, a):
        self.eat("static")
        self.eat("async")
        self.eat("move")
        if not self.eat("||"):
            self.need("|")
            while self.K[self.i] != "|":
                self.attributes()
                self.pattern_no_top()
                if self.eat(":"):
                    self.type()
                if self.K[self.i] != "|" and not self.split("|"):
                    self.need(",")
            self.i += 1
        if self.eat("->"):
            self.type()
            return self.node("closure", a, [self.block()])
        e = self.expr()
        return self.node("closure", a, [e])

    def match(self, a):
        self.need("match")
        subject = self.expr(no_struct=True)
        self.need("{")
        self.attributes()
        kids = [subject]
        while self.K[self.i] != "}":
            self.attributes()
            b = self.S[self.i]
            self.pattern()
            pat = self.src[b : self.E[self.i - 1]]
            guard = None
            if self.eat("if"):
                guard = self.expr(no_struct=False) if self.K[self.i] != "let" else self.condition()
            self.need("=>")
            body = self.expr(stmt=True, no_struct=False)
            kids.append(self.node("arm", b, [x for x in (guard, body) if x], pat))
            if not self.eat(","):
                if self.K[self.i] == "}":
                    break
                if body.t not in _BLOCKY:
                    self.fail("expected ','" if self.K[self.i] not in ("bad", "eof") else None)
        self.need("}")
        return self.node("match", a, kids)

    # -- patterns ------------------------------------------------------------------------

    def pattern(self):
        self.eat("|")
        self.pattern_no_top()
        while self.eat("|"):
            self.pattern_no_top()

    def pattern_no_top(self):
        K = self.K
        k = K[self.i]
        if k in ("num", "str", "char", "true", "false", "-"):
            self.literal_pat()
            self.range_tail()
            return
        if k in ("..", "..="):
            self.i += 1
            if K[self.i] in ("num", "char", "-", "name", "Self", "crate", "self"):
                self.literal_pat()
            return
        if k in ("&", "&&"):
            self.i += 1
            self.eat("mut")
            return self.pattern_no_top()
        if k == "(":
            return self.seq_pat(")")
        if k == "[":
            return self.seq_pat("]")
        if k in ("ref", "mut"):
            self.eat("ref")
            self.eat("mut")
            if K[self.i] == "self":
                self.i += 1
            else:
                self.name()
            if self.eat("@"):
                self.pattern_no_top()
            return
        if k == "const" and K[self.i + 1] == "{":
            self.i += 1
            self.block()
            return
        if k in ("name", "self", "Self", "crate", "super", "::", "<"):
            if k != "<" and self.macro_path():
                self.tree()
                return
            if k == "name" and K[self.i + 1] == "@":
                self.i += 2
                return self.pattern_no_top()
            self.path(expr=True)
            if K[self.i] == "(":
                return self.seq_pat(")")
            if K[self.i] == "{":
                self.i += 1
                while K[self.i] != "}":
                    self.attributes()
                    if self.eat(".."):
                        break
                    if K[self.i] == "num":
                        self.i += 1
                        self.need(":")
                        self.pattern()
                    else:
                        self.eat("box")
                        self.eat("ref")
                        self.eat("mut")
                        self.name()
                        if self.eat(":"):
                            self.pattern()
                    if K[self.i] != "}":
                        self.need(",")
                self.need("}")
                return
            self.range_tail()
            return
        self.fail("expected a pattern" if k not in ("bad", "eof") else None)

    def literal_pat(self):
        self.eat("-")
        if self.K[self.i] in ("num", "str", "char", "true", "false"):
            self.i += 1
        else:
            self.path(expr=True)

    def range_tail(self):
        if self.K[self.i] in ("..", "..=", "..."):
            open_ok = self.K[self.i] == ".."
            self.i += 1
            if self.K[self.i] in ("num", "char", "-", "name", "Self", "crate", "self", "str"):
                self.literal_pat()
            elif not open_ok:
                self.fail("expected the end of the range")

    def seq_pat(self, end):
        self.i += 1
        while self.K[self.i] != end:
            self.attributes()
            if self.K[self.i] == ".." and self.K[self.i + 1] in (",", end):
                self.i += 1
            else:
                self.pattern()
            if self.K[self.i] != end:
                self.need(",")
        self.i += 1

    # -- paths and types -------------------------------------------------------------------

    def path(self, expr=False):
        K = self.K
        if K[self.i] == "<":
            self.i += 1
            self.type()
            if self.eat("as"):
                self.type_path()
            self.need(">")
            if K[self.i] != "::":
                self.fail("expected '::'")
        self.eat("::")
        while True:
            if K[self.i] not in ("name", "self", "Self", "crate", "super"):
                self.fail("expected a path" if K[self.i] not in ("bad", "eof") else None)
            self.i += 1
            if not expr:
                if K[self.i] == "<" or (K[self.i] == "<<" and self.split("<")):
                    self.generic_args()
                elif K[self.i] == "(" and self.text(self.i - 1) in ("Fn", "FnMut", "FnOnce", "AsyncFn", "AsyncFnMut", "AsyncFnOnce"):
                    self.fn_args()
            if K[self.i] == "::":
                if K[self.i + 1] == "<" or (K[self.i + 1] == "<<"):
                    self.i += 1
                    if K[self.i] == "<<":
                        self.split("<")
                    self.generic_args()
                    if K[self.i] != "::":
                        return
                self.i += 1
                continue
            return

    def fn_args(self):
        self.need("(")
        while self.K[self.i] != ")":
            self.type()
            if self.K[self.i] != ")":
                self.need(",")
        self.i += 1
        if self.eat("->"):
            self.type_no_bounds()

    def generic_args(self):
        K = self.K
        self.need("<")
        while not (K[self.i] == ">" or (K[self.i] in (">>", ">=", ">>=") and self.split(">"))):
            if self.eat("life"):
                pass
            elif K[self.i] in ("num", "str", "char", "true", "false", "-", "{"):
                self.const_arg()
            elif K[self.i] == "name" and K[self.i + 1] == "=":
                self.i += 2
                if K[self.i] in ("num", "str", "char", "true", "false", "-", "{"):
                    self.const_arg()
                else:
                    self.type()
            elif K[self.i] == "name" and K[self.i + 1] == ":":
                self.i += 2
                self.bounds()
            else:
                self.type()
                if self.eat("="):
                    self.type()
                elif self.eat(":"):
                    self.bounds()
            if not (K[self.i] == ">" or (K[self.i] in (">>", ">=", ">>=") and self.split(">"))):
                self.need(",")
        self.i += 1

    def const_arg(self):
        if self.K[self.i] == "{":
            self.block()
        else:
            self.eat("-")
            if self.K[self.i] == "name":
                self.path()
            elif self.K[self.i] in ("num", "str", "char", "true", "false"):
                self.i += 1
            else:
                self.fail()

    def type_path(self):
        if self.K[self.i] not in ("name", "self", "Self", "crate", "super", "::", "<", "<<"):
            self.fail("expected a path" if self.K[self.i] not in ("bad", "eof") else None)
        self.path()

    def type(self):
        self.type_no_bounds(True)

    def type_no_bounds(self, plus=False):
        K = self.K
        k = K[self.i]
        if k in ("&", "&&"):
            self.i += 1
            self.eat("life")
            self.eat("mut")
            self.type_no_bounds()
        elif k == "*":
            self.i += 1
            if not (self.eat("const") or self.eat("mut")):
                self.fail("expected 'const' or 'mut'")
            self.type_no_bounds()
        elif k == "(":
            self.i += 1
            while K[self.i] != ")":
                self.type()
                if K[self.i] != ")":
                    self.need(",")
            self.i += 1
        elif k == "[":
            self.i += 1
            self.type()
            if self.eat(";"):
                self.expr(no_struct=False)
            self.need("]")
        elif k == "!":
            self.i += 1
        elif k in ("impl", "dyn"):
            self.i += 1
            self.bounds()
        elif k == "name" and self.text() == "_":
            self.i += 1
        elif k in ("fn", "unsafe", "extern") or (k == "for" and K[self.i + 1] == "<"):
            self.for_life()
            if K[self.i] not in ("fn", "unsafe", "extern"):
                self.type_path()
            else:
                self.eat("unsafe")
                if self.eat("extern"):
                    self.eat("str")
                self.need("fn")
                self.need("(")
                while K[self.i] != ")":
                    self.attributes()
                    if self.eat("..."):
                        break
                    if K[self.i] in ("name",) and K[self.i + 1] == ":":
                        self.i += 2
                    self.type()
                    if K[self.i] != ")":
                        self.need(",")
                self.need(")")
                if self.eat("->"):
                    self.type_no_bounds()
        elif k != "<" and self.macro_path():
            self.tree()
        elif k in ("name", "self", "Self", "crate", "super", "::", "<", "<<"):
            if k == "<<":
                self.split("<")
            self.path()
            if plus and K[self.i] == "+":
                self.i += 1
                self.bounds()
        else:
            self.fail("expected a type" if k not in ("bad", "eof") else None)


def parse(src: str, memo: bool = False, calls: bool = False) -> Parsed:
    return RsParser(src, memo, calls).program()
