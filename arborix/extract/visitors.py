"""Functions, calls, branch conditions and function references of a parsed file.

One walk goes down each tree with the conditions that hold at a place as its argument; what a language calls a function, a branch and a
reference is told by a small class per language.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field
from itertools import accumulate

from . import js_parser, py_parser, rs_parser, svelte_parser
from .base import Node


@dataclass
class Function:
    """A function of a file; call_sites: (callee, conditions) in source order; reference_sites: (target, context), distinct."""

    name: str
    qualified_name: str
    is_test: bool
    line: int
    end_line: int
    call_sites: list = field(default_factory=list)
    reference_sites: list = field(default_factory=list)


class Visitor:
    """What all languages share. ``strict``: keep the reading of elif chains and of Svelte line numbers that existing indexes have."""

    #: Node kinds of calls, and of expressions that name something.
    calls = frozenset(["call"])
    names = frozenset(["id"])
    #: Node kinds below which other conditions hold.
    branching = frozenset()

    def __init__(self, src: str, module: str, file_is_test: bool, include_tests: bool, strict: bool = True, with_references: bool = True):
        self.src, self.module, self.file_is_test, self.include_tests, self.strict, self.with_references = src, module, file_is_test, include_tests, strict, with_references
        self.out: list[Function] = []
        # the offset of each line break
        self.breaks = [*accumulate(map(len, src.split("\n")[:-1]), lambda a, n: a + n + 1)]

    def line(self, at: int) -> int:
        return bisect_left(self.breaks, at) + 1

    def qualified(self, scopes: list[str], name: str) -> str:
        return "::".join(x for x in [self.module, *scopes, name] if x)

    def emit(self, name: str, scopes: list[str], node: Node, body: Node | None, is_test: bool) -> None:
        f = Function(name, self.qualified(scopes, name), is_test, self.line(node.s), self.line(max(node.s, node.e - 1)))
        if body is not None:
            self.body(body, f)
        self.out.append(f)

    def body(self, body: Node, f: Function) -> None:
        self.walk(body, [], f.call_sites, f.reference_sites, body)

    # -- sites ---------------------------------------------------------------------

    def skip(self, node: Node, parent: Node | None) -> bool:
        """Whether a node is another function's or scope's business."""
        return False

    def resets(self, node: Node) -> bool:
        """Whether conditions outside a node do not count inside it."""
        return False

    def branches(self, node: Node, conds: list[str]):
        """(child, conditions) of every child."""
        return [(k, conds) for k in node.k]

    def callee(self, node: Node) -> str:
        return self.src[node.s : node.e].strip()

    def call_parts(self, node: Node) -> tuple[Node, list[Node]]:
        return node.f["callee"], node.f["args"]

    def walk(self, node: Node, conds: list[str], calls: list, refs: list, parent: Node | None) -> None:
        stack = [(node, conds, parent)]
        while stack:
            n, c, up = stack.pop()
            if n is None or (n is not node and self.skip(n, up)):
                continue
            if self.resets(n):
                c = []
            if n.t in self.calls:
                callee, args = self.call_parts(n)
                name = self.callee(callee)
                if name:
                    calls.append((name, list(c)))
                if self.with_references:
                    for a in args:
                        self.references(a, name, refs, n)
            # a node without children has no calls in it, unless it is one itself
            if n.t in self.branching:
                stack.extend([(k, kc, n) for k, kc in reversed(self.branches(n, c)) if k is not None and (k.k or k.f)])
            else:
                for k in reversed(n.k):
                    if k is not None and (k.k or k.f):
                        stack.append((k, c, n))

    def reference_name(self, node: Node) -> str | None:
        return self.src[node.s : node.e].strip() if node.t in self.names else None

    def references(self, node: Node, callee: str, refs: list, parent: Node | None) -> None:
        """Names found in an argument; a nested call contributes its own arguments only."""
        if node is None or self.skip(node, parent):
            return
        if node.t in self.calls:
            inner, args = self.call_parts(node)
            name = self.callee(inner)
            for a in args:
                self.references(a, name, refs, node)
            return
        target = self.reference_name(node)
        if target:
            site = (target, f"passed to {callee}" if callee else None)
            if site not in refs:
                refs.append(site)
            return
        for k in self.reference_children(node):
            self.references(k, callee, refs, node)

    def reference_children(self, node: Node):
        return node.k


class PythonVisitor(Visitor):
    names = frozenset(["id", "attr"])
    branching = frozenset(["if"])
    _scopes = frozenset(["def", "class", "decorated", "lambda"])

    def run(self, tree: Node) -> list[Function]:
        self.collect(tree, [])
        return self.out

    def collect(self, node: Node, scopes: list[str]) -> None:
        if node.t == "def" and node.v:
            is_test = self.file_is_test or node.v.startswith("test_")
            if is_test and not self.include_tests:
                return
            for k in node.f["body"].k:
                self.collect(k, [*scopes, node.v])
            self.emit(node.v, scopes, node, node.f["body"], is_test)
            return
        inner = [*scopes, node.v] if node.t == "class" and node.v else scopes
        for k in node.k:
            if k is not None and (k.k or k.f):
                self.collect(k, inner)

    def skip(self, node, parent):
        return node.t in self._scopes

    def callee(self, node):
        return self.src[node.s : node.e].strip()

    def branches(self, node, conds):
        if node.t != "if":
            return [(k, conds) for k in node.k]
        text = node.v or ""
        own = [*conds, text] if text else conds
        no = [*conds, f"!({text})"] if text else conds
        out = [(node.f["cond"], own), (node.f["then"], own)]
        for i, alt in enumerate(node.f["alts"]):
            # only the first alternative is read as the other branch of the condition, unless told otherwise
            here = no if i == 0 or not self.strict else own
            if alt.t == "elif":
                mine = [*here, alt.v] if alt.v else here
                out += [(alt.f["cond"], mine), (alt.f["then"], mine)]
                if not self.strict:
                    no = [*no, f"!({alt.v})"]
            else:
                out += [(k, here) for k in alt.k]
        return [(k, c) for k, c in out if k is not None]


class JsVisitor(Visitor):
    names = frozenset(["id", "member"])
    branching = frozenset(["if", "case"])
    _values = frozenset(["function", "arrow"])
    _bounds = frozenset(["function", "arrow", "method"])

    def __init__(self, *a, **k):
        super().__init__(*a, **k)
        self.declared: set[int] = set()

    def run(self, tree: Node) -> list[Function]:
        self.collect(tree, [], None)
        return self.out

    def named(self, name: str, node: Node, fn: Node, scopes: list[str]) -> None:
        body = fn.f["body"]
        is_test = self.file_is_test or name.startswith("test_")
        if body is None or (is_test and not self.include_tests):
            return
        for k in body.k:
            self.collect(k, [*scopes, name], body)
        self.emit(name, scopes, node, body, is_test)

    def collect(self, node: Node, scopes: list[str], parent: Node | None) -> None:
        if node is None:
            return
        t = node.t
        if t == "class" and node.v and self.is_declaration(parent):
            for k in node.k:
                self.collect(k, [*scopes, node.v], node)
            return
        if t == "function" and node.v and self.is_declaration(parent):
            self.named(node.v, node, node, scopes)
            return
        if t == "method" and node.v:
            self.named(node.v, node, node, scopes)
            return
        if t == "declarator" and node.f["id"].t == "id" and node.f["init"] is not None:
            v = node.f["init"]
            if v.t in self._values:
                self.named(node.f["id"].v, node, v, scopes)
                return
            if v.t == "object":
                for k in v.k:
                    self.collect(k, [*scopes, node.f["id"].v], v)
                return
        if t == "property" and node.f and node.v:
            v = node.f["value"]
            if v.t in self._values:
                self.named(node.v, node, v, scopes)
                return
            if v.t == "object":
                for k in v.k:
                    self.collect(k, [*scopes, node.v], v)
                return
        for k in node.k:
            if k is not None and (k.k or k.f):
                self.collect(k, scopes, node)

    @staticmethod
    def is_declaration(parent: Node | None) -> bool:
        return parent is None or parent.t in ("program", "block", "export", "case", "namespace", "label", "if", "while", "for", "do", "decorated")

    def skip(self, node, parent):
        if node.t in ("class", "function") and self.is_declaration(parent):
            return True
        if node.t == "method":
            return True
        return node.t in self._values and parent is not None and parent.t in ("declarator", "property")

    def resets(self, node):
        return node.t in self._bounds

    def branches(self, node, conds):
        if node.t == "if":
            text = node.v or ""
            yes = [*conds, text] if text else conds
            no = [*conds, f"!({text})"] if text else conds
            return [(k, c) for k, c in ((node.f["cond"], yes), (node.f["then"], yes), (node.f["else"], no)) if k is not None]
        if node.t == "case":
            return [(k, [*conds, node.v if node.v is not None else "default"]) for k in node.k]
        return [(k, conds) for k in node.k]

    def reference_children(self, node):
        if node.t == "property" and node.f and node.f["name"].t == "id" and node.f["name"] is not node.f["value"]:
            return [node.f["name"], *node.k] if node.f["value"] is not node.f["name"] and node.f["name"].s != node.f["value"].s else node.k[1:]
        return node.k


class RustVisitor(Visitor):
    names = frozenset(["path"])
    branching = frozenset(["if", "arm"])

    def run(self, tree: Node) -> list[Function]:
        self.collect(tree, [], False)
        return self.out

    def collect(self, node: Node, scopes: list[str], in_test: bool) -> None:
        if node.t == "mod" and "cfg(test)" in (node.f["attrs"] or ""):
            if not self.include_tests:
                return
            in_test = True
        if node.t == "fn":
            is_test = self.file_is_test or in_test or self.marked_test(node.f["attrs"])
            if is_test and not self.include_tests:
                return
            self.emit(node.v, scopes, self.from_fn(node), node.f["body"], is_test)
            return
        inner = [*scopes, node.v] if node.t == "impl" and node.v else scopes
        for k in node.k:
            if k is not None and (k.k or k.f):
                self.collect(k, inner, in_test)

    def from_fn(self, node: Node) -> Node:
        """The function without its attributes, which come before it in the text."""
        attrs = node.f["attrs"] or ""
        if not attrs:
            return node
        at = node.s + len(attrs)
        while at < node.e and self.src[at].isspace():
            at += 1
        return Node(node.t, at, node.e, node.k, node.v, node.f)

    @staticmethod
    def marked_test(attrs: str) -> bool:
        for a in re.findall(r"#\s*\[((?:[^\[\]]|\[[^\]]*\])*)\]", attrs or ""):
            c = "".join(a.split())
            if c == "test" or c.startswith("test(") or c.endswith("::test") or "::test(" in c or "cfg(test)" in c:
                return True
        return False

    def skip(self, node, parent):
        return node.t == "fn"

    def callee(self, node):
        return re.sub(r"::<(?:[^<>]|<[^<>]*>)*>$", "", self.src[node.s : node.e].strip())

    def reference_name(self, node):
        if node.t != "path":
            return None
        name = self.callee(node)
        return None if name in ("self", "Self", "super", "crate") else name

    def condition(self, node: Node) -> str:
        """The text of an if's condition; ``let P = v`` reads ``v is P``."""
        c = node.f["cond"]
        if c.t == "letcond":
            v = c.f["value"]
            return f"{self.src[v.s : v.e].strip()} is {c.v.strip()}"
        return self.src[c.s : c.e].strip()

    def branches(self, node, conds):
        if node.t == "if":
            text = self.condition(node)
            yes = [*conds, text] if text else conds
            no = [*conds, f"!({text})"] if text else conds
            return [(k, c) for k, c in ((node.f["cond"], yes), (node.f["then"], yes), (node.f["else"], no)) if k is not None]
        if node.t == "arm":
            pattern = self.src[node.s : node.k[0].e].strip() if len(node.k) == 2 else (node.v or "").strip()
            return [(k, [*conds, pattern] if pattern and pattern != "_" else conds) for k in node.k]
        return [(k, conds) for k in node.k]


def module_of(path: str, language: str) -> str:
    """The module a path stands for (the same rule as ``functions.paths.module_name``, for one file)."""
    parts = path.split("/")
    name = parts[-1]
    dot = name.rfind(".")
    stem = name[:dot] if dot > 0 else name
    folder = (language == "rust" and stem in ("mod", "lib", "main")) or (language == "python" and stem == "__init__") or (language in ("javascript", "jsx", "typescript", "tsx") and stem == "index")
    return (parts[-2] if len(parts) > 1 else "") if folder else stem


def extract(src: str, path: str, language: str, file_is_test: bool, include_tests: bool, strict: bool = True, references: bool = True) -> tuple[list[Function], list[tuple[int, str]]]:
    """(functions in order of emission, faults) of one file; without ``references`` their reference sites stay empty.

    Statements of a known shape are then not parsed again, and faults within f-strings are not looked for.
    """
    args = (module_of(path, language), file_is_test, include_tests, strict, references)
    if language == "python":
        p = py_parser.parse(src, calls=not references)
        return PythonVisitor(src, *args).run(p.tree), p.faults
    if language == "rust":
        p = rs_parser.parse(src, calls=not references)
        return RustVisitor(src, *args).run(p.tree), p.faults
    if language == "svelte":
        return _svelte(src, args)
    p = js_parser.parse(src, jsx=language in ("jsx", "tsx"), typed=language in ("typescript", "tsx"), calls=not references)
    return JsVisitor(src, *args).run(p.tree), p.faults


def _svelte(src: str, args: tuple) -> tuple[list[Function], list[tuple[int, str]]]:
    sp = svelte_parser.SvelteParser(src)
    out = sp.program()
    module, file_is_test, include_tests, strict, references = args
    functions: list[Function] = []
    for at, body, tree in sp.scripts:
        v = JsVisitor(body, *args)
        row = src.count("\n", 0, at)
        # lines are counted from the first line of code, and blank lines before it do not count, unless told otherwise
        lead = body[: len(body) - len(body.lstrip())].count("\n") if strict else 0
        for f in v.run(tree):
            f.line += row - lead
            f.end_line += row - lead
            functions.append(f)
    template = Function("template", "::".join(x for x in (module, "template") if x), file_is_test, 0, 0)
    lines = []
    for a, b, node in sorted(sp.expressions, key=lambda x: x[:2]):
        lines += [src.count("\n", 0, a) + 1, src.count("\n", 0, b) + 1]
        if node is None or node.t == "simple":
            continue
        text = src[a:b]
        # references tell whether there is a template function, so they are always looked for here
        v = JsVisitor(text, *args[:4])
        calls: list = []
        refs: list = []
        v.walk(node, [], calls, refs, None)
        template.call_sites += [c for c in calls if c not in template.call_sites]
        template.reference_sites += [r for r in refs if r not in template.reference_sites]
    if lines and (template.call_sites or template.reference_sites) and (include_tests or not file_is_test):
        template.line, template.end_line = min(lines), max(lines)
        if not references:
            template.reference_sites = []
        functions.append(template)
    return functions, out.faults
