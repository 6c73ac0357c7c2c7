"""Functions, calls, conditions and references of small files in every language; parsers and lexers."""

import ast

import pytest

from arborix.extract import js_parser, py_fast, py_lexer, py_parser, rs_fast, rs_lexer, rs_parser, svelte_parser
from arborix.extract.visitors import extract


def by_name(src, path, language, include_tests=True, is_test=False):
    return {f.name: f for f in extract(src, path, language, is_test, include_tests)[0]}


ROUTES = """fn main() {
    router();
    register_handler(validate_body);
}

fn router() {
    if method == "POST" {
        validate_body();
    } else {
        handle();
    }
}

fn validate_body() {}
fn register_handler(f: fn()) {}
fn handle() {}
"""


def test_rust():
    f = by_name(ROUTES, "src/main.rs", "rust")
    assert {n: x.line for n, x in f.items()} == {"main": 1, "router": 6, "validate_body": 14, "register_handler": 15, "handle": 16}
    assert f["router"].qualified_name == "src::router" and f["router"].end_line == 12
    assert f["router"].call_sites == [("validate_body", ['method == "POST"']), ("handle", ['!(method == "POST")'])]
    assert f["main"].reference_sites == [("validate_body", "passed to register_handler")]
    src = "impl Foo { #[tokio::test]\n fn t() { a::b::<u8>(c); }\n fn new() { match x { Some(v) => go(v), _ => stop() } if let Some(q) = f() { g() } } }\n#[cfg(test)]\nmod tests { fn helper() {} }\n"
    f = by_name(src, "lib/x.rs", "rust")
    assert f["t"].is_test and f["t"].qualified_name == "x::Foo::t" and f["t"].line == 2 and f["t"].call_sites == [("a::b", [])]
    assert f["new"].call_sites == [("go", ["Some(v)"]), ("stop", []), ("f", ["f() is Some(q)"]), ("g", ["f() is Some(q)"])]
    assert f["helper"].is_test
    assert set(by_name(src, "lib/x.rs", "rust", include_tests=False)) == {"new"}


def test_python():
    src = "class K:\n    @dec\n    def m(self):\n        if a:\n            self.f(x, k=y.z)\n        elif b:\n            g()\n        else:\n            h()\n        def inner():\n            deep()\n\ndef test_k():\n    K()\n"
    fs, _ = extract(src, "pkg/__init__.py", "python", False, True)
    assert [f.name for f in fs] == ["inner", "m", "test_k"]  # inner functions come first
    f = {x.name: x for x in fs}
    assert f["m"].qualified_name == "pkg::K::m" and f["m"].line == 3
    assert f["m"].call_sites == [("self.f", ["a"]), ("g", ["!(a)", "b"]), ("h", ["a"])]
    assert f["m"].reference_sites == [("x", "passed to self.f"), ("k", "passed to self.f"), ("y.z", "passed to self.f")]
    assert f["inner"].call_sites == [("deep", [])] and f["test_k"].is_test
    lax = {x.name: x for x in extract(src, "p.py", "python", False, True, strict=False)[0]}
    assert lax["m"].call_sites[-1] == ("h", ["!(a)", "!(b)"])


def test_javascript_family():
    src = "export const Button = () => { submitForm(x); return <div onClick={() => save(z)}>{label(1)}</div>; };\nclass A { m() { switch (q) { case 1: r(); default: s(); } } }\nconst o = { k: () => u(v) };\nfunction test_me() {}\n"
    f = by_name(src, "ui/Button.jsx", "jsx")
    assert f["Button"].call_sites == [("submitForm", []), ("save", []), ("label", [])]
    assert f["m"].call_sites == [("r", ["1"]), ("s", ["default"])] and f["m"].qualified_name == "Button::A::m"
    assert f["k"].qualified_name == "Button::o::k" and f["test_me"].is_test
    g = by_name("export const render = (a: T): void => { if (a) { helper(a) } else { other() } }\nfunction helper(x: T) {}\ndeclare function gone(): void;\n", "ui.ts", "typescript")
    assert g["render"].call_sites == [("helper", ["(a)"]), ("other", ["!((a))"])] and "gone" not in g


def test_svelte():
    src = '<script lang="ts">\nfunction submitForm(a: string) { save(a); }\n</script>\n\n<button on:click={() => submitForm(x)}>{label}</button>\n'
    f = by_name(src, "Button.svelte", "svelte")
    assert f["submitForm"].call_sites == [("save", [])]
    assert f["template"].call_sites == [("submitForm", [])] and f["template"].line == 5


def test_broken_files_keep_what_is_whole():
    fs, faults = extract("def a():\n    b()\n\ndef c(:\n    d()\n\ndef e():\n    f()\n", "x.py", "python", False, True)
    assert faults and [f.name for f in fs] == ["a", "e"]


VALID = {
    "js": ["", "a = b;\n/re[/]/g.test(c) ? d : e;", "x = `a ${b ? `c${d}` : ''} }`; label: for (const a of b) { if (a) continue label; }", "({ a = 1 } = b); async () => { for await (const x of y) ; }; export default class { #p = 1; static { f(); } get x() { return this.#p } }", "if (a) /x/.test(b);\nvar { c, ...d } = e, [f,, g] = h; a ?? (b || c); i = i++ / 2"],
    "jsx": ["const a = <A b={c} {...d}>{e && <f.g/>} text ' \" {/* c */}</A>; x = <></>"],
    "ts": ["const a = <T,>(b: T): b is T => b as unknown as T; type M = { readonly [K in keyof T]?: T[K] }; enum E { A = 1, B }", "abstract class A<T extends object = {}> implements B { private constructor(public a?: string) { super() } abstract m(): void; [k: string]: any }", "let a: (x: number) => Promise<Map<string, number[]>> = f<string>(b)!; declare module 'x' { export const y: number }", "function f(this: Window, a?: number): asserts a is number; function f(a) {}\ntype C<T> = T extends (infer U)[] ? U : never"],
    "tsx": ["const F = ({ a }: P) => <div className='x'>{a.map((b: T) => <B key={b} />)}</div>"],
    "rs": ["fn f<'a, T: Fn(&'a str) -> u8 + 'a>(x: &'a [T; 3]) -> Vec<Vec<u8>> where T: Clone { x.iter().map(|y| y(\"a\")).collect::<Vec<_>>() }", "struct A(pub u8, u16); enum B { C { x: i32 }, D(u8), E = 4 } impl<T> Tr for A { const X: u8 = 1; type Y = T; fn z(&mut self) {} }", "fn g() { let Some(x) = y else { return }; let a = if b { 1 } else { 2 }; match (x, a) { (1..=5, _) | (_, 7) if z => {}, _ => () } 'l: loop { break 'l } }", "fn h() { let s = r#\"a \" b\"#; let c = '\\''; /* a /* b */ c */ m![a { b }]; *x = &mut S { a, ..d }; x?.await?; for i in 0..n {} }"],
    "svelte": ["<script>let a = 1</script>{#if a}<p>{a}</p>{:else if b}x{:else}y{/if}{#each a as { b }, i (b)}<li>{i}{/each}<style>p { a: b }</style>", "{#await p then v}{v}{:catch e}{@html e}{/await}<input bind:value={x} {...y} on:click|once={() => f({a: 1})}>"],
    "py": ["match x:\n    case [1, *r] if r: pass\n    case {'a': A(b=c)} | None: pass\n", "async def f(a, /, b=1, *, c: int, **k) -> x:\n    async with a as b, c: yield\n    return [i async for i in x if (y := i)]\n", "x = f'{a!r:>{w}} {b[\"c\"]}' + rb'z'.decode()\nlambda *a, b=1: (yield)\n", "try:\n    pass\nexcept* (A, B) as e:\n    raise X from e\nelse:\n    pass\n" if False else "try:\n    pass\nfinally:\n    del a[1:2], b.c\n"],
}
INVALID = {
    "js": ["function f() {", "a = ;", "<<<<<<< HEAD\na\n=======\nb\n>>>>>>> x", "const a;", "return 1", "x = 'abc", "let a: string = 1", "<div/>", "`${a", "if (a) { b() ", "f(a,, b)", "1 = a", "class A { m( { } }"],
    "jsx": ["x = <a></b>", "x = <a b=c/>", "x = <a>{b</a>"],
    "ts": ["const a = <div>x</div>;", "interface A { b: }", "type X = ;", "fn main() {}"],
    "tsx": ["const a = <div>x</span>;"],
    "rs": ["fn f( {}", "fn f() { let a = ; }", "struct A { b: }", "let a = 1;", "fn f() { \"abc }", "fn f() { a b }", "impl A { fn x() }", "use a::{b;"],
    "svelte": ["<script>let a = </script>", "{#if a}<p>", "{a b}", "<div", "{/if}", "<p>{#if a}</p>{/if}", "<style>p { "],
    "py": ["def f(:\n  pass", "x = (1", "if a:\nb", "print 'a'", "a = 'b", "  x = 1", "class A\n    pass", "x = = 1", "def f():\n    a\n  b\n", "try:\n    a\n", "f(a=1, b)", "0777", "\"\"\"abc"],
}


def faults(ext, src):
    return {"js": lambda: js_parser.parse(src), "jsx": lambda: js_parser.parse(src, jsx=True), "ts": lambda: js_parser.parse(src, typed=True), "tsx": lambda: js_parser.parse(src, jsx=True, typed=True), "rs": lambda: rs_parser.parse(src), "svelte": lambda: svelte_parser.parse(src), "py": lambda: py_parser.parse(src)}[ext]().faults


@pytest.mark.parametrize("ext", sorted(VALID))
def test_valid(ext):
    for src in VALID[ext]:
        assert faults(ext, src) == [], src


@pytest.mark.parametrize("ext", sorted(INVALID))
def test_invalid(ext):
    for src in INVALID[ext]:
        assert faults(ext, src), src


def _sources():
    import duckdb

    return duckdb.connect().sql("SELECT path, content FROM '/root/testdata/sf0.001/source_files.parquet'").fetchall()


def test_python_agrees_with_the_interpreter():
    for path, src in _sources():
        if path.endswith(".py"):
            try:
                ast.parse(src.encode())
                ok = True
            except (SyntaxError, ValueError):
                ok = False
            assert ok == (not py_parser.parse(src, memo=True).faults), path


def test_short_lexers_agree_with_the_exact_ones():
    for path, src in _sources():
        if path.endswith(".py") and (t := py_fast.lex_plain(src)):
            e = py_lexer.lex(src)
            assert (t[0].kind, t[0].start, t[0].end, t[0].match, t[0].key, t[1]) == (e[0].kind, e[0].start, e[0].end, e[0].match, e[0].key, e[1])
        if path.endswith(".rs") and (t := rs_fast.lex_plain(src)):
            e = rs_lexer.lex(src)
            assert (t.kind, t.start, t.end, t.match, t.key) == (e.kind, e.start, e.end, e.match, e.key)


def test_memo_changes_nothing():
    for path, src in _sources():
        ext = path.rsplit(".", 1)[1]
        if ext in ("js", "ts"):
            typed = ext == "ts"
            assert bool(js_parser.parse(src, typed=typed, memo=True).faults) == bool(js_parser.parse(src, typed=typed).faults), path
