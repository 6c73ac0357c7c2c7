"""Small source trees with the functions, calls, conditions and references that they must give, and the whole call graph against plain Python."""

import glob

import pytest

from arborix.extract.base import allow_depth
from arborix.extract.udtf import functions_of
from arborix.extract.visitors import extract, module_of
from arborix.functions.paths import EXTENSIONS, LANGUAGES
from arborix.operators.graph import build_graph, call_edges, numbered_functions
from arborix.queries import code
from arborix.session import shared_dir

ROUTES = """fn main() {
    let app = router();
    register_handler(validate_body);
    app
}
fn router() -> App {
    if method == "POST" {
        validate_body();
    }
    handle();
    App
}
fn validate_body() -> bool {
    // needle
    true
}
fn register_handler(f: fn() -> bool) {
    let _ = f;
}
fn handle() {}
"""
TEST = """fn test_validate_body() {
    validate_body();
}
"""
FEEDERS = "".join(f"fn caller_{i}() {{ target(); }}\n" for i in range(1, 7))

# path -> text; then name -> (line, is_test); (caller, callee) -> conditions; (referencer, target) -> context
TREES = {
    "routes": (
        {"src/main.rs": ROUTES, "tests/integration.rs": TEST},
        {"main": (1, False), "router": (6, False), "validate_body": (13, False), "register_handler": (17, False), "handle": (20, False), "test_validate_body": (1, True)},
        {("main", "router"): [], ("main", "register_handler"): [], ("router", "validate_body"): ['method == "POST"'], ("router", "handle"): [], ("test_validate_body", "validate_body"): []},
        {("main", "validate_body"): "passed to register_handler"},
    ),
    "context": (
        {"src/main.rs": "fn wrapper() { a(); }\n\nfn a() {\n    start();\n    middle();\n    end();\n}\n\nfn start() {}\nfn middle() {}\nfn end() {}\n"},
        {"wrapper": (1, False), "a": (3, False), "start": (9, False), "middle": (10, False), "end": (11, False)},
        {("wrapper", "a"): [], ("a", "start"): [], ("a", "middle"): [], ("a", "end"): []},
        {},
    ),
    "tests only": (
        {"tests/integration.rs": "fn test_helper() {\n    helper();\n}\n\nfn helper() {}\n"},
        {"test_helper": (1, True), "helper": (5, True)},
        {("test_helper", "helper"): []},
        {},
    ),
    "python": (
        {"app.py": "def main():\n    router()\n    register_handler(validate_body)\n\n\ndef router():\n    if method == 'POST':\n        validate_body()\n\n\ndef validate_body():\n    return True\n\n\ndef register_handler(f):\n    return f\n"},
        {"main": (1, False), "router": (6, False), "validate_body": (11, False), "register_handler": (15, False)},
        {("main", "router"): [], ("main", "register_handler"): [], ("router", "validate_body"): ["method == 'POST'"]},
        {("main", "validate_body"): "passed to register_handler"},
    ),
    "typescript": ({"ui.ts": "export const render = (): void => {\n  helper();\n};\nfunction helper(): void {}\n"}, {"render": (1, False), "helper": (4, False)}, {("render", "helper"): []}, {}),
    "jsx": (
        {"Button.jsx": "function submitForm() {}\nexport function Button() {\n  return <button onClick={() => submitForm()}>{label()}</button>;\n}\nfunction label() { return 'x'; }\n"},
        {"submitForm": (1, False), "Button": (2, False), "label": (5, False)},
        {("Button", "submitForm"): [], ("Button", "label"): []},
        {},
    ),
    "svelte": ({"Button.svelte": "<script>\nfunction submitForm() {}\n</script>\n\n<button on:click={() => submitForm()}>x</button>\n"}, {"submitForm": (1, False), "template": (5, False)}, {("template", "submitForm"): []}, {}),
    "heat": (
        {"src/main.rs": "fn target() {}\n\n" + FEEDERS + "fn feeder_1() { caller_6(); }\nfn sink(f: fn()) {}\nfn register_1() { sink(target); }\n"},
        {"target": (1, False), **{f"caller_{i}": (2 + i, False) for i in range(1, 7)}, "feeder_1": (9, False), "sink": (10, False), "register_1": (11, False)},
        {**{(f"caller_{i}", "target"): [] for i in range(1, 7)}, ("feeder_1", "caller_6"): [], ("register_1", "sink"): []},
        {("register_1", "target"): "passed to sink"},
    ),
    "two languages": ({"app.py": "def shared():\n    pass\n", "app.ts": "function shared() {}\nfunction render() { shared(); }\n"}, None, {("ts:render", "ts:shared"): []}, {}),
    "one name, two types": (
        {"src/main.rs": "struct Foo;\nstruct Bar;\n\nfn call_foo() { Foo::new(); }\nfn call_bar() { Bar::new(); }\nimpl Foo { fn new() {} }\nimpl Bar { fn new() {} }\n"},
        None,
        {("call_foo", "src::Foo::new"): [], ("call_foo", "src::Bar::new"): [], ("call_bar", "src::Foo::new"): [], ("call_bar", "src::Bar::new"): []},
        {},
    ),
}


@pytest.mark.parametrize("name", TREES)
def test_tree(spark, name):
    files, functions, edges, references = TREES[name]
    df = spark.createDataFrame(list(files.items()), "path string, content string")
    nodes, e, r = (t.collect() for t in build_graph(functions_of(df)))
    if functions is not None:
        assert {n.name: (n.line, n.is_test) for n in nodes} == functions and len(nodes) == len(functions)
    called = {n.id: ("ts:" if name == "two languages" and n.language == "typescript" else "") + (n.qualified_name if n.name == "new" else n.name) for n in nodes}
    assert {(called[x.caller], called[x.callee]): x.conditions for x in e} == edges and len(e) == len(edges)
    assert {(called[x.referencer], called[x.target]): x.context for x in r} == references and len(r) == len(references)
    assert [x.edge_id for x in sorted(e, key=lambda x: (x.caller, x.callee))] == list(range(len(e)))


def plain_graph(files):
    """The call graph of (path, content), one site at a time."""
    place = {key: n for n, key, _ in LANGUAGES}
    allow_depth()
    nodes = []
    for path, content in files:
        language = EXTENSIONS.get(path.rsplit("/", 1)[-1].rpartition(".")[2])
        if language and content:
            is_test = any(f"/{d}/" in f"/{path}" for d in ("tests", "test", "__tests__")) or is_test_stem(path)
            nodes += [(place[language], path, k, language, f) for k, f in enumerate(extract(content, path, language, is_test, True)[0])]
    nodes.sort(key=lambda x: (x[0], x[1].encode(), x[2]))
    names = {}
    for i, (_, path, _, language, f) in enumerate(nodes):
        names.setdefault((language, f.name), []).append((i, f.qualified_name, module_of(path, language)))
    sites = {}
    for i, (_, _, _, language, f) in enumerate(nodes):
        for callee, conditions in f.call_sites:
            simple, _, q = (callee.rpartition(".")[2], "", None) if "." in callee else (callee.rpartition("::")[2], "", callee.rpartition("::")[0] if "::" in callee else None)
            found = names.get((language, simple), [])
            if q is not None and (hit := [x for x in found if x[1].startswith(q + "::") or x[2] == q]):
                found = hit
            for x in found:
                sites.setdefault((i, x[0]), []).append(conditions)
    out = []
    for k, ((a, b), lists) in enumerate(sorted(sites.items())):
        more = [c for x in lists[1:] for c in x if c not in lists[0]]
        out.append((k, a, b, " && ".join([] if not all(lists) else lists[0] + list(dict.fromkeys(more)))))
    return out


def is_test_stem(path):
    name = path.rsplit("/", 1)[-1]
    stem = name.rpartition(".")[0] or name
    return stem.endswith(("_test", ".test", ".spec", "_spec")) or stem.startswith("test_")


def test_code_graph_against_plain_python(spark, sf):
    files = [(f"{r.repo}/{r.path}", r.content) for r in spark.read.parquet(f"{sf}/source_files.parquet").collect()]
    want = plain_graph(files)
    got = sorted(tuple(r) for r in code.code_graph(spark, sf).collect())
    assert len(got) >= 5 and got == want


def test_all_trees_together_against_plain_python(spark):
    """Names that many files share, with conditions and qualifiers."""
    files = [(f"{k.replace(' ', '_')}/{p}", t) for k, (tree, *_) in TREES.items() for p, t in tree.items()]
    _, edges, _ = build_graph(functions_of(spark.createDataFrame(files, "path string, content string")))
    got = sorted((r.edge_id, r.caller, r.callee, " && ".join(r.conditions)) for r in edges.collect())
    assert len(got) == 30 and got == plain_graph(files)


def test_edges_of_a_name_that_all_share_are_not_written_as_rows(spark):
    """120 functions of one name, each of which calls it: 14,400 edges, of which no intermediate table may hold a row each."""
    mod = lambda i: f"def same():\n    if a:\n        same()\n    other{i}()\n\ndef other{i}():\n    pass\n"
    files = [(f"r/m{i:03}.py", mod(i)) for i in range(120)]
    before = set(glob.glob(f"{shared_dir(spark)}/arborix/*/*"))
    edges = call_edges(numbered_functions(functions_of(spark.createDataFrame(files, "path string, content string"), references=False), ["call_sites"]))
    got = sorted((r.edge_id, r.caller, r.callee, " && ".join(r.conditions)) for r in edges.collect())
    written = set(glob.glob(f"{shared_dir(spark)}/arborix/*/*")) - before
    assert len(got) == 120 * 121 and got == plain_graph(files)
    assert written and max(spark.read.parquet(p).count() for p in written) <= 240


def test_edges_of_qualified_and_plain_sites_together(spark):
    """A caller that names a function with and without its type, of types that are there and that are not."""
    files = [
        ("r/a.rs", "struct A;\nimpl A { fn new() {} fn go() { if x { A::new(); } new(); } }\nfn one() { if y { B::new(); } if z { A::new(); } C::new(); }\n"),
        ("r/b.rs", "struct B;\nimpl B { fn new() {} }\nfn two() { if p { B::new(); } one(); b::new(); }\n"),
        ("r/c.rs", "fn new() {}\nfn three() { match k { 1 => c::new(), _ => new() } two(); one(); }\n"),
    ]
    edges = call_edges(numbered_functions(functions_of(spark.createDataFrame(files, "path string, content string"), references=False), ["call_sites"]))
    got = sorted((r.edge_id, r.caller, r.callee, " && ".join(r.conditions)) for r in edges.collect())
    assert len(got) >= 10 and got == plain_graph(files)


def test_calls_without_references_are_the_same_calls(spark, sf):
    """Statements of a known shape are not parsed again where only calls count: each file twice, so that all shapes are known."""
    rows = [(f"{r.repo}/{r.path}", r.content) for r in spark.read.parquet(f"{sf}/source_files.parquet").collect()]
    rows += [(p, t) for tree, *_ in TREES.values() for p, t in tree.items()]
    more = {
        "s.js": "a(b(c), d[e()]);\nx.y(1).z(`${f(g)}`);\nlet h = () => { i(j); };\nk(function () { l(m); });\na(b(c), d[e()]);\nfoo(o ? p() : q());\nasync (r);\n",
        "s.py": "a(b(c), d[e()])\nx.y(1).z(f'{f(g)}')\nh = lambda: i(j)\nk(lambda: l(m))\nif n(): o(); p()\n",
        "s.rs": "fn a() { b(c(1), d); e.f::<G>(2).h(); let i = |j| k(j); let l = if m() { n() } else { o() }; q!(r()); }\n",
        "s.svelte": "<script>function a() { b(c); }</script>\n<p on:click={() => d(e)}>{f(g)}</p>\n",
    }
    rows += list(more.items())
    allow_depth()
    seen = 0
    for path, content in [*rows, *rows]:
        language = EXTENSIONS.get(path.rsplit("/", 1)[-1].rpartition(".")[2])
        if language and content:
            full, calls = (extract(content, path, language, False, True, True, r)[0] for r in (True, False))
            key = lambda fs: [(f.name, f.qualified_name, f.is_test, f.line, f.end_line, f.call_sites) for f in fs]
            assert key(full) == key(calls) and not any(f.reference_sites for f in calls)
            seen += len(calls)
    assert seen > 100


def test_extracted_functions_against_plain_python(spark, sf):
    rows = spark.read.parquet(f"{sf}/source_files.parquet").collect()
    want = set()
    allow_depth()
    for r in rows:
        language = EXTENSIONS.get(r.path.rsplit("/", 1)[-1].rpartition(".")[2])
        if language and r.content:
            is_test = any(f"/{d}/" in f"/{r.path}" for d in ("tests", "test", "__tests__")) or is_test_stem(r.path)
            want |= {(r.repo, r.path, language, k, f.name, f.qualified_name, f.is_test, f.line, f.end_line, len(f.call_sites), len(f.reference_sites)) for k, f in enumerate(extract(r.content, r.path, language, is_test, True)[0])}
    got = [tuple(r) for r in code.extract_functions(spark, sf).collect()]
    assert set(got) == want and len(got) == len(want)
