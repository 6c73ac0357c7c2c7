"""Search, enclosing functions, callers, blocks and output on small source trees."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from arborix.extract.udtf import functions_of
from arborix.operators import blocks, graph, intervals, search
from arborix.operators.resolve import resolve
from arborix.plans.search import search_json, search_text
from arborix.sources.scan import lines

FILES = "path string, language string, content string, is_test boolean, content_sha256 string"


def tree(spark, **files):
    rows = [(p.replace("__", "/").replace("_dot_", "."), None, c, False, None) for p, c in files.items()]
    from arborix.functions.paths import is_test_path, language_for_path

    return spark.createDataFrame(rows, FILES).withColumn("language", language_for_path("path")).withColumn("is_test", is_test_path("path")).withColumn("content_sha256", F.sha2("content", 256))


def index(files, include_tests=False):
    nodes, edges, refs = graph.build_graph(functions_of(files.select("path", "content"), include_tests))
    return {"nodes": nodes.cache(), "edges": edges.cache(), "references": refs.cache()}


MAIN = """fn main() {
    router();
    register_handler(validate_body);
}

fn router() {
    if method == "POST" {
        validate_body();
    }
}

fn validate_body() {
    // body check
}

fn register_handler(f: fn()) {}
"""


def test_routes(spark):
    files = tree(spark, **{"src__main_dot_rs": MAIN, "tests__it_dot_rs": "fn test_it() {\n    validate_body();\n}\n"})
    main, both = index(files), index(files, True)
    row = json.loads(search_json(files, main, "body check").collect()[0]["json"])
    assert (row["file"], row["line"], row["function"], row["function_line"], row["qualified_name"]) == ("src/main.rs", 13, "validate_body", 12, "src::validate_body")
    assert row["callers"] == [{"file": "src/main.rs", "function": "router", "is_test": False, "line": 6, "conditions": ['method == "POST"']}]
    assert row["references"][0]["function"] == "main" and row["references"][0]["context"] == "passed to register_handler"
    assert "hidden_callers" not in row and "hidden_test_callers" not in row
    hidden = json.loads(search_json(files, both, "body check").collect()[0]["json"])
    assert hidden["hidden_test_callers"] == 1 and len(hidden["callers"]) == 1
    shown = json.loads(search_json(files, both, "body check", show_tests=True).collect()[0]["json"])
    assert [c["function"] for c in shown["callers"]] == ["router", "test_it"] and shown["hidden_test_callers"] == 0
    # a test file is looked up in the other universe when the main one misses it
    found = search_json(files, main, "validate_body\\(\\);", paths=["tests"], test_index=both).collect()
    assert json.loads(found[0]["json"])["function"] == "test_it"
    text = "\n".join(search_text(files, main, "body check", ["-B1"]))
    assert text.splitlines()[:3] == ["src/main.rs:validate_body:12", "  12- fn validate_body() {", "  13:     // body check"]
    assert "  Called by:" in text and '    src/main.rs:router:6  (when method == "POST")' in text
    compact = "\n".join(search_text(files, main, "body check", compact=True))
    assert compact.startswith("src/main.rs:validate_body:12 [callers: src/main.rs:router:6")
    assert search_json(files, main, "nowhere to be found").count() == 0


def test_heat_and_limits(spark):
    body = "fn target() {} // needle\n" + "".join(f"fn caller_{i}() {{ target(); }}\n" for i in range(1, 7)) + "fn feeder_1() { caller_6(); }\nfn feeder_2() { caller_6(); }\n"
    files = tree(spark, **{"src__main_dot_rs": body})
    ix = index(files)
    row = json.loads(search_json(files, ix, "needle").collect()[0]["json"])
    assert len(row["callers"]) == 5 and row["hidden_callers"] == 1 and row["callers"][0]["function"] == "caller_6"
    row = json.loads(search_json(files, ix, "needle", limit=10).collect()[0]["json"])
    assert len(row["callers"]) == 6 and "hidden_callers" not in row


def test_languages_stay_apart(spark):
    files = tree(spark, **{"app_dot_py": "def shared():\n    pass  # needle\n", "app_dot_ts": "function shared() { /* needle */ }\nfunction render() { shared(); }\n"})
    rows = {r["path"]: json.loads(r["json"]) for r in search_json(files, index(files), "needle").collect()}
    assert rows["app.py"]["callers"] == [] and [c["function"] for c in rows["app.ts"]["callers"]] == ["render"]


def test_same_name_in_two_impls_falls_back_to_both(spark):
    files = tree(spark, **{"src__main_dot_rs": "impl Foo { fn new() {} }\nimpl Bar { fn new() {} }\nfn a() { Foo::new(); }\nfn b() { main::new(); }\n"})
    ix = index(files)
    names = {r.id: r.qualified_name for r in ix["nodes"].collect()}
    assert {(names[r.caller], names[r.callee]) for r in ix["edges"].collect()} == {("src::a", "src::Foo::new"), ("src::a", "src::Bar::new"), ("src::b", "src::Foo::new"), ("src::b", "src::Bar::new")}


def test_condition_merge_against_fold(spark):
    rng = random.Random(5)
    rows = [(rng.randint(0, 60), 1, i, [rng.choice("abc") for _ in range(rng.choice([0, 1, 1, 2, 3]))]) for i in range(400)]
    got = {r.caller: r.conditions for r in graph.build_edges(spark.createDataFrame(rows, "caller long, callee long, site_ord long, conditions array<string>")).collect()}
    want = {}
    for a, _, _, c in rows:
        if a not in want:
            want[a] = list(c)
        elif not c or not want[a]:
            want[a] = []
        else:
            want[a] += [x for x in dict.fromkeys(c) if x not in want[a]]
    assert got == want


def test_callers_over_hops_against_model(spark):
    rng = random.Random(2)
    pairs = sorted({(rng.randint(0, 40), rng.randint(0, 40)) for _ in range(160)})
    rows = [(i, a, b, [str(i)]) for i, (a, b) in enumerate(pairs)]
    got = {(r.seed, r.caller): (r.depth, r.conditions) for r in graph.callers(spark.createDataFrame([(i,) for i in range(41)] + [(None,), (3,)], "seed long"), spark.createDataFrame(rows, graph.EDGES), 4).collect()}
    want = {}
    for s in range(41):
        seen, front = {s}, [s]
        for d in range(1, 5):
            nxt = []
            for v in front:
                for i, a, b, c in rows:
                    if b == v and a not in seen:
                        seen.add(a)
                        nxt.append(a)
                        want[(s, a)] = (d, c)
            front = nxt
    assert got == want
    assert graph.callers(spark.createDataFrame([(1,)], "seed long"), spark.createDataFrame(rows, graph.EDGES), 0).count() == 0


def test_paths(spark):
    nodes = spark.createDataFrame([(i,) for i in range(7)], "id long")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 1), (0, 3), (3, 3), (5, 6), (6, 5), (4, 4)], "caller long, callee long")
    assert {r.id for r in graph.roots(nodes, edges).collect()} == {0}
    assert [list(r.chain) for r in graph.simple_paths(nodes, edges).orderBy("path_id").collect()] == [[0, 1, 2], [0, 3]]
    long = spark.createDataFrame([(i, i + 1) for i in range(20)], "caller long, callee long")
    chain = graph.simple_paths(spark.createDataFrame([(i,) for i in range(21)], "id long"), long).collect()
    assert [list(r.chain) for r in chain] == [list(range(10))]


def test_enclosing_against_model(spark):
    rng = random.Random(4)
    iv = [(i, rng.choice("ab"), s := rng.randint(1, 900), s + rng.randint(0, 500) if rng.random() > 0.1 else 0) for i in range(120)]
    pts = [(rng.choice("abc"), rng.randint(1, 1400)) for _ in range(300)] + [(None, 3)]
    df = spark.createDataFrame(iv, "id long, g string, s long, e long")
    for bucket in (None, 64):
        got = intervals.enclosing(spark.createDataFrame(pts, "g string, at long"), df, "g", "at", "s", "e", "id", ["id"], bucket).select("g", "at", F.col("id")).collect()
        for g, at, i in got:
            best = max(((s, k) for k, x, s, e in iv if x == g and e and s <= at <= e), default=(None, None))
            assert i == best[1]
        assert len(got) == len(pts)


def test_blocks_against_model(spark):
    rng = random.Random(6)
    rows = [(f, n, rng.choice(["x", "y", None])) for f in "ab" for n in sorted(rng.sample(range(1, 100), 40))]
    got = {(r.path, r.line_number): r.block for r in blocks.merge_blocks(spark.createDataFrame(rows, "path string, line_number long, q string"), "path", "line_number", "q").collect()}
    for f in "ab":
        block, prev = 0, None
        for _, n, q in (r for r in rows if r[0] == f):
            block += q is None or q != prev
            prev = q
            assert got[(f, n)] == block


def test_lines(spark):
    df = spark.createDataFrame([("a", "x\r\ny\n"), ("b", "x"), ("c", ""), ("d", None), ("e", "\n\n")], "path string, content string")
    got = sorted((r.path, r.line_number, r.text) for r in lines(df).collect())
    assert got == [("a", 1, "x\r"), ("a", 2, "y"), ("b", 1, "x"), ("e", 1, ""), ("e", 2, "")]


def test_spans_are_bytes(spark):
    df = spark.createDataFrame([("a", 1, "é needle naïve needle"), ("a", 2, "none")], "path string, line_number long, text string")
    hits = search.submatches(search.matches(df, "needle"), "needle").collect()
    spans = [(s.start, s.end) for s in hits[0].submatches]
    raw = "é needle naïve needle".encode()
    assert spans == [(m.start(), m.end()) for m in re.finditer(b"needle", raw)]


def test_spans_of_lines_with_private_characters(spark):
    texts = ["\ue000 needle", "\ue000\ue001needle\ue001\ue001\ue000needle\ue001\ue000", "needle\ue000", "\ue000\ue001\ue000needle", "no"]
    df = spark.createDataFrame([("a", i, t) for i, t in enumerate(texts)], "path string, line_number long, text string")
    got = {r.line_number: [(s.start, s.end) for s in r.submatches] for r in search.submatches(df, "needle").collect()}
    assert got == {i: [m.span() for m in re.finditer(b"needle", t.encode())] for i, t in enumerate(texts)}
    two = search.submatches(df, "need", search.parse_flags(["-e", "\ue000"])).collect()
    assert {r.line_number: [(s.start, s.end) for s in r.submatches] for r in two} == {i: [m.span() for m in re.finditer("need|\ue000".encode(), t.encode())] for i, t in enumerate(texts)}


def test_context_is_chosen_within_the_text(spark):
    rng = random.Random(3)
    texts = ["\n".join(rng.choice(["hit", "x", "y", ""]) for _ in range(rng.randint(1, 14))) for _ in range(40)] + ["", None, "hit", "hit\n", "x\nhit\n\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    for before, after in ((0, 0), (2, 1), (0, 3), (30, 0)):
        got = sorted(tuple(r) for r in search.with_context(df, lambda t: t.contains("hit"), before, after, key="id").collect())
        want = []
        for i, t in enumerate(texts):
            rows = (t[:-1] if t.endswith("\n") else t).split("\n") if t else []
            m = ["hit" in x for x in rows]
            want += [(i, k + 1, x, m[k]) for k, x in enumerate(rows) if any(m[max(0, k - after) : k + before + 1])]
        assert got == sorted(want)


def test_callers_of_hot_functions(spark):
    """Walks over three levels through callees with very many callers, against a walk one edge at a time."""
    rng = random.Random(4)
    pairs = list(dict.fromkeys([(rng.randint(10, 2500), 1) for _ in range(3000)] + [(rng.randint(0, 30), rng.randint(0, 30)) for _ in range(150)] + [(1, 5), (5, 7), (1, 1)]))
    rng.shuffle(pairs)
    edges = spark.createDataFrame([(i, a, b, [f"c{i}"]) for i, (a, b) in enumerate(pairs)], graph.EDGES)
    seeds = [1, 5, 7, 3, 999999]
    into = {}
    for i, (a, b) in enumerate(pairs):
        into.setdefault(b, []).append((i, a))
    want = set()
    for s in seeds:
        seen, front = {s}, [s]
        for level in (1, 2, 3):
            nxt = []
            for v in front:
                for i, a in into.get(v, []):
                    if a not in seen:
                        seen.add(a)
                        nxt.append(a)
                        want.add((s, a, level, i))
            front = nxt
    got = graph.callers(spark.createDataFrame([(s,) for s in [*seeds, 1, None]], "seed long"), edges, 3)
    assert {(r.seed, r.caller, r.depth, r.edge_id) for r in got.collect()} == want and got.count() == len(want)
    assert all(r.conditions == [f"c{r.edge_id}"] for r in got.collect())


def test_a_name_that_all_use(spark):
    nodes = spark.createDataFrame([(i, "new", f"m{i}::new", "rust", f"m{i}.rs", False, 1, 2) for i in range(3)] + [(9, "new", "x::new", "python", "x.py", False, 1, 2)], graph.NODES)
    sites = spark.createDataFrame([(i, "rust" if i % 2 else "python", "new" if i % 3 else "m1::new") for i in range(6000)] + [(7000, None, "new"), (7001, "rust", None)], "site long, language string, raw string")
    got = sorted((r.site, r.target) for r in resolve(sites, nodes, "raw", ["site"]).collect())
    want = []
    for i in range(6000):
        want += [(i, 9)] if i % 2 == 0 else [(i, 1)] if i % 3 == 0 else [(i, t) for t in (0, 1, 2)]
    assert got == sorted(want)


def test_the_first_paths_of_many(spark):
    """Chains that cannot be among the first paths are not followed, and the first are those of a full walk."""
    rng = random.Random(7)
    pairs = sorted({(a, b) for a, b in ((rng.randint(0, 14), rng.randint(0, 14)) for _ in range(45)) if a != b} | {(20, 0), (21, 3)})
    edges = spark.createDataFrame([(i, a, b, []) for i, (a, b) in enumerate(pairs)], graph.EDGES)
    nodes = spark.createDataFrame([(i,) for i in range(22)], "id long")
    whole = [tuple(r.chain) for r in graph.simple_paths(nodes, edges, max_depth=6, max_paths=None).orderBy("path_id").collect()]
    assert whole == sorted(whole) and len(whole) > 100
    for n in (1, 7, 40):
        assert [tuple(r.chain) for r in graph.simple_paths(nodes, edges, max_depth=6, max_paths=n).orderBy("path_id").collect()] == whole[:n]


def test_flags():
    o = search.parse_flags(["-i", "-C", "3", "-A1", "--before-context=x", "-t", "rust", "-g", "!*.md", "-m", "4"])
    assert (o.ignore_case, o.before, o.after, o.types, o.globs, o.max_count) == (True, 3, 1, ["rust"], ["!*.md"], 4)
    with pytest.raises(ValueError):
        search.parse_flags(["--replace", "x"])
    with pytest.raises(ValueError):
        search.to_java(r"a(?=b)")
    assert search.to_java("[[:alpha:]_]") == "(?U)[A-Za-z_]"
    assert re.search(search.glob_regex("**/src/*.{ts,tsx}"), "a/src/x.tsx") and not re.search(search.glob_regex("*.rs"), "a/x.rst")


def test_case_and_words(spark):
    df = spark.createDataFrame([("a", i, t) for i, t in enumerate(["Foo bar", "foobar", "FOO", "foo.bar", "éa"])], "path string, line_number long, text string")
    n = lambda p, *f: [r.line_number for r in search.matches(df, p, search.parse_flags(list(f))).orderBy("line_number").collect()]
    assert n("foo", "-i") == [0, 1, 2, 3] and n("foo", "-S") == [0, 1, 2, 3] and n("Foo", "-S") == [0]
    assert n("foo", "-w") == [3] and n("foo.bar", "-F") == [3] and n("foobar", "-x") == [1] and n(r"\w+a$") == [4]
    assert n("foo", "-v") == [0, 2, 4] and n("Foo", "-e", "FOO") == [0, 2]


def test_merge_graphs_moves_ids(spark):
    one = (spark.createDataFrame([(0, "a", "a", "rust", "f", False, 1, 2), (1, "b", "b", "rust", "f", False, 3, 4)], graph.NODES), spark.createDataFrame([(0, 0, 1, [])], graph.EDGES), spark.createDataFrame([], graph.REFERENCES))
    nodes, edges, refs = graph.merge_graphs(spark, [one, one])
    assert sorted(r.id for r in nodes.collect()) == [0, 1, 2, 3] and sorted((r.edge_id, r.caller, r.callee) for r in edges.collect()) == [(0, 0, 1), (1, 2, 3)] and refs.count() == 0
    assert graph.merge_graphs(spark, [])[0].count() == 0
