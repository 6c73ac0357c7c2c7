"""Index snapshots: reuse, incremental updates, damage; scanning a work tree."""

import os
import subprocess

from test_search import tree

from arborix.plans.analyze import analyze
from arborix.plans.index import describe, ensure_index, merge_mode
from arborix.sources import git, scan, snapshot


def test_modes(spark, tmp_path):
    root = f"file://{tmp_path}/ix"
    base = {"a_dot_py": "def hello():\n    pass\n", "tests__t_dot_py": "def test_x():\n    hello()\n", "b_dot_rs": "fn f() { g(); }\nfn g() {}\n"}
    go = lambda files, head="h1", **k: ensure_index(spark, tree(spark, **files), root, "r", head, **k)
    first = go(base, include_tests=False)
    assert (first.mode, first.changed_files) == ("full_rebuild", ["a.py", "b.rs"]) and describe(first) == "Built index (2 files)"
    assert first.tables["edges"].count() == 1
    same = go(base, include_tests=False)
    assert same.mode == "reused" and describe(same) == "Index already up to date"
    assert go(base, head="h2", include_tests=False).mode == "reused"
    assert snapshot.IndexStore(spark, root).meta().head == "h2"
    edited_test = base | {"tests__t_dot_py": "def test_x():\n    pass\n"}
    assert go(edited_test, include_tests=False).mode == "reused"
    edited = base | {"a_dot_py": "def hello():\n    pass\ndef main():\n    hello()\n"}
    out = go(edited, include_tests=False)
    assert (out.mode, out.changed_files) == ("incremental", ["a.py"]) and out.tables["edges"].count() == 2
    gone = {"a_dot_py": edited["a_dot_py"], "c_dot_ts": "function z() {}"}
    out = go(gone, include_tests=False)
    assert (out.mode, out.changed_files) == ("incremental", ["b.rs", "c.ts"]) and out.tables["edges"].count() == 1
    # reverted at the same head: seen by content
    assert go(base, include_tests=False).changed_files == ["a.py", "b.rs", "c.ts"]
    version = snapshot.IndexStore(spark, root).pointer.current_version()
    for f in os.listdir(f"{tmp_path}/ix/{version}/edges"):
        if f.endswith(".parquet"):
            with open(f"{tmp_path}/ix/{version}/edges/{f}", "wb") as h:
                h.write(b"damaged")
    spark.catalog.clearCache()
    assert go(base, include_tests=False).mode == "full_rebuild"
    with open(f"{tmp_path}/ix/CURRENT", "w") as h:
        h.write("nowhere")
    assert go(base, include_tests=False).mode == "full_rebuild"
    assert merge_mode("reused", "incremental") == "incremental"


def test_plans(spark, tmp_path):
    out = ensure_index(spark, tree(spark, **{"a_dot_py": "def f(): pass"}), f"file://{tmp_path}/p")
    assert {p["language"]: p["action"] for p in out.plans}["python"] == "full_rebuild" and {p["action"] for p in out.plans} == {"full_rebuild", "skip"}


def test_empty_tree(spark, tmp_path):
    out = ensure_index(spark, tree(spark, **{"x_dot_md": "no"}).filter("language is not null"), f"file://{tmp_path}/e")
    assert out.tables["nodes"].count() == 0 and out.tables["edges"].count() == 0


def test_analyze(spark):
    a = analyze(tree(spark, **{"m_dot_py": "def a():\n    b()\ndef b():\n    c()\ndef c():\n    pass\n"}).select("path", "content"))
    names = {r.id: r.name for r in a.nodes.collect()}
    assert [[names[i] for i in r.chain] for r in a.paths.collect()] == [["a", "b", "c"]]
    assert {names[r.id] for r in a.roots.collect()} == {"a"}


def test_scan_and_git(spark, tmp_path):
    repo = str(tmp_path / "repo")
    os.makedirs(f"{repo}/src/tests")
    put = lambda p, b: open(f"{repo}/{p}", "wb").write(b)  # noqa: E731, SIM115
    put("src/a.py", b"def a(): pass\n")
    put("src/tests/t.py", b"x = 1\n")
    put("src/bad.py", b"\xff\xfe = 1\n")
    put("src/no.txt", b"text")
    put("ignored.rs", b"fn x() {}")
    put(".gitignore", b"ignored.rs\n")
    run = lambda *a: subprocess.run(["git", "-C", repo, "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", "-A")
    run("commit", "-qm", "one")
    files, bad = scan.scan_files(spark, repo)
    assert {r.path for r in files.collect()} == {"src/a.py", "src/tests/t.py"} and [r.path for r in bad.collect()] == ["src/bad.py"]
    assert {r.path for r in scan.scan_files(spark, repo, include_tests=False)[0].collect()} == {"src/a.py"}
    old = git.head_hash(repo)
    run("mv", "src/a.py", "src/b.py")
    run("commit", "-qm", "two")
    put("src/tests/t.py", b"x = 2\n")
    put("new.py", b"y = 1\n")
    got = {(r.path, r.origin) for r in git.change_snapshot(spark, repo, old).collect()}
    assert got == {("src/a.py", "committed"), ("src/b.py", "committed"), ("src/tests/t.py", "dirty"), ("new.py", "untracked")}
    assert git.parse_name_status(b"R100\0a\0b\0M\0c\0D\0") == ["a", "b", "c"]
    assert snapshot.location("/w", repo, True).endswith("/v1/with-tests")


def test_scan_of_a_tree_without_a_repository(spark, tmp_path):
    """Ignore files hold in every folder; names that begin with an underscore, empty files and deep folders count."""
    tree = {
        "pkg/__init__.py": "x = 1\n", "pkg/_private.py": "y = 2\n", "pkg/empty.py": "", "pkg/.hidden.py": "no", ".cache/a.py": "no", "README.md": "no",
        ".ignore": "build/\n*.gen.py\n/top.py\n!keep.gen.py\n# comment\n\ndocs/**/old.py\n", "build/a.py": "no", "pkg/build/b.py": "no", "a.gen.py": "no", "pkg/b.gen.py": "no", "pkg/keep.gen.py": "z\n", "top.py": "no", "pkg/top.py": "t\n",
        "docs/x/y/old.py": "no", "docs/old.py": "no", "docs/new.py": "n\n", "sub/.gitignore": "*.ts\n!deep/good.ts\n", "sub/a.ts": "no", "sub/deep/good.ts": "g\n", "sub/deep/bad.ts": "no", "other/a.ts": "o\n", "sub/deep/.ignore": "!bad.rs\nfoo*\n", "sub/deep/bad.rs": "b\n", "sub/deep/foo1.rs": "no",
        **{f"many/{i}/{j}/f.js": f"{i}{j}\n" for i in range(9) for j in range(9)},
    }
    for path, text in tree.items():
        f = tmp_path / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    (tmp_path / "bad.py").write_bytes(b"\xff\xfe")
    (tmp_path / "link.py").symlink_to(tmp_path / "pkg/_private.py")
    files, bad = scan.scan_files(spark, str(tmp_path))
    got = {r.path: r.content for r in files.collect()}
    assert got == {p: t for p, t in tree.items() if t != "no" and not p.endswith("ignore")} and files.count() == len(got)
    assert [r.path for r in bad.collect()] == ["bad.py"]
    free = {r.path for r in scan.scan_files(spark, str(tmp_path), respect_ignores=False)[0].collect()}
    assert free == {p for p in tree if p.rpartition(".")[2] in ("py", "ts", "rs", "js") and not any(x.startswith(".") for x in p.split("/"))}
