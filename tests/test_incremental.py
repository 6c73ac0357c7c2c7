"""State versions, changes, and runs that die."""

from datetime import datetime

import pytest

from arborix.operators import incremental as inc

FILES = "repo string, path string, content string, content_sha256 string, hash string"


def files(spark, rows):
    return spark.createDataFrame([("r", p, c, None, "extra") for p, c in rows], FILES)


def run(store, df, fail=False):
    seen = []

    def process(todo):
        seen.extend(sorted((r.path, r.change) for r in todo.collect()))
        if fail:
            raise RuntimeError("died")

    if fail:
        with pytest.raises(RuntimeError):
            inc.run_incremental(store, df, process)
    else:
        inc.run_incremental(store, df, process)
    return seen


def test_runs(spark, tmp_path):
    store = inc.StateStore(spark, f"file://{tmp_path}/state")
    first = files(spark, [("a.py", "1"), ("./b.py", "2"), (None, "3"), ("c.py", None)])
    want = [("a.py", "added"), ("b.py", "added"), ("c.py", "added")]
    assert run(store, first, fail=True) == want  # nothing is put in force
    assert run(store, first) == want
    assert run(store, first) == []
    second = files(spark, [("a.py", "1"), ("b.py", "x"), ("d.py", "4")])
    want = [("b.py", "changed"), ("c.py", "removed"), ("d.py", "added")]
    store.prepare(inc.current_state(second))  # a version written by a run that died before the swap
    assert run(store, second, fail=True) == want
    assert run(store, second) == want
    assert run(store, second) == []


def test_a_file_that_changes_during_a_run(spark, tmp_path):
    """The state has the hashes that the changes were told by, so the later change is seen by the next run."""
    store = inc.StateStore(spark, f"file://{tmp_path}/state")
    at = f"{tmp_path}/files"
    write = lambda text: files(spark, [("a", text)]).coalesce(1).write.mode("overwrite").parquet(at)
    write("1")
    seen = []

    def process(todo):
        seen.extend((r.path, r.change) for r in todo.collect())
        write("2")

    inc.run_incremental(store, spark.read.parquet(at), process)
    assert run(store, spark.read.parquet(at)) == [("a", "changed")] and seen == [("a", "added")]
    assert run(store, spark.read.parquet(at)) == []


def test_output_and_state_come_in_force_together(spark, tmp_path, monkeypatch):
    """A run that dies before the one step leaves nothing of its output in force, one that dies after it everything."""
    store = inc.StateStore(spark, f"file://{tmp_path}/state")
    df = files(spark, [("a", "1"), ("b", "1")])
    rows = lambda: sorted((r.path, r.change) for o in store.outputs() for r in spark.read.parquet(o).collect())
    die = lambda *a: (_ for _ in ()).throw(RuntimeError("died"))
    with monkeypatch.context() as m:
        m.setattr(store, "succeed", die)
        with pytest.raises(RuntimeError):
            inc.run_incremental(store, df, lambda todo: todo)
    assert rows() == [] and store.current_version() is None
    with monkeypatch.context() as m:
        m.setattr(store, "swap", die)  # behind the step
        with pytest.raises(RuntimeError):
            inc.run_incremental(store, df, lambda todo: todo)
    assert rows() == [("a", "added"), ("b", "added")]
    assert run(store, df) == []
    inc.run_incremental(store, files(spark, [("a", "2"), ("b", "1")]), lambda todo: todo)
    assert rows() == [("a", "added"), ("a", "changed"), ("b", "added")]
    assert store.vacuum(hours=1) == 0 and store.vacuum(hours=0) >= 2  # state and output of the run that died first
    assert rows() == [("a", "added"), ("a", "changed"), ("b", "added")] and store.load().count() == 2


def test_of_two_runs_at_once_one_is_refused(spark, tmp_path):
    store = inc.StateStore(spark, f"file://{tmp_path}/state")
    run(store, files(spark, [("a", "1")]))

    def process(todo):
        run(inc.StateStore(spark, store.root), files(spark, [("a", "1"), ("b", "1")]))

    with pytest.raises(inc.Conflict):
        inc.run_incremental(store, files(spark, [("a", "1"), ("c", "1")]), process)
    assert {r.path for r in store.load().collect()} == {"a", "b"}
    assert run(store, files(spark, [("a", "1"), ("b", "1"), ("c", "1")])) == [("c", "added")]


def test_old_versions_go(spark, tmp_path):
    store = inc.StateStore(spark, f"file://{tmp_path}/state")
    for i in range(5):
        run(store, files(spark, [("a", str(i))]))
    assert sum(p.name.startswith("v-") for p in (tmp_path / "state").iterdir()) == 2


def test_fingerprints(spark):
    import hashlib

    rows = [("r", "python", f"d/{i}.py", f"h{i}") for i in range(50)] + [("r", "rust", "é.rs", None), (None, "python", "z", "1")]
    df = spark.createDataFrame(rows, "repo string, language string, path string, hash string")
    digest = lambda parts: hashlib.sha256("".join(x + "\0" for p in parts for x in p).encode()).hexdigest()
    py = digest(sorted((p, h) for r, n, p, h in rows[:50]))
    rs = digest([("é.rs", "")])
    got = inc.fingerprints(df, ["repo", "language"])
    assert {(r.repo, r.language): (r.fingerprint, r.n_files) for r in got.collect()} == {("r", "python"): (py, 50), ("r", "rust"): (rs, 1), (None, "python"): (digest([("z", "1")]), 1)}
    both = {r.repo: r.fingerprint for r in inc.combined_fingerprints(got, ["repo"]).collect()}
    assert both["r"] == digest([("rust", rs), ("python", py)])
    assert inc.fingerprints(df.limit(0), ["repo"]).count() == 0


def test_stored_state(spark):
    t = lambda d: datetime(2025, 1, d)
    runs = spark.createDataFrame([(1, "ok", t(1)), (1, "running", None), (2, "failed", t(9)), (3, "ok", t(5)), (4, "ok", t(5)), (None, "ok", t(9))], "run_id long, status string, finished_at timestamp")
    rows = [(1, "r", "./a", "AA", t(1)), (2, "r", "a", "bb", t(9)), (3, "r", "a", "cc", t(5)), (4, "r", "a", "DD", t(5)), (4, "r", "a", "DD", t(5)), (1, "r", "b", "ee", t(1)), (3, "r", "b", None, t(5)), (7, "r", "z", "ff", t(2)), (1, None, "n", "11", t(1)), (1, "r", None, "11", t(1))]
    cache = spark.createDataFrame(rows, "run_id long, repo string, path string, source_hash string, written_at timestamp")
    state = inc.stored_state(runs, cache)
    assert {(r.repo, r.path, r.hash) for r in state.collect()} == {("r", "a", "dd"), ("r", "b", None), (None, "n", "11")}
    now = spark.createDataFrame([("r", "a", "dd"), ("r", "b", "22"), (None, "n", "12")], "repo string, path string, hash string")
    assert {(r.repo, r.path, r.change) for r in inc.changes(now, state).collect()} == {("r", "b", "added"), (None, "n", "changed")}


def test_empty(spark):
    none = spark.createDataFrame([], inc.STATE)
    assert inc.changes(none, none).count() == 0


def test_stream_applies_each_change_once(spark, tmp_path):
    from arborix.streaming.incremental import FILES as STREAM
    from arborix.streaming.incremental import follow

    store = inc.StateStore(spark, f"file://{tmp_path}/s")
    seen = []

    def land(name, rows):
        spark.createDataFrame([("r", p, c, None, datetime(2025, 1, d)) for p, c, d in rows], STREAM).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    def go():
        follow(spark, f"{tmp_path}/in/*", store, f"{tmp_path}/cp", lambda todo, last: seen.extend((r.path, r.change) for r in todo.collect())).awaitTermination()

    land("1", [("a", "1", 1), ("a", "2", 2), ("b", "1", 1)])
    go()
    assert sorted(seen) == [("a", "added"), ("b", "added")]
    seen.clear()
    land("2", [("a", "2", 3), ("b", None, 3), ("c", "1", 3)])
    go()
    assert sorted(seen) == [("b", "removed"), ("c", "added")]
