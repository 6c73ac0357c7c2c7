"""Arguments, roots, and documents of an evaluation."""

import json
import os

import pytest

from arborix import cli
from arborix.sources import harness


def test_arguments(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "src").mkdir()
    c = cli.parse_args(["-i", "-C", "2", "--depth=3", "needle", "src", "."])
    assert (c.pattern, c.paths, c.flags, c.depth) == ("needle", ["src", "."], ["-i", "-C", "2"], 3)
    assert cli.parse_args(["--", "-x"]).pattern == "-x" and cli.parse_args(["src"]).pattern == "src"
    assert cli.parse_args(["-e", "a", "src"]).paths == ["src"] and cli.parse_args(["--build-index", "src"]).paths == ["src"]
    for bad in ([], ["--json", "--compact", "x"], ["--build-index", "--json"], ["--depth", "x", "y"], ["a", "b"], ["--replace", "x"]):
        with pytest.raises(ValueError):
            cli.parse_args(bad)
    assert cli.main(["--json", "--compact", "x"]) == 2


def test_roots(tmp_path):
    for r in ("one", "two"):
        os.makedirs(tmp_path / r / "a" / "b")
        (tmp_path / r / ".git").mkdir()
    os.makedirs(tmp_path / "free" / "x")
    one = os.path.realpath(tmp_path / "one")
    assert cli.infer_root([f"{one}/a/b", f"{one}/a"]) == (one, ["a/b", "a"])
    assert cli.infer_root([f"{tmp_path}/free", f"{tmp_path}/free/x"]) == (os.path.realpath(tmp_path / "free"), ["x"])
    with pytest.raises(ValueError):
        cli.infer_root([one, f"{tmp_path}/two"])


def test_documents(spark, tmp_path):
    assert harness.run_records(spark, str(tmp_path)).count() == 0  # no runs yet
    for p in ("t1/evaluations/codex/2/run.json", "t1/evaluations/codex/1/run.json", "t1/evaluations/codex/1/log.txt", "t2/evaluations/other/3/run.json", "t2/stray.json"):
        os.makedirs(os.path.dirname(tmp_path / "runs" / p), exist_ok=True)
        (tmp_path / "runs" / p).write_text("{}")
    got = [(r.task, r.agent, r.run_id, r.status) for r in harness.run_records(spark, str(tmp_path)).collect()]
    assert got == [("t2", "other", "3", "created"), ("t1", "codex", "2", "created"), ("t1", "codex", "1", "created")]
    (tmp_path / "j.json").write_text(json.dumps({"better_overall": "A", "scores": {"A": {"pr_alignment": 4}, "B": {"pr_alignment": 2, "test_alignment": 5}}}, indent=1))
    scores = harness.judgment_scores(harness.read_documents(spark, str(tmp_path / "j.json"), harness.JUDGMENT), "better_overall")
    assert {(r.label, r.measure, r.score) for r in scores.filter("score is not null").collect()} == {("A", "pr_alignment", 4), ("B", "pr_alignment", 2), ("B", "test_alignment", 5)}
    prs = spark.createDataFrame([("r", 1, "a", "m", "p", [(7, "a", "own"), (8, "b", "x"), (9, "c", "y")]), ("r", 2, "a", None, "p", [(1, "b", "z")])], "repo string, number long, author string, merge_commit string, parent string, issues array<struct<number:long,author:string,title:string>>")
    assert [(r.pr_number, r.issue.number) for r in harness.first_closed_issue(prs).collect()] == [(1, 8)]
    tasks = spark.createDataFrame([("x", ("o/r", None, None, None), (5, None, None))], "id string, repo struct<name:string,url:string,license:string,language:string>, issue struct<number:long,url:string,title:string>")
    new = spark.createDataFrame([("x", ("o/r", None, None, None), (5, None, None)), ("x", ("o/s", None, None, None), (6, None, None))], tasks.schema)
    assert sorted(r.id for r in harness.add_task(tasks, new).collect()) == ["x", "x-6"]
    lists = spark.createDataFrame([("1", 1, "r", 5), ("2", 3, "r", 5), ("3", 1, "r", 6)], "run_id string, rank int, repo string, issue long")
    assert harness.latest_candidate(lists, "r", 5).collect()[0].run_id == "2"
