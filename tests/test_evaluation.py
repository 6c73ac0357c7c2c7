"""Evaluation relations, text rules, payloads and rendering."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from arborix.functions import payload, render
from arborix.functions import text as T
from arborix.operators import evalmatrix as ev
from arborix.sources import harness
from arborix.timing import Timings


def test_differences(spark):
    s = spark.createDataFrame([("a", "A"), ("b", "D")], "path string, status string")
    n = spark.createDataFrame([("b", 0, 3), ("c", 2, 1)], "path string, added long, deleted long")
    assert {tuple(r) for r in ev.difference_summary(s, n, ["path"]).collect()} == {("a", "A", 0, 0), ("b", "D", 0, 3), ("c", "M", 2, 1)}


def test_candidates(spark):
    found = spark.createDataFrame([("r", 1, 5), ("r", 2, 1), ("r", 1, 0), ("s", 1, 3), ("t", 9, 2)], "repo string, issue long, seq long")
    known = spark.createDataFrame([("t", 9)], "repo string, issue long")
    pool = ev.candidate_pool(found, known, ["repo", "issue"], "seq", 2)
    assert [(r.repo, r.issue) for r in pool.orderBy("seq").collect()] == [("r", 1), ("r", 2)]
    chosen = spark.createDataFrame([("r", 2, 0), ("r", 2, 1), ("x", 1, 2)], "repo string, issue long, at long")
    assert {(r.repo, r.fault) for r in ev.selection_faults(chosen, pool, ["repo", "issue"], 2).collect()} == {("x", "unknown"), ("r", "repeated"), (None, "too_many")}
    assert [r.rank for r in ev.shortlist(chosen.limit(1), pool, ["repo", "issue"], "at").collect()] == [1]


def test_runs_and_labels(spark):
    runs = spark.createDataFrame([("t", "20260101T000000Z", "a", 1), ("t", "20260201T000000Z", "b", 2), ("u", "2", "a", 3)], "task string, run_id string, agent string, x long")
    assert {(r.task, r.x) for r in ev.latest(runs, ["task"]).collect()} == {("t", 2), ("u", 3)}
    tasks = spark.createDataFrame([("t", True), ("u", True), ("v", True), ("w", False), ("x", None)], "task string, prepared boolean")
    per = ev.runs_per_agent(tasks, runs.unionByName(runs.limit(1)), "task", "agent", ("b", "a"))
    assert {(r.task, r.runs) for r in per.collect()} == {("t", "b:1, a:2"), ("u", "a:1"), ("v", "prepared"), ("w", "-"), ("x", "-")}
    order = spark.createDataFrame([("e", x) for x in ("zeta", "codex", "abc", "claude")], "eval string, judge string")
    assert [r.judge for r in ev.judge_order(order, ["eval"], "judge").orderBy("rank").collect()] == ["claude", "codex", "abc", "zeta"]
    v = spark.createDataFrame([("t", "control"), ("t", "tool")], "task string, variant string")
    labels = ev.blind_order(v, "task", "variant", T.stable_token(F.col("task"), F.col("variant")))
    rows = spark.createDataFrame([("t", "A"), ("t", "B"), ("t", "tie")], "task string, winner string")
    assert {r.winner for r in ev.reveal(rows, labels, "task", "winner").collect()} == {"control", "tool", "tie"}
    j = spark.createDataFrame([("c", 0, "old"), ("c", 1, "new"), ("d", 0, "x")], "judge string, prio int, v string")
    assert {(r.judge, r.v) for r in ev.judgment_union(j, "judge", "prio").collect()} == {("c", "new"), ("d", "x")}


def test_text_rules(spark):
    df = spark.createDataFrame([("  Fix the `Parser`: crash!  ",), ("A\n\n long   " + "word " * 30,), (None,)], "t string")
    r = df.select(T.slugify(F.col("t"), 12), T.truncate_text(F.col("t"), 20), T.kind_hint(F.col("t")), T.prompt_title(F.col("t"))).collect()
    assert r[0][0] == "fix-the-pars" and r[0][2] == "bug" and r[0][3] == "Fix the Parser: crash!"
    assert r[1][1] == "A long word word..." and r[2][0] is None
    kinds = spark.createDataFrame([("An address book", "", "unknown"), ("Please add", "a flag", "feature"), ("RFC: x", "", "feature"), ("It fails", "please add one", "bug"), ("x", None, "unknown"), ("incorrect", "", "bug"), ("x", "an option", "feature"), ("", "a request", "feature")], "a string, b string, want string")
    assert all(k.got == k.want for k in kinds.select("want", T.kind_hint(F.col("a"), F.col("b")).alias("got")).collect())
    x = spark.createDataFrame([("o/My_Repo.js", "Why?!", 7), ("o/r", "?!", 7), ("o/r", "a" * 60, 7)], "r string, t string, i long")
    assert [r[0] for r in x.select(T.task_id(F.col("r"), F.col("t"), F.col("i"))).collect()] == ["my-repo-js-why", "r-issue-7", "r-" + "a" * 56]
    assert [harness.free_task_id("x", 7, t) for t in (set(), {"x"}, {"x", "x-7"}, {"x", "x-7", "x-7-2"})] == ["x", "x-7", "x-7-2", "x-7-3"]
    d = spark.createDataFrame([("2026-01-02", " a/b/c "), ("2026-13-02", "a"), ("x", "/b"), (None, None)], "d string, r string")
    assert [(str(r[0]), r[1]) for r in d.select(T.cli_date(F.col("d")), T.repo_name(F.col("r"))).collect()] == [("2026-01-02", "a/b/c"), ("None", None), ("None", None), ("None", None)]
    y = spark.sql("SELECT timestamp'2026-01-02 03:04:05' AS t, date'2026-07-03' AS d, 'a' AS x, 'b' AS y, 'tool_review' AS v")
    r = y.select(T.run_id(F.col("t")), T.discovery_cutoff(F.col("d")), T.stable_token(F.col("x"), F.col("y")), T.variant_name(F.col("v")), T.markdown_link(F.col("x"), F.lit(None)), T.markdown_link(F.col("x"), F.col("y"))).collect()[0]
    assert tuple(map(str, r)) == ("20260102T030405Z", "2026-01-01", hashlib.sha256(b"a::b").hexdigest()[:12], "tool + review", "n/a", "[a](b)")
    d = spark.createDataFrame([("3\t-\tx y", "R100\told\tnew")], "a string, b string").select(T.numstat(F.col("a")), T.name_status(F.col("b"))).collect()[0]
    assert tuple(d[0]) == (3, -1, "x y") and tuple(d[1]) == ("R100", "new", "old")


GOOD = {
    "better_matches_pr": "A", "better_overall": "B", "overall_ranking": ["accepted_pr", "B", "A"], "confidence": "high", "A_vs_pr_differences": ["x"], "B_vs_pr_differences": [], "A_vs_B_differences": ["y"],
    "scores": {x: {m: 3 for m in payload.MEASURES} for x in "AB"}, "notable_strengths": {"A": [], "B": []}, "notable_risks": {"A": [], "B": ["z"]}, "summary": "s",
}


def test_payloads():
    text = json.dumps(GOOD)
    deep = GOOD
    for _ in range(30):
        deep = {"result": {"messages": ["no", {"content": deep}]}}
    for wrapped in (GOOD, {"result": text}, [1, {"message": "no json", "final": GOOD}], {"messages": [{"content": text}]}, deep):
        assert payload.unwrap(wrapped) == GOOD
    assert payload.unwrap({"other": GOOD}) == {"other": GOOD} and payload.unwrap("text") == "text"  # only the keys of envelopes are opened
    assert payload.unwrap({"result": "[1]", "content": GOOD}) == [1]  # a text that is JSON stands for its envelope
    assert payload.first_json("x {bad} [1, 2] {\"a\": 1}") == [1, 2] and payload.first_json("none") is None and payload.first_json(None) is None
    assert payload.parse_answer(f"Here it is:\n{text}\nDone.") == GOOD
    for bad in ("", "  ", "nothing", "[1]"):
        with pytest.raises(ValueError):
            payload.parse_answer(bad)
    assert payload.is_selection({"summary": "", "candidates": []}) and not payload.is_selection({"candidates": []})
    assert not payload.is_judgment({"scores": {}, "better_overall": "A"}) and payload.is_judgment({"scores": {}, "best_overall": "A", "best_matches_pr": "A"})


def test_judgments():
    assert payload.judgment_errors(GOOD) == []
    new = payload.normalize_judgment(GOOD, ["A", "B"])
    assert new["best_overall"] == "B" and new["differences_vs_pr"] == {"A": ["x"], "B": []} and payload.normalize_judgment(new, ["A"]) is new
    assert payload.judgment_errors({}) == [f"missing {k}" for k in payload.REQUIRED]
    wrong = [
        ("best_overall", "C"), ("overall_ranking", ["A", "B"]), ("overall_ranking", ["accepted_pr", "A", "A"]), ("confidence", "sure"), ("scores", {"A": new["scores"]["A"]}), ("scores", {**new["scores"], "B": {**new["scores"]["B"], "pr_alignment": 6}}),
        ("scores", {**new["scores"], "B": {**new["scores"]["B"], "pr_alignment": "3"}}), ("differences_vs_pr", {"A": []}), ("differences_vs_pr", []), ("implementation_differences", [1]), ("notable_risks", {"A": [], "B": "x"}), ("notable_strengths", None), ("summary", 3),
    ]
    for k, v in wrong:
        assert len(payload.judgment_errors(new | {k: v})) >= 1, (k, v)
    assert payload.judgment_errors(new | {"best_overall": "tie"}) == []
    assert payload.ranking(GOOD) == ["accepted_pr", "B", "A"]
    assert payload.ranking({"overall_ranking": ["A", "B"], "scores": {"B": 1, "A": 1, "accepted_pr": 1}, "better_overall": "B"}) == ["accepted_pr", "B", "A"]
    assert payload.ranking({"scores": {"B": 1, "A": 1}, "best_overall": "tie"}) == ["accepted_pr", "A", "B"] and payload.ranking({}) == ["accepted_pr"]


def test_run_records(spark, tmp_path):
    def put(path, text=""):
        f = tmp_path / "runs" / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)

    base = "t/evaluations/codex/"
    put(base + "1/eval.json")
    put(base + "2/control.diff")
    put(base + "3/tool_files.json")
    put(base + "3/judgments/claude.json", "{}")
    put(base + "4/tool.diff")
    put(base + "4/publish.json", json.dumps({"published": True, "branches": {"control": {"url": "u"}}}))
    put("u/evaluations/claude/5/judgment.json", "{}")
    put("u/other/claude/6/judgment.json", "{}")
    tasks = spark.createDataFrame([("t", ("o/r",))], "id string, repo struct<name:string>")
    got = harness.run_records(spark, str(tmp_path), tasks)
    want = [("-", "u", "claude", "5", "-", "-", "judged"), ("o/r", "t", "codex", "4", "published", "snapshotted", "published"), ("o/r", "t", "codex", "3", "-", "snapshotted", "judged"), ("o/r", "t", "codex", "2", "snapshotted", "-", "snapshotted"), ("o/r", "t", "codex", "1", "-", "-", "created")]
    assert [tuple(r) for r in got.collect()] == want
    assert harness.run_list(got).collect()[1].line == "o/r | t | codex | 4 | control published | tool snapshotted | published"


def test_matrix(spark):
    runs = spark.createDataFrame([("t", "codex", "1"), ("t", "codex", "2"), ("u", None, None), ("v", "codex", "3")], "task_id string, agent string, eval_id string")
    scores = "scores map<string,struct<" + ",".join(f"{m}:int" for m in ev.MEASURES) + ">>"
    j = spark.createDataFrame([(e, "claude", "A", "tie", "accepted_pr", "high", {"A": (1, 2, 3, 4), "B": (5, 4, 3, 2)}) for e in ("1", "2")], f"eval_id string, judge string, best_matches_pr string, best_overall string, best string, confidence string, {scores}")
    m = spark.createDataFrame([("2", {"A": "tool", "B": "control"}, None), ("1", None, {"A": "control", "B": "tool"})], "eval_id string, label_to_variant map<string,string>, label_to_condition map<string,string>")
    labels = ev.manifest_labels(m, ["eval_id"])
    assert labels.count() == 4
    got = {r.task_id: r for r in ev.matrix_rows(runs, j, labels).collect()}
    assert (got["t"].eval_id, got["t"].best_matches_pr, got["t"].best_overall, got["t"].best_variant, got["t"].variant_count) == ("2", "tool", "tie", "accepted_pr", 2)
    assert [tuple(v) for v in got["t"].variants] == [("control", 5, 4, 3, 2), ("tool", 1, 2, 3, 4)]
    assert (got["t"].skipped, got["u"].skipped, got["v"].skipped) == (None, "no run", "not judged")
    row = got["t"].asDict() | {"report_path": "r.md", "variants": [v.asDict() | {"branch_url": u} for v, u in zip(got["t"].variants, ("x", None))]}
    md = harness.matrix_markdown([row]).splitlines()
    assert md[4] == "| t | codex | claude | 2 | tool | tie | accepted_pr | high | r.md |" and md[-2:] == ["| control | 5 | 4 | 3 | 2 | [branch](x) |", "| tool | 1 | 2 | 3 | 4 | n/a |"]
    assert spark.createDataFrame([(["scores"],), (None,)], "p array<string>").select(F.size(ev.missing_fields(F.col("p"), payload.REQUIRED))).collect()[0][0] == len(payload.REQUIRED) - 1


def test_timings(capsys):
    t = Timings(True)
    t.add("rg_run", 1.5)
    t.add("rg_run", 0.5)
    with pytest.raises(KeyError), t.measure("output"):
        raise KeyError
    t.show("x")
    line = capsys.readouterr().err
    assert "timings (x): head_hash=0.000s" in line and "rg_run=2.000s" in line and line.split()[-1].startswith("total=")
    off = Timings(False)
    off.add("rg_run", 1)
    off.show("x")
    assert off.seconds == {} and capsys.readouterr().err == ""


def test_rendering():
    c = render.Colors(True)
    assert render.highlight("é ab", [(3, 5)], c) == f"é {c.paint('match', 'ab')}" and render.highlight("é", [(1, 2)], c) == "é"
    assert render.color_choice(["--color", "always", "--color=never"]) == "never"
    assert render.hidden_context(1, 2) == "1 more caller and 2 more references hidden" and render.hidden_context(0, 0) is None
    assert render.hidden_test_callers(1, 5, True) == "1 test caller hidden" and render.hidden_test_callers(2, 5, False).startswith("Only test callers")
    assert render.hidden_test_callers(7, 5, True) == "2 more test callers hidden" and render.hidden_test_references(1, 5).startswith("Only")
