"""Documents of an evaluation: tasks, judgments, and the folders of its runs."""

from __future__ import annotations

from itertools import chain, count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import _fs, fs_text, small_table

# The fields of the documents.
TASK = "id string, repo struct<name:string,url:string,license:string,language:string>, issue struct<number:long,url:string,title:string>, ground_truth struct<pr_number:long,pr_url:string,pre_fix_commit:string,merge_commit:string>, prompt struct<title:string,body:string>, evaluation_focus array<string>"
SCORES = "map<string,struct<pr_alignment:int,reuse_alignment:int,duplication_risk:int,test_alignment:int>>"
JUDGMENT = f"better_matches_pr string, better_overall string, overall_ranking array<string>, confidence string, scores {SCORES}, summary string"


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents of a declared shape, whether of one line or many; fields that are missing are null."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_documents(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def judgment_scores(judgments: DataFrame, *keys: str) -> DataFrame:
    """keys, label, measure, score: one row per score of every judgment."""
    each = judgments.select(*keys, F.explode("scores").alias("label", "s"))
    return each.select(*keys, "label", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"s.{m}").cast("long").alias("score")) for m in ("pr_alignment", "reuse_alignment", "duplication_risk", "test_alignment")])).alias("x")).select(*keys, "label", "x.*")


def run_records(spark: SparkSession, root: str, tasks: DataFrame | None = None, variants: tuple[str, ...] = ("control", "tool")) -> DataFrame:
    """repo, task, agent, run_id, a column per variant, and status of every run root/runs/task/evaluations/agent/run_id, latest first.

    Status goes from ``created`` over ``snapshotted`` (a variant left a diff or a list of files) and ``judged`` (a judgment is there) to
    ``published``; only publish.json is read, the other files count by their names. Without a task of that id the repo is ``-``.
    """
    base = (root if "://" in root else f"file://{root}").rstrip("/") + "/runs"
    fs, at = _fs(spark, base)
    names = []
    if fs.exists(at):
        found = fs.listFiles(at, True)
        while found.hasNext():  # some files per run; an evaluation has few runs
            names.append((found.next().getPath().toString(),))
    texts = [(n, fs_text(spark, n)) for (n,) in names if n.endswith("/publish.json")]
    listed = small_table(spark, names, "path string").join(small_table(spark, texts, "_at string, text string"), F.col("path") == F.col("_at"), "left")
    p = F.split(F.expr(f"substring(path, {len(fs.makeQualified(at).toString()) + 2})"), "/")
    files = listed.select(p.alias("p"), "text").filter((F.size("p") >= 5) & (F.get("p", F.lit(1)) == "evaluations"))
    named = files.select(F.get("p", F.lit(0)).alias("task"), F.get("p", F.lit(2)).alias("agent"), F.get("p", F.lit(3)).alias("run_id"), F.array_join(F.slice("p", 5, F.size("p")), "/").alias("file"), "text")
    any_ = lambda c: F.coalesce(F.max(c), F.lit(False))
    meta = F.from_json("text", "published boolean, branches map<string,struct<url:string>>")
    left = [any_(F.col("file").isin(f"{v}.diff", f"{v}_files.json")).alias(f"_left_{v}") for v in variants]
    runs = named.groupBy("task", "agent", "run_id").agg(any_((F.col("file") == "judgment.json") | F.col("file").rlike(r"^judgments/[^/]+\.json$")).alias("_judged"), F.first(F.when(F.col("file") == "publish.json", meta), True).alias("_m"), *left)
    published = F.coalesce(F.col("_m.published"), F.lit(False))
    for v in variants:
        runs = runs.withColumn(v, T.variant_status(published, F.col("_m.branches")[v]["url"], F.col(f"_left_{v}")))
    started = F.lit(False)
    for v in variants:
        started = started | (F.col(v) != "-")
    runs = runs.withColumn("status", T.run_status(published, F.col("_judged"), started))
    names = tasks.select(F.col("id").alias("_t"), F.col("repo.name").alias("_repo")) if tasks is not None else spark.createDataFrame([], "_t string, _repo string")
    out = runs.join(names, F.col("task") == F.col("_t"), "left").select(F.coalesce("_repo", F.lit("-")).alias("repo"), "task", "agent", "run_id", *variants, "status")
    return out.orderBy(F.desc("run_id"), F.desc("task"), F.desc("agent"))


def run_list(records: DataFrame, variants: tuple[str, ...] = ("control", "tool")) -> DataFrame:
    """line: one line of text per run record."""
    each = [F.concat(F.lit(f"{v} "), F.col(v)) for v in variants]
    return records.select(F.concat_ws(" | ", "repo", "task", "agent", "run_id", *each, "status").alias("line"))


def matrix_markdown(rows: list) -> str:
    """The matrix of scored tasks (rows of ``matrix_rows`` with report_path and, per variant, branch_url) as Markdown. A short report by its nature."""
    link = lambda url: f"[branch]({url})" if url else "n/a"
    shown = lambda v: v.removesuffix("_review") + " + review" if v.endswith("_review") else v
    table = lambda cells: "| " + " | ".join(str(c) for c in cells) + " |"
    out = ["# Benchmark Matrix", "", table(["Task", "Agent", "Judge", "Variants", "Better vs PR", "Better overall", "Best variant", "Confidence", "Report"]), table(["---"] * 3 + ["---:"] + ["---"] * 5)]
    for r in rows:
        out += [table([r["task_id"], r["agent"], r["judge"], r["variant_count"], r["best_matches_pr"], r["best_overall"], r["best_variant"], r["confidence"], r["report_path"]]), ""]
        out += [table(["Variant", "PR align", "Reuse", "Duplication", "Tests", "Branch"]), table(["---"] + ["---:"] * 4 + ["---"])]
        out += [table([shown(v["variant"]), v["pr_alignment"], v["reuse_alignment"], v["duplication_risk"], v["test_alignment"], link(v["branch_url"])]) for v in r["variants"]]
    return "\n".join(out) + "\n"


def add_task(tasks: DataFrame, candidates: DataFrame) -> DataFrame:
    """Tasks with the candidates whose (repository, issue) no task has yet; an id that is taken gets a number."""
    key = lambda df: df.select(F.col("repo.name").alias("_r"), F.col("issue.number").alias("_i"))
    fresh = candidates.join(key(tasks).distinct(), (F.col("repo.name") == F.col("_r")) & (F.col("issue.number") == F.col("_i")), "left_anti")
    taken = tasks.select(F.col("id").alias("_t"))
    both = fresh.join(taken, F.col("id") == F.col("_t"), "left").withColumn("id", F.when(F.col("_t").isNotNull(), F.concat_ws("-", "id", F.col("issue.number").cast("string"))).otherwise(F.col("id"))).drop("_t")
    return tasks.unionByName(both)


def free_task_id(wanted: str, issue: int, taken: set[str]) -> str:
    """The id itself, with the issue's number behind it, or with 2, 3, ... behind that: the first that is not taken (a short list by its nature)."""
    numbered = f"{wanted}-{issue}"
    return next(x for x in chain([wanted, numbered], (f"{numbered}-{n}" for n in count(2))) if x not in taken)


def first_closed_issue(prs: DataFrame) -> DataFrame:
    """repo, pr_number, issue: of every merged pull request the first issue it closes that somebody else wrote.

    ``prs``: repo, number, author, merge_commit, parent, issues ARRAY<STRUCT<number, author, title>>. Requests without an author, a merge commit or
    its parent have none.
    """
    ok = prs.filter("author is not null and merge_commit is not null and parent is not null").select("repo", F.col("number").alias("pr_number"), "author", F.posexplode("issues").alias("at", "issue"))
    other = ok.filter(F.col("issue.author").isNotNull() & (F.col("issue.author") != F.col("author")))
    return other.groupBy("repo", "pr_number").agg(F.min_by("issue", "at").alias("issue"))


def latest_candidate(shortlists: DataFrame, repo: str, issue: int) -> DataFrame:
    """The candidate of a repository and issue from the newest shortlist that has it; ``shortlists``: run_id, rank, repo, issue, ..."""
    return shortlists.filter((F.col("repo") == repo) & (F.col("issue") == issue)).orderBy(F.desc("run_id"), "rank").limit(1)
