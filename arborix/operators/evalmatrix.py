"""Relations of an evaluation: runs, judgments, blind labels, candidates, differences and the score matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(runs: DataFrame, keys: list[str], run_id: str = "run_id") -> DataFrame:
    """The whole row of each key's latest run; ids are compared as what they are, text by text order."""
    rest = [c for c in runs.columns if c not in keys]
    return runs.groupBy(*keys).agg(F.max_by(F.struct(*rest), run_id).alias("r")).select(*keys, "r.*")


def judgment_union(judgments: DataFrame, key: str, priority: str) -> DataFrame:
    """One judgment per key, the one of highest priority; of equals the larger row."""
    rest = [c for c in judgments.columns if c not in (key, priority)]
    return judgments.groupBy(key).agg(F.max(F.struct(priority, *rest)).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def difference_summary(status: DataFrame, counts: DataFrame, key: list[str]) -> DataFrame:
    """status and counts by key from either side: status ``M`` and counts 0 where a side has nothing."""
    return status.join(counts, key, "full_outer").select(*key, F.coalesce("status", F.lit("M")).alias("status"), F.coalesce("added", F.lit(0)).alias("added"), F.coalesce("deleted", F.lit(0)).alias("deleted"))


def candidate_pool(found: DataFrame, known: DataFrame, key: list[str], seq: str, size: int) -> DataFrame:
    """The first ``size`` candidates in order of discovery: each key once, at its first place, without what is known already."""
    rest = [c for c in found.columns if c not in key]
    first = found.groupBy(*key).agg(F.min(F.struct(seq, *[c for c in rest if c != seq])).alias("r"))
    fresh = first.join(known.select(*key).distinct(), key, "left_anti")
    return fresh.select(*key, F.col(f"r.{seq}").alias(seq), *[F.col(f"r.{c}").alias(c) for c in rest if c != seq]).orderBy(seq).limit(size)


def selection_faults(selection: DataFrame, pool: DataFrame, key: list[str], limit: int) -> DataFrame:
    """key and fault of every selected candidate that is not in the pool (``unknown``) or selected twice (``repeated``), and one row ``too_many``."""
    unknown = selection.select(*key).join(pool.select(*key).distinct(), key, "left_anti").distinct().withColumn("fault", F.lit("unknown"))
    twice = selection.groupBy(*key).count().filter("count > 1").select(*key).withColumn("fault", F.lit("repeated"))
    n = selection.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).select(*[F.lit(None).cast(dict(selection.dtypes)[k]).alias(k) for k in key], F.lit("too_many").alias("fault"))
    return unknown.unionByName(twice).unionByName(n)


def shortlist(selection: DataFrame, pool: DataFrame, key: list[str], seq: str) -> DataFrame:
    """The selected candidates with what the pool knows of them, ranked from 1 in the order of selection."""
    ranked = selection.withColumn("rank", F.row_number().over(Window.orderBy(seq)).cast("long"))  # a short list by its nature
    return ranked.join(pool, key)


def blind_order(variants: DataFrame, task: str, variant: str, token: Column) -> DataFrame:
    """task, variant, label: labels A, B, ... in the order of a hash that gives nothing away."""
    w = Window.partitionBy(task).orderBy(token, variant)
    return variants.withColumn("label", F.char(F.lit(64) + F.row_number().over(w)))


def reveal(rows: DataFrame, labels: DataFrame, task: str, column: str) -> DataFrame:
    """``rows`` with the label in ``column`` replaced by its variant; what is no label (``tie``, ``accepted_pr``) stays."""
    l = labels.select(F.col(task).alias("_t"), F.col("label").alias("_l"), F.col("variant").alias("_v"))
    return rows.join(l, (F.col(task) == F.col("_t")) & (F.col(column) == F.col("_l")), "left").withColumn(column, F.coalesce("_v", F.col(column))).drop("_t", "_l", "_v")


def score_matrix(scores: DataFrame, keys: list[str], variant: str, measure: str, value: str, variants: list[str]) -> DataFrame:
    """One row per key with a column ``variant_measure`` for each variant and measure found in ``variants`` x the measures' names."""
    return scores.groupBy(*keys).pivot("cell", variants).agg(F.max(value)) if "cell" in scores.columns else scores.withColumn("cell", F.concat_ws("_", variant, measure)).groupBy(*keys).pivot("cell", variants).agg(F.max(value))


# The agents whose runs are counted, in the order in which they are shown, and the order of judges.
AGENTS = ("codex", "claude")
JUDGES = ("claude", "codex")


def _place(name: Column, order: tuple[str, ...]) -> Column:
    """The place of a name in a list, behind it for any other."""
    at = F.array_position(F.array(*[F.lit(x) for x in order]), name)
    return F.when(at > 0, at).otherwise(len(order) + 1)


def runs_per_agent(tasks: DataFrame, runs: DataFrame, task: str, agent: str, agents: tuple[str, ...] = AGENTS) -> DataFrame:
    """task, runs: how many runs each of ``agents`` has, as ``agent:n, agent:n`` in their order.

    ``tasks`` has one row per task and ``prepared``: a task without such runs shows ``prepared`` if it is and ``-`` if not (or null). Runs of
    other agents, null ones among them, and of unknown tasks are left out.
    """
    per = runs.filter(F.col(agent).isin(*agents)).groupBy(task, agent).agg(F.count(F.lit(1)).alias("n"))
    # at most one entry per agent meets in a list
    parts = per.groupBy(task).agg(F.array_sort(F.collect_list(F.struct(_place(F.col(agent), agents).alias("at"), F.concat_ws(":", agent, F.col("n").cast("string")).alias("t")))).alias("p"))
    shown = F.array_join(F.transform("p", lambda x: x["t"]), ", ")
    return tasks.join(parts, task, "left").select(task, F.coalesce(shown, F.when(F.coalesce("prepared", F.lit(False)), "prepared").otherwise("-")).alias("runs"))


def judge_order(judgments: DataFrame, keys: list[str], judge: str) -> DataFrame:
    """``judgments`` with ``rank`` from 1 within ``keys``: the preferred judges first, then the others by name."""
    return judgments.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(_place(F.col(judge), JUDGES), judge)).cast("long"))


def manifest_labels(manifests: DataFrame, keys: list[str]) -> DataFrame:
    """keys, label, variant of blind manifests: from label_to_variant, or label_to_condition where a manifest is of the older form."""
    return manifests.select(*keys, F.explode(F.coalesce("label_to_variant", "label_to_condition")).alias("label", "variant"))


def matrix_rows(runs: DataFrame, judgments: DataFrame, labels: DataFrame, task: str = "task_id") -> DataFrame:
    """One row per task, agent and judge of each task's latest run: eval_id, variant_count, best_matches_pr, best_overall, best_variant, confidence,
    variants ARRAY<STRUCT<variant, the four measures>>, and ``skipped``, why a task has no row of scores (``no run`` or ``not judged``).

    ``runs``: task, agent, eval_id (null for a task without a run). ``judgments``: eval_id, judge, best_matches_pr, best_overall, best,
    confidence, scores MAP<label, STRUCT<measures>>. ``labels``: eval_id, label, variant. What is no label stays as it is.
    """
    last = runs.groupBy(task).agg(F.max_by(F.struct("agent", "eval_id"), "eval_id").alias("r")).select(task, "r.*")
    names = labels.groupBy("eval_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "variant"))).alias("names"))
    rows = last.join(judgments, "eval_id", "left").join(names, "eval_id", "left")
    reveal_ = lambda c: F.coalesce(F.col("names")[F.col(c)], F.col(c)).alias(c)
    each = F.transform(F.array_sort(F.map_entries("names")), lambda e: F.struct(e["value"].alias("variant"), *[F.col("scores")[e["key"]][m].alias(m) for m in MEASURES]))
    skipped = F.when(F.col("eval_id").isNull(), "no run").when(F.col("judge").isNull(), "not judged")
    return rows.select(task, "agent", "judge", "eval_id", F.size("names").cast("long").alias("variant_count"), reveal_("best_matches_pr"), reveal_("best_overall"), reveal_("best").alias("best_variant"), "confidence", F.array_sort(each).alias("variants"), skipped.alias("skipped"))


# The scores a judgment has, each from 1 to 5.
MEASURES = ["pr_alignment", "reuse_alignment", "duplication_risk", "test_alignment"]


def missing_fields(present: Column, required: tuple[str, ...]) -> Column:
    """The required fields that an array of names lacks, in their order."""
    return F.array_except(F.array(*[F.lit(x) for x in required]), F.coalesce(present, F.array().cast("array<string>")))


def judgment_faults(scores: DataFrame, key: str, measure: str, value: str) -> DataFrame:
    """key, fault of judgments that lack a measure or have a score outside 1 to 5."""
    have = scores.groupBy(key).agg(F.collect_set(measure).alias("m"))
    want = F.array(*[F.lit(m) for m in MEASURES])
    missing = have.select(key, F.explode(F.array_except(want, "m")).alias("fault")).select(key, F.concat(F.lit("missing "), "fault").alias("fault"))
    bad = scores.filter(~F.coalesce(F.col(value).between(1, 5), F.lit(False))).select(key, F.concat(F.lit("range "), measure).alias("fault"))
    return missing.unionByName(bad).distinct()
