"""Building an index, and bringing it up to date from content hashes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..extract.udtf import FUNCTIONS, functions_of
from ..functions.paths import LANGUAGES
from ..operators.graph import build_graph
from ..operators.incremental import changes
from ..session import Stages
from ..sources.snapshot import SCHEMA_VERSION, IndexMeta, IndexStore, fingerprint

# Modes in ascending order of work.
MODES = ["reused", "incremental", "full_rebuild"]


@dataclass
class LoadOutcome:
    """How the index came about, what changed (path), and its tables."""

    mode: str
    changed: DataFrame | None = None
    tables: dict[str, DataFrame] = field(default_factory=dict)
    plans: list = field(default_factory=list)

    @property
    def changed_files(self) -> list[str]:
        """The changed paths in order, gathered only for who asks for them."""
        return [] if self.changed is None else [r["path"] for r in self.changed.orderBy("path").collect()]


def merge_mode(a: str, b: str) -> str:
    """The one with more work."""
    return max(a, b, key=MODES.index)


def plan_actions(spark: SparkSession, now: DataFrame, state: DataFrame, same_head: bool, compatible: bool) -> DataFrame:
    """language, action, n_changed: per language skip, reuse, refresh_head, incremental or full_rebuild.

    ``now`` and ``state``: language, path, hash. No files and no state: skip. No state, or one of another shape: full_rebuild. No change: reuse
    at the same head and refresh_head at another.
    """
    key = lambda df: df.select(F.col("language").alias("repo"), "path", "hash")
    diff = changes(key(now), key(state)).groupBy("repo").agg(F.count(F.lit(1)).alias("n_changed")).withColumnRenamed("repo", "language")
    langs = spark.createDataFrame([(n, k) for n, k, _ in LANGUAGES], "ordinal int, language string")
    here = now.groupBy("language").agg(F.count(F.lit(1)).alias("n_now"))
    there = state.groupBy("language").agg(F.count(F.lit(1)).alias("n_state"))
    rows = langs.join(here, "language", "left").join(there, "language", "left").join(diff, "language", "left")
    n_now, n_state = F.coalesce("n_now", F.lit(0)), F.coalesce("n_state", F.lit(0))
    no_change = F.coalesce("n_changed", F.lit(0)) == 0
    action = (
        F.when((n_now == 0) & (n_state == 0), "skip")
        .when((n_state == 0) | ~F.lit(compatible), "full_rebuild")
        .when(no_change, "reuse" if same_head else "refresh_head")
        .otherwise("incremental")
    )
    return rows.select("ordinal", "language", action.alias("action"), F.coalesce("n_changed", F.lit(0)).alias("n_changed")).orderBy("ordinal")


def ensure_index(spark: SparkSession, files: DataFrame, root: str, repo: str = "", head: str = "", include_tests: bool = True) -> LoadOutcome:
    """The index of ``files`` (path, language, content, is_test, content_sha256), reused, brought up to date or built anew.

    Freshness follows from content hashes alone: a file that was changed and changed back is known as unchanged. Missing or damaged snapshots
    are built anew without an error. Only changed files are parsed again; the relations of the graph are always joined in full.
    """
    store = IndexStore(spark, root)
    stages = Stages(spark, "index")
    keep = files if include_tests else files.filter("not is_test")
    now = stages.put(keep.select("language", "path", F.col("content_sha256").alias("hash")))
    print_ = fingerprint(now)
    meta = store.meta()
    wanted = IndexMeta(SCHEMA_VERSION, repo, include_tests, head, print_, now.count())
    compatible = meta is not None and (meta.repo, meta.include_tests) == (repo, include_tests)
    tables = store.tables() if compatible else None
    state = tables["state"] if tables else spark.createDataFrame([], "language string, path string, hash string")
    plans = plan_actions(spark, now, state, bool(meta and meta.head == head), tables is not None).collect()  # seven rows
    actions = {p["action"] for p in plans}
    if tables and actions <= {"skip", "reuse", "refresh_head"} and meta.fingerprint == print_:
        if meta.head != head:
            store.refresh_head(wanted)
        return LoadOutcome("reused", None, tables, plans)
    if tables:
        touched = changes(now.select(F.col("language").alias("repo"), "path", "hash"), state.select(F.col("language").alias("repo"), "path", "hash")).select("path").distinct()
        touched = stages.put(touched)
        fresh = functions_of(keep.join(touched, "path", "left_semi"), include_tests)
        functions = tables["functions"].join(touched, "path", "left_anti").unionByName(fresh)
        mode = "incremental"
        changed = touched
    else:
        functions = functions_of(keep, include_tests)
        mode = "full_rebuild"
        changed = now.select("path")
    functions = stages.put(functions.select(*[c.split()[0] for c in FUNCTIONS.split(", call_sites")[0].split(", ")], "call_sites", "reference_sites"))
    nodes, edges, refs = build_graph(functions)
    store.write({"functions": functions, "nodes": nodes, "edges": edges, "references": refs, "state": now}, wanted)
    return LoadOutcome(mode, changed, store.tables(), plans)


def describe(outcome: LoadOutcome) -> str:
    """The line an index build prints."""
    if outcome.mode == "reused":
        return "Index already up to date"
    n = outcome.changed.count()
    return f"{'Built' if outcome.mode == 'full_rebuild' else 'Updated'} index ({n} {'file' if n == 1 else 'files'})"
