"""Callers and references of functions, ranked, split, truncated and attached to matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.paths import normalize_path
from ..session import Stages, written
from .graph import callers, describe
from .intervals import enclosing
from .skew import salted_join

#: Entries shown per section unless told otherwise.
MAX_CONTEXT = 5


def caller_info(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, heats: DataFrame, depth: int = 1) -> DataFrame:
    """seed, file, function, is_test, line, depth, heat, conditions of every caller; line is where the caller is defined."""
    rows = callers(seeds, edges, depth)
    return describe(rows, "caller", nodes, heats, "edge_id").select("seed", "caller", "edge_id", "file", "function", "is_test", "line", "depth", "heat", "conditions")


def reference_info(seeds: DataFrame, nodes: DataFrame, refs: DataFrame, heats: DataFrame) -> DataFrame:
    """seed, file, function, is_test, line, heat, context, ref_id of every reference to a seed; one function may stand several times."""
    stages = Stages(refs.sparkSession, "references")
    s = seeds.select(F.col("seed").alias("seed")).distinct()
    links = refs.select("ref_id", "referencer", "target", "context")
    links = links if written(refs) else stages.put(links)
    rows = stages.put(salted_join(links, s, "target", "seed", F.col("ref_id"), "inner").select("seed", "referencer", "ref_id", "context"))
    return describe(rows, "referencer", nodes, heats, "ref_id").select("seed", "referencer", "ref_id", "file", "function", "is_test", "line", "heat", "context")


def ranked(rows: DataFrame, order: list, limit: int) -> DataFrame:
    """``rows`` with rnk in their (seed, is_test) part and ``total``, its size; only the first ``limit`` stay.

    Totals are counted apart with map-side combination, so that the window keeps only ``limit`` rows per part while it ranks.
    """
    w = Window.partitionBy("seed", "is_test").orderBy(*order)
    top = rows.withColumn("rnk", F.row_number().over(w).cast("long")).filter(F.col("rnk") <= limit)
    total = rows.groupBy("seed", "is_test").agg(F.count(F.lit(1)).alias("total")).select(F.col("seed").alias("_s"), F.col("is_test").alias("_t"), "total")
    return top.join(total, (F.col("seed") == F.col("_s")) & F.col("is_test").eqNullSafe(F.col("_t"))).drop("_s", "_t")


def _order(names: list[str]) -> list:
    return [F.col(n[1:]).desc() if n.startswith("-") else F.col(n).asc_nulls_first() for n in names]


def top_callers(info: DataFrame, limit: int = MAX_CONTEXT) -> DataFrame:
    return ranked(info, _order(["depth", "-heat", "file", "line", "function", "edge_id"]), limit)


def top_references(info: DataFrame, limit: int = MAX_CONTEXT) -> DataFrame:
    """Ties beyond heat, file, line and function keep the order of the references."""
    return ranked(info, _order(["-heat", "file", "line", "function", "ref_id"]), limit)


def node_contexts(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, refs: DataFrame, heats: DataFrame, depth: int = 1, limit: int = MAX_CONTEXT) -> DataFrame:
    """One row per seed: callers, test_callers, references, test_references (arrays of at most ``limit``, in rank order) and the four totals.

    It is worked out once per distinct function, however many lines matched in it.
    """
    c = top_callers(caller_info(seeds, nodes, edges, heats, depth), limit)
    r = top_references(reference_info(seeds, nodes, refs, heats), limit)
    t = F.coalesce("is_test", F.lit(False))

    def gather(rows: DataFrame, item, prefix: str) -> DataFrame:
        pick = lambda flag: F.transform(F.array_sort(F.collect_list(F.when(t == flag, F.struct("rnk", item.alias("v"))))), lambda x: x["v"])
        n = lambda flag: F.coalesce(F.max(F.when(t == flag, F.col("total"))), F.lit(0))
        return rows.groupBy("seed").agg(pick(False).alias(prefix), pick(True).alias(f"test_{prefix}"), n(False).alias(f"n_{prefix}"), n(True).alias(f"n_test_{prefix}"))

    callers_ = gather(c, F.struct("file", "function", "is_test", "line", "conditions"), "callers")
    references = gather(r, F.struct("file", "function", "is_test", "line", "context"), "references")
    return seeds.select("seed").distinct().join(callers_, "seed", "left").join(references, "seed", "left")


def enclose(matches: DataFrame, nodes: DataFrame) -> DataFrame:
    """``matches`` (path, line_number, ...) with node, function, qualified_name, function_line, end_line, language and node_is_test of the
    function around each, null where there is none. A leading ``./`` on either side does not matter."""
    iv = nodes.select(normalize_path("file").alias("_file"), "line", "end_line", "id", F.col("id").alias("node"), F.col("name").alias("function"), "qualified_name", F.col("line").alias("function_line"), F.col("end_line").alias("function_end"), F.col("language").alias("node_language"), F.col("is_test").alias("node_is_test"))
    keep = ["node", "function", "qualified_name", "function_line", "function_end", "node_language", "node_is_test"]
    return enclosing(matches.withColumn("_file", normalize_path("path")), iv, "_file", "line_number", "line", "end_line", "id", keep).drop("_file")


def enclose_with_fallback(matches: DataFrame, nodes: DataFrame, test_nodes: DataFrame, is_test_file) -> DataFrame:
    """Like ``enclose``, but matches of test files that no function of ``nodes`` encloses are looked up among ``test_nodes``."""
    first = enclose(matches, nodes)
    missed = F.col("node").isNull() & is_test_file
    again = enclose(first.filter(missed).select(*matches.columns), test_nodes).withColumn("universe", F.when(F.col("node").isNotNull(), "with_tests"))
    return first.filter(~missed).withColumn("universe", F.when(F.col("node").isNotNull(), "main")).unionByName(again)


def json_rows(enriched: DataFrame, show_tests: bool, limit: int = MAX_CONTEXT) -> DataFrame:
    """path, line_number, json: one JSON object per match, with keys in alphabetical order and absent keys for what does not apply.

    ``enriched`` joins matches, their functions and node contexts. Test entries are listed if asked for or if the function is a test itself;
    hidden counts appear where something is hidden, and those of tests wherever there are tests.
    """
    show = F.lit(show_tests) | F.coalesce(F.col("node_is_test"), F.lit(False))
    inside = F.col("node").isNotNull()
    empty = lambda c, like: F.coalesce(F.col(c), F.array().cast(like))
    kinds = dict(enriched.dtypes)
    lists = {c: empty(c, kinds[c]) for c in ("callers", "test_callers", "references", "test_references")}
    both = lambda a, b: F.when(inside, F.when(show, F.concat(lists[a], lists[b])).otherwise(lists[a]))
    over = lambda n: F.when(inside & (F.coalesce(F.col(n), F.lit(0)) > limit), F.col(n) - limit)
    tests = lambda n: F.when(inside & (F.coalesce(F.col(n), F.lit(0)) > 0), F.when(show, F.greatest(F.col(n) - limit, F.lit(0))).otherwise(F.col(n)))
    body = F.struct(
        both("callers", "test_callers").alias("callers"),
        F.col("text").alias("content"),
        F.col("path").alias("file"),
        F.col("function"),
        F.col("function_line"),
        over("n_callers").alias("hidden_callers"),
        over("n_references").alias("hidden_references"),
        tests("n_test_callers").alias("hidden_test_callers"),
        tests("n_test_references").alias("hidden_test_references"),
        F.when(inside, F.col("node_is_test")).alias("is_test"),
        F.when(inside, F.col("node_language")).alias("language"),
        F.col("line_number").alias("line"),
        F.col("qualified_name"),
        both("references", "test_references").alias("references"),
    )
    return enriched.select("path", "line_number", F.to_json(body).alias("json"))
