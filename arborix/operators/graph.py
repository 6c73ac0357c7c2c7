"""The call graph: edges, references, heat, callers over several hops, roots and paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.paths import language_ordinal
from ..session import Stages, small_table, written
from .resolve import candidates, qualifier, resolve, simple_name
from .skew import hot_counts, salted_join

MAX_DEPTH, MAX_PATHS = 10, 100_000

NODES = "id long, name string, qualified_name string, language string, file string, is_test boolean, line long, end_line long"
EDGES = "edge_id long, caller long, callee long, conditions array<string>"
REFERENCES = "ref_id long, referencer long, target long, kind string, context string"


def number_rows(df: DataFrame, order: list, name: str) -> DataFrame:
    """Dense numbers from 0 in a total order, without a single task: a range-partitioned sort, whose partition sizes give each its offset."""
    spark = df.sparkSession
    stages = Stages(spark, "number")
    part = stages.put(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    pid = F.shiftright(F.col("_m"), 33)
    sizes = part.groupBy(pid.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_o"))  # one row per partition
    low = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return part.withColumn("_p", pid).join(F.broadcast(offsets), "_p").withColumn(name, (F.col("_o") + low).cast("long")).drop("_m", "_p", "_o")


def merge_conditions(site_ord, conditions):
    """The conditions of an edge from those of its sites: none if any site has none; else the first site's list, then what later sites add."""
    lists = F.transform(F.array_sort(F.collect_list(F.struct(site_ord.alias("o"), F.coalesce(conditions, F.array().cast("array<string>")).alias("c")))), lambda x: x["c"])
    free = F.max(F.size(F.coalesce(conditions, F.array().cast("array<string>"))) == 0)
    return F.when(free, F.array().cast("array<string>")).otherwise(F.concat(F.get(lists, F.lit(0)), F.array_except(F.flatten(F.slice(lists, 2, F.greatest(F.size(lists) - 1, F.lit(0)))), F.get(lists, F.lit(0)))))


def build_edges(sites: DataFrame) -> DataFrame:
    """caller, callee, conditions: one row per pair, from resolved sites (caller, callee, site_ord, conditions). Self-calls stay."""
    return sites.groupBy("caller", "callee").agg(merge_conditions(F.col("site_ord"), F.col("conditions")).alias("conditions"))


def build_references(sites: DataFrame) -> DataFrame:
    """referencer, target, kind, context: the distinct references, without those of a function to itself."""
    return sites.filter("referencer <> target").select("referencer", "target", "kind", "context").distinct()


def numbered_functions(functions: DataFrame, sites: list[str]) -> DataFrame:
    """The nodes of extracted functions, numbered by language, path and order in the file, with the columns ``sites``; they stay in the function's row."""
    stages = Stages(functions.sparkSession, "graph")
    keyed = functions.select(language_ordinal("language").alias("_l"), "path", "fn_ord", "name", "qualified_name", "language", "is_test", "line", "end_line", *sites)
    numbered = number_rows(stages.put(keyed), ["_l", "path", "fn_ord"], "id")
    return numbered.select("id", "name", "qualified_name", "language", F.col("path").alias("file"), "is_test", "line", "end_line", *sites)


def call_edges(nodes: DataFrame) -> DataFrame:
    """The edges of ``numbered_functions`` with their ids in the order of caller and callee.

    Edges grow with the square of the functions that share a name, so no edge is shuffled or sorted as a row: every name has one sorted list of
    its functions, the lists of a caller's names meet at the caller, and the last step counts the ids on from the edges of the callers before.
    """
    stages = Stages(nodes.sparkSession, "edges")
    # language and name as one key (a language has no such character)
    key = lambda language, name: F.when(language.isNotNull() & name.isNotNull(), F.concat_ws("\x01", language, name))
    named = nodes.select(key(F.col("language"), F.col("name")).alias("n_key"), "id").filter("n_key is not null")
    names = stages.put(named.groupBy("n_key").agg(F.sort_array(F.collect_list("id")).alias("callees")).withColumn("n", F.size("callees").cast("long")))
    raw = F.col("s.callee_name")
    sites = nodes.select(F.col("id").alias("caller"), "language", F.posexplode("call_sites").alias("site_ord", "s"))
    sites = sites.select("caller", "site_ord", key(F.col("language"), simple_name(raw)).alias("s_key"), qualifier(raw).alias("q"), F.col("s.conditions").alias("conditions")).filter("s_key is not null")
    known = salted_join(sites, names.select("n_key", "n"), "s_key", "n_key", F.col("caller"), "inner")
    # sites without a qualifier mean all functions of their name, so they are merged before these are listed
    site = F.struct("site_ord", "q", "conditions")
    groups = known.groupBy("caller", "s_key").agg(F.max("n").alias("n"), F.max(F.col("q").isNotNull()).alias("asked"), merge_conditions(F.col("site_ord"), F.col("conditions")).alias("conditions"), F.collect_list(site).alias("sites"))
    groups = stages.put(groups.withColumn("sites", F.when(F.col("asked"), F.col("sites"))))
    lists = groups.filter("not asked").select("caller", "s_key", "n", "conditions")
    own = None
    if not groups.filter("asked").isEmpty():
        own = stages.put(_qualified_lists(groups.filter("asked").select("caller", F.explode("sites").alias("s"), "s_key"), nodes, key))
    sizes = lists.select("caller", "n") if own is None else lists.select("caller", "n").unionByName(own.select("caller", "n"))
    starts, most = _starts(sizes, stages)
    full = salted_join(lists, names.select("n_key", "callees"), "s_key", "n_key", F.col("caller"), "inner").select("caller", "callees", "conditions")
    if own is not None:
        full = full.unionByName(own.select("caller", "callees", "conditions"))
    # the lists of a caller have no function in common; each callee carries the number of its list through the sort
    both = full.groupBy("caller").agg(F.collect_list(F.struct("callees", "conditions")).alias("lists")).join(starts, "caller")
    marked = F.sort_array(F.flatten(F.transform("lists", lambda x, i: F.transform(x["callees"], lambda c: c * F.lit(most) + i))))
    rows = both.select("caller", "start", F.transform("lists", lambda x: x["conditions"]).alias("c"), F.posexplode(marked).alias("at", "m"))
    return rows.select((F.col("start") + F.col("at")).alias("edge_id"), "caller", F.expr(f"m DIV {most}").alias("callee"), F.get("c", (F.col("m") % F.lit(most)).cast("int")).alias("conditions"))


def _qualified_lists(sites: DataFrame, nodes: DataFrame, key) -> DataFrame:
    """caller, callees, n, conditions of callers and names of which some site has a qualifier: a list for each set of conditions."""
    s = sites.select(F.concat_ws("/", "caller", "s.site_ord").alias("site"), "caller", "s_key", "s.site_ord", "s.q", "s.conditions")
    found = candidates(s, nodes, key(F.col("language"), F.col("name")), ["caller", "site_ord", "conditions"]).withColumnRenamed("target", "callee")
    return build_edges(found).groupBy("caller", "conditions").agg(F.sort_array(F.collect_list("callee")).alias("callees")).select("caller", "callees", F.size("callees").cast("long").alias("n"), "conditions")


def _starts(sizes: DataFrame, stages: Stages, bucket: int = 1 << 16) -> tuple[DataFrame, int]:
    """(caller and the number of edges of all callers before it, most lists of a caller); ids of callers are dense, so a bucket of them is bounded."""
    per = stages.put(sizes.groupBy("caller").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).withColumn("b", F.expr(f"caller DIV {bucket}")))
    most = per.agg(F.max("k")).collect()[0][0] or 1
    totals = per.groupBy("b").agg(F.sum("n").alias("t"))
    before = totals.select("b", (F.sum("t").over(Window.orderBy("b")) - F.col("t")).alias("o"))  # one row per bucket
    within = F.sum("n").over(Window.partitionBy("b").orderBy("caller")) - F.col("n")
    return per.withColumn("w", within).join(F.broadcast(before), "b").select("caller", (F.col("o") + F.col("w")).cast("long").alias("start")), most


def build_graph(functions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, references) of extracted functions, with ids in their fixed order."""
    nodes = numbered_functions(functions, ["call_sites", "reference_sites"])
    plain = nodes.select("id", "name", "qualified_name", "language", "file", "is_test", "line", "end_line")
    marks = nodes.select(F.col("id").alias("referencer"), "language", F.posexplode("reference_sites").alias("site_ord", "s")).select("referencer", "language", "site_ord", F.col("s.target_name").alias("raw"), F.col("s.kind").alias("kind"), F.col("s.context").alias("context"))
    marks = marks.withColumn("site", F.concat_ws("/", "referencer", "site_ord"))
    found = build_references(resolve(marks, plain, "raw", ["site", "referencer", "kind", "context"]))
    order = [F.col("referencer"), F.col("target"), F.col("context").asc_nulls_first()]
    references = number_rows(found, order, "ref_id").select("ref_id", "referencer", "target", "kind", "context")
    return plain, call_edges(nodes), references


def merge_graphs(spark: SparkSession, graphs: list[tuple[DataFrame, DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Graphs one after the other, each graph's ids moved behind those of the graphs before; no graph gives empty tables."""
    out = [small_table(spark, [], s) for s in (NODES, EDGES, REFERENCES)]
    n = e = r = 0
    for nodes, edges, refs in graphs:
        out[0] = out[0].unionByName(nodes.withColumn("id", F.col("id") + n))
        out[1] = out[1].unionByName(edges.withColumns({"edge_id": F.col("edge_id") + e, "caller": F.col("caller") + n, "callee": F.col("callee") + n}))
        out[2] = out[2].unionByName(refs.withColumns({"ref_id": F.col("ref_id") + r, "referencer": F.col("referencer") + n, "target": F.col("target") + n}))
        n, e, r = n + nodes.count(), e + edges.count(), r + refs.count()
    return tuple(out)


def clean_edges(edges: DataFrame) -> DataFrame:
    """edge_id, caller, callee, conditions with one row per pair: repeats and several ids of a pair are merged as sites in edge-id order."""
    rows = edges.filter("caller is not null and callee is not null").select("edge_id", "caller", "callee", "conditions").dropDuplicates(["edge_id", "caller", "callee"])
    return rows.groupBy("caller", "callee").agg(F.min("edge_id").alias("edge_id"), merge_conditions(F.col("edge_id"), F.col("conditions")).alias("conditions")).select("edge_id", "caller", "callee", "conditions")


def clean_references(refs: DataFrame) -> DataFrame:
    """ref_id, referencer, target, kind, context: distinct references between two functions, kinds in lower case."""
    rows = refs.filter("referencer is not null and target is not null and referencer <> target")
    kind = F.lower(F.coalesce("kind", F.lit("argument")))
    return rows.groupBy("referencer", "target", kind.alias("kind"), "context").agg(F.min("ref_id").alias("ref_id")).select("ref_id", "referencer", "target", "kind", "context")


def heat(edges: DataFrame, refs: DataFrame) -> DataFrame:
    """id, heat: incoming call edges and references of every function that has any, counted by one grouping."""
    both = edges.select(F.col("callee").alias("id")).unionByName(refs.select(F.col("target").alias("id")))
    return both.filter("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("heat"))


def callers(seeds: DataFrame, edges: DataFrame, depth: int = 1) -> DataFrame:
    """seed, caller, depth, edge_id, conditions: who reaches each seed within ``depth`` calls.

    All seeds go on together. In each level the incoming edges of a level's callers are taken in the order in which these were found, then by
    edge id; the first edge to reach a new caller stands for it. A seed never lists itself. Depth 0 gives no rows.
    """
    stages = Stages(seeds.sparkSession, "callers")
    into = edges.select(F.col("callee").alias("_to"), F.col("caller").alias("c"), "edge_id", "conditions")
    if not written(edges):
        into = stages.put(into)
    hot = hot_counts(into, "_to")
    # the place in the order is the edges of the path from the seed, compared from the first: no numbers have to be dealt out within a seed
    front = stages.put(seeds.select(F.col("seed").cast("long").alias("seed")).filter("seed is not null").distinct().withColumns({"at": F.col("seed"), "place": F.array().cast("array<bigint>")}))
    seen = front.select(F.col("seed").alias("s"), F.col("at").alias("v"))
    out = None
    for level in range(1, depth + 1):
        # a hot callee's edges are spread, and its few entries of the front repeated
        step = salted_join(into, front, "_to", "at", F.col("edge_id"), "inner", hot)
        fresh = step.join(seen, (step["seed"] == seen["s"]) & (step["c"] == seen["v"]), "left_anti")
        first = fresh.groupBy("seed", "c").agg(F.min(F.struct("place", "edge_id", "conditions")).alias("b")).select("seed", F.col("c").alias("at"), F.concat("b.place", F.array("b.edge_id")).alias("place"), F.col("b.conditions").alias("conditions"))
        first = stages.put(first)
        rows = first.select("seed", F.col("at").alias("caller"), F.lit(level).cast("long").alias("depth"), F.element_at("place", -1).alias("edge_id"), "conditions")
        out = rows if out is None else out.unionByName(rows)
        if level < depth:
            if first.isEmpty():
                break
            front = first.select("seed", "at", "place")
            seen = seen.unionByName(front.select(F.col("seed").alias("s"), F.col("at").alias("v")))
    if out is None:
        return small_table(seeds.sparkSession, [], "seed long, caller long, depth long, edge_id long, conditions array<string>")
    return out


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id of the nodes that nothing calls; a call of itself counts as a call."""
    return nodes.select("id").distinct().join(edges.select(F.col("callee").alias("id")).filter("id is not null").distinct(), "id", "left_anti")


def simple_paths(nodes: DataFrame, edges: DataFrame, starts: DataFrame | None = None, max_depth: int = MAX_DEPTH, max_paths: int | None = MAX_PATHS) -> DataFrame:
    """path_id, chain: the call paths from every root, in the order of a depth-first walk by ids.

    A path ends where every callee is on it already or at ``max_depth`` functions; the first ``max_paths`` in that order are kept, the limit
    that the analysis has.
    """
    stages = Stages(nodes.sparkSession, "paths")
    first = (starts if starts is not None else roots(nodes, edges)).select("id")
    nxt = edges.filter("caller is not null and callee is not null").select(F.col("caller").alias("_from"), F.col("callee").alias("_to")).distinct()
    open_ = stages.put(first.select(F.array("id").alias("chain"), F.col("id").alias("tip")))
    ended = None
    for length in range(1, max_depth + 1):
        if length == max_depth:
            done = open_.select("chain")
            ended = done if ended is None else ended.unionByName(done)
            break
        grown = open_.join(nxt, F.col("tip") == F.col("_from"), "left")
        goes = F.col("_to").isNotNull() & ~F.array_contains("chain", F.col("_to"))
        step = stages.put(grown.select("chain", "_to", goes.alias("goes")))
        more = step.filter("goes").select(F.concat("chain", F.array("_to")).alias("chain"), F.col("_to").alias("tip"))
        stuck = step.groupBy("chain").agg(F.max("goes").alias("any")).filter("not any").select("chain")
        ended = stuck if ended is None else ended.unionByName(stuck)
        n = more.count()
        if not n:
            break
        # every open chain ends in one path at least, so those behind the first `max_paths` in order need not grow
        open_ = more if max_paths is None or n <= max_paths else stages.put(more.orderBy("chain").limit(max_paths))
    numbered = number_rows(ended, ["chain"], "path_id").select("path_id", "chain")
    return numbered if max_paths is None else numbered.filter(F.col("path_id") < max_paths)


def describe(rows: DataFrame, key: str, nodes: DataFrame, heats: DataFrame, spread: str) -> DataFrame:
    """``rows`` with file, function, is_test, line and heat (0 where it has none) of the function in ``key``; rows of unknown functions are left out.

    ``rows`` should be written or cheap. Functions and heats, one row each per id, meet first; then a function with very many rows is spread by
    the hash of ``spread``.
    """
    known = nodes.select(F.col("id").alias("_n"), "file", F.col("name").alias("function"), "is_test", "line").join(heats.select(F.col("id").alias("_h"), "heat"), F.col("_n") == F.col("_h"), "left").drop("_h")
    return salted_join(rows, known, key, "_n", F.col(spread), "inner").drop("_n").withColumn("heat", F.coalesce("heat", F.lit(0)))
