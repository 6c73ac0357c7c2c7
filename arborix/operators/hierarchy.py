"""Parent-child rows to full hierarchies: path, depth, root, descendants and circles.

Method: nodes whose hash falls on 1 of ``rate`` and all roots are splitters. Every node walks upwards to its next splitter; the walks are
doubled in each round, so a stretch of g nodes takes log2(g) joins. The splitters alone then form a graph smaller by ``rate`` that is solved
the same way up to the roots, and each node's path is its splitter's path followed by its own stretch. A walk that can still end shrinks the
set of open nodes in every round (the nodes of its path lie at every distance below its own), so when that set stops shrinking, the rest runs
in circles.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Stages
from .skew import salted_join

RATE = 8


@dataclass
class Hierarchy:
    """``nodes``: node_id, root_id, depth, chain ARRAY<BIGINT> from root to node; ids on or below a circle have -1, -1 and an empty chain."""

    nodes: DataFrame
    parents: DataFrame
    stages: Stages


def parents_of(links: DataFrame, child: str, parent: str, order: list[str]) -> DataFrame:
    """One row (node, parent) per id: the last link of each child by ``order`` holds; parents that are nobody's child get a null parent.

    Links with a null child are dropped. Links alike in all of ``order`` are told apart by the larger parent, null lowest.
    """
    held = (
        links.filter(F.col(child).isNotNull())
        .groupBy(F.col(child).cast("long").alias("node"))
        .agg(F.max(F.struct(*order, F.col(parent).cast("long").alias("_p"))).alias("h"))
        .select("node", F.col("h._p").alias("parent"))
    )
    # children and parents grouped together tell which ids have no link of their own, without an anti-join on a hot parent
    both = held.select("node", "parent", F.lit(1).alias("own")).unionByName(
        held.filter("parent is not null").select(F.col("parent").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(0).alias("own"))
    )
    return both.groupBy("node").agg(F.max(F.when(F.col("own") == 1, F.col("parent"))).alias("parent"))


def _walk(rows: DataFrame, stages: Stages, stop) -> tuple[DataFrame, int]:
    """Double the walks of ``rows`` (node, up, seg, open) until no open one can end.

    ``open`` rows look up the row of ``up``: its stretch is put before theirs, and its ``up`` becomes theirs; ``stop`` says from the looked-up
    row whether the walk ends. Returns all rows, of which those still open run in circles, and their number.
    """
    whole = stages.put(rows, split="open")
    done = [whole.filter("not open")]
    active = whole.filter("open")
    left = active.count()
    while left:
        table = active
        for d in done:
            table = table.unionByName(d)
        look = table.select(F.col("node").alias("l_node"), F.col("up").alias("l_up"), F.col("seg").alias("l_seg"), F.col("open").alias("l_open"))
        step = stages.put(stop(salted_join(active, look, "up", "l_node", F.col("node"))), split="open")
        active = step.filter("open")
        done.append(step.filter("not open"))
        n = active.count()
        if n == left:
            break
        left = n
    out = active
    for d in done:
        out = out.unionByName(d)
    return out, left


def build(links: DataFrame, child: str, parent: str, order: list[str], rate: int = RATE) -> Hierarchy:
    """The hierarchy of a link table (see Hierarchy). Empty input gives empty results; extra columns are ignored."""
    stages = Stages(links.sparkSession, "hierarchy")
    parents = stages.put(parents_of(links, child, parent, order))
    splits = lambda c: F.pmod(F.xxhash64(c), F.lit(rate)) == 0

    # to the next splitter; a root row has no `up` and ends every walk that looks it up
    start = parents.select("node", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), F.array().cast("array<long>")).otherwise(F.array("node")).alias("seg"), (F.col("parent").isNotNull() & ~splits(F.col("parent"))).alias("open"))

    def to_splitter(j: DataFrame) -> DataFrame:
        root = F.col("l_up").isNull()
        return j.select("node", F.when(root, F.col("up")).otherwise(F.col("l_up")).alias("up"), F.when(root, F.col("seg")).otherwise(F.concat("l_seg", "seg")).alias("seg"), (~root & F.col("l_open")).alias("open"))

    walked, _ = _walk(start, stages, to_splitter)

    # the graph of splitters and roots; `up` null: the stretch begins at the root
    reduced = walked.filter(F.col("up").isNull() | splits(F.col("node"))).select(
        "node",
        F.when(F.col("open"), F.lit(-1)).otherwise(F.col("up")).alias("up"),
        F.when(F.col("up").isNull(), F.array("node")).otherwise(F.col("seg")).alias("seg"),
        (F.col("up").isNotNull() & ~F.col("open")).alias("open"),
        F.col("open").alias("lost"),
    )

    def to_root(j: DataFrame) -> DataFrame:
        # a looked-up row that is lost (`up` -1, not open) ends the walk as lost, and so does a stretch that comes back to its own end: stretches
        # on circles grow to the circle's length, not to that of the deepest chain
        lost = F.col("l_node").isNull() | (~F.col("l_open") & F.col("l_up").isNotNull()) | F.array_contains("l_seg", F.col("node"))
        return j.select("node", F.when(lost, F.lit(-1)).otherwise(F.col("l_up")).cast("long").alias("up"), F.when(lost, F.array().cast("array<long>")).otherwise(F.concat("l_seg", "seg")).alias("seg"), (~lost & F.col("l_up").isNotNull()).alias("open"))

    solved, _ = _walk(reduced.drop("lost").withColumn("up", F.col("up").cast("long")), stages, to_root)
    heads = solved.filter("up is null").select(F.col("node").alias("h_node"), F.col("seg").alias("h_seg"))

    placed = salted_join(walked, heads, "up", "h_node", F.col("node"))
    chain = F.when(F.col("up").isNull(), F.array("node")).when(F.col("open") | F.col("h_node").isNull(), F.array().cast("array<long>")).otherwise(F.concat("h_seg", "seg"))
    nodes = placed.select(F.col("node").alias("node_id"), chain.alias("chain")).select(
        "node_id",
        F.when(F.size("chain") > 0, F.get("chain", F.lit(0))).otherwise(F.lit(-1)).cast("long").alias("root_id"),
        F.when(F.size("chain") > 0, F.size("chain") - 1).otherwise(F.lit(-1)).cast("long").alias("depth"),
        "chain",
    )
    return Hierarchy(nodes, parents, stages)


def paths(h: Hierarchy) -> DataFrame:
    """node_id, root_id, depth, path: the ids from the root to the node joined by ``/``."""
    return h.nodes.select("node_id", "root_id", "depth", F.concat_ws("/", F.col("chain").cast("array<string>")).alias("path"))


def descendants(h: Hierarchy) -> DataFrame:
    """node_id, descendant_id, distance: one row for every function below every function, as many as the paths have steps."""
    return h.nodes.filter(F.size("chain") > 1).select(F.col("node_id").alias("descendant_id"), "depth", F.posexplode("chain").alias("at", "node_id")).filter(F.col("at") < F.col("depth")).select("node_id", "descendant_id", (F.col("depth") - F.col("at")).cast("long").alias("distance"))


def circles(h: Hierarchy) -> DataFrame:
    """node_id, circle_id, on_circle of the ids without a root: the smallest id of the circle they run into, and whether they lie on it.

    Jumps are doubled until they are at least as long as there are such ids: then every jump ends on the circle and every id on a circle is
    the end of some jump.
    """
    st = h.stages
    lost = h.nodes.filter(F.size("chain") == 0).select(F.col("node_id").alias("node"))
    jump = st.put(lost.join(h.parents, "node").select("node", F.col("parent").alias("to"), F.col("node").alias("least")))
    n, length = jump.count(), 1
    while length <= n:
        look = jump.select(F.col("node").alias("l_node"), F.col("to").alias("l_to"), F.col("least").alias("l_least"))
        before, jump = jump, st.put(salted_join(jump, look, "to", "l_node", F.col("node"), "inner").select("node", F.col("l_to").alias("to"), F.least("least", "l_least").alias("least")))
        st.drop(before)
        length *= 2
    on = jump.select(F.col("to").alias("c_node")).distinct()
    least = jump.join(on, F.col("node") == F.col("c_node")).select(F.col("node").alias("e_node"), F.col("least").alias("circle_id"))
    return salted_join(jump, least, "to", "e_node", F.col("node"), "inner").join(on, F.col("node") == F.col("c_node"), "left").select(F.col("node").alias("node_id"), "circle_id", F.col("c_node").isNotNull().alias("on_circle"))
