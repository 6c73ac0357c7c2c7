"""Mixing sources to target weights by weighted fair queueing (p8).

The documents of a source queue in a shuffled order, over and over up to the source's number of repeats. A document's virtual finish time is
the tokens of its source up to and with it, divided by the source's weight; all queues are merged by that time and cut at the mix's budget. While
every source has documents, the tokens stand in the ratio of the weights; a source that runs out leaves its part to the others.

Both sums run over a global sort: each partition adds up its own rows as they pass, and one row per partition and source tells how much lies
before. Occurrences whose finish time lies so late that the budget is spent before them, whatever the order of documents, are never made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import Stages, small_table
from .tokens import count_tokens


def source_key(c: str):
    """Sources count alike whatever the case, outer spaces or hyphens for underscores."""
    return F.regexp_replace(F.lower(F.trim(F.col(c))), "-", "_")


def running_sums(rows: DataFrame, group: str, order: list[str], value: str, name: str, stages: Stages) -> DataFrame:
    """``rows`` with ``name``, the sum of ``value`` (non-negative, BIGINT) over the rows of its ``group`` (BIGINT) up to and with each by ``order``."""
    kinds = dict(rows.dtypes)
    at, by = rows.columns.index(value), rows.columns.index(group)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        pid = context.partitionId() if context else 0
        last, carry = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            g, v = np.asarray(b.column(by)), np.asarray(b.column(at))
            starts = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            sums = np.cumsum(v)
            base = np.append(0, sums[starts[1:] - 1])  # what lies before each group in the batch
            if g[0] == last:
                base[0] -= carry
            sums = sums - np.repeat(base, np.diff(np.append(starts, len(g))))
            last, carry = g[-1], int(sums[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sums), pa.array(np.full(len(g), pid, np.int32))], [*b.schema.names, "_in", "_pid"])

    part = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).mapInArrow(add, ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + ", _in long, _pid int")
    part = stages.put(part)
    sums = part.groupBy("_pid", group).agg(F.max("_in").alias("_sum"))
    # a group has one row per partition that it reaches into
    before = sums.select(F.col("_pid").alias("_p"), F.col(group).alias("_of"), (F.sum("_sum").over(Window.partitionBy(group).orderBy("_pid")) - F.col("_sum")).alias("_before"))
    return part.join(F.broadcast(before), (F.col("_pid") == F.col("_p")) & (F.col(group) == F.col("_of"))).withColumn(name, F.col("_in") + F.col("_before")).select(*rows.columns, name)


def _last_time(supply: list[tuple[float, int]], needed: int) -> float:
    """The first time at which queues of (weight, tokens they can give in all), each giving its weight per unit of time, have given ``needed``."""
    ends = sorted((t / w, w) for w, t in supply)
    given, now, speed = 0.0, 0.0, sum(w for w, _ in supply)
    for end, w in ends:
        if given + (end - now) * speed >= needed:
            return now + (needed - given) / speed
        given, now, speed = given + (end - now) * speed, end, speed - w
    return float("inf")


def mix(docs: DataFrame, targets: DataFrame, seed: int = 7, sizes: DataFrame | None = None) -> DataFrame:
    """doc_id, source, turn, tokens, running: the drawn occurrences, running being the mix's tokens up to and with each.

    ``docs``: doc_id, text, source. ``targets``: source, target_share, max_repeats, total_ratio. The budget is total_ratio times the tokens of
    all documents, of whatever source. A source listed twice counts with its larger share and repeats; sources with no share, no repeats or no
    documents draw nothing, and no documents at all give no rows. Null texts have no tokens; a null source matches no target.
    """
    stages = Stages(docs.sparkSession, "mix")
    if sizes is None:
        sizes = stages.put(count_tokens(docs.select("doc_id", source_key("source").alias("source"), "text"), ["doc_id", "source"]))
    want = targets.select(source_key("source").alias("source"), F.col("target_share").cast("double").alias("weight"), F.col("max_repeats").cast("int").alias("repeats")).filter("source is not null and weight > 0 and repeats > 0").groupBy("source").agg(F.max("weight").alias("weight"), F.max("repeats").alias("repeats"))
    ratio = targets.agg(F.max("total_ratio")).collect()[0][0] or 0.0
    budget = int((sizes.agg(F.sum("tokens")).collect()[0][0] or 0) * ratio)
    # targets list the sources of the mix, a table of fixed size; so do the sums per source
    per = sizes.filter("tokens > 0").groupBy("source").agg(F.sum("tokens").alias("all_"), F.max("tokens").alias("most")).join(F.broadcast(want), "source").orderBy("source").collect()
    # of what has finished by a time, each queue may hold back one document; so behind the time at which the queues have given the budget and
    # their largest documents, nothing fits
    end = _last_time([(r["weight"], r["all_"] * r["repeats"]) for r in per], budget + sum(r["most"] for r in per) + 1)
    table = small_table(docs.sparkSession, [(r["source"], i, r["weight"], r["repeats"], r["all_"]) for i, r in enumerate(per)], "source string, _g long, weight double, repeats int, _all long")
    rows = sizes.filter("tokens > 0").join(F.broadcast(table.select("source", "_g")), "source").select("_g", F.xxhash64(F.lit(seed), "doc_id").alias("_h"), "doc_id", F.col("tokens").cast("long").alias("tokens"))
    queue = running_sums(rows, "_g", ["_h", "doc_id"], "tokens", "_upto", stages).join(F.broadcast(table), "_g")
    turns = F.col("repeats") - 1
    if end != float("inf"):
        turns = F.least(turns, F.ceil((F.lit(end) * F.col("weight") - F.col("_upto")) / F.col("_all")).cast("int"))
    placed = queue.withColumn("turn", F.explode(F.sequence(F.lit(0), turns, F.lit(1)))) if end == float("inf") else queue.withColumn("turn", F.explode(F.when(turns >= 0, F.sequence(F.lit(0), turns, F.lit(1)))))
    finish = (F.col("turn").cast("long") * F.col("_all") + F.col("_upto")) / F.col("weight")
    merged = placed.select(F.lit(0).cast("long").alias("_one"), finish.alias("_finish"), "source", "doc_id", "turn", "tokens")
    return running_sums(merged, "_one", ["_finish", "source", "doc_id", "turn"], "tokens", "running", stages).filter(F.col("running") <= budget).select("doc_id", "source", "turn", "tokens", "running")


def shares(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, n_drawn, n_documents, most_turns, tokens, reached_share of every listed source, also of those that drew nothing."""
    got = drawn.groupBy("source").agg(F.count(F.lit(1)).alias("n_drawn"), F.count_if(F.col("turn") == 0).alias("n_documents"), (F.max("turn") + 1).cast("long").alias("most_turns"), F.sum("tokens").alias("tokens"))
    want = targets.select(source_key("source").alias("source"), "target_share").filter("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"))
    all_ = want.join(got, "source", "left").fillna(0, ["n_drawn", "n_documents", "most_turns", "tokens"])
    total = F.sum("tokens").over(Window.partitionBy())  # one row per source
    return all_.select("source", "target_share", "n_drawn", "n_documents", "most_turns", "tokens", F.when(total > 0, F.col("tokens") / total).otherwise(F.lit(0.0)).alias("reached_share"))
