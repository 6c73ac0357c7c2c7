"""Merging consecutive matches into blocks, and the lines a block shows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def merge_blocks(matches: DataFrame, key: str, at: str, same: str) -> DataFrame:
    """``matches`` with block, numbered from 1 per key: neighbours in order of ``at`` whose ``same`` is equal and not null share a block.

    Rows with a null ``same`` never merge, and an equal value that comes back later begins another block.
    """
    w = Window.partitionBy(key).orderBy(at)
    prev = F.lag(same).over(w)
    starts = F.when(F.col(same).isNotNull() & prev.eqNullSafe(F.col(same)), 0).otherwise(1)
    return matches.withColumn("_new", starts).withColumn("block", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")


def block_lines(blocks: DataFrame, lines: DataFrame, before: int, after: int, key: str = "path") -> DataFrame:
    """key, block, line_number, text, is_match: matching lines of every block and the context around them, each line once per block.

    A line between two blocks may show in both.
    """
    spans = blocks.select(F.col(key).alias("_k"), "block", F.col("line_number").alias("_m"), F.explode(F.sequence(F.greatest(F.col("line_number") - before, F.lit(1)), F.col("line_number") + after)).alias("_l"))
    want = spans.groupBy("_k", "block", "_l").agg(F.max((F.col("_l") == F.col("_m")).cast("int")).alias("hit"))
    return lines.join(want, (lines[key] == want["_k"]) & (lines["line_number"] == want["_l"])).select(key, "block", "line_number", "text", (F.col("hit") == 1).alias("is_match"))
