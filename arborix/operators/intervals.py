"""The innermost interval of a group around a point."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines per bucket: a group with very many intervals is joined bucket by bucket.
BUCKET = 256


def enclosing(points: DataFrame, intervals: DataFrame, group: str, at: str, start: str, end: str, ident: str, keep: list[str], bucket: int | None = BUCKET) -> DataFrame:
    """``points`` with the columns ``keep`` of the interval of the same group around each point, null where there is none.

    Of several intervals the one that starts last holds, of equal starts the one with the largest ``ident``. Intervals that end at 0 or are null
    anywhere enclose nothing. Points may repeat; each keeps its row.

    The join is an equi-join on group and bucket of lines with the range as a residual: an interval is repeated once per bucket it spans,
    so neither a group with many intervals nor a pair count can blow up one task, and the choice is one aggregation per point.
    """
    iv = intervals.filter((F.col(end) != 0) & F.col(start).isNotNull() & F.col(group).isNotNull()).select(F.col(group).alias("_g"), F.col(start).alias("_s"), F.col(end).alias("_e"), F.struct(F.col(start).alias("_s"), F.col(ident).alias("_i"), *keep).alias("_v"))
    probe = points.select(F.col(group).alias("_pg"), F.col(at).alias("_at")).distinct()
    cond = (F.col("_pg") == F.col("_g")) & F.col("_at").between(F.col("_s"), F.col("_e"))
    if bucket:
        iv = iv.filter(F.col("_e") >= F.col("_s")).withColumn("_b", F.explode(F.sequence(F.expr(f"_s div {bucket}"), F.expr(f"_e div {bucket}"))))
        probe = probe.withColumn("_pb", F.expr(f"_at div {bucket}"))
        cond = cond & (F.col("_pb") == F.col("_b"))
    # once per distinct place, then back to the points
    best = probe.join(iv, cond).groupBy("_pg", "_at").agg(F.max("_v").alias("_best"))
    best = best.select("_pg", "_at", *[F.col(f"_best.{k}").alias(k) for k in keep])
    return points.join(best, (F.col(group) == F.col("_pg")) & (F.col(at) == F.col("_at")), "left").drop("_pg", "_at")
