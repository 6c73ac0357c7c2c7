"""The top N of every group by a global sort (p5).

All rows are range-partitioned and sorted once by group, score and identifier. Each partition numbers its rows group by group and keeps the
first N; the sizes of the group parts in the partitions before give each kept row its exact position in the whole group. No group is ever held
by one task, however large it is, and the values by which rows are sorted never leave the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from ..session import Stages


def top_n(rows: DataFrame, group: list[str], order: list[Column], ident: str, n: int) -> DataFrame:
    """``group``, ``ident`` and rnk (1 to ``n``) of the first ``n`` rows of every group by ``order``.

    ``order`` must end in a unique column for a fixed result. Nulls in group columns form groups of their own. Empty input: no rows.
    """
    kinds = {f.name: StructField(f.name, f.dataType) for f in rows.schema}  # the rows of sizes have nulls where a column may have none
    schema = StructType([kinds[g] for g in group] + [kinds[ident], StructField("_rn", LongType()), StructField("_pid", LongType()), StructField("_n", LongType())])

    def number(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Kept rows have _rn; for each group part of the partition one row without it has the part's size in _n."""
        last, count, pid = None, 0, -1
        for f in frames:
            if not len(f):
                continue
            pid = int(f["_pid"].iloc[0])
            codes = np.zeros(len(f), dtype=bool)
            codes[0] = True
            for g in group:
                v = f[g]
                prev = v.shift(1)
                codes[1:] |= ~((v == prev) | (v.isna() & prev.isna())).to_numpy(dtype=bool, na_value=False)[1:]
            starts = np.flatnonzero(codes)
            first = tuple(None if pd.isna(x) else x for x in f[group].iloc[0])
            goes_on = last is not None and first == last
            if last is not None and not goes_on:
                yield _part(last, pid, count)
                count = 0
            rn = np.arange(len(f)) - np.repeat(starts, np.diff(np.append(starts, len(f)))) + 1
            if goes_on:
                end = starts[1] if len(starts) > 1 else len(f)
                rn[:end] += count
            keep = rn <= n
            out = f.loc[keep, group + [ident]].copy()
            out["_rn"], out["_pid"], out["_n"] = rn[keep], pid, None
            out["_n"] = out["_n"].astype("Int64")
            yield out
            if len(starts) > 1:
                # all parts that end in this batch
                ends = starts[1:] - 1
                done = f.iloc[ends][group].copy()
                done[ident] = None
                done["_rn"] = pd.array([None] * len(done), dtype="Int64")
                done["_pid"], done["_n"] = pid, rn[ends]
                yield done
            last = tuple(None if pd.isna(x) else x for x in f[group].iloc[-1])
            count = int(rn[-1])
        if last is not None:
            yield _part(last, pid, count)

    def _part(key: tuple, pid: int, count: int) -> pd.DataFrame:
        out = pd.DataFrame([dict(zip(group, key)) | {ident: None}], dtype=object)
        out["_rn"] = pd.array([None], dtype="Int64")
        out["_pid"], out["_n"] = pid, count
        return out

    keys = [F.col(g).asc_nulls_first() for g in group]
    sorted_ = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).select(*group, ident, F.spark_partition_id().cast("long").alias("_pid"))
    kept = Stages(rows.sparkSession, "topn").put(sorted_.mapInPandas(number, schema))
    # a group has one part per partition it reaches into; the sum of the parts before is what a part's rows are behind
    before = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = kept.filter("_rn is null").withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    # only parts behind others move their rows; they are at most one per partition
    moved = parts.filter("_before > 0").select(*[F.col(g).alias(f"m_{g}") for g in group], F.col("_pid").alias("m_pid"), "_before")
    on = F.col("_pid") == F.col("m_pid")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"m_{g}"))
    out = kept.filter("_rn is not null").join(moved, on, "left").withColumn("rnk", F.col("_rn") + F.coalesce("_before", F.lit(0)))
    return out.filter(F.col("rnk") <= n).select(*group, ident, "rnk")


def top_context(entries: DataFrame, n: int = 5) -> DataFrame:
    """seed, section, entry_id, rnk: the ``n`` hottest entries of every seed and section, tests and others each for themselves.

    Null heat counts as 0. Of entries alike in seed, section, is_test, file, line and function the one of highest heat, then smallest
    entry_id, counts. Order: heat descending, then file, line, function and entry_id, nulls first. Repeated rows count once. A null seed,
    section or is_test is a group of its own.
    """
    alike = ["seed", "section", "is_test", "file", "line", "function"]
    one = (
        entries.select(*alike, F.coalesce("heat", F.lit(0)).cast("long").alias("heat"), "entry_id")
        .groupBy(*alike)
        .agg(F.max(F.struct(F.col("heat"), (-F.col("entry_id")).alias("o"))).alias("b"))
        .select(*alike, F.col("b.heat").alias("heat"), (-F.col("b.o")).alias("entry_id"))
    )
    order = [F.col("heat").desc(), *(F.col(c).asc_nulls_first() for c in ("file", "line", "function", "entry_id"))]
    return top_n(one, ["seed", "section", "is_test"], order, "entry_id", n).select("seed", "section", "entry_id", "rnk")
