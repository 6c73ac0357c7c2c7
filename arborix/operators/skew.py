"""Joins and per-key results that do not depend on how rows fall on keys."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import Stages, shuffle_width, small_table

#: So many rows of a key burden no task, however few rows the others have.
SMALL = 1000


def hot_counts(df: DataFrame, key: str) -> tuple[dict, int]:
    """(rows of each hot key, rows from which a key is hot). A key is hot if it has more non-null rows than a task has on average.

    So there are fewer hot keys than shuffle partitions, by the pigeonhole principle, and only those reach the driver. Counts are combined on the
    map side; total and largest count come from one pass, and without a hot key there is no other. ``df`` is read once or twice: it should be a
    written table or cheap.
    """
    counts = df.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    total, most = counts.agg(F.sum("n"), F.max(F.when(F.col("k").isNotNull(), F.col("n")))).collect()[0]
    line = max((total or 0) // shuffle_width(df.sparkSession), SMALL)
    if (most or 0) <= line:
        return {}, line
    return {r["k"]: r["n"] for r in counts.filter(F.col("k").isNotNull() & (F.col("n") > line)).collect()}, line


def hot_counts_of(df: DataFrame, keys: list[str]) -> dict[str, tuple[dict, int]]:
    """``hot_counts`` of several columns of one type, by one pass over ``df``: fewer than shuffle partitions times columns rows reach the driver."""
    each = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("k")) for i, c in enumerate(keys)])).alias("x")).select("x.i", "x.k")
    line = max(df.count() // shuffle_width(df.sparkSession), SMALL)
    found = each.filter("k is not null").groupBy("i", "k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > line).collect()
    return {c: ({r["k"]: r["n"] for r in found if r["i"] == i}, line) for i, c in enumerate(keys)}


def hot_keys(df: DataFrame, key: str) -> list:
    """The hot keys (see ``hot_counts``)."""
    return list(hot_counts(df, key)[0])


def salted_join(big: DataFrame, small: DataFrame, big_key: str, small_key: str, spread: Column, how: str = "left", hot: tuple[dict, int] | None = None) -> DataFrame:
    """Equi-join in which the rows of a hot key of ``big`` are spread over as many tasks as they are worth.

    A hot key with n rows is cut into n / line parts by the hash of ``spread``, a column of ``big``, and its rows in ``small`` are repeated once
    per part; since the hot keys together have no more rows than ``big``, that makes fewer than two rows per shuffle partition where ``small`` is
    unique on its key. The other rows are shuffled once. Only the list of hot keys, shorter than the number of shuffle partitions, is
    broadcast. Null keys match nothing (``how='left'`` keeps the row). Columns other than the key must not clash.
    ``hot`` gives the counts where they are known.
    """
    counts, line = hot_counts(big, big_key) if hot is None else hot
    if not counts:
        return big.join(small, big[big_key] == small[small_key], how)
    kind = dict(big.dtypes)[big_key]
    parts = small_table(big.sparkSession, [(k, -(-n // line)) for k, n in counts.items()], f"_hot {kind}, _parts long")
    width = shuffle_width(big.sparkSession)
    # rows without a key cannot match, so they are spread as well
    salt = F.pmod(F.xxhash64(spread), F.when(F.col(big_key).isNull(), F.lit(width)).otherwise(F.coalesce("_parts", F.lit(1))))
    b = big.join(F.broadcast(parts), big[big_key] == F.col("_hot"), "left").withColumn("_salt", salt).drop("_hot", "_parts")
    s = small.join(F.broadcast(parts), small[small_key] == F.col("_hot"), "left").withColumn("_salt_s", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)) - 1))).drop("_hot", "_parts")
    return b.join(s, (F.col(big_key) == F.col(small_key)) & (F.col("_salt") == F.col("_salt_s")), how).drop("_salt", "_salt_s")


def exact_quantiles(pairs: DataFrame, probs: dict[str, float], bins: int = 256, stages: Stages | None = None) -> DataFrame:
    """Exact discrete quantiles of ``value`` per ``key``, without gathering the values of a heavy key.

    ``pairs`` has ``key`` and a BIGINT ``value``; null values are ignored. Result: key, n, and one column per entry of ``probs``: the value
    of rank ``max(1, ceil(p * n))`` in ascending order, the rule of SQL's PERCENTILE_DISC. Keys without a value are left out.

    Keys with more rows than a task has on average (fewer than there are shuffle partitions) are resolved by distributed selection: each round
    counts the values of the key's open interval in ``bins`` equal bins (counts merge on the map side, at most ``bins`` numbers a key and
    quantile leave a task), keeps the bin that holds the rank and stops when a bin is one value wide; 64-bit values need at most
    ``log_bins(range)`` rounds. The other keys fit a task each and are ranked by a spilling sort within the key.
    """
    spark = pairs.sparkSession
    stages = stages or Stages(spark, "quantiles")
    rows = stages.put(pairs.filter(F.col("value").isNotNull() & F.col("key").isNotNull()).select("key", F.col("value").cast("long").alias("value")))
    sums = stages.put(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")))
    total = sums.agg(F.sum("n")).collect()[0][0] or 0
    edge = max(total // shuffle_width(spark), SMALL)
    heavy = sums.filter(F.col("n") > edge).collect()  # fewer than there are shuffle partitions
    names = list(probs)
    rank = lambda p, n: F.greatest(F.lit(1), F.ceil(F.lit(p) * n)).cast("long")
    hot = [r["key"] for r in heavy]
    light = rows if not hot else rows.filter(~F.col("key").isin(hot))
    small = sums.filter(F.col("n") <= edge).select("key", "n")
    ranked = light.withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy("value")).cast("long")).join(small, "key")
    hits = ranked.groupBy("key").agg(F.first("n").alias("n"), *(F.max(F.when(F.col("rn") == rank(probs[c], F.col("n")), F.col("value"))).alias(c) for c in names))
    if not heavy:
        return hits
    found = _select_heavy(spark, rows.filter(F.col("key").isin(hot)), heavy, probs, bins)
    schema = "key " + dict(rows.dtypes)["key"] + ", n long, " + ", ".join(f"`{c}` long" for c in names)
    return hits.unionByName(small_table(spark, [(r["key"], r["n"], *(found[(r["key"], c)] for c in names)) for r in heavy], schema))


def _select_heavy(spark: SparkSession, rows: DataFrame, heavy: list, probs: dict[str, float], bins: int) -> dict:
    """Resolve the ranks of the heavy keys by histogram refinement; the state is one interval per key and quantile."""
    open_: dict[tuple, list[int]] = {}
    done: dict[tuple, int] = {}
    for r in heavy:
        for c, p in probs.items():
            x = p * r["n"]
            rank = max(1, int(-(-x // 1)))
            open_[(r["key"], c)] = [int(r["lo"]), int(r["hi"]), rank]
    while open_:
        for k in [k for k, (lo, hi, _) in open_.items() if lo == hi]:
            done[k] = open_.pop(k)[0]
        if not open_:
            break
        table = [(k, c, lo, (hi - lo) // bins + 1, hi) for (k, c), (lo, hi, _) in open_.items()]
        kind = dict(rows.dtypes)["key"]
        spans = small_table(spark, table, f"k {kind}, q string, lo long, width long, hi long")  # fewer rows than shuffle partitions times quantiles
        hist = rows.join(F.broadcast(spans), (F.col("key") == F.col("k")) & F.col("value").between(F.col("lo"), F.col("hi"))).groupBy("k", "q", F.expr("(CAST(value AS DECIMAL(20)) - lo) DIV width").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        below = Window.partitionBy("k", "q").orderBy("bin")
        wanted = small_table(spark, [(k, c, rank) for (k, c), (_, _, rank) in open_.items()], f"k {kind}, q string, rank long")
        # at most `bins` rows per key and quantile here
        cum = hist.withColumn("upto", F.sum("n").over(below)).join(F.broadcast(wanted), ["k", "q"]).filter((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
        width = {(k, c): (lo, w, hi) for k, c, lo, w, hi in table}
        for r in cum.collect():
            lo, w, hi = width[(r["k"], r["q"])]
            a = lo + r["bin"] * w
            open_[(r["k"], r["q"])] = [a, min(hi, a + w - 1), r["rank"] - (r["upto"] - r["n"])]
    return done


def per_key_profile(links: DataFrame, key: str, value: str, probs: dict[str, float] | None = None) -> DataFrame:
    """Rows, distinct values and quantiles of the distinct values of every key of a skewed link table.

    Result: key, n_rows, n_distinct, and the quantile columns (``q50``, ``q90`` unless told otherwise), one row per non-null key. Rows whose
    value is null count in n_rows only; a key with null values only has n_distinct 0 and null quantiles. Repeated rows count in n_rows and
    once among the distinct values. An empty table gives an empty result. Other columns are ignored.

    Distinct pairs are formed on (key, value), which no hot key can skew, and counted with map-side combination.
    """
    probs = probs or {"q50": 0.5, "q90": 0.9}
    base = links.select(F.col(key).cast("long").alias("key"), F.col(value).cast("long").alias("value")).filter(F.col("key").isNotNull())
    stages = Stages(links.sparkSession, "profile")
    # one shuffle on both columns gives the multiplicity of every pair; everything below reads this smaller table
    multi = stages.put(base.groupBy("key", "value").agg(F.count(F.lit(1)).alias("m")))
    n_rows = multi.groupBy("key").agg(F.sum("m").alias("n_rows"))
    q = exact_quantiles(multi.filter(F.col("value").isNotNull()).select("key", "value"), probs, stages=stages)
    return n_rows.join(q, "key", "left").select("key", "n_rows", F.coalesce("n", F.lit(0)).alias("n_distinct"), *probs)


def heavy_keys(profile: DataFrame, share: float = 0.01) -> DataFrame:
    """The keys of a profile with at least ``share`` of all distinct (key, value) pairs: key, n_distinct."""
    total = profile.agg(F.sum("n_distinct")).collect()[0][0] or 0  # one number
    return profile.filter((F.col("n_distinct") > 0) & (F.col("n_distinct") >= F.lit(float(total) * share))).select("key", "n_distinct")


def values_at_ranks(rows: DataFrame, value: str, ranks: list[int], bins: int = 256) -> list[int]:
    """The values of a BIGINT column at the given ranks (1 is the smallest value) in ascending order of all its rows, by distributed selection.

    Each round counts the rows of the open intervals in ``bins`` parts each; counts merge on the map side, so a task hands on at most ``bins``
    numbers per rank whatever its rows, and no value is gathered. A rank goes on in the part that holds it and is resolved when that is one
    value wide: 64-bit values need at most eight rounds. ``rows`` is read once per round and should be a written table. Null values are ignored;
    ranks below 1 or above the number of rows are an error.
    """
    base = rows.filter(F.col(value).isNotNull()).select(F.col(value).cast("long").alias("v"))
    lo, hi, n = base.agg(F.min("v"), F.max("v"), F.count("v")).collect()[0]
    if any(not 1 <= r <= (n or 0) for r in ranks):
        raise ValueError("no such rank")
    width, left = 1, {r: r for r in ranks}
    while ranks and hi // width - lo // width >= bins:
        width *= bins
    # the quotient rounded down, which fits 64 bits for every value
    part = lambda w: F.when(F.col("v") >= 0, F.expr(f"v DIV {w}")).otherwise(F.expr(f"-((-(v + 1)) DIV {w}) - 1"))
    at: dict[int, int] = dict.fromkeys(ranks, 0)  # the open part of each rank, of the width before
    before = None
    while ranks:
        held = base if before is None else base.filter(part(before).isin(sorted(set(at.values()))))
        # at most `bins` rows per rank
        counts = held.groupBy(part(width).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
        under: dict[int, list[tuple[int, int]]] = {}
        for r in sorted(counts, key=lambda r: r["p"]):
            under.setdefault(0 if before is None else r["p"] * width // before, []).append((r["p"], r["n"]))
        for r in ranks:
            for p, k in under[at[r]]:
                if left[r] <= k:
                    at[r] = p
                    break
                left[r] -= k
        if width == 1:
            break
        before, width = width, width // bins
    return [at[r] for r in ranks]


def heavy_by_selection(links: DataFrame, key: str, value: str, share: float = 0.01) -> DataFrame:
    """key, n_distinct of the keys with at least ``share`` of all distinct (key, value) pairs whose ends are both non-null.

    A key with that many pairs covers one of the ranks that lie so many pairs apart in the order of keys. Those ranks, ``1 / share`` of them, are
    resolved by ``values_at_ranks``, and only the keys found there are counted. No key's pairs are gathered; repeated rows count once.
    """
    stages = Stages(links.sparkSession, "heavy")
    base = links.select(F.col(key).cast("long").alias("key"), F.col(value).cast("long").alias("value")).filter("key is not null and value is not null")
    # one shuffle on both columns, which no hot key can skew; only the keys of the distinct pairs are read again
    pairs = stages.put(base.groupBy("key", "value").agg(F.count(F.lit(1)).alias("m")).select("key"))
    n = pairs.count()
    least = max(1, math.ceil(n * share - 1e-9))
    found = values_at_ranks(pairs, "key", list(range(least, n + 1, least)))
    # as few rows as there are ranks
    return pairs.filter(F.col("key").isin(sorted(set(found)))).groupBy("key").agg(F.count(F.lit(1)).alias("n_distinct")).filter((F.col("n_distinct") >= F.lit(n * share)) & (F.col("n_distinct") > 0))
