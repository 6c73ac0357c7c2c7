"""Per-key results of skewed links, and salted joins."""

import math
import random

from arborix.operators import skew
from arborix.operators.skew import exact_quantiles, heavy_keys, per_key_profile, salted_join


def test_profile_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(7, rng.randint(-(10**12), 10**12)) for _ in range(4000)] + [(rng.randint(10, 60), rng.randint(0, 50)) for _ in range(800)] + [(None, 5), (99, None), (99, None), (7, None)]
    rows += rows[:500]
    df = spark.createDataFrame([(*r, "n", "k") for r in rows], "callee long, caller long, n_rows string, key string")
    got = {r.key: (r.n_rows, r.n_distinct, r.q50, r.q90) for r in per_key_profile(df, "callee", "caller").collect()}
    want = {}
    for k in {a for a, _ in rows if a is not None}:
        vals = sorted({b for a, b in rows if a == k and b is not None})
        pick = lambda p: vals[max(1, math.ceil(p * len(vals))) - 1] if vals else None  # noqa: E731, B023
        want[k] = (sum(a == k for a, _ in rows), len(vals), pick(0.5), pick(0.9))
    assert got == want


def test_heavy_and_empty(spark):
    df = spark.createDataFrame([(1, i) for i in range(99)] + [(2, 1)], "callee long, caller long")
    assert [(r.key, r.n_distinct) for r in heavy_keys(per_key_profile(df, "callee", "caller"), 0.02).collect()] == [(1, 99)]
    none = spark.createDataFrame([], "callee long, caller long")
    assert heavy_keys(per_key_profile(none, "callee", "caller")).count() == 0


def test_quantiles_of_ties_and_extremes(spark):
    rows = [("a", v) for v in [5] * 2000 + [-(2**62), 2**62]]
    df = spark.createDataFrame(rows, "key string, value long")
    r = exact_quantiles(df, {"lo": 0.0, "mid": 0.5, "hi": 1.0}).collect()[0]
    assert (r.n, r.lo, r.mid, r.hi) == (2002, -(2**62), 5, 2**62)


def test_salted_join_keeps_everything(spark):
    big = spark.createDataFrame([(i, 1 if i % 3 else i) for i in range(5000)] + [(-1, None)], "id long, k long")
    small = spark.createDataFrame([(i, f"v{i}") for i in range(0, 5000, 2)] + [(1, "v1")], "sk long, v string")
    assert skew.hot_keys(big, "k") == [1]
    a = sorted(tuple(r) for r in salted_join(big, small, "k", "sk", big["id"]).select("id", "v").collect())
    d = {r.sk: r.v for r in small.collect()}
    assert a == sorted((i, d.get(k)) for i, k in (tuple(r) for r in big.collect()))


def test_hot_keys_are_cut_by_their_size(spark):
    rng = random.Random(4)
    rows = [(i, 1 if i < 9000 else 2 if i < 14000 else None if i < 15000 else i) for i in range(20000)]
    rng.shuffle(rows)
    big = spark.createDataFrame(rows, "id long, k long")
    small = spark.createDataFrame([(1, "one"), (2, "two"), (15001, "x"), (77, "y")], "sk long, v string")
    counts, line = skew.hot_counts(big, "k")
    assert set(counts) == ({1, 2} if line < 5000 else {1}) and line == max(20000 // 4, skew.SMALL)
    for hot in (None, (counts | {2: 5000}, 100)):
        for how in ("left", "inner"):
            got = sorted(((r.id, r.v) for r in salted_join(big, small, "k", "sk", big["id"], how, hot).collect()), key=str)
            d = {1: "one", 2: "two", 15001: "x"}
            assert got == sorted(((i, d.get(k)) for i, k in rows if how == "left" or k in d), key=str)


def test_values_at_ranks(spark):
    rng = random.Random(5)
    vals = [rng.choice([7, 7, 7, rng.randint(-(2**63), 2**63 - 1), rng.randint(0, 5)]) for _ in range(500)] + [-(2**63), 2**63 - 1]
    df = spark.createDataFrame([(v,) for v in vals + [None, None]], "v long")
    ranks = [1, 2, 100, 250, 251, 400, 501, 502]
    for bins in (4, 4096):
        assert skew.values_at_ranks(df, "v", ranks, bins) == [sorted(vals)[r - 1] for r in ranks]
    assert skew.values_at_ranks(df.limit(0), "v", []) == []


def test_heavy_by_selection(spark):
    rng = random.Random(6)
    for share in (0.01, 0.05, 0.5):
        rows = [(rng.choice([3, 3, 3, -8, -8, 10**15, *range(20, 60)]), rng.randint(0, 150)) for _ in range(2000)] + [(None, 1), (3, None), (4, None)]
        df = spark.createDataFrame([(*r, 0) for r in rows], "callee long, caller long, key long")
        pairs = {r for r in rows if None not in r}
        n = {k: sum(a == k for a, _ in pairs) for k in {a for a, _ in pairs}}
        assert {(r.key, r.n_distinct) for r in skew.heavy_by_selection(df, "callee", "caller", share).collect()} == {(k, c) for k, c in n.items() if c >= share * len(pairs)}
        assert skew.heavy_by_selection(df.limit(0), "callee", "caller", share).count() == 0
