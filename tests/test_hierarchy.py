"""Hierarchies against a brute-force walk."""

import random
from datetime import datetime

from arborix.operators import hierarchy

SCHEMA = "edge_id long, caller long, callee long, seen_at timestamp, depth string, node string"


def build(spark, rows):
    full = [(i, a, b, datetime(2025, 1, 1 + t), "x", "y") for i, (a, b, t) in enumerate(rows)]
    return hierarchy.build(spark.createDataFrame(full, SCHEMA), "callee", "caller", ["seen_at", "edge_id"])


def brute(rows):
    held = {}
    for i, (a, b, t) in enumerate(rows):
        if b is not None and (b not in held or (t, i) > held[b][0]):
            held[b] = ((t, i), a)
    parent = {b: a for b, (_, a) in held.items()}
    ids = set(parent) | {a for a in parent.values() if a is not None}
    out = {}
    for n in ids:
        chain, seen = [n], {n}
        while (p := parent.get(chain[-1])) is not None:
            if p in seen:
                chain = None
                break
            chain.append(p)
            seen.add(p)
        out[n] = (-1, -1, "") if chain is None else (chain[-1], len(chain) - 1, "/".join(map(str, reversed(chain))))
    return out, parent


def got(h):
    return {r.node_id: (r.root_id, r.depth, r.path) for r in hierarchy.paths(h).collect()}


def test_small_cases(spark):
    rows = [(None, 1, 0), (1, 2, 0), (2, 3, 0), (9, 3, 1), (3, 3, 2), (5, 6, 0), (6, 5, 0), (6, 7, 0), (7, 8, 0), (4, None, 0), (1, 2, 0)]
    h = build(spark, rows)
    assert got(h) == brute(rows)[0]
    on = {r.node_id: (r.circle_id, r.on_circle) for r in hierarchy.circles(h).collect()}
    assert on == {3: (3, True), 5: (5, True), 6: (5, True), 7: (5, False), 8: (5, False)}
    assert {(r.node_id, r.descendant_id, r.distance) for r in hierarchy.descendants(h).collect()} == {(1, 2, 1)}


def test_empty(spark):
    h = build(spark, [])
    assert got(h) == {}
    assert hierarchy.circles(h).count() == 0


def test_deep_wide_and_circles(spark):
    rng = random.Random(3)
    rows = [(None if i == 0 else i - 1, i, 0) for i in range(300)]  # a long chain
    rows += [(5, 1000 + i, rng.randint(0, 3)) for i in range(2500)]  # a hot parent
    rows += [(3000 + (i + 1) % 40, 3000 + i, 0) for i in range(40)]  # a long circle
    rows += [(rng.randint(0, 3100), 4000 + i, rng.randint(0, 9)) for i in range(200)]
    h = build(spark, rows)
    want, parent = brute(rows)
    assert got(h) == want
    pairs = {(a, b) for a, b, _ in (tuple(r) for r in hierarchy.descendants(h).collect())}
    assert pairs == {(int(x), n) for n, (_, _, path) in want.items() if path for x in path.split("/")[:-1]}


def test_circles_below_a_deep_chain(spark):
    """Stretches on circles stay short however deep the chains are."""
    rows = [(None if i == 0 else i - 1, i, 0) for i in range(2000)]
    rows += [(5000 + (i + 1) % 60, 5000 + i, 0) for i in range(60)] + [(5003, 6000, 0)] + [(6000 + i, 6001 + i, 0) for i in range(50)] + [(7000, 7000, 0), (7000, 7001, 0)]
    h = build(spark, rows)
    assert got(h) == brute(rows)[0]
    assert {r.circle_id for r in hierarchy.circles(h).collect()} == {5000, 7000}


def test_a_cluster_must_name_its_shared_folder():
    import pytest

    from arborix.session import shared_dir

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        shared_dir(Session())
