"""Queries of the general data-processing problems: hierarchies (p2), skewed keys (p3), incremental runs (p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hierarchy, incremental, skew
from ..session import Stages, read


def _tree(spark: SparkSession, d: str) -> hierarchy.Hierarchy:
    return hierarchy.build(read(spark, d, "call_tree"), child="callee", parent="caller", order=["seen_at", "edge_id"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.paths(_tree(spark, d))


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(_tree(spark, d))


def p2_circles(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.circles(_tree(spark, d))


def _profiles(spark: SparkSession, d: str) -> list[tuple[str, DataFrame]]:
    out = []
    for relation, key, value in (("edges", "callee", "caller"), ("refs", "target", "referencer")):
        out.append((relation, skew.per_key_profile(read(spark, d, relation), key, value)))
    return out


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    part = lambda relation, key, value: skew.heavy_by_selection(read(spark, d, relation), key, value).select(F.lit(relation).alias("relation"), F.col("key").alias("node_id"))
    return part("edges", "callee", "caller").unionByName(part("refs", "target", "referencer"))


def p3_profile(spark: SparkSession, d: str) -> DataFrame:
    (a, edges), (b, refs) = _profiles(spark, d)
    named = lambda x, df: df.select(F.lit(x).alias("relation"), F.col("key").alias("node_id"), "n_rows", "n_distinct", "q50", "q90")
    return named(a, edges).unionByName(named(b, refs))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    # what the runs left is put in force as a state version of its own; the next run's work is then planned against it
    stages = Stages(spark, "p6")
    store = incremental.StateStore(spark, f"{stages.root}/state")
    store.commit(incremental.stored_state(read(spark, d, "load_runs"), read(spark, d, "cache_files")))
    return incremental.plan_run(store, read(spark, d, "source_files"), stages)[2]


def p6_state(spark: SparkSession, d: str) -> DataFrame:
    return incremental.stored_state(read(spark, d, "load_runs"), read(spark, d, "cache_files"))


QUERIES = {f.__name__: f for f in (p2_found, p2_descendants, p2_circles, p3_found, p3_profile, p6_found, p6_state)}

_HELD = """held AS (
    SELECT callee AS node, caller AS parent FROM call_tree WHERE callee IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY callee ORDER BY seen_at DESC NULLS LAST, edge_id DESC NULLS LAST, caller DESC NULLS LAST) = 1),
  ids AS (SELECT node FROM held UNION SELECT parent FROM held WHERE parent IS NOT NULL),
  roots AS (SELECT ids.node FROM ids LEFT JOIN held ON held.node = ids.node WHERE held.parent IS NULL),
  w AS (SELECT node, node AS root, [node] AS chain FROM roots
        UNION ALL SELECT h.node, w.root, list_append(w.chain, h.node) FROM w JOIN held h ON h.parent = w.node)"""


def _profile_sql(relation: str, key: str, value: str) -> str:
    return f"""SELECT '{relation}' AS relation, k.{key} AS node_id, k.n_rows, coalesce(p.n, 0) AS n_distinct, p.q50, p.q90
FROM (SELECT {key}, count(*) AS n_rows FROM {relation} WHERE {key} IS NOT NULL GROUP BY 1) k
LEFT JOIN (SELECT {key}, count(*) AS n, quantile_disc({value}, 0.5) AS q50, quantile_disc({value}, 0.9) AS q90
           FROM (SELECT DISTINCT {key}, {value} FROM {relation} WHERE {key} IS NOT NULL AND {value} IS NOT NULL) GROUP BY 1) p ON p.{key} = k.{key}"""


def _heavy_sql(relation: str, key: str, value: str) -> str:
    return f"""SELECT '{relation}' AS relation, {key} AS node_id FROM
(SELECT DISTINCT {key}, {value} FROM {relation} WHERE {key} IS NOT NULL AND {value} IS NOT NULL)
GROUP BY {key} HAVING count(*) >= 0.01 * (SELECT count(*) FROM (SELECT DISTINCT {key}, {value} FROM {relation} WHERE {key} IS NOT NULL AND {value} IS NOT NULL))"""


_STATE_SQL = """
  SELECT c.repo, regexp_replace(c.path, '^\\./', '') AS path, lower(c.source_hash) AS hash
  FROM cache_files c JOIN (SELECT run_id, max(finished_at) AS fin FROM load_runs WHERE status = 'ok' GROUP BY 1) r ON r.run_id = c.run_id
  WHERE c.path IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY c.repo, regexp_replace(c.path, '^\\./', '')
    ORDER BY r.fin DESC NULLS LAST, c.run_id DESC, c.written_at DESC NULLS LAST, lower(c.source_hash) DESC NULLS LAST) = 1"""

SQL = {
    "p2_found": f"""WITH RECURSIVE {_HELD}
SELECT node AS node_id, root AS root_id, CAST(len(chain) - 1 AS BIGINT) AS depth, array_to_string(chain, '/') AS path FROM w
UNION ALL SELECT node, -1, -1, '' FROM ids WHERE node NOT IN (SELECT node FROM w)""",
    "p2_descendants": f"""WITH RECURSIVE {_HELD}, u AS (SELECT node, unnest(chain) AS node_id, generate_subscripts(chain, 1) AS pos, len(chain) AS n FROM w)
SELECT node_id, node AS descendant_id, CAST(n - pos AS BIGINT) AS distance FROM u WHERE pos < n""",
    "p2_circles": f"""WITH RECURSIVE {_HELD},
  lost AS (SELECT h.node, h.parent FROM held h WHERE h.node NOT IN (SELECT node FROM w)),
  r AS (SELECT node, parent AS pos FROM lost UNION SELECT r.node, lost.parent FROM r JOIN lost ON lost.node = r.pos),
  ring AS (SELECT node FROM r WHERE node = pos),
  named AS (SELECT r.node, min(r.pos) AS circle_id FROM r JOIN ring ON ring.node = r.pos GROUP BY 1)
SELECT node AS node_id, circle_id, node IN (SELECT node FROM ring) AS on_circle FROM named""",
    "p3_found": _heavy_sql("edges", "callee", "caller") + "\nUNION ALL\n" + _heavy_sql("refs", "target", "referencer"),
    "p3_profile": _profile_sql("edges", "callee", "caller") + "\nUNION ALL\n" + _profile_sql("refs", "target", "referencer"),
    "p6_state": _STATE_SQL,
    "p6_found": f"""WITH s AS ({_STATE_SQL}),
  f AS (SELECT repo, regexp_replace(path, '^\\./', '') AS path, lower(coalesce(content_sha256, sha256(coalesce(content, '')))) AS hash FROM source_files)
SELECT coalesce(f.repo, s.repo) AS repo, coalesce(f.path, s.path) AS path,
  CASE WHEN f.path IS NULL THEN 'removed' WHEN s.hash IS NULL THEN 'added' ELSE 'changed' END AS change
FROM f FULL JOIN s ON s.repo = f.repo AND s.path = f.path
WHERE (f.path IS NULL AND s.hash IS NOT NULL) OR (f.path IS NOT NULL AND (s.hash IS NULL OR s.hash <> f.hash))""",
}
