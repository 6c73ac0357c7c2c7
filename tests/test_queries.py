"""Every registered query of the core runs on whole tables and gives the rows of its SQL."""

import re

import pytest
from oracle import compare, duck, rows_of

from arborix import queries


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(queries.all_sql()))
def test_query(spark, sf, con, name):
    q, sql = queries.all_queries()[name], queries.all_sql()[name]
    why, _, _ = compare(spark, con, sf, name, q, sql)
    assert not why


def test_which_queries_have_no_sql():
    assert set(queries.all_queries()) - set(queries.all_sql()) == {"extract_functions", "code_graph"}


def test_callers_depth3_of_all_seeds(spark, sf, con):
    """The walk starts from every searched function, not from those of one name."""
    df = queries.all_queries()["callers_depth3"](spark, sf)
    want = con.sql("""WITH RECURSIVE pairs AS (SELECT DISTINCT caller, callee FROM edges WHERE caller IS NOT NULL AND callee IS NOT NULL),
      b AS (SELECT DISTINCT seed, seed AS v, 0 AS depth FROM context_entries WHERE seed IS NOT NULL
        UNION SELECT b.seed, p.caller, b.depth + 1 FROM b JOIN pairs p ON p.callee = b.v WHERE b.depth < 3)
      SELECT seed, v AS caller, CAST(min(depth) AS BIGINT) AS depth FROM b GROUP BY 1, 2 HAVING v <> seed""")
    rows = [tuple(r) for r in df.collect()]
    assert rows_of(df.columns, rows) == rows_of(want.columns, want.fetchall())
    assert {r[2] for r in rows} == {1, 2, 3}


def test_merge_graphs_of_all_languages(spark, sf):
    """Every node, and every edge and reference between two nodes, is in the merged graph under its moved ids."""
    from arborix.functions.paths import LANGUAGES
    from arborix.queries import code

    nodes, edges, refs = [x.collect() for x in code._graph(spark, sf)]
    place = {key: n for n, key, _ in LANGUAGES}
    order = sorted(nodes, key=lambda r: (place.get(r.language, len(place)), r.id))
    new = {r.id: i for i, r in enumerate(order)}
    got = {}
    for r in queries.all_queries()["merge_graphs"](spark, sf).collect():
        got.setdefault(r.part, []).append(r)
    assert sorted((r.id, r.name, r.language, r.file, r.line) for r in got["node"]) == [(i, r.name, r.language, r.file, r.line) for i, r in enumerate(order)]
    assert len({r.language for r in got["node"]}) == 7
    key = lambda t: tuple(str(x) for x in t)
    want = [(new[r.caller], new[r.callee], " && ".join(r.conditions)) for r in edges if r.caller in new and r.callee in new]
    assert sorted(((r.caller, r.callee, r.conditions) for r in got["edge"]), key=key) == sorted(want, key=key)
    want = [(new[r.referencer], new[r.target], r.kind, r.context) for r in refs if r.referencer in new and r.target in new]
    assert sorted(((r.referencer, r.target, r.kind, r.context) for r in got["reference"]), key=key) == sorted(want, key=key)
    for part in got.values():
        assert sorted(r.id for r in part) == list(range(len(part)))


def test_titles_of_whole_texts(spark, sf):
    """A title has all of its text, not the first characters only."""
    title = {r.doc_id: r.title for r in queries.all_queries()["text_rules"](spark, sf).collect()}
    docs = [r for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.text is not None and r.text.isascii()]
    assert any(len(r.text) > 60 for r in docs)
    assert [title[r.doc_id] for r in docs] == [re.sub(r"\s+", " ", r.text.replace("`", "")).strip() for r in docs]


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
