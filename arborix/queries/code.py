"""Queries of search, graph, enrichment and index maintenance over the source tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..operators import blocks, enrich, evalmatrix, graph, intervals, resolve, search
from ..operators.skew import salted_join
from ..session import Stages, read
from ..sources.scan import lines

#: What the search queries look for.
RUN_MODES = ("incremental", "full_rebuild", "reused")
LITERAL, REGEX, WORD = "return None", r"(fn|def|function)\s+\w*[Bb]udget\w*", "limit"


def _files(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "source_files").select("file_id", "repo", "path", P.language_for_path("path").alias("language"), "content")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return lines(_files(spark, d), key="file_id")


def line_scan(spark, d):
    return lines(read(spark, d, "documents"), key="doc_id", content="text")


def search_literal(spark, d):
    return search.matches(_lines(spark, d), LITERAL, search.parse_flags(["-F"]), key="file_id")


def search_regex(spark, d):
    return search.matches(_lines(spark, d), REGEX, key="file_id")


def search_icase(spark, d):
    return search.matches(_lines(spark, d), "todo", search.parse_flags(["-i"]), key="file_id")


def search_word(spark, d):
    return search.matches(_lines(spark, d), WORD, search.parse_flags(["-w"]), key="file_id")


def search_invert(spark, d):
    return search.matches(_lines(spark, d), r"[a-z]", search.parse_flags(["-v"]), key="file_id")


def search_max_count(spark, d):
    return search.matches(_lines(spark, d), "return", search.parse_flags(["-F", "-m", "2"]), key="file_id")


def search_submatches(spark, d):
    hits = search.submatches(search.matches(_lines(spark, d), "budget", key="file_id"), "budget")
    return hits.select("file_id", "line_number", F.size("submatches").cast("long").alias("n"), F.get("submatches", F.lit(0))["start"].alias("first_start"), F.element_at("submatches", -1)["end"].alias("last_end"))


def search_context(spark, d):
    return search.with_context(_files(spark, d), lambda t: t.contains(LITERAL), 2, 1, key="file_id").select("file_id", "line_number", "is_match")


def search_scoped(spark, d):
    o = search.parse_flags(["-t", "ts", "-g", "**/src/**", "-g", "!*.spec.*"])
    wanted = search.select_files(_files(spark, d), o, ["apps", "libs"])
    return search.matches(lines(wanted, key="file_id"), "import", o, key="file_id").select("file_id", "line_number")


def path_classify(spark, d):
    f = read(spark, d, "source_files")
    lang = P.language_for_path("path")
    return f.select("file_id", lang.alias("language"), P.is_test_path("path").alias("is_test"), P.module_name("path", lang).alias("module"))


def qualified_names(spark, d):
    n = graph_nodes(spark, d)
    mod = P.module_name("file", "language")
    return n.select("id", P.qualified_name(mod, F.array().cast("array<string>"), "name").alias("qualified"), resolve.simple_name(F.col("qualified_name")).alias("simple"), resolve.qualifier(F.col("qualified_name")).alias("qualifier"))


def graph_nodes(spark, d):
    """The functions, once each: repeats removed, paths without ``./``, language of the path, unknown tests as none."""
    n = read(spark, d, "nodes").unionByName(read(spark, d, "shared_nodes"))
    file = P.normalize_path("file")
    clean = n.select("id", "repo", "name", "qualified_name", F.coalesce(P.language_for_path(file), F.lower("language")).alias("language"), file.alias("file"), F.coalesce("is_test", F.lit(False)).alias("is_test"), "line", "end_line")
    return clean.groupBy("id").agg(F.max(F.struct("repo", "name", "qualified_name", "language", "file", "is_test", "line", "end_line")).alias("n")).select("id", "n.*")


def _graph(spark, d):
    st = Stages(spark, "q")
    nodes = st.put(graph_nodes(spark, d))
    edges = st.put(graph.clean_edges(read(spark, d, "edges")))
    refs = st.put(graph.clean_references(read(spark, d, "refs")))
    return nodes, edges, refs


def _points(spark, d):
    f = _files(spark, d)
    return search.matches(lines(f.select(F.concat_ws("/", "repo", "path").alias("path"), "content")), WORD, search.parse_flags(["-w"]))


def _intervals(spark, d):
    return graph_nodes(spark, d).withColumn("file", F.concat_ws("/", "repo", "file"))


def enclosing_function(spark, d):
    return enrich.enclose(_points(spark, d), _intervals(spark, d)).select("path", "line_number", "node", "qualified_name")


def enclosing_order(spark, d):
    """Nested and overlapping intervals: per customer, orders that are open for a while around ship days."""
    o = read(spark, d, "orders").select("o_custkey", F.unix_date(F.to_date("o_orderdate")).cast("long").alias("lo"), "o_orderkey").withColumn("hi", F.col("lo") + F.col("o_orderkey") % 90)
    li = read(spark, d, "lineitem").select("l_orderkey", F.unix_date(F.to_date("l_shipdate")).cast("long").alias("day"))
    probe = li.join(o.select("o_orderkey", F.col("o_custkey").alias("cust")), F.col("l_orderkey") == F.col("o_orderkey")).select("cust", "day").distinct()
    return intervals.enclosing(probe.withColumnRenamed("cust", "o_custkey"), o, "o_custkey", "day", "lo", "hi", "o_orderkey", ["o_orderkey"], bucket=32).select(F.col("o_custkey").alias("cust"), "day", F.col("o_orderkey").alias("open_order"))


def fallback_lookup(spark, d):
    nodes = _intervals(spark, d)
    pts = _points(spark, d)
    out = enrich.enclose_with_fallback(pts, nodes.filter("not is_test"), nodes, P.is_test_path("path"))
    return out.select("path", "line_number", "node", "universe")


def _sites(spark, d):
    n = graph_nodes(spark, d)
    refs = read(spark, d, "refs").dropDuplicates(["ref_id"])
    return n, refs.join(n.select(F.col("id").alias("r_id"), "language"), F.col("referencer") == F.col("r_id"))


def resolve_symbols(spark, d):
    n, s = _sites(spark, d)
    sites = s.select(F.col("ref_id").alias("site"), "language", F.regexp_extract("context", "^passed to (.+)$", 1).alias("raw")).filter("raw <> ''")
    return resolve.resolve(sites, n, "raw", ["site"])


def resolve_qualified(spark, d):
    n, s = _sites(spark, d)
    t = n.select(F.col("id").alias("t_id"), F.col("qualified_name").alias("raw"))
    return resolve.resolve(s.join(t, F.col("target") == F.col("t_id")).select(F.col("ref_id").alias("site"), "language", "raw"), n, "raw", ["site"])


def call_edges(spark, d):
    e = graph.clean_edges(read(spark, d, "edges"))
    return e.select("edge_id", "caller", "callee", F.array_join("conditions", " && ").alias("conditions"))


def reference_edges(spark, d):
    return graph.clean_references(read(spark, d, "refs"))


def in_degree_heat(spark, d):
    return graph.heat(graph.clean_edges(read(spark, d, "edges")), graph.clean_references(read(spark, d, "refs")))


def _seeds(spark, d):
    return read(spark, d, "context_entries").select("seed").filter("seed is not null").distinct()


def callers_depth1(spark, d):
    e = graph.clean_edges(read(spark, d, "edges"))
    return graph.callers(_seeds(spark, d), e, 1).select("seed", "caller", "depth", "edge_id", F.array_join("conditions", " && ").alias("conditions"))


def callers_depth3(spark, d):
    edges = Stages(spark, "c3").put(graph.clean_edges(read(spark, d, "edges")))
    return graph.callers(_seeds(spark, d), edges, 3).select("seed", "caller", "depth")


def references_of(spark, d):
    nodes, edges, refs = _graph(spark, d)
    return enrich.reference_info(_seeds(spark, d), nodes, refs, graph.heat(edges, refs)).select("seed", "ref_id", "file", "function", "is_test", "line", "heat", "context")


def topk_hidden(spark, d):
    nodes, edges, refs = _graph(spark, d)
    info = enrich.caller_info(_seeds(spark, d), nodes, edges, graph.heat(edges, refs))
    return enrich.top_callers(info).select("seed", "is_test", "rnk", "caller", "heat", F.greatest(F.col("total") - enrich.MAX_CONTEXT, F.lit(0)).alias("hidden"))


def enriched_search(spark, d):
    """Every line that has a literal, with the function around it and how many callers and references that has."""
    nodes, edges, refs = _graph(spark, d)
    st = Stages(spark, "es")
    found = st.put(enrich.enclose(_points(spark, d), nodes.withColumn("file", F.concat_ws("/", "repo", "file"))))
    ctx = enrich.node_contexts(found.select(F.col("node").alias("seed")).filter("seed is not null"), nodes, edges, refs, graph.heat(edges, refs))
    rows = found.join(ctx, F.col("node") == F.col("seed"), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return rows.select("path", "line_number", "node", zero("n_callers"), zero("n_test_callers"), zero("n_references"), zero("n_test_references"), F.get("callers", F.lit(0))["function"].alias("first_caller"))


def enriched_json(spark, d):
    nodes, edges, refs = _graph(spark, d)
    st = Stages(spark, "ej")
    found = st.put(enrich.enclose(_points(spark, d), nodes.withColumn("file", F.concat_ws("/", "repo", "file"))))
    ctx = enrich.node_contexts(found.select(F.col("node").alias("seed")).filter("seed is not null"), nodes, edges, refs, graph.heat(edges, refs))
    return enrich.json_rows(found.join(ctx, F.col("node") == F.col("seed"), "left"), False)


def graph_roots(spark, d):
    nodes, edges, _ = _graph(spark, d)
    return graph.roots(nodes, edges)


def simple_paths(spark, d):
    t = read(spark, d, "call_tree").select("caller", "callee")
    ids = t.select(F.col("caller").alias("id")).union(t.select("callee")).filter("id is not null").distinct()
    return graph.simple_paths(ids, t).select("path_id", F.array_join(F.col("chain").cast("array<string>"), "/").alias("chain"))


def dense_ids(spark, d):
    n = graph_nodes(spark, d)
    order = [P.language_ordinal("language"), F.col("repo"), F.col("file"), F.col("line"), F.col("id")]
    keyed = n.select(order[0].alias("o"), "repo", "file", "line", "id")
    return graph.number_rows(keyed, ["o", "repo", "file", "line", "id"], "dense").select("id", "dense")


def _by_language(df, order):
    """k: dense numbers over the rows of all languages ``o`` in turn; local: over those of each language alone."""
    rows = graph.number_rows(df, ["o", *order], "k")
    first = rows.groupBy("o").agg(F.min("k").alias("_first"))  # one row per language
    return rows.join(F.broadcast(first), "o").withColumn("local", F.col("k") - F.col("_first")).drop("_first")


def merge_graphs(spark, d):
    """Nodes, edges and references (``part``) of the graph merged from those of the languages, with all ids moved.

    Within its language each graph has ids of its own. Edges and references between two languages belong to no graph; they follow those of the
    graphs with the ids that their ends have in the merged one. Ends that no table lists have no id, so their rows are left out.
    """
    nodes, edges, refs = _graph(spark, d)
    st = Stages(spark, "mg")
    n = st.put(_by_language(nodes.withColumn("o", P.language_ordinal("language")), ["id"]))
    split = {}
    for name, rows, key, ends in (("edge", edges, "edge_id", ("caller", "callee")), ("reference", refs, "ref_id", ("referencer", "target"))):
        for end in ends:
            side = n.select(F.col("id").alias(f"{end}_id"), F.col("o").alias(f"{end}_o"), F.col("k").alias(f"{end}_k"), F.col("local").alias(f"{end}_local"))
            rows = st.put(salted_join(rows, side, end, f"{end}_id", F.col(key), "inner").drop(f"{end}_id"))
        inner = F.col(f"{ends[0]}_o") == F.col(f"{ends[1]}_o")
        order = [c for c in (key, *ends, "kind", "context") if c in rows.columns]
        within = st.put(_by_language(rows.filter(inner).withColumn("o", F.col(f"{ends[0]}_o")), order).withColumns({key: F.col("local"), **{e: F.col(f"{e}_local") for e in ends}}))
        between = graph.number_rows(rows.filter(~inner), order, "k").withColumns({key: F.col("k") + within.count(), **{e: F.col(f"{e}_k") for e in ends}})
        split[name] = within, between
    cols = {"edge": ["edge_id", "caller", "callee", "conditions"], "reference": ["ref_id", "referencer", "target", "kind", "context"]}
    parts = []
    for o in range(len(P.LANGUAGES) + 1):  # the last are of no known language
        own = n.filter(F.col("o") == o).select(F.col("local").alias("id"), "name", "qualified_name", "language", "file", "is_test", "line", "end_line")
        parts.append((own, *[split[x][0].filter(F.col("o") == o).select(*cols[x]) for x in cols]))
    nodes, edges, refs = graph.merge_graphs(spark, parts)
    edges, refs = edges.unionByName(split["edge"][1].select(*cols["edge"])), refs.unionByName(split["reference"][1].select(*cols["reference"]))
    out = nodes.withColumn("part", F.lit("node"))
    out = out.unionByName(edges.select(F.lit("edge").alias("part"), F.col("edge_id").alias("id"), "caller", "callee", F.array_join("conditions", " && ").alias("conditions")), True)
    out = out.unionByName(refs.select(F.lit("reference").alias("part"), F.col("ref_id").alias("id"), "referencer", "target", "kind", "context"), True)
    return out.select("part", "id", *[c for c in out.columns if c not in ("part", "id")])


def block_merge(spark, d):
    found = Stages(spark, "bm").put(enrich.enclose(_points(spark, d), _intervals(spark, d)))
    return blocks.merge_blocks(found, "path", "line_number", "qualified_name").select("path", "line_number", "block")


def block_context(spark, d):
    pts = Stages(spark, "bc").put(_points(spark, d).withColumn("same", F.lit("x")))
    b = blocks.merge_blocks(pts, "path", "line_number", "same")
    f = _files(spark, d).select(F.concat_ws("/", "repo", "path").alias("path"), "content").join(pts.select("path").distinct(), "path", "left_semi")
    return blocks.block_lines(b.select("path", "block", "line_number"), lines(f), 1, 1).select("path", "block", "line_number", "is_match")


def content_hash(spark, d):
    return read(spark, d, "source_files").select("file_id", F.sha2(F.coalesce("content", F.lit("")), 256).alias("hash"), T.stable_token(F.col("repo"), F.col("path")).alias("token"))


def fingerprint(spark, d):
    """Of every language of every repository SHA-256 over path, NUL, hash, NUL in path order, and of every repository over its languages' (language null)."""
    from ..operators.incremental import combined_fingerprints, fingerprints

    s = read(spark, d, "source_files").select("repo", P.language_for_path("path").alias("language"), P.normalize_path("path").alias("path"), F.sha2(F.coalesce("content", F.lit("")), 256).alias("hash")).filter("language is not null")
    each = Stages(spark, "fp").put(fingerprints(s, ["repo", "language"]))
    whole = combined_fingerprints(each, ["repo"]).join(each.groupBy("repo").agg(F.sum("n_files").alias("n_files")), "repo").withColumn("language", F.lit(None).cast("string"))
    return each.unionByName(whole)


def change_set(spark, d):
    """What the successful runs of a repository reported as changed, once each, that an index reads."""
    r = read(spark, d, "load_runs").filter("status = 'ok'").select("repo", F.explode("changed_files").alias("path")).select("repo", P.normalize_path("path").alias("path")).distinct()
    return r.filter(P.language_for_path("path").isNotNull())


def incremental_merge(spark, d):
    """What an incremental rebuild makes of every path: ``kept`` with the stored hash, ``replaced`` by another one, ``new``, or ``dropped``."""
    from ..operators.incremental import changes, current_state, stored_state

    st = Stages(spark, "im")
    state = st.put(stored_state(read(spark, d, "load_runs"), read(spark, d, "cache_files")).filter("hash is not null"))
    now = st.put(current_state(read(spark, d, "source_files")))
    names = F.when(F.col("change") == "added", "new").when(F.col("change") == "changed", "replaced").otherwise("dropped")
    moved = changes(now, state).select("repo", "path", names.alias("origin"))
    # what is there and did not move is kept; keys are grouped, so null repositories meet too
    both = now.select("repo", "path", F.lit("kept").alias("origin")).unionByName(moved)
    return both.groupBy("repo", "path").agg(F.coalesce(F.max(F.when(F.col("origin") != "kept", F.col("origin"))), F.lit("kept")).alias("origin"))


def mode_rollup(spark, d):
    """The mode with most work among each repository's successful runs, and its head if all agree on one."""
    r = read(spark, d, "load_runs").filter("status = 'ok'")
    rank = F.when(F.col("mode") == "full_rebuild", 2).when(F.col("mode") == "incremental", 1).otherwise(0)
    g = r.groupBy("repo").agg(F.max(rank).alias("m"), F.min("head").alias("a"), F.max("head").alias("b"))
    return g.select("repo", F.when(F.col("m") == 2, "full_rebuild").when(F.col("m") == 1, "incremental").otherwise("reused").alias("mode"), F.when(F.col("a") == F.col("b"), F.col("a")).alias("only_head"))


def diff_summary(spark, d):
    c = read(spark, d, "cache_files").select("repo", P.normalize_path("path").alias("path")).groupBy("repo", "path").agg(F.count(F.lit(1)).alias("added")).withColumn("deleted", F.lit(0).cast("long"))
    s = read(spark, d, "source_files").select("repo", "path", F.lit("A").alias("status"))
    return evalmatrix.difference_summary(s, c, ["repo", "path"])


def candidate_pool(spark, d):
    docs = read(spark, d, "documents").filter("repo is not null and file is not null")
    found = docs.select("repo", "file", F.col("doc_id").alias("seq"))
    known = read(spark, d, "source_files").select("repo", F.col("path").alias("file"))
    return evalmatrix.candidate_pool(found, known, ["repo", "file"], "seq", 100)


def latest_run(spark, d):
    r = read(spark, d, "load_runs").select("repo", "run_id", "head", "status").groupBy("repo", "run_id").agg(F.max("head").alias("head"), F.max(F.when(F.col("status") == "ok", 1).otherwise(0)).alias("ok"))
    return evalmatrix.latest(r, ["repo"])


def _scores(spark, d):
    docs = read(spark, d, "documents").filter("text is not null")
    line = lines(docs, key="doc_id", content="text").filter(F.col("text").rlike(r"^Variant [A-Z]: "))
    label = F.regexp_extract("text", r"^Variant ([A-Z]): ", 1)
    parts = F.explode(F.regexp_extract_all("text", F.lit(r"[a-z]+_[a-z]+ [0-9]+"), F.lit(0)))
    return line.select("doc_id", label.alias("label"), parts.alias("p")).select("doc_id", "label", F.regexp_extract("p", r"^(\S+) ", 1).alias("measure"), F.regexp_extract("p", r" (\d+)$", 1).cast("long").alias("score"))


def score_matrix(spark, d):
    cells = [f"{v}_{m}" for v in "ABC" for m in evalmatrix.MEASURES]
    return evalmatrix.score_matrix(_scores(spark, d), ["doc_id"], "label", "measure", "score", cells)


def judgment_faults(spark, d):
    s = _scores(spark, d).withColumn("judgment", F.concat_ws("/", "doc_id", "label"))
    return evalmatrix.judgment_faults(s, "judgment", "measure", "score")


def deblind(spark, d):
    s = _scores(spark, d).select("doc_id", "label").distinct()
    labels = evalmatrix.blind_order(s.select("doc_id", F.lower("label").alias("variant")), "doc_id", "variant", T.stable_token(F.col("doc_id").cast("string"), F.col("variant")))
    return evalmatrix.reveal(s.unionByName(s.select("doc_id", F.lit("tie").alias("label")).distinct()), labels, "doc_id", "label")


def runs_per_agent(spark, d):
    """How many runs of each mode every repository has; the modes stand for the agents."""
    r = read(spark, d, "load_runs")
    tasks = r.groupBy("repo").agg(F.max(F.col("status") == "ok").alias("prepared"))
    return evalmatrix.runs_per_agent(tasks, r, "repo", "mode", RUN_MODES)


def run_states(spark, d):
    r = read(spark, d, "load_runs")
    return r.select("run_id", T.run_status(F.coalesce(F.col("status") == "ok", F.lit(False)), F.col("finished_at").isNotNull(), F.coalesce(F.col("status") == "running", F.lit(False))).alias("state"))


def text_rules(spark, d):
    t = F.col("text")
    return read(spark, d, "documents").select("doc_id", T.slugify(t).alias("slug"), T.truncate_text(t).alias("short"), T.kind_hint(t).alias("kind"), T.prompt_title(t).alias("title"))


def extract_functions(spark, d):
    from ..extract.udtf import functions_of

    return functions_of(read(spark, d, "source_files").select("repo", "path", "content")).select("repo", "path", "language", "fn_ord", "name", "qualified_name", "is_test", "line", "end_line", F.size("call_sites").alias("n_calls"), F.size("reference_sites").alias("n_references"))


def code_graph(spark, d):
    """The call graph of the source files: parsed, resolved within each language and merged."""
    from ..extract.udtf import functions_of

    f = read(spark, d, "source_files").select(F.concat_ws("/", "repo", "path").alias("path"), "content")
    edges = graph.call_edges(graph.numbered_functions(functions_of(f, references=False), ["call_sites"]))
    return edges.select("edge_id", "caller", "callee", F.array_join("conditions", " && ").alias("conditions"))


def line_heat_rank(spark, d):
    """References of every searched function in rank order, tests apart."""
    nodes, edges, refs = _graph(spark, d)
    info = enrich.reference_info(_seeds(spark, d), nodes, refs, graph.heat(edges, refs))
    return enrich.top_references(info).select("seed", "is_test", "rnk", "ref_id", "total")


_NAMES = """line_scan search_literal search_regex search_icase search_word search_invert search_max_count search_submatches search_context search_scoped
path_classify qualified_names graph_nodes enclosing_function enclosing_order fallback_lookup resolve_symbols resolve_qualified call_edges reference_edges
in_degree_heat callers_depth1 callers_depth3 references_of topk_hidden line_heat_rank enriched_search enriched_json graph_roots simple_paths dense_ids merge_graphs
block_merge block_context content_hash fingerprint change_set incremental_merge mode_rollup diff_summary candidate_pool latest_run score_matrix judgment_faults
deblind runs_per_agent run_states text_rules extract_functions code_graph""".split()
QUERIES = {n: globals()[n] for n in _NAMES}
# ---- the same in SQL -------------------------------------------------------------

_LINES = """lines AS (SELECT file_id, repo, path, u.i AS line_number, u.t AS text FROM source_files,
  LATERAL (SELECT unnest(string_split(regexp_replace(content, '\\n$', ''), chr(10))) AS t, generate_subscripts(string_split(regexp_replace(content, '\\n$', ''), chr(10)), 1) AS i) u
  WHERE content IS NOT NULL AND content <> '')"""
_EXT = "regexp_extract({p}, '[^/]+[.]([^./]*)$', 1)"


def _lang(p: str) -> str:
    e = _EXT.format(p=p)
    return "CASE " + " ".join(f"WHEN {e} = '{k}' THEN '{v}'" for k, v in P.EXTENSIONS.items()) + " END"


def _stem(p: str) -> str:
    name = f"regexp_extract({p}, '([^/]*)$', 1)"
    return f"CASE WHEN regexp_matches({name}, '^.+[.][^.]*$') THEN regexp_extract({name}, '^(.+)[.][^.]*$', 1) ELSE {name} END"


def _module(p: str, lang: str) -> str:
    s = _stem(p)
    return f"""CASE WHEN ({lang} = 'rust' AND ({s}) IN ('mod','lib','main')) OR ({lang} = 'python' AND ({s}) = '__init__') OR ({lang} IN ('javascript','jsx','typescript','tsx') AND ({s}) = 'index')
  THEN regexp_extract({p}, '([^/]*)/[^/]*$', 1) ELSE {s} END"""


def _test(p: str) -> str:
    s = f"({_stem(p)})"
    return f"(contains('/' || {p}, '/tests/') OR contains('/' || {p}, '/test/') OR contains('/' || {p}, '/__tests__/') OR {s} LIKE '%\\_test' ESCAPE '\\' OR {s} LIKE '%.test' OR {s} LIKE '%.spec' OR {s} LIKE '%\\_spec' ESCAPE '\\' OR {s} LIKE 'test\\_%' ESCAPE '\\')"


_F = "regexp_replace(file, '^\\./', '')"
_NODES = f"""gn AS (SELECT id, repo, name, qualified_name, coalesce({_lang(_F)}, lower(language)) AS language, {_F} AS file, coalesce(is_test, false) AS is_test, line, end_line
  FROM (SELECT * FROM nodes UNION ALL BY NAME SELECT * FROM shared_nodes)
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY repo DESC NULLS LAST, name DESC NULLS LAST, qualified_name DESC NULLS LAST, coalesce({_lang(_F)}, lower(language)) DESC NULLS LAST, {_F} DESC NULLS LAST, coalesce(is_test, false) DESC, line DESC NULLS LAST, end_line DESC NULLS LAST) = 1)"""
_EDGES = """e0 AS (SELECT edge_id, caller, callee, coalesce(conditions, []) AS c FROM edges WHERE caller IS NOT NULL AND callee IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY edge_id, caller, callee) = 1),
  e1 AS (SELECT caller, callee, min(edge_id) AS edge_id, bool_or(len(c) = 0) AS free, list(c ORDER BY edge_id) AS l FROM e0 GROUP BY 1, 2),
  e2 AS (SELECT edge_id, caller, callee, free, l[1] AS f, flatten(l[2:]) AS r FROM e1),
  ge AS (SELECT edge_id, caller, callee, CASE WHEN free THEN [] ELSE list_concat(f, list_filter(r, lambda x, i: list_position(r, x) = i AND NOT list_contains(f, x))) END AS conditions FROM e2)"""
_REFS = """gr AS (SELECT min(ref_id) AS ref_id, referencer, target, lower(coalesce(kind, 'argument')) AS kind, context FROM refs
  WHERE referencer IS NOT NULL AND target IS NOT NULL AND referencer <> target GROUP BY 2, 3, 4, 5)"""
_HEAT = "gh AS (SELECT id, count(*) AS heat FROM (SELECT callee AS id FROM ge UNION ALL SELECT target FROM gr) GROUP BY 1)"
_SEEDS = "seeds AS (SELECT DISTINCT seed FROM context_entries WHERE seed IS NOT NULL)"
_WORD_RX = r"(^|[^\w])limit([^\w]|$)"
_POINTS = f"pts AS (SELECT repo || '/' || path AS path, line_number, text FROM lines WHERE regexp_matches(text, '{_WORD_RX}'))"
_ENC = """enc AS (SELECT p.path, p.line_number, n.id AS node, n.qualified_name, n.name, n.is_test FROM pts p LEFT JOIN gn n ON n.repo || '/' || n.file = p.path AND n.end_line <> 0 AND p.line_number BETWEEN n.line AND n.end_line
  QUALIFY row_number() OVER (PARTITION BY p.path, p.line_number ORDER BY n.line DESC NULLS LAST, n.id DESC NULLS LAST) = 1)"""
_SIMPLE = "CASE WHEN contains({r}, '.') THEN regexp_extract({r}, '([^.]*)$', 1) WHEN contains({r}, '::') THEN regexp_extract({r}, '(?:.*::)?(.*)$', 1) ELSE {r} END"
_QUAL = "CASE WHEN NOT contains({r}, '.') AND contains({r}, '::') THEN regexp_extract({r}, '^(.*)::', 1) END"
_RESOLVE = f"""s2 AS (SELECT site, language, {_SIMPLE.format(r='raw')} AS nm, {_QUAL.format(r='raw')} AS q FROM sites),
  cand AS (SELECT s2.site, n.id AS target, s2.q, coalesce(starts_with(n.qualified_name, s2.q || '::') OR ({_module('n.file', 'n.language')}) = s2.q, false) AS hit FROM s2 JOIN gn n ON n.language = s2.language AND n.name = s2.nm)
SELECT site, target FROM cand QUALIFY q IS NULL OR hit OR NOT bool_or(hit) OVER (PARTITION BY site)"""
_RSITES = "rs AS (SELECT ref_id, any_value(referencer) AS referencer, any_value(target) AS target, any_value(context) AS context FROM refs GROUP BY 1)"
_CALLERS = """info AS (SELECT s.seed, e.caller, e.edge_id, n.file, n.name AS function, n.is_test, n.line, coalesce(h.heat, 0) AS heat
  FROM seeds s JOIN ge e ON e.callee = s.seed AND e.caller <> s.seed JOIN gn n ON n.id = e.caller LEFT JOIN gh h ON h.id = e.caller)"""
_RINFO = """rinfo AS (SELECT s.seed, r.ref_id, r.referencer, n.file, n.name AS function, n.is_test, n.line, coalesce(h.heat, 0) AS heat, r.context
  FROM seeds s JOIN gr r ON r.target = s.seed JOIN gn n ON n.id = r.referencer LEFT JOIN gh h ON h.id = r.referencer)"""
_COUNTS = "(SELECT seed, count(*) FILTER (WHERE NOT is_test) AS a, count(*) FILTER (WHERE is_test) AS b FROM {t} GROUP BY 1)"
_SCORES = r"""sc AS (SELECT doc_id, label, regexp_extract(p, '^(\S+) ', 1) AS measure, CAST(regexp_extract(p, ' (\d+)$', 1) AS BIGINT) AS score FROM
  (SELECT doc_id, regexp_extract(t, '^Variant ([A-Z]): ', 1) AS label, unnest(regexp_extract_all(t, '[a-z]+_[a-z]+ [0-9]+')) AS p FROM
   (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents) WHERE regexp_matches(t, '^Variant [A-Z]: ')))"""
_WS = r"trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'), ' ')"


def _json(**fields: str) -> str:
    """One JSON object as text, without the keys whose value is null; ``json:`` marks a value that is JSON already."""
    parts = [f"'\"{k}\":' || " + (v.removeprefix("json:") if v.startswith("json:") else f"CAST(to_json({v}) AS VARCHAR)") for k, v in fields.items()]
    known = [f"CASE WHEN {v.removeprefix('json:')} IS NOT NULL THEN {p} END" for p, v in zip(parts, fields.values())]
    return "'{' || array_to_string(list_filter([" + ", ".join(known) + "], lambda x: x IS NOT NULL), ',') || '}'"


def _search(where: str) -> str:
    return f"WITH {_LINES} SELECT file_id, line_number, text FROM lines WHERE {where}"


_ORD = "CASE language " + " ".join(f"WHEN '{k}' THEN {n}" for n, k, _ in P.LANGUAGES) + " ELSE 7 END"

SQL = {
    "line_scan": r"""SELECT doc_id, u.i AS line_number, u.t AS text FROM documents, LATERAL (SELECT unnest(string_split(regexp_replace(text, '\n$', ''), chr(10))) AS t,
  generate_subscripts(string_split(regexp_replace(text, '\n$', ''), chr(10)), 1) AS i) u WHERE text IS NOT NULL AND text <> ''""",
    "search_literal": _search("contains(text, 'return None')"),
    "search_regex": _search(rf"regexp_matches(text, '{REGEX}')"),
    "search_icase": _search("regexp_matches(text, '(?i)todo')"),
    "search_word": _search(f"regexp_matches(text, '{_WORD_RX}')"),
    "search_invert": _search("NOT regexp_matches(text, '[a-z]')"),
    "search_max_count": f"WITH {_LINES} SELECT file_id, line_number, text FROM lines WHERE contains(text, 'return') QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY line_number) <= 2",
    "search_submatches": f"""WITH {_LINES} SELECT file_id, line_number, CAST(len(regexp_extract_all(text, 'budget')) AS BIGINT) AS n, CAST(strlen(text[:position('budget' IN text) - 1]) AS BIGINT) AS first_start,
  CAST(strlen(text) - strlen(string_split(text, 'budget')[-1]) AS BIGINT) AS last_end FROM lines WHERE contains(text, 'budget')""",
    "search_context": f"""WITH {_LINES}, m AS (SELECT *, contains(text, 'return None') AS is_match FROM lines)
SELECT file_id, line_number, is_match FROM m QUALIFY bool_or(is_match) OVER (PARTITION BY file_id ORDER BY line_number ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING)""",
    "search_scoped": f"""WITH {_LINES} SELECT file_id, line_number FROM lines WHERE contains(text, 'import') AND ({_lang('path')}) IN ('typescript', 'tsx') AND (starts_with(path, 'apps/') OR starts_with(path, 'libs/'))
  AND contains(path, '/src/') AND NOT regexp_matches(path, '(?:^|/)[^/]*[.]spec[.][^/]*$')""",
    "path_classify": f"SELECT file_id, {_lang('path')} AS language, {_test('path')} AS is_test, {_module('path', '(' + _lang('path') + ')')} AS module FROM source_files",
    "qualified_names": f"""WITH {_NODES} SELECT id, CASE WHEN ({_module('file', 'language')}) = '' THEN name ELSE ({_module('file', 'language')}) || '::' || name END AS qualified,
  {_SIMPLE.format(r='qualified_name')} AS simple, {_QUAL.format(r='qualified_name')} AS qualifier FROM gn""",
    "graph_nodes": f"WITH {_NODES} SELECT id, repo, name, qualified_name, language, file, is_test, line, end_line FROM gn",
    "enclosing_function": f"WITH {_LINES}, {_NODES}, {_POINTS}, {_ENC} SELECT path, line_number, node, qualified_name FROM enc",
    "enclosing_order": """WITH o AS (SELECT o_custkey, o_orderkey, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS lo FROM orders),
  p AS (SELECT DISTINCT o.o_custkey AS cust, CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS day FROM lineitem JOIN o ON o.o_orderkey = l_orderkey)
SELECT p.cust, p.day, o.o_orderkey AS open_order FROM p LEFT JOIN o ON o.o_custkey = p.cust AND p.day BETWEEN o.lo AND o.lo + o.o_orderkey % 90
QUALIFY row_number() OVER (PARTITION BY p.cust, p.day ORDER BY o.lo DESC NULLS LAST, o.o_orderkey DESC NULLS LAST) = 1""",
    "fallback_lookup": f"""WITH {_LINES}, {_NODES}, {_POINTS},
  m AS (SELECT p.path, p.line_number, n.id AS node FROM pts p LEFT JOIN gn n ON NOT n.is_test AND n.repo || '/' || n.file = p.path AND n.end_line <> 0 AND p.line_number BETWEEN n.line AND n.end_line
    QUALIFY row_number() OVER (PARTITION BY p.path, p.line_number ORDER BY n.line DESC NULLS LAST, n.id DESC NULLS LAST) = 1),
  {_ENC}
SELECT m.path, m.line_number, coalesce(m.node, CASE WHEN {_test('m.path')} THEN enc.node END) AS node,
  CASE WHEN m.node IS NOT NULL THEN 'main' WHEN {_test('m.path')} AND enc.node IS NOT NULL THEN 'with_tests' END AS universe
FROM m JOIN enc ON enc.path = m.path AND enc.line_number = m.line_number""",
    "resolve_symbols": f"""WITH {_NODES}, {_RSITES}, sites AS (SELECT ref_id AS site, n.language, regexp_extract(context, '^passed to (.+)$', 1) AS raw FROM rs JOIN gn n ON n.id = rs.referencer
    WHERE regexp_extract(context, '^passed to (.+)$', 1) <> ''), {_RESOLVE}""",
    "resolve_qualified": f"""WITH {_NODES}, {_RSITES}, sites AS (SELECT ref_id AS site, n.language, t.qualified_name AS raw FROM rs JOIN gn n ON n.id = rs.referencer JOIN gn t ON t.id = rs.target), {_RESOLVE}""",
    "call_edges": f"WITH {_EDGES} SELECT edge_id, caller, callee, array_to_string(conditions, ' && ') AS conditions FROM ge",
    "reference_edges": f"WITH {_REFS} SELECT ref_id, referencer, target, kind, context FROM gr",
    "in_degree_heat": f"WITH {_EDGES}, {_REFS}, {_HEAT} SELECT id, heat FROM gh",
    "callers_depth1": f"WITH {_EDGES}, {_SEEDS} SELECT seed, caller, CAST(1 AS BIGINT) AS depth, edge_id, array_to_string(conditions, ' && ') AS conditions FROM seeds JOIN ge ON callee = seed AND caller <> seed",
    "callers_depth3": f"""WITH RECURSIVE {_SEEDS}, pairs AS (SELECT DISTINCT caller, callee FROM edges WHERE caller IS NOT NULL AND callee IS NOT NULL),
  b AS (SELECT seed, seed AS v, 0 AS depth FROM seeds UNION SELECT b.seed, p.caller, b.depth + 1 FROM b JOIN pairs p ON p.callee = b.v WHERE b.depth < 3)
SELECT seed, v AS caller, CAST(min(depth) AS BIGINT) AS depth FROM b GROUP BY 1, 2 HAVING v <> seed""",
    "references_of": f"WITH {_NODES}, {_EDGES}, {_REFS}, {_HEAT}, {_SEEDS}, {_RINFO} SELECT seed, ref_id, file, function, is_test, line, heat, context FROM rinfo",
    "topk_hidden": f"""WITH {_NODES}, {_EDGES}, {_REFS}, {_HEAT}, {_SEEDS}, {_CALLERS}
SELECT seed, is_test, row_number() OVER w AS rnk, caller, heat, greatest(count(*) OVER (PARTITION BY seed, is_test) - 5, 0) AS hidden FROM info
WINDOW w AS (PARTITION BY seed, is_test ORDER BY heat DESC, file NULLS FIRST, line NULLS FIRST, function NULLS FIRST, edge_id) QUALIFY row_number() OVER w <= 5""",
    "line_heat_rank": f"""WITH {_NODES}, {_EDGES}, {_REFS}, {_HEAT}, {_SEEDS}, {_RINFO}
SELECT seed, is_test, row_number() OVER w AS rnk, ref_id, count(*) OVER (PARTITION BY seed, is_test) AS total FROM rinfo
WINDOW w AS (PARTITION BY seed, is_test ORDER BY heat DESC, file NULLS FIRST, line NULLS FIRST, function NULLS FIRST, ref_id) QUALIFY row_number() OVER w <= 5""",
    "enriched_search": f"""WITH {_LINES}, {_NODES}, {_EDGES}, {_REFS}, {_HEAT}, {_POINTS}, {_ENC}, seeds AS (SELECT DISTINCT node AS seed FROM enc WHERE node IS NOT NULL), {_CALLERS}, {_RINFO},
  first AS (SELECT seed, function FROM info WHERE NOT is_test QUALIFY row_number() OVER (PARTITION BY seed ORDER BY heat DESC, file NULLS FIRST, line NULLS FIRST, function NULLS FIRST, edge_id) = 1)
SELECT enc.path, enc.line_number, enc.node, coalesce(c.a, 0) AS n_callers, coalesce(c.b, 0) AS n_test_callers, coalesce(r.a, 0) AS n_references, coalesce(r.b, 0) AS n_test_references, first.function AS first_caller
FROM enc LEFT JOIN {_COUNTS.format(t='info')} c ON c.seed = enc.node LEFT JOIN {_COUNTS.format(t='rinfo')} r ON r.seed = enc.node LEFT JOIN first ON first.seed = enc.node""",
    "enriched_json": f"""WITH {_LINES}, {_NODES}, {_EDGES}, {_REFS}, {_HEAT}, {_POINTS},
  enc AS (SELECT p.path, p.line_number, p.text, n.id AS node, n.qualified_name, n.name, n.is_test, n.line, n.language FROM pts p LEFT JOIN gn n ON n.repo || '/' || n.file = p.path AND n.end_line <> 0 AND p.line_number BETWEEN n.line AND n.end_line
    QUALIFY row_number() OVER (PARTITION BY p.path, p.line_number ORDER BY n.line DESC NULLS LAST, n.id DESC NULLS LAST) = 1),
  seeds AS (SELECT DISTINCT node AS seed FROM enc WHERE node IS NOT NULL), {_CALLERS}, {_RINFO},
  c5 AS (SELECT seed, is_test, row_number() OVER w AS rnk, {_json(file='file', function='function', is_test='is_test', line='line', conditions='conditions')} AS j FROM (SELECT info.*, ge.conditions FROM info JOIN ge USING (edge_id, caller))
    WINDOW w AS (PARTITION BY seed, is_test ORDER BY heat DESC, file NULLS FIRST, line NULLS FIRST, function NULLS FIRST, edge_id) QUALIFY rnk <= 5),
  r5 AS (SELECT seed, is_test, row_number() OVER w AS rnk, {_json(file='file', function='function', is_test='is_test', line='line', context='context')} AS j FROM rinfo
    WINDOW w AS (PARTITION BY seed, is_test ORDER BY heat DESC, file NULLS FIRST, line NULLS FIRST, function NULLS FIRST, ref_id) QUALIFY rnk <= 5),
  cl AS (SELECT seed, string_agg(j, ',' ORDER BY rnk) FILTER (WHERE NOT is_test) AS a, string_agg(j, ',' ORDER BY is_test, rnk) AS b FROM c5 GROUP BY 1),
  rl AS (SELECT seed, string_agg(j, ',' ORDER BY rnk) FILTER (WHERE NOT is_test) AS a, string_agg(j, ',' ORDER BY is_test, rnk) AS b FROM r5 GROUP BY 1),
  m AS (SELECT enc.*, CASE WHEN node IS NOT NULL THEN '[' || coalesce(CASE WHEN enc.is_test THEN cl.b ELSE cl.a END, '') || ']' END AS callers, CASE WHEN node IS NOT NULL THEN '[' || coalesce(CASE WHEN enc.is_test THEN rl.b ELSE rl.a END, '') || ']' END AS refs_,
      CASE WHEN nc.a > 5 THEN nc.a - 5 END AS hc, CASE WHEN nr.a > 5 THEN nr.a - 5 END AS hr, CASE WHEN nc.b > 0 THEN CASE WHEN enc.is_test THEN greatest(nc.b - 5, 0) ELSE nc.b END END AS htc, CASE WHEN nr.b > 0 THEN CASE WHEN enc.is_test THEN greatest(nr.b - 5, 0) ELSE nr.b END END AS htr
    FROM enc LEFT JOIN cl ON cl.seed = node LEFT JOIN rl ON rl.seed = node LEFT JOIN {_COUNTS.format(t='info')} nc ON nc.seed = node LEFT JOIN {_COUNTS.format(t='rinfo')} nr ON nr.seed = node)
SELECT path, line_number, {_json(callers='json:callers', content='text', file='path', function='name', function_line='line', hidden_callers='hc', hidden_references='hr', hidden_test_callers='htc', hidden_test_references='htr', is_test='is_test', language='language', line='line_number', qualified_name='qualified_name', references='json:refs_')} AS json FROM m""",
    "graph_roots": f"WITH {_NODES} SELECT id FROM gn WHERE id NOT IN (SELECT callee FROM edges WHERE callee IS NOT NULL AND caller IS NOT NULL)",
    "simple_paths": """WITH RECURSIVE t AS (SELECT DISTINCT caller, callee FROM call_tree WHERE caller IS NOT NULL AND callee IS NOT NULL),
  ids AS (SELECT caller AS id FROM call_tree WHERE caller IS NOT NULL UNION SELECT callee FROM call_tree WHERE callee IS NOT NULL),
  roots AS (SELECT id FROM ids WHERE id NOT IN (SELECT callee FROM call_tree WHERE callee IS NOT NULL)),
  w AS (SELECT [id] AS chain, id AS tip FROM roots UNION ALL SELECT list_append(w.chain, t.callee), t.callee FROM w JOIN t ON t.caller = w.tip WHERE len(w.chain) < 10 AND NOT list_contains(w.chain, t.callee)),
  done AS (SELECT chain FROM w WHERE len(chain) = 10 OR NOT EXISTS (SELECT 1 FROM t WHERE t.caller = w.tip AND NOT list_contains(w.chain, t.callee)))
SELECT row_number() OVER (ORDER BY chain) - 1 AS path_id, array_to_string(chain, '/') AS chain FROM done QUALIFY path_id < 100000""",
    "dense_ids": f"WITH {_NODES} SELECT id, row_number() OVER (ORDER BY {_ORD}, repo, file, line, id) - 1 AS dense FROM gn",
    "merge_graphs": f"""WITH {_NODES}, {_EDGES}, {_REFS}, n AS (SELECT *, {_ORD} AS o, row_number() OVER (ORDER BY {_ORD}, id) - 1 AS k FROM gn),
  e AS (SELECT a.k AS caller, b.k AS callee, array_to_string(ge.conditions, ' && ') AS conditions, row_number() OVER (ORDER BY a.o <> b.o, CASE WHEN a.o = b.o THEN a.o END, ge.edge_id, ge.caller, ge.callee) - 1 AS id
    FROM ge JOIN n a ON a.id = ge.caller JOIN n b ON b.id = ge.callee),
  r AS (SELECT a.k AS referencer, b.k AS target, gr.kind, gr.context, row_number() OVER (ORDER BY a.o <> b.o, CASE WHEN a.o = b.o THEN a.o END, gr.ref_id, gr.referencer, gr.target, gr.kind, gr.context NULLS FIRST) - 1 AS id
    FROM gr JOIN n a ON a.id = gr.referencer JOIN n b ON b.id = gr.target)
SELECT 'node' AS part, k AS id, name, qualified_name, language, file, is_test, line, end_line, NULL AS caller, NULL AS callee, NULL AS conditions, NULL AS referencer, NULL AS target, NULL AS kind, NULL AS context FROM n
UNION ALL BY NAME SELECT 'edge' AS part, id, caller, callee, conditions FROM e
UNION ALL BY NAME SELECT 'reference' AS part, id, referencer, target, kind, context FROM r""",
    "block_merge": f"""WITH {_LINES}, {_NODES}, {_POINTS}, {_ENC}, b AS (SELECT *, CASE WHEN qualified_name IS NOT NULL AND qualified_name IS NOT DISTINCT FROM lag(qualified_name) OVER (PARTITION BY path ORDER BY line_number) THEN 0 ELSE 1 END AS n FROM enc)
SELECT path, line_number, CAST(sum(n) OVER (PARTITION BY path ORDER BY line_number) AS BIGINT) AS block FROM b""",
    "block_context": f"""WITH {_LINES}, {_POINTS} SELECT l.repo || '/' || l.path AS path, CAST(1 AS BIGINT) AS block, l.line_number, bool_or(p.line_number = l.line_number) AS is_match
FROM lines l JOIN pts p ON p.path = l.repo || '/' || l.path AND l.line_number BETWEEN p.line_number - 1 AND p.line_number + 1 GROUP BY 1, 2, 3""",
    "content_hash": "SELECT file_id, sha256(coalesce(content, '')) AS hash, sha256(repo || '::' || path)[:12] AS token FROM source_files",
    "fingerprint": f"""WITH f AS (SELECT repo, {_lang('path')} AS language, regexp_replace(path, '^\\./', '') AS path, sha256(coalesce(content, '')) AS hash FROM source_files),
  e AS (SELECT repo, language, sha256(string_agg(path || chr(0) || hash || chr(0), '' ORDER BY path)) AS fingerprint, count(*) AS n_files FROM f WHERE language IS NOT NULL GROUP BY 1, 2)
SELECT repo, language, fingerprint, n_files FROM e
UNION ALL SELECT repo, NULL, sha256(string_agg(language || chr(0) || fingerprint || chr(0), '' ORDER BY {_ORD})), CAST(sum(n_files) AS BIGINT) FROM e GROUP BY 1""",
    "change_set": f"SELECT DISTINCT repo, regexp_replace(p, '^\\./', '') AS path FROM (SELECT repo, unnest(changed_files) AS p FROM load_runs WHERE status = 'ok') WHERE ({_lang('p')}) IS NOT NULL",
    "incremental_merge": """WITH s AS (SELECT repo, path, lower(source_hash) AS hash FROM (SELECT c.repo, regexp_replace(c.path, '^\\./', '') AS path, c.source_hash FROM cache_files c
    JOIN (SELECT run_id, max(finished_at) AS fin FROM load_runs WHERE status = 'ok' GROUP BY 1) r ON r.run_id = c.run_id
    QUALIFY row_number() OVER (PARTITION BY c.repo, regexp_replace(c.path, '^\\./', '') ORDER BY r.fin DESC NULLS LAST, c.run_id DESC, c.written_at DESC NULLS LAST, lower(c.source_hash) DESC NULLS LAST) = 1) WHERE source_hash IS NOT NULL),
  f AS (SELECT repo, regexp_replace(path, '^\\./', '') AS path, lower(coalesce(content_sha256, sha256(coalesce(content, '')))) AS hash FROM source_files)
SELECT coalesce(f.repo, s.repo) AS repo, coalesce(f.path, s.path) AS path, CASE WHEN s.path IS NULL THEN 'new' WHEN f.path IS NULL THEN 'dropped' WHEN s.hash = f.hash THEN 'kept' ELSE 'replaced' END AS origin
FROM f FULL JOIN s ON s.repo = f.repo AND s.path = f.path""",
    "mode_rollup": """SELECT repo, CASE max(CASE mode WHEN 'full_rebuild' THEN 2 WHEN 'incremental' THEN 1 ELSE 0 END) WHEN 2 THEN 'full_rebuild' WHEN 1 THEN 'incremental' ELSE 'reused' END AS mode,
  CASE WHEN count(DISTINCT head) = 1 THEN max(head) END AS only_head FROM load_runs WHERE status = 'ok' GROUP BY 1""",
    "diff_summary": """WITH c AS (SELECT repo, regexp_replace(path, '^\\./', '') AS path, count(*) AS added FROM cache_files GROUP BY 1, 2), s AS (SELECT repo, path, 'A' AS status FROM source_files)
SELECT repo, path, coalesce(status, 'M') AS status, coalesce(added, 0) AS added, CAST(0 AS BIGINT) AS deleted FROM s FULL JOIN c USING (repo, path)""",
    "candidate_pool": """SELECT repo, file, min(doc_id) AS seq FROM documents d WHERE repo IS NOT NULL AND file IS NOT NULL AND NOT EXISTS (SELECT 1 FROM source_files s WHERE s.repo = d.repo AND s.path = d.file)
GROUP BY 1, 2 ORDER BY seq LIMIT 100""",
    "latest_run": """WITH r AS (SELECT repo, run_id, max(head) AS head, max(CASE WHEN status = 'ok' THEN 1 ELSE 0 END) AS ok FROM load_runs GROUP BY 1, 2)
SELECT repo, run_id, head, ok FROM r QUALIFY row_number() OVER (PARTITION BY repo ORDER BY run_id DESC) = 1""",
    "score_matrix": "WITH " + _SCORES + " SELECT doc_id, " + ", ".join(f"max(score) FILTER (WHERE label = '{v}' AND measure = '{m}') AS \"{v}_{m}\"" for v in "ABC" for m in evalmatrix.MEASURES) + " FROM sc GROUP BY 1",
    "judgment_faults": f"WITH {_SCORES}, j AS (SELECT doc_id || '/' || label AS judgment, measure, score FROM sc) SELECT a.judgment, 'missing ' || m.m AS fault FROM (SELECT DISTINCT judgment FROM j) a, (SELECT unnest({evalmatrix.MEASURES}) AS m) m"
    " WHERE NOT EXISTS (SELECT 1 FROM j WHERE j.judgment = a.judgment AND j.measure = m.m) UNION SELECT judgment, 'range ' || measure FROM j WHERE score IS NULL OR score NOT BETWEEN 1 AND 5",
    "deblind": f"""WITH {_SCORES}, s AS (SELECT DISTINCT doc_id, label FROM sc), l AS (SELECT doc_id, lower(label) AS variant, chr(CAST(64 + row_number() OVER (PARTITION BY doc_id ORDER BY sha256(doc_id || '::' || lower(label))[:12], lower(label)) AS INT)) AS label FROM s)
SELECT s.doc_id, coalesce(l.variant, s.label) AS label FROM s LEFT JOIN l ON l.doc_id = s.doc_id AND l.label = s.label UNION ALL SELECT DISTINCT doc_id, 'tie' FROM s""",
    "runs_per_agent": """WITH n AS (SELECT repo, mode, count(*) AS n FROM load_runs WHERE mode IN ('incremental', 'full_rebuild', 'reused') GROUP BY 1, 2),
  t AS (SELECT repo, string_agg(mode || ':' || n, ', ' ORDER BY list_position(['incremental', 'full_rebuild', 'reused'], mode)) AS runs FROM n GROUP BY 1)
SELECT r.repo, coalesce(t.runs, CASE WHEN r.prepared THEN 'prepared' ELSE '-' END) AS runs FROM (SELECT repo, coalesce(bool_or(status = 'ok'), false) AS prepared FROM load_runs GROUP BY 1) r LEFT JOIN t ON t.repo = r.repo""",
    "text_rules": rf"""SELECT doc_id, regexp_replace(substring(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48), '-+$', '') AS slug,
  CASE WHEN length({_WS}) > 600 THEN rtrim(substring({_WS}, 1, 597), ' ') || '...' ELSE {_WS} END AS short,
  CASE WHEN regexp_matches(lower(text), 'bug|regression|crash|error|incorrect|broken|fails|failure|fix') THEN 'bug'
    WHEN regexp_matches(lower(text), 'feature|enhancement|proposal|rfc|support|add |allow|option|request') THEN 'feature' ELSE 'unknown' END AS kind,
  trim(regexp_replace(replace(text, '`', ''), '[ \t\n\r\f\v]+', ' ', 'g'), ' ') AS title FROM documents""",
    "run_states": "SELECT run_id, CASE WHEN status = 'ok' THEN 'published' WHEN finished_at IS NOT NULL THEN 'judged' WHEN status = 'running' THEN 'snapshotted' ELSE 'created' END AS state FROM load_runs",
}
