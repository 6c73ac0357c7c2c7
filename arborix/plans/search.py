"""Search with call context: matching lines, the functions around them, and who calls and references those."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import is_test_path, normalize_path
from ..functions.render import Colors, render_block
from ..operators import blocks, enrich, search
from ..operators.graph import heat
from ..session import Stages
from ..sources.scan import lines


def enriched_matches(files: DataFrame, index: dict[str, DataFrame], pattern: str, flags: list[str] | None = None, paths: list[str] | None = None, depth: int = 1, limit: int = enrich.MAX_CONTEXT, test_index: dict[str, DataFrame] | None = None) -> DataFrame:
    """One row per matching line with its spans, its function (null columns outside one) and that function's context.

    With ``test_index``, test files that the main index does not cover are looked up there. No match is an empty result; an invalid pattern is an
    error.
    """
    o = search.parse_flags(flags or [])
    stages = Stages(files.sparkSession, "search")
    wanted = search.select_files(files, o, paths)
    hits = search.submatches(search.matches(lines(wanted), pattern, o), pattern, o) if not o.invert else search.matches(lines(wanted), pattern, o).withColumn("submatches", F.array().cast("array<struct<start:bigint,end:bigint>>"))
    if test_index:
        found = enrich.enclose_with_fallback(hits, index["nodes"], test_index["nodes"], is_test_path(normalize_path("path")))
    else:
        found = enrich.enclose(hits, index["nodes"]).withColumn("universe", F.when(F.col("node").isNotNull(), "main"))
    found = stages.put(found)
    out = None
    for name, ix in (("main", index), ("with_tests", test_index)):
        if ix is None:
            continue
        part = found.filter(F.col("universe") == name)
        seeds = part.select(F.col("node").alias("seed")).distinct()
        ctx = enrich.node_contexts(seeds, ix["nodes"], ix["edges"], ix["references"], heat(ix["edges"], ix["references"]), depth, limit)
        rows = part.join(ctx, F.col("node") == F.col("seed"), "left").drop("seed")
        out = rows if out is None else out.unionByName(rows)
    outside = found.filter("universe is null")
    return out.unionByName(outside, allowMissingColumns=True)


def search_json(files: DataFrame, index: dict[str, DataFrame], pattern: str, show_tests: bool = False, limit: int = enrich.MAX_CONTEXT, **how) -> DataFrame:
    """path, line_number, json in the order of paths and lines."""
    return enrich.json_rows(enriched_matches(files, index, pattern, limit=limit, **how), show_tests, limit).orderBy("path", "line_number")


def write_json_lines(rows: DataFrame, path: str) -> None:
    """One object per line."""
    rows.select("json").write.text(path)


def search_text(files: DataFrame, index: dict[str, DataFrame], pattern: str, flags: list[str] | None = None, show_tests: bool = False, limit: int = enrich.MAX_CONTEXT, compact: bool = False, colors: Colors | None = None, **how):
    """Yield the text of each block, in the order of paths and lines; rows come to the driver a partition at a time."""
    o = search.parse_flags(flags or [])
    stages = Stages(files.sparkSession, "text")
    hits = stages.put(enriched_matches(files, index, pattern, flags, limit=limit, **how))
    numbered = blocks.merge_blocks(hits, "path", "line_number", "qualified_name")
    shown = blocks.block_lines(numbered.select("path", "block", "line_number"), lines(search.select_files(files, o).join(hits.select("path").distinct(), "path", "left_semi")), o.before, o.after)
    spans = numbered.select(F.col("path").alias("_p"), F.col("line_number").alias("_l"), "submatches")
    shown = shown.join(spans, (F.col("path") == F.col("_p")) & (F.col("line_number") == F.col("_l")) & F.col("is_match"), "left").drop("_p", "_l")
    code = shown.groupBy("path", "block").agg(F.array_sort(F.collect_list(F.struct("line_number", "text", "is_match", "submatches"))).alias("code"))
    # the first match of a block stands for it
    cols = ["function", "function_line", "node_is_test", "callers", "test_callers", "references", "test_references", "n_callers", "n_test_callers", "n_references", "n_test_references"]
    heads = numbered.groupBy("path", "block").agg(F.min_by(F.struct(*cols), "line_number").alias("head"))
    for r in heads.join(code, ["path", "block"]).orderBy("path", "block").toLocalIterator():
        head = r["head"].asDict(recursive=True) | {"path": r["path"]}
        rows = [(x["line_number"], x["text"].removesuffix("\r"), x["is_match"], [(s["start"], s["end"]) for s in x["submatches"] or []]) for x in r["code"]]
        yield render_block(head, rows, show_tests, limit, colors, compact)
