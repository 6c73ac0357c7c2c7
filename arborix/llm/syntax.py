"""Source files that do not parse (p4).

Every file is parsed by the parser of its extension: recursive descent on statements, precedence climbing on expressions, and panic mode after
a fault, so that all faults of a file are found. The parsers are those that the call-graph extraction uses.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..extract import js_parser, py_parser, rs_parser, svelte_parser
from ..extract.base import allow_depth
from ..functions.paths import extension, language_for_path
from ..session import spread

PARSERS = {
    "py": lambda t: py_parser.parse(t, memo=True),
    "js": lambda t: js_parser.parse(t, memo=True),
    "jsx": lambda t: js_parser.parse(t, jsx=True, memo=True),
    "ts": lambda t: js_parser.parse(t, typed=True, memo=True),
    "tsx": lambda t: js_parser.parse(t, jsx=True, typed=True, memo=True),
    "rs": lambda t: rs_parser.parse(t, memo=True),
    "svelte": lambda t: svelte_parser.parse(t, memo=True),
}


def faults_of(ext: str, content: str) -> list[tuple[int, str]]:
    """(line, message) of every fault in the order of the text; empty for a valid file."""
    found = PARSERS[ext](content).faults
    out, line, at = [], 1, 0
    for a, what in sorted(found):
        line += content.count("\n", at, a) if a > at else 0
        at = max(at, a)
        out.append((line, what))
    return out


def _check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    allow_depth()
    for f in frames:
        rows = []
        for ext, content in zip(f["_ext"], f["_content"]):
            found = faults_of(ext, content)
            rows.append([{"line": n, "message": m} for n, m in found])
        yield pd.DataFrame({"file_id": f["file_id"], "faults": rows})


def check(files: DataFrame) -> DataFrame:
    """file_id, faults ARRAY<STRUCT<line, message>> of every file whose extension stands for a known language.

    A null or empty content is valid. Files of other extensions, and rows without a path, are left out. Equal file_ids give a row each.
    """
    rows = files.select("file_id", extension("path").alias("_ext"), F.coalesce("content", F.lit("")).alias("_content")).filter(F.col("_ext").isin(*PARSERS))
    return spread(rows, "file_id").mapInPandas(_check, "file_id long, faults array<struct<line:long,message:string>>")


def invalid(files: DataFrame) -> DataFrame:
    """file_id, n_faults, first_line, first_fault, faults (all, with line and message, in the order of the text) of the files that do not parse."""
    return check(files).filter(F.size("faults") > 0).select("file_id", F.size("faults").cast("long").alias("n_faults"), F.get("faults", F.lit(0))["line"].alias("first_line"), F.get("faults", F.lit(0))["message"].alias("first_fault"), "faults")


def errors(files: DataFrame) -> DataFrame:
    """file_id, ord (from 1), line, message: one row for every fault of every file, in the order of the text; ord 1 is the first cause."""
    return check(files).select("file_id", F.posexplode("faults").alias("at", "f")).select("file_id", (F.col("at") + 1).cast("long").alias("ord"), F.col("f.line").alias("line"), F.col("f.message").alias("message"))


def languages(files: DataFrame) -> DataFrame:
    """language, n_files, n_invalid, acceptance: the share of valid files of each language, over all repositories."""
    total = rates(files).groupBy("language").agg(F.sum("n_files").alias("n_files"), F.sum("n_invalid").alias("n_invalid"))
    return total.withColumn("acceptance", 1 - F.col("n_invalid") / F.col("n_files"))


def rates(files: DataFrame) -> DataFrame:
    """repo, language (of the extension), n_files, n_invalid, acceptance: the share of valid files, per repository and language.

    The parse result stays beside the file's own row (nothing is joined back), and counts are combined before the shuffle. A null repo is a
    group of its own.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        allow_depth()
        for f in frames:
            bad = [bool(PARSERS[e](c).faults) for e, c in zip(f["_ext"], f["_content"])]
            yield pd.DataFrame({"repo": f["repo"], "language": f["language"], "bad": bad})

    rows = files.select("repo", "path", language_for_path("path").alias("language"), extension("path").alias("_ext"), F.coalesce("content", F.lit("")).alias("_content")).filter(F.col("_ext").isin(*PARSERS))
    each = spread(rows, "path").drop("path").mapInPandas(count, "repo string, language string, bad boolean")
    return each.groupBy("repo", "language").agg(F.count(F.lit(1)).alias("n_files"), F.count_if("bad").alias("n_invalid")).withColumn("acceptance", 1 - F.col("n_invalid") / F.col("n_files"))
