"""Resolving names at call and reference sites to functions of the same language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.paths import module_name, normalize_path
from ..session import Stages
from .skew import salted_join


def simple_name(raw: Column) -> Column:
    """What follows the last dot, else the last ``::``, else the whole text."""
    return F.when(raw.contains("."), F.regexp_extract(raw, r"([^.]*)$", 1)).when(raw.contains("::"), F.regexp_extract(raw, r"(?:.*::)?(.*)$", 1)).otherwise(raw)


def qualifier(raw: Column) -> Column:
    """What comes before the last ``::`` of a name without a dot; null without one."""
    return F.when(~raw.contains(".") & raw.contains("::"), F.regexp_extract(raw, r"(?s)^(.*)::", 1))


def resolve(sites: DataFrame, nodes: DataFrame, raw: str, keep: list[str]) -> DataFrame:
    """``keep`` columns of each site with ``target`` (a node id), one row per function the name may mean.

    ``sites`` has language, a site id ``site`` and the raw name; ``nodes`` has id, name, qualified_name, language and file. Candidates share
    language and simple name. Where the site has a qualifier and some candidates' qualified names begin with it, or their file's module is it,
    only those count; otherwise all do. Null names and languages resolve to nothing.
    """
    s = sites.select("site", *[c for c in keep if c != "site"], F.col("language").alias("s_lang"), simple_name(F.col(raw)).alias("s_name"), qualifier(F.col(raw)).alias("q"))
    # language and name as one key (a language has no such character), so that the sites of a name that all use are spread
    both = lambda a, b: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.concat_ws("\x01", a, b))
    s = Stages(sites.sparkSession, "resolve").put(s.withColumn("s_key", both("s_lang", "s_name")).drop("s_lang"))
    return candidates(s, nodes, both("language", "name"), keep)


def candidates(s: DataFrame, nodes: DataFrame, key: Column, keep: list[str]) -> DataFrame:
    """``resolve`` for sites that have their key ``s_key`` and their qualifier ``q``; ``key`` is that of the nodes. ``s`` should be cheap to read."""
    n = nodes.select(F.col("id").alias("target"), key.alias("n_key"), F.col("qualified_name").alias("n_qual"), module_name(normalize_path("file"), "language").alias("n_mod"))
    cand = salted_join(s, n, "s_key", "n_key", F.col("site"), "inner")
    hit = F.coalesce(F.col("n_qual").startswith(F.concat("q", F.lit("::"))) | (F.col("n_mod") == F.col("q")), F.lit(False))
    # only sites with a qualifier need to know whether any candidate has it
    plain = cand.filter("q is null")
    asked = cand.filter("q is not null").withColumn("hit", hit).withColumn("any", F.max("hit").over(Window.partitionBy("site"))).filter("hit or not any").drop("hit", "any")
    cols = list(dict.fromkeys([*keep, "target"]))
    return plain.select(*cols).unionByName(asked.select(*cols))
