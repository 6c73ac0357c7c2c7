"""Line search: patterns, flags, spans of matches and context lines."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# POSIX classes, which Java reads as something else, as ASCII ranges.
_POSIX = {"alpha": "A-Za-z", "digit": "0-9", "alnum": "0-9A-Za-z", "upper": "A-Z", "lower": "a-z", "space": r"\t\n\x0B\f\r ", "blank": r"\t ", "punct": r"!-/:-@\[-`{-~", "xdigit": "0-9A-Fa-f", "word": "0-9A-Za-z_", "cntrl": r"\x00-\x1F\x7F", "print": r"\x20-\x7E", "graph": r"\x21-\x7E"}
# Type names of -t by language.
TYPES = {"rust": ["rust"], "py": ["python"], "python": ["python"], "js": ["javascript", "jsx"], "ts": ["typescript", "tsx"], "svelte": ["svelte"]}


@dataclass
class SearchOptions:
    """The supported flags; anything else is refused."""

    ignore_case: bool = False
    smart_case: bool = False
    word: bool = False
    line: bool = False
    fixed: bool = False
    invert: bool = False
    patterns: list[str] = field(default_factory=list)
    types: list[str] = field(default_factory=list)
    not_types: list[str] = field(default_factory=list)
    globs: list[str] = field(default_factory=list)
    max_count: int | None = None
    before: int = 0
    after: int = 0


def parse_flags(args: list[str]) -> SearchOptions:
    """Read search flags. The last of several context settings wins, an unreadable number counts as not given."""
    o = SearchOptions()
    i = 0

    def number(x: str) -> int | None:
        return int(x) if x.isdigit() else None

    def setting(flag: str, value: str) -> None:
        n = number(value)
        if n is not None:
            if flag in "BC":
                o.before = n
            if flag in "AC":
                o.after = n

    simple = {"-i": "ignore_case", "--ignore-case": "ignore_case", "-S": "smart_case", "--smart-case": "smart_case", "-w": "word", "--word-regexp": "word", "-x": "line", "--line-regexp": "line", "-F": "fixed", "--fixed-strings": "fixed", "-v": "invert", "--invert-match": "invert"}
    lists = {"-e": "patterns", "--regexp": "patterns", "-t": "types", "--type": "types", "-T": "not_types", "--type-not": "not_types", "-g": "globs", "--glob": "globs"}
    long_context = {"--after-context": "A", "--before-context": "B", "--context": "C"}
    while i < len(args):
        a = args[i]
        name, eq, value = a.partition("=")
        if a in ("-s", "--case-sensitive"):
            o.ignore_case = o.smart_case = False
        elif a in simple:
            setattr(o, simple[a], True)
        elif name in lists and (eq or i + 1 < len(args)):
            if not eq:
                i += 1
                value = args[i]
            getattr(o, lists[name]).append(value)
        elif name in ("-m", "--max-count") and (eq or i + 1 < len(args)):
            if not eq:
                i += 1
                value = args[i]
            o.max_count = number(value)
        elif re.fullmatch(r"-[ABC]", a) and i + 1 < len(args):
            i += 1
            setting(a[1], args[i])
        elif re.fullmatch(r"-[ABC]\d+", a):
            setting(a[1], a[2:])
        elif name in long_context and eq:
            setting(long_context[name], value)
        elif a == "--hidden":
            pass
        else:
            raise ValueError(f"unsupported flag: {a}")
        i += 1
    return o


def to_java(pattern: str) -> str:
    """A linear-time engine's pattern in Java's dialect; look-around and back-references are refused as that engine would."""
    if re.search(r"\(\?(?:[=!]|<[=!])", pattern) or re.search(r"(?<!\\)(?:\\\\)*\\[1-9]", pattern):
        raise ValueError("look-around and back-references are not supported")
    return "(?U)" + re.sub(r"\[:(\w+):\]", lambda m: _POSIX.get(m.group(1), m.group(0)), pattern)


def compiled(pattern: str, o: SearchOptions) -> str:
    """The Java pattern of one line match."""
    if o.fixed:
        body = "(?U)" + re.sub(r"([\\.\[\]{}()*+?^$|#&~\-])", r"\\\1", pattern)
    else:
        body = to_java(pattern)
    flags = "(?i)" if o.ignore_case or (o.smart_case and pattern == pattern.lower()) else ""
    inner = body[4:]
    if o.word:
        inner = rf"(?<![\w])(?:{inner})(?![\w])"
    if o.line:
        inner = rf"^(?:{inner})$"
    return "(?U)" + flags + inner


def predicate(text: Column, pattern: str, o: SearchOptions | None = None) -> Column:
    """Whether a line matches; a literal becomes a plain substring test."""
    o = o or SearchOptions()
    hit = None
    for p in [pattern, *o.patterns] if pattern is not None else o.patterns:
        one = text.contains(p) if o.fixed and not (o.ignore_case or o.smart_case or o.word or o.line) else text.rlike(compiled(p, o))
        hit = one if hit is None else hit | one
    return ~hit if o.invert else hit


def glob_regex(glob: str) -> str:
    """A path glob as a regular expression; without a slash it may match at any depth."""
    out, i = "", 0
    g = glob.lstrip("!")
    while i < len(g):
        c = g[i]
        if g.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif g.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "{" and "}" in g[i:]:
            j = g.index("}", i)
            out, i = out + "(?:" + "|".join(re.escape(x) for x in g[i + 1 : j].split(",")) + ")", j + 1
        elif c == "[" and "]" in g[i:]:
            j = g.index("]", i)
            out, i = out + g[i : j + 1].replace("[!", "[^"), j + 1
        else:
            out, i = out + re.escape(c), i + 1
    return ("^" if "/" in g else "(?:^|/)") + out.lstrip("/") + "$"


def in_scope(path: Column, scopes: list[str]) -> Column:
    """Whether a path is one of the searched paths or lies below one; no scope, or the root, takes all."""
    hit = None
    for s in scopes:
        s = s.removeprefix("./").rstrip("/")
        one = F.lit(True) if s in ("", ".") else (path == s) | path.startswith(s + "/")
        hit = one if hit is None else hit | one
    return F.lit(True) if hit is None else hit


def select_files(files: DataFrame, o: SearchOptions, scopes: list[str] | None = None) -> DataFrame:
    """The files a search reads: by type, glob and scope, decided from the path before any content is split."""
    out = files.filter(in_scope(F.col("path"), scopes or []))
    known = lambda names: [x for n in names for x in TYPES.get(n, [n])]
    if o.types:
        out = out.filter(F.col("language").isin(known(o.types)))
    if o.not_types:
        out = out.filter(~F.coalesce(F.col("language").isin(known(o.not_types)), F.lit(False)))
    wanted = [g for g in o.globs if not g.startswith("!")]
    for g in (g for g in o.globs if g.startswith("!")):
        out = out.filter(~F.col("path").rlike(glob_regex(g)))
    if wanted:
        hit = F.lit(False)
        for g in wanted:
            hit = hit | F.col("path").rlike(glob_regex(g))
        out = out.filter(hit)
    return out


def matches(lines: DataFrame, pattern: str, o: SearchOptions | None = None, key: str = "path") -> DataFrame:
    """key, line_number, text of the matching lines, at most ``max_count`` of each file."""
    o = o or SearchOptions()
    out = lines.filter(predicate(F.col("text"), pattern, o))
    if o.max_count is not None:
        w = Window.partitionBy(key).orderBy("line_number")
        out = out.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= o.max_count).drop("_n")
    return out


def submatches(hits: DataFrame, pattern: str, o: SearchOptions | None = None) -> DataFrame:
    """``hits`` with submatches ARRAY<STRUCT<start, end>>: the byte spans [start, end) of all matches of a line, left to right.

    The line is split at its matches; the lengths of the pieces in bytes, added up, are the spans, without any Python. Of several patterns the
    first one that matches at a place counts there.
    """
    o = o or SearchOptions()
    rx = "|".join(f"(?:{compiled(p, o)})" for p in ([pattern, *o.patterns] if pattern is not None else o.patterns))
    found = F.regexp_extract_all("text", F.lit(rx), F.lit(0))
    # matches are marked by a run of a private character that is longer than any in the line, between two of another, so whatever characters the
    # line has, the pieces between the marks can be measured
    runs = F.regexp_extract_all("text", F.lit("\ue001+"), F.lit(0))
    longest = F.when(F.col("text").contains("\ue001"), F.array_max(F.transform(runs, F.length))).otherwise(0)
    mark = F.concat(F.lit("\ue000"), F.repeat(F.lit("\ue001"), longest + 1), F.lit("\ue000"))
    gaps = F.split(F.regexp_replace("text", F.lit(rx), mark), mark, -1)
    pairs = F.arrays_zip(gaps.alias("gap"), found.alias("hit"))
    step = lambda acc, x: F.struct(
        (acc["at"] + F.octet_length(x["gap"]) + F.coalesce(F.octet_length(x["hit"]), F.lit(0))).cast("long").alias("at"),
        F.when(x["hit"].isNull(), acc["spans"]).otherwise(F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.octet_length(x["gap"])).cast("long").alias("start"), (acc["at"] + F.octet_length(x["gap"]) + F.octet_length(x["hit"])).cast("long").alias("end"))))).alias("spans"),
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))
    return hits.withColumn("submatches", F.aggregate(pairs, start, step, lambda acc: acc["spans"]))


def with_context(texts: DataFrame, is_match: Callable[[Column], Column], before: int, after: int, key: str = "path", content: str = "content") -> DataFrame:
    """key, line_number, text, is_match of the matching lines and those within ``before`` lines above or ``after`` below one.

    The lines are chosen within the row of their text, before they become rows: nothing is shuffled, and lines that are not shown are never
    made. Lines are those of ``sources.scan.lines``; texts without a match give no row.
    """
    body = F.split(F.regexp_replace(F.col(content), r"\n\z", ""), "\n", -1)
    rows = texts.filter(F.col(content).isNotNull() & (F.col(content) != "")).select(F.col(key), body.alias("_t"))
    rows = rows.withColumn("_m", F.transform("_t", lambda t: F.coalesce(is_match(t), F.lit(False)))).filter(F.array_contains("_m", True))
    near = lambda i: F.array_contains(F.slice("_m", F.greatest(i + 1 - after, F.lit(1)), F.least(i, F.lit(after)) + 1 + before), True)
    shown = F.filter(F.transform("_t", lambda t, i: F.struct((i + 1).cast("long").alias("line_number"), t.alias("text"), F.get("_m", i).alias("is_match"), near(i).alias("near"))), lambda x: x["near"])
    return rows.select(key, F.explode(shown).alias("x")).select(key, "x.line_number", "x.text", "x.is_match")
