"""Source files and their lines as DataFrames."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import EXTENSIONS, is_test_path, language_for_path
from ..operators.search import glob_regex
from ..session import small_table

FILES = "path string, language string, content string, is_test boolean, content_sha256 string"
# Files that hold ignore rules; of one folder the later file wins.
IGNORE_FILES = (".gitignore", ".ignore")
#: Bytes of contents in one batch, and folders for each core that the walk is divided into.
BATCH_BYTES, FOLDERS = 8 << 20, 8


class Ignores:
    """Ignore rules of a folder and those around it: the last rule that matches a path decides, rules of inner folders after those of outer ones."""

    def __init__(self, rules: tuple = ()):
        self.rules = rules

    def within(self, folder: str, rel: str) -> Ignores:
        """These rules and those of the ignore files in ``folder``, whose path from the root is ``rel``."""
        found = []
        names = [*IGNORE_FILES] if rel else [".git/info/exclude", *IGNORE_FILES]
        for name in names:
            try:
                with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
                    found += [r for line in f if (r := self._rule(line.rstrip("\n\r")))]
            except OSError:
                pass
        return Ignores((*self.rules, *((rel + "/" if rel else "", *r) for r in found))) if found else self

    @staticmethod
    def _rule(line: str) -> tuple | None:
        """(pattern, whether it takes back, whether it is for folders only) of a line; None for blanks and comments."""
        line = line if line.endswith("\\ ") else line.rstrip(" ")
        if not line or line.startswith("#"):
            return None
        back = line.startswith("!")
        glob = (line[1:] if back else line).removeprefix("\\")
        body = glob.rstrip("/")
        return (re.compile(glob_regex(body)), back, glob.endswith("/")) if body else None

    def hide(self, rel: str, is_dir: bool) -> bool:
        for base, rx, back, folders in reversed(self.rules):
            if (is_dir or not folders) and rel.startswith(base) and rx.search(rel[len(base) :]):
                return not back
        return False


def _entries(base: str, rel: str, rules: Ignores | None) -> tuple[list[str], list[str], Ignores | None]:
    """(folders, source files, rules) of a folder: no hidden entries, no links, none that the rules hide; what cannot be read is left out."""
    folder = os.path.join(base, rel)
    rules = rules.within(folder, rel) if rules is not None else None
    dirs, files = [], []
    try:
        found = sorted(os.scandir(folder), key=lambda e: e.name)
    except OSError:
        return [], [], rules
    for e in found:
        path = f"{rel}/{e.name}" if rel else e.name
        is_dir = e.is_dir(follow_symlinks=False)
        if e.name.startswith(".") or (rules is not None and rules.hide(path, is_dir)):
            continue
        if is_dir:
            dirs.append(path)
        elif e.is_file(follow_symlinks=False) and e.name.rpartition(".")[2] in EXTENSIONS and not e.name.startswith("."):
            files.append(path)
    return dirs, files, rules


def _rules_at(base: str, rel: str) -> Ignores:
    """The rules that hold in the folder around ``rel``."""
    rules, parts = Ignores(), rel.split("/") if rel else []
    for i in range(len(parts)):
        at = "/".join(parts[:i])
        rules = rules.within(os.path.join(base, at), at)
    return rules


def scan_files(spark: SparkSession, root: str, include_tests: bool = True, respect_ignores: bool = True) -> tuple[DataFrame, DataFrame]:
    """(files, unreadable): the source files of a tree, and those that are no UTF-8.

    Paths are relative to ``root``, a folder that all executors see. Hidden entries, links, other extensions and (unless asked for) tests are left
    out by path, before any content is read; with ``respect_ignores`` the rules of ignore files hold, in repositories and elsewhere, in every
    folder for what is below it. The driver walks only so far as to divide the tree among the tasks, which list and read the rest; no list of
    paths is gathered. Empty files count; unreadable ones are set aside rather than failing the scan.
    """
    base = os.path.realpath(root.removeprefix("file://"))
    wide = spark.sparkContext.defaultParallelism * FOLDERS
    open_, units = [("", Ignores() if respect_ignores else None)], []
    while open_ and len(open_) + len(units) < wide:
        rel, rules = open_.pop(0)
        dirs, _, rules = _entries(base, rel, rules)
        units.append((rel, False))
        open_ += [(d, rules) for d in dirs]
    units += [(rel, True) for rel, _ in open_]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, contents, n = [], [], 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])
        for b in batches:
            for rel, deep in zip(*(c.to_pylist() for c in b.columns)):
                todo = [(rel, _rules_at(base, rel) if respect_ignores else None)]
                while todo:
                    at, rules = todo.pop()
                    dirs, files, rules = _entries(base, at, rules)
                    todo += [(d, rules) for d in dirs] if deep else []
                    for path in files:
                        try:
                            with open(os.path.join(base, path), "rb") as f:
                                contents.append(f.read())
                        except OSError:
                            continue
                        paths.append(path)
                        n += len(contents[-1])
                        if n >= BATCH_BYTES:
                            yield out()
                            paths, contents, n = [], [], 0
        yield out()

    raw = small_table(spark, units, "folder string, deep boolean").repartition(min(len(units), wide), "folder").mapInArrow(read, "path string, content binary")
    rows = raw.withColumn("language", language_for_path("path")).filter("language is not null").withColumn("is_test", is_test_path("path"))
    if not include_tests:
        rows = rows.filter("not is_test")
    text = rows.withColumn("text", F.col("content").cast("string"))
    good = F.is_valid_utf8("text")
    files = text.filter(good).select("path", "language", F.col("text").alias("content"), "is_test", F.sha2("text", 256).alias("content_sha256"))
    return files, text.filter(~good).select("path", "language")


def lines(texts: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """key, line_number, text: the lines of every text.

    A final line break begins no further line; an empty or null text has no lines; a carriage return stays part of its line.
    """
    body = F.regexp_replace(F.col(content), r"\n\z", "")
    rows = texts.filter(F.col(content).isNotNull() & (F.col(content) != "")).select(F.col(key), F.posexplode(F.split(body, "\n", -1)).alias("p", "text"))
    return rows.select(key, (F.col("p") + 1).cast("long").alias("line_number"), "text")
