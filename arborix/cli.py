"""Command line: ``python -m arborix [FLAGS] PATTERN [PATH...]``."""

from __future__ import annotations

import os
import sys
from dataclasses import dataclass, field

from .operators.search import parse_flags

USAGE = "arborix [--json | --compact] [--depth N] [--max-context N] [--include-tests] [--show-tests] [--color auto|always|never] [--build-index] [SEARCH FLAGS] PATTERN [PATH...]"
_TAKES_VALUE = frozenset(["-e", "--regexp", "-t", "--type", "-T", "--type-not", "-g", "--glob", "-m", "--max-count", "-A", "-B", "-C"])


class UsageError(ValueError):
    """Arguments that cannot go together or are missing."""


@dataclass
class Command:
    pattern: str | None = None
    paths: list[str] = field(default_factory=list)
    flags: list[str] = field(default_factory=list)
    json: bool = False
    compact: bool = False
    build_index: bool = False
    include_tests: bool = False
    show_tests: bool = False
    depth: int = 1
    max_context: int = 5
    color: str = "auto"


def looks_like_path(arg: str) -> bool:
    return arg in (".", "..") or "/" in arg or os.path.exists(arg)


def parse_args(argv: list[str]) -> Command:
    """Own options, search flags, the pattern and the paths.

    Trailing arguments that look like paths are paths; the last one before them is the pattern. What begins with a dash is a flag unless ``--``
    comes before it.
    """
    c, rest, i, literal = Command(), [], 0, False
    own = {"--json": "json", "--compact": "compact", "--build-index": "build_index", "--include-tests": "include_tests", "--show-tests": "show_tests"}
    while i < len(argv):
        a = argv[i]
        name, eq, value = a.partition("=")
        if literal or not a.startswith("-") or a == "-":
            rest.append(a)
        elif a == "--":
            literal = True
        elif a in own:
            setattr(c, own[a], True)
        elif name in ("--depth", "--max-context", "--color"):
            if not eq:
                i += 1
                if i == len(argv):
                    raise UsageError(f"{name} needs a value")
                value = argv[i]
            if name == "--color":
                c.color = value
            elif not value.isdigit():
                raise UsageError(f"{name} needs a number")
            else:
                setattr(c, "depth" if name == "--depth" else "max_context", int(value))
        else:
            c.flags.append(a)
            if a in _TAKES_VALUE and i + 1 < len(argv):
                i += 1
                c.flags.append(argv[i])
        i += 1
    if c.json and c.compact:
        raise UsageError("--json and --compact cannot go together")
    if c.build_index and (c.json or c.compact or c.show_tests):
        raise UsageError("--build-index takes no output options")
    given = parse_flags(c.flags).patterns
    while len(rest) > (0 if given else 1) and looks_like_path(rest[-1]):
        c.paths.insert(0, rest.pop())
    if rest:
        c.pattern = rest.pop()
    if rest:
        raise UsageError(f"unexpected argument: {rest[0]}")
    if c.build_index:
        if c.pattern is not None:
            c.paths.insert(0, c.pattern)
            c.pattern = None
    elif c.pattern is None and not given:
        raise UsageError("a pattern is needed")
    return c


def git_root(path: str) -> str | None:
    at = os.path.realpath(path if os.path.isdir(path) else os.path.dirname(path) or ".")
    while True:
        if os.path.exists(os.path.join(at, ".git")):
            return at
        up = os.path.dirname(at)
        if up == at:
            return None
        at = up


def infer_root(paths: list[str]) -> tuple[str, list[str]]:
    """(root, paths relative to it): the one repository of all paths, or their common folder if none is in one."""
    full = [os.path.realpath(p) for p in paths] or [os.path.realpath(".")]
    roots = {git_root(p) for p in full}
    if len(roots) > 1:
        raise UsageError("the paths lie in different repositories")
    root = roots.pop()
    if root is None:
        root = os.path.commonpath([p if os.path.isdir(p) else os.path.dirname(p) for p in full])
    rel = [os.path.relpath(p, root) for p in full]
    return root, [r for r in rel if r != "."]


def main(argv: list[str] | None = None) -> int:
    """Run; 0 also where nothing matches or the reader goes away, 2 on wrong arguments."""
    try:
        c = parse_args(sys.argv[1:] if argv is None else argv)
        root, paths = infer_root(c.paths)
    except ValueError as e:
        print(f"{e}\nusage: {USAGE}", file=sys.stderr)
        return 2
    from .functions.render import Colors
    from .plans.index import describe, ensure_index
    from .plans.search import search_json, search_text
    from .session import local_session
    from .sources import git
    from .sources.scan import scan_files
    from .sources.snapshot import location

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    files, _ = scan_files(spark, root)
    head = git.head_hash(root) if git_root(root) else ""
    warehouse = os.environ.get("ARBORIX_WAREHOUSE", os.path.expanduser("~/.cache/arborix"))
    built = ensure_index(spark, files, "file://" + location(warehouse, root, c.include_tests), root, head, c.include_tests)
    if c.build_index:
        print(describe(built))
        return 0
    both = None if c.include_tests else ensure_index(spark, files, "file://" + location(warehouse, root, True), root, head, True).tables
    how = {"flags": c.flags, "paths": paths, "depth": c.depth, "test_index": both}
    try:
        if c.json:
            for r in search_json(files, built.tables, c.pattern, c.show_tests, c.max_context, **how).toLocalIterator():
                print(r["json"])
        else:
            colors = Colors(c.color in ("always", "ansi") or (c.color == "auto" and sys.stdout.isatty()))
            for block in search_text(files, built.tables, c.pattern, show_tests=c.show_tests, limit=c.max_context, compact=c.compact, colors=colors, **how):
                print(block, end="\n\n")
    except BrokenPipeError:
        pass
    return 0
