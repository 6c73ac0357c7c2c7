"""Heads and change sets of git repositories."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession

CHANGES = "path string, origin string"


def _git(repo: str, *args: str) -> bytes:
    p = subprocess.run(["git", "-C", repo, *args], capture_output=True)
    if p.returncode:
        raise RuntimeError(f"git {' '.join(args)}: {p.stderr.decode(errors='replace').strip()}")
    return p.stdout


def head_hash(repo: str) -> str:
    """The commit at HEAD; an error in a repository without a commit."""
    return _git(repo, "rev-parse", "HEAD").decode().strip()


def common_dir(repo: str) -> str:
    return _git(repo, "rev-parse", "--git-common-dir").decode().strip()


def parse_name_status(raw: bytes) -> list[str]:
    """Paths of NUL-delimited name-status output: both paths of a rename or copy, one of anything else; a cut-off end is ignored."""
    fields = raw.split(b"\0")
    if fields and not fields[-1]:
        fields.pop()
    out, i = [], 0
    while i < len(fields):
        n = 2 if fields[i][:1] in (b"R", b"C") else 1
        if i + n >= len(fields):
            break
        out += [p.decode("utf-8", "replace") for p in fields[i + 1 : i + 1 + n]]
        i += n + 1
    return out


def change_snapshot(spark: SparkSession, repo: str, previous: str | None = None) -> DataFrame:
    """path, origin: what changed by commits since ``previous``, in the work tree, and as untracked files. A path may have several origins."""
    head = head_hash(repo)
    rows = []
    if previous and previous != head:
        rows += [(p, "committed") for p in parse_name_status(_git(repo, "diff", "--name-status", "-z", f"{previous}..{head}"))]
    rows += [(p, "dirty") for p in parse_name_status(_git(repo, "diff", "--name-status", "-z", "HEAD"))]
    rows += [(p.decode("utf-8", "replace"), "untracked") for p in _git(repo, "ls-files", "-oz", "--exclude-standard").split(b"\0") if p]
    return spark.createDataFrame(rows, CHANGES).distinct()
