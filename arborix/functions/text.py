"""Text rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mark a report as a bug or a feature.
BUG_WORDS = ("bug", "regression", "crash", "error", "incorrect", "broken", "fails", "failure", "fix")
FEATURE_WORDS = ("feature", "enhancement", "proposal", "rfc", "support", "add ", "allow", "option", "request")


def stable_token(*parts: Column, length: int = 12) -> Column:
    """The first hex digits of the SHA-256 of the parts joined by ``::``."""
    return F.substring(F.sha2(F.concat_ws("::", *parts), 256), 1, length)


def branch_name(token: Column, variant: Column) -> Column:
    return F.concat(F.lit("benchmark/"), token, F.lit("/"), variant)


def slugify(text: Column, limit: int = 48) -> Column:
    """Lower case, runs of other characters as one hyphen, none at the ends, at most ``limit`` characters; ``task`` where the cut leaves nothing."""
    s = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    cut = F.regexp_replace(F.substring(s, 1, limit), "-+$", "")
    return F.when(F.length(s) <= limit, s).otherwise(F.when(cut == "", "task").otherwise(cut))


def task_id(repo: Column, title: Column, issue: Column) -> Column:
    """The id that a task of this repository (``owner/name``) and title asks for: name and title as slugs, the issue where the title has none."""
    slug = slugify(title, 56)
    return F.concat_ws("-", slugify(F.split(repo, "/", 2)[1], 24), F.when(slug == "", F.concat(F.lit("issue-"), issue.cast("string"))).otherwise(slug))


def truncate_text(text: Column, limit: int = 600) -> Column:
    """White space collapsed; longer texts cut to ``limit`` characters with ``...`` at the end."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(t) > limit, F.concat(F.rtrim(F.substring(t, 1, limit - 3)), F.lit("..."))).otherwise(t)


def kind_hint(*parts: Column) -> Column:
    """``bug`` where the parts (title, body, labels) joined by blanks have a bug word, else ``feature`` where they have a feature word, else ``unknown``."""
    low = F.lower(F.concat_ws(" ", *parts))
    has = lambda words: low.rlike("|".join(words))
    return F.when(has(BUG_WORDS), "bug").when(has(FEATURE_WORDS), "feature").otherwise("unknown")


def prompt_title(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, "`", ""), r"\s+", " "))


def repo_name(text: Column) -> Column:
    """``owner/name`` where the text is that (what follows the first slash is the name), else null."""
    return F.when(F.trim(text).rlike(r"(?s)^[^/]+/.+$"), F.trim(text))


def variant_status(published: Column, branch_url: Column, has_diff: Column) -> Column:
    """``published`` for a variant of a published run whose branch has an address, else ``snapshotted`` where it left a diff or a file list, else ``-``."""
    return F.when(published & (F.coalesce(branch_url, F.lit("")) != ""), "published").when(has_diff, "snapshotted").otherwise("-")


def run_status(published: Column, judged: Column, snapshotted: Column) -> Column:
    return F.when(published, "published").when(judged, "judged").when(snapshotted, "snapshotted").otherwise("created")


def numstat(line: Column) -> Column:
    """added, deleted, path of a tab-separated line; ``-`` (a binary file) counts as -1."""
    p = F.split(line, "\t", 3)
    n = lambda i: F.when(p[i] == "-", F.lit(-1)).otherwise(p[i].cast("long")).cast("long")
    return F.struct(n(0).alias("added"), n(1).alias("deleted"), p[2].alias("path"))


def name_status(line: Column) -> Column:
    """status, path, previous_path of a tab-separated line; the status keeps its score (R100), renames and copies keep where they came from."""
    p = F.split(line, "\t")
    return F.struct(p[0].alias("status"), F.element_at(p, -1).alias("path"), F.when(p[0].rlike("^[RC]"), p[1]).alias("previous_path"))


def run_id(at: Column) -> Column:
    """The id of a run started at a time: ``20260102T030405Z`` (the session's time zone must be UTC)."""
    return F.date_format(at, "yyyyMMdd'T'HHmmss'Z'")


def cli_date(text: Column) -> Column:
    """A date given as YYYY-MM-DD; null for anything else."""
    return F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(text, "yyyy-M-d"))


#: Days before today up to which pull requests are looked for.
CUTOFF_DAYS = 183


def discovery_cutoff(today: Column) -> Column:
    return F.date_sub(today, CUTOFF_DAYS)


def variant_name(variant: Column) -> Column:
    """How a variant is shown: one that was reviewed as ``name + review``."""
    return F.regexp_replace(variant, "^(.*)_review$", "$1 + review")


def markdown_link(label: Column, url: Column) -> Column:
    return F.when(F.coalesce(url, F.lit("")) == "", "n/a").otherwise(F.concat(F.lit("["), label, F.lit("]("), url, F.lit(")")))
