"""Path, language and name rules as column expressions (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The seven language keys in their fixed order, with the names shown to users.
LANGUAGES = [
    (0, "rust", "Rust"),
    (1, "python", "Python"),
    (2, "javascript", "JavaScript"),
    (3, "jsx", "JSX"),
    (4, "svelte", "Svelte"),
    (5, "typescript", "TypeScript"),
    (6, "tsx", "TSX"),
]
# File extension (case-sensitive) to language key.
EXTENSIONS = {"rs": "rust", "py": "python", "js": "javascript", "jsx": "jsx", "svelte": "svelte", "ts": "typescript", "tsx": "tsx"}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_path(path: Column | str) -> Column:
    """The path without one leading ``./``."""
    return F.regexp_replace(_c(path), r"^\./", "")


def file_name(path: Column | str) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def extension(path: Column | str) -> Column:
    """The text after the last dot of the file name; empty without one or where the dot is the first character."""
    return F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1)


def stem(path: Column | str) -> Column:
    """The file name up to its last dot; the whole name where the only dot is the first character."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def language_for_path(path: Column | str) -> Column:
    """The language key of a path's extension, null for any other extension."""
    e = extension(path)
    out = F.lit(None).cast("string")
    for ext, key in EXTENSIONS.items():
        out = F.when(e == ext, F.lit(key)).otherwise(out)
    return out


def language_ordinal(language: Column | str) -> Column:
    out = F.lit(len(LANGUAGES))
    for n, key, _ in LANGUAGES:
        out = F.when(_c(language) == key, F.lit(n)).otherwise(out)
    return out


def is_test_path(path: Column | str) -> Column:
    """Whether a relative path lies in a test folder or its stem marks a test."""
    p = F.concat(F.lit("/"), _c(path))
    # Test folders, stem endings and stem beginning.
    folder = p.contains("/tests/") | p.contains("/test/") | p.contains("/__tests__/")
    s = stem(path)
    marked = s.endswith("_test") | s.endswith(".test") | s.endswith(".spec") | s.endswith("_spec") | s.startswith("test_")
    return F.coalesce(folder | marked, F.lit(False))


def is_relevant(path: Column | str, language: str, include_tests: bool) -> Column:
    keep = F.coalesce(language_for_path(path) == language, F.lit(False))
    return keep if include_tests else keep & ~is_test_path(path)


def module_name(path: Column | str, language: Column | str) -> Column:
    """The module a file stands for: its stem, or its folder's name for the files that stand for their folder."""
    s, lang = stem(path), _c(language)
    parts = F.split(_c(path), "/")
    parent = F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise(F.lit(""))
    # Stems that stand for their folder, by language.
    folder = (
        ((lang == "rust") & s.isin("mod", "lib", "main"))
        | ((lang == "python") & (s == "__init__"))
        | (lang.isin("javascript", "jsx", "typescript", "tsx") & (s == "index"))
    )
    return F.when(folder, parent).otherwise(s)


def qualified_name(module: Column | str, scopes: Column, name: Column | str) -> Column:
    """Module (if any), scopes and name joined by ``::``."""
    parts = F.concat(F.array(_c(module)), F.coalesce(scopes, F.array().cast("array<string>")), F.array(_c(name)))
    return F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), "::")
