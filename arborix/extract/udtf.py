"""Extraction as a table function over files."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import is_test_path, language_for_path, normalize_path
from ..session import spread
from .base import allow_depth
from .visitors import extract

_SITES = "call_sites array<struct<callee_name:string,conditions:array<string>>>, reference_sites array<struct<target_name:string,kind:string,context:string>>"
FUNCTIONS = f"repo string, path string, language string, fn_ord long, name string, qualified_name string, is_test boolean, line long, end_line long, {_SITES}"

_CALL = pa.struct([("callee_name", pa.string()), ("conditions", pa.list_(pa.string()))])
_REFERENCE = pa.struct([("target_name", pa.string()), ("kind", pa.string()), ("context", pa.string())])
_ARROW = pa.schema(
    [("repo", pa.string()), ("path", pa.string()), ("language", pa.string()), ("fn_ord", pa.int64()), ("name", pa.string()), ("qualified_name", pa.string()), ("is_test", pa.bool_()), ("line", pa.int64()), ("end_line", pa.int64()), ("call_sites", pa.list_(_CALL)), ("reference_sites", pa.list_(_REFERENCE))]
)


def _list_array(lists: list[list[str]]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, lists))], pa.int32()), pa.array([*chain.from_iterable(lists)], pa.string()))


class _Lists:
    """Lists of (name, second) pairs as flat columns, without an object per pair."""

    def __init__(self):
        self.ends, self.names, self.seconds = [0], [], []

    def add(self, pairs: list[tuple]) -> None:
        for name, second in pairs:
            self.names.append(name)
            self.seconds.append(second)
        self.ends.append(len(self.names))

    def structs(self, kind: pa.DataType, rest) -> pa.Array:
        """The lists as an Arrow column of structs; ``rest`` makes the fields behind the name."""
        flat = pa.StructArray.from_arrays([pa.array(self.names, pa.string()), *rest(self.seconds)], fields=[kind.field(i) for i in range(kind.num_fields)])
        return pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), flat)


def functions_of(files: DataFrame, include_tests: bool = True, strict: bool = True, references: bool = True) -> DataFrame:
    """One row per function of ``files`` (path, content, optional repo), in the schema of ``FUNCTIONS``.

    Without ``references`` the reference sites, which take time of their own, are not looked for and come out empty.
    Files of other extensions, and test files unless ``include_tests``, are left out before their content is read. Files with syntax errors
    give what the parser could keep. A null or empty content gives no row; a missing repo column counts as null.
    """
    repo = F.col("repo") if "repo" in files.columns else F.lit(None).cast("string")
    rows = files.select(repo.alias("repo"), F.col("path"), "content").withColumn("language", language_for_path("path")).withColumn("file_is_test", is_test_path(normalize_path("path"))).filter("language is not null and content is not null")
    if not include_tests:
        rows = rows.filter("not file_is_test")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allow_depth()
        # the trees have no cycles, so looking for any while they grow is in vain
        gc.disable()
        try:
            for b in batches:
                cols: list[list] = [[] for _ in range(9)]
                calls, refs = _Lists(), _Lists()
                for repo, path, content, language, is_test in zip(*(b.column(c).to_pylist() for c in ("repo", "path", "content", "language", "file_is_test"))):
                    found, _ = extract(content, path, language, bool(is_test), include_tests, strict, references)
                    for i, x in enumerate(found):
                        calls.add(x.call_sites)
                        refs.add(x.reference_sites)
                        for col, v in zip(cols, (repo, path, language, i, x.name, x.qualified_name, x.is_test, x.line, x.end_line)):
                            col.append(v)
                plain = [pa.array(c, f.type) for c, f in zip(cols, _ARROW)]
                yield pa.RecordBatch.from_arrays([*plain, calls.structs(_CALL, lambda c: [_list_array(c)]), refs.structs(_REFERENCE, lambda c: [pa.array(["argument"] * len(c), pa.string()), pa.array(c, pa.string())])], schema=_ARROW)
        finally:
            gc.enable()

    return spread(rows, "path").mapInArrow(run, FUNCTIONS)
