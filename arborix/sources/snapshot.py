"""Index snapshots: versioned Parquet tables with a metadata row that is put in force by an atomic rename."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.incremental import StateStore, combined_fingerprints, fingerprints
from ..session import remove

SCHEMA_VERSION = 1


@dataclass
class IndexMeta:
    """What an index was built from; one differing field makes it another index."""

    version: int
    repo: str
    include_tests: bool
    head: str
    fingerprint: str
    files: int


def location(warehouse: str, repo: str, include_tests: bool) -> str:
    """The folder of a repository's index: its name and the first 16 hex digits of its path's hash, with and without tests apart."""
    full = os.path.realpath(repo)
    digest = hashlib.sha256(full.encode()).hexdigest()[:16]
    return f"{warehouse.rstrip('/')}/{os.path.basename(full)}-{digest}/v{SCHEMA_VERSION}/{'with-tests' if include_tests else 'prod'}"


class IndexStore:
    """Tables of an index below a folder: functions, nodes, edges, references and state, all of one version."""

    TABLES = ("functions", "nodes", "edges", "references", "state")

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.pointer = StateStore(spark, self.root)

    def meta(self) -> IndexMeta | None:
        """The metadata in force; None if there is none, or it cannot be read or is of another version."""
        try:
            v = self.pointer.current_version()
            if v is None:
                return None
            raw = "".join(r[0] for r in self.spark.read.text(f"{self.root}/{v}/meta").collect())
            m = IndexMeta(**json.loads(raw))
            return m if m.version == SCHEMA_VERSION else None
        except Exception:
            return None

    def tables(self) -> dict[str, DataFrame] | None:
        """The tables in force; None where any is missing or damaged."""
        try:
            v = self.pointer.current_version()
            out = {t: self.spark.read.parquet(f"{self.root}/{v}/{t}") for t in self.TABLES}
            for t in out.values():
                t.limit(1).collect()  # a damaged file shows now
            return out
        except Exception:
            return None

    def write(self, tables: dict[str, DataFrame], meta: IndexMeta) -> None:
        try:
            old = self.pointer.current_version()
        except Exception:  # a damaged pointer is replaced
            old = None
        v = f"v-{uuid.uuid4().hex}"
        for name in self.TABLES:
            tables[name].write.parquet(f"{self.root}/{v}/{name}")
        self.write_meta(v, meta)
        self.pointer.swap(v)
        # readers of the version just replaced still find it; the one before goes
        older = self.pointer.follow(old, v)
        if older:
            remove(self.spark, f"{self.root}/{older}")

    def write_meta(self, version: str, meta: IndexMeta) -> None:
        self.spark.createDataFrame([(json.dumps(asdict(meta)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/{version}/meta")

    def refresh_head(self, meta: IndexMeta) -> None:
        """Only the metadata moves."""
        self.write_meta(self.pointer.current_version(), meta)


def fingerprint(state: DataFrame) -> str:
    """The combined fingerprint of a state (language, path, hash): that of its languages' fingerprints; of no files the digest of nothing."""
    one = combined_fingerprints(fingerprints(state, ["language"]).withColumn("_all", F.lit(0)), ["_all"])
    return next((r["fingerprint"] for r in one.collect()), hashlib.sha256().hexdigest())
