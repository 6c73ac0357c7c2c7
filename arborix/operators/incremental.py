"""Processing only what is new, changed or gone since the last successful run.

State is one Parquet folder per version. A run writes the rows of its version and whatever its processing gave first; then one small file that
names it the successor of the version it started from is put in place by an atomic rename that fails where that version has a successor already.
That one step puts state and output in force together. A run that dies before it leaves the old version in force, its output is never seen, and
the next run gets the same work again; a run that dies after it is complete. Of two runs that start from one version, one is refused. So the
outputs in force hold every change once: none is skipped and none repeated.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import language_ordinal, normalize_path
from ..session import Stages, _fs, fs_text, remove, small_table

STATE = "repo string, path string, hash string"


class Conflict(RuntimeError):
    """Another run has put a successor of the same version in force."""


class StateStore:
    """Versioned (repo, path, hash) state below ``root``: ``v-*`` the states, ``out-*`` the outputs, ``next/V`` the name of V's successor.

    ``CURRENT`` spares the walk from the first version; where it is behind, the successors are followed.
    """

    FIRST = "none"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.pointer = f"{self.root}/CURRENT"

    def _read(self, path: str) -> str | None:
        text = fs_text(self.spark, path)
        return None if text is None else text.strip()

    def _write(self, path: str, text: str, overwrite: bool) -> bool:
        """Put a small file in place whole, by a rename; False if it must not be overwritten and is there."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        fs, p = _fs(self.spark, path)
        tmp = jvm.org.apache.hadoop.fs.Path(f"{self.root}/.{uuid.uuid4().hex}")
        out = fs.create(tmp, True)
        out.write(bytearray(text.encode()))
        out.close()
        fs.mkdirs(p.getParent())
        rename = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), conf)
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE if overwrite else jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            rename.rename(tmp, p, options)
        except Exception:
            fs.delete(tmp, False)
            if not overwrite and fs.exists(p):
                return False
            raise
        return True

    def current_version(self) -> str | None:
        v = self._read(self.pointer)
        while after := self._read(f"{self.root}/next/{v or self.FIRST}"):
            v = after
        return v

    def load(self) -> DataFrame:
        """The state in force; an empty one before the first commit."""
        return self.load_version(self.current_version())

    def load_version(self, v: str | None) -> DataFrame:
        return small_table(self.spark, [], STATE) if v is None else self.spark.read.schema(STATE).parquet(f"{self.root}/{v}")

    def prepare(self, state: DataFrame, output: DataFrame | None = None) -> str:
        """Write a version, and the output that belongs to it, without putting them in force."""
        v = f"v-{uuid.uuid4().hex}"
        if output is not None:
            output.write.parquet(f"{self.root}/out-{v}")
        state.select("repo", "path", "hash").write.parquet(f"{self.root}/{v}")
        return v

    def swap(self, version: str) -> None:
        """Put a written version in force whatever is in force now."""
        self._write(self.pointer, version, True)

    def succeed(self, before: str | None, version: str) -> None:
        """Put a written version in force as the successor of ``before``; ``Conflict`` if that has one."""
        if not self._write(f"{self.root}/next/{before or self.FIRST}", version, False):
            raise Conflict(f"another run has succeeded {before or 'the start'}")
        # in force from here on; the rest only saves time and space, and the next commit makes up for it
        self.swap(version)
        old = self.follow(before, version)
        if old:  # readers of the version just replaced still find it
            remove(self.spark, f"{self.root}/{old}")

    def follow(self, before: str | None, version: str) -> str | None:
        """Note which version ``version`` replaced; the one that was replaced before that, if there is one."""
        old = self._read(f"{self.root}/before/{before}") if before else None
        self._write(f"{self.root}/before/{version}", before or self.FIRST, True)
        return None if old in (None, self.FIRST) else old

    def commit(self, state: DataFrame, output: DataFrame | None = None, before: str | None | bool = False) -> str:
        """Write a version and put it in force as the successor of ``before`` (unless told, of the one in force now)."""
        base = self.current_version() if before is False else before
        v = self.prepare(state, output)
        self.succeed(base, v)
        return v

    def outputs(self) -> list[str]:
        """The folders of the outputs in force, in the order of their runs; runs without output have none."""
        out, v = [], self._read(f"{self.root}/next/{self.FIRST}")
        while v:
            fs, p = _fs(self.spark, f"{self.root}/out-{v}")
            if fs.exists(p):
                out.append(f"{self.root}/out-{v}")
            v = self._read(f"{self.root}/next/{v}")
        return out

    def vacuum(self, hours: float = 168) -> int:
        """Delete what runs that died left: versions and outputs never put in force and older than ``hours``. Returns their number."""
        fs, p = _fs(self.spark, self.root)
        if not fs.exists(p):
            return 0
        known, v = set(), self._read(f"{self.root}/next/{self.FIRST}")
        while v:
            known |= {v, f"out-{v}"}
            v = self._read(f"{self.root}/next/{v}")
        known |= {self._read(self.pointer)}
        n = 0
        for f in fs.listStatus(p):
            name = f.getPath().getName()
            if name not in known and (name.startswith(("v-", "out-v-", ".")) or name.startswith("CURRENT.")) and time.time() - f.getModificationTime() / 1000 > hours * 3600:
                n += bool(fs.delete(f.getPath(), True))
        return n


def stored_state(runs: DataFrame, stored: DataFrame) -> DataFrame:
    """What the successful runs left for every (repo, path): repo, path, hash (null where the path was dropped).

    Only runs with a row of status ``ok`` count; a run finishes at the latest ``finished_at`` of its ok rows. Per (repo, path) the row of the
    run that finished last holds, then of the largest run_id, then the one written last, then the largest hash. Rows of unknown runs, and rows
    without a path, are ignored; a leading ``./`` of the path and the case of hashes are ignored too.
    """
    ok = runs.filter((F.col("status") == "ok") & F.col("run_id").isNotNull()).groupBy("run_id").agg(F.max("finished_at").alias("_fin"))
    rows = stored.filter(F.col("path").isNotNull()).select("run_id", "repo", normalize_path("path").alias("path"), F.lower("source_hash").alias("hash"), F.col("written_at").alias("_w"))
    # runs are few beside the rows they wrote; Spark broadcasts them only below its own size threshold
    return rows.join(ok, "run_id").groupBy("repo", "path").agg(F.max(F.struct("_fin", "run_id", "_w", "hash")).alias("h")).select("repo", "path", F.col("h.hash").alias("hash"))


def current_state(files: DataFrame) -> DataFrame:
    """repo, path and content hash of the current files; the hash is computed where it is missing. Rows without a path are ignored,
    a null content counts as empty, and of several rows of a path the one with the largest hash holds."""
    h = F.lower(F.coalesce(F.col("content_sha256"), F.sha2(F.coalesce(F.col("content"), F.lit("")), 256)))
    return files.filter(F.col("path").isNotNull()).select("repo", normalize_path("path").alias("path"), h.alias("hash")).groupBy("repo", "path").agg(F.max("hash").alias("hash"))


def changes(now: DataFrame, state: DataFrame) -> DataFrame:
    """repo, path, change: ``added`` (no stored hash), ``changed`` (another hash) or ``removed`` (stored, no longer there).

    Both sides are keyed alike, so they meet by one union and grouping; a null repo is a key like any other.
    """
    both = now.select("repo", "path", F.col("hash").alias("n"), F.lit(None).cast("string").alias("s"), F.lit(1).alias("here")).unionByName(
        state.select("repo", "path", F.lit(None).cast("string").alias("n"), F.lower("hash").alias("s"), F.lit(0).alias("here"))
    )
    g = both.groupBy("repo", "path").agg(F.max("n").alias("n"), F.max("s").alias("s"), F.max("here").alias("here"))
    change = F.when((F.col("here") == 1) & F.col("s").isNull(), "added").when((F.col("here") == 1) & (F.col("n") != F.col("s")), "changed").when((F.col("here") == 0) & F.col("s").isNotNull(), "removed")
    return g.select("repo", "path", change.alias("change")).filter("change is not null")


def plan_run(store: StateStore, files: DataFrame, stages: Stages) -> tuple[str | None, DataFrame, DataFrame]:
    """(version started from, state to be, changes): both tables are written, so every later step sees the same files whatever happens to them."""
    before = store.current_version()
    now = stages.put(current_state(files))
    return before, now, stages.put(changes(now, store.load_version(before)))


def run_incremental(store: StateStore, files: DataFrame, process) -> DataFrame:
    """One run: ``process(changes)`` is called with repo, path and change, and only if it returns is the new state put in force.

    A DataFrame that ``process`` returns is written beside the new state and comes in force with it (``StateStore.outputs``), so it is there
    once however often a run dies. What ``process`` does elsewhere must bear a repetition: a run that dies before the swap is done again. The
    state has the hashes that the changes were told by; a file that changes while ``process`` runs is a change for the next run.
    """
    stages = Stages(files.sparkSession, "run")
    before, now, todo = plan_run(store, files, stages)
    output = process(todo)
    store.commit(now, output if isinstance(output, DataFrame) else None, before)
    return todo


def fingerprints(state: DataFrame, keys: list[str]) -> DataFrame:
    """keys, fingerprint, n_files: SHA-256 over path, NUL, hash, NUL of the files of each key in path order (by bytes); null hashes count as empty.

    A digest runs over its bytes in order, so the rows of a key pass through one task; they are sorted by a spilling sort and hashed as they
    pass, and none is held in memory. Rows are a path and a hash each, never contents. No files give no row.
    """
    kinds = dict(state.dtypes)
    rows = state.select(*keys, F.coalesce("path", F.lit("")).alias("path"), F.coalesce("hash", F.lit("")).alias("hash")).repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, "path", "hash")

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, h, n = None, None, 0
        done = lambda: pd.DataFrame([[*last, h.hexdigest(), n]], columns=[*keys, "fingerprint", "n_files"], dtype=object)
        for f in frames:
            for key, part in f.groupby(keys, sort=False, dropna=False):
                key = tuple(None if pd.isna(k) else k for k in key)
                if key != last:
                    if h is not None:
                        yield done()
                    last, h, n = key, hashlib.sha256(), 0
                h.update("".join(x + "\0" + y + "\0" for x, y in zip(part["path"], part["hash"])).encode())
                n += len(part)
        if h is not None:
            yield done()

    return rows.mapInPandas(digest, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", fingerprint string, n_files long")


def combined_fingerprints(prints: DataFrame, keys: list[str], language: str = "language") -> DataFrame:
    """keys, fingerprint: SHA-256 over language, NUL, fingerprint, NUL of the languages of each key in their fixed order."""
    each = F.array_sort(F.collect_list(F.struct(language_ordinal(language).alias("o"), F.concat(language, F.lit("\0"), "fingerprint", F.lit("\0")).alias("t"))))  # one per language
    return prints.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(each, lambda x: x["t"]), ""), 256).alias("fingerprint"))
