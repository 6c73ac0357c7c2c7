"""Keeping an index up to date from a stream of changed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.incremental import StateStore, changes, current_state
from ..session import Stages

FILES = "repo string, path string, content string, content_sha256 string, modified_at timestamp"


def apply_changes(store: StateStore, batch: DataFrame, process) -> None:
    """One micro-batch: the last version of every file in it against the state; what is new or changed goes to ``process``, then the state moves.

    A batch that is delivered again finds its hashes in the state and does nothing. What ``process`` returns as a DataFrame is put in force with
    the new state by one step (see ``StateStore``), so a batch that dies in between counts as not processed. ``removed`` files are rows with a
    null content.
    """
    stages = Stages(batch.sparkSession, "stream")
    last = stages.put(batch.groupBy("repo", "path").agg(F.max(F.struct("modified_at", "content", "content_sha256")).alias("v")).select("repo", "path", "v.*"))
    now = stages.put(current_state(last.filter("content is not null")))
    before = store.current_version()
    old = store.load_version(before)
    touched = last.select("repo", "path").distinct()
    on = ["repo", "path"]
    todo = stages.put(changes(now, old.join(touched, on, "left_semi")))
    if todo.isEmpty():
        return
    output = process(todo, last)
    store.commit(old.join(touched, on, "left_anti").unionByName(now), output if isinstance(output, DataFrame) else None, before)


def follow(spark: SparkSession, folder: str, store: StateStore, checkpoint: str, process, once: bool = True):
    """Read Parquet files of changed sources as they land in ``folder``; with ``once`` all that is there, then stop."""
    stream = spark.readStream.schema(FILES).parquet(folder)
    w = stream.writeStream.foreachBatch(lambda df, _: apply_changes(store, df, process)).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
