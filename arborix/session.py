"""Session defaults, table reading and lineage cutting.

Intermediate results of iterative operators are written as Parquet below the
shared folder named by ``spark.checkpoint.dir``, so that a lost executor costs
a re-read and not a re-computation. A folder is chosen here only where the
session names none (tests on one machine).
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Settings for a session of our own; a session that exists is left as it is.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str = "*", partitions: int = 8, **extra: str) -> SparkSession:
    """A local session with the defaults above, for tests and the bench."""
    b = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", str(partitions))
    for k, v in (DEFAULTS | extra).items():
        b = b.config(k, v)
    return b.config("spark.ui.enabled", "false").getOrCreate()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables; set only where a local session has none, an error on a cluster without one."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if told:
        return told.rstrip("/")
    current = sc.getCheckpointDir()
    if not current:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="arborix-"))
        current = sc.getCheckpointDir()
    return current.rstrip("/")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def fs_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file; None if there is none."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system; a missing one is no error."""
    try:
        fs, p = _fs(spark, path)
        fs.delete(p, True)
    except Exception:  # the session may be gone at interpreter exit
        pass


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a few rows as a local relation of the plan: no Python worker has to start for it."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))
    cols = zip(*rows) if rows else [()] * len(kinds)
    return spark.createDataFrame(pa.table([pa.array(list(c), f.type) for c, f in zip(cols, kinds)], schema=kinds), schema)


class Stages:
    """Written intermediate tables of one operator run.

    ``put`` materialises a DataFrame and returns it re-read from storage;
    ``drop`` frees tables that no later step reads. What is left is deleted
    when the interpreter exits.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/arborix/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(remove, spark, self.root)
        self.n = 0

    def put(self, df: DataFrame, split: str | None = None) -> DataFrame:
        """Write ``df`` and read it again; ``split`` names a column to partition the files by."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        w = df.write.option("compression", "zstd")
        (w.partitionBy(split) if split else w).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        if split:
            out = out.select(*df.columns)
        out._arborix_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if path := getattr(t, "_arborix_path", None):
                remove(self.spark, path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` over at least as many tasks as there are cores, for work that is heavy beside its input.

    A table read in fewer parts than that is small (its parts are bounded) and is shuffled once by the hash of ``key``; any other stays as it is.
    """
    width = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= width else df.repartition(width, key)


def written(df: DataFrame) -> bool:
    """Whether the table is one that ``Stages.put`` gave back."""
    return hasattr(df, "_arborix_path")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
