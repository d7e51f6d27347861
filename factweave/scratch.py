"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: The scratch tables of each scratch() that is open, the innermost last.
_OPEN: ContextVar[tuple[list[tuple[SparkSession, str]], ...]] = ContextVar("scratch", default=())
#: A setting of Spark: an action's shuffle files go when it ends, not when the driver happens to collect its garbage.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Cores may be few when a program starts, so a share of the shuffle partitions counts too.
FILES_A_CORE = 4


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Only a local session may leave it unset: elsewhere a local folder would keep each executor's files to itself."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.gettempdir()}/factweave-scratch"
    return root.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session may be gone at exit; a leftover scratch table is harmless
        return


@contextmanager
def scratch() -> Iterator[None]:
    """Scratch tables made inside are removed at the end, for programs that run on: nothing lazy that reads them may leave it."""
    made: list[tuple[SparkSession, str]] = []
    token = _OPEN.set((*_OPEN.get(), made))
    try:
        yield
    finally:
        _OPEN.reset(token)
        for spark, path in made:
            _remove(spark, path)


@contextmanager
def _releasing(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(RELEASE, None)
    spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.unset(RELEASE) if before is None else spark.conf.set(RELEASE, before)


def materialize(df: DataFrame, name: str, outlive: bool = False) -> DataFrame:
    """Write a table into the shared scratch folder and read it back: lineage is cut, a lost executor costs nothing done so far, and the shuffles that led to it are gone.

    It lasts as long as the scratch() around it (outlive: the one around that), or else as the program.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/factweave/{name}-{uuid.uuid4().hex}"
    with _releasing(spark):
        df.write.parquet(path)
    scopes = _OPEN.get()[:-1] if outlive else _OPEN.get()
    if scopes:
        scopes[-1].append((spark, path))
    else:
        atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def drop(table: DataFrame) -> None:
    """Remove a scratch table before its time, when nothing lazy reads it any more."""
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        _remove(table.sparkSession, path)


def compact(df: DataFrame, name: str) -> DataFrame:
    """materialize() in at most a few files for each core: where Hadoop's native library is missing, a local file system starts a process for each file and folder that is made."""
    spark = df.sparkSession
    most = max(FILES_A_CORE * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // FILES_A_CORE)
    return materialize(df.coalesce(most), name)
