"""Session helpers shared by every operator; join strategies are left to adaptive execution."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Rows in memory against their size in a file: repeated values shrink a column by such factors and more.
FILE_FACTOR = 64
_FACTOR_NAME = "spark.sql.sources.fileCompressionFactor"
_LOCAL: list[tempfile.TemporaryDirectory] = []
_SCRATCH: list[list[str]] = []


def local_session(cores: str = "8", partitions: int = 8, app: str = "boxledger") -> SparkSession:
    """Session for tests and the bench; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def real_sizes(spark: SparkSession) -> None:
    """Let Spark weigh files by what their rows take in memory, unless the session names a factor of its own.

    A table of a few compressed MB may be a GB of rows, which Spark would gather on the driver to broadcast them. Joins of
    tables that are not tiny start as shuffles, and adaptive execution broadcasts a side by its real size.
    """
    if spark.conf.get(_FACTOR_NAME, None) in (None, "1.0"):
        spark.conf.set(_FACTOR_NAME, str(float(FILE_FACTOR)))


def shared_dir(spark: SparkSession) -> str:
    """Folder for written intermediate tables: ``spark.checkpoint.dir`` of the session.

    On a cluster the setting is required, as driver and executors must share the folder. In local mode, where it names
    none, a folder that ends with the process is set.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        _LOCAL.append(tempfile.TemporaryDirectory(prefix="boxledger-", ignore_cleanup_errors=True))
        named = _LOCAL[-1].name
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage by writing the table to the shared folder and reading it back.

    The plan runs once, the result survives the loss of executors, and the scan that replaces it
    knows its real size, from which Spark chooses join strategies.
    """
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def new_path(spark: SparkSession) -> str:
    """A new place in the shared folder, which the innermost open ``scratch`` deletes at its end."""
    path = f"{shared_dir(spark)}/boxledger-{uuid.uuid4().hex}"
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder; a path that is not there is no error."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are cut inside are deleted at the end, so frames that read them must be written by then."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            remove(spark, path)


def settled(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` returns, written; the tables it has cut on the way are deleted."""
    path = new_path(spark)
    with scratch(spark):
        df = build()
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """SQL settings (dots written as two underscores) that hold for the actions inside."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
