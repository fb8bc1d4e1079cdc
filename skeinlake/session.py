"""Session helper and table loader."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def local_session(cpus: int | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName("skeinlake")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SKEINLAKE_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, ``spark.checkpoint.dir``; local sessions get one of their own where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    set_ = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not set_.isDefined():
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="skeinlake-")
        atexit.register(shutil.rmtree, at, True)
        spark.sparkContext.setCheckpointDir("file://" + at)
        set_ = spark.sparkContext._jsc.sc().getCheckpointDir()
    return set_.get().rstrip("/")


_passing: ContextVar[list[DataFrame] | None] = ContextVar("passing", default=None)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    shared_folder(df.sparkSession)
    out = df.checkpoint()
    if (made := _passing.get()) is not None:
        made.append(out)
    return out


@contextmanager
def passing_checkpoints(spark: SparkSession) -> Iterator[None]:
    """The files of checkpoints that are made within go when it ends; what has to stay is written before. Else they stay as long as the driver keeps their frames."""
    before, made = _passing.get(), []
    _passing.set(made)
    try:
        yield
    finally:
        _passing.set(before)
        for df in made:
            at = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
            if at.isDefined():
                path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at.get())
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables. Read through Spark only, so any Hadoop path works."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
