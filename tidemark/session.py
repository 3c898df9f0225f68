"""Session set-up and scratch tables that outlive a lost executor."""

from __future__ import annotations

import contextlib
import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

_FALLBACK: dict[str, str] = {}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tidemark")
    for key, value in CONF.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one where that is unset, and on a local master only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return _FALLBACK[app]


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once as Parquet under the scratch root and read it back.

    Lineage ends at the files, so a lost executor costs a re-read and never a re-computation.
    The files go when the session's file system closes.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/tidemark-{uuid.uuid4().hex}-{name}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    found = spark.read.schema(df.schema).parquet(path)
    found._scratch = path
    return found


def discard(df: DataFrame) -> None:
    """Delete the files of a materialised ``df`` that nothing reads any more, and shuffle files of finished queries."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(df._scratch)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    sweep(spark)


def sweep(spark: SparkSession) -> None:
    """Have the context's cleaner remove the shuffle files of plans that the driver's collector finds to be gone."""
    spark.sparkContext._jvm.java.lang.System.gc()


def broadcast_up_to(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most so many rows, and else as it is. It should be materialised."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once an application, unless their path already has it; and bound their batches."""
    bound_batches(spark)
    home = Path(__file__).resolve().parent.parent
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or str(home) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    folder = tempfile.mkdtemp(prefix="tidemark-package-")
    archive = shutil.make_archive(f"{folder}/tidemark", "zip", home, "tidemark")
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def trim() -> None:
    """Give what a worker has freed back to the system, where its allocator can; workers outlive their tasks."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: Bytes of an Arrow batch, and rows where Spark can't count bytes: ten thousand long texts would be gigabytes.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2500


def bound_batches(spark: SparkSession) -> None:
    """Batches of bounded size, unless the session has sizes of its own."""
    limits = {"spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES, "spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS}
    for key, most in limits.items():
        if spark.conf.get(key, None) is None:  # not set by the session
            spark.conf.set(key, str(most))


def arrow_map(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow`` with this package at hand in the workers, on batches of bounded size."""
    ship(df.sparkSession)

    def run(batches: Iterator) -> Iterator:
        yield from f(batches)
        trim()

    return df.mapInArrow(run, schema)


def arrow_groups(df: DataFrame, keys: list[str], f: Callable, schema: StructType | str) -> DataFrame:
    """``applyInArrow`` on the groups of ``keys`` with this package at hand in the workers."""
    ship(df.sparkSession)
    return df.groupBy(*keys).applyInArrow(f, schema)
