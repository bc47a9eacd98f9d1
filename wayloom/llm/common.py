"""What the operators of this subpackage share: tables, shared work folders and bounded broadcasts."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when it has at most this many rows of a few fixed-width columns.
BROADCAST_ROWS = 2_000_000
#: Where its columns are not of fixed width, its bytes are counted too.
BROADCAST_BYTES = 64_000_000
#: Rows in an Arrow batch of texts: with the session's bound on its bytes this bounds a Python worker's memory.
BATCH_ROWS = 1000


def tuned(spark: SparkSession) -> SparkSession:
    """The session with Arrow batches small enough for long texts, if it allows larger ones."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    return spark


def lean(run: Callable) -> Callable:
    """A function over batches that gives freed memory back to the system when a task ends, as idle workers keep theirs."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # not every C library has it
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Without one a local folder serves where driver and executors are one process; else it is an error."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="wayloom-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


#: Folders of work tables, by application, that are deleted when the driver's Python ends.
_work: dict[str, str] = {}


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new place for a work table, in the application's own folder."""
    app = spark.sparkContext.applicationId
    if app not in _work:
        _work[app] = f"{shared_dir(spark)}/wayloom/{app}"
        atexit.register(_tidied, spark, _work[app])
    return f"{_work[app]}/{name}-{uuid.uuid4().hex}"


def _tidied(spark: SparkSession, folder: str) -> None:
    """Deletes an application's work tables; where its JVM is gone they stay."""
    with contextlib.suppress(Exception):
        removed(spark, folder)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, read again: lineage ends there, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path), path


def removed(spark: SparkSession, *paths: str) -> None:
    """Deletes work tables that no returned plan reads."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        where = jvm.org.apache.hadoop.fs.Path(p)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def small_side(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if its counted rows (of fixed width) are at most `most`; beyond that the join shuffles."""
    return F.broadcast(df) if rows <= most else df


def row_key(key: str, text: str) -> Column:
    """Names a row by its id and text: rows without an id are told apart, and equal ids with other texts too."""
    t = F.coalesce(F.col(text), F.lit(""))
    return F.concat(F.coalesce(F.col(key).cast("string"), F.lit("-")), F.lit(":"), F.xxhash64(t).cast("string"))
