"""Intermediate tables.

`keep` holds a table that several steps read, on executors' disks as Spark's own
cache: a lost executor's part is computed again from its inputs, and
`spark.catalog.clearCache()` frees it. `materialise` writes a table to the folder
that all executors share and so cuts lineage, for loops, between stages and in
chains of such tables: the plan of a query holds those of the kept tables that it
reads, theirs too, and the driver stores it again at each of its changes.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
import weakref

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}
#: Where written tables are, by the id of the table read back.
_PATHS: dict[int, str] = {}


def shared_root(spark: SparkSession) -> str:
    """A folder of this application under `spark.checkpoint.dir`; removed when the driver ends.

    Where no folder is named, a local master (tests) gets a temporary one, set on
    the session's context; on a cluster that is an error, as executors wouldn't
    share it.
    """
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="tessera-")
            spark.sparkContext.setCheckpointDir(base)
        _ROOTS[app] = f"{base.rstrip('/')}/tessera-{app}"
        atexit.register(_remove, spark, _ROOTS[app])
    return _ROOTS[app]


def release_memory() -> None:
    """Give what large arrays held back to the system, after work on the driver."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Free kept tables that nothing reads any more, and the shuffles that made them.

    Spark deletes a shuffle's files once the driver's JVM has collected what
    refers to it, which by itself can take as long as the job. Tables made from
    these ones must have been written, else they would be computed again.
    """
    for t in tables:
        t.unpersist()
    release_memory()
    spark._jvm.System.gc()


def _remove(spark: SparkSession, root: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone already
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def keep(df: DataFrame) -> DataFrame:
    """Compute `df` once, on disk, for several later uses."""
    df = df.persist(StorageLevel.DISK_ONLY)
    df.count()
    return df


def materialise(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """Write `df` once and read it back: later uses neither recompute it nor depend on executors that ran it.

    small: rows of few bytes, dealt out anew in partitions of Spark's advisory size, so that they don't make a file for each task.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    (df.hint("rebalance") if small else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = path
    weakref.finalize(out, _PATHS.pop, id(out), None)
    return out


def drop(table: DataFrame) -> None:
    """Delete a table that materialise() wrote, once nothing reads it any more."""
    if path := _PATHS.get(id(table)):
        _remove(table.sparkSession, path)
