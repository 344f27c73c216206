"""Session helpers: worker import path, shared scratch folder, written tables."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE_ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(cpus: int = 8, shuffle_partitions: int | None = None) -> SparkSession:
    """A session for tests and benches; on a cluster bring your own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("gridloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


#: Bytes of a record batch to a Python worker: rows may hold very long texts.
BATCH_BYTES = "8m"


#: Allocator settings of Python workers.
WORKER_MEMORY = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "1", "MALLOC_TRIM_THRESHOLD_": "16777216", "MALLOC_MMAP_THRESHOLD_": "8388608"}


def let_workers_import(spark: SparkSession) -> None:
    """Prepare a session for operators that run Python on the executors.

    The folder of this package is put on the workers' path; that matters only
    where the package is not installed, as an installed one is found before.
    Where the session leaves the bytes of a record batch at Spark's default of
    64 MB, BATCH_BYTES is set, since a worker and its executor hold several.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in ("64m", "67108864", "67108864b"):
        spark.conf.set(key, BATCH_BYTES)
    env = spark.sparkContext.environment
    # a worker lives through many tasks: what one used goes back to the system
    for name, value in WORKER_MEMORY.items():
        env.setdefault(name, value)
    have = [x for x in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if x]
    if PACKAGE_ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join([*have, PACKAGE_ROOT])


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    and the session runs on one machine, as in tests, a temporary folder is made
    and used; elsewhere executors would not see each other's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="gridloom-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Tables that were written and not dropped yet, the oldest first, with the thread that wrote them.
_WRITTEN: dict[str, int] = {}


def written(df: DataFrame, name: str, compression: str = "zstd") -> tuple[DataFrame, str]:
    """Write df as Parquet in the shared folder and read it back.

    Cuts the lineage: what was computed survives the loss of executors. The
    path is returned so that a caller who is done with the table can drop it;
    drop_written drops what lazy results still needed when it was made.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridloom/{name}-{uuid.uuid4().hex}"
    _WRITTEN[path] = threading.get_ident()
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        _WRITTEN.pop(path, None)


def tables_written() -> list[str]:
    """The tables that this thread wrote and didn't drop, the oldest first; other threads may still read theirs."""
    return [path for path, thread in _WRITTEN.items() if thread == threading.get_ident()]


def drop_written(spark: SparkSession, keep: Iterable[str] = ()) -> None:
    """Delete all tables that this thread wrote, but for some: for when the results that read them are stored."""
    keep = set(keep)
    drop(spark, *(p for p in tables_written() if p not in keep))
