"""Intermediate tables and files in the folder all executors share."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


class _Made(threading.local):
    """Paths of the staged tables of a thread."""

    def __init__(self) -> None:
        self.paths: set[str] = set()


_made = _Made()


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder: ``spark.checkpoint.dir``.

    Where the setting is missing, a local-mode session gets a temporary folder
    of its own; on a cluster that is an error, as a folder of one machine would
    be lost with it.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not conf.get("spark.master", "").split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="orrery-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/orrery/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    This cuts lineage and survives the loss of executors.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    _made.paths.add(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._orrery_path = path
    return out


def dropped(*dfs: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for df in dfs:
        delete(df.sparkSession, df._orrery_path)
        _made.paths.discard(df._orrery_path)


def swept(spark: SparkSession, since: set[str], *kept: DataFrame) -> None:
    """Deletes the tables staged after ``since`` (a copy of ``made()``) but those kept."""
    for path in made() - since - {df._orrery_path for df in kept}:
        delete(spark, path)
        _made.paths.discard(path)


def cleared(spark: SparkSession, paths: set[str], reader: DataFrame) -> set[str]:
    """Deletes the staged tables at ``paths`` that ``reader`` doesn't read, and says which."""
    read = {name for f in reader.inputFiles() for name in f.split("/")}
    gone = {p for p in paths if p.rpartition("/")[2] not in read}
    for p in gone:
        delete(spark, p)
        _made.paths.discard(p)
    return gone


def made() -> set[str]:
    """Paths of the staged tables that this thread has made and not deleted."""
    return set(_made.paths)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or with a number where ``df`` has such a column (in any case of letters)."""
    have = {c.lower() for c in df.columns}
    return next(n for k in range(len(have) + 1) if (n := f"{name}{k or ''}") not in have)


def written_bytes(df: DataFrame) -> int:
    """Size of the files of a staged table."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._orrery_path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def delete(spark: SparkSession, uri: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def released() -> None:
    """Gives memory that a task has freed back to the system, as its worker lives on."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
