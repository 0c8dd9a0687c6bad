"""Written intermediate tables in the folder that all machines of the cluster share.

An executor can be lost at any time; what is written here is never recomputed. The folder is the session's
``spark.checkpoint.dir``. Where that is unset a temporary folder is taken in local mode (tests, a laptop), where driver and tasks are one
process; a cluster without a shared folder is an error, not a silent loss.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, or in local mode a folder of this process where none is set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines share; it is unset on {master}")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="lexispark-"))
        path = _own[0]
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own for an intermediate table or archive, remembered for :func:`release`."""
    path = f"{shared_dir(spark)}/lexispark/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def spill(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder, or to ``path``, as Parquet and return it read again: this cuts the lineage."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.parquet(path)
    again = spark.read.schema(df.schema).parquet(path)
    again._spilled = path
    return again


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop(*tables: DataFrame) -> None:
    """Delete tables that :func:`spill` returned and that nothing reads any more."""
    for df in tables:
        path = df._spilled
        delete(df.sparkSession, path)
        if path in _written:
            _written.remove(path)


def sweep(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle files of frames that are no longer referenced: it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written() -> list[str]:
    """Paths of all tables that were written and not deleted yet."""
    return list(_written)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete intermediate tables. Frames that read them end to work."""
    for path in paths:
        if path in _written:
            delete(spark, path)
            _written.remove(path)
    sweep(spark)
