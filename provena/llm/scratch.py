"""Intermediate tables in the folder that the driver and all executors share.

The folder is the session's ``spark.checkpoint.dir``. Only where it is unset, and only for a
local master, a temporary folder takes its place. A written table cuts the lineage: a lost
executor costs the tasks that read it, not the whole history of the job.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; a temporary one for a local master that has none."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="provena-"))
    return "file://" + _local[0]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark)}/provena-{uuid.uuid4().hex}/{name}"
    _written.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a materialized table that no later result reads."""
    path = getattr(df, "_scratch_path", None)
    if path:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through Spark's file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    if path in _written:
        _written.remove(path)


def clear(spark: SparkSession) -> None:
    """Delete everything that this process left in the shared folder. Results read from it end here."""
    for path in list(_written):
        remove(spark, path)
