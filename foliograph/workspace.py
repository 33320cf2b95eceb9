"""Places that every executor and the driver can see, and tables written there.

Long lineages are cut by writing a table, never by keeping blocks on one
executor: a lost executor then costs only the tasks that were running on it.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; where that is unset (tests, a laptop) one of our own."""
    named = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_SETTING} to a folder that driver and executors share")
    own = "file://" + os.path.join(tempfile.gettempdir(), f"foliograph-{spark.sparkContext.applicationId}")
    spark.sparkContext.setCheckpointDir(own)
    spark.conf.set(_SETTING, own)
    return own


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/foliograph-{spark.sparkContext.applicationId}"


def drop_written(spark: SparkSession) -> None:
    """Deletes this application's written tables; to be called when no result that reads them is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back, so that what follows reads files instead of repeating the work.
    Columns ``by``, of few values, get a folder each: who filters by them reads no other rows."""
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bounded_batches(df: DataFrame, size: str = "32m") -> DataFrame:
    """``df``, in a session whose Arrow batches are bounded in bytes as well as rows, so that very long texts don't fill a worker."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(setting, None) is None:
        df.sparkSession.conf.set(setting, size)
    _find_package(df.sparkSession)
    return df


def _find_package(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, whatever folder the driver was started in."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
