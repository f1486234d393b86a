"""Session helpers: where intermediate tables go, and reading input tables."""

from __future__ import annotations

import gc
import getpass
import os
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only a local-mode session without one gets a default of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file:///tmp/checkpoints/{getpass.getuser()}-{os.getpid()}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with an eager checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


_STAGED: list[str] = []
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it again: compact, and safe when executors are lost."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGED.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Delete a table that :func:`staged` returned, once what is made from it is staged itself."""
    path = _PATHS.pop(df)
    _STAGED.remove(path)
    _delete(df.sparkSession, path)


def release() -> None:
    """Let Spark drop the shuffle files of steps whose DataFrames are gone."""
    from pyspark import SparkContext

    gc.collect()
    if SparkContext._active_spark_context is not None:
        SparkContext._active_spark_context._jvm.System.gc()


def clear_staged(spark: SparkSession) -> int:
    """Delete the tables that :func:`staged` wrote in this process; returns their number. Call it once their results are no longer read."""
    n = 0
    while _STAGED:
        _delete(spark, _STAGED.pop())
        n += 1
    return n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
