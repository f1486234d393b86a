"""Files of a folder, through Spark's own listing, so any store that Spark reads will do."""

from __future__ import annotations

from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, bytes) of the files at or below ``path``; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return found.select("path", F.col("length").alias("bytes"))


def mounted(path: str) -> str:
    """The plain path of one on a mounted file system; ValueError for any other store."""
    parts = urlsplit(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{path} is not on a mounted file system")
    return parts.path if parts.scheme else path
