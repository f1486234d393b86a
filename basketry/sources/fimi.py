"""Horizontal transactions: one basket a line, items separated by blanks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.operators.encode import numbered
from basketry.session import staged


def read_fimi(spark: SparkSession, path: str) -> DataFrame:
    """(tid, item). A tid is the line's rank in (file, position); a blank line is a basket without items and keeps its number."""
    lines = spark.read.text(path).select(F.col("value"), F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("m"))
    # offsets within a file grow with the partition, and so does the generated id
    ranked = numbered(staged(lines, "fimi"), [F.col("f"), F.col("m")], "tid")
    items = F.filter(F.split(F.col("value"), r"\s+"), lambda x: x != "")
    return ranked.select(F.col("tid").cast("long").alias("tid"), F.explode(items.cast("array<int>")).alias("item")).dropna().distinct()


def write_fimi(baskets: DataFrame, path: str, mode: str = "overwrite") -> None:
    lines = baskets.groupBy("tid").agg(F.array_sort(F.collect_set("item")).alias("items"))
    lines.orderBy("tid").select(F.array_join(F.col("items").cast("array<string>"), " ").alias("value")).write.mode(mode).text(path)
