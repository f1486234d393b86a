"""Pattern text: ``i1 i2 ... (support)``, the empty set first as ``(N)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = r"^(.*?)\s*\((\d+)\)$"


def write_patterns(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``lines`` (level, line) as MiningResult.lines() gives them: by level, then by ``ranks`` if there, else by item numbers."""
    items = F.filter(F.split(F.regexp_extract("line", LINE, 1), r"\s+"), lambda x: x != "").cast("array<int>")
    within = F.col("ranks") if "ranks" in lines.columns else items
    lines.orderBy("level", within).select(F.col("line").alias("value")).write.mode(mode).text(path)


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """(items, support) without the empty set; lines of another form are skipped."""
    raw = spark.read.text(path).filter(F.col("value").rlike(LINE))
    body, support = F.regexp_extract("value", LINE, 1), F.regexp_extract("value", LINE, 2).cast("long")
    parsed = raw.select(F.array_sort(F.filter(F.split(body, r"\s+"), lambda x: x != "").cast("array<int>")).alias("items"), support.alias("support"))
    return parsed.filter(F.size("items") > 0)


def read_transaction_count(spark: SparkSession, path: str) -> int | None:
    row = spark.read.text(path).filter(F.col("value").rlike(r"^\s*\(\d+\)$")).select(F.regexp_extract("value", LINE, 2).cast("long")).first()
    return row[0] if row else None
