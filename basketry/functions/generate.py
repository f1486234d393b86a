"""Generated inputs for tests and benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def random_matrix(spark: SparkSession, rows: int, cols: int, seed: int = 0) -> DataFrame:
    """(row, values): ``rows`` arrays of ``cols`` doubles in [0, 1).

    A value depends on seed, row and column alone, so the matrix is the same however it is partitioned.
    """
    if rows < 0 or cols < 0:
        raise ValueError("rows and cols must be 0 or more")
    unit = F.lit(2.0**-53)
    cells = F.transform(F.sequence(F.lit(1), F.lit(cols)), lambda c: F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("id"), c), 11) * unit)
    values = cells if cols else F.array().cast("array<double>")
    return spark.range(rows).select(F.col("id").alias("row"), values.alias("values"))
