"""A keyed store for bulk reads and writes: Parquet dealt into buckets by the key's hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "_bucket"


class KeyedStore:
    """Rows under ``path``, found by ``key``. Reads go to the buckets of the wanted keys only.

    ``buckets`` must stay the same over the life of a store. Keys may repeat; a null key is never found.
    """

    def __init__(self, path: str, key: str, buckets: int = 64):
        if buckets < 1:
            raise ValueError("buckets must be 1 or more")
        self.path, self.key, self.buckets = path.rstrip("/"), key, buckets

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn(BUCKET, F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int"))

    def write(self, rows: DataFrame, mode: str = "append") -> None:
        """Adds rows; with mode ``overwrite`` they take the place of all that the store holds."""
        dealt = self._bucketed(rows).repartition(BUCKET).sortWithinPartitions(BUCKET, self.key)
        dealt.write.mode(mode).partitionBy(BUCKET).parquet(self.path)

    def _all(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)

    def get(self, spark: SparkSession, key) -> DataFrame:
        """Rows of one key, from one bucket; key and bucket filters both reach the scan."""
        wanted = self._bucketed(spark.range(1).select(F.lit(key).alias(self.key))).first()[BUCKET]
        return self._all(spark).filter((F.col(BUCKET) == wanted) & (F.col(self.key) == F.lit(key))).drop(BUCKET)

    def read(self, keys: DataFrame) -> DataFrame:
        """Rows whose key is in ``keys``, joined on bucket and key so that other buckets are pruned at run time."""
        wanted = self._bucketed(keys.select(self.key)).distinct()
        return self._all(keys.sparkSession).join(wanted, [BUCKET, self.key], "left_semi").drop(BUCKET)

    def reset(self, spark: SparkSession) -> None:
        """Empties the store and keeps its schema."""
        empty = spark.createDataFrame([], self._all(spark).schema)
        empty.write.mode("overwrite").parquet(self.path)
