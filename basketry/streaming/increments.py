"""Extension: keep patterns up to date from a stream of baskets, one incremental update per micro-batch."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.operators.encode import normalize
from basketry.plans.incremental import update_patterns
from basketry.plans.miner import mine
from basketry.schemas import BASKETS, PATTERNS
from basketry.session import staged


class PatternMaintainer:
    """For ``writeStream.foreachBatch``: baskets and patterns live as Parquet under ``path``, a folder for each batch.

    A batch is an increment of whole transactions. Its folder of baskets holds the increment alone, its folder of
    patterns those of all baskets so far; replaying a batch id writes the same again.
    """

    def __init__(self, path: str, min_sup: float):
        self.path, self.min_sup = path.rstrip("/"), min_sup

    def _before(self, spark: SparkSession, kind: str, batch_id: int, schema) -> DataFrame:
        """Rows of earlier batches with their batch ``v``; none where nothing was written yet."""
        with_batch = schema.fieldNames() + ["v"]
        try:
            found = spark.read.parquet(f"{self.path}/{kind}")
        except AnalysisException:
            return spark.createDataFrame([], schema).withColumn("v", F.lit(0)).select(with_batch)
        return found.select(with_batch).filter(F.col("v") < batch_id)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = staged(normalize(batch), "increment")
        old = self._before(spark, "baskets", batch_id, BASKETS).drop("v")
        l_new, before = mine(new, self.min_sup).itemsets(), self._before(spark, "patterns", batch_id, PATTERNS)
        last = before.agg(F.max("v")).first()[0]
        if last is not None:
            l_new = update_patterns(before.filter(F.col("v") == last).drop("v"), l_new, old, new, self.min_sup)
        elif not old.isEmpty():  # earlier baskets without a pattern
            l_new = mine(old.unionByName(new), self.min_sup).itemsets()
        l_new.write.mode("overwrite").parquet(f"{self.path}/patterns/v={batch_id}")
        new.write.mode("overwrite").parquet(f"{self.path}/baskets/v={batch_id}")

    def patterns(self, spark: SparkSession, batch_id: int) -> DataFrame:
        return spark.read.schema(PATTERNS).parquet(f"{self.path}/patterns/v={batch_id}")
