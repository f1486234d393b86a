"""From baskets to supports, ranks and vertical bitmaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.session import checkpoint

WORD_BITS = 16


def normalize(baskets: DataFrame, tid: str = "tid", item: str = "item") -> DataFrame:
    """Distinct (tid BIGINT, item INT); rows with a null in either go."""
    return cleaned(baskets, tid, item).distinct()


def cleaned(baskets: DataFrame, tid: str = "tid", item: str = "item") -> DataFrame:
    """As :func:`normalize`, but rows may repeat."""
    return baskets.select(F.col(tid).cast("long").alias("tid"), F.col(item).cast("int").alias("item")).dropna()


def from_arrays(df: DataFrame, tid: str = "tid", items: str = "items") -> DataFrame:
    return normalize(df.select(F.col(tid).alias("tid"), F.explode(items).alias("item")))


def transaction_count(baskets: DataFrame) -> int:
    return baskets.agg(F.countDistinct("tid")).first()[0]


def item_support(baskets: DataFrame) -> DataFrame:
    """(item, support) of normalised baskets."""
    return baskets.groupBy("item").agg(F.count(F.lit(1)).alias("support"))


def frequent_items(baskets: DataFrame, min_sup: int) -> DataFrame:
    return item_support(baskets).filter(F.col("support") >= min_sup)


def item_rank(supports: DataFrame) -> DataFrame:
    """(rank, item, support), rank 0 for the highest support, ties by item.

    Ranks come from a range partitioning with offsets, so no single task sorts all items.
    """
    order = [F.col("support").desc(), F.col("item")]
    return numbered(supports.select("item", "support"), order, "rank").select(F.col("rank").cast("int").alias("rank"), "item", "support")


def recode(baskets: DataFrame, ranks: DataFrame) -> DataFrame:
    """(tid, item) with each item's rank in place of its id; items without a rank go."""
    return baskets.join(ranks.select("item", "rank"), "item").select("tid", F.col("rank").alias("item"))


def decode(itemsets: DataFrame, ranks: DataFrame) -> DataFrame:
    """(items, support) over ranks back to ids, ascending."""
    members = itemsets.select(F.col("items").alias("coded"), "support", F.explode("items").alias("rank")).join(ranks.select("item", "rank"), "rank")
    found = members.groupBy("coded").agg(F.first("support").alias("support"), F.array_sort(F.collect_list("item")).alias("items"))
    return found.select("items", "support")


def dense_tids(baskets: DataFrame) -> DataFrame:
    """(tid, tid_no) with tid_no 0..n-1 in tid order: bitmaps over sparse keys would be mostly empty."""
    return numbered(baskets.select("tid").distinct(), [F.col("tid")], "tid_no")


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with ``name``, 0 for the first row in ``order``."""
    parts = checkpoint(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    sizes = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    # one row a partition: bounded by the number of partitions
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_off")
    numbered = parts.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    return numbered.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_off") + F.col("_r") - 1).drop("_p", "_r", "_off")


def vertical_words(baskets: DataFrame) -> DataFrame:
    """(item, word_idx, word): transaction t is bit t % 16 of word t div 16."""
    word_idx = F.expr(f"tid div {WORD_BITS}")
    bit = F.expr(f"shiftleft(1L, cast(tid % {WORD_BITS} as int))")
    return baskets.groupBy("item", word_idx.alias("word_idx")).agg(F.bit_or(bit).alias("word"))


def vertical_reserve(baskets: DataFrame, catalog: DataFrame) -> DataFrame:
    """(item, support) of every catalog item, 0 for those in no basket."""
    return catalog.select(F.col("item").cast("int").alias("item")).distinct().join(item_support(baskets), "item", "left").select("item", F.coalesce("support", F.lit(0).cast("long")).alias("support"))


def vertical_bitmaps(baskets: DataFrame, stripes: int = 1) -> DataFrame:
    """(item, stripe, bucket, bitmap) with Spark's 4 KB bitmaps of 32,768 transactions each.

    ``stripes`` deals transactions round robin, so that counting isn't held to the number of buckets.
    """
    pos = F.expr(f"tid div {stripes}")
    return baskets.select("item", F.expr(f"cast(pmod(tid, {stripes}) as int)").alias("stripe"), pos.alias("pos")).groupBy(
        "item", "stripe", F.expr("bitmap_bucket_number(pos)").alias("bucket")
    ).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(pos))").alias("bitmap"))
