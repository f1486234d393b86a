"""Exact dedup: two passes with a Bloom filter, so that only possibly repeated rows shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.bloom import may_repeat, members, seen_twice, slice_of, slices
from basketry.llm.common import attach_groups, keyed, sheltered, staged


def exact_dedup(docs: DataFrame, max_filter_bytes: int = 64 << 20, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per input row.

    Pass one hashes every text once and fills the filter; pass two tests each hash. Rows that the filter clears pass
    straight through; the rest are grouped by their SHA-256, never by the text. The hash space is dealt to so many
    slices that the filter of one takes ``max_filter_bytes`` at most (about 33 million rows at 64 MB); both passes run
    for each slice, on the digests, which are written once and take 50 bytes a row.

    Null texts count as empty. Of equal texts the row with the largest doc_id stays, a null id being the smallest; of
    rows equal in both, one stays. An empty table gives an empty result; other columns of ``docs`` are not looked at.
    """
    spark = docs.sparkSession
    content = F.coalesce(F.col(text), F.lit("")).cast("binary")
    digests = keyed(docs.select(F.col(doc_id).alias("doc_id"), F.unhex(F.sha2(content, 256)).alias("sha")))
    digests = staged(digests.withColumn("key", F.xxhash64("sha")), "digests")
    n = digests.count()
    parts = slices(n, max_filter_bytes)
    marked = []
    for k in range(parts):
        part = digests.filter(slice_of(F.col("key"), parts) == k) if parts > 1 else digests
        bits = seen_twice(part, "key", part.count())
        marked.append(staged(part.withColumn("maybe", may_repeat(bits, F.col("key"), spark)).drop("key"), "marked"))
    marked = reduce(DataFrame.unionByName, marked)
    suspects = marked.filter("maybe").drop("maybe")
    groups = suspects.groupBy("sha").agg(F.max(F.struct("doc_id", "_rid")).alias("top"), F.count(F.lit(1)).alias("group_size"))
    groups = staged(groups.filter("group_size > 1"), "groups")
    found = attach_groups(suspects, groups, "sha", "group_size", n).select(
        "doc_id",
        F.when(F.col("top").isNull(), F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("top._rid") == F.col("_rid"), F.lit(True)).alias("kept"),
        "sha",
    )
    clear = marked.filter("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    return clear.unionByName(found).withColumn("text_sha256", F.lower(F.hex("sha"))).drop("sha")


@sheltered
def distinct_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay. Rows that a filter of the dropped ones clears aren't shuffled."""
    text, doc_id = options.get("text", "text"), options.get("doc_id", "doc_id")
    lost = exact_dedup(docs, **options).filter("not kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_lost"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("_again"))
    lost = staged(lost.distinct(), "lost")
    bits = members(lost.select(F.xxhash64("_id", "_lost").alias("k")), "k")
    marked = docs.withColumn("_sha", F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))
    marked = marked.withColumn("_maybe", may_repeat(bits, F.xxhash64(doc_id, "_sha"), docs.sparkSession))
    doubt = marked.filter("_maybe").join(lost, (F.col("_sha") == F.col("_lost")) & F.col(doc_id).eqNullSafe(F.col("_id")), "left")
    once = doubt.filter("_again").dropDuplicates(["_sha"])
    cols = docs.columns
    return marked.filter("not _maybe").select(cols).unionByName(doubt.filter("_again is null").select(cols)).unionByName(once.select(cols))


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
