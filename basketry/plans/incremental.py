"""Incremental update: L(DB) and L(db) give L(DB + db), counting only the sets known on one side."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.thresholds import absolute_support, check_lossless
from basketry.operators import counting, encode
from basketry.session import checkpoint


def only_in_new(l_old: DataFrame, l_new: DataFrame, old: DataFrame) -> DataFrame:
    """(items, support_new, support_old): sets frequent in the increment alone, counted in the old baskets."""
    lone = checkpoint(l_new.join(l_old.select("items"), "items", "left_anti").withColumnRenamed("support", "support_new"))
    return lone.join(counting.supports_in(old, lone).withColumnRenamed("support", "support_old"), "items")


def only_in_old(l_old: DataFrame, l_new: DataFrame, new: DataFrame) -> DataFrame:
    """(items, support_old, support_new): sets frequent in the old baskets alone, counted in the increment."""
    lone = checkpoint(l_old.join(l_new.select("items"), "items", "left_anti").withColumnRenamed("support", "support_old"))
    return lone.join(counting.supports_in(new, lone).withColumnRenamed("support", "support_new"), "items")


def in_both(l_old: DataFrame, l_new: DataFrame) -> DataFrame:
    return l_old.withColumnRenamed("support", "support_old").join(l_new.withColumnRenamed("support", "support_new"), "items")


def merge(l_old: DataFrame, l_new: DataFrame, old: DataFrame, new: DataFrame, min_sup: int) -> DataFrame:
    """(items, support) of the union at an absolute threshold."""
    cols = ["items", "support_old", "support_new"]
    parts = in_both(l_old, l_new).select(cols).unionByName(only_in_new(l_old, l_new, old).select(cols)).unionByName(only_in_old(l_old, l_new, new).select(cols))
    return parts.select("items", (F.col("support_old") + F.col("support_new")).alias("support")).filter(F.col("support") >= min_sup)


def update_patterns(l_old: DataFrame, l_new: DataFrame, old: DataFrame, new: DataFrame, min_sup: int | float | str | Fraction, thresholds: tuple[int, int] | None = None) -> DataFrame:
    """L(DB + db). ``min_sup`` is a share, or absolute with the ``thresholds`` used on the old and new part.

    Transactions of the two parts must be different. Raises ValueError if the thresholds could lose a set.
    """
    old, new = encode.normalize(old), encode.normalize(new)
    n_old, n_new = encode.transaction_count(old), encode.transaction_count(new)
    if thresholds is None:
        if isinstance(min_sup, int):
            raise ValueError("an absolute min_sup needs the thresholds of both parts")
        thresholds = absolute_support(min_sup, max(1, n_old)), absolute_support(min_sup, max(1, n_new))
    total = absolute_support(min_sup, max(1, n_old + n_new))
    if isinstance(min_sup, int):
        check_lossless(*thresholds, total)
    return merge(l_old, l_new, old, new, total)
