"""Column functions on ascending itemset arrays and on bit words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def prefix(items: Column) -> Column:
    """All items but the last."""
    return F.slice(items, F.lit(1), F.size(items) - 1)


def last(items: Column) -> Column:
    return F.element_at(items, -1)


def one_smaller(items: Column) -> Column:
    """Array of the (k-1)-subsets of a k-set."""
    return F.transform(
        F.sequence(F.lit(1), F.size(items)),
        lambda p: F.concat(F.slice(items, F.lit(1), p - 1), F.slice(items, p + 1, F.size(items))),
    )


def itemset_text(items: Column) -> Column:
    return F.array_join(items.cast("array<string>"), " ")


def pattern_line(items: Column, support: Column) -> Column:
    """``1 2 5 (2)``; the empty set gives ``(9)``."""
    body = itemset_text(items)
    return F.concat(F.when(F.size(items) > 0, F.concat(body, F.lit(" "))).otherwise(F.lit("")), F.lit("("), support.cast("string"), F.lit(")"))


def ceil_div(x: Column, y: int) -> Column:
    return F.call_function("div", x + (y - 1), F.lit(y))


def and_words(a: Column, b: Column) -> Column:
    """Word-wise AND of two arrays of words of the same length."""
    return F.zip_with(a, b, lambda x, y: x.bitwiseAND(y))


def popcount_words(words: Column) -> Column:
    return F.aggregate(words, F.lit(0).cast("long"), lambda acc, w: acc + F.bit_count(w))
