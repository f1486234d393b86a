"""AND and popcount of bit vectors held as words: single, batched and segmented forms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.itemsets import and_words, ceil_div, popcount_words


def and_pair(words: DataFrame, left: int, right: int) -> DataFrame:
    """(word_idx, word) of two items of a vertical table; zero words are dropped."""
    a = words.filter(F.col("item") == left).select("word_idx", F.col("word").alias("a"))
    b = words.filter(F.col("item") == right).select("word_idx", F.col("word").alias("b"))
    return a.join(b, "word_idx").select("word_idx", F.col("a").bitwiseAND(F.col("b")).alias("word")).filter("word <> 0")


@dataclass
class AndCalls:
    """Calls of :func:`vector_and` that stored a vector, and that counted one."""

    stored: int = 0
    counted: int = 0


def vector_and(words: DataFrame, left: int, right: int, stored: DataFrame | None = None, store: bool = True, count: bool = True, calls: AndCalls | None = None) -> tuple[DataFrame | None, int]:
    """One AND with flags: (vector, ones), the vector None unless ``store``, the ones -1 unless ``count``.

    ``right`` is an item of ``words`` or, where ``stored`` is given, the ``seg`` of an intermediate result there
    (seg, word_idx, word).
    """
    other = words.withColumnRenamed("item", "seg") if stored is None else stored
    a = words.filter(F.col("item") == left).select("word_idx", F.col("word").alias("a"))
    b = other.filter(F.col("seg") == right).select("word_idx", F.col("word").alias("b"))
    anded = a.join(b, "word_idx").select("word_idx", F.col("a").bitwiseAND(F.col("b")).alias("word")).filter("word <> 0")
    ones = (anded.agg(F.sum(F.bit_count("word").cast("long"))).first()[0] or 0) if count else -1
    if calls is not None:
        calls.stored += store
        calls.counted += count
    return (anded if store else None), ones


def array_and(arrays: DataFrame, left: int, right: int) -> DataFrame:
    """(words, support) of two items of a table (item, words ARRAY<BIGINT>) with arrays of one length.

    The filter on the items reaches below the making of the arrays, so that no others are made.
    """
    both = arrays.filter(F.col("item").isin(left, right)).agg(*(F.first(F.when(F.col("item") == item, F.col("words")), ignorenulls=True).alias(name) for item, name in ((left, "a"), (right, "b"))))
    anded = both.dropna().select(and_words(F.col("a"), F.col("b")).alias("words"))
    return anded.select("words", popcount_words(F.col("words")).alias("support"))


def word_arrays(words: DataFrame, n_tids: int, bits: int = 16) -> DataFrame:
    """(item, words): dense arrays of a vertical table, zeros where an item has no word.

    Each word is followed by the zeros up to the next one, so that the work grows with the length of the arrays.
    """
    size = ceil_div(F.lit(n_tids).cast("long"), bits)
    zeros = lambda n: F.array_repeat(F.lit(0).cast("long"), n.cast("int"))
    inside = F.when(F.col("word_idx").between(0, size - 1), F.struct(F.col("word_idx").cast("long").alias("at"), F.coalesce(F.col("word").cast("long"), F.lit(0)).alias("word")))
    held = words.groupBy("item").agg(F.array_sort(F.collect_list(inside)).alias("held"))
    place = lambda k: F.coalesce(F.get("held", k)["at"], size)
    filled = F.concat(zeros(place(F.lit(0))), F.flatten(F.transform("held", lambda x, k: F.concat(F.array(x["word"]), zeros(place(k + 1) - x["at"] - 1)))))
    return held.select("item", filled.alias("words"))


def popcount_by_item(words: DataFrame) -> DataFrame:
    return words.groupBy("item").agg(F.sum(F.bit_count("word").cast("long")).alias("support"))


def children_support(baskets: DataFrame, parents: DataFrame) -> DataFrame:
    """(parent, child, support) for rows (parent INT, children ARRAY<INT>): one parent vector against many children."""
    pairs = parents.select("parent", F.explode("children").alias("child")).distinct()
    p = baskets.select("tid", F.col("item").alias("parent")).join(parents.select("parent").distinct(), "parent", "left_semi")
    hit = p.join(pairs, "parent").join(baskets.select("tid", F.col("item").alias("child")), ["tid", "child"])
    counted = hit.groupBy("parent", "child").agg(F.count(F.lit(1)).alias("support"))
    return pairs.join(counted, ["parent", "child"], "left").select("parent", "child", F.coalesce("support", F.lit(0).cast("long")).alias("support"))


def bounded_parents(parents: list[int], lengths: list[int], children: list[int]) -> list[tuple[int, list[int]]]:
    """Flat batch description (parents, child-list lengths, concatenated children) as (parent, children) rows."""
    if len(parents) != len(lengths) or sum(lengths) != len(children):
        raise ValueError("lengths must match the parents and add up to the children")
    out, at = [], 0
    for parent, n in zip(parents, lengths):
        out.append((parent, children[at : at + n]))
        at += n
    return out


def bounded_and(words: DataFrame, parents: list[int], lengths: list[int], children: list[int], stored: DataFrame | None = None, begin: int = -1, store: bool = False) -> DataFrame:
    """A batch of parents, each ANDed with its own children of ``words(item, word_idx, word)``.

    With ``begin`` -1 a parent is an item of ``words``; otherwise it counts from segment ``begin`` of ``stored(seg,
    word_idx, word)``, vectors that an earlier batch kept. Gives (parent, pos, child, support), or with ``store``
    (seg, word_idx, word), the segments numbered in the order of the children.
    """
    if (begin < 0) != (stored is None):
        raise ValueError("stored vectors and their beginning come together")
    rows, at = [], 0
    for parent, held in bounded_parents(parents, lengths, children):
        rows += [(parent, parent + max(begin, 0), pos, child, at + pos) for pos, child in enumerate(held)]
        at += len(held)
    pairs = words.sparkSession.createDataFrame(rows, "parent int, left int, pos int, child int, seg int")
    source = words.withColumnRenamed("item", "seg") if stored is None else stored
    left = source.select(F.col("seg").alias("left"), "word_idx", F.col("word").alias("a"))
    right = words.select(F.col("item").alias("child"), "word_idx", F.col("word").alias("b"))
    hit = pairs.join(left, "left").join(right, ["child", "word_idx"]).withColumn("word", F.col("a").bitwiseAND(F.col("b"))).filter("word <> 0")
    if store:
        return hit.select("seg", "word_idx", "word")
    counted = hit.groupBy("seg").agg(F.sum(F.bit_count("word").cast("long")).alias("support"))
    return pairs.join(counted, "seg", "left").select("parent", "pos", "child", F.coalesce("support", F.lit(0).cast("long")).alias("support"))


def segmented_and(words: DataFrame, pairs: DataFrame, store: bool = True) -> DataFrame:
    """Segment ANDs: ``words(side, seg, word_idx, word)`` with sides ``l`` and ``r``; ``pairs(parent, pos, child)``.

    Gives (parent, pos, child, word_idx, word), or with ``store=False`` the popcount of each word as ``ones``.
    """
    left = words.filter("side = 'l'").select(F.col("seg").alias("parent"), "word_idx", F.col("word").alias("a"))
    right = words.filter("side = 'r'").select(F.col("seg").alias("child"), "word_idx", F.col("word").alias("b"))
    anded = pairs.join(left, "parent").join(right, ["child", "word_idx"]).withColumn("word", F.col("a").bitwiseAND(F.col("b")))
    value = F.col("word") if store else F.bit_count("word").alias("ones")
    return anded.select("parent", "pos", "child", "word_idx", value)
