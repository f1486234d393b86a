"""Candidate generation: prefix join, subset check, dead ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.itemsets import last, one_smaller, prefix


def prefix_join(level: DataFrame) -> DataFrame:
    """(items) of size k+1 from a level of k-sets that share their first k-1 items."""
    side = level.select(prefix(F.col("items")).alias("p"), last(F.col("items")).alias("z"))
    a, b = side.alias("a"), side.alias("b")
    return a.join(b, (F.col("a.p") == F.col("b.p")) & (F.col("a.z") < F.col("b.z"))).select(
        F.concat(F.col("a.p"), F.array(F.col("a.z"), F.col("b.z"))).alias("items")
    )


def subset_check(candidates: DataFrame, level: DataFrame) -> DataFrame:
    """Candidates of which every (k-1)-subset is in ``level``.

    The two subsets that made the candidate, those without one of its last two items, hold already; the rest are
    looked up by a join on the subset.
    """
    others = F.slice(one_smaller(F.col("items")), F.lit(1), F.size("items") - 2)
    exploded = candidates.select("items", F.explode(others).alias("sub"))
    found = exploded.join(level.select(F.col("items").alias("sub")), "sub", "left_semi")
    return found.groupBy("items").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == F.size("items") - 2).select("items")


def dead_ends(level: DataFrame, candidates: DataFrame) -> DataFrame:
    """Sets of ``level`` that no candidate extends."""
    return level.join(candidates.select(prefix(F.col("items")).alias("items")).distinct(), "items", "left_anti")


def node_count(candidates: DataFrame) -> DataFrame:
    """(n_nodes): the nodes a prefix tree over the candidates would have."""
    heads = candidates.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("items")), lambda j: F.slice("items", F.lit(1), j))).alias("head"))
    return heads.distinct().agg(F.count(F.lit(1)).alias("n_nodes"))


def nodes_at(candidates: DataFrame, depth: int) -> DataFrame:
    """(n_nodes) of the same tree at one depth, 2 being that of pairs."""
    heads = candidates.filter(F.size("items") >= depth).select(F.slice("items", 1, depth).alias("head"))
    return heads.distinct().agg(F.count(F.lit(1)).alias("n_nodes"))
