"""Connected components of a distributed edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import attach_groups, staged


def _star(edges: DataFrame, n: int) -> DataFrame:
    """Every neighbour ``v`` of ``u`` with the least of u and its neighbours, as (u, v, m)."""
    least = staged(edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("deg")), "least")
    return attach_groups(edges, least, "u", "deg", n).select("u", "v", F.least("m", "u").alias("m"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, root) of all nodes of edges (u, v) of two longs; the root is the smallest id of its component.

    Work and storage follow the edges; hubs are handled by :func:`attach_groups`. No component is brought together.
    """
    now = staged(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        n, mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, mark) == before or not n:
            break
        before = (n, mark)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, 2 * n).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = staged(large.filter("u <> v").distinct(), "large")
        small = _star(large, n)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        now = staged(small.filter("u <> v").distinct(), "small")
    else:
        raise RuntimeError(f"components not settled in {max_rounds} rounds")
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
