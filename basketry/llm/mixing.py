"""Mixing sources to target weights by pivotal dependent rounding in a reduction tree."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import attach_groups, keyed, sheltered, staged, words

#: Units that one leaf of the tree pairs, and residuals that one inner node does.
LEAF = 4096
EPS = 1e-9


def source_plan(rows: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """(sk, no, source_size, n, target) of each source of ``rows`` (sk, size); ``sk`` sorts as sources do, null last.

    Sources take the weights in turn. None gets over ``cap`` times its size; what is over goes to the others by weight.
    So the target is the smaller of cap * size and level * weight, with one level for all, which is raised until the
    targets add up to all sizes. Only sums come to the driver, so there may be any number of sources.
    """
    totals = rows.groupBy("sk").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    parts = staged(totals.repartitionByRange("sk").sortWithinPartitions("sk").select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "sources")
    counts = parts.groupBy("part").agg(F.count(F.lit(1)).alias("k"))  # a row a partition
    starts = counts.select("part", (F.sum("k").over(Window.orderBy("part")) - F.col("k")).alias("start"))
    no = F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("no") % len(weights) + 1).cast("int"))
    plan = parts.join(F.broadcast(starts), "part").withColumn("no", no).withColumn("weight", weight)
    plan = staged(plan.select("sk", "no", "source_size", "n", "weight"), "source-weights")
    total, level, before = plan.agg(F.sum("source_size")).first()[0] or 0, math.inf, None
    while level != before and total:
        before, full = level, F.col("weight") * level > cap * F.col("source_size") if level < math.inf else F.lit(False)
        # sizes are whole numbers, so their sum doesn't depend on the order
        kept, shared = plan.agg(F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)), F.sum(F.when(~full, F.col("weight")))).first()
        level = (total - cap * kept) / shared if shared else level
    target = F.least(cap * F.col("source_size"), F.col("weight") * level) if total else F.lit(0.0)
    return plan.select("sk", "no", "source_size", "n", target.cast("double").alias("target"))


def pivot(sizes: np.ndarray, probs: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Round probabilities to 0 or 1 in the given order; returns them and the index of the one left between, or -1.

    Each step moves mass, counted in words, between the residual and the next unit until one of the two is integral.
    The direction is drawn so that every expectation stays; the sum of size times probability never changes.
    """
    p = probs.astype(float).tolist()
    w = sizes.astype(float).tolist()
    draws = rng.random(len(p)).tolist()
    i = -1
    for j in range(len(p)):
        if not EPS < p[j] < 1 - EPS:
            p[j] = float(round(p[j]))
            continue
        if i < 0:
            i = j
            continue
        up = min((1 - p[i]) * w[i], p[j] * w[j])  # most that i can take from j
        down = min(p[i] * w[i], (1 - p[j]) * w[j])
        d = up if draws[j] * (up + down) < down else -down
        p[i] += d / w[i]
        p[j] -= d / w[j]
        done_i, done_j = not EPS < p[i] < 1 - EPS, not EPS < p[j] < 1 - EPS
        if done_i:
            p[i] = float(round(p[i]))
        if done_j:
            p[j] = float(round(p[j]))
        i = -1 if done_i and done_j else j if done_i else i
    return np.array(p), i


def _rows(docs: DataFrame, text: str, doc_id: str, source: str) -> DataFrame:
    """``docs`` with ``_size``, ``_sk`` (the source, so that null sorts last) and ``_key``, the same for rows equal in id,
    source and text."""
    mark = lambda c: F.when(c.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), c.cast("string")))
    body, sk = F.coalesce(F.col(text), F.lit("")), mark(F.col(source))
    key = F.unhex(F.md5(F.concat_ws("\x00", mark(F.col(doc_id)), F.md5(sk.cast("binary")), body).cast("binary")))
    return docs.withColumns({"_size": F.size(words(body)).cast("long"), "_sk": sk, "_key": key})


def _round(units: DataFrame, most: int, seed: int) -> DataFrame:
    """(key, up): which of ``units`` (key, no, w, p, node) are rounded up. ``most``: leaves of the largest source."""
    shape = "key binary, no long, w long, p double, node long, left boolean"

    def round_node(level: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.assign(key=[bytes(k) for k in pdf["key"]]).sort_values(["w", "key"], ascending=[False, True]).reset_index(drop=True)
            rng = np.random.default_rng([seed, level, int(pdf["no"].iloc[0]), int(pdf["node"].iloc[0])])
            p, left = pivot(pdf["w"].to_numpy(), pdf["p"].to_numpy(), rng)
            out = pdf[["key", "no", "w", "node"]].assign(p=p, left=False)
            if left >= 0:
                out.loc[left, "left"] = True
            return out[["key", "no", "w", "p", "node", "left"]]

        return run

    decided, level = [], 0
    now = staged(units.groupBy("no", "node").applyInPandas(round_node(0), shape), "mix0")
    while most > 1:
        decided.append(now.filter("not left"))
        most, level = math.ceil(most / LEAF), level + 1
        up = now.filter("left").withColumn("node", F.floor(F.col("node") / LEAF))
        now = staged(up.groupBy("no", "node").applyInPandas(round_node(level), shape), f"mix{level}")
    for part in decided:
        now = now.unionByName(part)
    return now.select("key", F.round("p").cast("long").alias("up"))


def _copies(rows: DataFrame, weights: tuple[float, ...], cap: float, seed: int) -> DataFrame:
    """``rows`` (rid, key, sk, size, and any others) with ``source_size``, ``target`` and ``copies``."""
    n = rows.count()
    plan = staged(source_plan(rows, weights, cap).withColumn("leaves", F.greatest(F.lit(1), F.ceil(F.col("n") / LEAF))), "mix-plan")
    most = plan.agg(F.max("leaves")).first()[0] or 1
    units = rows.filter("size > 0").groupBy("key").agg(F.max("sk").alias("sk"), F.max("size").alias("w"), F.count(F.lit(1)).alias("m"))
    rate = F.col("target") / F.col("source_size")
    units = attach_groups(units, plan, "sk", "n", n).withColumn("base", F.floor(rate + EPS)).withColumn("mass", F.col("m") * F.greatest(F.lit(0.0), rate - F.col("base")))
    units = units.withColumn("sure", F.floor(F.col("mass") + EPS)).withColumn("p", F.greatest(F.lit(0.0), F.col("mass") - F.col("sure")))
    units = staged(units.select("key", "no", "w", "m", "base", "sure", "p", F.pmod(F.xxhash64("key", F.lit(seed)), F.col("leaves")).alias("node")), "mix-units")
    rounded = units.join(_round(units.select("key", "no", "w", "p", "node"), most, seed), "key")
    rounded = staged(rounded.select("key", "m", "base", (F.col("sure") + F.col("up")).alias("more")), "mix-rounded")

    # of equal rows, ``more`` have one copy more; they are counted partition by partition where that is not all or none
    placed = attach_groups(rows, rounded, "key", "m", n).withColumn("part", F.shiftright("rid", 33))
    some = F.coalesce((F.col("more") > 0) & (F.col("more") < F.col("m")), F.lit(False))
    split = staged(placed.filter(some), "mix-equal")
    counts = split.groupBy("key", "part").agg(F.count(F.lit(1)).alias("k"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("key", "part", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("start"))
    at = F.col("start") + F.row_number().over(Window.partitionBy("key", "part").orderBy("rid"))
    split = split.join(starts, ["key", "part"]).withColumn("more", F.when(at <= F.col("more"), F.col("m")).otherwise(F.lit(0).cast("long"))).drop("start")
    done = placed.filter(~some).unionByName(split).withColumn("copies", F.coalesce(F.col("base") + (F.col("more") > 0).cast("long"), F.lit(0).cast("long")))
    return attach_groups(done.drop("m", "base", "more", "part"), plan.select("sk", "n", "source_size", "target"), "sk", "n", n).drop("n")


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0, seed: int = 17, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken), one row per input row.

    A row is taken floor(r) times and once more with probability r - floor(r), r being its source's target over size.
    Rows equal in id, source and text are one unit: of m such rows floor(m * (r - floor(r))) are taken once more for
    sure, and one with the probability that is left. These fractions are rounded together: units of a source are dealt
    to leaves of about 4096, each goes through its units from the largest on, so that what is left over is small, and
    one residual a leaf goes up the tree. The residual at the root is rounded to the nearer side. Draws depend on the
    rows, the seed and the place in the tree alone, so reruns agree. Texts without words have size 0 and are not taken.
    An empty table gives an empty result.
    """
    found = keyed(_rows(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text")), "text", "doc_id", "source"))
    rows = staged(found.select(F.col("_rid").alias("rid"), F.col("_key").alias("key"), F.col("_sk").alias("sk"), F.col("_size").alias("size"), "doc_id", "source"), "sizes")
    return _copies(rows, weights, cap, seed).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


@sheltered
def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0, seed: int = 17, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """The mix itself: the rows of ``docs``, each as many times as it is taken."""
    rows = staged(keyed(_rows(docs, text, doc_id, source)), "mix-rows")
    found = _copies(rows.select(F.col("_rid").alias("rid"), F.col("_key").alias("key"), F.col("_sk").alias("sk"), F.col("_size").alias("size")), weights, cap, seed)
    kept = rows.join(found.filter("copies > 0").select(F.col("rid").alias("_rid"), F.col("copies").cast("int").alias("_copies")), "_rid")
    return kept.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(docs.columns)
