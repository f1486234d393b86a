"""Shared parts: columns, group statistics that survive hot keys, samples and staged tables."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.session import discard, release, shared_dir, staged, table

__all__ = ["attach_groups", "discard", "held_out", "hot_limit", "keyed", "labelled_sample", "lean", "release", "shared_dir", "sheltered", "staged", "table", "words"]

#: ASCII white space; all else belongs to words.
SPACE = "[\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text; null gives none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 1 when divided by 3; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """For functions over batches: at the end of a task its worker, which Spark keeps for others, gives freed memory back."""

    @wraps(run)
    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU C library
                trim(0)

    return task


def keyed(df: DataFrame) -> DataFrame:
    """Adds ``_rid``, unique per row; stable once the result is staged."""
    return df.withColumn("_rid", F.monotonically_increasing_id())


def sheltered(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For operators that return rows of ``docs``: extra columns named with an underscore first, as helper columns are,
    go by other names while the operator runs, so that none is hidden or overwritten."""

    @wraps(operator)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        names, taken, safe = docs.columns, set(docs.columns), []
        for i, name in enumerate(names):
            if name.startswith("_") and name not in options.values():
                name = f"x{i}{name}"
                while name in taken:
                    name = f"x{name}"
                taken.add(name)
            safe.append(name)
        return operator(docs.toDF(*safe), *args, **options).toDF(*names)

    return run


def hot_limit(n_rows: int) -> int:
    """Groups over this size are hot; there are at most 4096 of them, whatever the input."""
    return max(64, n_rows // 4096)


def attach_groups(rows: DataFrame, stats: DataFrame, key: str, size: str, n_rows: int) -> DataFrame:
    """Left join of ``rows`` with one row of ``stats`` per key, without a task for a hot key.

    Hot groups, at most 4096 rows of ``stats``, are broadcast; the others, each small, are joined by a shuffle.
    """
    limit = hot_limit(n_rows)
    hot, cold = stats.filter(F.col(size) > limit), stats.filter(F.col(size) <= limit)
    at_hot = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, "left")
    return at_hot.unionByName(rest)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """Documents to learn from, with column ``y`` and a count of each class in all labels that may be learnt from.

    Takes at most ``per_class`` ids of each class, those whose hashed id is smallest; ids that are held out never.
    An id labelled both ways counts as 1; a null id or label doesn't count.
    """
    usable = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y")).dropna().filter(F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("y").alias("y"))
    sizes = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = None
    for y in (0, 1):
        part = usable.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    # at most 2 * per_class rows of two numbers
    return docs.join(F.broadcast(picked), "doc_id"), sizes
