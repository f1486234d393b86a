"""Support counting: three strategies that must agree.

* ``horizontal`` keeps (tid, candidate) occurrences in the JVM: baskets are exploded into the item pairs that start a
  candidate. Best for sparse items and short baskets.
* ``bitmap`` ANDs Spark's own bitmaps per (candidate, stripe, bucket). Best for dense items in pure Catalyst.
* ``arrow`` ANDs NumPy bit rows per (block of candidates, stripe of transactions); blocks hold a fixed number of
  candidates that are neighbours in order, and meet the rows of their own items only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.operators.encode import vertical_bitmaps
from basketry.session import checkpoint, release, staged

#: Candidates in a block of ``arrow``: a task holds the 4 KB rows of at most this many items and their prefixes.
BATCH = 25_000
#: Baskets with more items than this are split for the pair join.
LONG = 2_048
#: Items of a stripe in a part of the bitmap pair count: a task holds the 4 KB rows of two parts.
PART = 1_024
#: Rows ANDed at once within a task: 8 MB.
_CHUNK = 2_048
#: Packed rows of pairs that a task sums at once; a row has about PART pairs at most.
_ROWS = 1_000


@dataclass(frozen=True)
class Profile:
    """``longest``: items of the longest basket; ``pairs``: item pairs in all baskets; ``n_tids``: baskets; ``span``: from the first tid to the last."""

    longest: int
    pairs: int
    n_tids: int
    span: int

    @property
    def sparse(self) -> bool:
        """Most bits of bit rows over these tids would stand for none."""
        return self.span > 4 * self.n_tids + 32_768


def profile(baskets: DataFrame) -> Profile:
    sizes = baskets.groupBy("tid").agg(F.count(F.lit(1)).alias("n"))
    row = sizes.agg(F.max("n"), F.sum(F.expr("n * (n - 1) div 2")), F.count(F.lit(1)), F.max("tid"), F.min("tid")).first()
    return Profile(row[0] or 0, row[1] or 0, row[2], row[3] - row[4] + 1 if row[2] else 0)


def pair_support(baskets: DataFrame, min_sup: int = 1, longest: int | None = None) -> DataFrame:
    """(items, support) of all item pairs by an equi-join on the transaction.

    A basket of more than ``LONG`` items (``longest`` is looked up where it isn't given) is dealt into parts by item,
    and each part joined with the whole basket, so that no task makes all pairs of one basket.
    """
    if longest is None:
        longest = profile(baskets).longest
    if longest <= LONG:
        left, right, on = baskets, baskets, ["tid"]
    else:
        parts = baskets.groupBy("tid").agg(F.ceil(F.count(F.lit(1)) / LONG).cast("int").alias("parts"))
        sized = baskets.join(parts, "tid")
        left = sized.withColumn("part", F.pmod(F.hash("item"), "parts"))
        right = sized.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        on = ["tid", "part"]
    joined = left.select(*on, F.col("item").alias("i")).join(right.select(*on, F.col("item").alias("j")), on).filter("i < j")
    counted = joined.groupBy("i", "j").agg(F.count(F.lit(1)).alias("support"))
    return counted.filter(F.col("support") >= min_sup).select(F.array("i", "j").alias("items"), "support")


def pair_support_bitmap(baskets: DataFrame, min_sup: int = 1) -> DataFrame:
    """(items, support) of all item pairs that some basket holds, by ANDs of bit rows. Rows of ``baskets`` may repeat.

    Pairs are made within a stripe of transactions, of the items that it has; items without a stripe in common don't
    meet. The items of a stripe are dealt into parts of about ``PART``, and a task ANDs one or two parts of one stripe,
    each row with those of larger items, in the words where it has bits. Supports are summed from packed rows.
    """
    packed = packed_pairs(baskets)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Pairs as one number, in order; those of the last item and block wait for more."""
        pairs, support = np.array([], np.int64), np.array([], np.int64)
        for pdf in batches:
            for low in range(0, len(pdf), _ROWS):
                some = pdf.iloc[low : low + _ROWS]
                i, block = some["i"].to_numpy(np.int64), some["block"].to_numpy(np.int64)
                first = (i << 32) + (block << 16) + (1 << 31)
                mates = [_unpacked(x).cumsum() for x in some["mates"]]
                pairs = np.concatenate([pairs, *(k + x for k, x in zip(first, mates))])
                pairs, at = np.unique(pairs, return_inverse=True)
                support = np.bincount(at, np.concatenate([support, *map(_unpacked, some["ones"])])).astype(np.int64)
                done = np.searchsorted(pairs, first[-1])
                yield _pairs(pairs[:done], support[:done])
                pairs, support = pairs[done:], support[done:]
        yield _pairs(pairs, support)

    sums = packed.repartition("i", "block").sortWithinPartitions("i", "block").mapInPandas(add, "i int, j int, support long")
    return sums.filter(F.col("support") >= min_sup).select(F.array("i", "j").alias("items"), "support")


def packed_pairs(baskets: DataFrame) -> DataFrame:
    """(i, block, mates, ones): for an item, of a stripe and part, the larger items of a block of 65,536 that share
    transactions with it, as steps from one to the next, and how many each; both packed."""
    # rows that are met where they are aggregated: half-filled bit rows of each map task would take more
    met = baskets.select("item", F.expr("bitmap_bucket_number(tid)").alias("stripe"), F.expr("bitmap_bit_position(tid)").alias("bit")).repartition("item", "stripe")
    rows = staged(met.groupBy("item", "stripe").agg(F.expr("bitmap_construct_agg(bit)").alias("bits")), "bit_rows")
    release()
    sizes = rows.groupBy("stripe").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    dealt = rows.join(sizes, "stripe").withColumn("part", F.pmod(F.xxhash64("item"), "parts").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("stripe", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), (F.col("part") > F.col("other")).alias("right"), "item", "bits")

    def part_pairs(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item")
        ids, right = pdf["item"].to_numpy(np.int64), pdf["right"].to_numpy()
        bits = np.frombuffer(b"".join(pdf["bits"]), np.uint64).reshape(len(pdf), -1)
        p, q = np.flatnonzero(~right), np.flatnonzero(right)
        found = []
        for one, other in ((p, q), (q, p)) if key[1] < key[2] else ((np.arange(len(ids)),) * 2,):
            columns, mates = np.ascontiguousarray(bits[other].T), ids[other]
            for row in one:
                first = int(np.searchsorted(mates, ids[row], side="right"))
                words = np.flatnonzero(bits[row])
                ones = np.bitwise_count(columns[words, first:] & bits[row, words][:, None]).sum(axis=0, dtype=np.int32)
                some = np.flatnonzero(ones)
                blocks = mates[first + some] >> 16
                for x in np.split(some, np.flatnonzero(np.diff(blocks)) + 1) if len(some) else ():
                    found.append((ids[row], mates[first + x[0]] >> 16, _packed(np.diff(mates[first + x] & 0xFFFF, prepend=0)), _packed(ones[x])))
        return pd.DataFrame(found, columns=["i", "block", "mates", "ones"]).astype({"i": np.int32, "block": np.int32})

    return dealt.groupBy("stripe", "p", "q").applyInPandas(part_pairs, "i int, block int, mates binary, ones binary")


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers below 65,536: their low bytes, then their high bytes, most of them 0."""
    return numbers.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(2, -1).T.astype(np.int64) @ np.array([1, 256])


def _pairs(pairs: np.ndarray, support: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"i": (pairs >> 32).astype(np.int32), "j": ((pairs & 0xFFFFFFFF) - (1 << 31)).astype(np.int32), "support": support})


def count_horizontal(baskets: DataFrame, candidates: DataFrame) -> DataFrame:
    """(items, support) of the candidates with support of 1 or more.

    Candidates join on their first two items, the rarest join key a basket offers cheaply, and one containment test
    per (basket, candidate) replaces a count of matches.
    """
    wanted = candidates.select("items", F.element_at("items", 1).alias("x"), F.element_at("items", 2).alias("y"))
    arrays = baskets.groupBy("tid").agg(F.array_sort(F.collect_list("item")).alias("basket"))
    starts = arrays.select("basket", F.posexplode("basket").alias("at", "x")).join(wanted.select("x").distinct(), "x", "left_semi")
    heads = starts.select("basket", "x", F.explode(F.expr("slice(basket, at + 2, size(basket))")).alias("y"))
    hit = heads.join(wanted, ["x", "y"]).filter(F.size(F.array_except("items", "basket")) == 0)
    return hit.groupBy("items").agg(F.count(F.lit(1)).alias("support"))


def count_bitmap(baskets: DataFrame, candidates: DataFrame, stripes: int = 8) -> DataFrame:
    """(items, support); an item that lacks a bucket is zero there, hence the check that all k bitmaps are present."""
    vertical = vertical_bitmaps(baskets, stripes)
    wanted = candidates.select("items", F.explode("items").alias("item"))
    anded = wanted.join(vertical, "item").groupBy("items", "stripe", "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.expr("bitmap_count(bitmap_and_agg(bitmap))").alias("ones")
    )
    return anded.filter(F.col("n") == F.size("items")).groupBy("items").agg(F.sum("ones").alias("support")).filter("support > 0")


def bit_rows(baskets: DataFrame, tid: str = "tid") -> DataFrame:
    """(item, stripe, bits): 4 KB of bits for each stripe of 32,768 transactions that an item is in."""
    stripe, bits = F.expr(f"bitmap_bucket_number({tid})"), F.expr(f"bitmap_construct_agg(bitmap_bit_position({tid}))")
    return baskets.groupBy("item", stripe.alias("stripe")).agg(bits.alias("bits"))


def count_arrow(baskets: DataFrame, candidates: DataFrame, rows: DataFrame | None = None, batch: int = BATCH) -> DataFrame:
    """(items, support) of the candidates, of any lengths, with support of 1 or more, by NumPy ANDs.

    Candidates are dealt by range into blocks of about ``batch``; each (block, stripe) is one group that gets the
    block's candidates and the rows of its items. A prefix shared by neighbours is ANDed once. Nothing but the number
    and longest of the candidates reaches the driver.
    """
    rows = bit_rows(baskets) if rows is None else rows
    n, longest = candidates.agg(F.count(F.lit(1)), F.max(F.size("items"))).first()
    if not n:
        return baskets.sparkSession.createDataFrame([], "items array<int>, support long")
    width = max(2, longest)
    # ANDing the last item again changes nothing, so that all sets of a block have one length
    padded = F.concat("items", F.array_repeat(F.element_at("items", -1), F.lit(width) - F.size("items")))
    dealt = candidates.select("items", padded.alias("padded")).repartitionByRange(-(-n // batch), "padded", "items").withColumn("block", F.spark_partition_id())
    blocks = checkpoint(dealt.withColumn("no", F.row_number().over(Window.partitionBy("block").orderBy("padded", "items")) - 1))
    needed = blocks.select("block", F.explode("items").alias("item")).distinct()
    pieces = rows.join(needed, "item").select("block", "stripe", "item", "bits")
    flat = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("no", "padded"))), lambda s: s["padded"]))
    per_block = blocks.groupBy("block").agg(flat.alias("flat"))
    sets = pieces.select("block", "stripe").distinct().join(per_block, "block").toDF("of_block", "of_stripe", "flat")

    def part_supports(key, found: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        members = np.asarray(wanted["flat"].iloc[0], dtype=np.int32).reshape(-1, width)
        bits = np.frombuffer(b"".join(found["bits"]), np.uint64).reshape(len(found), -1)
        ids = found["item"].to_numpy()
        order = np.argsort(ids)
        at = order[np.minimum(np.searchsorted(ids, members, sorter=order), len(ids) - 1)]
        nos = np.flatnonzero((ids[at] == members).all(axis=1))  # a set with an item that the stripe lacks is in no basket of it
        at = at[nos]
        sums = np.zeros(len(nos), dtype=np.int64)
        bounds = np.flatnonzero((at[1:, :-1] != at[:-1, :-1]).any(axis=1)) + 1
        for start, stop in zip([0, *bounds], [*bounds, len(nos)]):
            if start == stop:
                continue
            head = np.bitwise_and.reduce(bits[at[start, :-1]], axis=0)
            for low in range(start, stop, _CHUNK):
                high = min(stop, low + _CHUNK)
                sums[low:high] = np.bitwise_count(bits[at[low:high, -1]] & head).sum(axis=1)
        some = sums > 0
        return pd.DataFrame({"block": np.int32(key[0]), "no": nos[some].astype(np.int32), "part": sums[some]})

    counted = pieces.groupBy("block", "stripe").cogroup(sets.groupBy("of_block", "of_stripe")).applyInPandas(part_supports, "block int, no int, part long")
    sums = counted.groupBy("block", "no").agg(F.sum("part").alias("support"))
    return blocks.select("block", "no", "items").join(sums, ["block", "no"]).select("items", "support")


def supports_in(baskets: DataFrame, itemsets: DataFrame) -> DataFrame:
    """(items, support) of given sets of any length, 0 included."""
    found = count_arrow(baskets, itemsets.select("items"))
    return itemsets.select("items").join(found, "items", "left").select("items", F.coalesce("support", F.lit(0).cast("long")).alias("support"))
