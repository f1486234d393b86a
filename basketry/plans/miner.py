"""Level-wise mining: candidates from the last level, counting by a chosen strategy, one table written a level."""

from __future__ import annotations

import time
from dataclasses import dataclass
from fractions import Fraction
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry import schemas
from basketry.functions.itemsets import itemset_text, pattern_line
from basketry.functions.thresholds import absolute_support
from basketry.operators import counting, encode
from basketry.operators.candidates import node_count, prefix_join, subset_check
from basketry.session import staged
from basketry.sources.patterns import write_patterns

STRATEGIES = ("auto", "horizontal", "bitmap", "arrow")


@dataclass
class MiningResult:
    """``levels``: one DataFrame (items, support) for each length; ``n_tids``: transactions; ``min_sup``: absolute."""

    levels: list[DataFrame]
    n_tids: int
    min_sup: int
    stats: list[tuple]
    empty: DataFrame

    @property
    def total(self) -> int:
        """Patterns found, the empty set not counted."""
        return sum(row[3] for row in self.stats)

    def itemsets(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.levels) if self.levels else self.empty

    def patterns(self, include_empty: bool = False) -> DataFrame:
        """(level INT, itemset STRING, support BIGINT)."""
        sets = self.itemsets()
        out = sets.select(F.size("items").alias("level"), itemset_text(F.col("items")).alias("itemset"), "support")
        if include_empty:
            row = sets.sparkSession.createDataFrame([(0, "", self.n_tids)], "level int, itemset string, support long")
            out = row.unionByName(out)
        return out

    def lines(self, include_empty: bool = True, ranked: bool = False) -> DataFrame:
        """(level, line) in the text form of the pattern sink; ``ranked`` adds ``ranks``, the items' support ranks, ascending."""
        sets = self.ranked() if ranked else self.itemsets()
        ranks = ["ranks"] if ranked else []
        out = sets.select(F.size("items").alias("level"), pattern_line(F.col("items"), F.col("support")).alias("line"), *ranks)
        if include_empty:
            row, schema = ((0, f"({self.n_tids})", []), "level int, line string, ranks array<int>") if ranked else ((0, f"({self.n_tids})"), "level int, line string")
            out = sets.sparkSession.createDataFrame([row], schema).unionByName(out)
        return out

    def ranked(self) -> DataFrame:
        """(items, support, ranks): depth-first order of the patterns is that of the level and then of ``ranks``."""
        sets = self.itemsets()
        if not self.levels:
            return sets.withColumn("ranks", F.col("items"))
        ranks = encode.item_rank(self.levels[0].select(F.element_at("items", 1).alias("item"), "support")).select("item", "rank")
        members = sets.select("items", "support", F.explode("items").alias("item")).join(ranks, "item")
        return members.groupBy("items").agg(F.first("support").alias("support"), F.array_sort(F.collect_list("rank")).alias("ranks"))

    def level_stats(self) -> DataFrame:
        return self.empty.sparkSession.createDataFrame(self.stats, schemas.LEVEL_STATS)


class FrequentItemsetMiner:
    """Mines all itemsets with at least ``min_sup`` transactions (an int, or a share in (0, 1]).

    ``strategy`` picks how sets of three or more items are counted; pairs always use the join on the transaction.
    ``auto`` compares, level by level, the item pairs in all baskets, which ``horizontal`` goes through, with the rows
    that ``arrow`` ANDs. ``max_len`` stops at that length, ``batch`` bounds the candidates that a task of ``arrow``
    holds, ``output`` is a folder for the patterns as text. Baskets are (tid, item) or (tid, items ARRAY).
    """

    def __init__(self, min_sup: int | float | str | Fraction, strategy: str = "auto", max_len: int | None = None, verbose: bool = False, batch: int = counting.BATCH, output: str | None = None):
        if strategy not in STRATEGIES:
            raise ValueError(f"strategy must be one of {STRATEGIES}")
        if isinstance(min_sup, int) and min_sup < 1:
            raise ValueError("min_sup must be 1 or more")
        if batch < 1:
            raise ValueError("batch must be 1 or more")
        self.min_sup, self.strategy, self.max_len, self.verbose, self.batch, self.output = min_sup, strategy, max_len, verbose, batch, output

    def mine(self, baskets: DataFrame) -> MiningResult:
        result = self._mine(baskets)
        if self.output:
            write_patterns(result.lines(ranked=True), self.output)
        return result

    def _picked(self, shape: counting.Profile, n_candidates: int) -> str:
        if self.strategy != "auto":
            return self.strategy
        ands = n_candidates * max(1, shape.n_tids // 32_768)
        return "horizontal" if shape.longest <= counting.LONG and shape.pairs < ands else "arrow"

    def _mine(self, baskets: DataFrame) -> MiningResult:
        baskets = staged(encode.from_arrays(baskets) if "items" in baskets.columns else encode.normalize(baskets), "baskets")
        empty = baskets.sparkSession.createDataFrame([], schemas.PATTERNS)
        n_tids = encode.transaction_count(baskets)
        if not n_tids:
            return MiningResult([], 0, 1 if not isinstance(self.min_sup, int) else self.min_sup, [], empty)
        min_sup = absolute_support(self.min_sup, n_tids)
        levels: list[DataFrame] = []
        stats: list[tuple] = []
        pruned, rows, shape, k = None, None, None, 0
        while self.max_len is None or k < self.max_len:
            k += 1
            t0 = time.perf_counter()
            candidates, n_candidates, n_nodes = None, None, None
            if k > 2:
                candidates = staged(subset_check(prefix_join(levels[-1]), levels[-1]), "candidates")
                n_candidates = candidates.count()
                if not n_candidates:
                    break
                n_nodes = node_count(candidates).first()[0] if self.verbose else None
            t1 = time.perf_counter()
            if k == 1:
                counted = encode.item_support(baskets).select(F.array("item").alias("items"), "support")
            elif k == 2:
                keep = levels[0].select(F.element_at("items", 1).alias("item"))
                pruned = staged(baskets.join(keep, "item", "left_semi"), "pruned")
                shape = counting.profile(pruned)
                counted = counting.pair_support(pruned, min_sup, shape.longest)
            elif (picked := self._picked(shape, n_candidates)) == "horizontal":
                counted = counting.count_horizontal(pruned, candidates)
            elif picked == "bitmap":
                counted = counting.count_bitmap(pruned, candidates)
            else:
                if rows is None:
                    made = counting.bit_rows(pruned.join(encode.dense_tids(pruned), "tid"), tid="tid_no") if shape.sparse else counting.bit_rows(pruned)
                    rows = staged(made, "rows")
                counted = counting.count_arrow(pruned, candidates, rows, self.batch)
            level = staged(counted.filter(F.col("support") >= min_sup).select(F.col("items").cast("array<int>").alias("items"), F.col("support").cast("long").alias("support")), "level")
            t2 = time.perf_counter()
            left = level.count()
            stats.append((k, n_candidates, n_nodes, left, t1 - t0, t2 - t1, time.perf_counter() - t2))
            if left:
                levels.append(level)
            if left <= k:  # a set of k + 1 items needs k + 1 frequent subsets
                break
        return MiningResult(levels, n_tids, min_sup, stats, empty)


def mine(baskets: DataFrame, min_sup: int | float | str | Fraction, **options) -> MiningResult:
    return FrequentItemsetMiner(min_sup, **options).mine(baskets)
