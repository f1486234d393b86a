"""Frequent-itemset mining on Spark DataFrames."""

from basketry.plans.incremental import update_patterns
from basketry.plans.miner import FrequentItemsetMiner, MiningResult, mine

__all__ = ["FrequentItemsetMiner", "MiningResult", "mine", "update_patterns"]
