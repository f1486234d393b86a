"""Command line: ``python -m basketry mine`` and ``python -m basketry update``."""

from __future__ import annotations

import argparse
import sys
import time
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

from basketry.operators.counting import BATCH
from basketry.operators.encode import normalize
from basketry.plans.incremental import update_patterns
from basketry.plans.miner import STRATEGIES, FrequentItemsetMiner, MiningResult
from basketry.session import clear_staged, staged
from basketry.sources import fimi, patterns, vbitmap

FORMATS = ("fimi", "vbitmap", "parquet")


def support(text: str) -> int | Fraction:
    """``100`` is a number of transactions; ``0.01``, ``1/100`` and ``1%`` are shares."""
    try:
        if text.endswith("%"):
            return Fraction(text[:-1]) / 100
        return int(text) if text.isdigit() else Fraction(text)
    except (ValueError, ZeroDivisionError):
        raise argparse.ArgumentTypeError(f"{text!r} is neither a number of transactions nor a share") from None


def read_baskets(spark: SparkSession, path: str, form: str) -> DataFrame:
    """(tid, item) from basket text, vertical bitmap files or a Parquet table with these columns."""
    if form == "fimi":
        return fimi.read_fimi(spark, path)
    if form == "vbitmap":
        return vbitmap.to_baskets(vbitmap.read_vbitmap(spark, path))
    return normalize(spark.read.parquet(path))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="basketry", description="Frequent-itemset mining on Spark.")
    top.add_argument("--master", help="Spark master, where spark-submit sets none")
    commands = top.add_subparsers(dest="command", required=True)
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--format", choices=FORMATS, default="fimi", help="form of the baskets")
    common.add_argument("--min-sup", type=support, required=True, help="transactions (100) or a share (0.01, 1/100, 1%%)")
    common.add_argument("--output", required=True, help="folder for the patterns")
    mine = commands.add_parser("mine", parents=[common], help="all frequent itemsets of baskets")
    mine.add_argument("--data", required=True, nargs="+", help="baskets; several inputs must have different transaction numbers")
    mine.add_argument("--strategy", choices=STRATEGIES, default="auto")
    mine.add_argument("--batch", type=int, default=BATCH, help="candidates that a task holds at once")
    mine.add_argument("--max-len", type=int)
    mine.add_argument("--verbose", action="store_true", help="statistics of each level")
    update = commands.add_parser("update", parents=[common], help="patterns of old and new baskets together, from those of both parts")
    for side in ("old", "new"):
        update.add_argument(f"--{side}", required=True, help=f"{side} baskets")
        update.add_argument(f"--{side}-patterns", required=True, help=f"patterns of the {side} baskets at the same share")
    return top


def _mine(spark: SparkSession, args: argparse.Namespace) -> int:
    baskets = read_baskets(spark, args.data[0], args.format)
    for path in args.data[1:]:
        baskets = baskets.unionByName(read_baskets(spark, path, args.format))
    miner = FrequentItemsetMiner(args.min_sup, args.strategy, args.max_len, args.verbose, args.batch, args.output)
    result = miner.mine(baskets)
    if args.verbose:
        for row in result.level_stats().orderBy("level").collect():  # one row a level
            joined = f"{row.n_candidates} candidates, {row.n_nodes} nodes, " if row.n_candidates is not None else ""
            print(f"level {row.level}: {joined}{row.n_patterns} patterns, {row.generate_s + row.count_s:.2f} s")
    return result.total


def _update(spark: SparkSession, args: argparse.Namespace) -> int:
    old, new = (staged(read_baskets(spark, path, args.format), "baskets") for path in (args.old, args.new))
    l_old, l_new = (patterns.read_patterns(spark, path) for path in (args.old_patterns, args.new_patterns))
    merged = staged(update_patterns(l_old, l_new, old, new, args.min_sup), "merged")
    n_tids = old.select("tid").unionByName(new.select("tid")).distinct().count()
    result = MiningResult([merged], n_tids, 0, [], merged)
    patterns.write_patterns(result.lines(), args.output)
    return merged.count()


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    builder = SparkSession.builder.appName("basketry")
    spark = (builder.master(args.master) if args.master else builder).getOrCreate()
    began = time.perf_counter()
    try:
        total = {"mine": _mine, "update": _update}[args.command](spark, args)
    finally:
        clear_staged(spark)
    print(f"{total} patterns in {time.perf_counter() - began:.1f} s, written to {args.output}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
