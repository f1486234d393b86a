"""The queries of the engine on the driver tables, with the same results in SQL."""

from __future__ import annotations

import uuid
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions.itemsets import itemset_text
from basketry.functions.thresholds import absolute_support
from basketry.operators import candidates as cand
from basketry.operators import counting, encode, vector_and
from basketry.plans import incremental
from basketry.plans.miner import MiningResult, mine
from basketry.session import shared_dir, staged, table
from basketry.sources import fimi, patterns, vbitmap
from basketry.sources.keyed import KeyedStore

#: Relative supports, as fractions so that Spark and SQL agree to the unit.
ORDER_SUPP, ORDER_BRAND, CUST_BRAND, FUP = Fraction(1, 50_000), Fraction(27, 10000), Fraction(2, 5), Fraction(17, 1000)
DELTA = "2001-01-01"


def order_supp(spark: SparkSession, d: str) -> DataFrame:
    return encode.normalize(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey")


def _n_tids(spark: SparkSession, d: str) -> int:
    """One more than the highest transaction number of :func:`order_supp`, 0 without any."""
    last = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").dropna().agg(F.max("l_orderkey")).first()[0]
    return 0 if last is None else last + 1


def _brand(part: DataFrame) -> DataFrame:
    return part.select("p_partkey", F.regexp_extract("p_brand", "[0-9]+", 0).cast("int").alias("brand"))


def order_brand(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(_brand(table(spark, d, "part")), F.col("l_partkey") == F.col("p_partkey"))
    return encode.normalize(joined, "l_orderkey", "brand")


def cust_brand(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(_brand(table(spark, d, "part")), F.col("l_partkey") == F.col("p_partkey"))
    joined = lines.join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return encode.normalize(joined, "o_custkey", "brand")


def order_brand_parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    baskets = staged(order_brand(spark, d), "order_brand")
    orders = table(spark, d, "orders")
    new = baskets.join(orders.filter(F.col("o_orderdate") >= DELTA).select(F.col("o_orderkey").alias("tid")), "tid", "left_semi")
    old = baskets.join(orders.filter(F.col("o_orderdate") < DELTA).select(F.col("o_orderkey").alias("tid")), "tid", "left_semi")
    return old, new


def _threshold(baskets: DataFrame, share: Fraction) -> int:
    return absolute_support(share, max(1, encode.transaction_count(baskets)))


def _named(df: DataFrame, *more: str) -> DataFrame:
    return df.select(itemset_text(F.col("items")).alias("itemset"), *more)


def _level2(baskets: DataFrame, share: Fraction) -> tuple[DataFrame, DataFrame, int]:
    m = _threshold(baskets, share)
    keep = baskets.join(encode.frequent_items(baskets, m), "item", "left_semi")
    return keep, counting.pair_support(keep, m), m


def q01(spark, d):
    return encode.item_support(order_supp(spark, d))


def q02(spark, d):
    b = order_supp(spark, d)
    return encode.frequent_items(b, _threshold(b, Fraction(4, 1000)))


def q03(spark, d):
    return encode.item_rank(encode.item_support(order_supp(spark, d)))


def q04(spark, d):
    return encode.vertical_words(order_supp(spark, d))


def q05(spark, d):
    lines = encode.normalize(table(spark, d, "lineitem"), "l_orderkey", "l_partkey")
    return encode.vertical_reserve(lines, table(spark, d, "part").select(F.col("p_partkey").alias("item")))


def q06(spark, d):
    return vector_and.popcount_by_item(encode.vertical_words(order_supp(spark, d)))


def q07(spark, d):
    return vector_and.and_pair(encode.vertical_words(order_supp(spark, d)), 1, 2)


def q08(spark, d):
    _, pairs, _ = _level2(order_supp(spark, d), ORDER_SUPP)
    return _named(pairs, "support")


def q09(spark, d):
    _, pairs, _ = _level2(order_brand(spark, d), Fraction(3, 200))
    return _named(cand.prefix_join(pairs))


def q10(spark, d):
    _, pairs, _ = _level2(order_brand(spark, d), Fraction(3, 200))
    pairs = staged(pairs, "pairs")
    return _named(cand.subset_check(cand.prefix_join(pairs), pairs))


def q11(spark, d):
    _, pairs, _ = _level2(order_brand(spark, d), Fraction(3, 200))
    pairs = staged(pairs, "pairs")
    return _named(cand.dead_ends(pairs, cand.prefix_join(pairs)), "support")


def _level3(spark, d):
    keep, pairs, m = _level2(staged(order_brand(spark, d), "order_brand"), ORDER_BRAND)
    pairs = staged(pairs, "pairs")
    triples = staged(cand.subset_check(cand.prefix_join(pairs), pairs), "triples")
    return keep, triples, m


def q12(spark, d):
    keep, triples, m = _level3(spark, d)
    return _named(counting.count_horizontal(keep, triples).filter(F.col("support") >= m), "support")


def q12_bitmap(spark, d):
    keep, triples, m = _level3(spark, d)
    return _named(counting.count_bitmap(keep, triples).filter(F.col("support") >= m), "support")


def q12_arrow(spark, d):
    keep, triples, m = _level3(spark, d)
    return _named(counting.count_arrow(keep, triples).filter(F.col("support") >= m), "support")


def q13(spark, d):
    keep, triples, m = _level3(spark, d)
    return _named(counting.supports_in(keep, triples).filter(F.col("support") < m), "support")


def _mined(spark, d) -> MiningResult:
    return mine(cust_brand(spark, d), CUST_BRAND)


def q14(spark, d):
    return _mined(spark, d).patterns()


def q15(spark, d):
    return _mined(spark, d).level_stats().filter("n_patterns > 0").select("level", "n_patterns")


def q16(spark, d):
    return mine(cust_brand(spark, d), Fraction(3, 5)).lines()


def q17(spark, d):
    rows = vector_and.bounded_parents([1, 3, 7], [2, 3, 1], [2, 5, 4, 6, 8, 9])
    return vector_and.children_support(order_supp(spark, d), spark.createDataFrame(rows, "parent int, children array<int>"))


def _fup(spark, d):
    old, new = order_brand_parts(spark, d)
    return mine(old, FUP).itemsets(), mine(new, FUP).itemsets(), old, new


def q18(spark, d):
    l_old, l_new, old, _ = _fup(spark, d)
    return _named(incremental.only_in_new(l_old, l_new, old), "support_new", "support_old")


def q18b(spark, d):
    l_old, l_new, _, new = _fup(spark, d)
    return _named(incremental.only_in_old(l_old, l_new, new), "support_old", "support_new")


def q19(spark, d):
    l_old, l_new, old, new = _fup(spark, d)
    merged = incremental.update_patterns(l_old, l_new, old, new, FUP)
    return merged.select(F.size("items").alias("level"), itemset_text(F.col("items")).alias("itemset"), "support")


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def q20(spark, d):
    """Write vertical files from the executors, read them back, and give the supports found in them."""
    path = _folder(spark, "order_supp")
    vbitmap.write_vbitmaps(encode.vertical_words(order_supp(spark, d)), _n_tids(spark, d), path, packed=True)
    return spark.read.format("vbitmap").schema("item int, support long").load(path)


def q21(spark, d):
    keep, triples, _ = _level3(spark, d)
    return cand.node_count(triples)


def q22(spark, d):
    """Pattern lines numbered in the order of the sink: by level, then depth-first by support rank."""
    lines = mine(cust_brand(spark, d), Fraction(3, 5)).lines(ranked=True)
    return encode.numbered(lines, [F.col("level"), F.col("ranks")], "seq").select("seq", "line")


def q23(spark, d):
    """Baskets as text, read back: the brands of each line."""
    path = _folder(spark, "baskets")
    fimi.write_fimi(cust_brand(spark, d), path)
    return encode.item_support(fimi.read_fimi(spark, path))


def q24(spark, d):
    """Patterns as text, read back as a prior result."""
    path = _folder(spark, "patterns")
    mine(cust_brand(spark, d), Fraction(3, 5), output=path)
    return _named(patterns.read_patterns(spark, path), "support")


def _segments(spark, d) -> tuple[DataFrame, DataFrame]:
    words = encode.vertical_words(order_supp(spark, d)).select(F.col("item").alias("seg"), "word_idx", "word")
    both = words.select(F.lit("l").alias("side"), "*").unionByName(words.select(F.lit("r").alias("side"), "*"))
    rows = [(p, k, c) for p, held in vector_and.bounded_parents([1, 3, 7], [2, 3, 1], [2, 5, 4, 6, 8, 9]) for k, c in enumerate(held)]
    return both, spark.createDataFrame(rows, "parent int, pos int, child int")


def q25(spark, d):
    return vector_and.segmented_and(*_segments(spark, d))


def q26(spark, d):
    return vector_and.segmented_and(*_segments(spark, d), store=False)


def q27(spark, d):
    arrays = vector_and.word_arrays(encode.vertical_words(order_supp(spark, d)), _n_tids(spark, d))
    return vector_and.array_and(arrays, 1, 2).select("support", F.size("words").cast("long").alias("n_words"))


def q28(spark, d):
    """Not made distinct before, as bits are."""
    return _named(counting.pair_support_bitmap(encode.cleaned(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey")), "support")


def q29(spark, d):
    return _mined(spark, d).level_stats().filter("n_candidates is not null").select("level", "n_candidates")


def q30(spark, d):
    """Mined over ranks in place of item ids, and decoded."""
    b = staged(cust_brand(spark, d), "cust_brand")
    ranks = staged(encode.item_rank(encode.item_support(b)), "ranks")
    return _named(encode.decode(mine(encode.recode(b, ranks), Fraction(3, 5)).itemsets(), ranks), "support")


def q31(spark, d):
    _, triples, _ = _level3(spark, d)
    return cand.nodes_at(triples, 2)


def q32(spark, d):
    """Vectors of pairs kept by one batch, ANDed with further items by the next."""
    words = staged(encode.vertical_words(order_supp(spark, d)), "words")
    kept = vector_and.bounded_and(words, [1, 3], [2, 1], [2, 5, 4], store=True)
    return vector_and.bounded_and(words, [0, 2], [2, 1], [7, 9, 8], stored=staged(kept, "kept"), begin=0)


def q33(spark, d):
    """Customers put into a keyed store, and those with orders of the highest priority read from it."""
    store = KeyedStore(_folder(spark, "customers"), "c_custkey", 8)
    store.write(table(spark, d, "customer").select("c_custkey", "c_nationkey"))
    wanted = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return store.read(wanted)


def q34(spark, d):
    """One AND with its count."""
    _, ones = vector_and.vector_and(encode.vertical_words(order_supp(spark, d)), 1, 2, store=False)
    return spark.createDataFrame([(ones,)], "support long")


ITEMSETS = {
    "q01_item_support": q01, "q02_frequent_items": q02, "q03_item_rank": q03, "q04_vertical_words": q04,
    "q05_vertical_reserve": q05, "q06_word_popcount": q06, "q07_and_pair_words": q07, "q08_pairwise_support": q08,
    "q09_candidates_k3_raw": q09, "q10_candidates_k3_checked": q10, "q11_dead_ends_k2": q11, "q12_frequent_k3": q12,
    "q12b_frequent_k3_bitmap": q12_bitmap, "q12c_frequent_k3_arrow": q12_arrow, "q13_rejected_candidates_k3": q13,
    "q14_mine_full_cust_brand": q14, "q15_level_stats": q15, "q16_pattern_lines": q16,
    "q17_batched_children_support": q17, "q18_fup_counts_new_in_old": q18, "q18b_fup_counts_old_in_new": q18b,
    "q19_fup_merged": q19, "q20_vbitmap_roundtrip": q20, "q21_tree_nodes_k3": q21,
    "q22_pattern_order": q22, "q23_basket_text": q23, "q24_prior_patterns": q24, "q25_segmented_and_words": q25,
    "q26_segmented_and_counts": q26, "q27_array_and": q27, "q28_pairs_bitmap": q28, "q29_candidates_per_level": q29,
    "q30_recoded_mining": q30, "q31_tree_nodes_level2": q31, "q32_stored_and": q32, "q33_keyed_store": q33, "q34_counted_and": q34,
}

# ---------------------------------------------------------------- the same in SQL

_SUPP = "b AS (SELECT DISTINCT l_orderkey AS tid, CAST(l_suppkey AS INTEGER) AS item FROM lineitem)"
_BRANDS = "pb AS (SELECT p_partkey, CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER) AS brand FROM part)"
_BRAND = f"{_BRANDS}, b AS (SELECT DISTINCT l_orderkey AS tid, brand AS item FROM lineitem JOIN pb ON l_partkey = p_partkey)"
_CUST = f"{_BRANDS}, b AS (SELECT DISTINCT o_custkey AS tid, brand AS item FROM lineitem JOIN pb ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"
_COUNT = "c AS (SELECT count(DISTINCT tid) AS n FROM b)"


def _at_least(share: Fraction, value: str = "count(*)", n: str = "(SELECT n FROM c)") -> str:
    return f"{value} * {share.denominator} >= {share.numerator} * {n}"


def _joined(k: int, b: str = "b") -> str:
    return f"FROM {b} b1 " + " ".join(f"JOIN {b} b{i} ON b{i}.tid = b1.tid AND b{i}.item > b{i - 1}.item" for i in range(2, k + 1))


def _names(k: int) -> str:
    return " || ' ' || ".join(f"CAST(b{i}.item AS VARCHAR)" for i in range(1, k + 1))


def _sets(k: int, share: Fraction, b: str = "b", n: str = "(SELECT n FROM c)") -> str:
    group = ", ".join(f"b{i}.item" for i in range(1, k + 1))
    return f"SELECT {k} AS level, {_names(k)} AS itemset, count(*) AS support {_joined(k, b)} GROUP BY {group} HAVING {_at_least(share, n=n)}"


def _mining(share: Fraction, levels: int, b: str = "b", n: str = "(SELECT n FROM c)") -> str:
    return " UNION ALL ".join(_sets(k, share, b, n) for k in range(1, levels + 1))


_L2 = "l2 AS (SELECT b1.item AS i, b2.item AS j, count(*) AS support " + _joined(2) + " GROUP BY 1, 2 HAVING {})"
_C3 = "c3 AS (SELECT x.i, x.j, y.j AS k FROM l2 x JOIN l2 y ON x.i = y.i AND x.j < y.j)"
_C3OK = "ok AS (SELECT c3.* FROM c3 WHERE EXISTS (SELECT 1 FROM l2 WHERE l2.i = c3.j AND l2.j = c3.k))"
_ISET3 = "CAST(i AS VARCHAR) || ' ' || CAST(j AS VARCHAR) || ' ' || CAST(k AS VARCHAR) AS itemset"


def _pairs(share: Fraction, b: str = _BRAND) -> str:
    return f"WITH {b}, {_COUNT}, {_L2.format(_at_least(share))}"


_THREE = f"{_pairs(ORDER_BRAND)}, {_C3}, {_C3OK}"
_S3 = f"s3 AS (SELECT b1.item AS i, b2.item AS j, b3.item AS k, count(*) AS support {_joined(3)} GROUP BY 1, 2, 3)"
_FREQ3 = f"WITH {_BRAND}, {_COUNT} SELECT itemset, support FROM ({_sets(3, ORDER_BRAND)})"
_PARTS = (
    f"WITH {_BRAND}, old AS (SELECT b.* FROM b JOIN orders ON tid = o_orderkey WHERE o_orderdate < DATE '{DELTA}'), "
    f"new AS (SELECT b.* FROM b JOIN orders ON tid = o_orderkey WHERE o_orderdate >= DATE '{DELTA}')"
)


def _counts_of(b: str) -> str:
    return " UNION ALL ".join(f"SELECT {_names(k)} AS itemset, count(*) AS support {_joined(k, b)} GROUP BY {', '.join(f'b{i}.item' for i in range(1, k + 1))}" for k in (1, 2, 3))


def _one_sided(here: str, there: str) -> str:
    n_here, n_there = (f"(SELECT count(DISTINCT tid) FROM {b})" for b in (here, there))
    return (
        f"{_PARTS}, h AS ({_counts_of(here)}), t AS ({_counts_of(there)}) "
        f"SELECT h.itemset, h.support AS support_{here}, coalesce(t.support, 0) AS support_{there} FROM h LEFT JOIN t USING (itemset) "
        f"WHERE {_at_least(FUP, 'h.support', n_here)} AND NOT ({_at_least(FUP, 'coalesce(t.support, 0)', n_there)})"
    )


_SEGMENTS = (
    f"WITH {_SUPP}, w AS (SELECT item, tid // 16 AS word_idx, CAST(sum(1 << CAST(tid % 16 AS INTEGER)) AS BIGINT) AS word FROM b GROUP BY 1, 2), "
    "p(parent, pos, child) AS (VALUES (1, 0, 2), (1, 1, 5), (3, 0, 4), (3, 1, 6), (3, 2, 8), (7, 0, 9)) SELECT parent, pos, child, x.word_idx"
)
_SEGMENT_JOIN = "FROM p JOIN w x ON x.item = parent JOIN w y ON y.item = child AND y.word_idx = x.word_idx"
#: Candidates of three to five items: sets whose subsets of one item less are all frequent.
_CANDIDATES = (
    f"m AS ({_mining(CUST_BRAND, 5)}), f AS (SELECT level, [CAST(i AS INTEGER) FOR i IN string_split(itemset, ' ')] AS s FROM m), "
    "j AS (SELECT x.level + 1 AS level, list_append(x.s, y.s[-1]) AS s FROM f x JOIN f y ON x.level = y.level AND x.level > 1 AND x.s[:-2] = y.s[:-2] AND x.s[-1] < y.s[-1]), "
    "e AS (SELECT level, s, unnest(range(1, level - 1)) AS p FROM j), "
    "g AS (SELECT e.level, e.s FROM e JOIN f ON f.level = e.level - 1 AND f.s = list_concat(e.s[:p - 1], e.s[p + 1:]) GROUP BY 1, 2 HAVING count(*) = e.level - 2) "
    "SELECT level, count(*) AS n_candidates FROM g GROUP BY level"
)

ITEMSETS_SQL = {
    "q01_item_support": f"WITH {_SUPP} SELECT item, count(*) AS support FROM b GROUP BY item",
    "q02_frequent_items": f"WITH {_SUPP}, {_COUNT} SELECT item, count(*) AS support FROM b GROUP BY item HAVING {_at_least(Fraction(4, 1000))}",
    "q03_item_rank": f"WITH {_SUPP}, s AS (SELECT item, count(*) AS support FROM b GROUP BY item) SELECT CAST(row_number() OVER (ORDER BY support DESC, item) - 1 AS INTEGER) AS rank, item, support FROM s",
    "q04_vertical_words": f"WITH {_SUPP} SELECT item, tid // 16 AS word_idx, CAST(sum(1 << CAST(tid % 16 AS INTEGER)) AS BIGINT) AS word FROM b GROUP BY 1, 2",
    "q05_vertical_reserve": "WITH b AS (SELECT DISTINCT l_orderkey AS tid, CAST(l_partkey AS INTEGER) AS item FROM lineitem), s AS (SELECT item, count(*) AS support FROM b GROUP BY item) SELECT CAST(p_partkey AS INTEGER) AS item, coalesce(support, 0) AS support FROM part LEFT JOIN s ON p_partkey = item",
    "q06_word_popcount": f"WITH {_SUPP}, w AS (SELECT item, tid // 16 AS i, sum(1 << CAST(tid % 16 AS INTEGER)) AS word FROM b GROUP BY 1, 2) SELECT item, CAST(sum(bit_count(CAST(word AS BIGINT))) AS BIGINT) AS support FROM w GROUP BY item",
    "q07_and_pair_words": f"WITH {_SUPP}, w AS (SELECT item, tid // 16 AS word_idx, CAST(sum(1 << CAST(tid % 16 AS INTEGER)) AS BIGINT) AS word FROM b GROUP BY 1, 2) SELECT x.word_idx, x.word & y.word AS word FROM w x JOIN w y USING (word_idx) WHERE x.item = 1 AND y.item = 2 AND x.word & y.word <> 0",
    "q08_pairwise_support": f"WITH {_SUPP}, {_COUNT} SELECT itemset, support FROM ({_sets(2, ORDER_SUPP)})",
    "q09_candidates_k3_raw": f"{_pairs(Fraction(3, 200))}, {_C3} SELECT {_ISET3} FROM c3",
    "q10_candidates_k3_checked": f"{_pairs(Fraction(3, 200))}, {_C3}, {_C3OK} SELECT {_ISET3} FROM ok",
    "q11_dead_ends_k2": f"{_pairs(Fraction(3, 200))}, {_C3} SELECT CAST(i AS VARCHAR) || ' ' || CAST(j AS VARCHAR) AS itemset, support FROM l2 WHERE NOT EXISTS (SELECT 1 FROM c3 WHERE c3.i = l2.i AND c3.j = l2.j)",
    "q12_frequent_k3": _FREQ3,
    "q12b_frequent_k3_bitmap": _FREQ3,
    "q12c_frequent_k3_arrow": _FREQ3,
    "q13_rejected_candidates_k3": f"{_THREE}, {_S3} SELECT {_ISET3}, coalesce(support, 0) AS support FROM ok LEFT JOIN s3 USING (i, j, k) WHERE NOT ({_at_least(ORDER_BRAND, 'coalesce(support, 0)')})",
    "q14_mine_full_cust_brand": f"WITH {_CUST}, {_COUNT} {_mining(CUST_BRAND, 5)}",
    "q15_level_stats": f"WITH {_CUST}, {_COUNT} SELECT level, count(*) AS n_patterns FROM ({_mining(CUST_BRAND, 5)}) GROUP BY level",
    "q16_pattern_lines": f"WITH {_CUST}, {_COUNT} SELECT level, itemset || ' (' || CAST(support AS VARCHAR) || ')' AS line FROM ({_mining(Fraction(3, 5), 4)}) UNION ALL SELECT 0, '(' || CAST(n AS VARCHAR) || ')' FROM c",
    "q17_batched_children_support": f"WITH {_SUPP}, p(parent, child) AS (VALUES (1, 2), (1, 5), (3, 4), (3, 6), (3, 8), (7, 9)) SELECT parent, child, (SELECT count(*) FROM b x JOIN b y USING (tid) WHERE x.item = parent AND y.item = child) AS support FROM p",
    "q18_fup_counts_new_in_old": _one_sided("new", "old"),
    "q18b_fup_counts_old_in_new": _one_sided("old", "new"),
    "q19_fup_merged": f"WITH {_BRAND}, {_COUNT} {_mining(FUP, 3)}",
    "q20_vbitmap_roundtrip": f"WITH {_SUPP} SELECT item, count(*) AS support FROM b GROUP BY item",
    "q21_tree_nodes_k3": f"{_THREE} SELECT (SELECT count(DISTINCT i) FROM ok) + (SELECT count(*) FROM (SELECT DISTINCT i, j FROM ok)) + (SELECT count(*) FROM ok) AS n_nodes",
    "q22_pattern_order": f"WITH {_CUST}, {_COUNT}, r AS (SELECT item, row_number() OVER (ORDER BY count(*) DESC, item) - 1 AS rank FROM b GROUP BY item HAVING {_at_least(Fraction(3, 5))}), "
    f"m AS ({_mining(Fraction(3, 5), 4)}), o AS (SELECT level, itemset, support, list_sort(list(rank)) AS ranks FROM (SELECT level, itemset, support, unnest(string_split(itemset, ' ')) AS i FROM m) JOIN r ON CAST(i AS INTEGER) = r.item GROUP BY 1, 2, 3), "
    "a AS (SELECT level, itemset || ' (' || CAST(support AS VARCHAR) || ')' AS line, ranks FROM o UNION ALL SELECT 0, '(' || CAST(n AS VARCHAR) || ')', [] FROM c) "
    "SELECT row_number() OVER (ORDER BY level, ranks) - 1 AS seq, line FROM a",
    "q23_basket_text": f"WITH {_CUST} SELECT item, count(*) AS support FROM b GROUP BY item",
    "q24_prior_patterns": f"WITH {_CUST}, {_COUNT} SELECT itemset, support FROM ({_mining(Fraction(3, 5), 4)})",
    "q25_segmented_and_words": f"{_SEGMENTS}, x.word & y.word AS word {_SEGMENT_JOIN}",
    "q26_segmented_and_counts": f"{_SEGMENTS}, CAST(bit_count(x.word & y.word) AS INTEGER) AS ones {_SEGMENT_JOIN}",
    "q27_array_and": f"WITH {_SUPP} SELECT (SELECT count(*) FROM b x JOIN b y USING (tid) WHERE x.item = 1 AND y.item = 2) AS support, max(tid) // 16 + 1 AS n_words FROM b",
    "q28_pairs_bitmap": f"WITH {_SUPP} SELECT itemset, support FROM ({_sets(2, Fraction(1), n='1')})",
    "q29_candidates_per_level": f"WITH {_CUST}, {_COUNT}, {_CANDIDATES}",
    "q30_recoded_mining": f"WITH {_CUST}, {_COUNT} SELECT itemset, support FROM ({_mining(Fraction(3, 5), 4)})",
    "q31_tree_nodes_level2": f"{_THREE} SELECT count(*) AS n_nodes FROM (SELECT DISTINCT i, j FROM ok)",
    "q32_stored_and": f"WITH {_SUPP}, p(parent, pos, child, i, j) AS (VALUES (0, 0, 7, 1, 2), (0, 1, 9, 1, 2), (2, 0, 8, 3, 4)) SELECT parent, pos, child, (SELECT count(*) FROM b x JOIN b y USING (tid) JOIN b z USING (tid) WHERE x.item = i AND y.item = j AND z.item = child) AS support FROM p",
    "q33_keyed_store": "SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "q34_counted_and": f"WITH {_SUPP} SELECT count(*) AS support FROM b x JOIN b y USING (tid) WHERE x.item = 1 AND y.item = 2",
}
