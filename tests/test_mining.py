"""Golden baskets, bit-vector fixtures, file formats, incremental and streaming updates, and edge cases of mining."""

import time
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from basketry import session
from basketry.__main__ import main, support
from basketry.functions.generate import random_matrix
from basketry.functions.thresholds import absolute_support, check_lossless
from basketry.operators import counting, encode, vector_and
from basketry.plans.incremental import update_patterns
from basketry.plans.miner import mine
from basketry.sources import files, fimi, patterns, vbitmap
from basketry.sources.keyed import KeyedStore
from basketry.streaming.increments import PatternMaintainer

DB = [{1, 2, 5}, {2, 4}, {2, 3}, {1, 2, 4}, {1, 3}, {2, 3}, {1, 3}, {1, 2, 3, 5}, {1, 2, 3}]
MORE = [{4, 5}, {4, 5}, {1, 4, 5}, {2}, {2, 4}]
GOLDEN = {(1,): 6, (2,): 7, (3,): 6, (4,): 2, (5,): 2, (1, 2): 4, (1, 3): 4, (1, 5): 2, (2, 3): 4, (2, 4): 2, (2, 5): 2, (1, 2, 3): 2, (1, 2, 5): 2}
MERGED = {(1,): 7, (2,): 9, (3,): 6, (4,): 6, (5,): 5, (1, 2): 4, (1, 3): 4, (2, 3): 4}


def frame(spark, baskets, first=0):
    return spark.createDataFrame([(t, i) for t, b in enumerate(baskets, first) for i in sorted(b)], "tid long, item int")


def found(sets):
    return {tuple(r["items"]): r["support"] for r in sets.collect()}


def brute(baskets, min_sup):
    items, out, k = sorted(set().union(*baskets)), {}, 1
    while True:
        level = {c: n for c in combinations(items, k) if (n := sum(set(c) <= b for b in baskets)) >= min_sup}
        if not level:
            return out
        out, k = out | level, k + 1


@pytest.mark.parametrize("strategy", ["horizontal", "bitmap", "arrow"])
def test_golden_baskets(spark, strategy):
    result = mine(frame(spark, DB), 2, strategy=strategy, verbose=True)
    assert found(result.itemsets()) == GOLDEN == brute(DB, 2)
    assert (result.total, result.n_tids, result.stats[-1][0]) == (13, 9, 3)
    assert {r["line"] for r in result.lines().filter("level in (0, 3)").collect()} == {"(9)", "1 2 3 (2)", "1 2 5 (2)"}


@pytest.mark.parametrize("strategy", ["horizontal", "bitmap", "arrow"])
def test_random_baskets(spark, strategy):
    rng = np.random.default_rng(5)
    baskets = [set(rng.choice(9, rng.integers(1, 7), replace=False).tolist()) for _ in range(120)]
    assert found(mine(frame(spark, baskets), 12, strategy=strategy).itemsets()) == brute(baskets, 12)


def test_edges(spark):
    assert mine(frame(spark, DB), 10).total == 0
    assert mine(spark.createDataFrame([], "tid long, item int"), 0.5).itemsets().count() == 0
    assert found(mine(frame(spark, [{7}, {7}]), 2).itemsets()) == {(7,): 2}
    twice = spark.createDataFrame([(0, 1), (0, 1), (1, 1), (None, 1), (2, None)], "tid long, item int")
    assert found(mine(twice, 1).itemsets()) == {(1,): 2}
    assert found(mine(frame(spark, [{1, 2, 3}] * 4), 1.0).itemsets()) == brute([{1, 2, 3}] * 4, 4)
    assert found(mine(frame(spark, DB), 2, max_len=2).itemsets()) == {k: v for k, v in GOLDEN.items() if len(k) < 3}
    with pytest.raises(ValueError):
        mine(frame(spark, DB), 0)


@pytest.mark.parametrize("n", [32_768, 32_769])
def test_bucket_boundary(spark, n):
    """Item 4 is absent from the first bucket of a bitmap."""
    baskets = spark.sql(f"SELECT id AS tid, explode(IF(id >= 32768, array(1, 2, 3, 4), array(1, 2, 3))) AS item FROM range({n})")
    got = {s: found(mine(baskets, 1, strategy=s).itemsets()) for s in ("bitmap", "arrow", "horizontal")}
    assert got["bitmap"] == got["arrow"] == got["horizontal"]
    assert got["arrow"][1, 2, 3] == n and got["arrow"].get((1, 2, 3, 4), 0) == n - 32_768


def test_thresholds():
    assert [absolute_support(0.4, 10), absolute_support("1/3", 9), absolute_support(1, 9)] == [4, 3, 1]
    with pytest.raises(ValueError):
        check_lossless(5, 5, 8)


def words_frame(spark, sides):
    rows = [(side, seg, k, w) for side, segs in sides.items() for seg, words in enumerate(segs) for k, w in enumerate(words)]
    return spark.createDataFrame(rows, "side string, seg int, word_idx int, word int")


def test_single_vector_and(spark):
    words = words_frame(spark, {"l": [[2047, 65024]], "r": [[65343, 32768], [0, 0], [65528, 256]]})
    pairs = spark.createDataFrame([(0, 0, 0), (0, 1, 2)], "parent int, pos int, child int")
    got = {(r["child"], r["word_idx"]): r["ones"] for r in vector_and.segmented_and(words, pairs, store=False).collect()}
    assert got == {(0, 0): 9, (0, 1): 1, (2, 0): 8, (2, 1): 0}


def test_batched_vector_and(spark):
    words = words_frame(spark, {"l": [[24, 56], [78, 97], [102, 562]], "r": [[1, 2], [3, 4], [5, 6], [7, 8]]})
    rows = [(p, k, c) for p, children in vector_and.bounded_parents([0, 2], [2, 3], [0, 3, 1, 2, 3]) for k, c in enumerate(children)]
    got = vector_and.segmented_and(words, spark.createDataFrame(rows, "parent int, pos int, child int"))
    assert {(r["parent"], r["child"], r["word_idx"]): r["word"] for r in got.collect()} == {
        (0, 0, 0): 0, (0, 0, 1): 0, (0, 3, 0): 0, (0, 3, 1): 8, (2, 1, 0): 2, (2, 1, 1): 0, (2, 2, 0): 4, (2, 2, 1): 2, (2, 3, 0): 6, (2, 3, 1): 0,
    }
    with pytest.raises(ValueError):
        vector_and.bounded_parents([0], [2], [1])


def test_vertical_words(spark):
    words = {r["item"]: r["word"] for r in encode.vertical_words(frame(spark, DB)).collect()}
    assert words == {1: 0x1D9, 2: 0x1AF, 3: 0x1F4, 4: 0x00A, 5: 0x081}


def test_basket_text(spark, tmp_path):
    (tmp_path / "in.txt").write_text("1 2 5\n2  4 2\n\n3 \n")
    path = str(tmp_path / "in.txt")
    assert {(r["tid"], r["item"]) for r in fimi.read_fimi(spark, path).collect()} == {(0, 1), (0, 2), (0, 5), (1, 2), (1, 4), (3, 3)}
    fimi.write_fimi(frame(spark, DB), str(tmp_path / "out"))
    assert {(r["tid"], r["item"]) for r in fimi.read_fimi(spark, str(tmp_path / "out")).collect()} == {(t, i) for t, b in enumerate(DB) for i in b}


def test_pattern_text(spark, tmp_path):
    result, path = mine(frame(spark, DB), 2), str(tmp_path / "patterns")
    patterns.write_patterns(result.lines(), path)
    assert found(patterns.read_patterns(spark, path)) == GOLDEN
    assert patterns.read_transaction_count(spark, path) == 9
    many = spark.createDataFrame([(1, f"{i} (3)") for i in (10, 9, 2, 100)] + [(2, "10 11 (2)"), (2, "2 30 (2)"), (0, "(5)")], "level int, line string")
    patterns.write_patterns(many, path)
    written = sorted((tmp_path / "patterns").glob("part-*"))
    assert [x for f in written for x in f.read_text().splitlines()] == ["(5)", "2 (3)", "9 (3)", "10 (3)", "100 (3)", "2 30 (2)", "10 11 (2)"]


@pytest.mark.parametrize("width", [4, 8])
@pytest.mark.parametrize("n", [1, 15, 16, 17])
def test_vertical_file(spark, tmp_path, width, n):
    baskets = [{1, 2} if t % 3 else {2} for t in range(n)]
    catalog = spark.createDataFrame([(1,), (2,), (9,)], "item int")
    path = str(tmp_path / "v.bin")
    assert vbitmap.write_vbitmap(encode.vertical_words(frame(spark, baskets)), n, path, catalog, width) == 3
    spark.dataSource.register(vbitmap.VBitmapDataSource)
    by_source, by_file = spark.read.format("vbitmap").load(path), vbitmap.read_vbitmap(spark, path)
    want = {1: sum(1 in b for b in baskets), 2: n, 9: 0}
    for vertical in (by_source, by_file):
        assert {r["item"]: r["support"] for r in vertical.collect()} == want
        assert {(r["tid"], r["item"]) for r in vbitmap.to_baskets(vertical).collect()} == {(t, i) for t, b in enumerate(baskets) for i in b}
    assert vbitmap.lookup(by_file, 2).count() == 1
    with pytest.raises(ValueError):
        vbitmap.parse_header(b"\1" * 16, 17)


def test_incremental_update(spark):
    old, new = frame(spark, DB), frame(spark, MORE, len(DB))
    l_old, l_new = mine(old, 0.25).itemsets(), mine(new, 0.25).itemsets()
    assert found(l_new) == {(2,): 2, (4,): 4, (5,): 3, (4, 5): 3}
    assert found(update_patterns(l_old, l_new, old, new, 0.25)) == MERGED == found(mine(old.union(new), 0.25).itemsets())
    with pytest.raises(ValueError):
        update_patterns(l_old, l_new, old, new, 4)


def test_stream_of_increments(spark, tmp_path):
    """Patterns after each micro-batch are those of all baskets so far, a replayed batch changes nothing."""
    source, keeper = tmp_path / "source", PatternMaintainer(str(tmp_path / "state"), 0.25)

    def drain():
        stream = spark.readStream.schema("tid long, item int").parquet(str(source)).writeStream.foreachBatch(keeper)
        query = stream.option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
        query.awaitTermination(120)

    frame(spark, DB).coalesce(1).write.parquet(str(source))
    drain()
    frame(spark, MORE, len(DB)).coalesce(1).write.mode("append").parquet(str(source))
    drain()
    assert found(keeper.patterns(spark, 1)) == MERGED
    keeper(frame(spark, MORE, len(DB)), 1)
    assert found(keeper.patterns(spark, 1)) == MERGED


@pytest.mark.parametrize("batch", [1, 3, 1000])
def test_blocks_of_candidates(spark, batch):
    """Sets of several lengths, some in no basket, whatever the size of a block."""
    sets = [[1], [5], [1, 2], [2, 5], [4, 5], [1, 2, 3], [1, 2, 5], [1, 2, 3, 5], [9], [1, 9]]
    wanted = spark.createDataFrame([(s,) for s in sets], "items array<int>")
    want = {tuple(s): n for s in sets if (n := sum(set(s) <= b for b in DB))}
    assert found(counting.count_arrow(frame(spark, DB), wanted, batch=batch)) == want
    assert found(mine(frame(spark, DB), 2, strategy="arrow", batch=batch).itemsets()) == GOLDEN


def test_long_baskets(spark, monkeypatch):
    """Baskets over the bound are split for the pair join and give the same pairs."""
    whole = found(counting.pair_support(frame(spark, DB)))
    monkeypatch.setattr(counting, "LONG", 2)
    assert found(counting.pair_support(frame(spark, DB))) == whole == found(counting.pair_support_bitmap(frame(spark, DB)))
    assert found(mine(frame(spark, DB), 2).itemsets()) == GOLDEN


@pytest.mark.parametrize("part", [40, 1_024])
def test_bitmap_pairs_meet_within_stripes(spark, monkeypatch, part):
    """6,000 items in 60 groups that share no stripe: pairs across groups are never made."""
    monkeypatch.setattr(counting, "PART", part, raising=False)
    rng, far = np.random.default_rng(3), []
    for g in range(60):
        far += [(g * 65_536 + t * 500, {int(g * 100 + i) for i in rng.choice(100, rng.integers(1, 6), replace=False)}) for t in range(100)]
    want = Counter(p for _, b in far for p in combinations(sorted(b), 2))
    baskets = session.staged(spark.createDataFrame([(t, i) for t, b in far for i in b], "tid long, item int"))
    began = time.monotonic()
    got = found(counting.pair_support_bitmap(baskets))
    assert time.monotonic() - began < 30 and got == want
    assert found(counting.pair_support_bitmap(baskets, 2)) == {p: n for p, n in want.items() if n > 1}
    assert counting.pair_support_bitmap(baskets.limit(0)).count() == 0


def test_bitmap_pairs_travel_packed(spark):
    """A row for an item of a stripe and each block of its mates, not for each pair; ids of any sign, in several stripes."""
    rng, ids = np.random.default_rng(5), [-(2**31), -65_537, -65_536, -1, 0, 1, 65_535, 65_536, 2**31 - 1, *range(100, 140)]
    db = [(t * 9_000, {int(i) for i in rng.choice(ids, 30, replace=False)}) for t in range(12)]
    want = Counter(p for _, b in db for p in combinations(sorted(b), 2))
    baskets = session.staged(spark.createDataFrame([(t, i) for t, b in db for i in b], "tid long, item int"))
    assert found(counting.pair_support_bitmap(baskets)) == want == found(counting.pair_support_bitmap(baskets.unionByName(baskets)))
    rows = counting.packed_pairs(baskets).collect()
    assert len(rows) < sum(len(b) for _, b in db) * 4 and sum(len(r["mates"]) for r in rows) == sum(len(r["ones"]) for r in rows) <= 2 * sum(want.values())


def test_sparse_transaction_numbers(spark):
    far = spark.createDataFrame([(t * 10**12 - 10**9, i) for t, b in enumerate(DB) for i in b], "tid long, item int")
    assert counting.profile(far).sparse and not counting.profile(frame(spark, DB)).sparse
    for strategy in ("auto", "arrow", "horizontal"):
        assert found(mine(far, 2, strategy=strategy).itemsets()) == GOLDEN


def test_arrays_as_baskets(spark):
    arrays = spark.createDataFrame([(t, sorted(b)) for t, b in enumerate(DB)], "tid long, items array<int>")
    assert found(mine(arrays, 2).itemsets()) == GOLDEN


def test_recode_and_decode(spark):
    ranks = encode.item_rank(encode.item_support(frame(spark, DB)))
    coded = mine(encode.recode(frame(spark, DB), ranks), 2).itemsets()
    assert found(encode.decode(coded, ranks)) == GOLDEN


def test_depth_first_order(spark, tmp_path):
    """By level, then depth-first by rank: here the ranks of items 1 to 5 are 1, 0, 2, 3 and 4."""
    mine(frame(spark, DB), 2, output=str(tmp_path / "out"))
    written = [x for f in sorted((tmp_path / "out").glob("part-*")) for x in f.read_text().splitlines()]
    rank = {1: 1, 2: 0, 3: 2, 4: 3, 5: 4}
    want = sorted(GOLDEN, key=lambda s: (len(s), sorted(rank[i] for i in s)))
    assert written == ["(9)"] + [f"{' '.join(map(str, s))} ({GOLDEN[s]})" for s in want]


def test_vector_and_with_flags(spark):
    words, calls = encode.vertical_words(frame(spark, DB)), vector_and.AndCalls()
    vector, ones = vector_and.vector_and(words, 1, 2, calls=calls)
    assert ones == 4 and vector.first()["word"] == 0x1D9 & 0x1AF
    kept = vector.withColumn("seg", vector["word_idx"].cast("int"))
    assert vector_and.vector_and(words, 3, 0, stored=kept, store=False, calls=calls) == (None, 2)
    assert vector_and.vector_and(words, 1, 9, count=False, calls=calls)[1] == -1
    assert calls == vector_and.AndCalls(stored=2, counted=2)


def test_stored_batches(spark):
    words = encode.vertical_words(frame(spark, DB))
    kept = vector_and.bounded_and(words, [1, 2], [2, 1], [2, 3, 4], store=True)
    got = vector_and.bounded_and(words, [0, 1], [2, 1], [3, 5, 4], stored=kept, begin=1)
    assert {(r["parent"], r["child"]): r["support"] for r in got.collect()} == {(0, 3): 4, (0, 5): 1, (1, 4): 2}
    with pytest.raises(ValueError):
        vector_and.bounded_and(words, [0], [1], [2], begin=0)


def test_batches_against_single_ands(spark):
    """10,000 seeded words a segment: a batch of parents and children gives what one AND at a time gives."""
    size, segs = 10_000, 4
    left, right = (np.random.default_rng(seed).integers(0, 65536, (segs, size)) for seed in (777, 999))
    lists, at = np.random.default_rng(2), [0, 2, 3]
    children = [sorted(lists.choice(segs, 3, replace=False).tolist()) for _ in at]
    rows = [(p, k, c) for p, held in zip(at, children) for k, c in enumerate(held)]
    words = words_frame(spark, {"l": left.tolist(), "r": right.tolist()})
    pairs = spark.createDataFrame(rows, "parent int, pos int, child int")
    stored = vector_and.segmented_and(words, pairs).groupBy("parent", "child").agg({"word": "sum"}).collect()
    counts = vector_and.segmented_and(words, pairs, store=False).groupBy("parent", "child").agg({"ones": "sum"}).collect()
    assert {tuple(r) for r in stored} == {(p, c, int((left[p] & right[c]).sum())) for p, _, c in rows}
    assert {tuple(r) for r in counts} == {(p, c, int(np.bitwise_count(left[p] & right[c]).sum())) for p, _, c in rows}


def test_array_and(spark):
    arrays = vector_and.word_arrays(encode.vertical_words(frame(spark, DB)), 17)
    assert [tuple(r) for r in vector_and.array_and(arrays, 1, 2).collect()] == [([0x1D9 & 0x1AF, 0], 4)]
    assert vector_and.array_and(arrays, 1, 9).count() == 0


def test_word_arrays_of_many_words(spark):
    """50,000 words in a vector: the time grows with their number, not with its square."""
    n = 800_000
    words = spark.sql(f"SELECT cast(i AS int) AS item, id AS word_idx, (id * 7 + i) % 65535 + 1 AS word FROM range(3, {n // 16 - 2}), (SELECT explode(array(1, 2, 4)) AS i) WHERE (id + i) % 3 > 0")
    began = time.monotonic()
    got = {r["item"]: np.array(r["words"]) for r in vector_and.word_arrays(words, n).collect()}
    anded = vector_and.array_and(vector_and.word_arrays(words, n), 1, 2).first()
    assert time.monotonic() - began < 30
    at = np.arange(n // 16)
    want = {i: np.where(((at + i) % 3 > 0) & (at >= 3) & (at < n // 16 - 2), (at * 7 + i) % 65535 + 1, 0) for i in (1, 2, 4)}
    assert all((got[i] == want[i]).all() for i in want) and len(got) == 3
    assert anded["words"] == (want[1] & want[2]).tolist() and anded["support"] == np.bitwise_count(want[1] & want[2]).sum()
    assert {r["item"]: r["words"] for r in vector_and.word_arrays(encode.vertical_words(frame(spark, [{1}] * 40 + [{1, 2}] * 8)), 17).collect()} == {1: [65535, 65535], 2: [0, 0]}


def test_folder_of_vertical_files(spark, tmp_path):
    path, words = str(tmp_path / "v"), encode.vertical_words(frame(spark, DB))
    vbitmap.write_vbitmaps(words.filter("item < 4"), 9, path)
    vbitmap.write_vbitmaps(words.filter("item >= 4"), 9, path, width=4, mode="append")
    for vertical in (spark.read.format("vbitmap").load(path), vbitmap.read_vbitmap(spark, path)):
        assert {(r["tid"], r["item"]) for r in vbitmap.to_baskets(vertical).collect()} == {(t, i) for t, b in enumerate(DB) for i in b}
    listed = {r["path"].rsplit("/", 1)[1]: r["bytes"] for r in files.list_files(spark, path, "*.bin").collect()}
    assert listed == {f.name: f.stat().st_size for f in (tmp_path / "v").glob("*.bin")} and len(listed) >= 2
    vbitmap.write_vbitmaps(words.filter("item = 5"), 9, path)
    assert [r["item"] for r in spark.read.format("vbitmap").load(path).collect()] == [5]
    with pytest.raises(ValueError):
        files.mounted("s3a://bucket/v")


def test_packed_vertical_files(spark, tmp_path):
    """As many bytes as the set bits need, dense items as they are, and the same read back, beside plain files too."""
    path, rng, n = str(tmp_path / "v"), np.random.default_rng(4), 1_000_000
    held = {i: np.sort(rng.choice(n, 40, replace=False)) for i in range(1, 301)} | {0: np.arange(n // 2, dtype=np.int64) * 2}
    rows = [(int(t), i) for i, tids in held.items() if i for t in tids]
    baskets = spark.createDataFrame(rows, "tid long, item int").unionByName(spark.range(n // 2).selectExpr("id * 2 AS tid", "0 AS item"))
    catalog = spark.createDataFrame([(i,) for i in range(302)], "item int")
    vbitmap.write_vbitmaps(encode.vertical_words(baskets), n, path, catalog, packed=True)
    assert sum(f.stat().st_size for f in (tmp_path / "v").glob("*.bin")) < 300_000 < 301 * n // 8
    want = {i: len(tids) for i, tids in held.items()} | {301: 0}
    assert {r["item"]: r["support"] for r in spark.read.format("vbitmap").schema("item int, support long").load(path).collect()} == want
    vbitmap.write_vbitmaps(spark.createDataFrame([(400, 3, 5)], "item int, word_idx long, word long"), n, path, mode="append")
    for vertical in (spark.read.format("vbitmap").option("splits", 3).load(path), vbitmap.read_vbitmap(spark, path)):
        got = {r["item"]: (r["support"], r["words"]) for r in vertical.collect()}
        assert {i: x[0] for i, x in got.items()} == want | {400: 2}
        for i in (0, 1, 300):
            assert np.array_equal(np.flatnonzero(np.unpackbits(np.frombuffer(got[i][1], np.uint8), bitorder="little")), held[i])
        assert got[301][1] == bytes(n // 8) and np.flatnonzero(np.frombuffer(got[400][1], "<u2")).tolist() == [3]


def test_keyed_store(spark, tmp_path):
    store = KeyedStore(str(tmp_path / "store"), "k", 4)
    rows = [(k, k * 10) for k in range(20)]
    store.write(spark.createDataFrame(rows, "k int, v int"))
    store.write(spark.createDataFrame([(3, 31), (None, 1)], "k int, v int"))
    assert {r["v"] for r in store.get(spark, 3).collect()} == {30, 31}
    assert store.get(spark, 99).count() == 0
    wanted = spark.createDataFrame([(1,), (3,), (3,), (None,), (50,)], "k int")
    assert sorted(r["v"] for r in store.read(wanted).collect()) == [10, 30, 31]
    store.reset(spark)
    assert store.read(wanted).count() == 0
    store.write(spark.createDataFrame([(1, 5)], "k int, v int"))
    assert [r["v"] for r in store.read(wanted).collect()] == [5]


def test_random_matrix(spark):
    first, again = (random_matrix(spark, 50, 40, 7).repartition(n).orderBy("row").collect() for n in (1, 5))
    values = np.array([r["values"] for r in first])
    assert first == again and values.shape == (50, 40) and 0 <= values.min() and values.max() < 1
    assert abs(values.mean() - 0.5) < 0.05 and len(np.unique(values)) == 2000
    assert random_matrix(spark, 2, 0).first()["values"] == []


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(session, "_STAGED", [])
    for name, baskets, first in (("old", DB, 0), ("new", MORE, len(DB))):
        frame(spark, baskets, first).write.parquet(str(tmp_path / name))
        main(["mine", "--format", "parquet", "--data", str(tmp_path / name), "--min-sup", "1/4", "--output", str(tmp_path / f"{name}.txt")])
    args = [x for side in ("old", "new") for x in (f"--{side}", str(tmp_path / side), f"--{side}-patterns", str(tmp_path / f"{side}.txt"))]
    main(["update", "--format", "parquet", *args, "--min-sup", "25%", "--output", str(tmp_path / "all.txt")])
    assert found(patterns.read_patterns(spark, str(tmp_path / "all.txt"))) == MERGED
    assert patterns.read_transaction_count(spark, str(tmp_path / "all.txt")) == 14
    (tmp_path / "baskets.txt").write_text("".join(" ".join(map(str, sorted(b))) + "\n" for b in DB))
    main(["mine", "--data", str(tmp_path / "baskets.txt"), "--min-sup", "2", "--output", str(tmp_path / "out"), "--verbose"])
    assert found(patterns.read_patterns(spark, str(tmp_path / "out"))) == GOLDEN and not session._STAGED
    printed = capsys.readouterr().out
    assert "13 patterns" in printed and "level 3: 2 candidates" in printed
    assert [str(support(x)) for x in ("3", "0.01", "1%")] == ["3", "1/100", "1/100"]
    with pytest.raises(SystemExit):
        main(["mine", "--data", "x", "--min-sup", "many", "--output", "y"])
