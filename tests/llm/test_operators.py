"""Each operator against SQL, a library or brute force, and on nulls, empty texts, repeats and empty tables."""

import base64
import hashlib
import re
from collections import Counter
from itertools import combinations, product

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from basketry import session
from basketry.llm import bloom, bpe, exact_dedup, mixing, near_dedup, quality, rules, substring_dedup, toxicity, url_filter, warc
from basketry.llm.queries import LLM, LLM_SQL, TOKENIZER
from tests.compare import connect, same

SF = "/root/testdata/sf0.001"
ODD = [(1, "one two three", "en", "a", 13, 7), (1, "one two three", "en", "a", 13, 7), (2, None, None, None, None, 1), (None, "", "en", "b", 0, 2), (3, "x " * 30_000, "en", "a", 60_000, 3), (None, None, None, None, None, None)]
SHAPE = "doc_id long, text string, lang string, source string, n_chars long, score int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SHAPE)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SHAPE)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 0, 0), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", sorted(LLM_SQL))
def test_same_as_sql(spark, name):
    assert same(spark, connect(SF), name, LLM[name], LLM_SQL[name], SF) > 0


def test_bpe_is_the_library(spark):
    from tokenizers import Tokenizer

    known, own = Tokenizer.from_file(TOKENIZER), bpe.ForcedBoundaryBPE(open(TOKENIZER, "rb").read())
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    for text in [*texts, "", "a<|endoftext|>b", "\r\n \x1c\x85　 ab", "a" * 20_000, "中文😀é"]:
        ids = known.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ids
        assert own.decode(own.encode(text)) == known.decode(ids, skip_special_tokens=False)


def test_bpe_edges(odd, none):
    got = bpe.bpe_digests(odd, TOKENIZER).collect()
    assert len(got) == len(ODD) and sum(r["n_tokens"] == 0 for r in got) == 3
    assert bpe.bpe_digests(none, TOKENIZER).count() == 0
    back = bpe.decode_documents(bpe.encode_documents(odd, TOKENIZER), TOKENIZER).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in back)


def _sets(texts):
    out = {}
    for i, t in texts.items():
        w = (t or "").encode().split()
        k = min(5, len(w))
        out[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if w else set()
    return out


def _components(sets, linked):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_near_duplicates_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    sets = _sets({r["doc_id"]: r["text"] for r in docs.collect()})
    linked = [(a, b) for a, b in combinations(sets, 2) if sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    links, root = Counter(i for pair in linked for i in pair), _components(sets, linked)
    got = near_dedup.near_duplicates(docs).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == {i: (root[i], links[i]) for i in sets}


def test_near_duplicates_over_many_blocks(spark, monkeypatch):
    """Links between blocks are found, whatever their size and however the levels end: chains, a large group, lone texts."""
    rng = np.random.default_rng(2)
    base, texts = [f"w{i}" for i in range(200)], {}
    for i in range(150):  # a group of texts near to each other
        own = list(base)
        for k in rng.choice(200, 3, replace=False):
            own[k] = f"x{i}_{k}"
        texts[len(texts)] = " ".join(own)
    for c in range(6):  # chains, of which only neighbours are similar
        own = [f"c{c}_{k}" for k in range(120)]
        for i in range(20):
            own[5 * i : 5 * i + 5] = [f"y{c}_{i}_{k}" for k in range(5)]
            texts[len(texts)] = " ".join(own)
    sets = _sets(texts)
    linked = [(a, b) for a, b in combinations(sets, 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    links, root = Counter(i for pair in linked for i in pair), _components(sets, linked)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for block, weight in ((8, 1 << 17), (128, 500), (128, 1 << 17)):
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        monkeypatch.setattr(near_dedup, "WEIGHT", weight)
        got = near_dedup.near_duplicates(docs).collect()
        assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == {i: (root[i], links[i]) for i in sets}


def test_forest_labels_meet_as_similarity_says():
    """Two texts of similarity s share a prefix of d minima in a tree with probability s ** d."""
    rng = np.random.default_rng(4)
    a = rng.choice(2**62, 900, replace=False).astype(np.uint64)
    pairs = [(a[k : k + 90], a[k + 10 : k + 100]) for k in range(0, 800, 4)]  # 80 of 100
    left, right = (np.array([np.frombuffer(x, ">u2").reshape(32, 10) for x in near_dedup.forest_labels([np.sort(p[k]) for p in pairs], 32, 10)]) for k in (0, 1))
    for d in (1, 3, 6, 10):
        assert abs((left[:, :, :d] == right[:, :, :d]).all(axis=2).mean() - 0.8**d) < 0.04
    assert near_dedup.least_depth(0.8, 32, 10, 0.9999) == 6


def test_near_duplicates_edges(odd, none):
    got = near_dedup.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    assert sorted(r["n_links"] for r in got) == [0, 0, 0, 0, 1, 1]
    assert near_dedup.near_duplicates(none).count() == 0
    assert near_dedup.one_of_each(odd).count() == len(ODD)


def test_one_of_each_without_good_ids(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(None, base), (None, f"{base} one"), (4, "alone here"), (5, f"x {base[3:]}"), (7, " ".join(f"v{i}" for i in range(60))), (7, " ".join(f"v{i}" for i in range(61)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["text"]) for r in near_dedup.one_of_each(docs).collect()]
    assert sorted(i for i, _ in got) == [4, 5, 7] and set(got) <= set(rows)
    assert near_dedup.one_of_each(docs.filter("doc_id is null")).count() == 1


def test_passages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    words = {r["doc_id"]: (r["text"] or "").encode().split() for r in docs.collect()}
    seen = {}
    for i, w in words.items():
        for k in range(len(w) - 49):
            seen.setdefault(tuple(w[k : k + 50]), set()).add(i)
    got = {}
    for r in substring_dedup.repeated_passages(docs).collect():
        got.setdefault(r["doc_id"], []).append((r["start_word"], r["end_word"]))
    for i, w in words.items():
        for k in range(len(w) - 49):
            if len(seen[tuple(w[k : k + 50])]) > 1:
                assert any(a <= k and k + 50 <= b for a, b in got.get(i, [])), (i, k)


def _covered(spark, texts, at, least=50):
    """Texts of which a row covers the ``least`` words from ``at[i]`` on."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = [r for r in substring_dedup.repeated_passages(docs).collect()]
    return {r["doc_id"] for r in rows if r["doc_id"] in at and any(r["start_word"] <= a and a + least <= r["end_word"] for a in at[r["doc_id"]])}


def test_passages_with_a_hot_piece(spark):
    """A piece too short to be a passage, in every text; after it, words that only two share."""
    piece = [f"licence{i}" for i in range(40)]
    texts, at = [], {}
    for i in range(900):
        tail = [f"p{i % 60}_{k}" for k in range(20 if i % 2 else 10)] if i < 120 else []
        start = i % 7
        texts.append(" ".join([*(f"h{i}_{k}" for k in range(start)), *piece, *tail, *(f"t{i}_{k}" for k in range(40))]))
        if tail:
            at[i] = [start]
    assert _covered(spark, texts, at) == set(at)
    assert substring_dedup.repeated_passages(spark.createDataFrame(list(enumerate(texts[120:])), "doc_id long, text string")).count() == 0


def test_passages_that_recur_in_a_text(spark):
    texts, at, twice = [], {}, [f"w{k}" for k in range(60)]
    for i in range(80):
        passage = [f"p{i // 2}_{k}" for k in range(60)]
        texts.append(" ".join([*passage[:40], *(f"x{i}_{k}" for k in range(30 + i % 9)), *passage, *(f"z{i}_{k}" for k in range(20))]))
        at[i] = [70 + i % 9]
    texts += [" ".join([*twice, *(f"y{k}" for k in range(70)), *twice]), " ".join(twice), " ".join([*"abcdefghij"] * 9), " ".join(f"q{k % 60}" for k in range(120))]
    at[80], at[81] = [0], [0]
    assert _covered(spark, texts, at) == set(at)
    docs = spark.createDataFrame(list(enumerate(texts[80:])), "doc_id long, text string")
    got = sorted((r["doc_id"], r["start_word"], r["end_word"], r["n_docs"]) for r in substring_dedup.repeated_passages(docs).collect())
    assert got == [(0, 0, 60, 2), (0, 130, 190, 2), (1, 0, 60, 2)]


def _linked_pairs(spark, pairs_of, between, alter, seed=1):
    """How many of ``pairs_of`` pairs that share a passage of 120 words have it in one class, with ``between`` texts
    that hold it with a word changed every 17; ``alter`` changes the passage of the second one."""
    rng, texts, at = np.random.default_rng(seed), [], []
    for g in range(pairs_of):
        for kind in ["first", *["other"] * between, "second"]:
            i, words, start = len(texts), [f"p{g}_{k}" for k in range(120)], int(rng.integers(5, 60))
            if kind == "other":
                for k in range(int(rng.integers(17)), 120, 17):
                    words[k] = f"c{i}_{k}"
            else:
                at.append((i, start))
            words = alter(words, rng) if kind == "second" else words
            texts.append(" ".join([*(f"a{i}_{k}" for k in range(start)), *words, *(f"z{i}_{k}" for k in range(20))]))
    rows = substring_dedup.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    classes = [{r["class_id"] for r in rows if r["doc_id"] == i and r["start_word"] <= a + 40 and r["end_word"] >= a + 80} for i, a in at]
    assert all(any(r["doc_id"] == i for i, _ in at) or between for r in rows)
    return sum(bool(x & y) for x, y in zip(classes[::2], classes[1::2]))


@pytest.mark.parametrize("between", [0, 3, 10, 30])
def test_passages_among_texts_that_share_less(spark, between):
    assert _linked_pairs(spark, 40, between, lambda words, rng: words) == 40


def test_short_near_passages_among_texts_that_share_less(spark):
    """Passages of 52 words, in 40 pairs of texts the second time with another word in the middle (similarity 0.81); each
    has 30 texts with two words changed beside it, none of which is alike to both or in the way."""
    rng, texts, at = np.random.default_rng(8), [], []
    for g in range(40):
        for kind in ["first", *["other"] * 30, "second"]:
            i, start, words = len(texts), int(rng.integers(5, 60)), [f"p{g}_{k}" for k in range(52)]
            changed = {"first": [], "second": [int(rng.integers(18, 34))], "other": [int(rng.integers(4, 16)), int(rng.integers(36, 48))]}[kind]
            for k in changed:
                words[k] = f"c{i}_{k}"
            if kind != "other":
                at.append(i)
            texts.append(" ".join([*(f"a{i}_{k}" for k in range(start)), *words, *(f"z{i}_{k}" for k in range(20))]))
    rows = substring_dedup.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    classes = {i: {r["class_id"] for r in rows if r["doc_id"] == i} for i in at}
    assert sum(bool(classes[a] & classes[b]) for a, b in zip(at[::2], at[1::2])) >= 39


def test_near_passages(spark):
    """Of passages of 120 words with two words changed (shingle similarity 0.84), 0.95 are found; such
    with a word changed every 9, which have a similarity of about 0.3, are not."""

    def few(words, rng):
        for k in (30, 80):
            words[k + int(rng.integers(9))] = f"n{rng.integers(10**9)}"
        return words

    def many(words, rng):
        for k in range(4, 120, 9):
            words[k] = f"n{rng.integers(10**9)}"
        return words

    assert _linked_pairs(spark, 60, 0, few) >= 57
    assert _linked_pairs(spark, 60, 0, many) == 0


def _stretches(a, b, own, lost, least, per_mille):
    for s in range(len(b)):
        for e in range(s + least, len(b) + 1):
            part = set(b[s:e].tolist())
            both = len(part & set(a.tolist())) + lost
            if b[s] in a and b[e - 1] in a and 1000 * both >= per_mille * (len(part - set(a.tolist())) + both + max(0, own - both)):
                return True
    return False


def test_stretches_that_repeat_shingles_by_brute_force():
    rng = np.random.default_rng(5)
    runs = [rng.integers(0, k, n).astype(np.uint16) for k in (3, 8, 14) for n in (20, 23, 12, 9, 23, 16)]
    own = np.array([substring_dedup._least_distinct(x, 12) for x in runs])
    assert own.tolist() == [min(len(set(x[s : s + 12].tolist())) for s in range(max(1, len(x) - 11))) for x in runs]
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(runs)), np.arange(len(runs))))
    lost = np.arange(len(runs)) % 5 == 0
    got = substring_dedup._dense_sets(runs, *substring_dedup._coded(runs), own, lost.astype(int), i, j, 12, 700)
    assert got.tolist() == [_stretches(runs[x], runs[y], own[x], lost[y], 12, 700) for x, y in zip(i, j)]
    assert 0 < got.sum() < len(got)


def test_windows_that_repeat_words_are_paired_only_if_alike(spark):
    """Twelve texts that repeat their own words many times, and six more that are the same but for a word, in one key."""
    words = lambda x, n: [f"{x}{k % 6}" for k in range(n)]
    texts = [words(f"u{t}_", 45) + ["centre"] + words(f"v{t}_", 44) for t in range(12)] + [words("u99_", 45) + ["centre"] + words("v99_", 43) + [f"end{t}"] for t in range(6)]
    made = [(t, [hash_of(w) for w in text], [7], [0], [44], [85], [-1], [1]) for t, text in enumerate(texts)]
    rows = spark.createDataFrame(made, "rid long, w array<long>, key array<long>, l array<int>, c array<int>, r array<int>, label array<long>, parts array<int>")
    pairs = substring_dedup._left_out(substring_dedup._contexts(rows, 46, 5), 46, 0.8)
    got = pairs.collect()
    assert len(got) == 15 and all(r["rid"] >= 12 for r in got)
    assert sum(r["tree"] for r in got) == 5


def test_rows_of_a_hot_key_grow_with_its_windows(spark, monkeypatch):
    """A passage in 40 texts, and in 40 more with a word changed every 17, which are alike to none: these are compared
    with all others, and no pair of them becomes a row."""
    texts, rows, staged = [], {}, substring_dedup.staged
    for i in range(80):
        words = [f"p{k}" for k in range(120)]
        for k in range(i % 17, 120 if i >= 40 else 0, 17):
            words[k] = f"c{i}_{k}"
        texts.append(" ".join([*(f"a{i}_{k}" for k in range(i % 9)), *words, *(f"z{i}_{k}" for k in range(20))]))

    def counted(df, name="stage"):
        out = staged(df, name)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(substring_dedup, "staged", counted)
    got = substring_dedup.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got if r["class_id"] == 0 and r["end_word"] - r["start_word"] == 120} == set(range(40))
    assert rows["pairs"] < rows["labelled"]
    again = spark.createDataFrame([(t, [hash_of(f"w{k}") for k in range(89)] + [t], [7], [0], [44], [85], [-1], [1]) for t in range(40)], "rid long, w array<long>, key array<long>, l array<int>, c array<int>, r array<int>, label array<long>, parts array<int>")
    assert substring_dedup._left_out(substring_dedup._contexts(again, 46, 5), 46, 0.8, every=False).count() == 39


def test_hot_keys_are_dealt_in_rounds(spark, monkeypatch):
    """Windows of 60 texts that share a phrase, every third with the words around it too: with small blocks the pairs of
    parts are dealt out in rounds, with the same result, and tables that are not read again are gone."""
    phrase = [f"p{k}" for k in range(9)]
    texts = [[*(f"a{i % 3 and i}_{k}" for k in range(60)), *phrase, *(f"z{i % 3 and i}_{k}" for k in range(60)), f"end{i}"] for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    names, dealt, staged, left_out = [], [], substring_dedup.staged, substring_dedup._left_out
    monkeypatch.setattr(substring_dedup, "staged", lambda df, name="stage": names.append(name) or staged(df, name))
    monkeypatch.setattr(substring_dedup, "_left_out", lambda rows, *a, **b: dealt.append(rows.agg(F.sum("parts"), F.count("*")).first()) or left_out(rows, *a, **b))
    whole = {tuple(r) for r in substring_dedup.repeated_passages(docs).collect()}
    assert {r[0] for r in whole} == set(range(0, 60, 3)) and "compared" not in names
    monkeypatch.setattr(substring_dedup, "BLOCK", 4)
    before = set(session._STAGED)
    assert {tuple(r) for r in substring_dedup.repeated_passages(docs).collect()} == whole
    copies, n = dealt[-1]
    assert n == dealt[0][1] > 40 and copies < n * n / 4 * 0.6 and names.count("compared") == -(-copies // (substring_dedup.COPIES * n)) > 1
    left = {path.rsplit("/", 1)[1].rsplit("-", 1)[0] for path in set(session._STAGED) - before}
    assert "pairs" in left and not left & {"windows", "met", "contexts"}


@pytest.mark.parametrize("size", [5, 14, 60])
def test_parts_of_a_hot_key_meet_once(spark, monkeypatch, size):
    """Every two windows of a key are in one tile, whatever the parts, and a window is copied about as often as the root of the number of blocks."""
    monkeypatch.setattr(substring_dedup, "BLOCK", 4)
    parts = spark.range(1).select(substring_dedup._parts(F.lit(size))).first()[0]
    assert parts == {5: 2, 14: 4, 60: 8}[size]
    part, label = np.arange(size) * 7 % parts, np.arange(size) % 3
    met = Counter()
    for p in range(parts):
        for q in range(p, parts):
            some = np.flatnonzero((part == p) | (part == q))
            for tile, first in substring_dedup._tiles(part[some], label[some], p, q):
                assert len(tile) <= 8
                at = some[tile].tolist()
                met.update(frozenset(x) for x in (combinations(at, 2) if not first else product(at[:first], at[first:])))
    assert set(met.values()) == {1} and len(met) == size * (size - 1) // 2


def hash_of(word):
    return int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "little", signed=True)


def test_windows_of_a_repetition_are_few():
    tokens = np.concatenate([np.arange(100), np.tile(np.arange(200, 207), 3000), np.arange(300, 400)]).astype(np.uint64)
    odd_, flip = substring_dedup._functions(4, 1)
    assert len(substring_dedup.compact_windows(tokens, 46, odd_, flip)[0]) < 200


def test_compact_windows_cover_every_subsequence():
    rng = np.random.default_rng(3)
    tokens = rng.choice(2**62, 200, replace=False).astype(np.uint64)
    odd_, flip = substring_dedup._functions(2, 1)
    fn, _, left, at, right = substring_dedup.compact_windows(tokens, 12, odd_, flip)
    for f in range(2):
        v = ((tokens ^ flip[f]) * odd_[f]) & ~substring_dedup.POSITION
        own = [(a, c, b) for g, a, c, b in zip(fn, left, at, right) if g == f]
        for i in range(0, 189, 7):
            for j in range(i + 11, 200, 5):
                c = i + int(v[i : j + 1].argmin())
                assert [x for x in own if x[0] <= i <= x[1] <= j <= x[2]] == [x for x in own if x[1] == c]


def test_passages_edges(odd, none):
    assert substring_dedup.repeated_passages(none).count() == 0
    assert substring_dedup.repeated_passages(odd).count() == 0


def test_exact_dedup_edges(odd, none):
    got = exact_dedup.exact_dedup(odd).collect()
    assert len(got) == len(ODD) and sum(r["kept"] for r in got) == 3
    assert exact_dedup.exact_dedup(odd, max_filter_bytes=1).count() == len(ODD)
    assert exact_dedup.exact_dedup(none).count() == 0
    assert exact_dedup.distinct_documents(odd).count() == 3


def test_exact_dedup_in_slices(spark):
    """A filter of one segment at a time, and filters of members that are fuller than planned, change no result."""
    docs = spark.range(150_000).selectExpr("id AS doc_id", "concat('t', if(id % 5 = 0, id div 50, id)) AS text")
    assert bloom.slices(150_000, 1) == 3
    want = docs.groupBy("text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    for bound in (1, 64 << 20):
        got = exact_dedup.exact_dedup(docs, max_filter_bytes=bound)
        assert got.count() == 150_000 and got.filter("kept").count() == want.count()
        assert got.select("doc_id", "keep_id", "group_size").exceptAll(docs.join(want, "text").select("doc_id", "keep_id", "group_size")).isEmpty()
    keys = docs.select(F.xxhash64("doc_id").alias("k"))
    bits = bloom.members(keys.filter("k % 2 = 0"), "k", max_bytes=1 << 17)
    passed = keys.withColumn("p", bloom.may_repeat(bits, F.col("k"), spark))
    assert len(bits) == 1 and passed.filter("k % 2 = 0 and not p").isEmpty() and passed.filter("k % 2 <> 0 and not p").count() > 60_000


def share_out(sizes, weights=(1, 2, 3), cap=3.0):
    """Words each source gets, by sharing the excess again until none is above its cap."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    target, left, open_ = {}, float(sum(sizes.values())), list(order)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > cap * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        target |= {s: cap * sizes[s] for s in over}
        left -= sum(target[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    return target


def _sized(spark, sizes):
    return spark.createDataFrame([("1" if s is None else "0" + s, n) for s, n in sizes.items()], "sk string, size long")


def test_mix(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(docs).toPandas()
    assert len(rows) == docs.count() and (rows["taken"] <= 3 * rows["size"]).all()
    by = rows.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((by["taken"] - by["target"]).abs() <= 0.15 * by["target"] + 100).all()
    assert len(mixing.mix(odd).collect()) == len(ODD) and mixing.mix(none).count() == 0
    for sizes in ({"b": 10, "a": 1000, None: 10}, {"é": 5, "z": 900, "": 1, "Z": 40, None: 300, "zz": 7, "zzz": 2000}, {None: 0}, {"x": 0, "y": 3}):
        got = mixing.source_plan(_sized(spark, sizes)).collect()
        assert {None if r["sk"] == "1" else r["sk"][1:]: r["target"] for r in got} == pytest.approx(share_out(sizes))
    assert share_out({"b": 10, "a": 1000, None: 10}) == {"a": 960.0, "b": 30, None: 30}


def test_mix_of_many_sources_and_equal_rows(spark):
    """2,000 sources; a third of all rows equal and without id: words still come near each target."""
    rows = spark.range(12_000).selectExpr("if(id % 3 = 0, null, id) AS doc_id", "if(id % 3 = 0, 'same text here', concat('w', id, ' x', if(id % 2 = 0, ' y z', ''))) AS text", "if(id % 3 = 0, 's', concat('t', id % 2000)) AS source")
    got = mixing.mix(rows)
    hot = got.filter("source = 's'").groupBy("copies").count().collect()
    goal = got.filter("source = 's'").first()["target"]
    assert got.count() == 12_000 and len(hot) == 2 and abs(sum(3 * r["copies"] * r["count"] for r in hot) - goal) <= 3
    off = got.groupBy("source").agg(F.max(F.col("size")).alias("most"), F.abs(F.sum("taken") - F.first("target")).alias("off"))
    assert off.filter("off > most + 1e-6").isEmpty() and got.filter("taken > 3 * size").isEmpty()
    again = mixing.mix(rows.repartition(3))
    assert got.select("doc_id", "source", "taken").exceptAll(again.select("doc_id", "source", "taken")).isEmpty()


def test_mix_reruns_agree(spark):
    rows = [(i, " ".join("w" * (1 + i % 3) for _ in range(1 + i * 7 % 23)), None if i % 9 == 8 else f"s{i % 9}") for i in range(900)]
    runs = []
    for parts, shuffles in ((1, 3), (7, 8), (5, 13)):
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        docs = spark.createDataFrame(rows[::-1] if parts > 1 else rows, "doc_id long, text string, source string").repartition(parts)
        runs.append(sorted((r["doc_id"], r["taken"]) for r in mixing.mix(docs).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert runs[0] == runs[1] == runs[2]


def test_pivot_keeps_the_sum():
    rng = np.random.default_rng(0)
    w, p = np.arange(100, 0, -1.0), np.full(100, 0.37)
    out, left = mixing.pivot(w, p, rng)
    assert abs((w * out).sum() - (w * p).sum()) < 1e-6
    assert all(x in (0.0, 1.0) for k, x in enumerate(out) if k != left)


def test_quality_and_toxicity(spark, odd, none, labels):
    base = "/root/testdata/sf0.01"
    marks = {r["doc_id"]: r for r in spark.read.parquet(f"{base}/labels.parquet").collect()}
    got = [r for r in LLM["op1_quality"](spark, base).collect() if r["held_out"] and r["doc_id"] in marks]
    assert np.mean([r["predicted"] == marks[r["doc_id"]]["quality"] for r in got]) > 0.95
    got = [r for r in LLM["op5_toxicity"](spark, base).collect() if r["held_out"] and r["doc_id"] in marks]
    toxic, clean = ([r["predicted"] for r in got if marks[r["doc_id"]]["toxic"] == y] for y in (1, 0))
    assert np.mean(toxic) >= 0.85 and np.mean(clean) <= 0.02
    clash = odd.withColumnsRenamed({"score": "y", "n_chars": "t", "lang": "held_out", "source": "predicted"})
    for run in (quality.classify_quality, toxicity.classify_toxicity):
        assert len(run(odd, labels).collect()) == len(run(clash, labels).collect()) == len(ODD)
        assert run(none, labels).count() == 0
        assert len(run(odd, labels.limit(0)).collect()) == len(ODD)


def test_folding_and_exceptions():
    lex = toxicity.Lexicon({" idiot ": 2.0, " lowei": 1.0, " ass ": 1.0, " shit ": 1.0, " dumbass ": 1.0, " loser ": 1.0, " réeux": 1.0}, [" not an idiot "])
    a = lex.automaton()
    hits = lambda t: lex.hits(a, toxicity.fold(t))
    for odd_word in ("1d10t", "іdіоt", "ıdiot", "ӏdiot", "idіөt", "idi07", "i.d.i.o.t", "i d i o t", "ídiót", "𝐢𝐝𝐢𝐨𝐭", "ＩＤＩＯＴ", "ɪᴅɪᴏᴛ", "IDIOT!!!"):
        assert hits(f"You {odd_word}, you") == 2, odd_word
    for word in ("a55", "a$$", "5h17", "dumba55", "1oser", "ӏoser", "réeuxpa", "loweichen"):
        assert hits(f"x {word}") == 1, word
    for word in ("mp3 covid19 h2o 2024 $5", "reeuxpa", "class", "идет", "a b c"):
        assert hits(word) == 0, word
    assert hits("he is not an idiot") == 0 and hits("not an idiot, an idiot") == 2 and hits("") == hits(None) == 0


def test_matcher_by_brute_force():
    rng = np.random.default_rng(8)
    words = ["aa", "ab", "aab", "b", "ba", "bab"]
    for _ in range(60):
        entries = {(f" {w} " if rng.random() < 0.5 else f" {w}"): float(rng.integers(1, 9)) for w in rng.choice(words, 3, replace=False)}
        exceptions = [f" {' '.join(rng.choice(words, rng.integers(1, 4)))} " for _ in range(3)]
        lex = toxicity.Lexicon(entries, [x for x in exceptions if x not in entries])
        text = f" {' '.join(rng.choice(words, 30))} "
        spans = lambda p: [(i, i + len(p)) for i in range(len(text)) if text.startswith(p, i)]
        shields = [s for x in lex.exceptions for s in spans(x)]
        want = sum(w for p, w in entries.items() for s, e in spans(p) if not any(x <= s and e <= y for x, y in shields))
        assert lex.hits(lex.automaton(), text) == want


def test_lexicon_learns_phrases(spark):
    """An insult counts; the clean phrases it is part of don't."""
    rng = np.random.default_rng(3)
    filler = [f"word{i}" for i in range(300)]
    rows, marks = [], []
    for i in range(240):
        bad, words = i % 4 == 0, list(rng.choice(filler, 30))
        words[5:5] = ["you", "dolt", str(rng.choice(filler))] if bad else ["dolt", "rope"] if i % 4 == 1 else []
        rows.append((i, " ".join(words)))
        marks.append((i, int(bad)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    lex = toxicity.train(docs, marks, least_gain=4.0, least_rate=0.3)
    assert any(" dolt ".startswith(e) for e in lex.entries) and " dolt rope " in lex.exceptions
    a = lex.automaton()
    assert lex.hits(a, toxicity.fold("you dolt")) > 0 == lex.hits(a, toxicity.fold("a dolt rope here"))


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y, np.ones(4000))
    assert ((model.score(x) > 0.5) == y).mean() > 0.95


def test_urls(spark, none):
    rows = [(1, "http://A.example.com/en/7x?q"), (2, "https://b.net/de/1"), (3, "x"), (4, None), (5, "http://www.free-bets.org"), (6, "http://freebets.io/#x"), (7, "http://b.example.net/de/8"), (7, "http://b.example.net/de/8")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("x") for c in ("host", "html", "part", "word", "_rid", "odds", "n")})
    found = url_filter.filter_urls(pages).collect()
    got = {r["page_id"]: r for r in found}
    assert len(found) == len(rows)
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert (got[2]["rule"], got[7]["rule"]) == ("net/de/", "example.net/de/8")
    assert got[3]["host"] == got[4]["path"] == "" and got[3]["verdict"] == "allow"
    assert got[5]["verdict"] == got[6]["verdict"] == "block"
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_names_are_split_as_by_brute_force():
    rng = np.random.default_rng(6)
    counts = {"th": 50.0, "the": 30.0, "er": 20.0, "on": 9.0, "ther": 2.0, "her": 8.0, "one": 1.0}
    model = url_filter.WordModel(counts, sum(counts.values()))

    def cost(words):
        return sum(np.log(model.total / counts[w]) if w in counts else np.log(model.total) + url_filter.LETTER * len(w) for w in words)

    def splits(name):
        return [[name[:i], *rest] for i in range(1, len(name) + 1) for rest in (splits(name[i:]) if i < len(name) else [[]])]

    for _ in range(40):
        name = "".join(rng.choice(["th", "e", "er", "on", "x", "her", "one"], 4))
        assert cost(model.segment(name)) == pytest.approx(min(map(cost, splits(name))))
        assert "".join(model.segment(name)) == name
    assert url_filter.WordModel({"free": 9.0, "bets": 9.0}, 18.0).segment("freebets") == ["free", "bets"]
    assert len(url_filter.WordModel({"ab": 5.0}, 9.0).segment("ab" * 5000)) == 5000


def test_urls_by_brute_force(spark):
    """A whole table: rules, names split by the words of the pages, odds of words learnt from decided urls."""
    table = f"{SF}/pages.parquet"
    rows = spark.read.parquet(table).collect()
    runs = lambda t: [w for w in regex.split(r"\P{L}+", t.lower()) if w]
    counts = Counter(w for r in rows for w in runs(re.sub("<[^>]*>", " ", r["html"] or "")) if 2 <= len(w) <= url_filter.LONGEST)
    for w in (*url_filter.UNWANTED, *url_filter.WANTED):
        counts[w] += url_filter.SEED_COUNT
    model, urls, seen = url_filter.WordModel(counts, sum(counts.values())), [], set()
    for r in rows:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", r["url"] or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [x for x in url_filter.RULES if (host == x[1] or host.endswith("." + x[1])) and path.startswith(x[2])]
        rule = max(fits, key=lambda x: len(x[1] + x[2])) if fits else None
        rest = f"{host.rpartition('.')[0] or host} {path[len(rule[2]) :] if rule else path}"
        urls.append((r["page_id"], host, path, rule, runs(rest)))
        if rule:
            seen |= {(host, part, rule[0]) for part in runs(rest)}
    a, b = (Counter(w for _, part, said in seen if said == which for w in model.segment(part)) for which in ("block", "allow"))
    words, odds = {*a, *b, *url_filter.UNWANTED, *url_filter.WANTED}, {}
    for w in words:
        p, q = (0.5 * (w in seeds) / len(seeds) + 0.5 * (c[w] + 1) / (sum(c.values()) + len(words)) for seeds, c in ((url_filter.UNWANTED, a), (url_filter.WANTED, b)))
        odds[w] = np.log(p / q)
    got = {r["page_id"]: r for r in url_filter.filter_urls(spark.read.parquet(table)).collect()}
    for page, host, path, rule, parts in urls:
        tokens = [w for part in parts for w in model.segment(part) if w in odds]
        want = np.log(0.1) + sum(odds[w] for w in tokens)
        assert (got[page]["host"], got[page]["path"], got[page]["rule"]) == (host, path, rule[1] + rule[2] if rule else None)
        assert got[page]["verdict"] == (rule[0] if rule else "block" if want > 0 else "allow")
        assert rule or not tokens or got[page]["odds"] == pytest.approx(want)


def test_urls_learn_from_decided_ones(spark):
    """Names of sites that rules block, alone or run together, speak against other sites."""
    rules = [("block", f"{w}{i}{v}.com", "/") for i in range(8) for w, v in (("zonk", "marl"), ("zonk", "pell"))] + [("allow", f"quiet{i}pond.com", "/") for i in range(8)]
    rows = [f"http://{host}/a" for _, host, _ in rules] + ["http://zonk.net/", "http://zonkmarl.net/", "http://quietpond.net/", "http://pond.net/"]
    pages = spark.createDataFrame([(i, u, "zonk marl pell quiet pond " * 9) for i, u in enumerate(rows)], "page_id long, url string, html string")
    got = [r["verdict"] for r in url_filter.filter_urls(pages, rules, prior=np.log(0.4)).orderBy("page_id").collect()]
    assert got[-4:] == ["block", "block", "allow", "allow"]


def test_rules_edges(odd, none):
    got = rules.rule_verdicts(odd).collect()
    assert len(got) == len(ODD) and not any(r["kept"] for r in got)
    assert max(r["n_repeat_words"] for r in got) == 30_000
    assert rules.rule_verdicts(none).count() == 0
    clash = odd.withColumnsRenamed({"score": "body", "n_chars": "n_words", "lang": "kept", "source": "_m"})
    assert sorted(r["n_words"] for r in rules.cascade(clash, ready=rules.BASE).collect()) == sorted(r["n_words"] for r in got)
    assert rules.kept_documents(clash).columns == clash.columns


def test_rules_agree_in_any_order(spark):
    """Whatever is ready and in whatever order, the same rows are kept; the greedy order is by rejection per cost."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r["doc_id"] for r in rules.rule_verdicts(docs).filter("kept").collect()}
    assert 0 < len(want) < docs.count()
    assert want == {r["doc_id"] for r in rules.kept_documents(docs).collect()} == {r["doc_id"] for r in rules.kept_documents(docs, rules=rules.RULES[::-1]).collect()}
    a, b, c = rules.RULES[:3]
    # c rejects most for its cost; b then has nothing left that c has not rejected
    assert [x[0] for x in rules.greedy_order([(a, 4.0), (b, 1.0), (c, 1.0)], {0: 50, 0b001: 10, 0b110: 20, 0b100: 20})] == [c, a, b]


def test_warc_round_trip(spark):
    rows = [(1, "http://a", "x"), (2, "http://b\r\n", "x"), (3, None, None), (None, "http://c", "x"), (5, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    archive = warc.write_archive(pages)
    assert archive.payloads.count() == 2 and archive.payloads.count() < archive.headers.count()
    got = {r["page_id"]: r for r in warc.read_archive(archive).collect()}
    assert [got[k]["record_type"] for k in (1, 2, 3, 5)] == ["response", "revisit", "response", "revisit"]
    assert got[2]["refers_to"] == got[None]["refers_to"] == 1 and got[5]["refers_to"] == 3
    records = [bytes(r["record"]) for r in warc.reconstruct(archive).collect()]
    assert sum(r.endswith(b"\r\n\r\nx\r\n\r\n") for r in records) == 1 and all(r.startswith(b"WARC/1.1\r\n") for r in records)
    assert warc.read_archive(warc.write_archive(pages.limit(0))).count() == 0



def test_warc_by_brute_force(spark):
    """Repeated rows and page_ids, long and non-ASCII payloads, blank lines in a payload, a bound, columns that clash."""
    rows = [(1, "http://é/ü", "a\r\n\r\nb", 5), (1, "http://é/ü", "a\r\n\r\nb", 5), (1, "u", "other", 0), (2, "u", "ü" * 200_000, 1), (9, "v", "ü" * 200_000, 1), (7, None, "ab", 2), (6, "w", "ab", 2), (8, "w", "", 2), (4, "w", None, None), (None, "w", "ab", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, rid int").withColumn("sha256", F.lit("x")).withColumn("payload", F.lit("y"))
    for bound in (0, 3):
        archive = warc.write_archive(pages, min_bytes=bound)
        first, got = {}, Counter()
        for page, _, html, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
            data = (html or "").encode()
            again = data in first and len(data) >= bound
            got[page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first[data] if again else None] += 1
            first.setdefault(data, page)
        read = warc.read_archive(archive)
        assert Counter(tuple(r) for r in read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()) == got
        assert archive.payloads.count() == len(first)
        bodies = Counter(bytes(r["payload"]) for r in warc.parse_records(warc.reconstruct(archive)).collect() if b"WARC-Type: response" in bytes(r["header"]))
        want = Counter((r[2] or "").encode() for r in rows)
        assert bodies == Counter({k: n if len(k) < bound else 1 for k, n in want.items()})
    broken = warc.Archive(archive.headers, archive.payloads.withColumn("payload", F.concat("payload", F.lit(b"!"))))
    with pytest.raises(Exception, match="digest"):
        warc.read_archive(broken).collect()
