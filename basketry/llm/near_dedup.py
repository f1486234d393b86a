"""N-gram Jaccard join by an LSH forest of MinHash signatures, with exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.bloom import may_repeat, members
from basketry.llm.common import attach_groups, keyed, lean, release, sheltered, staged, words
from basketry.llm.components import components

#: Texts of a block, and their shingles, at most; a longer text is a block by itself. Two blocks are compared in one task.
BLOCK = 128
WEIGHT = 1 << 16
#: Shingles hashed at a time: arrays that stay in the processor's cache.
CHUNK = 1 << 16
#: Texts that a task signs at a time.
ROWS = 500
#: Bytes of a label for each minimum hash.
STEP = 2


def least_depth(threshold: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix by which a pair right at the threshold meets in some tree with probability ``recall``."""
    for k in range(depth, 0, -1):
        if 1 - (1 - threshold**k) ** trees >= recall:
            return k
    raise ValueError("more trees are needed for this recall")


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` words; a shorter text is one shingle, an empty one none."""
    h = np.asarray(hashes).astype(np.uint64)
    n = len(h)
    if not n:
        return h
    size = min(size, n)
    with np.errstate(over="ignore"):
        out = np.zeros(n - size + 1, np.uint64)
        for k in range(size):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : n - size + 1 + k]
        out += np.uint64(size)
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        return out ^ (out >> np.uint64(32))


def forest_labels(sets: list[np.ndarray], trees: int, depth: int, seed: int = 11) -> list[bytes]:
    """The labels of each text in all trees, one after the other: ``depth`` minimum hashes of STEP bytes each. As bytes,
    labels sort as the leaves of a prefix trie do. Texts need a shingle."""
    rng = np.random.default_rng(seed)
    odd = rng.integers(0, 2**63, (trees, depth), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    flip = rng.integers(0, 2**63, (trees, depth), dtype=np.uint64)
    out = np.empty((len(sets), trees, depth), ">u2")
    sizes = np.array([len(s) for s in sets])
    start = 0
    with np.errstate(over="ignore"):
        while start < len(sets):
            stop = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:]), CHUNK, side="right")))
            flat = np.concatenate(sets[start:stop])
            at = np.concatenate([[0], np.cumsum(sizes[start:stop])[:-1]])
            for t in range(trees):
                for d in range(depth):
                    low = np.minimum.reduceat((flat ^ flip[t, d]) * odd[t, d], at)
                    low = (low ^ (low >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                    out[start:stop, t, d] = low >> np.uint64(48)
            start = stop
    return [x.tobytes() for x in out]


def overlaps(a: list[np.ndarray], b: list[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of intersection and union, of sets of ``a`` with each other or with those of ``b``. Counted exactly."""
    every = a if b is None else a + b
    n = len(every)
    sizes = np.array([len(s) for s in every], np.int64)
    values, owner = np.concatenate(every), np.repeat(np.arange(n), sizes)
    _, column, counts = np.unique(values, return_inverse=True, return_counts=True)
    shared = counts[column] > 1
    column, owner = column[shared], owner[shared]
    rank = np.cumsum(np.bincount(column, minlength=1) > 0) - 1 if len(column) else np.array([], int)
    column = rank[column] if len(column) else column
    rows, cols = (n, n) if b is None else (len(a), len(b))
    both = np.zeros((rows, cols), np.int64)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    width = 4096
    total = int(column[-1]) + 1 if len(column) else 0
    edges = np.searchsorted(column, np.arange(0, total + width, width))
    for k in range(len(edges) - 1):
        part = slice(edges[k], edges[k + 1])
        dense = np.zeros((n, width), np.float32)
        dense[owner[part], column[part] - k * width] = 1
        left, right = (dense, dense) if b is None else (dense[: len(a)], dense[len(a) :])
        both += (left @ right.T).astype(np.int64)
    left, right = (sizes, sizes) if b is None else (sizes[: len(a)], sizes[len(a) :])
    return both, left[:, None] + right[None, :] - both


def _lowest(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id in each one's component."""
    low = ids.copy()
    for i in np.argsort(ids, kind="stable"):
        if low[i] != ids[i]:
            continue
        stack, seen = [i], {int(i)}
        while stack:
            for j in np.flatnonzero(linked[stack.pop()]):
                if int(j) not in seen and low[j] == ids[j]:
                    seen.add(int(j))
                    stack.append(j)
        for j in seen:
            low[j] = min(low[j], ids[i])
    return low


def near_duplicates(docs: DataFrame, threshold: float = 0.8, size: int = 5, trees: int = 32, depth: int = 8, recall: float = 0.9999, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, class_id, n_links, n_text_links, text_md5), one row per input row.

    Two texts are linked if their sets of ``size``-word shingles have a Jaccard similarity of at least ``threshold``.
    ``class_id`` is the smallest doc_id that links lead to; ``n_links`` counts the other rows similar to this one,
    copies included, and ``n_text_links`` the different texts similar to it.

    Equal texts are one member. Each tree of the forest labels a text with ``depth`` minimum hashes; texts whose labels
    begin alike are below one node of its trie. Texts are put in the sorted order of a trie and cut into blocks. From the longest prefixes on, all blocks that some node joins are verified on whole sets, two by two and each
    two once; then prefixes are shortened by one. That ends when the links found tell that ``recall`` is reached: a link
    of similarity s is found at depth d with a probability known from s, d and ``trees``, so each one found stands for
    some that were missed. It never goes on beyond :func:`least_depth`, where each pair at the threshold has that
    chance. Pairs are counted where they are verified and never become rows.

    A text of fewer than ``size`` words is one shingle. Null texts count as empty; texts without words have no
    shingles, so no links, and their class is their own id. A null id is never a class's id unless all are null.
    """
    return _classes(docs, threshold, size, trees, depth, recall, text, doc_id).drop("root", "single")


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The batches in pieces of ROWS rows, so that what is made of one piece is gone before the next."""
    for pdf in batches:
        for first in range(0, len(pdf), ROWS):
            yield pdf.iloc[first : first + ROWS]


def _labelled(docs: DataFrame, size: int, trees: int, depth: int) -> DataFrame:
    """(rid, doc_id, md5, n_words, labels) of ``docs`` (doc_id, text); no labels for a text without words."""
    hashed = keyed(docs).select(F.col("_rid").alias("rid"), "doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("md5"), word_hashes(F.col("text")).alias("w"))

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _cut(batches):
            sets = [shingles(w, size) for w in pdf["w"]]
            made = iter(forest_labels([s for s in sets if len(s)], trees, depth))
            yield pdf[["rid", "doc_id", "md5"]].assign(n_words=[len(w) for w in pdf["w"]], labels=[next(made) if len(s) else None for s in sets])

    return hashed.mapInPandas(lean(sign), "rid long, doc_id long, md5 binary, n_words long, labels binary")


def _blocks(met: DataFrame, groups: DataFrame) -> DataFrame:
    """(rid, block) of ``groups`` (rid, root, n_words): neighbours in order of component, tree and label."""
    order = ["root", "tree", "label", "rid"]
    first = met.groupBy("rid").agg(F.min(F.struct("tree", "label")).alias("at"))
    placed = groups.join(first, "rid").select("rid", "n_words", "root", "at.tree", "at.label").repartitionByRange(*order).sortWithinPartitions(*order)

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = 0.0
        for pdf in batches:
            weight = np.maximum(1 / BLOCK, pdf["n_words"].to_numpy() / WEIGHT)
            ends = before + np.cumsum(weight)
            yield pd.DataFrame({"rid": pdf["rid"], "part": TaskContext.get().partitionId(), "at": ends - weight, "until": ends})
            before = float(ends[-1]) if len(ends) else before

    placed = staged(placed.select("rid", "n_words").mapInPandas(weigh, "rid long, part int, at double, until double"), "order")
    # a row a partition
    sizes = placed.groupBy("part").agg(F.max("until").alias("n"))
    starts = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))
    return placed.join(F.broadcast(starts), "part").select("rid", F.floor(F.col("start") + F.col("at")).alias("block"))


def _verify(threshold: float, trees: int, depths: range):
    """Compares two blocks, or one with itself: (rid, low, texts, others, missed)."""
    per_mille = round(threshold * 1000)  # in whole numbers, so that a pair right at the threshold is in

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        left = (pdf["block"] == i).to_numpy()
        order = np.concatenate([np.flatnonzero(left), np.flatnonzero(~left)])
        m, n = int(left.sum()), len(pdf)
        ids, copies = pdf["rid"].to_numpy(np.int64)[order], pdf["copies"].to_numpy(np.int64)[order]
        sets = [np.frombuffer(pdf["shingles"].iloc[x], np.uint64) for x in order]
        linked, similarity = np.zeros((n, n), bool), np.zeros((n, n))
        if i == j or 0 < m < n:
            both, union = overlaps(sets, None) if i == j else overlaps(sets[:m], sets[m:])
            at = (slice(None), slice(None)) if i == j else (slice(0, m), slice(m, n))
            linked[at], similarity[at] = 1000 * both >= per_mille * union, both / union
            if i == j:
                np.fill_diagonal(linked, False)
            else:
                linked |= linked.T
                similarity += similarity.T
        at, _ = np.nonzero(linked)
        s = similarity[linked]
        missed = [np.bincount(at, (1 - s**d) ** trees / (1 - (1 - s**d) ** trees), n) for d in depths]
        return pd.DataFrame({"rid": ids, "low": _lowest(linked, ids), "texts": linked.sum(1).astype(np.int64), "others": (linked @ copies).astype(np.int64), "missed": list(np.array(missed).T)})

    return verify


def _links(met: DataFrame, sets: DataFrame, threshold: float, trees: int, depth: int, floor: int, recall: float) -> DataFrame:
    """(rid, low, texts, others, missed) for each text and comparison of its block, from the longest prefixes on.

    ``met`` (rid, tree, label, block) are the leaves that are not alone below their node at depth ``floor``.
    """
    verify = _verify(threshold, trees, range(floor, depth + 1))
    links, done = None, None
    for d in range(depth, floor - 1, -1):
        nodes = staged(met.select(F.xxhash64("tree", F.substring("label", 1, STEP * d)).alias("node"), "block").distinct(), "nodes")
        a, b = nodes.alias("a"), nodes.alias("b")
        pairs = a.join(b, (F.col("a.node") == F.col("b.node")) & (F.col("a.block") < F.col("b.block"))).select(F.col("a.block").alias("i"), F.col("b.block").alias("j"))
        if done is None:
            pairs = pairs.distinct().unionByName(nodes.select(F.col("block").alias("i"), F.col("block").alias("j")).distinct())
        else:
            pairs = pairs.distinct().join(done, ["i", "j"], "left_anti")
        pairs = staged(pairs, "block-pairs")
        if done is not None and pairs.isEmpty():
            continue
        done = pairs if done is None else done.unionByName(pairs)
        sides = pairs.select("i", "j", F.col("i").alias("block")).unionByName(pairs.filter("i < j").select("i", "j", F.col("j").alias("block")))
        found = sides.join(sets, "block").groupBy("i", "j").applyInPandas(verify, "rid long, low long, texts long, others long, missed array<double>")
        found = staged(found, "links")
        links = found if links is None else links.unionByName(found)
        total, missed = links.agg(F.sum("texts"), F.sum(F.element_at("missed", d - floor + 1))).first()
        # as if one link more, right at the threshold, had been there to find
        if total and (missed + 2 * (1 - threshold**d) ** trees) <= (1 - recall) * total:
            break
    return links


def _classes(docs: DataFrame, threshold: float = 0.8, size: int = 5, trees: int = 32, depth: int = 8, recall: float = 0.9999, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """As :func:`near_duplicates`, with ``root``, the same for all rows of a class whatever their ids, and ``single``,
    true for a row that is its whole class. Texts without words have no root."""
    spark = docs.sparkSession
    floor = least_depth(threshold, trees, depth, recall)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = staged(_labelled(docs, size, trees, depth), "signatures")
    n = rows.count()
    some = rows.filter("labels is not null")
    texts = staged(some.groupBy("md5").agg(F.min("rid").alias("rid"), F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"), F.max("n_words").alias("n_words")), "texts")

    # labels of the rows that stand for their text; those of a text without copies never shuffle for this
    bits = members(texts.filter("copies > 1").select(F.xxhash64("md5").alias("key")), "key")
    marked = some.withColumn("maybe", may_repeat(bits, F.xxhash64("md5"), spark))
    stands = marked.filter("maybe").join(texts.select("rid"), "rid", "left_semi").unionByName(marked.filter("not maybe"))
    leaves = stands.select("rid", "labels", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    leaves = leaves.select("rid", "tree", F.substring("labels", F.col("tree") * (STEP * depth) + 1, F.lit(STEP * depth)).alias("label"))
    leaves = leaves.withColumn("key", F.xxhash64("tree", F.substring("label", 1, STEP * floor)))
    shared = staged(leaves.groupBy("key").agg(F.min("rid").alias("first"), F.count(F.lit(1)).alias("size")).filter("size > 1"), "prefixes")
    release()
    bits = members(shared.select("key"), "key")
    met = attach_groups(leaves.filter(may_repeat(bits, F.col("key"), spark)), shared, "key", "size", n).filter("size is not null")
    met = staged(met.select("rid", "first", "tree", "label"), "met")
    groups = staged(components(met.select(F.col("rid").alias("u"), F.col("first").alias("v"))).withColumnRenamed("id", "rid"), "components")
    blocks = staged(_blocks(met, texts.select("rid", "n_words").join(groups, "rid")), "blocks")
    met = staged(met.drop("first").join(blocks, "rid"), "leaves")
    candidates = staged(texts.select("md5", "rid", "copies").join(blocks, "rid"), "candidates")
    release()

    # texts that a filter of the candidates clears are not shuffled; of copies, each map task sends one
    bits = members(candidates.select(F.xxhash64("md5").alias("key")), "key")
    pool = docs.select("text", F.unhex(F.md5(F.col("text").cast("binary"))).alias("md5")).filter(may_repeat(bits, F.xxhash64("md5"), spark))
    pool = pool.groupBy("md5").agg(F.first("text").alias("text")).join(candidates, "md5").select("rid", "copies", "block", word_hashes(F.col("text")).alias("w"))

    def distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _cut(batches):
            yield pdf[["rid", "copies", "block"]].assign(shingles=[np.unique(shingles(w, size)).tobytes() for w in pdf["w"]])

    sets = staged(pool.mapInPandas(lean(distinct), "rid long, copies long, block long, shingles binary"), "sets")
    links = _links(met, sets, threshold, trees, depth, floor, recall)
    classes = components(links.filter("rid <> low").select(F.col("rid").alias("u"), F.col("low").alias("v")))
    counts = links.groupBy("rid").agg(F.sum("texts").alias("texts"), F.sum("others").alias("others"))
    known = texts.join(counts, "rid", "left").join(classes.withColumnRenamed("id", "rid"), "rid", "left")
    known = staged(known.withColumn("root", F.coalesce("root", "rid")), "known")
    heads = known.groupBy("root").agg(F.min("first_id").alias("class_id"), F.count(F.lit(1)).alias("members"))
    known = attach_groups(known, staged(heads, "heads"), "root", "members", n)
    known = staged(known.select("md5", "copies", "class_id", "root", ((F.col("members") == 1) & (F.col("copies") == 1)).alias("single"), F.coalesce("texts", F.lit(0).cast("long")).alias("texts"), F.coalesce("others", F.lit(0).cast("long")).alias("others")), "classes")
    out = attach_groups(some.select("doc_id", "md5"), known, "md5", "copies", n)
    out = out.select("doc_id", "class_id", (F.col("others") + F.col("copies") - 1).alias("n_links"), F.col("texts").alias("n_text_links"), F.lower(F.hex("md5")).alias("text_md5"), "root", "single")
    lone = rows.filter("labels is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_text_links"), F.lower(F.hex("md5")).alias("text_md5"), F.lit(None).cast("long").alias("root"), F.lit(True).alias("single"))
    return out.unionByName(lone)


@sheltered
def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without near copies: one document of each class stays.

    It is the one with the smallest id, a null id being the largest; of texts with the same id the one with the
    smallest digest. Rows equal in id and text are one document, whose rows all stay. Texts without words are in no
    class and stay.
    """
    text, doc_id = options.get("text", "text"), options.get("doc_id", "doc_id")
    found = staged(_classes(docs, **options).filter("not single").select("doc_id", "text_md5", "root"), "linked")
    here = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_md5")
    tops = staged(found.groupBy("root").agg(F.min(here).alias("top"), F.count(F.lit(1)).alias("size")), "tops")
    lost = attach_groups(found, tops, "root", "size", found.count()).filter(~here.eqNullSafe(F.col("top")))
    gone = staged(lost.select(F.col("doc_id").alias("_id"), F.col("text_md5").alias("_gone")).distinct(), "gone")
    bits = members(gone.select(F.xxhash64("_id", "_gone").alias("k")), "k")
    marked = docs.withColumn("_md5", F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).withColumn("_long", F.col(doc_id).cast("long"))
    marked = marked.withColumn("_maybe", may_repeat(bits, F.xxhash64("_long", "_md5"), docs.sparkSession))
    doubt = marked.filter("_maybe").join(gone, (F.col("_md5") == F.col("_gone")) & F.col("_long").eqNullSafe(F.col("_id")), "left_anti")
    return marked.filter("not _maybe").unionByName(doubt).select(docs.columns)


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
x AS (SELECT t, md5(t) AS m, count(*) AS copies, min(doc_id) AS first_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d GROUP BY t),
s AS (SELECT DISTINCT m, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT m, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT m, w, least(5, len(w)) AS k FROM x WHERE len(w) > 0))),
n AS (SELECT m, count(*) AS size FROM s GROUP BY m),
p AS (SELECT a.m AS a, b.m AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.m <> b.m GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n AS na ON na.m = p.a JOIN n AS nb ON nb.m = p.b WHERE 1000 * common >= 800 * (na.size + nb.size - common)),
r(m, o) AS (SELECT m, m FROM x UNION SELECT r.m, l.b FROM r JOIN l ON l.a = r.o),
c AS (SELECT r.m, min(x.first_id) AS class_id FROM r JOIN x ON x.m = r.o GROUP BY r.m),
k AS (SELECT l.a AS m, count(*) AS texts, sum(x.copies) AS others FROM l JOIN x ON x.m = l.b GROUP BY l.a)
SELECT d.doc_id, CASE WHEN len(x.w) = 0 THEN d.doc_id ELSE c.class_id END AS class_id,
  CAST(CASE WHEN len(x.w) = 0 THEN 0 ELSE coalesce(k.others, 0) + x.copies - 1 END AS BIGINT) AS n_links, CAST(coalesce(k.texts, 0) AS BIGINT) AS n_text_links, x.m AS text_md5
FROM d JOIN x ON x.t = d.t JOIN c ON c.m = x.m LEFT JOIN k ON k.m = x.m
"""
