"""Each stage of the corpus pipeline on all that its predecessor kept, against a brute-force version."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from basketry.llm import quality
from basketry.llm.common import staged, table
from basketry.llm.queries import TOKENIZER
from tests.llm.test_operators import share_out

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def outputs(spark):
    docs, out = table(spark, SF, "documents"), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = staged(stage(spark, docs, SF), f"test-{name}")
    return out


def _rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_order_and_columns(outputs):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "bpe"]
    for name in ("quality", "exact_dedup", "near_dedup", "mixing"):
        assert outputs[name].columns == outputs["documents"].columns


def test_quality_keeps_what_the_model_accepts(spark, outputs):
    docs, labels = outputs["documents"], table(spark, SF, "labels")
    model = quality.train(docs.select("doc_id", "text"), labels)
    good = {r["doc_id"] for r in quality.score_quality(docs, model).filter("score >= 0.5").collect()}
    assert _rows(outputs["quality"]) == Counter({tuple(r): 1 for r in docs.collect() if r["doc_id"] in good})
    marks = {r["doc_id"]: r["quality"] for r in labels.collect()}
    kept = {r["doc_id"] for r in outputs["quality"].collect()}
    assert np.mean([(i in kept) == bool(q) for i, q in marks.items() if q is not None]) > 0.9


def test_exact_dedup_keeps_the_largest_id(outputs):
    best = {}
    for r in outputs["quality"].collect():
        best[r["text"] or ""] = max(r["doc_id"], best.get(r["text"] or "", -1))
    assert sorted(r["doc_id"] for r in outputs["exact_dedup"].collect()) == sorted(best.values())


def test_near_dedup_keeps_one_of_each_component(outputs):
    sets = {}
    for r in outputs["exact_dedup"].collect():
        w = (r["text"] or "").encode().split()
        k = min(5, len(w))
        sets[r["doc_id"]] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert sorted(r["doc_id"] for r in outputs["near_dedup"].collect()) == sorted(i for i in sets if find(i) == i)


def test_mixing_repeats_whole_documents(outputs):
    docs = {r["doc_id"]: r for r in outputs["near_dedup"].collect()}
    taken = Counter(r["doc_id"] for r in outputs["mixing"].collect())
    size = {i: len((r["text"] or "").split()) for i, r in docs.items()}  # these texts have no other white space
    assert set(taken) <= set(docs) and max(taken.values()) <= 3 and all(size[i] for i in taken)
    assert _rows(outputs["mixing"]) == Counter({tuple(docs[i]): n for i, n in taken.items()})
    by, words = defaultdict(int), defaultdict(int)
    for i, r in docs.items():
        by[r["source"]] += size[i]
        words[r["source"]] += size[i] * taken[i]
    for source, goal in share_out(dict(by)).items():
        most = max(size[i] for i, r in docs.items() if r["source"] == source)
        assert abs(words[source] - goal) <= most


def test_bpe_is_the_library(outputs):
    from tokenizers import Tokenizer

    known, want = Tokenizer.from_file(TOKENIZER), Counter()
    for r in outputs["mixing"].collect():
        ids = known.encode(r["text"] or "", add_special_tokens=False).ids
        plain = known.decode(ids, skip_special_tokens=False)
        want[r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(plain.encode()).hexdigest()] += 1
    assert _rows(outputs["bpe"].select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) == want


@pytest.mark.parametrize("name", list(STAGES))
def test_edges(spark, name):
    """Nulls in any column, empty texts, repeated rows, extra columns with clashing names, and an empty table."""
    shape = "doc_id long, text string, lang string, source string, n_chars long, score double, size int, _copies int, md5 string, _md5 string, _sha string, _maybe boolean, _score double, x9_md5 int"
    odd = spark.createDataFrame([
        (1, "one two three", "en", "a", 13, 0.1, 1, 2, "x", "p", "q", True, 9.0, 1), (1, "one two three", "en", "a", 13, 0.1, 1, 2, "x", "p", "q", True, 9.0, 1), (2, *[None] * 13),
        (None, "", "en", "b", 0, 0.2, 3, 4, "y", "p", "q", False, 0.0, 2), (None,) * 14, (3, "x " * 20_000, "en", "a", 40_000, 0.3, 5, 6, "z", None, "", True, 1.0, 3),
    ], shape)
    for docs in (odd, odd.limit(0)):
        docs = staged(docs, "odd")
        got = STAGES[name](spark, docs, SF)
        assert got.columns == (docs.columns if name != "bpe" else ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        if name != "bpe":
            assert set(_rows(got)) <= set(_rows(docs))
        n, rows = got.count(), docs.count()
        assert (n == 0) if not rows else n <= 3 * rows
