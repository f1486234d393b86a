"""Quality classifier: a generalised additive model with pairwise interactions, from boosted shallow trees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import held_out, labelled_sample, lean, sheltered

FEATURES = [
    "log_words", "word_length", "upper", "digits", "symbols", "exclaims", "stops", "wide", "distinct_words",
    "distinct_pairs", "stutter", "repeated_lines", "line_words", "long_words",
]
_CLASSES = np.zeros((256, 7))
for _no, _bytes in enumerate((range(65, 91), range(97, 123), range(48, 58), b"#*$%&|<>", b"!", b".,;:?", range(128, 256))):
    _CLASSES[list(_bytes), _no] = 1


def text_features(text: str | None) -> list[float]:
    """The FEATURES of a whole text; null and empty texts give zeros."""
    data = (text or "").encode()
    w = data.split()  # on ASCII white space
    if not w:
        return [0.0] * len(FEATURES)
    n = len(w)
    upper, lower, digits, symbols, exclaims, stops, wide = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _CLASSES
    chars = sum(map(len, w))
    lines = [x for x in data.split(b"\n") if x.strip()]
    return [
        np.log1p(n), chars / n, upper / max(1.0, upper + lower), digits / chars, symbols / chars, exclaims / chars, stops / n, wide / chars,
        len(set(w)) / n, len(set(zip(w, w[1:]))) / max(1, n - 1), sum(map(eq, w, w[1:])) / n, 1 - len(set(lines)) / len(lines),
        n / len(lines), sum(len(x) > 24 for x in w) / n,
    ]


@dataclass
class AdditiveModel:
    """Sums of table entries: one table a feature, one a chosen pair of features. At most a few thousand numbers."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for f, (edges, values) in enumerate(zip(self.edges, self.tables)):
            out += values[np.searchsorted(edges, x[:, f], side="right")]
        rough = {f: np.searchsorted(self.coarse[f], x[:, f], side="right") for a, b, _ in self.pairs for f in (a, b)}
        for a, b, values in self.pairs:
            out += values[rough[a], rough[b]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _leaf(g, h, ridge):
    return g / (h + ridge)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Values per bin of a tree of ``leaves`` leaves on one feature, grown greedily from sums of gradients."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    gain = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)
    spans = [(0, len(g))]
    for _ in range(leaves - 1):
        best = (1e-9, None, None)
        for a, b in spans:
            if b - a > 1:
                at = np.arange(a + 1, b)
                gains = gain(a, at) + gain(at, b) - gain(a, b)
                k = int(gains.argmax())
                best = max(best, (float(gains[k]), (a, b), int(at[k])), key=lambda t: t[0])
        if best[1] is None:
            break
        a, b = best[1]
        spans.remove((a, b))
        spans += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in spans:
        out[a:b] = _leaf(cg[b] - cg[a], ch[b] - ch[a], ridge)
    return out


def _cross(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree of one cut on each of two features."""
    G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    q = lambda c: (c[:-1, :-1], c[:-1, -1:] - c[:-1, :-1], c[-1:, :-1] - c[:-1, :-1], c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + c[:-1, :-1])
    if g.shape[0] < 2 or g.shape[1] < 2:
        return 0.0, np.zeros_like(g)
    gs, hs = q(G), q(H)
    gains = sum(x * x / (y + ridge) for x, y in zip(gs, hs)) - G[-1, -1] ** 2 / (H[-1, -1] + ridge)
    i, j = np.unravel_index(int(gains.argmax()), gains.shape)
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = (_leaf(x[i, j], y[i, j], ridge) for x, y in zip(gs, hs))
    return float(gains[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 150, pair_rounds: int = 60, n_pairs: int = 6, rate: float = 0.15, bins: int = 32, coarse_bins: int = 8, leaves: int = 3, ridge: float = 1.0) -> AdditiveModel:
    """Boost a small tree on each feature in turn, round after round; then choose pairs by their gain on what is left
    and boost those in turn. With one class, or none, the model is a constant."""
    n, k = x.shape
    positive = float((weight * y).sum())
    total = float(weight.sum())
    intercept = np.log((positive + 0.5) / (total - positive + 0.5))
    edges = [_cuts(x[:, f], bins) if n else np.array([]) for f in range(k)]
    coarse = [_cuts(x[:, f], coarse_bins) if n else np.array([]) for f in range(k)]
    model = AdditiveModel(float(intercept), edges, [np.zeros(len(e) + 1) for e in edges], coarse, [])
    if not n or len(np.unique(y)) < 2:
        return model
    fine = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)]
    rough = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(coarse)]
    margin = np.full(n, model.intercept)

    def slopes():
        p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        return weight * (y - p), weight * np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for f in range(k):
            g, h = slopes()
            m = len(edges[f]) + 1
            step = rate * _tree(np.bincount(fine[f], g, m), np.bincount(fine[f], h, m), leaves, ridge)
            model.tables[f] += step
            margin += step[fine[f]]

    def grid(a, b, g, h):
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        cell = rough[a] * shape[1] + rough[b]
        return np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    gains = sorted(((_cross(*grid(a, b, g, h), ridge)[0], a, b) for a, b in combinations(range(k), 2)), reverse=True)
    chosen = [(a, b) for gain, a, b in gains[:n_pairs] if gain > 1e-6]
    model.pairs = [(a, b, np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1))) for a, b in chosen]
    for _ in range(pair_rounds):
        for a, b, values in model.pairs:
            g, h = slopes()
            step = rate * _cross(*grid(a, b, g, h), ridge)[1]
            values += step
            margin += step[rough[a], rough[b]]
    return model


def _features(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """``keep`` columns and ``x``, the array of features."""
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[keep].assign(x=[text_features(t) for t in pdf[text]])

    return df.select(*keep, text).mapInPandas(lean(run), ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "x array<double>"]))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 8000, text: str = "text") -> AdditiveModel:
    """Fit on at most ``per_class`` labelled documents of each class, none of them held out.

    The classes weigh what they weigh among all labels. Of rows with the same id, one counts.
    """
    sample, sizes = labelled_sample(docs, labels, label, per_class)
    rows = _features(sample, ["doc_id", "y"], text).groupBy("doc_id", "y").agg(F.max("x").alias("x")).orderBy("doc_id").collect()
    x = np.array([r["x"] for r in rows], float).reshape(-1, len(FEATURES))
    y = np.array([r["y"] for r in rows], float)
    weight = np.ones(len(y))
    for c in (0, 1):
        if (y == c).any():
            weight[y == c] = sizes[c] / (y == c).sum()
    return fit(x, y, weight * len(y) / max(weight.sum(), 1e-9))


def score_quality(docs: DataFrame, model: AdditiveModel, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with column ``out``, a score between 0 and 1, features and bin additions a batch at a time."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(np.array([text_features(t) for t in texts], float).reshape(-1, len(FEATURES))))

    return docs.withColumn(out, score(F.col(text)))


@sheltered
def good_documents(docs: DataFrame, labels: DataFrame, per_class: int = 8000, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``."""
    model = train(docs.select("doc_id", "text"), labels, per_class=per_class)
    return score_quality(docs, model, out="_score").filter(F.col("_score") >= threshold).drop("_score")


def classify_quality(docs: DataFrame, labels: DataFrame, per_class: int = 8000, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row.

    Null texts count as empty, and empty ones get a score like any other; a null id isn't held out; repeated rows get
    the same score; without labels every score is 0.5. The score comes from the text alone.
    """
    scored = score_quality(docs.select("doc_id", "text"), train(docs.select("doc_id", "text"), labels, per_class=per_class))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
