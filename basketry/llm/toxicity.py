"""Toxicity by a weighted lexicon: Aho-Corasick over folded text, normalised by length, with exception phrases."""

from __future__ import annotations

import re
import string
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import held_out, labelled_sample, lean, staged

# Letters of other scripts that look like Latin ones, and signs that stand for letters within a word.
LOOKALIKES = {
    **str.maketrans("абвгезийкмнопрстухчьѕіјһԁԛԝөү", "abbresuukmhonpctyxybsijhdqwoy"),
    **str.maketrans("αβγεηικνοπρστυχω", "abyenikvonpotuxw"),
    **str.maketrans("աոսօցզհյ", "anuogqhj"),
}
SIGNS = str.maketrans("01345678@$!|", "oieasgtbasii")
#: The same, where what looks like an i is read as l.
SIGNS_AS_L = str.maketrans("01345678@$!|", "oleasgtbasll")
_SIGN = re.compile(r"[01345678@$!|](?=[01345678@$!|]{0,3}[^\W\d_])")
_WORD = re.compile(r"[^\W\d_]+")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .\-_*]){3,}[^\W\d_](?![^\W_])")
_EDGES = "".join(sorted(set(string.punctuation) - set("$@|"))) + "…«»“”‘’–—¡¿"
#: Beginnings of words that may become lexicon entries have so many letters.
STEMS = range(3, 9)
#: Terms that a task gathers before it hands on their counts.
GATHER = 100_000
#: Occurrences of a term that count within one document.
REPEATS = 3
#: Common English insults and swear words, and their plurals: entries from the start, however few documents are labelled.
SEEDS = tuple(
    f" {w}{end} "
    for w in (
        "idiot moron imbecile cretin dimwit halfwit nitwit dunce dumbass jackass dumbo fool loser scum scumbag lowlife degenerate trash garbage vermin parasite "
        "clown freak creep pervert pig rat cockroach maggot bastard bitch whore slut asshole arsehole douchebag dickhead prick twat wanker tosser cunt faggot "
        "retard motherfucker fucker bullshit shithead coward weakling scoundrel"
    ).split()
    for end in ("", "s")
) + tuple(
    f" {w} "
    for w in "stupid dumb pathetic worthless disgusting despicable contemptible repulsive brainless idiotic moronic retarded subhuman shit fuck fucking fucked crap filthy filth hate loathe".split()
)
#: A seed weighs as if it were found so many more times in toxic documents.
SEED_COUNT = 2


def _strokes() -> dict[int, str]:
    """Latin letters that no decomposition makes plain, by their names: dotless, stroked, small capital."""
    form, out = re.compile(r"LATIN (?:SMALL LETTER|LETTER SMALL CAPITAL) (?:DOTLESS )?([A-Z])(?: WITH .*)?$"), {}
    for code in (*range(0x80, 0x300), *range(0x1D00, 0x1E00), *range(0xA720, 0xAB70)):
        if (m := form.match(unicodedata.name(chr(code), ""))) and not unicodedata.normalize("NFKD", chr(code))[0].isascii():
            out[code] = m[1].lower()
    return out


PLAIN = LOOKALIKES | _strokes()


def _plain(word: str) -> str:
    """The word as it looks, in Latin letters without marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", word.translate(PLAIN)) if not unicodedata.combining(c))


def _own(word: str) -> str:
    """A word of Latin letters into which look-alikes are mixed, in Latin letters; any other as it is."""
    return _plain(word) if not word.isascii() and any(c.isascii() for c in word) and any(ord(c) in LOOKALIKES for c in word) else word


def _signed(t: str) -> str:
    return _SIGN.sub(lambda m: m[0].translate(SIGNS), t)


def fold(text: str | None) -> str:
    """The words of the text in lower case, with a blank before, between and after them; then further readings of odd
    words, one a line: without marks, with all signs read as letters (as i or as l), or with spaced letters joined."""
    t = (text or "").casefold()
    if not t.isascii():
        t = unicodedata.normalize("NFKC", t).casefold().replace("ӏ", "1")  # a bar that is read both ways
    words = [w if w.isascii() else _own(w) for w in _WORD.findall(_signed(t))]
    more = [p for w in words if not w.isascii() and (p := _plain(w)) != w]
    for token in t.split():
        if token.isalpha() or (core := token.strip(_EDGES)).isalpha() or not _WORD.search(core):
            continue
        known = {_own(w) for w in _WORD.findall(_signed(token))}
        for table in (SIGNS, SIGNS_AS_L):
            for w in map(_plain, _WORD.findall(core.translate(table))):
                if w not in known:
                    known.add(w)
                    more.append(w)
    more += [_plain("".join(_WORD.findall(x))) for x in _SPACED.findall(t)]
    return f" {' '.join(words)} " + "".join(f"\n {w} " for w in more)


def _lines(folded: str) -> str:
    """The text's own words, without the further readings."""
    return folded.partition("\n")[0]


@dataclass
class Lexicon:
    """``entries``: pattern to weight. `` word `` matches a word, `` stem`` (no blank after) the start of one.

    ``exceptions``: phrases with a blank at both ends; an entry within one doesn't count.
    ``scale``: intercept and factors of the hits and of the hits by length.
    """

    entries: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    scale: tuple[float, float, float] = (-3.0, 1.0, 1.0)

    def automaton(self):
        a = ahocorasick.Automaton()
        for k, w in self.entries.items():
            a.add_word(k, (len(k), w))
        for k in self.exceptions:
            a.add_word(k, (len(k), None))
        if len(a):
            a.make_automaton()
        return a

    def hits(self, automaton, folded: str) -> float:
        """Sum of the weights of matched entries outside exception phrases."""
        if not len(automaton):
            return 0.0
        found = [(end, n, w) for end, (n, w) in automaton.iter(folded)]
        if not found:
            return 0.0
        shields = [(end - n + 1, end) for end, n, w in found if w is None]
        total, k, reach = 0.0, 0, -1
        shields.sort()
        for start, end, w in sorted((end - n + 1, end, w) for end, n, w in found if w is not None):
            while k < len(shields) and shields[k][0] <= start:
                reach, k = max(reach, shields[k][1]), k + 1
            if end > reach:
                total += w
        return total

    def margin(self, total: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        b, by_hits, by_share = self.scale
        return b + by_hits * np.log1p(total) + by_share * np.log1p(100 * total / np.maximum(n_words, 20))


def _measure(lexicon: Lexicon, automaton, folded: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([lexicon.hits(automaton, t) for t in folded], float), np.array([_lines(t).count(" ") - 1 for t in folded], float)


def _terms(folded: str) -> list[tuple[str, int]]:
    """(term, count) of the words, and of beginnings of words, that may become entries."""
    out: Counter[str] = Counter()
    for w, n in Counter(_lines(folded).split()).items():
        n = min(n, REPEATS)
        out[f" {w} "] += n
        for k in STEMS:
            if k < len(w):
                out[f" {w[:k]}"] += n
    return [*out.items()]


def _phrases(lexicon: Lexicon, automaton, folded: str) -> set[str]:
    """Words that start with an entry, and the two and three words that such a word is the middle or an end of."""
    line, out = _lines(folded), set()
    for end, (n, _) in automaton.iter(line) if len(automaton) else ():
        start = end - n + 1
        stop = line.index(" ", start + 1)
        before, after = line.rfind(" ", 0, start) if start else start, line.find(" ", stop + 1)
        after = stop if after < 0 else after
        out.update({line[start : stop + 1], line[before : stop + 1], line[start : after + 1], line[before : after + 1]})
    return out


def _rate(a: float, b: float, n: float, m: float) -> float:
    """Log of how much more often than among ``m`` clean words something is found among ``n`` toxic ones."""
    return float(np.log((a + 0.5) / (n + 1)) - np.log((b + 0.5) / (m + 1)))


def _nested(a: str, b: str) -> bool:
    """One matches wherever the other does: equal, or a stem of the other."""
    return a == b or (a[-1] != " " and b.startswith(a)) or (b[-1] != " " and a.startswith(b))


def _calibrate(total: np.ndarray, n_words: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression on the two measures by Newton steps with a small ridge."""
    x = np.column_stack([np.ones(len(y)), np.log1p(total), np.log1p(100 * total / np.maximum(n_words, 20))])
    b = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3), x.T @ (weight * (y - p)) - 0.1 * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, b))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 6000, least_gain: float = 12.0, least_rate: float = 1.5, size: int = 256, phrases: int = 1000) -> Lexicon:
    """Learn the lexicon from at most ``per_class`` labelled documents of each class, none of them held out.

    Words and beginnings of words are counted by class over the sample, REPEATS times a document at most. Those more
    frequent in toxic documents by a factor of exp(``least_rate``) and with a log likelihood ratio of ``least_gain``
    are entries, the most telling first, at most ``size``; none that another one covers. Common insults (SEEDS) join
    them, unless the sample speaks against it. Words that start with an entry, and phrases of two or three words with
    one, that are found in clean documents for the most part are exceptions, the ``phrases`` most frequent of them.
    """
    spark = docs.sparkSession
    sample, sizes = labelled_sample(docs, labels, label, per_class)

    def folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "t": [fold(x) for x in pdf["text"]]})

    # one text an id, so that the sample stays as small as its ids are few; and each text once, as words of a text that
    # many documents share would look telling
    sample = sample.groupBy("doc_id", "y").agg(F.min("text").alias("text")).mapInPandas(lean(folded), "doc_id long, y int, t string")
    sample = staged(sample.groupBy("t").agg(F.min("doc_id").alias("doc_id"), F.max("y").alias("y")).withColumn("n_words", F.size(F.split(F.substring_index("t", "\n", 1), " ")) - 2), "sample")
    n = {r["y"]: (r["n"], r["w"]) for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("w")).collect()}
    if 1 not in n:
        return Lexicon()
    (n_toxic, toxic_words), (n_clean, clean_words) = n[1], n.get(0, (0, 0))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, list[int]] = {}

        def flush() -> pd.DataFrame:
            out = pd.DataFrame({"term": [*found], **{c: [x[i] for x in found.values()] for i, c in enumerate(("a", "b", "docs"))}})
            found.clear()
            return out.astype({"term": object})

        for pdf in batches:
            for text, y in zip(pdf["t"], pdf["y"]):
                for term, n in _terms(text):
                    sums = found.setdefault(term, [0, 0, 0])
                    sums[0 if y else 1] += n
                    sums[2] += y
                if len(found) >= GATHER:
                    yield flush()
        yield flush()

    counts = sample.select("t", "y").mapInPandas(lean(counted), "term string, a long, b long, docs long").groupBy("term").agg(*(F.sum(c).alias(c) for c in ("a", "b", "docs")))
    a, b = F.col("a"), F.col("b")
    fair = (a + b) * F.lit(toxic_words / max(1, toxic_words + clean_words))
    gain = a * F.log(a / fair) + F.when(b > 0, b * F.log(b / (a + b - fair))).otherwise(0.0)
    rate = F.log((a + 0.5) / F.lit(toxic_words + 1)) - F.log((b + 0.5) / F.lit(clean_words + 1))
    counts = staged(counts.filter((F.col("docs") >= (3 if n_toxic >= 20 else 2)) | F.col("term").isin(*SEEDS)).withColumn("gain", gain).withColumn("rate", rate), "terms")
    top = counts.filter((F.col("gain") >= least_gain) & (F.col("rate") >= least_rate)).orderBy(F.round("gain", 6).desc(), F.length("term").desc(), "term").limit(20 * size).collect()
    entries: dict[str, float] = {}
    for r in top:
        if len(entries) < size and not any(_nested(r["term"], e) for e in entries):
            entries[r["term"]] = min(float(r["rate"]), 10.0)
    seen = {r["term"]: (r["a"], r["b"]) for r in counts.filter(F.col("term").isin(*SEEDS)).collect()}
    for t in SEEDS:
        a, b = seen.get(t, (0, 0))
        weight = _rate(a + SEED_COUNT, b, toxic_words, clean_words)
        if weight >= least_rate and not any(_nested(t, e) for e in entries):
            entries[t] = min(weight, 10.0)

    known = spark.sparkContext.broadcast(Lexicon(entries))

    @F.pandas_udf("array<string>")
    def around(texts: pd.Series) -> pd.Series:
        automaton = known.value.automaton()
        return pd.Series([sorted(_phrases(known.value, automaton, t)) for t in texts])

    clean = sample.select("y", F.explode(around("t")).alias("p")).groupBy("p").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    clean = clean.filter((F.col("b") >= 2) & (F.col("b") / max(1, n_clean) > 3 * F.col("a") / n_toxic))
    lexicon = Lexicon(entries, [r["p"] for r in clean.orderBy(F.desc("b"), "p").limit(phrases).collect()])
    plain = spark.sparkContext.broadcast(lexicon)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = plain.value.automaton()
        for pdf in batches:
            total, words = _measure(plain.value, automaton, list(pdf["t"]))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "total": total, "words": words})

    found = sample.mapInPandas(measured, "doc_id long, y int, total double, words double").orderBy("doc_id").collect()  # 2 * per_class rows
    y = np.array([r["y"] for r in found], float)
    weight = np.where(y == 1, sizes[1] / n_toxic, sizes.get(0, 0) / max(1, n_clean))
    lexicon.scale = _calibrate(np.array([r["total"] for r in found]), np.array([r["words"] for r in found]), y, weight)
    return lexicon


def score_toxicity(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` between 0 and 1. The lexicon, at most some 1,300 phrases, is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        automaton = own.automaton()
        for texts in batches:
            total, words = _measure(own, automaton, [fold(t) for t in texts])
            yield pd.Series(1 / (1 + np.exp(-np.clip(own.margin(total, words), -30, 30))))

    return docs.withColumn("score", score(F.col(text)))


def classify_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 6000, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row.

    Null texts count as empty; empty texts have no hits and get the score of such; a null id isn't held out; repeated
    rows get the same score; without toxic labels every score is low and the same.
    """
    plain = docs.select("doc_id", "text")
    scored = score_toxicity(plain, train(plain, labels, per_class=per_class))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
