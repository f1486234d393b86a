"""URL filter: fixed rules first, else naive Bayes over words that a unigram Viterbi finds in host and path."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import attach_groups, keyed, staged

#: Fixed rules: (verdict, host, path prefix). A rule fits its host and all subdomains; the longest that fits decides.
RULES = (
    ("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"), ("block", "org", "/es/"),
)
#: Words of unwanted and of wanted sites: what the classifier knows before it learns from decided urls.
UNWANTED = (
    "casino poker slots jackpot lottery betting bets gambling roulette pills viagra pharmacy cheap replica porn xxx adult escort hookup nude cams webcam "
    "spam scam phishing malware virus crack warez torrent keygen hacked payday loans forex cash prize winner win free click clicks ads advert track tracker "
    "tracking banner popup affiliate promo farm bots"
).split()
WANTED = (
    "news blog wiki docs library university school science research journal museum city government health recipe kitchen garden sports weather travel music "
    "film book books history arts forum support help mail maps photo code open data project community church family office business tools learn education "
    "world local today times post daily home about contact article story review guide"
).split()
#: A seed word counts in the unigram model as a word that is found so often.
SEED_COUNT = 100.0
#: Letters of the longest word looked up; a longer run of letters is split into such words or stays unknown.
LONGEST = 32
#: Pieces that a task gathers before it hands them on.
FLUSH = 50_000
#: Cost of each letter of an unknown word: a power of ten.
LETTER = math.log(10)


@dataclass
class WordModel:
    """Unigram counts: ``words``, as far as they are of use for the names at hand, and the ``total`` of all."""

    words: dict[str, float]
    total: float

    def segment(self, name: str) -> list[str]:
        """The most probable split of a name into words; of equal ones that with the longer last word.

        A known word costs its negative log probability, an unknown string that of a count of one and LETTER a letter.
        Linear in the length of the name.
        """
        free = math.log(max(self.total, 1.0))
        best, unknown = [(0.0, 0)], (math.inf, 0)
        for end in range(1, len(name) + 1):
            # an unknown string that ends here, of any length
            unknown = min((unknown[0] + LETTER, unknown[1]), (best[end - 1][0] + free + LETTER, end - 1))
            least = unknown
            for start in range(max(0, end - LONGEST), end):
                n = self.words.get(name[start:end])
                if n:
                    least = min(least, (best[start][0] + free - math.log(n), start))
            best.append(least)
        found, end = [], len(name)
        while end:
            start = best[end][1]
            found.append(name[start:end])
            end = start
        return found[::-1]


def pieces(name: str) -> set[str]:
    """All strings of 2 to LONGEST letters in a name: the words that may be of use for it."""
    return {name[i:j] for i in range(len(name)) for j in range(i + 2, min(len(name), i + LONGEST) + 1)}


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z in lower case, and path; both empty without a ``://``."""
    form = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    given = F.coalesce(url, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(given, form, 1), upper, upper.lower()), F.regexp_extract(given, form, 2)


def ruled(urls: DataFrame, rules=RULES) -> DataFrame:
    """``urls`` (host, path) with ``rule`` and its verdict ``said``, null where none fits, and ``rest``, what naive Bayes
    looks at: the host without its top-level label, and the path without the prefix that the rule itself tests."""
    rule, said, path = F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("path")
    for say, at, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((F.col("host") == at) | F.col("host").endswith(f".{at}")) & F.col("path").startswith(prefix)
        rule, said = F.when(fits, F.lit(at + prefix)).otherwise(rule), F.when(fits, F.lit(say)).otherwise(said)
        path = F.when(fits, F.expr(f"substring(path, {len(prefix) + 1})")).otherwise(path)
    rest = F.concat_ws(" ", F.regexp_replace("host", r"\.[^.]*$", ""), path)
    return urls.withColumn("rule", rule).withColumn("said", said).withColumn("rest", rest)


def _runs(text: Column) -> Column:
    """The runs of letters of a text, in lower case."""
    return F.array_remove(F.split(F.lower(text), r"\P{L}+"), "")


def corpus_words(pages: DataFrame, html: str = "html") -> DataFrame:
    """(word, n): how often each word of up to LONGEST letters is found in the pages outside tags."""
    plain = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), "<[^>]*>", " ")
    found = pages.select(F.explode(_runs(plain)).alias("word")).filter(f"length(word) between 2 and {LONGEST}")
    return found.groupBy("word").agg(F.count(F.lit(1)).cast("double").alias("n"))


def segmented(parts: DataFrame, counts: DataFrame) -> DataFrame:
    """``parts`` with ``tokens``: each ``part`` split by the counts of its own pieces, which a join finds.

    Seed words count SEED_COUNT times besides. No table of words is sent to the executors.
    """
    seeds = {w: SEED_COUNT for w in (*UNWANTED, *WANTED)}
    total = sum(seeds.values()) + (counts.agg(F.sum("n")).first()[0] or 0.0)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple[str, str]] = []
        for pdf in batches:
            for part in pdf["part"]:
                out += [(part, word) for word in sorted(pieces(part))]
                if len(out) >= FLUSH:
                    yield pd.DataFrame(out, columns=["part", "word"], dtype=object)
                    out = []
        yield pd.DataFrame(out, columns=["part", "word"], dtype=object)

    known = parts.select("part").mapInPandas(cut, "part string, word string").join(counts, "word")
    known = known.groupBy("part").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            tokens = []
            for part, found in zip(pdf["part"], pdf["known"]):
                words = {w: seeds[w] for w in pieces(part) & seeds.keys()}
                for x in () if found is None else found:
                    words[x["word"]] = words.get(x["word"], 0.0) + x["n"]
                tokens.append(WordModel(words, total).segment(part))
            yield pdf.drop(columns="known").assign(tokens=tokens)

    return parts.join(known, "part", "left").select(*parts.columns, "known").mapInPandas(split, f"{shape}, tokens array<string>")


def token_odds(tokens: DataFrame, smoothing: float = 1.0, seed_share: float = 0.5) -> DataFrame:
    """(word, odds): multinomial log odds of block from ``tokens`` (tokens, n_block, n_allow).

    The probability of a word in a class is, by ``seed_share``, that of the class's seed words, each alike, and for the
    rest its smoothed share among the words of the class's urls.
    """
    spark = tokens.sparkSession
    rows = [(w, float(w in UNWANTED), float(w in WANTED)) for w in sorted({*UNWANTED, *WANTED})]
    seeds = spark.createDataFrame(rows, "word string, u double, v double")
    seen = tokens.filter("n_block + n_allow > 0").select(F.explode("tokens").alias("word"), "n_block", "n_allow")
    seen = seen.select("word", "n_block", "n_allow", F.lit(0.0).alias("u"), F.lit(0.0).alias("v")).unionByName(seeds.select("word", F.lit(0).alias("n_block"), F.lit(0).alias("n_allow"), "u", "v"))
    seen = staged(seen.groupBy("word").agg(F.sum("n_block").alias("a"), F.sum("n_allow").alias("b"), F.sum("u").alias("u"), F.sum("v").alias("v")), "url-words")
    words, n_block, n_allow = seen.agg(F.count(F.lit(1)), F.sum("a"), F.sum("b")).first()

    def share(seed: str, n_seeds: int, count: str, n: int) -> Column:
        return seed_share * F.col(seed) / n_seeds + (1 - seed_share) * (F.col(count) + smoothing) / (n + smoothing * words)

    return seen.select("word", (F.log(share("u", len(UNWANTED), "a", n_block)) - F.log(share("v", len(WANTED), "b", n_allow))).alias("odds"))


def filter_urls(pages: DataFrame, rules=RULES, prior: float = math.log(0.1), smoothing: float = 1.0, seed_share: float = 0.5, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict, odds), one row per input row.

    Urls that a rule fits are decided by it. They are also the rows that naive Bayes learns from (see :func:`ruled`); a
    site counts once for each word, so that a large one doesn't settle what its words mean. Names in
    hosts and paths are split into words by the unigram counts of the words in all pages. The other urls get ``odds``,
    the log odds of block from ``prior`` and the words of host and path, and are blocked above 0.

    Each different name is split once, with the counts of its own pieces; words, names and urls meet by joins, at any
    number of them. A null url, or one without ``://``, has an empty host and path, fits no rule and is allowed, as are
    urls without a known word. Repeated rows get the same verdict; an empty table gives an empty result.
    """
    found = pages.select(F.col(page_id).alias("page_id"), *(c.alias(n) for c, n in zip(host_and_path(F.col(url)), ("host", "path"))))
    urls = staged(keyed(ruled(found, rules)), "urls")
    parts = urls.select("_rid", "said", F.col("host"), F.explode(_runs(F.col("rest"))).alias("part"))
    sites = parts.filter("said is not null").select("host", "part", "said").distinct()
    sites = sites.groupBy("part").agg(F.count_if(F.col("said") == "block").alias("n_block"), F.count_if(F.col("said") == "allow").alias("n_allow"))
    asked = parts.filter("said is null").groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    zero = F.lit(0).cast("long")
    names = asked.join(sites, "part", "full").select("part", *(F.coalesce(c, zero).alias(c) for c in ("size", "n_block", "n_allow")))
    tokens = staged(segmented(staged(names, "url-names"), corpus_words(pages, html)), "url-tokens")
    odds = staged(token_odds(tokens, smoothing, seed_share), "url-odds")
    scored = tokens.filter("size > 0").select("part", "size", F.explode("tokens").alias("word")).join(odds, "word").groupBy("part", "size").agg(F.sum("odds").alias("odds"))
    placed = staged(parts.filter("said is null").select("_rid", "part"), "url-parts")
    by_url = attach_groups(placed, staged(scored, "url-scores"), "part", "size", placed.count()).groupBy("_rid").agg((F.lit(prior) + F.sum("odds")).alias("odds"))
    verdict = F.coalesce("said", F.when(F.col("odds") > 0, "block").otherwise("allow"))
    return urls.join(by_url, "_rid", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "odds")
