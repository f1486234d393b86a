"""Quality rules as a short-circuit cascade, ordered by rejection per cost. DataFrame functions only."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import staged, words

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 8


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _signs(body: Column, letters: str) -> Column:
    """How many characters of the text are among ``letters``."""
    return (F.length(body) - F.length(F.translate(body, letters, ""))).cast("long")


def _lines(body: Column) -> Column:
    return F.filter(F.split(body, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))


def _covered(starts: Column) -> Column:
    """Words covered by windows at these ascending positions."""
    steps = F.zip_with(starts, F.slice(starts, F.lit(2), F.greatest(F.size(starts), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)


def _repeated(w: Column) -> Column:
    """Words in windows of WINDOW words that the text has twice or more.

    A window is known by a 64-bit hash. Hashes and their positions are sorted within the row only where some hash
    occurs twice; the cost is n log n for a text of any length.
    """
    zero = F.lit(0).cast("long")
    windows = F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, F.lit(WINDOW))))

    def again(t: Column) -> Column:
        return F.filter(t, lambda x, i: F.coalesce(x["h"] == F.get(t, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(t, i + 1)["h"], F.lit(False)))

    def of(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda v, i: F.struct(v.alias("h"), i.alias("p"))))
        twice = _let(_let(placed, again), lambda t: _let(F.sort_array(F.transform(t, lambda x: x["p"])), _covered))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), twice).otherwise(zero)

    return F.when(F.size(w) > WINDOW, _let(windows, of)).otherwise(zero)


#: What rules may ask of a text and its words. Worked out only where it is asked for.
MEASURES: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda body, w: F.size(w).cast("long"),
    "word_chars": lambda body, w: F.length(F.translate(body, " \t\n\x0b\x0c\r", "")).cast("long"),
    "n_symbols": lambda body, w: _signs(body, SYMBOLS),
    "n_lines": lambda body, w: F.size(_lines(body)).cast("long"),
    "n_dup_lines": lambda body, w: _let(_lines(body), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    "n_repeat_words": lambda body, w: _repeated(w),
    "n_capitals": lambda body, w: _signs(body, CAPITALS),
    "n_exclaims": lambda body, w: _signs(body, "!"),
    "n_distinct": lambda body, w: F.size(F.array_distinct(w)).cast("long"),
}
#: The measures that the query returns for every row.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """Rejects a text where ``rejects``, of a function from a measure's name to its column, is true."""

    name: str
    rejects: Callable[[Callable[[str], Column]], Column]


#: Production rules. Whole numbers on both sides, so that any engine gives the same.
RULES = (
    Rule("few", lambda m: m("n_words") < 20),
    Rule("repeated_words", lambda m: 100 * m("n_repeat_words") > 30 * m("n_words")),
    Rule("symbols", lambda m: 100 * m("n_symbols") > 10 * m("word_chars")),
    Rule("repeated_lines", lambda m: 100 * m("n_dup_lines") > 30 * m("n_lines")),
    Rule("word_length", lambda m: (m("word_chars") < 2 * m("n_words")) | (m("word_chars") > 15 * m("n_words"))),
    Rule("capitals", lambda m: 100 * m("n_capitals") > 40 * m("word_chars")),
    Rule("exclaims", lambda m: 100 * m("n_exclaims") > 10 * m("word_chars")),
    Rule("few_words", lambda m: 100 * m("n_distinct") < 5 * m("n_words")),
)


def _of_text(make: Callable[[Column, Column], Column]) -> Column:
    """``make`` of the column ``body`` and of its words. These are bound within one expression, so that the text is
    split once a row, wherever a filter on the result is pushed."""
    return _let(words(F.col("body")), lambda w: make(F.col("body"), w))


def _rejected(rules: Iterable[Rule], ready: tuple[str, ...]) -> Column:
    """Whether any of the rules rejects; the first that does ends it."""

    def chain(body: Column, w: Column) -> Column:
        out = F.lit(False)
        for rule in rules:
            out = out | rule.rejects(lambda name: F.col(name) if name in ready else MEASURES[name](body, w))
        return out

    return _of_text(chain)


def prepared(docs: DataFrame, ready: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """``docs`` with ``body`` (text, null as empty) and the ``ready`` measures, which replace columns of the same names."""
    own = [F.col(c).alias(f"_in_{i}") for i, c in enumerate(docs.columns)]
    names = {f"_in_{i}": c for i, c in enumerate(docs.columns) if c not in ("body", *ready)}
    df = docs.select(*own, F.coalesce(F.col(text), F.lit("")).alias("body"))
    found = _of_text(lambda body, w: F.struct(F.lit(True).alias("_"), *(MEASURES[m](body, w).alias(m) for m in ready)))
    return df.withColumn("_m", found).select(*(F.col(k).alias(c) for k, c in names.items()), "body", *(F.col(f"_m.{m}") for m in ready))


def greedy_order(rules: list[tuple[Rule, float]], hits: dict[int, int]) -> list[tuple[Rule, float, float]]:
    """(rule, cost, share) in the order to run: always the rule that rejects most of what is left for its cost.

    ``hits``: how many sampled rows each set of rules (bit i for rule i) rejects. ``share`` is of the rows left.
    """
    out, open_, left = [], list(range(len(rules))), dict(hits)
    while open_:
        rows = max(1, sum(left.values()))
        share = {i: sum(n for bits, n in left.items() if bits >> i & 1) / rows for i in open_}
        best = max(open_, key=lambda i: (share[i] / rules[i][1], -rules[i][1], -i))
        out.append((*rules[best], share[best]))
        open_.remove(best)
        left = {bits: n for bits, n in left.items() if not bits >> best & 1}
    return out


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ready: tuple[str, ...] = (), sample_rows: int = 2000, text: str = "text", seed: int = 7) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected of what is left) in the order to run.

    Measured on about ``sample_rows`` rows, each row drawn by itself: each rule alone, in one task, from ``body`` and
    the ``ready`` measures, best of three and less the time of no rule. The order moves cost
    only: a text is kept if no rule rejects it, in whatever order.
    """
    n = docs.count()
    if not n or not rules:
        return [(r, 0.0, 0.0) for r in rules]
    picked = docs.select(F.col(text).alias("text")).filter(F.rand(seed) < min(1.0, sample_rows / n))
    sample = staged(prepared(picked, ready), "rules-sample").coalesce(1)

    def seconds(condition: Column) -> float:
        best = math.inf
        for _ in range(3):
            began = time.perf_counter()
            sample.agg(F.count_if(condition)).first()
            best = min(best, time.perf_counter() - began)
        return best

    idle = seconds(_rejected([], ready))
    bits = sum((F.when(_rejected([r], ready), 1 << i).otherwise(0) for i, r in enumerate(rules)), F.lit(0))
    hits = {r["bits"]: r["count"] for r in sample.groupBy(bits.alias("bits")).count().collect()}  # 2 ** len(rules) rows
    return greedy_order([(r, max(1e-3, seconds(_rejected([r], ready)) - idle)) for r in rules], hits)


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ready: tuple[str, ...] = (), sample_rows: int = 2000, text: str = "text") -> DataFrame:
    """``docs`` with ``body``, the ``ready`` measures and ``kept``.

    The rules run in their measured order; the disjunction stops at the first that rejects, and measures that are not
    ``ready`` are worked out only when a rule that asks for them is reached. Null texts count as empty; these have no
    words. Repeated rows get the same result; an empty table gives an empty result. Columns of ``docs`` with the names
    of those added are replaced.
    """
    ordered = [rule for rule, _, _ in order_rules(docs, rules, ready, sample_rows, text)]
    return prepared(docs, ready, text).withColumn("kept", ~_rejected(ordered, ready))


def kept_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that no rule rejects."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    text = options.pop("text", "text")
    found = cascade(docs.toDF(*names), text=names[docs.columns.index(text)], **options)
    return found.filter("kept").select(*names).toDF(*docs.columns)


def rule_verdicts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)."""
    found = cascade(docs.select("doc_id", "text"), ready=BASE)
    return found.select("doc_id", *BASE, F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words").alias("base_failed"), "kept")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body FROM documents),
s AS (SELECT *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM s WHERE len(w) >= 8)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, CAST(sum(least(8, step)) AS BIGINT) AS n FROM (SELECT rid, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 8) AS step FROM dup) GROUP BY rid),
m AS (
  SELECT doc_id, body, w, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(body, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    length(regexp_replace(body, '[^A-Z]', '', 'g')) AS n_capitals, length(regexp_replace(body, '[^!]', '', 'g')) AS n_exclaims
  FROM s LEFT JOIN rep USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 30 * n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words
    OR 100 * n_capitals > 40 * word_chars OR 100 * n_exclaims > 10 * word_chars OR 100 * len(list_distinct(w)) < 5 * n_words) AS kept
FROM b
"""
