"""One query per operator over its whole table, with the parameters used in production."""

from __future__ import annotations

import public_tokenizers

from basketry.llm import bpe, exact_dedup, mixing, near_dedup, quality, rules, substring_dedup, toxicity, url_filter, warc
from basketry.llm.common import table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_quality(spark, d):
    return quality.classify_quality(table(spark, d, "documents"), table(spark, d, "labels"))


def op2_url_filter(spark, d):
    return url_filter.filter_urls(table(spark, d, "pages"))


def op3_mixing(spark, d):
    return mixing.mix(table(spark, d, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op4_substring_dedup(spark, d):
    return substring_dedup.repeated_passages(table(spark, d, "documents"))


def op5_toxicity(spark, d):
    return toxicity.classify_toxicity(table(spark, d, "documents"), table(spark, d, "labels"))


def op6_quality_rules(spark, d):
    return rules.rule_verdicts(table(spark, d, "documents"))


def op7_exact_dedup(spark, d):
    return exact_dedup.exact_dedup(table(spark, d, "documents"))


def op8_bpe(spark, d):
    return bpe.bpe_digests(table(spark, d, "documents"), TOKENIZER)


def op9_jaccard_join(spark, d):
    return near_dedup.near_duplicates(table(spark, d, "documents"))


def op10_warc(spark, d):
    return warc.read_archive(warc.write_archive(table(spark, d, "pages")))


LLM = {
    "op1_quality": op1_quality, "op2_url_filter": op2_url_filter, "op3_mixing": op3_mixing, "op4_substring_dedup": op4_substring_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_quality_rules": op6_quality_rules, "op7_exact_dedup": op7_exact_dedup, "op8_bpe": op8_bpe,
    "op9_jaccard_join": op9_jaccard_join, "op10_warc": op10_warc,
}

LLM_SQL = {"op6_quality_rules": rules.SQL, "op7_exact_dedup": exact_dedup.SQL, "op9_jaccard_join": near_dedup.SQL, "op10_warc": warc.SQL}
