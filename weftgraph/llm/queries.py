"""The operators' registered queries; each reads its whole tables."""

from __future__ import annotations

import public_tokenizers

from weftgraph.llm import line_dedup as line
from weftgraph.llm import oracles
from weftgraph.llm.bpe import bpe
from weftgraph.llm.decontaminate import decontaminate
from weftgraph.llm.hard_negatives import hard_negatives
from weftgraph.llm.html_extraction import html_extraction
from weftgraph.llm.importance_resampling import importance_resampling
from weftgraph.llm.jaccard_join import jaccard_join
from weftgraph.llm.quality_model import quality_model
from weftgraph.llm.quality_rules import quality_rules
from weftgraph.llm.secret_scan import secret_scan
from weftgraph.llm.substring_dedup import substring_dedup
from weftgraph.llm.suffix_dedup import suffix_dedup
from weftgraph.llm.toxicity import toxicity


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark, sf_dir: str):
    return secret_scan(table(spark, sf_dir, "documents"))


def op2_toxicity(spark, sf_dir: str):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_quality_classifier(spark, sf_dir: str):
    return quality_model(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_substring_dedup(spark, sf_dir: str):
    return substring_dedup(table(spark, sf_dir, "documents"), window=35).drop("kept_text")


def op5_ngram_jaccard_join(spark, sf_dir: str):
    return jaccard_join(table(spark, sf_dir, "documents")).drop("tkey")


def op6_benchmark_decontamination(spark, sf_dir: str):
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10).drop("items", "near_items", "hits")


def op7_line_dedup(spark, sf_dir: str):
    return line.line_dedup(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1).drop("kept_text")


def op8_bpe(spark, sf_dir: str):
    return bpe(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep=False)


def op9_suffix_array_dedup(spark, sf_dir: str):
    return suffix_dedup(table(spark, sf_dir, "documents"), length=400).drop("kept")


def op10_quality_rules(spark, sf_dir: str):
    return quality_rules(table(spark, sf_dir, "documents"))


def op11_html_extraction(spark, sf_dir: str):
    return html_extraction(table(spark, sf_dir, "pages"))


def op12_importance_resampling(spark, sf_dir: str):
    return importance_resampling(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), order=1, buckets=10_000, seed=2024, min_words=20, percent=10)


def op13_hard_negatives(spark, sf_dir: str):
    return hard_negatives(table(spark, sf_dir, "embeddings"), every=100, positives=5, negatives=10, least=30, most=90)


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_toxicity, op3_quality_classifier, op4_substring_dedup, op5_ngram_jaccard_join, op6_benchmark_decontamination, op7_line_dedup, op8_bpe, op9_suffix_array_dedup, op10_quality_rules, op11_html_extraction, op12_importance_resampling, op13_hard_negatives)}
ORACLES = {
    "op4_substring_dedup": oracles.SUBSTRING,
    "op5_ngram_jaccard_join": oracles.JACCARD,
    "op6_benchmark_decontamination": oracles.BENCHMARK,
    "op7_line_dedup": line.ORACLE,
    "op9_suffix_array_dedup": oracles.SUFFIX,
    "op12_importance_resampling": oracles.IMPORTANCE,
    "op13_hard_negatives": oracles.NEGATIVES,
}
