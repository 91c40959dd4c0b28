"""The registered queries of this folder, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linehaul.llm import bin_completion, decontaminate, hard_negatives, jaccard, line_dedup, neighbours, packing, secrets, suffix_dedup, token_counts, toxicity, urls, variants
from linehaul.llm.stage import small_batches
from linehaul.plans.inputs import table


def word_tokenizer() -> str:
    """The file of the word BPE, where the public tokenizers are installed."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def piece_vocabulary() -> str:
    """The file of the 32,000 pieces, where the public tokenizers are installed."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return table(small_batches(spark), sf, name)


def op1_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.piece_report(_read(spark, sf, "documents"), word_tokenizer())


def op2_nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.nearest(_read(spark, sf, "embeddings"), F.col("id") % 100 == 0)


def op3_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.token_report(_read(spark, sf, "documents"), piece_vocabulary())


def op4_suffix_array_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.repeat_report(_read(spark, sf, "documents"))


def op5_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.toxicity_report(_read(spark, sf, "documents"), _read(spark, sf, "labels"))


def op6_ngram_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.component_report(_read(spark, sf, "documents"))


def op7_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return line_dedup.line_report(_read(spark, sf, "documents"))


def op8_secret_scans(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.secret_report(_read(spark, sf, "documents"))


#: Fixed rules of the URL query: verdict, host, beginning of the path.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op9_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    return urls.verdict_report(_read(spark, sf, "pages"), URL_RULES)


def op10_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    documents, tests = _read(spark, sf, "documents"), _read(spark, sf, "benchmark")
    out = decontaminate.contamination_report(documents, tests)
    return out.drop("longest")


def op11_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return variants.variant_report(_read(spark, sf, "documents"))


def op12_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return bin_completion.piece_report(_read(spark, sf, "documents"), word_tokenizer())


def op13_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    return hard_negatives.negative_report(_read(spark, sf, "embeddings"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_packing,
        op2_nearest_neighbours,
        op3_token_counts,
        op4_suffix_array_dedup,
        op5_toxicity,
        op6_ngram_jaccard_join,
        op7_line_dedup,
        op8_secret_scans,
        op9_url_filters,
        op10_benchmark_decontamination,
        op11_spelling_variants,
        op12_best_fit_packing,
        op13_hard_negatives,
    )
}
