"""Registered queries of this package, and SQL twins of those that SQL can express."""

from __future__ import annotations

import public_tokenizers as vocabularies
from pyspark.sql import DataFrame, SparkSession

from wardline.llm import (
    alignment, bytebpe, fingerprint, htmltext, language, lengths, lines, neardup, packing, quality, toxicity, urls, variants,
)
from wardline.llm.common import table

BYTE_BPE = "byte_bpe_multi_50k.tiktoken"
WORD_BPE = "word_bpe_49k.json"
ALIGNED_BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def lempel_ziv_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.with_edits(table(spark, sf_dir, "documents"))


def line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.judge(table(spark, sf_dir, "documents"))


def hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents"), neardup.Likeness(words=3, percent=85))


def nearest_toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.round_trip(table(spark, sf_dir, "documents"), vocabularies.path(BYTE_BPE), vocabularies.PATTERN)


def hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabularies.path(WORD_BPE))


def quadratic_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.report(table(spark, sf_dir, "documents"), vocabularies.path(BYTE_BPE), vocabularies.PATTERN)


def url_language_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language.identify(docs, language.fit(language.training_rows(docs)))


def cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.report(table(spark, sf_dir, "documents"), vocabularies.path(ALIGNED_BPE), vocabularies.path(PIECES))


def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.grouped(table(spark, sf_dir, "documents"))


def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return htmltext.extract(pages, htmltext.fit(pages))


QUERIES = {
    "op1_lempel_ziv_fingerprints": lempel_ziv_fingerprints,
    "op2_line_frequency": line_frequency,
    "op3_hyperminhash": hyperminhash,
    "op4_nearest_toxic": nearest_toxic,
    "op5_byte_level_bpe": byte_level_bpe,
    "op6_hilbert_packing": hilbert_packing,
    "op7_quadratic_discriminant": quadratic_discriminant,
    "op8_length_histogram": length_histogram,
    "op9_url_language_models": url_language_models,
    "op10_string_kernel_language": string_kernel_language,
    "op11_cross_tokenizer_alignment": cross_tokenizer_alignment,
    "op12_spelling_variants": spelling_variants,
    "op13_html_extraction": html_extraction,
}

ORACLES: dict[str, str] = {
    "op2_line_frequency": lines.ORACLE,
    "op9_url_language_models": urls.ORACLE,
}
