"""From raw documents to packed training sequences, in four stages.

Each stage takes ``(spark, docs, sf_dir)``, works on every row its predecessor kept and returns a
DataFrame; all but the last return the columns of ``documents``.  ``run`` writes each stage's rows to
the shared scratch folder and reads them back for the next one.
"""

from __future__ import annotations

import public_tokenizers as vocabularies
from pyspark.sql import DataFrame, SparkSession

from wardline.llm import language, neardup, packing, quality
from wardline.llm.catalog import WORD_BPE
from wardline.llm.common import prepare, table
from wardline.session import landed


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language the classifier recognises."""
    known = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language.reject(docs, language.fit(language.training_rows(known)))


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that score at least the quality threshold; learned from all labelled documents."""
    known = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = quality.training_labels(table(spark, sf_dir, "labels"), "quality")
    return quality.reject(docs, quality.fit(quality.with_features(known), labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: five-word shingles, likeness 0.8 or more."""
    prepare(spark)
    return neardup.one_of_each(docs, neardup.Likeness(words=5, percent=80))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences."""
    prepare(spark)
    return packing.pack(docs, vocabularies.path(WORD_BPE))


STAGES = [
    ("language", identify_language),
    ("quality", judge_quality),
    ("near-duplicates", drop_near_duplicates),
    ("packing", pack),
]

#: Tokens, hashes of floats and graph components are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = landed(docs, f"pipeline-{name}")
    return docs
