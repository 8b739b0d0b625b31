"""Exact histogram of encoded lengths, and what its suffix sums answer.

Documents become one row per distinct length (counted before the shuffle).  Suffix sums run in two
levels, inside slots of ``SLOT`` lengths and over the slots, so no task holds more than one slot's
lengths or one row per slot.  For a context limit L the row of the smallest length >= L gives:
documents and tokens at or above L, the tokens left after truncation to L, and the share of documents
that fit.

Defined results: NULL text counts as empty text, of length 0.  An empty table has no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.common import text_udf
from wardline.llm.tokens import byte_bpe
from wardline.session import landed

SLOT = 1024


def n_tokens(vocabulary: str, pattern: str):
    """Column function: text -> number of tokens of the whole text."""

    def make():
        bpe = byte_bpe(vocabulary, pattern)
        return lambda texts: pa.array([len(bpe.encode(t or "")) // 4 for t in texts], pa.int64())

    return text_udf(make, "bigint")


def histogram(docs: DataFrame, length) -> DataFrame:
    """n_tokens, n_docs: documents of each length."""
    return docs.select(length.alias("n_tokens")).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each length taken as a context limit: n_docs of that length, docs_at_least, tokens_at_least,
    docs_total, tokens_total, truncated_tokens and share_fitting (documents of at most that length)."""
    h = hist.select("n_tokens", "n_docs", F.floor(F.col("n_tokens") / SLOT).alias("_slot"))
    tokens = F.col("n_tokens") * F.col("n_docs")
    slots = h.groupBy("_slot").agg(F.sum("n_docs").alias("_d"), F.sum(tokens).alias("_t"))
    above = Window.orderBy(F.desc("_slot")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    slots = slots.select(
        "_slot",
        F.coalesce(F.sum("_d").over(above), F.lit(0)).alias("_da"),
        F.coalesce(F.sum("_t").over(above), F.lit(0)).alias("_ta"),
        F.sum("_d").over(everything).alias("docs_total"),
        F.sum("_t").over(everything).alias("tokens_total"),
    )
    inside = Window.partitionBy("_slot").orderBy(F.desc("n_tokens"))
    r = h.join(slots, "_slot").select(
        "n_tokens", "n_docs",
        (F.sum("n_docs").over(inside) + F.col("_da")).alias("docs_at_least"),
        (F.sum(tokens).over(inside) + F.col("_ta")).alias("tokens_at_least"),
        "docs_total", "tokens_total",
    )
    return r.withColumn(
        "truncated_tokens",
        F.col("tokens_total") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least"),
    ).withColumn(
        "share_fitting",
        (F.col("docs_total") - F.col("docs_at_least") + F.col("n_docs")) / F.col("docs_total"),
    )


def at_limit(sums: DataFrame, limit: int) -> DataFrame:
    """One row for any context limit: docs_at_least, tokens_at_least, truncated_tokens (no row if the
    table was empty).  Lengths at or above the limit are cut to it."""
    total = sums.agg(F.max("tokens_total").alias("t"), F.max("docs_total").alias("d"))
    first = (
        sums.where(F.col("n_tokens") >= limit).orderBy("n_tokens").limit(1)
        .select(F.col("docs_at_least").alias("a"), F.col("tokens_at_least").alias("b"))
        .agg(F.coalesce(F.max("a"), F.lit(0)).alias("docs_at_least"), F.coalesce(F.max("b"), F.lit(0)).alias("tokens_at_least"))
    )
    one = F.lit(1).alias("_k")
    return (
        first.select(one, "*").join(total.where("d is not null").select(one, "t"), "_k")
        .select("docs_at_least", "tokens_at_least",
                (F.col("t") - F.col("tokens_at_least") + limit * F.col("docs_at_least")).alias("truncated_tokens"))
    )


def quantile(sums: DataFrame, share: float) -> DataFrame:
    """The smallest length that at least ``share`` of the documents do not exceed."""
    return sums.where(F.col("share_fitting") >= share).agg(F.min("n_tokens").alias("n_tokens"))


def report(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    return suffix_sums(landed(histogram(docs, n_tokens(vocabulary, pattern)(F.col("text"))), "length-histogram"))
