"""Injection scoring with a pluggable scorer, and a Spark ML model to plug in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline import vocab as V
from wardline.functions.text import let

#: Called once per Python worker; returns the function that scores a batch (0..1 per text).
ScorerFactory = Callable[[], Callable[[pd.Series], pd.Series]]


#: Characters that neighbouring windows share, more than the longest tell-tale word.
OVERLAP = 64


def lexical_score(c: Column, width: int = V.INJECTION_CHARS) -> Column:
    """Stand-in when no model is supplied, in built-in functions: in each window of a text every distinct
    tell-tale word halves the doubt; the worst window counts."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(c) - 1, F.lit(0)), F.lit(width - OVERLAP))

    def score(low: Column) -> Column:
        n = sum((low.contains(w).cast("int") for w in V.ROT13_KEYWORDS), F.lit(0))
        return F.lit(1.0) - F.pow(F.lit(0.5), n)

    return F.array_max(F.transform(starts, lambda i: let(F.lower(F.substr(c, i + 1, F.lit(width))), score)))


def injection_score(c: Column, factory: ScorerFactory | None = None, width: int = V.INJECTION_CHARS) -> Column:
    """Highest score over the overlapping ``width``-character windows of each text; without a factory the
    native :func:`lexical_score`."""
    if factory is None:
        return lexical_score(c, width)
    step = width - OVERLAP

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = factory()
        for texts in batches:
            out = pd.Series([None] * len(texts), index=texts.index, dtype="float64")
            todo = texts[texts.notna()]
            if len(todo):
                pieces = todo.map(
                    lambda t: [t[i : i + width] for i in range(0, max(1, len(t)), step)]
                ).explode()
                best = pd.Series(score(pieces.reset_index(drop=True)).to_numpy(dtype=float))
                out.loc[todo.index] = best.groupby(pieces.index.to_numpy()).max().loc[todo.index]
            yield out

    return run(c)


def score_injection(
    df: DataFrame,
    col: str = "text",
    factory: ScorerFactory | None = None,
    threshold: float = V.INJECTION_THRESHOLD,
    part: str = "whole",
) -> DataFrame:
    """Add label, injection_score, safe_score, blocked.

    ``part``: ``whole`` scores overlapping 512-character windows and keeps the worst; ``head`` only the
    first window, ``tail`` only the first window of the last 1024 characters (what an in-line
    gateway with a latency budget reads).  Texts of ten characters or fewer are safe unasked.
    """
    text = F.col(col)
    if part == "tail":
        cut = V.MESSAGE_TAIL_CHARS
        text = F.when(F.length(text) > cut, F.substring(text, -cut, cut)).otherwise(text)
    if part in ("head", "tail"):
        text = F.substring(text, 1, V.INJECTION_CHARS)
    asked = F.when(F.length(text) > V.INJECTION_MIN_CHARS, text)
    scored = df.withColumn("_s", injection_score(asked, factory))
    s = F.col("_s")
    blocked = F.coalesce(s >= threshold, F.lit(False))
    return scored.select(
        *df.columns,
        F.when(s.isNull(), "safe").when(blocked, "INJECTION").otherwise("SAFE").alias("label"),
        F.coalesce(F.round(s, 4), F.lit(0.0)).alias("injection_score"),
        F.coalesce(F.round(F.lit(1.0) - s, 4), F.lit(1.0)).alias("safe_score"),
        blocked.alias("blocked"),
    )


def train_injection_model(
    labelled: DataFrame, col: str = "text", label: str = "label", features: int = 1 << 14
) -> PipelineModel:
    """Word counts into a logistic regression; ``label`` is INJECTION or SAFE."""
    data = labelled.select(
        F.col(col).alias("text"), (F.col(label) == "INJECTION").cast("double").alias("y")
    )
    stages = [
        RegexTokenizer(inputCol="text", outputCol="_words", pattern=r"\W+"),
        HashingTF(inputCol="_words", outputCol="_x", numFeatures=features),
        LogisticRegression(featuresCol="_x", labelCol="y", maxIter=20, regParam=0.01),
    ]
    return Pipeline(stages=stages).fit(data)


def apply_injection_model(
    model: PipelineModel, df: DataFrame, col: str = "text", threshold: float = V.INJECTION_THRESHOLD
) -> DataFrame:
    """JVM-side scoring with the trained model, in the columns of :func:`score_injection`."""
    src = df if col == "text" else df.withColumn("text", F.col(col))
    kept = [c for c in df.columns if c != "text"]
    out = model.transform(src)
    p = vector_to_array(F.col("probability"))[1]
    return out.select(
        *kept,
        F.when(p >= threshold, "INJECTION").otherwise("SAFE").alias("label"),
        F.round(p, 4).alias("injection_score"),
        F.round(F.lit(1.0) - p, 4).alias("safe_score"),
        (p >= threshold).alias("blocked"),
    )
