"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a Gaussian over ``FEATURES`` numbers per document, with a covariance shrunk towards
the pooled one and then towards a multiple of the identity.  A score is the logistic of the
difference of log densities (Mahalanobis distances through cached Cholesky factors) plus the log
prior odds.  Class moments are sums over all labelled rows: each task adds up its rows and Spark sums
the partial sums by position, so nothing but ``FEATURES**2`` numbers per class reaches the driver.

Defined results: NULL text counts as empty text, which is scored like any other.  A document with
several labels counts once for each.  If a class has no labelled row, every score is the share of
class 1 among the labelled rows (0.5 if there is none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import fold, release_memory, text_udf
from wardline.session import landed

FEATURES = 18
THRESHOLD = 0.3
_MARKS = np.frombuffer(b"#*$%&<>@^~=_+\\", dtype=np.uint8)


def statistics(text: str | None) -> np.ndarray:
    """The transformed statistics of one whole text."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    n = np.bincount(raw, minlength=256)
    size = max(1, len(raw))
    upper, digits, spaces = n[65:91].sum(), n[48:58].sum(), n[32] + n[9:14].sum()
    words = text.split()
    w = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    lines = [x for x in text.split("\n") if x.strip()]
    k = max(1, len(lines))
    root = np.sqrt
    return np.array([
        np.log1p(len(words)),
        root(n[_MARKS].sum() / size),
        root(n[124] / size),
        root(n[33] / size),
        root(upper / size),
        root(digits / size),
        root(n[44] / size),
        root(n[46] / size),
        root((n[33:48].sum() + n[58:65].sum() + n[91:97].sum() + n[123:127].sum()) / size),
        spaces / size,
        np.log1p(len(set(words)) * 1.0) - np.log1p(len(words)),
        np.log1p(len(set(zip(words, words[1:]))) * 1.0) - np.log1p(max(0, len(words) - 1)),
        np.log(lengths.mean() + 1),
        np.log(lengths.std() + 1),
        np.log(lengths.max() + 1),
        np.log1p(len(lines)) - np.log1p(len(words)),
        root(1 - len(set(lines)) / k if lines else 0.0),
        root(n[128:].sum() / size),
    ], dtype=np.float64)


def _features():
    release_memory()

    def fn(texts):
        return pa.array([statistics(t) for t in texts], pa.list_(pa.float64()))

    return fn


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and the statistics of each row."""
    return docs.select("doc_id", text_udf(_features, "array<double>")(F.col(text)).alias("x"))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, list] = {}
    for b in batches:
        if not b.num_rows:
            continue
        x = np.asarray(b.column(1).flatten()).reshape(-1, FEATURES)
        y = np.asarray(b.column(0))
        for c in (0, 1):
            z = x[y == c]
            if len(z):
                s = sums.setdefault(c, [0, np.zeros(FEATURES), np.zeros((FEATURES, FEATURES))])
                s[0] += len(z)
                s[1] += z.sum(0)
                s[2] += z.T @ z
    for c, (n, s, ss) in sums.items():
        v = np.concatenate([[n], s, ss.ravel()])
        yield pa.RecordBatch.from_arrays(
            [pa.array([c] * len(v), pa.int32()), pa.array(range(len(v)), pa.int32()), pa.array(v)], ["y", "at", "v"]
        )


class Model:
    def __init__(self, means, factors, log_odds: float, constant: float | None = None):
        self.means, self.factors, self.log_odds, self.constant = means, factors, log_odds, constant

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for the rows of ``x``."""
        if self.constant is not None:
            return np.full(len(x), self.constant)
        logs = []
        for mean, (inverse, log_det) in zip(self.means, self.factors):
            z = (x - mean) @ inverse.T
            logs.append(-0.5 * (z * z).sum(1) - 0.5 * log_det)
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0] + self.log_odds, -40, 40)))


def solve(sums: dict[int, np.ndarray], pooled_share: float = 0.1, identity_share: float = 0.02) -> Model:
    """Model from per-class sums (count, sum, sum of outer products)."""
    n = {c: sums[c][0] if c in sums else 0.0 for c in (0, 1)}
    if not n[0] or not n[1]:
        return Model(None, None, 0.0, n[1] / (n[0] + n[1]) if n[0] + n[1] else 0.5)
    mean, cov = {}, {}
    for c in (0, 1):
        s, ss = sums[c][1 : 1 + FEATURES], sums[c][1 + FEATURES :].reshape(FEATURES, FEATURES)
        mean[c] = s / n[c]
        cov[c] = ss / n[c] - np.outer(mean[c], mean[c])
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-8))
    factors = []
    for c in (0, 1):
        own = (1 - pooled_share) * cov[c] + pooled_share * pooled
        own = own / np.outer(scale, scale)
        own = (1 - identity_share) * own + identity_share * np.eye(FEATURES)
        chol = np.linalg.cholesky(own)
        inverse = np.linalg.inv(chol) / scale
        factors.append((inverse, 2 * np.log(np.diag(chol)).sum()))
    return Model([mean[0], mean[1]], factors, float(np.log(n[1] / n[0])))


def fit(features: DataFrame, labels: DataFrame) -> Model:
    """Fit on all labelled rows.  ``features``: doc_id, x.  ``labels``: doc_id, y (0 or 1)."""
    rows = labels.where("y in (0, 1)").select("doc_id", F.col("y").cast("int").alias("y")).join(features, "doc_id").select("y", "x")
    parts = rows.mapInArrow(_moments, "y int, at int, v double").groupBy("y", "at").agg(F.sum("v").alias("v")).collect()
    sums: dict[int, np.ndarray] = {}
    for r in parts:
        sums.setdefault(r["y"], np.zeros(1 + FEATURES + FEATURES * FEATURES))[r["at"]] = r["v"]
    return solve(sums)


def training_labels(labels: DataFrame, name: str) -> DataFrame:
    """Labels that may be learned from: those of the rows outside the held-out fold."""
    return labels.where(fold(F.col("doc_id"), 5) != 0).select("doc_id", F.col(name).alias("y"))


def scorer(model: Model, of_features: bool = False):
    """Column function: text (or its statistics) -> score."""

    def make():
        release_memory()

        def fn(values):
            x = np.array([v if of_features else statistics(v) for v in values]).reshape(-1, FEATURES)
            return pa.array(model.scores(x), pa.float64())

        return fn

    return text_udf(make, "double")


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; texts are read once, their statistics landed."""
    features = landed(with_features(docs), "quality-statistics")
    model = fit(features, training_labels(labels, "quality"))
    return features.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
        scorer(model, of_features=True)(F.col("x")).alias("score"),
    ).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """Keep the rows that score at least the threshold."""
    return docs.where(scorer(model)(F.col("text")) >= THRESHOLD)
