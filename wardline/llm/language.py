"""Language identification with a string kernel.

A text is the set of its character 1- to 3-grams (lower-cased, hashed into ``2**BITS`` slots: a
blended-spectrum presence kernel, normalised to the cosine of the two sets).  Landmarks give a
Nystroem map, one ridge regression per language is solved in it, and because every step after the
presence vector is linear, map and weights fold into one matrix: scoring a batch is one product.

The model is fitted on ``per_language`` rows of every language (those of smallest hash; all rows of a
language that has fewer), with the same number of landmarks for each; a sampled row travels as a bitmap
of ``2**BITS`` bits, never as text.

Defined results: NULL text, and text without a letter, is ``und`` with score 0; so is every text if
no labelled row exists.  Ties go to the language that sorts first.  Repeated rows are scored alike.
Texts are read whole.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.common import fold, release_memory, text_udf

BITS = 15
UNKNOWN = "und"
#: Texts whose presence vectors are held at once.
ROWS = 64
#: The hash filter before the exact choice of rows lets so many times the wanted rows of a language pass.
SLACK = 4


def gram_slots(text: str) -> np.ndarray:
    """Slots of all 1-, 2- and 3-grams of a text, with repeats."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    shift = np.uint32(32 - BITS)
    one = c * np.uint32(2654435761)
    two = (one[:-1] ^ np.uint32(0x9E3779B9)) * np.uint32(2246822519) + one[1:]
    three = (two[:-1] ^ np.uint32(0x85EBCA6B)) * np.uint32(3266489917) + one[2:]
    return np.concatenate([(g * np.uint32(2654435769)) >> shift for g in (one, two, three)])


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def presence(texts: list[str]) -> np.ndarray:
    x = np.zeros((len(texts), 1 << BITS), dtype=np.float32)
    for row, text in zip(x, texts):
        row[gram_slots(text)] = 1
    return x


def _bitmaps():
    def fn(texts):
        return pa.array(
            [np.packbits(presence([t])[0].astype(bool)).tobytes() if has_letter(t) else None for t in texts],
            pa.binary(),
        )

    return fn


class Model:
    """``weights`` maps a normalised presence vector to one response per language."""

    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray):
        self.languages, self.weights, self.bias = languages, weights, bias

    def responses(self, texts: list[str]) -> np.ndarray:
        out = np.empty((len(texts), len(self.languages)), dtype=np.float32)
        for i in range(0, len(texts), ROWS):
            x = presence(texts[i : i + ROWS])
            out[i : i + ROWS] = (x @ self.weights) / np.sqrt(x.sum(1))[:, None]
        return out + self.bias


def _unpacked(x: np.ndarray, rows) -> np.ndarray:
    """Normalised rows of presence vectors, or of bitmaps."""
    part = (np.unpackbits(x[rows], axis=1) if x.dtype == np.uint8 else x[rows]).astype(np.float32)
    return part / np.sqrt(part.sum(1, keepdims=True))


def solve(x: np.ndarray, lang: list[str], landmarks: int = 32, ridge: float = 1e-3) -> Model:
    """Kernel ridge regression, one against the rest, on Nystroem features of presence rows (or bitmaps) ``x``.
    The first ``landmarks`` rows of each language are landmarks."""
    names = sorted(set(lang))
    at = {n: i for i, n in enumerate(names)}
    seen: dict[str, int] = {}
    turn = []
    for i, v in enumerate(lang):
        seen[v] = seen.get(v, 0) + 1
        turn.append((seen[v], i))
    marks = _unpacked(x, [i for nth, i in sorted(turn) if nth <= landmarks])
    value, vector = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = value > 1e-6 * value[-1]
    root = vector[:, good] / np.sqrt(value[good])
    phi = np.concatenate([
        (_unpacked(x, slice(i, i + ROWS)) @ marks.T).astype(np.float64) @ root for i in range(0, len(x), ROWS)
    ])
    centre, mean = phi.mean(0), np.array([seen[n] for n in names]) / len(x)
    phi -= centre
    y = np.zeros((len(x), len(names)))
    y[np.arange(len(x)), [at[v] for v in lang]] = 1
    a = phi.T @ phi + ridge * len(x) * np.eye(phi.shape[1])
    w = np.linalg.solve(a, phi.T @ (y - mean))
    return Model(names, (marks.T @ (root @ w)).astype(np.float32), (mean - centre @ w).astype(np.float32))


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = 200) -> Model | None:
    """Fit on the ``per_language`` labelled rows of smallest hash of every language.  ``key`` only seeds the
    choice of rows."""
    order = F.xxhash64(F.col(key).cast("string"), F.col(text))
    rows = rows.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        F.col(lang).alias("lang"), order.alias("order"), F.col(text).alias("text")
    )
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    first = Window.partitionBy("lang").orderBy("order")

    def chosen(shares: dict[str, float]) -> list:
        # One row for each language, which the driver holds anyway.
        share = F.broadcast(rows.sparkSession.createDataFrame(list(shares.items()), "lang string, share double"))
        return (
            rows.join(share, "lang").where(F.pmod("order", F.lit(1 << 30)) < F.col("share") * (1 << 30))
            .withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= per_language)
            .select("lang", "order", text_udf(_bitmaps, "binary")(F.col("text")).alias("bits"))
            .where("bits is not null").collect()
        )

    sample = chosen({v: min(1.0, SLACK * per_language / n) for v, n in counts.items()})
    got = Counter(r["lang"] for r in sample)
    # Repeated rows have one hash, so the filter can miss too many of them.
    short = {v: 1.0 for v, n in counts.items() if n > SLACK * per_language and got[v] < per_language}
    if short:
        sample = [r for r in sample if r["lang"] not in short] + chosen(short)
    if not sample:
        return None
    sample.sort(key=lambda r: (r["lang"], r["order"]))
    return solve(np.stack([np.frombuffer(r["bits"], dtype=np.uint8) for r in sample]), [r["lang"] for r in sample])


def predictor(model: Model | None):
    """Column function: text -> struct(lang_pred string, score double)."""

    def make():
        release_memory()

        def fn(texts):
            rows = [i for i, t in enumerate(texts) if model is not None and has_letter(t)]
            lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            if rows:
                f = model.responses([texts[i] for i in rows])
                for i, best, top in zip(rows, f.argmax(1), f.max(1)):
                    lang[i], score[i] = model.languages[best], float(min(1.0, max(0.0, top)))
            return pa.StructArray.from_arrays(
                [pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["lang_pred", "score"]
            )

        return fn

    return text_udf(make, "lang_pred string, score double")


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(fold(F.col("doc_id"), 4) != 2)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    return docs.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"),
        predictor(model)(F.col("text")).alias("_p"),
    ).select("doc_id", "held_out", "_p.lang_pred", "_p.score")


def reject(docs: DataFrame, model: Model | None, least: float = 0.3) -> DataFrame:
    """Keep the rows whose language is recognised with a response of at least ``least``."""
    p = predictor(model)(F.col("text"))
    return docs.where((p["lang_pred"] != UNKNOWN) & (p["score"] >= least))
