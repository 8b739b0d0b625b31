"""Shannon entropy and the obfuscation test, as native expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline import vocab as V
from wardline.functions.text import let, words


def shannon_entropy(c: Column) -> Column:
    """Bits per character; the empty string has none.

    Sorting the characters turns equal ones into runs, so one scan counts them all.
    """
    in_order = F.array_join(F.sort_array(F.split(c, "")), "")
    runs = F.regexp_extract_all(in_order, F.lit(r"(?s)(.)\1*"), F.lit(0))

    def total(n: Column) -> Column:
        terms = F.transform(runs, lambda run: F.length(run) / n)
        return F.aggregate(terms, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))

    return F.when(c == "", F.lit(0.0)).otherwise(let(F.length(c), total))


def _can_reach(c: Column, threshold: float) -> Column:
    """Entropy never exceeds log2(distinct characters): a cheap exact pre-test."""
    need = math.ceil(2**threshold - 1e-9)
    return F.size(F.array_distinct(F.split(c, ""))) >= need


def windows(c: Column) -> Column:
    """Overlapping windows (80 characters every 40), built by gluing neighbouring blocks.

    ``substring`` would rescan the text from its start for every window; blocks are cut once.
    """
    blocks = F.regexp_extract_all(c, F.lit(f"(?s)(.{{1,{V.ENTROPY_STEP}}})"), F.lit(1))
    count = F.ceil((F.length(c) - V.ENTROPY_TAIL) / V.ENTROPY_STEP).cast("int")
    nxt = F.concat(F.slice(blocks, 2, F.greatest(F.size(blocks), F.lit(1))), F.array(F.lit("")))
    glued = F.zip_with(blocks, nxt, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(
        F.length(c) > V.ENTROPY_TAIL, F.slice(glued, 1, F.greatest(count, F.lit(0)))
    ).otherwise(F.array().cast("array<string>"))


def _first_over(candidates: Column, threshold: float) -> Column:
    scored = F.transform(
        F.filter(candidates, lambda s: _can_reach(s, threshold)),
        lambda s: F.struct(shannon_entropy(s).alias("h"), s.alias("s")),
    )
    return F.get(F.filter(scored, lambda x: x["h"] >= threshold), F.lit(0))


def entropy_violation(
    c: Column, threshold: float = V.ENTROPY_THRESHOLD, min_length: int = V.ENTROPY_MIN_LENGTH, may: Column | None = None
) -> Column:
    """struct(flagged, score, snippet): first long word, else first window, over the threshold.

    ``may``: a test that holds wherever something is over it."""
    long_words = F.filter(words(c), lambda w: F.length(w) >= min_length)
    hit = F.coalesce(
        _first_over(long_words, threshold),
        F.when(F.length(c) >= min_length, _first_over(windows(c), threshold)),
    )
    return let(
        hit if may is None else F.when(may, hit),
        lambda h: F.struct(
            h.isNotNull().alias("flagged"),
            F.coalesce(F.round(h["h"], 2), F.lit(0.0)).alias("score"),
            F.coalesce(F.substring(h["s"], 1, V.ENTROPY_WINDOW), F.lit("")).alias("snippet"),
        ),
    )
