"""The normaliser as a table operator: evasion-free text plus what had to be undone."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import batches, decode, text
from wardline.session import small_batches

Translator = Callable[[list[str]], list[str]]


def translate_non_latin(c: Column, language: Column, translator: Translator | None) -> Column:
    """Send only texts in another script (or a mix) through ``translator``; failures keep the text."""
    if translator is None:
        return c

    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        out = batch.copy()
        todo = batch[batch.notna()]

        def ask(texts: list[str]) -> list:
            """Answers in order; None for each text if the translator fails."""
            try:
                got = list(translator(texts))
                return got if len(got) == len(texts) else [None] * len(texts)
            except Exception:  # a failing translator must not fail the job
                return [None] * len(texts)

        got = ask(todo.tolist()) if len(todo) else []
        if len(todo) > 1 and not any(got):
            got = [ask([t])[0] for t in todo]  # one bad text must not spoil its batch
        for at, answer in zip(todo.index, got):
            if answer and answer.strip():
                out[at] = answer
        return out

    return F.coalesce(run(F.when(~language.isin("latin", "other"), c)), c)


def normalize_prompts(
    df: DataFrame,
    col: str = "text",
    translator: Translator | None = None,
    compat: bool = True,
) -> DataFrame:
    """Add ``norm``: struct(text, original_length, normalized_length, edit_distance_ratio,
    language, evasion_detected, evasion_techniques).

    ``compat`` as in :func:`normal_parts`."""
    stages, parts = normal_parts(df, col, translator, compat)
    return stages.select(*[F.col(f"`{n}`") for n in df.columns], F.struct(*parts).alias("norm"))


def normal_parts(
    df: DataFrame, col: str = "text", translator: Translator | None = None, compat: bool = True
) -> tuple[DataFrame, list[Column]]:
    """``df`` with the stages of the normaliser, and the named parts of ``norm`` over it; those that nobody selects are
    not computed.

    ``compat`` reports any irregular white space as leetspeak (the word pass re-joins words by
    single blanks); otherwise only changed words count.
    """
    small_batches(df.sparkSession)
    raw = F.col(col)
    rest = [F.col(f"`{n}`") for n in df.columns]
    short = raw.isNull() | (F.length(raw) < 3)

    # Each stage is its own projection and refers to the one before by name, so Catalyst
    # keeps them apart and no text step is evaluated twice.  Two passes over Arrow batches do the steps
    # that are exact there and name the texts that the others may change.
    a = df.select(*rest, batches.unveiled(raw).alias("_a"))
    a = a.withColumn("_s1", F.coalesce("_a.text", raw))
    s1, s2, s3, turned = (F.col(n) for n in ("_s1", "_s2", "_s3", "_turned"))
    b = a.withColumn("_s2", F.when(F.col("_a.base64"), decode.decode_base64_segments(s1, F.lit(True))).otherwise(s1))
    # what an earlier step changed is tested again
    may_hex = F.when(s2 == s1, F.col("_a.hex")).otherwise(s2.rlike(decode.MAYBE_HEX))
    b = b.withColumn("_s3", F.when(may_hex, decode.decode_hex_segments(s2, F.lit(True))).otherwise(s2))
    c = b.withColumn("_turned", F.when(F.col("_a.rot13") | (s3 != s1), text.rot13_if_keyword(s3)).otherwise(s3))
    done = {
        "turned": turned, "invisible": F.col("_a.invisible"), "unicode": F.col("_a.unicode"), "url": F.col("_a.url"),
        "base64": s2 != s1, "hex": s3 != s2, "rot13": turned != s3,
    }
    # explode over one element keeps the two passes, and the steps between them, apart
    d = c.select(*rest, F.explode(F.array(F.struct(*[v.alias(k) for k, v in done.items()]))).alias("_d"))
    turned = F.col("_d.turned")
    d = d.withColumn("_w", batches.worded(turned))
    d = d.withColumn("_letters", F.when(F.col("_w.unsure"), text.reverse_leet(turned)).otherwise(F.coalesce("_w.text", turned)))
    e = d.withColumn("_lang", F.when(F.col("_w.scripts"), text.dominant_script(F.col("_letters"))).otherwise("latin"))
    before_leet = turned if compat else text.collapse_spaces(turned)
    flags = [
        (F.col("_d.invisible"), F.lit("invisible_chars")),
        (F.col("_d.unicode"), F.lit("unicode_confusables")),
        (F.col("_d.url"), F.lit("url_encoding")),
        (F.col("_d.base64"), F.lit("base64_encoding")),
        (F.col("_d.hex"), F.lit("hex_encoding")),
        (F.col("_d.rot13"), F.lit("rot13")),
        (F.col("_letters") != before_leet, F.lit("leetspeak")),
        (
            ~F.col("_lang").isin("latin", "other"),
            F.concat(F.lit("non_latin_script:"), F.col("_lang")),
        ),
    ]
    techniques = F.array_compact(
        F.array(*[F.when(F.coalesce(on, F.lit(False)), name) for on, name in flags])
    )
    # explode over one element: a filter on the result must not be pushed below this point, where
    # Catalyst would spell out every stage once per mention.
    stages = F.struct(F.col("_letters").alias("text"), F.col("_lang").alias("lang"), techniques.alias("tech"))
    g = e.select(*rest, F.explode(F.array(stages)).alias("_n"))
    if translator is not None:
        g = g.withColumn("_final", translate_non_latin(F.col("_n.text"), F.col("_n.lang"), translator))
    final = F.col("_n.text" if translator is None else "_final")

    def unless_short(short_value, value: Column) -> Column:
        return F.when(short, short_value).otherwise(value)

    nothing = F.lit(None)
    return g, [
        unless_short(raw, final).alias("text"),
        unless_short(nothing, F.length(raw)).alias("original_length"),
        unless_short(nothing, F.length(final)).alias("normalized_length"),
        unless_short(nothing, text.edit_ratio(raw, final)).alias("edit_distance_ratio"),
        unless_short(F.lit("latin"), F.col("_n.lang")).alias("language"),
        unless_short(F.lit(False), F.size("_n.tech") > 0).alias("evasion_detected"),
        unless_short(F.array().cast("array<string>"), F.col("_n.tech")).alias("evasion_techniques"),
    ]


def evasion_events(normalized: DataFrame, col: str = "text") -> DataFrame:
    """One high-severity ``evasion_attempt`` event per evasive prompt."""
    return normalized.filter("norm.evasion_detected").select(
        *[c for c in normalized.columns if c not in (col, "norm")],
        F.lit("evasion_attempt").alias("action"),
        F.lit("high").alias("severity"),
        F.array_join("norm.evasion_techniques", ", ").alias("evasion_techniques"),
        F.col("norm.language").alias("language"),
        F.col("norm.edit_distance_ratio").alias("edit_distance_ratio"),
        F.substring(col, 1, 200).alias("original_preview"),
        F.substring("norm.text", 1, 200).alias("normalized_preview"),
    )
