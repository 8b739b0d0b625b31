"""Decoding steps: NFKC, percent, base64 and hex runs.

A text is cut at the runs a step may decode, the runs are decoded as arrays of bytes, and the pieces are joined
again, all in built-in expressions.  Only NFKC has none: texts that hold a character beyond ASCII cross
to Python in one Arrow UDF, the others never do; a pattern that tells which of them may change costs more than the
crossing.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from wardline import vocab as V
from wardline.functions.text import fold_confusables, is_wide, let, runs_replaced, spans

#: Java reads these as the rules were written: only ``\n`` ends a line, white space is Unicode's.
_LINES = "(?d)"
_BASE64 = _LINES + V.BASE64_SEGMENT.replace(r"\s", spans(V.SPACE_CLASS))
#: Possessive, so that a run of any length needs no stack; pairs and separators cannot be told apart in two ways.
_HEX = V.HEX_SEGMENT.replace(r"[:\s]?", f"[:{spans(V.SPACE_CLASS)}]?+").replace("{7,}", "{7,}+")
#: What every such run holds, tried first: neither looks at what may stand around a run.
_MAYBE_BASE64 = "[A-Za-z0-9+/]{20}"
MAYBE_HEX = f"[0-9a-fA-F]{{2}}(?:[:{spans(V.SPACE_CLASS)}]?[0-9a-fA-F]{{2}}){{7}}"
_PERCENT = "(?:%[0-9A-Fa-f]{2})++"
#: One UTF-8 character in hex digits; any other byte alone.
_TAIL = "[89AB][0-9A-F]"
VALID = (
    "[0-7][0-9A-F]"
    f"|(?:C[2-9A-F]|D[0-9A-F]){_TAIL}"
    f"|E0[AB][0-9A-F]{_TAIL}|E[1-9ABCEF]{_TAIL}{_TAIL}|ED[89][0-9A-F]{_TAIL}"
    f"|F0[9AB][0-9A-F]{_TAIL}{_TAIL}|F[1-3]{_TAIL}{_TAIL}{_TAIL}|F48[0-9A-F]{_TAIL}{_TAIL}"
)
#: What a readable text may hold: letters, marks, numbers, punctuation, symbols and white space.  Emoji that the
#: running Java does not know yet are readable too.
_UNREADABLE = "[^\\p{L}\\p{M}\\p{N}\\p{P}\\p{S}\\p{Z}\\t\\n\\x0B\\f\\r\\x1c-\\x1f\\x85\\x{1F000}-\\x{1FBFF}]"

STEPS = ("unicode", "url", "base64", "hex")


@F.arrow_udf(StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    """NFKC of the texts that it changes, else NULL."""
    kept = lambda t: t is None or unicodedata.is_normalized("NFKC", t)
    return pa.array([None if kept(t) else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


def compatible(c: Column) -> Column:
    """NFKC."""
    return F.coalesce(_nfkc(F.when(is_wide(c), c)), c)


def nfkc(c: Column) -> Column:
    """NFKC, then lookalike letters."""
    return fold_confusables(compatible(c))


def _readable(digits: Column) -> Column:
    """The text of bytes in hex digits, bytes that are no UTF-8 left out; NULL unless it reads as text."""
    characters = F.filter(F.regexp_extract_all(F.upper(digits), F.lit(f"{VALID}|.."), F.lit(0)), lambda x: (F.length(x) > 2) | (x < "80"))
    text = F.unhex(F.array_join(characters, "")).cast("string")
    return let(text, lambda t: F.when((t != "") & ~t.rlike(_UNREADABLE), F.concat(F.lit(" "), t, F.lit(" "))))


def percent_decode(c: Column) -> Column:
    """Percent runs as UTF-8; broken characters become U+FFFD."""
    return runs_replaced(c, _PERCENT, lambda run: F.make_valid_utf8(F.unhex(F.replace(run, F.lit("%"), F.lit(""))).cast("string")))


def decode_base64_segments(c: Column, may: Column | None = None) -> Column:
    """Base64 runs that read as text; runs of a wrong length or padding stay.

    ``may``: a test that holds wherever such a run stands."""

    def one(run: Column) -> Column:
        data, pads = F.regexp_extract(run, "[A-Za-z0-9+/]{20,}", 0), F.regexp_extract(run, "[A-Za-z0-9+/]{20,}(=*)", 1)
        over = F.length(data) % 4
        sound = (over == 0) | ((over == 2) & (F.length(pads) == 2)) | ((over == 3) & (F.length(pads) >= 1))
        full = F.concat(data, F.when(over == 2, "==").when(over == 3, "=").otherwise(""))
        return F.when(sound, _readable(F.hex(F.unbase64(full))))

    return runs_replaced(c, _BASE64, one, c.rlike(_MAYBE_BASE64) if may is None else may)


def decode_hex_segments(c: Column, may: Column | None = None) -> Column:
    """Hex runs that read as text, with colons or ASCII blanks between the pairs; ``may`` as for base64."""

    def one(run: Column) -> Column:
        digits = F.regexp_replace(F.regexp_replace(run, r"^(?:0x|\\x)", ""), r"[: \t\n\x0B\f\r]", "")
        return F.when(digits.rlike("^[0-9a-fA-F]+$"), _readable(digits))

    return runs_replaced(c, _HEX, one, c.rlike(MAYBE_HEX) if may is None else may)


def decoded(df: DataFrame, col: str, keep: list, out: str = "_d") -> DataFrame:
    """``keep`` and ``out``: struct(text, unicode, url, base64, hex) of ``col``.

    Each step is a projection of its own that names the one before, so no text step is evaluated twice."""
    cur = df.withColumn("_s0", nfkc(F.col(col)))
    for i, step in enumerate((percent_decode, decode_base64_segments, decode_hex_segments)):
        cur = cur.withColumn(f"_s{i + 1}", step(F.col(f"_s{i}")))
    changed = [F.col("_s0") != F.col(col), *[F.col(f"_s{i + 1}") != F.col(f"_s{i}") for i in range(3)]]
    # explode over one element keeps the steps from being spelled out once per mention further up
    made = F.struct(F.col("_s3").alias("text"), *[F.coalesce(on, F.lit(False)).alias(name) for on, name in zip(changed, STEPS)])
    return cur.select(*keep, F.explode(F.array(made)).alias(out))
