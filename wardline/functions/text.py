"""Native text expressions of the normaliser (layer 0)."""

from __future__ import annotations

import codecs

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline import vocab as V

_ROT_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_ROT_TO = "NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, which may use it any number of times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spans(chars: str) -> str:
    """A regular expression's class of ``chars``, neighbours as a range: every member of a class is tested in turn."""
    out, codes = [], sorted({ord(x) for x in chars})
    for code in codes:
        if out and code == out[-1][1] + 1:
            out[-1][1] = code
        else:
            out.append([code, code])
    return "".join(f"\\x{{{low:x}}}" + (f"-\\x{{{high:x}}}" if high > low else "") for low, high in out)


def is_wide(c: Column) -> Column:
    """Whether ``c`` holds a character beyond ASCII; lengths are compared, no pattern is tried."""
    return F.octet_length(c) != F.length(c)


_INVISIBLE = f"[{spans(V.INVISIBLE)}]"
_CONFUSABLE = f"[{spans(V.CONFUSABLE_FROM)}]"


def strip_invisible(c: Column) -> Column:
    return F.when(is_wide(c), F.regexp_replace(c, _INVISIBLE, "")).otherwise(c)


def fold_confusables(c: Column) -> Column:
    folded = F.translate(c, V.CONFUSABLE_FROM, V.CONFUSABLE_TO)
    there = c.rlike(_CONFUSABLE)
    return F.when(there if V.CONFUSABLE_FROM[:1] < "\x80" else is_wide(c) & there, folded).otherwise(c)


def rot13(c: Column) -> Column:
    return F.translate(c, _ROT_FROM, _ROT_TO)


def rot13_if_keyword(c: Column) -> Column:
    """The rotated text when rotation makes a tell-tale word appear that was not there before.

    Only a text that holds such a word rotated is rotated as a whole; letters beyond ASCII that become ASCII in lower
    case do not rotate, so texts with them always are."""

    def may_turn(low: Column) -> Column:
        hit = is_wide(c) & c.rlike("[\u0130\u212a]")
        for word in V.ROT13_KEYWORDS:
            hit = hit | low.contains(codecs.encode(word, "rot13"))
        return hit

    def pick(v: Column) -> Column:
        def choose(low: Column) -> Column:
            appears = F.lit(False)
            for word in V.ROT13_KEYWORDS:
                appears = appears | (low["turned"].contains(word) & ~low["plain"].contains(word))
            return F.when(appears, v["turned"]).otherwise(v["text"])

        lowered = F.struct(F.lower(v["text"]).alias("plain"), F.lower(v["turned"]).alias("turned"))
        return let(lowered, choose)

    return F.when(let(F.lower(c), may_turn), let(F.struct(c.alias("text"), rot13(c).alias("turned")), pick)).otherwise(c)


_SPACES = spans(V.SPACE_CLASS)
_ASCII_SPACES = spans("".join(x for x in V.SPACE_CLASS if x < "\x80"))


def words(c: Column) -> Column:
    def cut(space: str) -> Column:
        return F.split(c, f"[{space}]+")

    return F.filter(F.when(is_wide(c), cut(_SPACES)).otherwise(cut(_ASCII_SPACES)), lambda w: w != "")


def collapse_spaces(c: Column) -> Column:
    """Every run of white space as one blank; single blanks are left as they stand."""

    def one(space: str) -> Column:
        return F.regexp_replace(c, f" [{space}]++|[{space}&&[^ ]][{space}]*+", " ")

    return F.trim(F.when(is_wide(c), one(_SPACES)).otherwise(one(_ASCII_SPACES)))


def runs_replaced(c: Column, pattern: str, decode, may: Column | None = None) -> Column:
    """``c`` with every run that ``pattern`` finds replaced by ``decode(run)``, which keeps it by NULL.

    ``may``: a cheaper test that holds wherever ``pattern`` is found."""

    def joined(v: Column) -> Column:
        new = F.transform(v["runs"], lambda run: F.coalesce(decode(run), run))
        return F.array_join(F.zip_with(v["gaps"], new, lambda gap, run: F.concat(gap, F.coalesce(run, F.lit("")))), "")

    cut = F.struct(F.split(c, pattern, -1).alias("gaps"), F.regexp_extract_all(c, F.lit(pattern), F.lit(0)).alias("runs"))
    there = c.rlike(pattern)
    return F.when(there if may is None else may & there, let(cut, joined)).otherwise(c)


#: A word with a leet character, in a text whose words stand between single blanks.
_LEET_WORD = f"(?<![^ ])[^ {V.LEET_FROM}]*+[{V.LEET_FROM}][^ ]*+"


def reverse_leet(c: Column) -> Column:
    """Leet words back to letters; words end up joined by single spaces."""

    def fix(w: Column) -> Column:
        return F.when(w.rlike(r"\p{L}") & (F.length(w) > 3), F.translate(w, V.LEET_FROM, V.LEET_TO))

    # Only words that hold a leet character are looked at.
    return let(collapse_spaces(c), lambda v: runs_replaced(v, _LEET_WORD, fix, v.rlike(f"[{V.LEET_FROM}]")))


def dominant_script(c: Column) -> Column:
    names = F.array(*[F.lit(n) for n, _ in V.SCRIPT_RANGES])
    (_, latin), *others = V.SCRIPT_RANGES

    def counted(v: Column) -> Column:
        """Characters per script; what is left without the Latin runs is short, or another script."""
        rest = [F.length(F.regexp_replace(v["rest"], f"[^{span}]+", "")) for _, span in others]
        return F.array(v["latin"], *rest)

    counts = let(
        F.struct(
            F.length(F.regexp_replace(c, f"[^{latin}]+", "")).alias("latin"),
            F.regexp_replace(c, "[\\x00-\u024f]+", "").alias("rest"),
        ),
        counted,
    )

    def name(n: Column) -> Column:
        total = F.aggregate(n, F.lit(0), lambda acc, x: acc + x)
        top = F.array_max(n)
        return (
            F.when(total == 0, F.lit("latin"))
            .when(top < total * V.SCRIPT_DOMINANCE, F.lit("mixed"))
            # array_position finds the first of equals: the declared order breaks ties
            .otherwise(F.element_at(names, F.array_position(n, top).cast("int")))
        )

    # Pure ASCII can only be Latin (or letterless): skip five passes over the text.
    return F.when(~is_wide(c), F.lit("latin")).otherwise(let(counts, name))


def edit_ratio(original: Column, changed: Column) -> Column:
    """Share of positions that differ, over the longer text, case and blanks ignored."""

    def bare(c: Column) -> Column:
        return F.replace(F.lower(c), F.lit(" "), F.lit(""))

    def ratio(v: Column) -> Column:
        a, b = v["a"], v["b"]
        both = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x == y, F.lit(False)))
        same = F.size(F.filter(both, lambda hit: hit))
        longest = F.greatest(F.length(a), F.length(b))
        return F.when((a == "") | (a == b), F.lit(0.0)).otherwise(F.round(F.lit(1.0) - same / longest, 4))

    return let(F.struct(bare(original).alias("a"), bare(changed).alias("b")), ratio)
