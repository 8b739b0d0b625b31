"""Literals that a pattern cannot match without.

A text is searched for them before a pattern is tried: finding a fixed string is many times cheaper than a regular
expression that starts at every character, and most texts hold none.
"""

from __future__ import annotations

import re
from functools import lru_cache
from re import _constants as C
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with partners outside ASCII when case does not count (dotless and dotted i, long s, the Kelvin sign).
_AMBIGUOUS = "iskISK"
#: Shorter literals are in most texts, so lowering a text for them does not pay.
WORTH = 4


def _pieces(run: str, fold: bool) -> list[str]:
    """Parts of a run of literals that may be searched for, in lower case if ``fold``."""
    if not fold:
        return [run] if run else []
    return [p.lower() for p in re.split(rf"[{_AMBIGUOUS}]|[^\x00-\x7f]", run) if p]


def _best(found: list[set[str]]) -> set[str] | None:
    """The alternatives that are longest at their shortest."""
    return max(found, key=lambda alternatives: min(map(len, alternatives)), default=None)


def _needed(tokens, fold: bool) -> set[str] | None:
    """Alternatives of which every match of a parsed sequence holds at least one; None if there are none."""
    found: list[set[str]] = []
    run = ""
    for op, value in [*tokens, (None, None)]:
        if op is C.LITERAL:
            run += chr(value)
            continue
        found += [{p} for p in _pieces(run, fold)]
        run, inner = "", None
        if op is C.SUBPATTERN:
            _, added, removed, part = value
            inner = None if (added | removed) & re.IGNORECASE else _needed(part, fold)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            least, _, part = value
            inner = _needed(part, fold) if least else None
        elif op is C.ATOMIC_GROUP:
            inner = _needed(value, fold)
        elif op is C.BRANCH:
            each = [_needed(part, fold) for part in value[1]]
            inner = set().union(*each) if all(each) else None
        if inner:
            found.append(inner)
    return _best(found)


@lru_cache(maxsize=4096)
def required(pattern: str) -> tuple[tuple[str, ...], bool]:
    """(literals, case does not count): a match holds one of them; none if that cannot be told."""
    try:
        parsed = _parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):  # written for Java alone
        return (), False
    fold = bool(parsed.state.flags & re.IGNORECASE)
    if parsed.state.flags & re.VERBOSE:
        return (), fold
    return tuple(sorted(_needed(parsed, fold) or ())), fold


def may_match(c: Column, pattern: str) -> Column | None:
    """Whether a literal that ``pattern`` needs stands in ``c``; None if it needs none."""
    literals, fold = required(pattern)
    if not literals or fold and min(map(len, literals)) < WORTH:
        return None
    text, hit = F.lower(c) if fold else c, None
    for literal in literals:
        hit = text.contains(literal) if hit is None else hit | text.contains(literal)
    return hit
