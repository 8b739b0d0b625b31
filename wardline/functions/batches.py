"""Steps and tests over whole Arrow batches of texts.

A linear scan (RE2, in Arrow) tells which texts of a batch a step may change or a rule may match; it is many times
cheaper than a backtracking expression tried at every character.  Only the texts it names are looked at one by one, and
what is decided here about rules and entropy is a "may": the expressions that decide run on what is left.
"""

from __future__ import annotations

import base64
import codecs
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable
from functools import lru_cache
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructType

from wardline import vocab as V
from wardline.functions.text import spans

#: Texts that are Python strings at one time.
BLOCK = 256

_SPACES = spans(V.SPACE_CLASS)
_INVISIBLE = f"[{spans(V.INVISIBLE)}]"
_CONFUSABLE = f"[{spans(V.CONFUSABLE_FROM)}]"
#: Characters beyond these may change under NFKC; neighbours among these do not combine.
_SETTLED = spans("".join(chr(i) for i in range(0x250) if unicodedata.normalize("NFKC", chr(i)) == chr(i)))
_PERCENT = "%[0-9A-Fa-f]{2}"
_BASE64 = V.BASE64_SEGMENT.replace(r"\s", _SPACES)
_HEX = f"[0-9a-fA-F]{{2}}(?:[:{_SPACES}]?[0-9a-fA-F]{{2}}){{7}}"
_ROTATED = "(?i:" + "|".join(codecs.encode(word, "rot13") for word in V.ROT13_KEYWORDS) + ")|[\\x{130}\\x{212a}]"
_UNEVEN = f"^ |  | $|[{spans(V.SPACE_CLASS.replace(' ', ''))}]"
_LEET = f"[{V.LEET_FROM}]"
_BEYOND_LATIN = "[\\x{250}-\\x{10ffff}]"
_LONG_WORD = f"[^{_SPACES}]{{{V.ENTROPY_MIN_LENGTH}}}"

_NO_INVISIBLE = dict.fromkeys(V.INVISIBLE, "")
_LETTERS = str.maketrans(V.LEET_FROM, V.LEET_TO)
_PERCENT_RUN = re.compile(f"(?:{_PERCENT})+")
_LEET_CHAR = re.compile(_LEET)
_BASE64_RUN = re.compile(V.BASE64_SEGMENT)
#: Possessive, as where the runs are decoded.
_HEX_RUN = re.compile(V.HEX_SEGMENT.replace(r"[:\s]?", r"[:\s]?+").replace("{7,}", "{7,}+"))
#: No text with one of these is readable.
_CONTROL = re.compile("[\x00-\x08\x0e-\x1b\x7f]")


def _holds(texts: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(texts, pattern).fill_null(False).to_numpy(zero_copy_only=False)


def _each(texts: pa.Array, at: np.ndarray):
    """(row, text) of the rows that ``at`` holds, a block at a time."""
    rows = np.flatnonzero(at)
    for i in range(0, len(rows), BLOCK):
        yield from zip(rows[i : i + BLOCK], texts.take(pa.array(rows[i : i + BLOCK])).to_pylist())


def _replaced(texts: pa.Array, at: np.ndarray, change: Callable[[str], str]) -> tuple[pa.Array, np.ndarray]:
    """``texts`` with those that ``at`` holds changed, and which came out different."""
    differ, new = np.zeros(len(texts), bool), []
    for i, old in _each(texts, at):
        text = change(old)
        if text != old:
            differ[i] = True
            new.append(text)
    if new:
        texts = pc.replace_with_mask(texts, pa.array(differ), pa.array(new, texts.type))
    return texts, differ


def _kind(**fields) -> StructType:
    made = StructType()
    for name, kind in fields.items():
        made.add(name, kind)
    return made


def _struct(columns: dict[str, np.ndarray | pa.Array]) -> pa.StructArray:
    return pa.StructArray.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))


def _if_changed(texts: pa.Array, changed: np.ndarray) -> pa.Array:
    """NULL where nothing changed: the caller has that text."""
    return pc.if_else(pa.array(changed), texts, pa.scalar(None, texts.type)).cast(pa.string())


def _mapped(text: str, into: dict[str, str]) -> str:
    for x in into.keys() & set(text):
        text = text.replace(x, into[x])
    return text


def _kept(texts: pa.Array, at: np.ndarray, test: Callable[[str], bool]) -> np.ndarray:
    """The rows of ``at`` whose text passes ``test``."""
    out = np.zeros(len(texts), bool)
    for i, text in _each(texts, at):
        out[i] = test(text)
    return out


def _may_read(data: bytes) -> bool:
    text = data.decode("utf-8", "ignore")
    return text != "" and not _CONTROL.search(text)


def _may_base64(text: str) -> bool:
    runs = (run[1].rstrip("=") for run in _BASE64_RUN.finditer(text))
    return any(len(x) % 4 != 1 and _may_read(base64.b64decode(x + "=" * (-len(x) % 4))) for x in runs)


def _may_hex(text: str) -> bool:
    return any(_may_read(bytes.fromhex(re.sub(r"[:\s]", "", run[1]))) for run in _HEX_RUN.finditer(text))


def _percent(text: str) -> str:
    return _PERCENT_RUN.sub(lambda run: bytes.fromhex(run[0].replace("%", "")).decode("utf-8", "replace"), text)


@F.arrow_udf(_kind(text=StringType(), **dict.fromkeys(("invisible", "unicode", "url", "base64", "hex", "rot13"), BooleanType())))
def unveiled(texts: pa.Array) -> pa.Array:
    """Texts without invisible characters, under NFKC, with lookalikes folded and percent runs decoded; NULL if all that
    changed nothing.  Which of these steps changed them, and which later ones may."""
    cur, invisible = _replaced(texts, _holds(texts, _INVISIBLE), lambda t: _mapped(t, _NO_INVISIBLE))
    cur, compatible = _replaced(cur, _holds(cur, f"[^{_SETTLED}]"), lambda t: unicodedata.normalize("NFKC", t))
    cur, folded = _replaced(cur, _holds(cur, _CONFUSABLE), lambda t: _mapped(t, V.CONFUSABLES))
    cur, url = _replaced(cur, _holds(cur, _PERCENT), _percent)
    return _struct({
        "text": _if_changed(cur, invisible | compatible | folded | url),
        "invisible": invisible, "unicode": compatible | folded, "url": url,
        "base64": _kept(cur, _holds(cur, _BASE64), _may_base64), "hex": _kept(cur, _holds(cur, _HEX), _may_hex), "rot13": _holds(cur, _ROTATED),
    })


def _unleet(text: str, unsure: list[bool]) -> str:
    """Leet words back to letters; ``unsure`` is told of a word whose only letters are newer than Unicode 3.2, which
    the running Java may not know."""
    out, done = [], 0
    for found in _LEET_CHAR.finditer(text):
        at = found.start()
        if at < done:
            continue
        start, end = text.rfind(" ", done, at) + 1 or done, text.find(" ", at)
        end = len(text) if end < 0 else end
        word = text[start:end]
        if len(word) > 3:
            letters = [x for x in word if x.isalpha()]
            if letters and not any(x < "\x80" or unicodedata.ucd_3_2_0.category(x)[0] == "L" for x in letters):
                unsure.append(True)
            out += [text[done:start], word.translate(_LETTERS) if letters else word]
            done = end
    out.append(text[done:])
    return "".join(out)


@F.arrow_udf(_kind(text=StringType(), unsure=BooleanType(), scripts=BooleanType()))
def worded(texts: pa.Array) -> pa.Array:
    """Texts with white space collapsed and leet words back to letters; NULL if that changed nothing.  ``unsure``: leave
    that to Java.  ``scripts``: some character is of no Latin script."""
    cur, even = _replaced(texts, _holds(texts, _UNEVEN), lambda t: " ".join(t.split()))
    unsure = np.zeros(len(texts), bool)
    told: list[list[bool]] = []

    def unleet(text: str) -> str:
        told.append([])
        return _unleet(text, told[-1])

    leet = _holds(cur, _LEET)
    cur, plain = _replaced(cur, leet, unleet)
    unsure[np.flatnonzero(leet)] = [bool(x) for x in told]
    return _struct({"text": _if_changed(cur, even | plain), "unsure": unsure, "scripts": _holds(cur, _BEYOND_LATIN)})


#: Below this many different characters nothing reaches the threshold.
_DISTINCT = math.ceil(2**V.ENTROPY_THRESHOLD - 1e-9)


def _dense(part: str) -> bool:
    """Whether ``part`` may reach the threshold; sums in another order differ in the last digits."""
    if len(set(part)) < _DISTINCT:
        return False
    n = len(part)
    return math.log2(n) - sum(k * math.log2(k) for k in Counter(part).values()) / n >= V.ENTROPY_THRESHOLD - 1e-6


def _may_violate(texts: pa.Array) -> np.ndarray:
    """Where a long word or a window may reach the entropy threshold."""
    out, long_word = np.zeros(len(texts), bool), _holds(texts, _LONG_WORD)
    for i, t in _each(texts, pc.greater_equal(pc.utf8_length(texts), V.ENTROPY_MIN_LENGTH).fill_null(False).to_numpy(zero_copy_only=False)):
        out[i] = any(_dense(t[k : k + V.ENTROPY_WINDOW]) for k in range(0, len(t) - V.ENTROPY_TAIL, V.ENTROPY_STEP)) or (
            long_word[i] and any(_dense(w) for w in t.split() if len(w) >= V.ENTROPY_MIN_LENGTH)
        )
    return out


#: Bits of a number that hold a rule each.
BITS = 62


def suspects(c: Column, patterns: list[str]) -> tuple[Column, Callable[[Column], list[Column | None]]]:
    """A struct column (entropy, rules), and the tests that read whether each of ``patterns`` may match from it; None
    for a pattern that only Java understands."""
    wide = [widened(p) for p in patterns]

    @F.arrow_udf(_kind(entropy=BooleanType(), rules=ArrayType(LongType())))
    def run(texts: pa.Array) -> pa.Array:
        words = -(-len(wide) // BITS)
        bits = np.zeros((len(texts), words), np.int64)
        for i, p in enumerate(wide):
            if p is not None:
                bits[:, i // BITS] |= _holds(texts, p).astype(np.int64) << (i % BITS)
        ends = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * words)
        return _struct({"entropy": _may_violate(texts), "rules": pa.ListArray.from_arrays(ends, pa.array(bits.ravel()))})

    def tests(told: Column) -> list[Column | None]:
        bit = lambda i: F.get(told["rules"], F.lit(i // BITS)).bitwiseAND(F.lit(1 << i % BITS)) != 0
        return [None if p is None else bit(i) for i, p in enumerate(wide)]

    return run(c), tests


_BEYOND_ASCII = "\\x{80}-\\x{10ffff}"
_ANY = "(?s:.)"
_CATEGORIES = {
    C.CATEGORY_DIGIT: "0-9" + _BEYOND_ASCII,
    C.CATEGORY_SPACE: "\\x{9}-\\x{d}\\x{1c}-\\x{20}" + _BEYOND_ASCII,
    C.CATEGORY_WORD: "0-9A-Za-z_" + _BEYOND_ASCII,
}
#: Letters beyond ASCII that Java takes for ASCII ones when case does not count.
_FOLDED = "\\x{130}\\x{131}\\x{17f}\\x{212a}"


def _class(items: list, fold: bool) -> str:
    """A class at least as wide as one of ``items``."""
    out = _FOLDED if fold else ""
    for op, value in items:
        if op is C.CATEGORY and value in _CATEGORIES:
            out += _CATEGORIES[value]
        elif op in (C.LITERAL, C.RANGE):
            low, high = value if op is C.RANGE else (value, value)
            if fold and high >= 0x80:
                return _ANY
            if low <= ord("[") <= high and op is C.LITERAL:
                raise ValueError("Java may read a class inside a class")
            out += f"\\x{{{low:x}}}-\\x{{{high:x}}}"
        else:  # negated
            return _ANY
    return f"(?i:[{out}])" if fold else f"[{out}]"


def _wider(tokens, fold: bool) -> str:
    out = ""
    for op, value in tokens:
        if op is C.LITERAL:
            special = fold and (value >= 0x80 or chr(value) in "iskISK")
            out += _class([(op, value)], True) if special else f"(?i:\\x{{{value:x}}})" if fold else f"\\x{{{value:x}}}"
        elif op in (C.ANY, C.NOT_LITERAL):
            out += _ANY
        elif op is C.IN:
            out += _class(value, fold)
        elif op is C.SUBPATTERN:
            _, added, removed, part = value
            out += f"(?:{_wider(part, (fold or bool(added & re.IGNORECASE)) and not removed & re.IGNORECASE)})"
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, part = value
            out += f"(?:{_wider(part, fold)}){{{low},{'' if high is C.MAXREPEAT else high}}}"
        elif op is C.ATOMIC_GROUP:
            out += f"(?:{_wider(value, fold)})"
        elif op is C.BRANCH:
            out += "(?:" + "|".join(_wider(part, fold) for part in value[1]) + ")"
        elif op not in (C.AT, C.ASSERT, C.ASSERT_NOT):  # what looks around only narrows a match
            raise ValueError(op)
    return out


@lru_cache(maxsize=4096)
def widened(pattern: str) -> str | None:
    """A pattern for the linear scan that is found wherever Java finds ``pattern``; None if that cannot be told."""
    if re.search(r"\\[0-9NvQE]|&&|\[\^?\]", pattern):  # the two languages read these differently
        return None
    try:
        parsed = _parser.parse(pattern)
        if parsed.state.flags & (re.VERBOSE | re.ASCII | re.LOCALE):
            return None
        wide = _wider(parsed, bool(parsed.state.flags & re.IGNORECASE))
        pc.match_substring_regex(pa.array([""]), wide)
    except (re.error, OverflowError, RecursionError, ValueError):  # written for Java alone, or too large
        return None
    return wide
