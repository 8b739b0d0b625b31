"""Main text of web pages by the best contiguous region.

A page is read once into a flat sequence of tags and text runs.  Every tag scores below zero, the words of a run
score above it where they look like content and below it where they do not; the contiguous region of the
largest sum, found in one linear scan, is the article.  What lies inside the region but is no part of the
article (menus, side bars, notices, adverts, forms, scripts, styles, reader comments) is left out.

* Weights come from labelled pages: pages whose markup says which part is the article (``article``, ``main``,
  their roles, ``articleBody``).  All such pages count.  For each kind of token - a tag that opens or closes, or
  a word, with the element it is in and whether it is link text - the numbers inside and outside the article
  are added up in Spark; kinds are made of ``TAGS`` known names, so the table has at most a few hundred rows.
  Its log odds, with a prior of ``PRIOR`` tokens at +1 per word and -0.5 to -3.25 per tag, are kept to the sign of the
  method: tags never score above ``LEAST_TAG``, words of unmarked pages never below ``LEAST_WORD``.
* On a page that is marked itself, words outside the marked parts score ``OUTSIDE`` each and tags inside them next
  to nothing, so the region is the marked part down to its shortest paragraph.
* Elements are left out by name (``DROPPED``) or by a word of their class, id or role (``NOTED``); by word only
  if no marked part is inside and, other than for comments, they hold less than half of the page's words.
  A ``header`` inside the article keeps its headings.

The parser is linear: one pattern cuts the page, a stack of open elements is kept with a count per name, and
elements that were never closed end with their parent.  Ends of other elements do not end an article.

Defined results: NULL or empty html gives an empty text, as does a page without a word of content.  Broken
markup, unknown tags and very long pages need no special case; no text is cut.  Repeated rows give equal
results; without labelled pages the prior holds; an empty table gives no rows.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRIOR = 50
#: Scores before any page is seen: of a word, of text styles, of blocks of prose, of other tags.
WORD_PRIOR, STYLE_PRIOR, PROSE_PRIOR, TAG_PRIOR = 1.0, -0.5, -1.0, -3.25
LEAST_WORD, LEAST_TAG = 0.05, -0.05
MOST = 6.0
#: On a marked page: words outside the marked parts, and tags inside them.
OUTSIDE, MARKED_TAG = -3.0, -1e-6

# Names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rb rp rt rtc ruby s "
    "samp small span strike strong sub sup time tt u var wbr".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = HEADINGS | frozenset("p li blockquote pre dd dt".split())
#: Elements that end an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
#: An open element of the set ends when the element named opens.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead"}, "body": {"head"},
}
TAGS = frozenset(
    "address article aside b blockquote body br button caption center code dd details div dl dt em figcaption figure "
    "font footer form h1 h2 h3 h4 h5 h6 header hr i img li main nav ol p pre section small span strong summary table "
    "tbody td tfoot th thead tr u ul a".split()
)
#: Elements that are never part of an article.
DROPPED = frozenset(
    "nav footer aside form script style noscript template svg math iframe object embed applet canvas audio video "
    "select button input textarea dialog menu head title noembed noframes xmp search datalist map".split()
)
#: Words of class, id or role that name what is no part of an article.
COMMENTS = frozenset("comment comments commentlist commentary disqus replies reply respond".split())
NOTED = COMMENTS | frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sidebar sidebars menu menus menubar nav navbar "
    "navigation breadcrumb breadcrumbs cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
    "subscribe subscription signup login share sharing social related recommended recommendations promo promotion "
    "promoted sponsor sponsored sponsors footer masthead header toolbar pagination pager search widget widgets skip "
    "complementary contentinfo dialog".split()
)

_CUT = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)"
    r"(?P<rest>(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.IGNORECASE)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Only their own ends, or those of ``OUTER`` elements, end an article; text styles end within their block.
SCOPES = frozenset(("article", "main"))
OUTER = SCOPES | {"body", "html"}
#: Text styles inside one another that an end looks through.
NESTED = 64

OPEN, CLOSE, TEXT = 0, 1, 2


class Page:
    """A page as parallel lists: per token its kind (``OPEN``, ``CLOSE``, ``TEXT``), name (of the tag, or of the
    element a text is in), text, whether it is link text, whether it is marked as article, and whether it is left out."""

    def __init__(self, source: str):
        self.kind: list[int] = []
        self.name: list[str] = []
        self.text: list[str] = []
        self.words: list[int] = []
        self.linked: list[bool] = []
        self.marked: list[bool] = []
        self.has_mark = False
        self._stack: list[tuple] = []  # name, state before, token of its start, word of its class
        self._scopes = [Counter()]  # names of open elements, anew inside each article
        self._links = self._marks = self._drops = self._heads = 0
        self._noted: list[tuple] = []
        self.out: list[bool] = []
        self._parse(source)

    def _token(self, kind: int, name: str, text: str = "") -> None:
        self.kind.append(kind)
        self.name.append(name)
        self.text.append(text)
        words = len(text.split())
        self.words.append(words)
        self.linked.append(self._links > 0)
        self.marked.append(self._marks > 0)
        self.out.append(self._drops > 0 or self._heads > 0 and not any(h in self._scopes[-1] for h in HEADINGS))

    def _parse(self, source: str) -> None:
        at = 0
        while m := _CUT.search(source, at):
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            name = m["name"]
            if name is None:
                continue
            name = name.lower()
            if m["close"]:
                self._close(name)
                continue
            self._start(name, m["rest"])
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.IGNORECASE).search(source, at)
                at = end.start() if end else len(source)
        if at < len(source):
            self._text(source[at:])
        while self._stack:
            self._end()
        self._leave_out()

    def _text(self, raw: str) -> None:
        self._token(TEXT, self._stack[-1][0] if self._stack else "body", html.unescape(raw))

    def _start(self, name: str, rest: str) -> None:
        if name in ENDS_P and "p" in self._scopes[-1]:
            self._until("p")
        for other in ENDS.get(name, ()):
            if self._stack and self._stack[-1][0] == other:
                self._end()
        values = {a.lower(): x or y or z for a, x, y, z in _ATTRIBUTE.findall(rest)} if "=" in rest else {}
        words = {w.lower() for a in ("class", "id", "role") for w in _NAME.findall(values.get(a, ""))}
        marks = (name in ("article", "main") or values.get("role") in ("main", "article") or "articleBody" in values.get("itemprop", "")) and not words & COMMENTS
        if name in VOID:
            self._token(OPEN, name)
            return
        note = words & NOTED if name not in ("html", "body", "main") and (name != "article" or words & COMMENTS) else set()
        drops = name in DROPPED or name == "header" and not self._marks
        heads = name == "header" and self._marks > 0
        self._stack.append((name, marks, drops, heads, note, len(self.kind)))
        self._scopes[-1][name] += 1
        if name in SCOPES:
            self._scopes.append(Counter())
        self._links += name == "a"
        self._marks += marks and not self._drops
        self._drops += drops
        self._heads += heads
        self.has_mark |= marks and not drops and self._drops == 0
        self._token(OPEN, name)

    def _end(self) -> None:
        name, marks, drops, heads, note, start = self._stack.pop()
        self._token(CLOSE, name)
        if name in SCOPES:
            self._scopes.pop()
        names = self._scopes[-1]
        names[name] -= 1
        if not names[name]:
            del names[name]
        self._links -= name == "a"
        self._drops -= drops
        self._marks -= marks and not self._drops
        self._heads -= heads
        if note:
            self._noted.append((start, len(self.kind), bool(note & COMMENTS)))

    def _until(self, name: str) -> None:
        """Ends elements up to and with the innermost ``name``."""
        while True:
            last = self._stack[-1][0]
            self._end()
            if last == name:
                return

    def _close(self, name: str) -> None:
        if name == "br":
            self._token(OPEN, name)
        elif name in INLINE:
            for i in range(1, min(NESTED, len(self._stack)) + 1):
                last = self._stack[-i][0]
                if last == name:
                    self._until(name)
                if last not in INLINE or last == name:
                    break
        elif name in self._scopes[-1] or name in OUTER and any(name in names for names in self._scopes):
            self._until(name)

    def _leave_out(self) -> None:
        """Leaves out elements by a word of their class."""
        if not self._noted:
            return
        words = np.cumsum([0, *(0 if o else w for w, o in zip(self.words, self.out))])
        starts = np.cumsum([0, *((k == OPEN and n in ("article", "main")) for k, n in zip(self.kind, self.name))])
        mark = np.zeros(len(self.kind) + 1, dtype=np.int64)
        for start, end, comments in self._noted:
            holds_mark = starts[end] - starts[start + 1] > 0
            if comments or not holds_mark and 2 * (words[end] - words[start]) < words[-1]:
                mark[start] += 1
                mark[end] -= 1
        inside = np.cumsum(mark[:-1]) > 0
        self.out = [o or bool(i) for o, i in zip(self.out, inside)]

    def kinds(self) -> list[tuple]:
        """Kind of each token: (what, name, linked)."""
        return [
            ("word" if k == TEXT else "open" if k == OPEN else "close", n if n in TAGS else "other", bool(a) and k == TEXT)
            for k, n, a in zip(self.kind, self.name, self.linked)
        ]

    def region(self, weights: dict) -> tuple[int, int]:
        """Start and end of the tokens with the largest sum of scores; the first of equals."""
        best, best_at, total, start = 0.0, (0, 0), 0.0, 0
        for i, (kind, words, out, marked) in enumerate(zip(self.kinds(), self.words, self.out, self.marked)):
            if out:
                continue
            if kind[0] == "word":
                score = words * (OUTSIDE if self.has_mark and not marked else weight(weights, kind))
            else:
                score = MARKED_TAG if marked else weight(weights, kind)
            if total <= 0:
                total, start = 0.0, i
            total += score
            if total > best:
                best, best_at = total, (start, i + 1)
        return best_at

    def main_text(self, weights: dict) -> str:
        start, end = self.region(weights)
        parts = []
        for kind, name, text, out in zip(*(x[start:end] for x in (self.kind, self.name, self.text, self.out))):
            if kind != TEXT:
                if name not in INLINE:
                    parts.append(" ")
            elif not out:
                parts.append(text)
        return " ".join("".join(parts).split())


def prior(what: str, name: str) -> float:
    if what == "word":
        return WORD_PRIOR
    return STYLE_PRIOR if name in INLINE or name == "br" else PROSE_PRIOR if name in PROSE else TAG_PRIOR


def weight(weights: dict, kind: tuple) -> float:
    """Score of a kind of token; the prior's where no labelled page has it."""
    found = weights.get(kind)
    return prior(*kind[:2]) if found is None else found


def weights_of(counts: list[tuple]) -> dict:
    """Scores from (what, name, linked, inside, outside): log odds, smoothed by the prior and held to the
    sign of words and tags."""
    out = {}
    for what, name, linked, inside, outside in counts:
        share = 1 / (1 + math.exp(-prior(what, name)))
        odds = math.log((inside + PRIOR * share) / (outside + PRIOR * (1 - share)))
        out[what, name, linked] = min(MOST, max(LEAST_WORD, odds)) if what == "word" else max(-MOST, min(LEAST_TAG, odds))
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """what, name, linked, inside, outside: tokens of this task's labelled pages."""
    inside, outside = Counter(), Counter()
    for batch in batches:
        for source in batch.column(0):
            page = Page(source.as_py() or "")
            if not page.has_mark:
                continue
            for kind, words, out, marked in zip(page.kinds(), page.words, page.out, page.marked):
                if not out:
                    (inside if marked else outside)[kind] += words if kind[0] == "word" else 1
    rows = [(*kind, inside[kind], outside[kind]) for kind in inside | outside]
    columns = list(zip(*rows)) or [()] * 5
    yield pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64()))],
        ["what", "name", "linked", "inside", "outside"],
    )


def fit(pages: DataFrame) -> dict:
    """Scores of the kinds of token, from all labelled pages (those whose markup names the article)."""
    counts = (
        pages.select("html").where(F.col("html").rlike(r"(?i)<article|<main|role\s*=|articleBody"))
        .mapInArrow(_count, "what string, name string, linked boolean, inside bigint, outside bigint")
        .groupBy("what", "name", "linked").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    )
    return weights_of([tuple(r) for r in counts.collect()])  # a row per kind of token


def extract(pages: DataFrame, weights: dict) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Page(s.as_py() or "").main_text(weights) for s in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(
        run, "page_id bigint, url string, text string, n_chars bigint"
    )
