"""Lempel-Ziv phrase fingerprints.

A text is parsed into dictionary phrases (each the longest known phrase plus one character); the set of
phrases is what a compressor would learn from it.  Phrases are hashed, dealt into ``BINS`` by their top
bits, and each bin keeps its smallest hash, of which one byte is stored (0: empty bin).  The likeness of
two fingerprints is the share of agreeing bins among those that are not empty in both, corrected for
agreement by chance; it estimates the Jaccard likeness of the phrase sets, hence how well one text would
compress with the other's dictionary.

For each document ``with_edits`` also fingerprints an edited text: its last floor(n/2) characters are
replaced by the first ones of the next document in descending id order.  Texts are range-sorted by id
once; a task walks its rows in order, and the row at each partition's end meets the first row of the next
partition in a join with one row per partition.  The parse of the unedited half serves both fingerprints.

Defined results: NULL text counts as empty, whose fingerprint is all empty bins; two empty fingerprints
have likeness 1, one empty and one not 0.  Rows with equal ids are ordered by text (descending); NULL ids
come last.  With one row, the next document is the row itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.session import landed

BINS = 256
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def phrase_ends(text: str, known: set[str], start: int = 0) -> list[int]:
    """Ends of the phrases of ``text`` from ``start`` on; ``known`` gains the phrases.  A last stretch
    that is already a phrase has no end of its own.

    Phrases are closed under prefixes, so the search for the longest known one may start at the length
    of the previous phrase and move either way."""
    ends, n, guess = [], len(text), 1
    add, append = known.add, ends.append
    while start < n:
        end = start + guess
        if end > n:
            end = n
        phrase = text[start:end]
        if phrase in known:
            while phrase in known:
                if end >= n:
                    return ends
                end += 1
                phrase = text[start:end]
        else:
            while end - start > 1:
                shorter = text[start : end - 1]
                if shorter in known:
                    break
                phrase = shorter
                end -= 1
        add(phrase)
        append(end)
        guess = end - start
        start = end
    return ends


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse modulo 2**64; kept, and grown as needed."""
    if len(_kept[0]) < n:
        size = max(n, 2 * len(_kept[0]), 1 << 12)
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _kept[i] = np.cumprod(steps)
    return _kept[0], _kept[1]


_kept = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _hashes(text: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``text[start:end]``: differences of prefix sums of a polynomial, mixed with the
    length."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    power, inverse = _powers(len(code))
    prefix = np.zeros(len(code) + 1, dtype=np.uint64)
    np.cumsum(code * power[: len(code)], out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * inverse[starts]
    h ^= (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def signature(hashes: np.ndarray) -> bytes:
    """One byte per bin from the smallest hash in it."""
    low = np.full(BINS, np.iinfo(np.uint64).max, dtype=np.uint64)
    full = np.zeros(BINS, dtype=bool)
    bins = (hashes >> np.uint64(56)).astype(np.int64)
    np.minimum.at(low, bins, hashes & np.uint64((1 << 56) - 1))
    full[bins] = True
    return np.where(full, low % np.uint64(255) + np.uint64(1), np.uint64(0)).astype(np.uint8).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    some = (x > 0) | (y > 0)
    n = int(some.sum())
    if not n:
        return 1.0
    chance = 1 / 255
    share = int(((x == y) & some).sum()) / n
    return min(1.0, max(0.0, (share - chance) / (1 - chance)))


class Parsed:
    """A text's phrases, enough to parse any text that shares a prefix with it."""

    def __init__(self, text: str):
        self.text = text
        self.ends = np.array(phrase_ends(text, set()), dtype=np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64) if len(self.ends) else self.ends
        self.hashes = _hashes(text, self.starts, self.ends)

    def edited(self, keep: int, tail: str) -> bytes:
        """Signature of ``text[:keep] + tail``: the parse goes on from the last phrase inside ``keep``."""
        text = self.text
        done = int(np.searchsorted(self.ends, keep, side="right"))
        known = {text[s:e] for s, e in zip(self.starts[:done].tolist(), self.ends[:done].tolist())}
        at = int(self.ends[done - 1]) if done else 0
        rest = text[at:keep] + tail
        ends = np.array(phrase_ends(rest, known), dtype=np.int64)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
        return signature(np.concatenate([self.hashes[:done], _hashes(rest, starts, ends)]))


def fingerprint(text: str | None) -> bytes:
    return signature(Parsed(text or "").hashes)


def edited_text(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


#: Columns of the result as they are landed: hashes and fingerprints in bytes.
_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_KINDS = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
_ROW = (
    "doc_id bigint, n_chars bigint, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, "
    "near_edited double, near_next double"
)
#: The same and, on one row per partition, its number and its first and last text.
_ENDS = ["part", "first", "last"]
_END_KINDS = [pa.int64(), pa.string(), pa.string()]
_WALKED = _ROW + ", part bigint, first string, last string"


def _row(doc, text: str, parsed: Parsed, mark: bytes, following: str, next_mark: bytes) -> tuple:
    half = len(text) // 2
    sha = hashlib.sha256(edited_text(text, following).encode("utf-8", "surrogatepass")).digest()
    edited = parsed.edited(len(text) - half, following[:half])
    return doc, len(text), sha, mark, edited, likeness(mark, edited), likeness(mark, next_mark)


def _batch(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one partition; beside them one row with the partition's number and its first and last text."""
    part, rows, held, first = TaskContext.get().partitionId(), [], None, None
    names, kinds, no_ends = _NAMES + _ENDS, _KINDS + _END_KINDS, (None,) * len(_ENDS)
    for batch in batches:
        for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = value.as_py() or ""
            if held and held[1] == text:
                parsed, mark = held[2], held[3]
            else:
                parsed = Parsed(text)
                mark = signature(parsed.hashes)
            if held:
                rows.append(_row(*held, text, mark) + no_ends)
            else:
                first = text
            held = (doc, text, parsed, mark)
            if len(rows) >= 1000:
                yield _batch(rows, names, kinds)
                rows = []
    if held:
        rows.append((held[0], *[None] * (len(_NAMES) - 1), part, first, held[1]))
        yield _batch(rows, names, kinds)


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last row of each partition, with the first text of the next one."""
    for batch in batches:
        rows = []
        for doc, text, following in zip(*(c.to_pylist() for c in batch.columns)):
            parsed = Parsed(text)
            rows.append(_row(doc, text, parsed, signature(parsed.hashes), following, fingerprint(following)))
        yield _batch(rows, _NAMES, _KINDS)


def with_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    by_id, by_text = F.desc_nulls_last("doc_id"), F.desc("text")
    walked = landed(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        # Bounds are drawn from ids alone: sampled texts would pass through the driver.
        .repartitionByRange(by_id).sortWithinPartitions(by_id, by_text).mapInArrow(_walk, _WALKED),
        "fingerprints",
    )
    # One row per partition from here on.
    ends = walked.where("part is not null").select("part", "doc_id", "first", "last")
    place = ends.select("part", F.row_number().over(Window.orderBy("part")).alias("at"), F.count("*").over(Window.partitionBy(F.lit(0))).alias("n"))
    heads = place.join(ends.select("part", "first"), "part").select(F.col("at").alias("head"), "first")
    tails = place.join(ends.select("part", "doc_id", "last"), "part").select((F.col("at") % F.col("n") + 1).alias("head"), "doc_id", "last")
    closed = tails.join(heads, "head").select("doc_id", "last", "first").mapInArrow(_close, _ROW)
    hexed = {c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")}
    return walked.where("part is null").select(*_NAMES).unionByName(closed).withColumns(hexed)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (hex) of each whole text, without edits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = [fingerprint(t.as_py()).hex() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(marks, pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, fingerprint string")
