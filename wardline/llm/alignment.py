"""Alignment of two tokenizers' tokens, and how often their ids meet corpus-wide.

Tokenizer A is a byte-level BPE file, B a sentencepiece model.  Both encode a blank followed by the text.
Byte offsets where tokens of both end cut the tokens into groups; every A token is linked with the B tokens
whose bytes it overlaps.

* Identity map: an array from A id to the B id of the same bytes.  A group that is one A token and its
  mapped B token is *regular*: it is stored as its A id alone (two bytes) and counted in one vector of
  vocabulary length per task.  Only pairs of other groups are counted by shuffle, added up within each
  document and task before it.
* Words repeat, so texts are cut at places that no token of either side can span (before a blank or line
  feed that follows another character, between a word and marks behind it) and each worker keeps the alignment
  of the pieces it met last, at most twice ``PIECES`` of them.  A text with other white space is one piece.
* For the report per document, counts of identity pairs and the highest count of each B id are vectors of
  vocabulary length.  The ``FREQUENT`` most frequent other pairs go along; a pair beyond them stands in at
  most one ``FREQUENT``-th of all links, so joining those by key meets no hot key.

Defined results: a NULL or empty text, and one whose bytes differ from its tokens' bytes on either side, has
no tokens (zeros and an empty digest).  Repeated rows are reported, and counted, once each; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import chunks
from wardline.llm.tokens import TO_CHARACTER
from wardline.session import landed

#: Pieces whose alignment a worker keeps, and the longest of them.
PIECES, LONGEST = 100_000, 40
#: Characters of texts that are cut at a time.
STEP = 500_000
#: Irregular pairs whose counts are sent to all tasks (16 bytes each).
FREQUENT = 100_000
#: Irregular pairs that a task adds up before it hands them on.
HELD = 2_000_000

_LETTER, _MARK = "[A-Za-zÀ-ÖØ-öø-ÿ]", "[.,!?;:#*%$&]"
_PIECE = re.compile(r"[ \n]+[^ \n]+")
#: The same, with marks behind a word apart.
_PARTED = re.compile(rf"[ \n]+{_LETTER}+(?={_MARK}+(?:[ \n]|\Z))|{_MARK}+(?=[ \n]|\Z)|[ \n]+[^ \n]+")
_WORD = re.compile(rf" ?{_LETTER}+")
_OTHER_SPACE = re.compile(r"[^\S \n]|᠎")
_MAPPED = np.dtype([("key", "<u4"), ("n", "<i8")])


class Aligned(NamedTuple):
    """The alignment of one piece: sizes, regular A ids, irregular pairs and groups in writing."""

    n_a: int
    n_b: int
    n_groups: int
    n_links: int
    regular: bytes
    pairs: bytes
    groups: str


class Aligner:
    """Both tokenizers, the bytes of their ids and the identity map."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte = {c: b for b, c in TO_CHARACTER.items()}
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            if all(c in byte for c in entry):
                self.bytes_a[i] = bytes(map(byte.__getitem__, entry))
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[1:-1], 16)]) if self.b.is_byte(i)
            else b"" if self.b.is_control(i) or self.b.is_unknown(i)
            else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]
        # Cutting before blanks and line feeds needs a B vocabulary that never joins them to what precedes.
        if any("▁" in p.lstrip("▁") or "\n" in p for p in pieces):
            raise ValueError(f"{path_b} has pieces that go on over a blank or line feed")
        # No token of A spans the end of a word; where B has none either, marks behind words stand apart.
        self.cut = _PIECE if any(re.search(_LETTER + _MARK, p) for p in pieces) else _PARTED
        same: dict[bytes, int] = {}
        for i, raw in enumerate(self.bytes_b):
            if raw and not (raw in same and self.b.is_byte(i)):
                same[raw] = i if raw not in same or self.b.is_byte(same[raw]) else same[raw]
        self.identity = np.array([same.get(raw, -1) if raw else -1 for raw in self.bytes_a], dtype=np.int32)
        self.size_a, self.size_b = (np.array(list(map(len, x)), dtype=np.int64) for x in (self.bytes_a, self.bytes_b))
        self.decimal = list(map(str, range(max(len(pieces), len(self.bytes_a)))))
        self.written = [f"{i}|{b}" for i, b in enumerate(self.identity.tolist())]
        self.known: dict[str, Aligned | None] = {}
        self.before: dict[str, Aligned | None] = {}
        self.word = self._word_encoder(path_a)

    def _word_encoder(self, path_a: str):
        """tiktoken's encoder for pieces that are one run of letters: several times as fast, and equal where the
        file's merges stand in the order of their ids, one for each."""
        import tiktoken

        with open(path_a, encoding="utf-8") as f:
            merges = json.load(f)["model"]["merges"]
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        made = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
        if made != list(range(256, 256 + len(made))) or sorted(map(len, self.bytes_a[:256])) != [1] * 256:
            return None
        ranks = {raw: i for i, raw in enumerate(self.bytes_a) if raw}
        return tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def align(self, pieces: list[str], many_a: list[list[int]], many_b: list[list[int]]) -> list[Aligned | None]:
        """Alignments of pieces from their tokens; None where the tokens' bytes are not those of the piece."""
        flat_a, flat_b = list(chain.from_iterable(many_a)), list(chain.from_iterable(many_b))
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        whole, ends = b"".join(raw), np.cumsum(list(map(len, raw)))
        a, b = np.array(flat_a, dtype=np.int64), np.array(flat_b, dtype=np.int64)
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        fits = b"".join(map(self.bytes_a.__getitem__, flat_a)) == whole == b"".join(map(self.bytes_b.__getitem__, flat_b)) and all(
            np.array_equal(np.concatenate(([0], e))[np.cumsum(list(map(len, many)))], ends) for e, many in ((ends_a, many_a), (ends_b, many_b))
        )
        if not fits and len(pieces) > 1:
            return [self.align([p], [x], [y])[0] for p, x, y in zip(pieces, many_a, many_b)]
        if not fits or not whole:
            return [None] * len(pieces)
        # Between neighbouring ends lies one overlap.
        points = np.union1d(ends_a, ends_b)
        at_a, at_b = np.searchsorted(ends_a, points), np.searchsorted(ends_b, points)
        link_a, link_b = a[at_a], b[at_b]
        last = np.flatnonzero((ends_a[at_a] == points) & (ends_b[at_b] == points))  # of each group
        single = (np.diff(last, prepend=-1) == 1) & (self.identity[link_a[last]] == link_b[last])
        regular = np.zeros(len(points), dtype=bool)
        regular[last[single]] = True
        regular_ids = link_a[regular].astype("<u2").tobytes()
        pairs = (link_a << 16 | link_b)[~regular].astype("<u4").tobytes()
        groups = list(map(self.written.__getitem__, link_a[last].tolist()))
        odd = np.flatnonzero(~single)
        end_a, end_b = at_a[last] + 1, at_b[last] + 1
        text_a, text_b = (list(map(self.decimal.__getitem__, x)) for x in (flat_a, flat_b))
        start_a, start_b = np.concatenate(([0], end_a[:-1])), np.concatenate(([0], end_b[:-1]))
        for g, i, j, k, m in zip(*(x.tolist() for x in (odd, start_a[odd], end_a[odd], start_b[odd], end_b[odd]))):
            groups[g] = ",".join(text_a[i:j]) + "|" + ",".join(text_b[k:m])
        links = np.searchsorted(points, ends, "right")
        regulars = np.concatenate(([0], np.cumsum(regular)))[links]
        out, g, n, r, q = [], 0, 0, 0, 0
        for x, y, to_g, to_n, to_r in zip(many_a, many_b, np.searchsorted(last, links).tolist(), links.tolist(), regulars.tolist()):
            to_q = to_n - to_r
            out.append(Aligned(len(x), len(y), to_g - g, to_n - n, regular_ids[2 * r : 2 * to_r], pairs[4 * q : 4 * to_q], ";".join(groups[g:to_g])))
            g, n, r, q = to_g, to_n, to_r, to_q
        return out

    def encode(self, pieces: list[str]) -> list[Aligned | None]:
        """Alignments of pieces as they stand inside a text."""
        words = [self.word is not None and _WORD.fullmatch(p) is not None for p in pieces]
        other = iter(self.a.encode_batch_fast([p for p, w in zip(pieces, words) if not w], add_special_tokens=False))
        many_a = [self.word(p) if w else next(other).ids for p, w in zip(pieces, words)]
        # B adds a blank itself; that and a line feed behind it are tokens of their own.
        many_b = self.b.encode([p[1:] if p[0] == " " else "\n" + p for p in pieces], num_threads=1)
        return self.align(pieces, many_a, [b if p[0] == " " else b[2:] for p, b in zip(pieces, many_b)])

    def learn(self, pieces: set[str]) -> dict[str, Aligned | None]:
        """Alignments of pieces that ``known`` lacks.  A worker keeps those it met lately, in two generations."""
        fresh = {p: self.before[p] for p in pieces if p in self.before}
        new = list(pieces - fresh.keys())
        fresh.update(zip(new, self.encode(new)))
        if len(self.known) + len(fresh) > PIECES:
            self.before, self.known = self.known, {}
        self.known.update((p, f) for p, f in fresh.items() if len(p) <= LONGEST)
        return fresh

    def pieces(self, text: str) -> list[str]:
        if _OTHER_SPACE.search(text):
            return [text]
        body = text.rstrip(" \n")
        found = self.cut.findall(body) or [""]
        found[-1] += text[len(body) :]
        return found

    def texts(self, texts: list[str | None]) -> Iterator[list[Aligned] | None]:
        """For each text the alignments of its pieces in order; None if it has no tokens."""
        for part in chunks([t or "" for t in texts], STEP):
            cut = [self.pieces(" " + t) if t else [] for t in part]
            get = self.known.get
            found = [[get(p, 0) for p in pieces] for pieces in cut]
            missed = {p for pieces, f in zip(cut, found) if 0 in f for p, x in zip(pieces, f) if x == 0}
            fresh = self.learn(missed) if missed else {}
            for t, pieces, f in zip(part, cut, found):
                if 0 in f:
                    f = [fresh[p] if x == 0 else x for p, x in zip(pieces, f)]
                if None in f:
                    f = self.encode([" " + t])
                yield None if not f or None in f else f


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One per worker process and pair of vocabularies."""
    return Aligner(path_a, path_b)


_ALIGNED = (
    "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
    "regular binary, pairs binary, times binary"
)
_KINDS = [pa.int64()] * 6 + [pa.string()] + [pa.binary()] * 3


def _align_texts(path_a: str, path_b: str):
    def one(found: list[Aligned] | None) -> tuple:
        if found is None:
            return 0, 0, 0, 0, "", b"", b"", b""
        pairs, times = np.unique(np.frombuffer(b"".join([f.pairs for f in found]), "<u4"), return_counts=True)
        return (
            sum([f.n_a for f in found]), sum([f.n_b for f in found]), sum([f.n_groups for f in found]),
            sum([f.n_links for f in found]), hashlib.sha256(";".join([f.groups for f in found]).encode()).hexdigest(),
            b"".join([f.regular for f in found]), pairs.tobytes(), times.astype("<u4").tobytes(),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)
        for batch in batches:
            columns = list(zip(*map(one, both.texts(batch.column(2).to_pylist())))) or [()] * 8
            arrays = [pa.array(c, kind) for c, kind in zip(columns, _KINDS[2:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], [f.split()[0] for f in _ALIGNED.split(", ")])

    return run


def _count_regular(size: int):
    """a, n: how often each A id stands in a regular group of this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = np.zeros(size, dtype=np.int64)
        for batch in batches:
            vector += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u2"), minlength=size)
        at = np.flatnonzero(vector)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(vector[at], pa.int64())], ["a", "n"])

    return run


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, n: irregular pairs of this task, added up ``HELD`` at a time."""

    def summed(keys: list, times: list) -> pa.RecordBatch:
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(at, np.concatenate(times), len(key)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(n)], ["key", "n"])

    keys, times, size = [], [], 0
    for batch in batches:
        keys.append(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4"))
        times.append(np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4"))
        size += len(keys[-1])
        if size >= HELD:
            yield summed(keys, times)
            keys, times, size = [], [], 0
    if size:
        yield summed(keys, times)


def _score_texts(identity: np.ndarray, regular_n: np.ndarray, highest: np.ndarray, frequent: np.ndarray):
    """Sums over a document's links; links of pairs that are not ``frequent`` are handed on in ``rest``."""
    regular_best = (regular_n == highest[identity]) & (identity >= 0)

    def one(regular: bytes, pairs: bytes, times: bytes) -> tuple:
        ids = np.frombuffer(regular, "<u2")
        key, m = np.frombuffer(pairs, "<u4"), np.frombuffer(times, "<u4").astype(np.int64)
        at = np.searchsorted(frequent["key"], key)
        has = at < len(frequent)
        has[has] = frequent["key"][at[has]] == key[has]
        n, m_has = frequent["n"][at[has]], m[has]
        best = regular_best[ids].sum() + m_has[n == highest[key[has] & 0xFFFF]].sum()
        rest = key[~has].astype(np.int64) << 32 | m[~has]
        return int(best), int(regular_n[ids].sum() + (n * m_has).sum()), rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(*x) for x in zip(*(batch.column(i).to_pylist() for i in (7, 8, 9)))]
            best, total, rest = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:7], pa.array(best, pa.int64()), pa.array(total, pa.int64()), pa.array(rest, pa.list_(pa.int64()))],
                [*batch.schema.names[:7], "n_best", "count_sum", "rest"],
            )

    return run


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per document: sizes, digest of its groups, regular A ids, irregular pairs and their numbers.
    Landed, as counting and reporting both read it."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return landed(rows.mapInArrow(_align_texts(path_a, path_b), _ALIGNED), "aligned")


def pair_counts(found: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """key (A id * 65536 + B id), n: links of every id pair corpus-wide; ``regular`` marks identity pairs."""
    identity = aligner(path_a, path_b).identity
    regular = found.select("regular").mapInArrow(_count_regular(len(identity)), "a int, n bigint").groupBy("a").agg(F.sum("n").alias("n"))
    other = found.select("pairs", "times").mapInArrow(_count_pairs, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    mapped = found.sparkSession.createDataFrame(  # vocabulary length
        [(i, i << 16 | int(b)) for i, b in enumerate(identity) if b >= 0], "a int, key bigint"
    )
    same = regular.join(mapped, "a").select("key", F.col("n").alias("_same"))
    return other.join(same, "key", "full").select(
        "key", (F.coalesce("n", F.lit(0)) + F.coalesce("_same", F.lit(0))).alias("n"), F.col("_same").isNotNull().alias("regular")
    )


def _column(rows, name: str) -> np.ndarray:
    return rows.column(name).to_numpy().astype(np.int64)


def report(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    found = aligned(docs, path_a, path_b)
    counts = landed(pair_counts(found, path_a, path_b), "pair-counts")
    both = aligner(path_a, path_b)
    by_b = counts.groupBy(F.col("key").bitwiseAND(0xFFFF).alias("b")).agg(F.max("n").alias("highest"))
    tops = by_b.toArrow()  # at most one row per B id
    highest = np.zeros(len(both.bytes_b), dtype=np.int64)
    highest[_column(tops, "b")] = _column(tops, "highest")
    same = counts.where("regular").select("key", "n").toArrow()  # at most one row per A id
    regular_n = np.zeros(len(both.identity), dtype=np.int64)
    regular_n[_column(same, "key") >> 16] = _column(same, "n")
    most = counts.orderBy(F.desc("n"), "key").limit(FREQUENT).select("key", "n").toArrow()
    frequent = np.zeros(most.num_rows, dtype=_MAPPED)
    frequent["key"], frequent["n"] = _column(most, "key"), _column(most, "n")
    frequent.sort(order="key")

    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    kinds = ", ".join(f for f in _ALIGNED.split(", ")[:7]) + ", n_best bigint, count_sum bigint, rest array<bigint>"
    scored = found.mapInArrow(_score_texts(both.identity, regular_n, highest, frequent), kinds)
    if most.num_rows < FREQUENT:  # then they are all
        return scored.select(*names)
    scored = landed(scored, "scored")
    beyond = counts.join(F.broadcast(by_b), F.col("key").bitwiseAND(0xFFFF) == F.col("b")).select(
        "key", "n", (F.col("n") == F.col("highest")).alias("top")
    )
    link = F.explode("rest").alias("link")
    rest = (
        scored.select("row", link)
        .select("row", F.shiftrightunsigned("link", 32).alias("key"), F.col("link").bitwiseAND(0xFFFFFFFF).alias("m"))
        .join(beyond, "key").groupBy("row")
        .agg(F.sum(F.when(F.col("top"), F.col("m")).otherwise(0)).alias("_best"), F.sum(F.col("m") * F.col("n")).alias("_sum"))
    )
    return scored.join(rest, "row", "left").withColumns({
        "n_best": F.col("n_best") + F.coalesce("_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0)),
    }).select(*names)
