"""Encoders over public vocabulary files, for use inside Arrow batches.

Both encoders split a text at places that no pre-token can span (after a run of non-blank
characters; between a letter and a following mark other than an apostrophe), keep the ids of each
distinct piece, and let the ``tokenizers`` library encode the pieces they have not met.  Most words
of a corpus repeat, so the merges run once per word and worker instead of once per occurrence; the
ids are those of the whole text.  A worker holds at most ``PIECES`` pieces (the word encoder three times
as many) and starts afresh beyond.
"""

from __future__ import annotations

import base64
import os
import re
import unicodedata
from functools import lru_cache

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

PIECES = 250_000
#: Pieces longer than this are encoded each time.
LONGEST = 40
#: Characters of one text that are cut into pieces at a time.
SEGMENT = 1 << 20

#: The vocabularies' white space is Python's without the four separator controls.
_SPACED = re.compile(r"[^\S\x1c-\x1f]*[^\W\d_]+(?=[^\w'])|[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")
_BARE = re.compile(r"[^\W\d_]+(?=[^\w'])|[\S\x1c-\x1f]+")
_END = re.compile(r"(?<=\S)(?=[^\S\x1c-\x1f])")


def segments(text: str, size: int = SEGMENT):
    """Cut a text into stretches of about ``size`` characters, each ending before a blank that
    follows a non-blank character."""
    start = 0
    while len(text) - start > size:
        m = _END.search(text, start + size)
        if not m:
            break
        yield text[start : m.start()]
        start = m.start()
    yield text[start:] if start else text


def byte_characters() -> dict[int, str]:
    """One printable character for each byte: itself where it is printable, else one from 256 on."""
    plain = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace()]
    moved = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(moved)}


TO_CHARACTER = byte_characters()
_TRANSLATION = str.maketrans({chr(b): c for b, c in TO_CHARACTER.items()})


def spelled(text: str) -> str:
    """The UTF-8 bytes of a text in byte characters."""
    return text.encode("utf-8").decode("latin-1").translate(_TRANSLATION)


class _Pieces:
    """Base: ids of texts as little-endian bytes of ``dtype``, by pieces."""

    dtype = "<u4"
    most = PIECES

    def __init__(self):
        self.known: dict[str, bytes] = {}

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of new pieces; short ones are kept."""
        if len(self.known) + len(pieces) > self.most:
            self.known = {}
        fresh, rest = {}, []
        for p in pieces:
            word = self.word(p)
            if word is None:
                rest.append(p)
            else:
                fresh[p] = np.array([t.id for t in self.model.tokenize(word)], self.dtype).tobytes()
        for i in range(0, len(rest), 1000):
            part = rest[i : i + 1000]
            for p, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                fresh[p] = np.array(e.ids, self.dtype).tobytes()
        self.known.update((p, v) for p, v in fresh.items() if len(p) <= LONGEST)
        return fresh

    def join(self, pieces: list[str]) -> bytes:
        found = list(map(self.known.get, pieces))
        if None in found:
            fresh = self.learn({p for p, ids in zip(pieces, found) if ids is None})
            found = [fresh[p] if ids is None else ids for p, ids in zip(pieces, found)]
        return b"".join(found)


class ByteBPE(_Pieces):
    """Byte-level BPE over a rank file, as tiktoken encodes ordinary text.

    Bytes are written as printable characters, one each, so that the ``tokenizers`` library can hold
    the vocabulary; every split of a token into two known tokens is a merge, in the order of ranks,
    and a piece that is a token itself is taken whole.
    """

    def __init__(self, path: str, pattern: str):
        super().__init__()
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        to_byte = {c: b for b, c in TO_CHARACTER.items()}
        spell = lambda raw: "".join(map(TO_CHARACTER.__getitem__, raw))
        vocabulary = {spell(k): v for k, v in ranks.items()}
        merges = [
            (spell(k[:j]), spell(k[j:]))
            for k in sorted(ranks, key=ranks.__getitem__)
            for j in range(1, len(k))
            if k[:j] in ranks and k[j:] in ranks
        ]
        self.tokenizer = Tokenizer(models.BPE(vocab=vocabulary, merges=merges, ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(Regex(pattern), "removed", invert=True),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ])
        self.model = self.tokenizer.model
        self.raw = {v: bytes(map(to_byte.__getitem__, k)) for k, v in vocabulary.items()}

    def word(self, piece: str) -> str | None:
        """The piece in byte characters if it is one run of letters (after at most one space)."""
        body = piece[1:] if piece[:1] == " " else piece
        return spelled(piece) if body.isalpha() else None

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, as little-endian unsigned 32-bit integers."""
        return b"".join(self.join(_SPACED.findall(s)) for s in segments(text))

    def decode(self, ids: bytes) -> bytes:
        """Bytes of ids.  A character split over tokens is whole again once the bytes are joined."""
        return b"".join(map(self.raw.__getitem__, np.frombuffer(ids, self.dtype).tolist()))

    def offsets(self, ids: bytes) -> list[tuple[int, int]]:
        """Character span (start, end) of each id in the decoded text; a token that holds only part
        of a character spans that whole character."""
        raw = np.frombuffer(self.decode(ids), dtype=np.uint8)
        size = np.array([len(self.raw[i]) for i in np.frombuffer(ids, self.dtype).tolist()], dtype=np.int64)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        end = np.cumsum(size)
        return [(int(char[e - n]), int(char[e - 1]) + 1) for e, n in zip(end, size)]


class WordBPE(_Pieces):
    """BPE with word ends from a tokenizer file that lower-cases and drops white space."""

    dtype = "<u2"
    most = 3 * PIECES  # its pieces are short

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model

    def word(self, piece: str) -> str | None:
        return spelled(piece) if piece.isalpha() else None

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        # A comma or stop after a run of letters is a token of its own.
        marked = {p for p in pieces if p[-1] in ".," and p[:-1].isalpha()}
        if not marked:
            return super().learn(pieces)
        known = self.known
        bare = {p[:-1] for p in marked} - pieces
        fresh = super().learn(pieces - marked | {p for p in bare if p not in known} | {".", ","})
        whole = {p: (fresh.get(p[:-1]) or known[p[:-1]]) + fresh[p[-1]] for p in marked}
        self.known.update((p, v) for p, v in whole.items() if len(p) <= LONGEST)
        return fresh | whole

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, as little-endian unsigned 16-bit integers."""
        if "Σ" in text or "İ" in text or not unicodedata.is_normalized("NFC", text):
            # Lower-casing or composing here could differ from the tokenizer's own.
            return b"".join(
                np.array(self.tokenizer.encode(s, add_special_tokens=False).ids, self.dtype).tobytes()
                for s in segments(text)
            )
        # str.split() also splits at the separator controls, which the vocabulary keeps.
        split = _BARE.findall if any(c in text for c in "\x1c\x1d\x1e\x1f") else str.split
        return b"".join(self.join(split(s.lower())) for s in segments(text))


@lru_cache(maxsize=4)
def byte_bpe(path: str, pattern: str) -> ByteBPE:
    """One encoder per worker process and vocabulary."""
    return ByteBPE(path, pattern)


@lru_cache(maxsize=4)
def word_bpe(path: str) -> WordBPE:
    return WordBPE(path)
