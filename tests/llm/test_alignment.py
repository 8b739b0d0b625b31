"""Tokenizer alignment against a plain version that encodes whole texts and compares all byte ranges."""

import hashlib
import random
from collections import Counter

import public_tokenizers as vocabularies
import pytest
from check_oracle import duck
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wardline.llm import alignment, catalog

A, B = vocabularies.path(catalog.ALIGNED_BPE), vocabularies.path(catalog.PIECES)
ODD = [
    "", None, " ", "  ", "\n", " \n ", "a\t b", "a ", "a  \n", "x▁y", "\n\n  foo\n bar \n\n", "日本語 テキスト　空白 ", "don't  it's\n'll",
    "a\x85 b", "<|endoftext|> <s> <0x0A>", "\x00 \x1c x", "é á b", "foo\n \nbar", "  lead", "foo,bar baz... %% qux%", "x², y.",
    "👩‍👩‍👧 ok", "x" * 5000, "the quick brown fox " * 4000, "AaAaaaAAA aaaa" * 30,
]


@pytest.fixture(scope="module")
def both():
    return alignment.Aligner(A, B)


def plain(texts, both):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, digest) of each text."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    found, links, counts = [], [], Counter()
    for text in texts:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = both.b.encode(text) if text else []
        raw = (" " + text).encode() if text else b""
        if b"".join(both.bytes_a[i] for i in ids_a) != raw or b"".join(both.bytes_b[i] for i in ids_b) != raw:
            ids_a = ids_b = []
        spans = []
        for ids, raws in ((ids_a, both.bytes_a), (ids_b, both.bytes_b)):
            at, out = 0, []
            for i in ids:
                out.append((at, at + len(raws[i])))
                at += len(raws[i])
            spans.append(out)
        here, low = [], 0
        for i, (start, end) in zip(ids_a, spans[0]):
            while spans[1][low][1] <= start:
                low += 1
            j = low
            while j < len(ids_b) and spans[1][j][0] < end:
                here.append((i, ids_b[j]))
                j += 1
        groups, i, j = [], 0, 0
        for cut in sorted({e for _, e in spans[0]} & {e for _, e in spans[1]}):
            k = next(x for x in range(i, len(ids_a)) if spans[0][x][1] == cut) + 1
            m = next(x for x in range(j, len(ids_b)) if spans[1][x][1] == cut) + 1
            groups.append(",".join(map(str, ids_a[i:k])) + "|" + ",".join(map(str, ids_b[j:m])))
            i, j = k, m
        counts.update(here)
        links.append(here)
        found.append((len(ids_a), len(ids_b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    highest = Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    return [
        (n_a, n_b, n, len(h), sum(counts[x] == highest[x[1]] for x in h), sum(counts[x] for x in h), digest)
        for (n_a, n_b, n, digest), h in zip(found, links)
    ]


def as_rows(df):
    return sorted((str(r["doc_id"]), r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in df.collect())


@pytest.mark.parametrize("frequent", [alignment.FREQUENT, 40])
def test_query(spark, sf, both, monkeypatch, frequent):
    monkeypatch.setattr(alignment, "FREQUENT", frequent)
    texts = dict(duck(sf).sql("SELECT doc_id, text FROM documents").fetchall())
    want = sorted((str(i), *r) for i, r in zip(texts, plain(texts.values(), both)))
    assert as_rows(catalog.QUERIES["op11_cross_tokenizer_alignment"](spark, sf)) == want


def test_odd_texts(spark, both):
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice("ab é\n.,'1▁日\t ") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    ids = [None if i == 3 else i // 2 for i in range(len(texts))]  # repeated and NULL ids
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id bigint, text string").repartition(3)
    docs = docs.withColumns({c: F.lit("x") for c in ("row", "n_a", "pairs", "times", "key", "n", "rest", "regular")})
    want = sorted((str(i), *r) for i, r in zip(ids, plain(texts, both)))
    assert as_rows(alignment.report(docs, A, B)) == want
    assert alignment.report(docs.limit(0), A, B).count() == 0


def test_pieces_equal_whole_texts(both):
    words = [p for t in ODD if t for p in both.pieces(" " + t)]
    assert all("".join(both.pieces(" " + t)) == " " + t for t in ODD if t)
    small = alignment.Aligner(A, B)
    assert small.word is not None and small.cut is alignment._PARTED
    fast = small.encode(words)
    small.word = None  # all by the tokenizers library
    assert small.encode(words) == fast


def test_worker_keeps_two_generations(both, monkeypatch):
    monkeypatch.setattr(alignment, "PIECES", 50)
    texts = [" ".join(f"w{i % k}x" for i in range(40)) for k in range(1, 60)]
    fresh = alignment.Aligner(A, B)
    got = [";".join(f.groups for f in found) for found in fresh.texts(texts)]
    assert got == [both.encode([" " + t])[0].groups for t in texts]
    assert len(fresh.known) + len(fresh.before) <= 150
