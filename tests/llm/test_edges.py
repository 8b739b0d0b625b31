"""Every operator on NULLs, empty and very long texts, repeated rows, empty tables and clashing columns."""

import hashlib
import zlib

import numpy as np
import public_tokenizers as vocabularies
import pytest
from pyspark.sql import functions as F

from wardline.llm import bytebpe, fingerprint, language, lengths, lines, neardup, packing, quality, toxicity, urls

BYTE, WORD = vocabularies.path("byte_bpe_multi_50k.tiktoken"), vocabularies.path("word_bpe_49k.json")
PATTERN = vocabularies.PATTERN
PROSE = "the quick brown fox jumps over a lazy dog while seven wizards quietly brew potions near an old stone bridge "
LONG = "".join(f"{PROSE}{i} " for i in range(3000))
ROWS = [
    (1, PROSE, "en", "a"), (2, None, None, None), (3, "", "en", ""), (4, " \n\t  ", "en", "a"), (5, PROSE, "en", "a"),
    (5, PROSE, "en", "a"), (None, PROSE, "en", "b"), (7, LONG, "en", "a"), (8, "日本語 ¿qué? é \u0000 👩‍👩‍👧", "xx", "b"),
    (9, "12 345 !!", "en", None),
]
SCHEMA = "doc_id bigint, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    # Columns whose names operators use themselves.
    extra = {c: F.lit("x") for c in ("score", "n", "id", "kind", "regs", "key", "x", "y", "_row", "_l", "host", "kept", "_p", "_gone", "part", "comp")}
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).withColumns(extra)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(
        [(i, i % 2, (i + 1) % 2, "extra") for i in (1, 2, 3, 4, 7, 8)] + [(None, 1, 1, "e"), (5, None, None, "e")],
        "doc_id bigint, quality int, toxic int, text string",
    )


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_fingerprints(docs):
    out = fingerprint.with_edits(docs).collect()
    assert len(out) == len(ROWS)
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    texts = [r[1] or "" for r in order]
    want = sorted(
        (str(r[0]), len(t), hashlib.sha256(fingerprint.edited_text(t, texts[(i + 1) % len(texts)]).encode()).hexdigest())
        for i, (r, t) in enumerate(zip(order, texts))
    )
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in out) == want
    rows = by_id(fingerprint.with_edits(docs))
    assert rows[1]["fingerprint"] == rows[5]["fingerprint"] == rows[None]["fingerprint"]
    assert set(rows[2]["fingerprint"]) == {"0"} and rows[2]["fingerprint"] == rows[3]["fingerprint"]
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out)
    assert fingerprint.with_edits(docs.limit(0)).count() == 0
    one = fingerprint.with_edits(docs.where("doc_id = 7")).first()
    assert one["near_next"] == 1.0
    assert {r["doc_id"] for r in fingerprint.fingerprints(docs).collect()} == {r[0] for r in ROWS}


def test_lines(docs):
    out = lines.judge(docs).collect()
    assert len(out) == len(ROWS)
    rows = by_id(lines.judge(docs))
    assert rows[2]["n_words"] == rows[3]["n_words"] == rows[4]["n_words"] == 0 and not rows[2]["kept"]
    assert rows[1]["n_words"] == 20 and rows[1]["base_failed"]
    assert rows[7]["n_words"] == 21 * 3000 and rows[7]["base_failed"]
    assert rows[9]["word_chars"] == 7
    assert lines.judge(docs.limit(0)).count() == 0


def test_near_duplicates(docs):
    rows = neardup.groups(docs, neardup.Likeness(3, 85)).collect()
    assert len(rows) == len(ROWS)
    got = {r["doc_id"]: r for r in rows}
    assert got[5]["component_id"] == 1 and not got[5]["kept"] and got[1]["kept"]
    assert got[None]["component_id"] is None and got[None]["kept"]
    for i in (2, 3, 4):
        assert got[i]["n_shingles"] == 0 and got[i]["component_id"] == i and got[i]["kept"]
    assert neardup.groups(docs.limit(0)).count() == 0
    stay = neardup.one_of_each(docs)
    assert stay.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in stay.collect()) == sorted(["1", "2", "3", "4", "7", "8", "9", "None"])
    twice = docs.where("doc_id = 5")
    assert neardup.one_of_each(twice).count() == 1


def test_toxicity(docs, labels):
    out = toxicity.score(docs, labels).collect()
    assert len(out) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    assert toxicity.score(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in toxicity.score(docs, labels.limit(0)).collect()} == {0.0}
    assert {r["score"] for r in toxicity.score(docs, labels.where("toxic = 1")).collect()} == {1.0}


def test_byte_bpe(docs):
    out = bytebpe.round_trip(docs, BYTE, PATTERN).collect()
    texts = {}
    for i, t, *_ in ROWS:
        texts.setdefault(i, t or "")
    assert len(out) == len(ROWS)
    for r in out:
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    assert bytebpe.round_trip(docs.limit(0), BYTE, PATTERN).count() == 0
    enc = bytebpe.encode(docs, BYTE, PATTERN, offsets=True)
    back = by_id(bytebpe.decode(enc, BYTE, PATTERN))
    assert all(bytes(back[i]["raw"]).decode() == t for i, t in texts.items())


def test_packing(docs):
    out = packing.pack(docs, WORD).collect()
    total = {}
    for r in out:
        total[r["sequence_id"]] = total.get(r["sequence_id"], 0) + r["length"]
    assert all(n == packing.SEQUENCE or n & (n - 1) == 0 for n in total.values())
    assert {r["doc_id"] for r in out} == {r[0] for r in ROWS}
    empty = [r for r in out if r["doc_id"] == 2]
    assert [(r["start"], r["length"], r["doc_tokens"]) for r in empty] == [(0, 1, 1)]
    assert empty[0]["ids_crc32"] == zlib.crc32(np.array([2], "<u4").tobytes())
    assert sum(r["length"] for r in out if r["doc_id"] == 7) == [r["doc_tokens"] for r in out if r["doc_id"] == 7][0]
    assert packing.pack(docs.limit(0), WORD).count() == 0


def test_quality(docs, labels):
    out = quality.score(docs, labels).collect()
    assert len(out) == len(ROWS) and all(0 <= r["score"] <= 1 for r in out)
    assert quality.score(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in quality.score(docs, labels.limit(0)).collect()} == {0.5}
    model = quality.fit(quality.with_features(docs), quality.training_labels(labels, "quality"))
    assert quality.reject(docs, model).columns == docs.columns


def test_lengths(docs):
    texts = [r[1] or "" for r in ROWS]
    out = {r["n_tokens"]: r for r in lengths.report(docs, BYTE, PATTERN).collect()}
    assert sum(r["n_docs"] for r in out.values()) == len(texts) and out[0]["n_docs"] == 2
    assert lengths.report(docs.limit(0), BYTE, PATTERN).count() == 0


def test_urls(spark):
    given = [
        (1, "https://A.Example.ORG/en/2?x"), (2, None), (3, "no scheme"), (4, "http://example.org/es/"), (5, "http://b.example.org/en/17#t"),
        (6, "http://x.com"), (7, "http://x.com/fr/1://y"), (8, ""), (9, "http://xcom/de/"), (9, "http://xcom/de/"), (10, "http://com/de/é\n"),
        (None, "http://q.example.net/" + "a" * 5000), (11, "http://example.org?x/es/"),
    ]
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in given], "page_id bigint, url string, host string, verdict string")
    rows = {r["page_id"]: r for r in urls.judge(pages).collect()}
    assert (rows[1]["host"], rows[1]["path"], rows[1]["rule"], rows[1]["verdict"]) == ("a.example.org", "/en/2", "org/", "allow")
    assert (rows[2]["host"], rows[2]["path"]) == (rows[3]["host"], rows[3]["path"]) == ("", "")
    assert (rows[4]["rule"], rows[4]["verdict"]) == ("example.org/es/", "block")
    assert rows[5]["rule"] == "example.org/en/1" and rows[6]["rule"] is None and rows[6]["path"] == ""
    assert rows[7]["rule"] == "com/fr/" and rows[9]["rule"] is None and rows[10]["rule"] == "com/de/"
    assert rows[11]["rule"] is None and rows[11]["path"] == ""
    assert {r["verdict"] for r in rows.values()} <= {"allow", "block"} and urls.judge(pages).count() == len(given)
    assert urls.judge(pages.limit(0)).count() == 0
    unruled = pages.where("page_id in (2, 6)")
    assert {r["verdict"] for r in urls.judge(unruled).collect()} == {"allow"}


def test_language(docs):
    model = language.fit(language.training_rows(docs))
    out = by_id(language.identify(docs, model))
    for i in (2, 3, 4, 9):
        assert (out[i]["lang_pred"], out[i]["score"]) == ("und", 0.0)
    assert out[7]["lang_pred"] == "en" and out[None]["held_out"] is False
    assert language.fit(docs.limit(0)) is None
    assert {r["lang_pred"] for r in language.identify(docs, None).collect()} == {"und"}
    assert language.reject(docs, model).columns == docs.columns
    assert language.identify(docs.limit(0), model).count() == 0
