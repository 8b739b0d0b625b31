"""Spelling variants against a plain version that tries every edit of every word."""

import random
import re
import zlib
from collections import Counter

import pytest
from check_oracle import duck
from pyspark.sql import functions as F

from wardline.llm import catalog, variants

ALPHABET = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))


def plain(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= 2}
    near, form = {}, {}
    for w in words:
        if len(w) > 200:  # only fixed long words below; they have no near words
            near[w] = set()
            continue
        edits = {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in ALPHABET}
        edits |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in ["", *ALPHABET]}
        near[w] = {e for e in edits if e in words} - {w}
    for w, others in near.items():
        most = max((words[x] for x in others), default=0)
        if most >= 10 * words[w]:
            form[w] = min(x for x in others if words[x] == most)

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()}


def as_rows(df):
    rows = [(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query(spark, sf):
    rows = duck(sf).sql("SELECT doc_id, text FROM documents").fetchall()
    assert as_rows(catalog.QUERIES["op12_spelling_variants"](spark, sf)) == plain(rows)


@pytest.fixture(scope="module")
def crowded():
    """Words that crowd around each other, runs of equal letters, chains of forms, ties, very long words."""
    rng = random.Random(8)
    bases = ["aaaaaaa", "abababab", "zürichsee", "colours", "aaaaaaaaa", "þþþþþþþ÷"]
    pool = set(bases)
    for _ in range(250):
        w = rng.choice(sorted(pool))
        i = rng.randrange(len(w))
        pool.add(rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abcé") + w[i:], w[:i] + rng.choice("abcé") + w[i + 1 :]]))
    texts = [" ".join(rng.choices(sorted(pool), k=60)) for _ in range(40)]
    texts += ["Colours " * 3000, "coloors " * 150, "colloors " * 6, "kolours 1 " * 150, None, "", "x y", "q" * 20000 + " " + "q" * 20000, "Ünïcödé ÜNÏCÖDÉ " * 3]
    return [(None if i == 5 else i // 2, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_crowded_words(spark, crowded, partitions):
    docs = spark.createDataFrame(crowded, "doc_id bigint, text string").repartition(4)
    docs = docs.withColumns({c: F.lit("x") for c in ("word", "n", "id", "forward", "backward", "form", "root", "prefix", "_key", "_part")})
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = as_rows(variants.grouped(docs))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == plain(crowded)
    assert any(f and r != f for _, f, r, *_ in got)  # a chain of forms
    assert variants.grouped(docs.limit(0)).count() == 0


def test_nodes_number_prefixes(spark):
    rng = random.Random(2)
    words = sorted({"".join(rng.choices("abc", k=rng.randint(1, 9))) for _ in range(500)} | {"a" * 300_000, "a" * 300_000 + "b"})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    node, prefix = {}, {}
    for r in variants.numbered(df, F.col("word"), "nodes").collect():
        assert len(r["nodes"]) == len(r["word"]) + 1
        for i, v in enumerate(r["nodes"]):
            if len(r["word"]) > 100 and i % 1000:
                continue
            assert node.setdefault(r["word"][:i], v) == v and prefix.setdefault(v, r["word"][:i]) == r["word"][:i]
    assert [node[w] for w in words if len(w) < 100] == sorted(node[w] for w in words if len(w) < 100)
