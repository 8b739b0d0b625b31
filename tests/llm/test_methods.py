"""Operators against plain versions of themselves, on the small tables."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as vocabularies
import pytest
import tiktoken
from tokenizers import Tokenizer
from check_oracle import compare, duck

import corpus_pipeline
from wardline.llm import catalog, fingerprint, language, lengths, lines, neardup, packing, quality, tokens, toxicity

BYTE, WORD = vocabularies.path(catalog.BYTE_BPE), vocabularies.path(catalog.WORD_BPE)


@pytest.fixture(scope="module")
def texts(sf):
    return dict(duck(sf).sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


@pytest.fixture(scope="module")
def plain():
    with open(BYTE, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("plain", pat_str=vocabularies.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_sql(spark, sf, name):
    ok, message = compare(catalog.QUERIES[name](spark, sf), duck(sf), catalog.ORACLES[name])
    assert ok, message


def phrases(text):
    """Textbook parse: the longest known phrase plus one character."""
    known, word = set(), ""
    for c in text:
        word += c
        if word not in known:
            known.add(word)
            word = ""
    return known


def test_phrases_are_the_textbook_ones():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("abcdé\n"[: rng.randint(1, 6)]) for _ in range(rng.randint(0, 200)))
        known = set()
        ends = fingerprint.phrase_ends(text, known)
        assert known == phrases(text) and len(ends) == len(known)
        keep, tail = rng.randint(0, len(text)), "".join(rng.choice("abx") for _ in range(20))
        assert fingerprint.Parsed(text).edited(keep, tail) == fingerprint.fingerprint(text[:keep] + tail)


def test_likeness_follows_phrase_sets(texts):
    for a, b in zip(list(texts.values())[:60:2], list(texts.values())[1:60:2]):
        x, y = phrases(a), phrases(a[: len(a) // 2] + b[: len(a) // 2])
        true = len(x & y) / len(x | y)
        got = fingerprint.likeness(fingerprint.fingerprint(a), fingerprint.fingerprint(a[: len(a) // 2] + b[: len(a) // 2]))
        assert abs(true - got) < 0.17


def test_fingerprint_query(spark, sf, texts):
    rows = {r["doc_id"]: r for r in catalog.QUERIES["op1_lempel_ziv_fingerprints"](spark, sf).collect()}
    order = sorted(texts, reverse=True)
    assert set(rows) == set(texts)
    for i, following in zip(order, order[1:] + order[:1]):
        edited = fingerprint.edited_text(texts[i], texts[following])
        assert rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert rows[i]["edited_fingerprint"] == fingerprint.fingerprint(edited).hex()
        assert rows[i]["near_next"] == fingerprint.likeness(fingerprint.fingerprint(texts[i]), fingerprint.fingerprint(texts[following]))


def brute_groups(texts, words, percent):
    sets = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[j : j + words]) for j in range(max(1, len(w) - words + 1))} if w else set()
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    holders = {}
    for i in sorted(sets):
        shared = Counter(j for g in sets[i] for j in holders.get(g, ()))
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
        for g in sets[i]:
            holders.setdefault(g, []).append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates_query(spark, sf, texts):
    rows = catalog.QUERIES["op3_hyperminhash"](spark, sf).collect()
    want = brute_groups(texts, 3, 85)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_chained_near_copies(spark):
    """A large group whose members lie on both sides of the threshold, and exact copies."""
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(150)]
    texts = {}
    for i in range(220):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = f"v{rng.randint(0, 10**6)}"
        texts[i] = " ".join(w)
    texts |= {1000 + i: texts[i % 7] for i in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.groups(docs, neardup.Likeness(3, 85)).collect()}
    assert got == brute_groups(texts, 3, 85)


def test_estimates_are_close():
    rng = np.random.default_rng(1)
    orders = neardup._orders()
    for n in (30, 300, 3000):
        for share in (0.5, 0.85):
            both = rng.integers(0, 2**63, int(n * share), dtype=np.uint64)
            more = int(n * (1 - share) / 2)
            sets = [np.unique(np.concatenate([both, rng.integers(0, 2**63, more, dtype=np.uint64)]) * np.uint64(2)) for _ in "ab"]
            true = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
            a, b = (neardup.sketch(np.sort(neardup._mix(s)), orders) for s in sets)
            est = neardup.estimate(a[None], b[None], np.array([n]), np.array([n]))[0]
            assert abs(est - true) <= neardup.slack(np.array([n]), np.array([n]), true)[0]


def test_nearest_examples_are_exact():
    rng = np.random.default_rng(2)
    vectors = []
    for _ in range(400):
        terms = sorted(rng.choice(50, rng.integers(1, 8), replace=False).tolist())
        w = rng.random(len(terms)) + 0.1
        vectors.append(list(zip(terms, (w / np.linalg.norm(w)).tolist())))
    dense = np.zeros((400, 50))
    for row, v in zip(dense, vectors):
        for t, w in v:
            row[t] = w
    index = toxicity.Index(vectors, 50)
    for q in range(0, 400, 7):
        cosines = dense @ dense[q]
        want = sorted(((-round(c, 12), i) for i, c in enumerate(cosines) if c > 0))[:15]
        assert [i for _, i in index.nearest(vectors[q], 15)] == [i for _, i in want]


def held_out(df, con, label):
    rows = dict(con.sql(f"SELECT doc_id, {label} FROM labels").fetchall())
    out = [(r["score"], r["predicted"], rows[r["doc_id"]]) for r in df.where("held_out").collect() if r["doc_id"] in rows]
    return np.array([s for s, _, _ in out]), np.array([p for _, p, _ in out]), np.array([y for _, _, y in out])


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    score, predicted, y = held_out(catalog.QUERIES["op4_nearest_toxic"](spark, sf), duck(sf), "toxic")
    assert predicted[y == 1].mean() > 0.85 and predicted[y == 0].mean() < 0.03
    evidence = toxicity.scorer(
        toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").selectExpr("doc_id", "toxic as y")),
        evidence=True,
    )
    found = spark.createDataFrame([("stupid idiot clown",), (None,)], "text string").select(evidence("text").alias("e")).collect()
    assert found[0]["e"]["score"] > 0.5 and len(found[0]["e"]["evidence"]) > 0 and found[1]["e"]["evidence"] == []


def test_toxic_words_of_few_rows_count_over_all_labels(spark, monkeypatch):
    rng = np.random.default_rng(8)
    plain = [f"w{i}" for i in range(300)]

    def text(i):
        return " ".join([*rng.choice(plain, 30), *(["nasty"] if i % 2 and i > 24 else ["slur"] if i % 2 else [])])

    rows = [(i, text(i), i % 2) for i in range(800)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, y int")
    score = toxicity.scorer(toxicity.fit(docs, labels), evidence=True)
    asked = spark.createDataFrame([("slur",), ("other",)], "text string").select(score("text").alias("e")).collect()
    assert {e["doc_id"] for e in asked[0]["e"]["evidence"]} == set(range(1, 25, 2))
    assert asked[0]["e"]["score"] > 0.6 > asked[1]["e"]["score"]
    # A smaller sample does not change the counts.
    seen = []
    monkeypatch.setattr(toxicity, "PER_CLASS", {0: 100, 1: 100})
    count = toxicity.frequencies
    monkeypatch.setattr(toxicity, "frequencies", lambda d, y, t: seen.append((t, count(d, y, t))) or seen[0][1])
    toxicity.fit(docs, labels)
    terms, (a, b, n1, n0) = seen[0]
    assert (a[terms["nasty"]], b[terms["nasty"]], n1, n0) == (388, 0, 400, 400)


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    score, predicted, y = held_out(catalog.QUERIES["op7_quadratic_discriminant"](spark, sf), duck(sf), "quality")
    assert predicted[y == 1].mean() > 0.97 and predicted[y == 0].mean() < 0.1


def test_discriminant_is_the_gaussian_one():
    rng = np.random.default_rng(4)
    x = {c: rng.normal(c, 1 + c, (500, quality.FEATURES)) for c in (0, 1)}
    sums = {c: np.concatenate([[len(v)], v.sum(0), (v.T @ v).ravel()]) for c, v in x.items()}
    model = quality.solve(sums, 0.0, 0.0)
    z, logs = x[1][:20], []
    for c in (0, 1):
        m, s = x[c].mean(0), np.cov(x[c].T, bias=True)
        d = z - m
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) - 0.5 * np.linalg.slogdet(s)[1])
    assert np.allclose(model.scores(z), 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -40, 40))))


def test_byte_bpe_is_tiktoken(spark, sf, texts, plain):
    rows = {r["doc_id"]: r for r in catalog.QUERIES["op5_byte_level_bpe"](spark, sf).collect()}
    for i, t in texts.items():
        ids = np.array(plain.encode_ordinary(t), "<u4").tobytes()
        assert (rows[i]["n_tokens"], rows[i]["ids_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())


def test_pieces_do_not_change_ids(plain):
    rng = random.Random(9)
    pool = "aB' .,\n\t é_1²#ß中s're\x1c "
    byte, word = tokens.byte_bpe(BYTE, vocabularies.PATTERN), tokens.word_bpe(WORD)
    whole = Tokenizer.from_file(WORD)
    for _ in range(1500):
        t = "".join(rng.choice(pool) for _ in range(rng.randint(0, 60)))
        ids = byte.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode_ordinary(t)
        assert byte.decode(ids).decode() == t
        assert np.frombuffer(word.encode(t), "<u2").tolist() == whole.encode(t, add_special_tokens=False).ids
    long = "word, and  more\n" * 150_000
    assert b"".join(byte.join(tokens._SPACED.findall(s)) for s in tokens.segments(long, 1000)) == byte.encode(long)


def test_offsets_cover_the_characters():
    byte = tokens.byte_bpe(BYTE, vocabularies.PATTERN)
    text = "naïve 👩‍👩‍👧 ŧext 中"
    ids = byte.encode(text)
    spans = byte.offsets(ids)
    at = 0
    for i, (start, end) in zip(np.frombuffer(ids, "<u4").tolist(), spans):
        raw = byte.raw[i]
        assert raw in text[start:end].encode()
        at += len(raw)
    assert at == len(text.encode()) and spans[0][0] == 0 and spans[-1][1] == len(text)


def test_hilbert_visits_neighbours():
    grid = np.array([[a, b, c] for a in range(8) for b in range(8) for c in range(8)])
    keys = packing.hilbert(grid, 3)
    assert sorted(keys.tolist()) == list(range(512))
    walk = grid[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_packing_query(spark, sf, texts):
    rows = catalog.QUERIES["op6_hilbert_packing"](spark, sf).collect()
    whole = Tokenizer.from_file(WORD)
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, t in texts.items():
        ids = np.array(whole.encode(t, add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : at].tobytes())
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.SEQUENCE and at & (at - 1) == 0


def test_length_report(spark, sf, texts, plain):
    sizes = [len(plain.encode_ordinary(t)) for t in texts.values()]
    report = catalog.QUERIES["op8_length_histogram"](spark, sf)
    rows = report.collect()
    assert {r["n_tokens"] for r in rows} == set(sizes)
    for r in rows:
        n = r["n_tokens"]
        assert r["n_docs"] == sizes.count(n) and r["docs_at_least"] == sum(s >= n for s in sizes)
        assert r["tokens_at_least"] == sum(s for s in sizes if s >= n) and r["tokens_total"] == sum(sizes)
        assert r["truncated_tokens"] == sum(min(s, n) for s in sizes)
        assert r["share_fitting"] == sum(s <= n for s in sizes) / len(sizes)
    for limit in (1, 500, 2048, 10**6):
        assert lengths.at_limit(report, limit).first()["truncated_tokens"] == sum(min(s, limit) for s in sizes)
    assert lengths.quantile(report, 0.5).first()["n_tokens"] == sorted(sizes)[(len(sizes) + 1) // 2 - 1]


def test_language_on_held_out_rows(spark, sf):
    true = dict(duck(sf).sql("SELECT doc_id, lang FROM documents").fetchall())
    rows = catalog.QUERIES["op10_string_kernel_language"](spark, sf).where("held_out").collect()
    assert sum(r["lang_pred"] == true[r["doc_id"]] for r in rows) >= 0.97 * len(rows)


def test_every_language_is_learned(spark):
    rows = [(3 * i + j, chr(0x4E00 + i) * 5 + f" {j}", f"l{i:03}") for i in range(220) for j in range(3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.fit(docs)
    assert len(model.languages) == 220
    best = model.responses([r[1] for r in rows]).argmax(1)
    assert [model.languages[i] for i in best] == [r[2] for r in rows]


def test_folded_weights_are_kernel_ridge_regression(texts):
    sample = [t for t in list(texts.values())[:40]]
    x = language.presence(sample)
    names = ["a" if i % 2 else "b" for i in range(40)]
    model = language.solve(x, names, landmarks=40, ridge=1e-2)
    u = x / np.sqrt(x.sum(1, keepdims=True))
    k = (u @ u.T).astype(float)
    y = np.array([[n == "a", n == "b"] for n in names], dtype=float)
    centre = np.eye(40) - 1 / 40
    kc = centre @ k @ centre
    want = kc @ np.linalg.solve(kc + 0.4 * np.eye(40), y - y.mean(0)) + y.mean(0)
    assert np.abs(model.responses(sample) - want).max() < 0.02


def test_pipeline(spark, sf, texts):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.toPandas(), docs.schema)
        kept[name] = {r["doc_id"] for r in docs.collect()}
    good = {i for i, q in duck(sf).sql("SELECT doc_id, quality FROM labels").fetchall() if q == 1}
    assert len(kept["language"] & good) >= 0.98 * len(good) and len(kept["quality"] & good) >= 0.95 * len(good)
    groups = brute_groups({i: texts[i] for i in kept["quality"]}, 5, 80)
    assert kept["near-duplicates"] == {i for i, (_, top) in groups.items() if i == top}
    packed = {r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()}
    assert packed == kept["near-duplicates"]


def test_frequent_lines_deplete_documents(spark):
    """Lines above a host's limits go; who lives on them is rejected, who only quotes them stays."""
    letters = str.maketrans("0123456789", "abcdefghij")  # digits are normalised away
    shared = [" ".join(f"common{i}word{j}" for j in range(20)).translate(letters) for i in range(4)]
    own = lambda i, n: " ".join(f"own{i}x{j}" for j in range(n)).translate(letters)
    rows = [(i, "\n".join([*shared, own(i, 5)]), "a") for i in range(15)]
    rows += [(100 + i, "\n".join([shared[0], own(100 + i, 70)]), "a") for i in range(15)]
    rows += [(200 + i, "\n".join(shared), "b") for i in range(500)]  # copies of one text count once
    rows += [(800 + i, "\n".join([*shared, own(i, 5)]), "c") for i in range(10)]  # at the limit, not above
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)
    out = {r["doc_id"]: r for r in lines.judge(docs).collect()}
    assert not any(r["base_failed"] for r in out.values())
    assert {i for i, r in out.items() if not r["kept"]} == set(range(15))


def test_repeated_windows():
    """The covered words of repeated three-word windows, against the plain count."""
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    rng = random.Random(8)
    texts = [" ".join(rng.choice("ab cd ef g".split()[: rng.randint(1, 4)]) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["n"] for r in df.select("i", lines.repeated_words(lines.words_of(F.col("t"))).alias("n")).collect()}
    for i, t in enumerate(texts):
        w = t.split()
        n = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        assert got[i] == len({p for j in range(len(w) - 2) if n[tuple(w[j : j + 3])] > 1 for p in (j, j + 1, j + 2)})
