"""Toxicity by nearest labelled examples.

Examples are a bounded sample of labelled rows (``PER_CLASS`` of each class, chosen by hash of the id;
one of each set of equal texts).  Terms are all words of the examples that are more frequent in toxic
documents; how many documents of each class hold a word is counted over all labelled rows, where near
copies count once: documents count by the smallest hash of their three-word runs.  A text is the
TF-IDF vector of its terms, each weighted by its tie to the label (``ties``); its score comes from the
``NEIGHBOURS`` nearest example vectors by exact cosine with a damped norm, each voting with the square of
the cosine, evened out for the sampling of the classes and drawn to the base rate by a small weight, then
put through a logistic fitted on leave-one-out votes.

The search is exact: example vectors lie in blocks; for each term the index keeps its postings, the largest
weight in each block and the largest of all.  A text's terms are scored in the order of what they can add, until the
rest cannot lift a new example to the nearest found so far; the block weights then leave a few examples,
whose cosines are computed in full.

Defined results: NULL text counts as empty.  A text without terms gets the base rate of examples
without terms.  Equal example vectors are one entry that votes with its counts; between entries of equal
cosine the first in index order wins.  Without examples of both classes the score is the share of toxic
labels (0 if there are no labels).
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import fold, release_memory, text_udf
from wardline.session import landed

PER_CLASS = {0: 6000, 1: 6000}
#: Documents, dealt as the classes are, that smooth the ratio of a term's shares.
PRIOR = 1.0
#: z score and ratio of shares at which a term has half of its full weight.
SURE_Z = 5.0
STRONG_RATIO = 3.0
DAMPING = 2.0
NEIGHBOURS = 15
BLOCK = 64
#: Least and most bits of the map of labelled ids (1 and 16 MB).
BITMAP, MOST_BITS = 1 << 23, 1 << 27
#: Terms that are scored first.
GROUP = 16
THRESHOLD = 0.5
#: Weight with which the base rate joins the votes.
PULL = 0.5
#: Distinct texts whose scores a task remembers.
REMEMBERED = 50_000

_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class Index:
    """Block-max inverted index over vectors given as (term, weight) rows."""

    def __init__(self, vectors: list, n_terms: int, block: int = BLOCK):
        self.block, self.size = block, len(vectors)
        self.blocks = -(-len(vectors) // block)
        rows = [np.asarray(v, dtype=np.float64).reshape(-1, 2) for v in vectors]
        ids = np.repeat(np.arange(len(rows), dtype=np.int32), [len(v) for v in rows])
        terms = np.concatenate([v[:, 0] for v in rows] or [np.zeros(0)]).astype(np.int32)
        weights = np.concatenate([v[:, 1] for v in rows] or [np.zeros(0)])
        order = np.lexsort((ids, terms))
        self.ids, self.weights, terms = ids[order], weights[order], terms[order]
        self.begin = np.searchsorted(terms, np.arange(n_terms + 1))
        # Of each term: the blocks it stands in, where its postings of the block begin, and their largest weight.
        cell = terms.astype(np.int64) * max(1, self.blocks) + self.ids // block
        self.first = np.flatnonzero(np.diff(cell, prepend=-1))
        self.cell = (self.ids[self.first] // block).astype(np.int32)
        self.best = np.maximum.reduceat(self.weights, self.first) if len(self.first) else np.zeros(0)
        self.cells = np.searchsorted(terms[self.first], np.arange(n_terms + 1))
        self.first = np.append(self.first, len(self.ids))
        # The largest weight of each term.
        self.most = np.zeros(n_terms)
        has = np.flatnonzero(np.diff(self.begin))
        if len(has):
            self.most[has] = np.maximum.reduceat(self.weights, self.begin[has])
        self._entries = self._query = None

    @staticmethod
    def _spans(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = end - begin
        return np.repeat(begin - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())

    def _forward(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each entry's terms begin, its terms and their weights; made from the postings when first needed."""
        if self._entries is None:
            order = np.argsort(self.ids, kind="stable")
            terms = np.repeat(np.arange(len(self.begin) - 1, dtype=np.int32), np.diff(self.begin))
            self._entries = np.searchsorted(self.ids[order], np.arange(self.size + 1)), terms[order], self.weights[order]
        return self._entries

    def _exact(self, entries: np.ndarray, terms: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Cosines of ``entries`` with the query."""
        begin, its_terms, its_weights = self._forward()
        if self._query is None:
            self._query = np.zeros(len(self.begin) - 1)
        self._query[terms] = weight
        part = self._spans(begin[entries], begin[entries + 1])
        owner = np.repeat(np.arange(len(entries)), begin[entries + 1] - begin[entries])
        score = np.bincount(owner, its_weights[part] * self._query[its_terms[part]], len(entries))
        self._query[terms] = 0
        return score

    def nearest(self, query, k: int, skip: int = -1) -> list[tuple[float, int]]:
        """(cosine, entry) of the k nearest entries with a positive cosine, nearest first; ``skip`` is left out."""
        q = np.asarray(query, dtype=np.float64).reshape(-1, 2)
        terms, weight = q[:, 0].astype(np.int64), q[:, 1]
        most = weight * self.most[terms]
        order = np.argsort(-most, kind="stable")
        terms, weight = terms[order], weight[order]
        rest = np.append(np.cumsum(most[order][::-1])[::-1], 0.0)  # what the terms from here on can add at most
        score, least, at, step, touched = np.zeros(self.size), 0.0, 0, GROUP, np.zeros(0, dtype=np.int64)
        # Heavy terms first: once the others together cannot reach the k-th best, only entries met so far can.
        while at < len(terms) and rest[at] >= least - 1e-12:
            begin, end = self.begin[terms[at : at + step]], self.begin[terms[at : at + step] + 1]
            spans = list(zip(begin.tolist(), end.tolist()))
            ids = np.concatenate([self.ids[b:e] for b, e in spans])
            share = np.concatenate([self.weights[b:e] for b, e in spans]) * np.repeat(weight[at : at + step], end - begin)
            score += np.bincount(ids, share, self.size)
            if skip >= 0:
                score[skip] = 0
            touched = np.flatnonzero(score)
            if len(touched) >= k:
                least = np.partition(score[touched], -k)[-k]
            at, step = at + step, step * 3
        at = min(at, len(terms))
        found = touched[score[touched] + rest[at] >= least - 1e-11]
        if rest[at] > 0 and len(found) > k:
            # The largest weights in an entry's block bound what the other terms can add to it.
            cells = self._spans(self.cells[terms[at:]], self.cells[terms[at:] + 1])
            more = np.repeat(weight[at:], self.cells[terms[at:] + 1] - self.cells[terms[at:]]) * self.best[cells]
            bound = np.bincount(self.cell[cells], more, self.blocks)
            found = found[score[found] + bound[found // self.block] >= least - 1e-11]
        exact = self._exact(found, terms, weight) if rest[at] > 0 and len(found) else score[found]
        return sorted(((float(s), int(i)) for s, i in zip(exact, found) if s > 0), key=lambda x: (-round(x[0], 12), x[1]))[:k]


def ties(a: np.ndarray, b: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """Weight of terms that ``a`` of ``n1`` toxic and ``b`` of ``n0`` clean documents hold: inverse document
    frequency, times the log ratio of the shares (smoothed by ``PRIOR`` documents), times how sure the
    ratio is.  Falls smoothly to nothing as a term is tied less to toxic documents; 0 only if not tied at all."""
    n = n1 + n0
    ratio = np.log((a + PRIOR * n1 / n) / n1) - np.log((b + PRIOR * n0 / n) / n0)
    mean = (a + b) / n
    z = (a / n1 - b / n0) / np.sqrt(mean * (1 - mean) * (1 / n1 + 1 / n0) + 1e-12)
    sure, strong = np.maximum(z, 0) ** 4, np.maximum(ratio, 0) ** 4
    idf = np.log((n + 1) / (a + b + 1)) + 1e-9
    return idf * sure / (sure + SURE_Z**4) * strong / (strong + math.log(STRONG_RATIO) ** 4)


def unit(terms: np.ndarray, counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """TF-IDF vector of length below one as (term, weight) rows: ``DAMPING`` joins the norm, so that a text of
    weakly tied terms stays short."""
    v = (1 + np.log(counts)) * weights[terms]
    keep = v > 0
    v, terms = v[keep], terms[keep]
    return np.stack([terms, v / math.sqrt(float(v @ v) + DAMPING**2)], 1) if len(v) else np.zeros((0, 2))


class Model:
    def __init__(self, terms: list[str], weights: np.ndarray, entries: list, base: float, empty: float, weight: dict):
        """``entries``: (vector, toxic, clean, example id) of the distinct example vectors."""
        self.terms = {t: i for i, t in enumerate(terms)}
        self.weights, self.base, self.empty, self.weight = weights, base, empty, weight
        # Vectors that share their heaviest term stand together, so that bounds of blocks differ.
        entries = sorted(entries, key=lambda e: (int(e[0][np.argmax(e[0][:, 1]), 0]), e[3]))
        self.toxic = np.array([e[1] for e in entries], dtype=np.float64)
        self.clean = np.array([e[2] for e in entries], dtype=np.float64)
        self.example = [e[3] for e in entries]
        self.index = Index([e[0] for e in entries], len(terms))
        self.slope, self.shift = 1.0, 0.0
        self._calibrate([e[0] for e in entries])

    def vector(self, text: str | None) -> np.ndarray:
        return unit(*term_counts(text, self.terms), self.weights)

    def _vote(self, near: list[tuple[float, int]], own: tuple[float, float, int] | None = None) -> float:
        up, all_ = PULL * self.base, PULL
        for cosine, e in near:
            toxic, clean = self.toxic[e] * self.weight[1], self.clean[e] * self.weight[0]
            if own and own[2] == e:
                toxic, clean = toxic - own[0] * self.weight[1], clean - own[1] * self.weight[0]
            s = cosine * cosine / max(1.0, self.toxic[e] + self.clean[e]) ** 0.5
            up += s * toxic
            all_ += s * (toxic + clean)
        return up / all_

    def _logit(self, p: float) -> float:
        p = min(1 - 1e-4, max(1e-4, p))
        return math.log(p / (1 - p))

    def _calibrate(self, vectors: list) -> None:
        """Logistic on leave-one-out votes, drawn to the identity; Newton steps."""
        x, y, w = [], [], []
        for e, v in enumerate(vectors):
            near = self.index.nearest(v, NEIGHBOURS)
            for label, n, own in ((1, self.toxic[e], (1, 0, e)), (0, self.clean[e], (0, 1, e))):
                if n:
                    x.append(self._logit(self._vote(near, own)))
                    y.append(label)
                    w.append(n * self.weight[label])
        if not x or len(set(y)) < 2:
            return
        a, y, w = np.stack([np.array(x), np.ones(len(x))], 1), np.array(y, dtype=float), np.array(w)
        theta, start, hold = np.array([1.0, 0.0]), np.array([1.0, 0.0]), 5.0
        for _ in range(20):
            p = 1 / (1 + np.exp(-np.clip(a @ theta, -30, 30)))
            grad = a.T @ (w * (p - y)) + hold * (theta - start)
            hess = (a * (w * p * (1 - p))[:, None]).T @ a + hold * np.eye(2)
            step = np.linalg.solve(hess, grad)
            theta = theta - np.clip(step, -1, 1)
        if theta[0] > 0:
            self.slope, self.shift = float(theta[0]), float(theta[1])

    def score(self, text: str | None) -> tuple[float, list[tuple[float, int]]]:
        """Score and nearest entries of a text."""
        v = self.vector(text) if self.index.size else ()
        if not len(v):
            return self.empty, []
        near = self.index.nearest(v, NEIGHBOURS)
        z = self.slope * self._logit(self._vote(near)) + self.shift
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z)))), near


def term_counts(text: str | None, terms: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a text's terms, rising, and how often each occurs."""
    return np.unique(np.array([terms[w] for w in words(text) if w in terms], dtype=np.int32), return_counts=True)


def _vocabulary():
    release_memory()

    def fn(texts):
        return pa.array([sorted(set(words(t))) for t in texts], pa.list_(pa.string()))

    return fn


def _counted(terms: dict[str, int]):
    def make():
        release_memory()

        def fn(texts):
            found = [term_counts(t, terms) for t in texts]
            return pa.array([{"t": t.astype("<i4").tobytes(), "n": n.astype("<i4").tobytes()} for t, n in found],
                            pa.struct([("t", pa.binary()), ("n", pa.binary())]))

        return fn

    return make


def _profile(terms: dict[str, int]):
    """Per text a key that near copies mostly share (the smallest hash of its three-word runs) and the numbers of
    its terms."""

    def make():
        release_memory()

        def fn(texts):
            out = []
            for t in texts:
                w = words(t)
                runs = {" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))}
                found = np.array([terms[x] for x in set(w) if x in terms], dtype="<i4")
                out.append({"copy": min(map(xxhash.xxh64_intdigest, runs)) >> 2, "terms": found.tobytes()})
            return pa.array(out, pa.struct([("copy", pa.int64()), ("terms", pa.binary())]))

        return fn

    return make


def _count_terms(size: int):
    """t, a, b: toxic and clean documents of this task that hold each term; their number under -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, size + 1), dtype=np.int64)
        for batch in batches:
            for y, terms in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[y, -1] += 1
                counts[y, np.frombuffer(terms, "<i4")] += 1
        at = np.flatnonzero(counts.any(0))
        t = np.where(at == size, -1, at)
        yield pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(counts[1, at]), pa.array(counts[0, at])], ["t", "a", "b"])

    return run


def likely(docs: DataFrame, labels: DataFrame, bits: int = BITMAP) -> DataFrame:
    """``docs`` without most of the rows that have no label, so that their texts need not be looked at to find out.

    Ids are hashed into a bitmap of ``bits`` bits; a row whose bit is not set has no label.  The more labels, the
    more others pass too: a join on the ids must decide.  The bitmap is a table of its parts of 32,768 bits."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(bits)) + 1
    marks = (
        labels.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("_bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("_bits"))
    )
    place = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return (
        docs.join(F.broadcast(marks), F.bitmap_bucket_number(bit) == F.col("_bucket"))
        .where(F.getbit(byte, (place % 8).cast("int")) == 1).drop("_bucket", "_bits")
    )


def frequencies(docs: DataFrame, labels: DataFrame, terms: dict[str, int]) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Of each term, the toxic and the clean documents that hold it, and the documents of each class: over all
    labelled rows, near copies counted once.

    Texts are turned into numbers of terms where they are read and are not shuffled.  Only ids and keys are, to find
    the labels and to choose one document of each group of copies; terms are added up inside a task, so a task hands
    on one row per term."""
    profile = text_udf(_profile(terms), "struct<copy: bigint, terms: binary>")
    # Eight bits a label let few rows without one pass, whatever their number.
    bits = min(MOST_BITS, max(BITMAP, 1 << (8 * labels.count()).bit_length()))
    profiles = landed(
        likely(docs.select("doc_id", "text"), labels, bits).select("doc_id", profile(F.coalesce("text", F.lit(""))).alias("p"))
        .select("doc_id", "p.*", F.monotonically_increasing_id().alias("row")),
        "toxic-profiles",
    )
    one = profiles.select("doc_id", "copy", "row").join(labels, "doc_id").groupBy("copy", "y").agg(F.min("row").alias("row"))
    counted = (
        profiles.select("row", "terms").join(one.select("row", "y"), "row").select("y", "terms")
        .mapInArrow(_count_terms(len(terms)), "t int, a bigint, b bigint")
        .groupBy("t").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).toArrow()
    )
    t, a, b = (counted.column(c).to_numpy() for c in ("t", "a", "b"))
    out = np.zeros((2, len(terms) + 1))
    out[0, t], out[1, t] = a, b  # -1 is the last
    return out[0, :-1], out[1, :-1], float(out[0, -1]), float(out[1, -1])


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """``docs``: doc_id, text.  ``labels``: doc_id, y (0 or 1)."""
    release_memory()
    labels = labels.where("y in (0, 1) and doc_id is not null").select("doc_id", F.col("y").cast("int").alias("y"))
    total = {r["y"]: r["count"] for r in labels.groupBy("y").count().collect()}
    if not total:
        return None
    share = F.when(F.col("y") == 1, F.lit(min(1.0, PER_CLASS[1] / total.get(1, 1)))).otherwise(
        F.lit(min(1.0, PER_CLASS[0] / total.get(0, 1)))
    )
    order = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 30))
    # The sample has a fixed bound, so its ids may be sent to every task.
    chosen = F.broadcast(labels.where(order < share * (1 << 30)))
    sample = (
        docs.select("doc_id", "text").join(chosen, "doc_id")
        .select("doc_id", "y", F.coalesce("text", F.lit("")).alias("text"))
        .groupBy("y", F.xxhash64("text").alias("h"))
        .agg(F.min("doc_id").alias("doc_id"), F.first("text").alias("text"))
        .persist()
    )
    try:
        base = total.get(1, 0) / sum(total.values())
        size = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
        if len(size) < 2:
            return Model([], np.zeros(0), [], base, base, {0: 1.0, 1: 1.0})
        # No other word can meet an example.
        names = sample.select(F.explode(text_udf(_vocabulary, "array<string>")(F.col("text"))).alias("w")).distinct().toArrow()
        names = sorted(names.column("w").to_pylist())
        weights = ties(*frequencies(docs, labels, {w: i for i, w in enumerate(names)}))
        release_memory()
        # Words without a weight meet nothing.
        names = [w for w, v in zip(names, weights) if v > 0]
        terms, weights = {w: i for i, w in enumerate(names)}, weights[weights > 0]
        rows = (
            sample.select("doc_id", "y", text_udf(_counted(terms), "struct<t: binary, n: binary>")(F.col("text")).alias("p"))
            .select("doc_id", "y", "p.t", "p.n").toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending")])
        )
        weight = {c: total.get(c, 0) / size[c] for c in (0, 1)}
        scale = min(weight.values())
        weight = {c: w / scale for c, w in weight.items()}
        entries: dict[bytes, list] = {}
        seen = {0: 0, 1: 0}
        for doc_id, y, t, n in zip(*rows.columns):
            v = unit(np.frombuffer(t.as_buffer(), "<i4"), np.frombuffer(n.as_buffer(), "<i4"), weights)
            if not len(v):
                continue
            y = y.as_py()
            e = entries.setdefault(xxhash.xxh3_128_digest(v.tobytes()), [v, 0, 0, doc_id.as_py()])
            e[1 if y else 2] += 1
            seen[y] += 1
        del rows
        none = {c: (size[c] - seen[c]) * weight[c] for c in (0, 1)}
        empty = none[1] / (none[0] + none[1]) if none[0] + none[1] else base
        model = Model(names, weights, list(entries.values()), base, empty, weight)
        del entries, terms
        release_memory()
        return model
    finally:
        sample.unpersist()


def scorer(model: Model | None, evidence: bool = False):
    """Column function: text -> score, or struct(score, evidence) with the ids and cosines of the
    nearest examples."""

    def make():
        release_memory()
        remembered: dict[bytes, tuple] = {}

        def one(text):
            if model is None:
                return 0.0, (), ()
            key = xxhash.xxh3_128_digest(text or "")
            got = remembered.get(key)
            if got is None:
                if len(remembered) >= REMEMBERED:
                    remembered.clear()
                score, near = model.score(text)
                got = remembered[key] = score, array("d", [c for c, _ in near]), array("i", [e for _, e in near])
            return got

        def fn(texts):
            found = [one(t) for t in texts]
            score = pa.array([s for s, *_ in found], pa.float64())
            if not evidence:
                return score
            near = [[{"doc_id": model.example[e], "cosine": c} for c, e in zip(cosines, entries)] for _, cosines, entries in found]
            return pa.StructArray.from_arrays(
                [score, pa.array(near, pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64())])))],
                ["score", "evidence"],
            )

        return fn

    return text_udf(make, "struct<score: double, evidence: array<struct<doc_id: bigint, cosine: double>>>" if evidence else "double")


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (doc_id and cosine of the nearest examples, nearest first) of every
    row; learns from labels outside the held-out fold."""
    model = fit(docs, labels.where(fold(F.col("doc_id"), 5) != 0).select("doc_id", F.col("toxic").alias("y")))
    return docs.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
        scorer(model, evidence=True)(F.col("text")).alias("_s"),
    ).select("doc_id", "held_out", "_s.score", (F.col("_s.score") >= THRESHOLD).cast("int").alias("predicted"), "_s.evidence")
