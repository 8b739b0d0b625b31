"""Near-duplicate documents by HyperMinHash sketches.

A document's set is its distinct word shingles.  Documents of equal sets form a class; everything else
works on one document per class, so exact copies cost one row each however many there are.

* Sketch: shingle hashes are dealt into ``REGISTERS`` buckets; a bucket keeps its smallest hash,
  compressed to the number of its leading zeros and ``MANTISSA`` bits behind the first one.  Empty
  buckets borrow from the first full one in an order of their own, so registers of small sets still
  agree with the probability of the sets' likeness.
* Bands of ``ROWS`` registers are hashed.  A bucket of the band table is a star: each member is paired
  with one pivot of the bucket, not with all members.
* Pairs are estimated (share of agreeing registers, less the expected accidental agreement) and dropped
  only if they lie six standard errors below the threshold; the rest are verified on full sets.
* First each document meets its most likely pivot; then, where pivot and document are still in different
  components, its other pivots; last, members of a bucket that lie outside the bucket's largest component
  meet the members of other components, block by block.  Of those pairs only the ones whose sets can share
  enough, by counts over parts of the hash range, become rows.  A pair is left unverified only if it is
  connected already or cannot be a link.

Two documents of likeness s share a band with probability 1 - (1 - s**ROWS)**BANDS: at 0.85 all but
about 2e-9, at 0.8 all but 3e-6.

Defined results: NULL and empty texts have an empty set and are linked with nothing.  A row with a NULL
id takes no part: its component is NULL and it is kept.  Rows that share an id are meant to be copies;
classes with the same smallest id count as linked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType

from wardline.llm.common import release_memory
from wardline.llm.components import components
from wardline.session import landed

REGISTERS, MANTISSA = 256, 10
ROWS, BANDS = 6, 42
#: Parts of the hash range in which sets are counted, and members of a bucket that meet at a time.
PARTS, BLOCK = 256, 256
#: Words whose hashes a task remembers.
REMEMBERED = 200_000


@dataclass(frozen=True)
class Likeness:
    """Shingle length in words, and the least likeness of a link in per cent."""

    words: int = 5
    percent: int = 80


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Distinct shingle hashes of texts: words are split at ASCII blanks, A-Z in lower case."""

    def __init__(self, words: int):
        self.words, self.known = words, {}
        self.factors = _mix(np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

    def hashes(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes; a text of fewer words than a shingle is one shingle."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, dtype=np.uint64)
        found = list(map(self.known.get, words))
        if None in found:
            if len(self.known) > REMEMBERED:
                self.known = {}
            for i, h in enumerate(found):
                if h is None:
                    found[i] = self.known[words[i]] = xxhash.xxh64_digest(words[i])
        h = np.frombuffer(b"".join(found), dtype=">u8").astype(np.uint64)
        n = min(self.words, len(h))
        total = np.full(len(h) - n + 1, n, dtype=np.uint64)
        for j in range(n):
            total += h[j : len(h) - n + 1 + j] * self.factors[j]
        return np.unique(_mix(total))


def _orders() -> np.ndarray:
    """For each register, the order in which it asks the others."""
    return np.argsort(np.random.default_rng(5).random((REGISTERS, REGISTERS)), axis=1)


def sketch(hashes: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """Compressed registers (16 bits each) of a set that is not empty."""
    bucket = (hashes >> np.uint64(56)).astype(np.int64)
    rest = hashes & np.uint64((1 << 56) - 1)
    # Sorted hashes: the first of each bucket is its smallest.
    full, at = np.unique(bucket, return_index=True)
    low = rest[at].astype(np.float64)  # exponent: leading zeros; the fraction's top bits: mantissa
    fraction, exponent = np.frexp(np.maximum(low, 1.0))
    zeros = 56 - exponent
    mantissa = ((fraction * 2 - 1) * (1 << MANTISSA)).astype(np.int64)
    out = np.zeros(REGISTERS, dtype=np.uint16)
    out[full] = (zeros << MANTISSA | mantissa).astype(np.uint16)
    if len(full) < REGISTERS:
        has = np.zeros(REGISTERS, dtype=bool)
        has[full] = True
        empty = np.flatnonzero(~has)
        out[empty] = out[orders[empty, has[orders[empty]].argmax(1)]]
    return out


def band_keys(registers: np.ndarray) -> np.ndarray:
    """64-bit keys of the bands of sketches (rows of registers); keys of different bands differ."""
    x = registers[:, : ROWS * BANDS].astype(np.uint64).reshape(len(registers), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), x.shape[:2]).copy()
    for r in range(ROWS):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + x[:, :, r])
    return key.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Likeness of sketches a and b (rows) of sets of na and nb members, corrected for accidental
    agreement: about 0.17 * 2**-MANTISSA per register for sets of equal size, less for unequal ones."""
    ratio = na / np.maximum(nb, 1)
    accidental = 0.169919487159739 * 2.0**-MANTISSA * 4 * ratio / (1 + ratio) ** 2
    return np.clip((a == b).mean(1) - accidental, 0.0, 1.0)


def slack(na: np.ndarray, nb: np.ndarray, level: float) -> np.ndarray:
    """Six standard errors of an estimate at ``level``; small sets fill few registers."""
    return 6 * np.sqrt(level * (1 - level) / np.minimum(REGISTERS, np.maximum(1, np.minimum(na, nb))))


def _digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _sketches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        shingler, orders = Shingler(words), _orders()
        for batch in batches:
            n, kind, regs = [], [], []
            for text in batch.column(1):
                h = shingler.hashes(text.as_py())
                n.append(len(h))
                kind.append(_digest(h) if len(h) else None)
                regs.append(sketch(h, orders).tobytes() if len(h) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(kind, pa.binary()), pa.array(regs, pa.binary())],
                ["doc_id", "n", "kind", "regs"],
            )

    return run


def _sets(words: int):
    """id and set of the rows whose set has the digest of their class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        shingler = Shingler(words)
        for batch in batches:
            ids, sets = [], []
            for i, kind, text in zip(*(c for c in batch.columns)):
                h = shingler.hashes(text.as_py())
                if _digest(h) == kind.as_py():
                    ids.append(i.as_py())
                    sets.append(h.view(np.int64))
                if len(ids) >= 500:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["id", "set"])
                    ids, sets = [], []
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["id", "set"])

    return run


@F.arrow_udf(ArrayType(LongType()))
def _bands(regs: pa.Array) -> pa.Array:
    x = np.frombuffer(b"".join(regs.to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)
    keys = band_keys(x)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * BANDS, pa.int32()), pa.array(keys.ravel(), pa.int64()))


def _estimator(percent: int):
    """Column function: sketches and sizes of two sets -> estimate, NULL if it rules a link out."""
    level = percent / 100

    @F.arrow_udf("double")
    def run(a: pa.Array, b: pa.Array, na: pa.Array, nb: pa.Array) -> pa.Array:
        x, y = (np.frombuffer(b"".join(v.to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS) for v in (a, b))
        n, m = (np.asarray(v, dtype=np.float64) for v in (na, nb))
        est = estimate(x, y, n, m)
        # Sizes alone bound the likeness.
        possible = (np.minimum(n, m) * 100 >= np.maximum(n, m) * percent) & (est >= level - slack(n, m, level))
        return pa.array(est, pa.float64(), mask=~possible)

    return run


class _Search:
    """The steps of one run over a table of classes (id, n, kind, regs)."""

    def __init__(self, docs: DataFrame, classes: DataFrame, how: Likeness):
        self.docs, self.classes, self.how = docs, classes, how

    def members(self) -> DataFrame:
        """key, id, pivot: the members of all buckets of two or more, with the bucket's pivot."""
        bands = self.classes.select("id", F.explode(_bands("regs")).alias("key"))
        pivots = (
            bands.groupBy("key").agg(F.min(F.struct(F.xxhash64("id", "key").alias("h"), "id")).alias("p"), F.count("*").alias("n"))
            .where("n > 1").select("key", F.col("p.id").alias("pivot"))
        )
        return bands.join(pivots, "key").select("key", "id", "pivot")

    def estimated(self, pairs: DataFrame) -> DataFrame:
        """a, b, est of the distinct pairs that may be links."""
        one = self.classes.select(F.col("id").alias("a"), F.col("regs").alias("_ra"), F.col("n").alias("_na"))
        two = self.classes.select(F.col("id").alias("b"), F.col("regs").alias("_rb"), F.col("n").alias("_nb"))
        return (
            pairs.select("a", "b").distinct().join(one, "a").join(two, "b")
            .withColumn("est", _estimator(self.how.percent)("_ra", "_rb", "_na", "_nb"))
            .select("a", "b", "est").where("est is not null")
        )

    def sets(self, ids: DataFrame) -> DataFrame:
        kinds = self.classes.select(F.col("id").alias("doc_id"), "kind").join(ids.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
        return self.docs.select("doc_id", "text").join(kinds, "doc_id").select("doc_id", "kind", "text").mapInArrow(
            _sets(self.how.words), "id bigint, set array<bigint>"
        )

    def verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs a, b whose full sets are alike enough."""
        both = (
            pairs.select("a", "b").join(sets.select(F.col("id").alias("a"), F.col("set").alias("_x")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("set").alias("_y")), "b")
        )
        shared = F.size(F.array_intersect("_x", "_y"))
        return (
            both.select("a", "b", shared.alias("_s"), (F.size("_x") + F.size("_y")).alias("_n"))
            .where(100 * F.col("_s") >= self.how.percent * (F.col("_n") - F.col("_s"))).select("a", "b")
        )


def _with_comp(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``pairs`` with ca, cb: the components of a and b so far."""
    if labels is None:
        return pairs.withColumns({"ca": F.col("a"), "cb": F.col("b")})
    return (
        pairs.join(labels.select(F.col("id").alias("a"), F.col("comp").alias("ca")), "a", "left")
        .join(labels.select(F.col("id").alias("b"), F.col("comp").alias("cb")), "b", "left")
        .withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")})
    )


def _merge(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels after joining the components that ``links`` (a, b) connect."""
    if labels is None:
        return components(links)
    over = components(_with_comp(links, labels).select(F.col("ca").alias("a"), F.col("cb").alias("b")).where("a <> b"))
    moved = over.select(F.col("id").alias("comp"), F.col("comp").alias("_new"))
    old = labels.join(moved, "comp", "left").select("id", F.coalesce("_new", "comp").alias("comp"))
    alone = over.join(labels.select("id"), "id", "left_anti").select("id", "comp")
    return landed(old.unionByName(alone), "labels")


def linked(docs: DataFrame, classes: DataFrame, how: Likeness) -> DataFrame:
    """id, comp of the classes that have links; classes without links may be missing."""
    search = _Search(docs, classes, how)
    members = landed(search.members(), "band-members")
    pairs = landed(
        search.estimated(members.where("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b"))), "pivot-pairs"
    )
    sets = landed(search.sets(members.select("id")), "shingle-sets")
    best = pairs.groupBy("a").agg(F.max_by("b", F.struct("est", "b")).alias("b"))
    labels = components(landed(search.verified(best, sets), "links"))
    # Other pivots, where they could still join two components.
    rest = _with_comp(pairs, labels).where("ca <> cb")
    labels = _merge(labels, landed(search.verified(rest, sets), "links"))
    # What a bucket's largest component leaves out meets the members of other components.
    placed = landed(
        members.join(labels, "id", "left").select("key", "id", "pivot", F.coalesce("comp", "id").alias("comp")), "band-components"
    )
    last = landed(search.estimated(landed(_across(placed, sets, how.percent), "cross-pairs")), "cross-estimates")
    return _merge(labels, landed(search.verified(last, sets), "links"))


@F.arrow_udf(BinaryType())
def _counts(sets: pa.Array) -> pa.Array:
    """How many members of a set fall into each of ``PARTS`` parts of the hash range."""
    return pa.array(
        [np.bincount(np.asarray(s.values).view(np.uint64) >> np.uint64(20) & np.uint64(PARTS - 1), minlength=PARTS).astype("<u4").tobytes() for s in sets],
        pa.binary(),
    )


def _may_link(percent: int):
    """From pairs of blocks of one bucket: the pairs across components that could be links.

    Two sets share at most the sum, over the parts of the hash range, of the smaller of their two counts;
    pairs for which even that is too little are left out."""

    def block(members) -> tuple:
        ids, comps = (np.array([m[k] for m in members], dtype=np.int64) for k in ("id", "comp"))
        counts = np.frombuffer(b"".join(m["counts"] for m in members), "<u4").reshape(-1, PARTS).astype(np.int64)
        return ids, comps, counts, np.array([m["main"] for m in members], dtype=bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, two in zip(batch.column(0), batch.column(1)):
                (ids, comps, counts, _), (others, their, theirs, main) = block(one.as_py()), block(two.as_py())
                size, sizes, a, b = counts.sum(1), theirs.sum(1), [], []
                for i in range(len(ids)):
                    at = np.flatnonzero((their != comps[i]) & (main | (ids[i] < others)) & (100 * np.minimum(sizes, size[i]) >= percent * np.maximum(sizes, size[i])))
                    shared = np.minimum(theirs[at], counts[i]).sum(1)
                    at = at[100 * shared >= percent * (sizes[at] + size[i] - shared)]
                    a += [int(ids[i])] * len(at)
                    b += others[at].tolist()
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _across(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs of bucket members in different components that could be links, untested so far.

    Members of a bucket are dealt into blocks of about ``BLOCK``, and what lies outside its largest
    component meets the bucket block by block, so a bucket of any size is spread over tasks."""
    mixed = (
        placed.groupBy("key", "comp").agg(F.count("*").alias("n"))
        .groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("largest"), F.count("*").alias("n"), F.sum("n").alias("size"))
        .where("n > 1").select("key", "largest", F.ceil(F.col("size") / BLOCK).alias("blocks"))
    )
    # The pivot has met all members of its bucket.
    inside = landed(placed.join(mixed, "key").where("id <> pivot").drop("pivot"), "mixed-buckets")
    counts = landed(
        sets.join(inside.select("id").distinct(), "id", "left_semi").select("id", _counts("set").alias("counts")), "part-counts"
    )
    rows = inside.join(counts, "id").select(
        "key", F.pmod(F.xxhash64("id"), "blocks").alias("block"), (F.col("comp") == F.col("largest")).alias("main"), "id", "comp", "counts"
    )
    member = F.collect_list(F.struct("id", "comp", "counts", "main"))
    left = rows.where("not main").groupBy("key", "block").agg(member.alias("one")).select("key", "one")
    right = rows.groupBy("key", "block").agg(member.alias("two")).select("key", "two")
    return left.join(right, "key").select("one", "two").mapInArrow(_may_link(percent), "a bigint, b bigint").distinct()


def groups(docs: DataFrame, how: Likeness = Likeness()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = landed(docs.mapInArrow(_sketches(how.words), "doc_id bigint, n bigint, kind binary, regs binary"), "sketches")
    classes = landed(
        rows.where("kind is not null and doc_id is not null").groupBy("kind")
        .agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("regs").alias("regs")),
        "classes",
    )
    labels = linked(docs, classes, how)
    named = classes.select("kind", "id").join(labels, "id", "left").select("kind", F.coalesce("comp", "id").alias("comp"))
    return rows.select("doc_id", "n", "kind").join(named, "kind", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, how: Likeness = Likeness()) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: one of each group, and rows with a NULL id.  Of rows
    that repeat both id and text one stays."""
    gone = groups(docs, how).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    left = docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
    again = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("_again")).count().where("count > 1").select("_again")
    once = left.join(again, left["doc_id"] == again["_again"], "left_anti")
    more = left.join(again, left["doc_id"] == again["_again"], "left_semi").dropDuplicates(["doc_id", "text"])
    return once.unionByName(more)
