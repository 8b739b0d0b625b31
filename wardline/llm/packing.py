"""Packing along a space-filling curve.

A document is its token ids plus an end token.  The ids, hashed with a sign into ``SLOTS`` slots and
brought to length one, are its vector; a fixed random projection takes it to ``DIMS`` numbers, which
corpus mean and spread turn into coordinates of a grid, and the place on the Hilbert curve through
that grid is the sort key.  Spark range-sorts by (key, doc_id); each partition then lays its documents
end to end and cuts every ``SEQUENCE`` tokens, so neighbours share sequences and nothing is padded
inside a partition.  What is left at a partition's end becomes sequences whose lengths are powers of
two, which need no padding either.

Equal texts have equal keys; the id breaks ties, so a group of copies of any size is spread over
partitions.  Ids are encoded once and landed in the shared scratch folder; the sort moves those.

Defined results: NULL text counts as empty, a document of one token.  Rows with equal ids are packed
each.  A NULL id sorts first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import text_udf
from wardline.llm.tokens import word_bpe
from wardline.session import landed

SEQUENCE = 4096
END = 2
SLOTS, DIMS, BITS = 256, 4, 10
PIECES = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint"
)


def _projection() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slot and sign of every 16-bit id, and the matrix that takes slots to ``DIMS`` numbers."""
    h = np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    slot = ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(56)).astype(np.int64) % SLOTS
    sign = np.where((h >> np.uint64(17)) & np.uint64(1), 1.0, -1.0)
    return slot, sign, np.random.default_rng(7).standard_normal((SLOTS, DIMS))


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_bpe(path)
        slot, sign, matrix = _projection()
        end = np.array([END], "<u2").tobytes()
        for batch in batches:
            docs = batch.column(0).to_pylist()
            for i in range(0, len(docs), 500):
                text = batch.column(1).slice(i, 500).to_pylist()
                ids = [encoder.encode(t or "") + end for t in text]
                vectors = []
                for raw in ids:
                    at = np.frombuffer(raw, "<u2")
                    v = np.bincount(slot[at], weights=sign[at], minlength=SLOTS)
                    vectors.append((v / max(1e-9, np.sqrt(v @ v))) @ matrix)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs[i : i + 500], pa.int64()), pa.array(ids, pa.binary()),
                     pa.array(vectors, pa.list_(pa.float64()))],
                    ["doc_id", "ids", "v"],
                )

    return run


def hilbert(coordinates: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of grid points (rows of unsigned integers below ``2**bits``).

    Skilling's transform: undo the excess work from the top bit down, then Gray-code the axes and
    interleave their bits."""
    x = coordinates.astype(np.int64).T.copy()
    dims = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for i in range(dims):
            flip = (x[i] & bit) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    mask = np.zeros(x.shape[1], dtype=np.int64)
    bit = 1 << (bits - 1)
    while bit > 1:
        mask = np.where(x[-1] & bit, mask ^ (bit - 1), mask)
        bit >>= 1
    x ^= mask
    key = np.zeros(x.shape[1], dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _keys(mean: list[float], spread: list[float]):
    """Column function: projected vector -> place on the curve."""

    def make():
        def fn(vectors):
            z = (np.array(vectors, dtype=np.float64).reshape(-1, DIMS) - mean) / np.maximum(spread, 1e-9)
            unit = 1 / (1 + np.exp(-1.702 * np.clip(z, -8, 8)))
            return pa.array(hilbert((unit * ((1 << BITS) - 1)).astype(np.int64), BITS), pa.int64())

        return fn

    return text_udf(make, "bigint")


def _flush(sequence: list, filled: int, number: int) -> tuple[list, int]:
    """Rows of one sequence, or of its parts of power-of-two length if it is not full."""
    rows, cut, base = [], [], 0
    sizes = [filled] if filled == SEQUENCE else [1 << b for b in range(SEQUENCE.bit_length(), -1, -1) if filled >> b & 1]
    for s in sizes:
        cut.append((base, base + s))
        base += s
    part = 0
    for doc, start, ids, total, offset in sequence:
        at = 0
        while at < len(ids):
            while offset + at >= cut[part][1]:
                part += 1
            n = min(len(ids) - at, cut[part][1] - offset - at)
            crc = zlib.crc32(ids[at : at + n].astype("<u4").tobytes())
            rows.append((doc, start + at, n, crc, total, number + part, offset + at - cut[part][0]))
            at += n
    return rows, number + len(sizes)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 40
    sequence, filled, rows = [], 0, []

    def emit():
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in zip(*rows)],
            ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        )

    for batch in batches:
        for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = np.frombuffer(raw.as_buffer(), "<u2")
            at = 0
            while at < len(ids):
                n = min(len(ids) - at, SEQUENCE - filled)
                sequence.append((doc, at, ids[at : at + n], len(ids), filled))
                at += n
                filled += n
                if filled == SEQUENCE:
                    new, number = _flush(sequence, filled, number)
                    rows += new
                    sequence, filled = [], 0
        if len(rows) >= 5000:
            yield emit()
            rows = []
    if filled:
        rows += _flush(sequence, filled, number)[0]
    if rows:
        yield emit()


def pack(docs: DataFrame, vocabulary: str) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    encoded = landed(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        .mapInArrow(_encode(vocabulary), "doc_id bigint, ids binary, v array<double>"),
        "packing-ids",
    )
    stats = encoded.agg(*[
        f(F.col("v")[i]).alias(f"{name}{i}") for i in range(DIMS) for name, f in (("m", F.avg), ("s", F.stddev_pop))
    ]).first()
    mean, spread = ([stats[f"{k}{i}"] or 0.0 for i in range(DIMS)] for k in "ms")
    return (
        encoded.select("doc_id", "ids", _keys(mean, spread)(F.col("v")).alias("key"))
        .repartitionByRange("key", "doc_id", F.length("ids"), F.crc32("ids"))
        .sortWithinPartitions("key", "doc_id", F.length("ids"), F.crc32("ids"))
        .select("doc_id", "ids")
        .mapInArrow(_pack, PIECES)
    )
