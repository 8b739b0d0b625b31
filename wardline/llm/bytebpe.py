"""Byte-level BPE encoding and decoding over Arrow batches.

Defined results: NULL text counts as empty, which has no tokens.  Texts are encoded whole; repeated
rows are encoded alike.  Decoding gives bytes, so characters that are split over tokens, and ids cut in
the middle of a character, need no special case; as text, broken characters become U+FFFD.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.tokens import byte_bpe

#: Rows handed on at a time, so that the ids of a batch stay small next to its texts.
ROWS = 500


def _ids(raw: list[bytes]) -> pa.Array:
    """List array of token ids."""
    ends = np.cumsum([0, *(len(r) // 4 for r in raw)])
    return pa.LargeListArray.from_arrays(
        pa.array(ends, pa.int64()), pa.array(np.frombuffer(b"".join(raw), "<u4").astype(np.int32), pa.int32())
    ).cast(pa.list_(pa.int32()))


def encode(docs: DataFrame, vocabulary: str, pattern: str, offsets: bool = False) -> DataFrame:
    """doc_id, ids array<int> and, if asked for, spans array<struct<start, end>>: the characters that
    each id covers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(vocabulary, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                raw = [bpe.encode(t or "") for t in part.column(1).to_pylist()]
                columns = [part.column(0), _ids(raw)]
                if offsets:
                    spans = [[{"start": a, "end": b} for a, b in bpe.offsets(r)] for r in raw]
                    columns.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "spans"][: len(columns)])

    schema = "doc_id bigint, ids array<int>" + ", spans array<struct<start: int, end: int>>" * offsets
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id and raw binary: the bytes that ``ids`` stand for (NULL ids: no bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(vocabulary, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                raw = [bpe.decode(np.array(v or [], "<u4").tobytes()) for v in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(raw, pa.binary())], ["doc_id", "raw"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, raw binary")


def round_trip(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode and decode without handing ids to Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(vocabulary, pattern)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            rows = []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py() or "")
                rows.append((len(ids) // 4, sha(ids), sha(bpe.decode(ids))))
            n, a, b = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
