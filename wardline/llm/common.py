"""Helpers that several operators of this package share."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.session import ship_package


#: Rows of one Arrow batch: texts are long, and a worker holds a batch several times over.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Give Python workers this package and small batches."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; NULL for a NULL id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def release_memory() -> None:
    """Hands back what earlier tasks left in this worker process: Spark reuses workers, and one that has encoded
    still holds vocabularies and pieces that a task of another operator does not need."""
    tokens = sys.modules.get("wardline.llm.tokens")
    if tokens:
        tokens.byte_bpe.cache_clear()
        tokens.word_bpe.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def text_udf(make: Callable[[], Callable[[list], pa.Array]], returns) -> Callable[[Column], Column]:
    """Arrow UDF over one column: ``make`` runs once per task and returns a function that maps a
    list of Python values (None for NULL) to an Arrow array of the same length."""

    @F.arrow_udf(returns)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fn = make()
        for batch in batches:
            yield fn(batch.to_pylist())

    return run


def chunks(values: list, max_chars: int):
    """Cut a list of strings into runs of about ``max_chars`` characters (at least one string)."""
    start = size = 0
    for i, v in enumerate(values):
        if size and size + len(v) > max_chars:
            yield values[start:i]
            start, size = i, 0
        size += len(v)
    if start < len(values):
        yield values[start:]
