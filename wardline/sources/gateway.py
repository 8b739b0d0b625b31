"""Reading gateway events (batch, stream, log lines) and writing alert lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from wardline.schemas import ENVELOPE, GATEWAY_EVENT

INDEX = "gateway"
SOURCE = "ai-gateway"
WATERMARK = "10 minutes"


def unwrap(envelopes: DataFrame, index: str | None = INDEX) -> DataFrame:
    """Envelope rows to flat event columns, one index only."""
    picked = envelopes if index is None else envelopes.filter(F.col("index") == index)
    return picked.select("event.*")


#: Where :func:`split_lines` notes a line that is no event.
BAD = "_bad"


def split_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Envelopes, and the lines that are none (``file``, ``line``), of text lines: tables and streams alike.

    A line that is not JSON, is cut short, or holds a value of the wrong type is bad as a whole; blank lines are
    neither.  The schema is fixed, nothing is inferred."""
    schema = StructType([*ENVELOPE.fields, StructField(BAD, StringType())])
    read = lines.where(F.trim("value") != "").select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"),
        F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}).alias("e"),
    )
    sound = F.col("e").isNotNull() & F.col(f"e.{BAD}").isNull()
    return read.where(sound).select("e.*").drop(BAD), read.where(~sound).select("file", "line")


def read_gateway_events(spark: SparkSession, path: str, index: str | None = INDEX) -> DataFrame:
    """JSON lines of ``{sourcetype, index, event}``; :func:`bad_gateway_lines` has the rest."""
    return unwrap(split_lines(spark.read.text(path))[0], index)


def bad_gateway_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line: what :func:`read_gateway_events` could not read."""
    return split_lines(spark.read.text(path))[1]


def with_event_time(df: DataFrame, us: str = "us") -> DataFrame:
    return df.withColumn("ts", F.timestamp_micros(F.col(us)))


def stream_gateway_events(
    spark: SparkSession,
    path: str,
    index: str | None = INDEX,
    files_per_batch: int = 1000,
    watermark: str = WATERMARK,
) -> DataFrame:
    """The same feed as a file stream with an event-time watermark."""
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    return with_event_time(unwrap(split_lines(raw)[0], index)).withWatermark("ts", watermark)


def stream_bad_gateway_lines(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """The unreadable lines of the same feed as a stream of their own."""
    return split_lines(spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path))[1]


def decode_siem_json(df: DataFrame, line: str = "line", source: str = SOURCE) -> DataFrame:
    """Keep log lines that begin with the gateway's source field and decode them."""
    prefix = '{"source": "' + source + '"'
    return (
        df.filter(F.col(line).startswith(prefix))
        .select(*[c for c in df.columns if c != line], F.from_json(line, GATEWAY_EVENT).alias("event"))
    )


def write_alert_jsonl(df: DataFrame, path: str) -> None:
    """Append one JSON object per alert."""
    df.write.mode("append").json(path)


def alert_sink(path: str, query: str):
    """``foreachBatch`` writer: a replayed batch overwrites its own folder, so alerts stay single."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/query={query}/batch_id={batch_id}")

    return write
