"""Live views: log errors as a stream of lines, and plays kept as the last time of each item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.logs import clean_text, error_text, is_error, log_level


def error_stream(spark: SparkSession, path: str) -> DataFrame:
    """Error lines of files that come into a folder; stateless, so append mode needs no watermark."""
    lines = spark.readStream.text(path).withColumn("file", F.col("_metadata.file_name"))
    return errors(lines.withColumnRenamed("value", "line"))


def errors(lines: DataFrame) -> DataFrame:
    """The stream's and the batch's common part."""
    line = F.col("line")
    return lines.where(is_error(line)).select("file", log_level(line).alias("level"), error_text(line).alias("message"), clean_text(line).alias("clean_message"))


def run_error_stream(spark: SparkSession, path: str, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Write error lines to Parquet: every so often ('5 seconds'), or once over what is there."""
    return write_errors(error_stream(spark, path), out, checkpoint, every)


def write_errors(found: DataFrame, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Write a stream of error lines: every so often, or once over what is there."""
    writer = found.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start(out)


def last_plays(events: DataFrame, watermark: str = "1 day") -> DataFrame:
    """A stream of plays (event_id, user_id, item_id, ts) without repeated events, as the last time by user and item."""
    once = events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy("user_id", "item_id").agg(F.max("ts").alias("last_played"))
