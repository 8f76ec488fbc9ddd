"""Streaming intake: documents cleaned, scored and upserted as they arrive; windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.text import clean_text, extraction_quality


def document_stream(spark: SparkSession, path: str, schema: StructType, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def processed(documents: DataFrame) -> DataFrame:
    """Cleaned text and quality of a batch or a stream of documents."""
    c = clean_text(F.col("text"))
    return documents.select("doc_id", c.alias("text")).withColumn("quality", extraction_quality(F.col("text")))


def start_intake(documents: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Write each micro-batch under its own number, so that a batch that runs again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        processed(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts and sums of events by tumbling window and type; later than `late` is left out."""
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("window.start").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))
    )
