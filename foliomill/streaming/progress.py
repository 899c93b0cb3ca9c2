"""Structured Streaming: fetched pages to parts, and running progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliomill.operators import pages, store
from foliomill.sources import documents

PAGES = "page_id bigint, url string, html string"


def page_stream(spark: SparkSession, path: str, files: int = 8) -> DataFrame:
    """Pages as they arrive in a folder of Parquet files."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files).parquet(path)


def parsed(stream: DataFrame) -> DataFrame:
    """Parts of a stream of pages; stateless, one parse per page."""
    return pages.page_chapters(stream)


def upsert_parts(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append every micro-batch to a table, tagged with its number. A batch that is
    written again after a failure replaces itself; readers take the last row of a URL
    (``last_parts``)."""

    def write(batch: DataFrame, number: int) -> None:
        tagged = batch.withColumn("batch", F.lit(number))
        tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(target)

    return parsed(stream).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_parts(parts: DataFrame) -> DataFrame:
    """The last delivered row of each URL."""
    return store.latest(parts, ["url"], [-F.col("batch"), -F.col("page_id")])


def merge_parts(spark: SparkSession, target: str) -> None:
    """Reduce a table of batches to the last row of each URL, between runs of the stream.
    Readers see the table before or after; later batches are added as before."""
    documents.write_swapped(last_parts(spark.read.parquet(target)), target, "batch")


def progress(events: DataFrame) -> DataFrame:
    """Parts done, failed and in all by work, of a stream or table of states."""
    return events.groupBy("book_id").agg(
        F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status").isin("failed", "empty")).alias("failed"), F.count("*").alias("total")
    )


def windowed_progress(events: DataFrame, late: str = "10 days", window: str = "30 days") -> DataFrame:
    """Parts fetched by window of time, late ones within the watermark counted; state is
    kept only for open windows. Rows without a time are left out."""
    timed = events.where("fetched_at IS NOT NULL").withWatermark("fetched_at", late)
    return timed.groupBy(F.window("fetched_at", window).alias("w")).agg(F.count("*").alias("parts")).select(F.col("w.start").alias("start"), "parts")
