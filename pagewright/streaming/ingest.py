"""Pages as a stream: new structured pages are cleaned as they arrive and written once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagewright.operators import elements

SCHEMA = "doc_id string, page_no int, pos int, type string, content string, caption string"


def clean(page_elements: DataFrame) -> DataFrame:
    """The page-level steps that need no other page."""
    return elements.attach_unit_captions(elements.backfill_captions(elements.drop_page_artifacts(elements.dedupe_exact(page_elements))))


def ingest(spark: SparkSession, source: str, sink: str, checkpoint: str, schema: str = SCHEMA) -> StreamingQuery:
    """Runs over the Parquet files of source until all there are done; a rerun takes up only new ones.

    Each batch is written under its own number, so one that is done again after a failure replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        clean(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pages_by_window(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """(window, type, n) of an event stream (ts, event_type): counts by time window, late rows up to the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), F.col("event_type").alias("type")).agg(F.count("*").alias("n"))
