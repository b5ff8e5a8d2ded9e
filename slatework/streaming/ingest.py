"""Incremental ingest of parsed pages: judged as they come, each page once, into a Parquet table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructField, StructType, TimestampType

from slatework import schemas
from slatework.operators.pages import assess_pages


def page_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Pages (PAGE columns and ingested_at) of the JSON files that arrive in a folder."""
    return spark.readStream.schema(StructType([*schemas.PAGE.fields, StructField("ingested_at", TimestampType())])).json(folder)


def judged_once(pages: DataFrame, late: str = "1 day") -> DataFrame:
    """Pages with role and quality; a page that comes again within the time allowed for late rows is dropped.

    The state holds the keys within the watermark only, so it does not grow with the stream.
    """
    once = pages.filter(F.col("document_id").isNotNull()).withWatermark("ingested_at",
        late).dropDuplicatesWithinWatermark(["document_id", "page_number"])
    return assess_pages(once)


def ingest(spark: SparkSession, folder: str, table: str, checkpoint: str, late: str = "1 day") -> StreamingQuery:
    """Work off what is there into a Parquet table, exactly once across restarts (checkpoint must be shared storage)."""
    return (judged_once(page_stream(spark, folder), late).writeStream.format("parquet").option("path", table)
            .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())
