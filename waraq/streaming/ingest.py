"""Resumable, append-only landing of pages as a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from waraq.shared import fresh_path


def page_stream(spark: SparkSession, path: str, schema: StructType, kind: str = "parquet", files_per_trigger: int = 64) -> DataFrame:
    """Stream of the files at ``path``; each is read once, whatever restarts happen."""
    return spark.readStream.schema(schema).format(kind).option("maxFilesPerTrigger", files_per_trigger).load(path)


def first_deliveries(pages: DataFrame, watermark: str | None = None) -> DataFrame:
    """One row of each page of the stream: (book_id, number, sub_idx).

    With a ``watermark`` on received_at the state of pages older than it is dropped; without, the state holds every page seen.
    """
    rows = pages.select("book_id", F.coalesce("page_id", "url_page_id").alias("number"), "sub_idx", "received_at").where("number IS NOT NULL")
    if watermark:
        return rows.withWatermark("received_at", watermark).dropDuplicatesWithinWatermark(["book_id", "number", "sub_idx"])
    return rows.drop("received_at").dropDuplicates(["book_id", "number", "sub_idx"])


def land(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Append what is there now to ``target`` and stop; the next call goes on after the last committed batch, exactly once."""
    stream.writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def landed(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of ``folder`` landed through the stream into the shared folder."""
    schema = spark.read.parquet(f"{folder}/pages.parquet").schema
    target = fresh_path(spark, "landed")
    land(first_deliveries(page_stream(spark, f"{folder}/pages.parquet*", schema)), f"{target}/data", f"{target}/checkpoint")
    return spark.read.schema("book_id int, number int, sub_idx int").parquet(f"{target}/data")
