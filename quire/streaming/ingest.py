"""Folder ingestion as a stream: files that arrive are worked on by the batch operators, each once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_documents(spark: SparkSession, folder: str, schema: str = "doc_id bigint, text string", per_trigger: int = 100) -> DataFrame:
    """Parquet files of documents as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def run_batches(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Starts a query that applies ``work`` to each micro-batch and appends its result; a batch that is repeated replaces what it wrote before."""

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def status_counts(stream: DataFrame, time: str = "ts", late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Counts by window and status, kept until ``late`` after the window."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "status").agg(F.count("*").alias("n")).select("w.start", "w.end", "status", "n")
