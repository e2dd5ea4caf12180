"""Vocabularies that grow while documents stream in, and the state of jobs.

A store is a folder of versions. Batch n of a stream matches with the versions up to n and writes what it learns as version n + 1, so a
batch that is repeated reads the same vocabulary and writes the same version again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

VARIANTS = "canon string, variant string"


def start_store(vocab: DataFrame, store: str) -> None:
    """Version 0."""
    vocab.select("canon", "variant").write.mode("overwrite").parquet(f"{store}/version=0")


def as_of(spark: SparkSession, store: str, version: int) -> DataFrame:
    """(canon, variant, version) as known at a version: each variant with the first version that held it, of several names in that the least. Later folders are not read."""
    held = spark.read.schema(f"{VARIANTS}, version int").option("basePath", store).parquet(store).where(F.col("version") <= version)
    first = held.withColumn("variant", F.lower(F.trim("variant"))).groupBy("variant").agg(F.min(F.struct("version", "canon")).alias("f"))
    return first.select("f.canon", "variant", "f.version")


def append_version(learned: DataFrame, store: str, version: int) -> None:
    """Writes (canon, variant) rows that no version before holds as ``version``, in place of what it held."""
    spark = learned.sparkSession
    before = as_of(spark, store, version - 1).select("variant")
    new = learned.select("canon", F.lower(F.trim("variant")).alias("variant")).groupBy("variant").agg(F.min("canon").alias("canon")).join(before, "variant", "left_anti")
    new.select("canon", "variant").write.mode("overwrite").parquet(f"{store}/version={version}")


def match_as_of(headings: DataFrame, store: str) -> DataFrame:
    """``headings`` (heading, version, ...) with canon: each matched with the vocabulary as it was at the row's own version; null where it was not known yet."""
    spark = headings.sparkSession
    every = spark.read.schema(f"{VARIANTS}, version int").option("basePath", store).parquet(store)
    first = every.withColumn("variant", F.lower(F.trim("variant"))).groupBy("variant").agg(F.min(F.struct("version", "canon")).alias("f")).select(F.col("variant").alias("__v"), F.col("f.version").alias("__n"), F.col("f.canon").alias("canon"))
    known = (F.lower(F.trim("heading")) == F.col("__v")) & (F.col("__n") <= F.col("version"))
    return headings.join(first, known, "left").select(*[F.col(f"`{c}`") for c in headings.columns], "canon")


def learn_batches(stream: DataFrame, store: str, out: str, checkpoint: str, work: Callable[[DataFrame, DataFrame], DataFrame], teach: Callable[[DataFrame, DataFrame], DataFrame]):
    """Starts a query that applies ``work`` (batch, vocabulary) to each micro-batch, writes its result to ``out`` and appends what ``teach`` (batch, vocabulary) gives to the store.

    The store must hold version 0. Both are written before the stream's own checkpoint moves on; a batch that is repeated after a failure overwrites its result and its version with the same rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        vocab = as_of(batch.sparkSession, store, number)
        work(batch, vocab).write.mode("overwrite").parquet(f"{out}/batch={number}")
        append_version(teach(batch, vocab), store, number + 1)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


STATUS = "job_id string, status string, n_events bigint, n_failed bigint, updated timestamp"


def job_status(events: DataFrame) -> DataFrame:
    """The state of each job of a stream of events (job_id, status, ts), a row for each job that a micro-batch touches: job_id, status, n_events, n_failed, updated.

    The state store keeps a job's last status by event time, of equal times the greater name; events that come late count, but don't set the status back. Events without a job or a time are passed over.
    """

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        updated, status, n, failed = state.get if state.exists else (pd.Timestamp(0), "", 0, 0)
        best = (pd.Timestamp(updated), status)
        for part in parts:
            n, failed = n + len(part), failed + int((part["status"] == "failed").sum())
            best = max(best, max(zip(part["ts"], part["status"].fillna(""))))
        state.update((best[0].to_pydatetime(), best[1], n, failed))
        yield pd.DataFrame({"job_id": [key[0]], "status": [best[1]], "n_events": [n], "n_failed": [failed], "updated": [best[0]]})

    own = events.where("job_id is not null and ts is not null").select("job_id", "status", "ts")
    return own.groupBy("job_id").applyInPandasWithState(fold, STATUS, "updated timestamp, status string, n bigint, failed bigint", "update", GroupStateTimeout.NoTimeout)
