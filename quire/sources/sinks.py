"""Sinks: JSON, CSV, tables of sections, appends without repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import sanitize_cell
from quire.operators.vocabulary import new_variants


def write_json(df: DataFrame, path: str, by: list[str] = (), mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*by).json(path)


def write_csv(df: DataFrame, path: str, preview: dict[str, int] | None = None) -> None:
    """With a header; all cells quoted and cleaned, the columns of ``preview`` cut to their length."""
    cut = preview or {}
    cells = [(F.substring(sanitize_cell(F.col(c).cast("string")), 1, cut[c]) if c in cut else sanitize_cell(F.col(c).cast("string"))).alias(c) for c in df.columns]
    df.select(*cells).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def batch_header(results: DataFrame) -> DataFrame:
    """One row with the batch's totals, for a file beside the results."""
    return results.agg(
        F.count("*").alias("total_files"), F.count_if(F.col("status") == "success").alias("successful"), F.count_if(F.col("status") == "empty").alias("empty"), F.count_if(F.col("status") == "error").alias("errors")
    )


def write_batch(results: DataFrame, path: str) -> None:
    """Results as JSON lines, and their totals under ``_summary``-like path ``path/summary``."""
    write_json(results, f"{path}/results")
    write_json(batch_header(results).coalesce(1), f"{path}/summary")


def sheets(results: DataFrame, detail: str) -> tuple[DataFrame, DataFrame]:
    """A summary without the array column ``detail``, and the array exploded: the two sheets of a report."""
    key = "doc_id"
    return results.drop(detail).withColumn(f"n_{detail}", F.size(F.coalesce(detail, F.array()))), results.select(key, F.explode(detail).alias("d")).select(key, "d.*")


def append_learned(learned: DataFrame, existing: DataFrame, path: str) -> None:
    """Appends (canon, variant) rows that aren't held yet as JSON lines."""
    new_variants(learned, existing).select(F.col("canon").alias("canonical"), F.col("variant").alias("header")).write.mode("append").json(path)


def filter_experience(results: DataFrame, which: str = "all", column: str = "experiences") -> DataFrame:
    """Rows whose list is empty, not empty, or all."""
    n = F.size(F.coalesce(F.col(column), F.array().cast(results.schema[column].dataType)))
    return results if which == "all" else results.where(n == 0 if which == "empty" else n > 0)
