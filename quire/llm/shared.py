"""Helpers that the operators share: cutting lineage and reading tables."""

from __future__ import annotations

import gc
import tempfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Production place of the tokenizer; a parameter of every operator that needs it.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the installed vocabulary lies; asked for where it is used, as executors have their own file systems."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints that driver and executors share: the one the session names in ``spark.checkpoint.dir``.

    A folder of this machine is set only where none is named and all tasks run on this machine, as in tests.
    """
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="quire-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so that later reads survive lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files of tables that nothing refers to any more; it does so only when the driver collects its garbage, which may be long after."""
    gc.collect()
    spark._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, in whatever store it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def most_frequent(counted: DataFrame, n: str, most: int) -> tuple[int, int]:
    """(least count, rows below it): at most ``most`` rows of ``counted`` have that count or more.

    The counts come to the driver as a histogram, eight classes for each power of two, so a few hundred rows at any size.
    """
    power = F.floor(F.log2(n)).cast("int")
    part = F.floor(F.col(n) / F.pow(F.lit(2.0), power) * 8).cast("int")
    classes = counted.groupBy(power.alias("power"), part.alias("part")).agg(F.count("*").alias("rows"), F.min(n).alias("least")).orderBy(F.desc("least")).collect()
    taken, least = 0, None
    for one in classes:
        if taken + one["rows"] > most:
            break
        taken, least = taken + one["rows"], one["least"]
    left = sum(one["rows"] for one in classes) - taken
    return (least if least is not None else (classes[0]["least"] * 2 + 2 if classes else 1)), left


def summed(keys: list[np.ndarray], weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's weights, exact."""
    keys, weights = np.concatenate(keys), np.concatenate(weights)
    if not len(keys):
        return keys, weights
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(weights, starts)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def text_hash(name: str = "text"):
    """With the id it tells rows apart: rows that agree in both are repeated ones."""
    return F.xxhash64(text_or_empty(name))


def known_rows(rows: DataFrame) -> DataFrame:
    """(doc_id, h), each once."""
    return rows.select("doc_id", "h").distinct()


_ID, _HASH = "__row id__", "__row hash__"


def _named(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in df.columns], F.col("doc_id").alias(_ID), text_hash().alias(_HASH))


def _these(named: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    own = rows.select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"))
    return named.join(own, F.col(f"`{_HASH}`").eqNullSafe(F.col("__h")) & F.col(f"`{_ID}`").eqNullSafe(F.col("__id")), how)


def without_rows(df: DataFrame, rows: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """``df`` (with doc_id and text) without the rows that ``rows`` (doc_id, h) names; of those that ``repeated`` names one each stays.

    Null ids equal one another. Of repeated rows with different other columns the least in these is the one that stays,
    by an aggregation that combines map-side.
    """
    names = [f"`{c}`" for c in df.columns]
    left = _these(_named(df), rows, "left_anti")
    if repeated is None or repeated.isEmpty():
        return left.select(*names)
    once = _these(left, repeated, "left_anti").select(*names)
    least = _these(left, repeated, "left_semi").groupBy(f"`{_ID}`", f"`{_HASH}`").agg(F.min(F.struct(*[F.col(c) for c in names])).alias("row"))
    return once.union(least.select(*[F.col(f"row.{c}") for c in names]))
