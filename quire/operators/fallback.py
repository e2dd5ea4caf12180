"""Strategies tried one after the other until one gives a result that is good enough."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import cut

Strategy = Callable[[DataFrame], DataFrame]

ATTEMPTS = "array<struct<strategy:string,quality:double,error:string>>"


def parse_order(is_scanned: Column, has_regions: Column, columns: Column) -> Column:
    """The strategies for a document by its layout, first to last."""
    names = lambda *x: F.array(*map(F.lit, x))
    return F.when(is_scanned, names("ocr")).when(has_regions, names("region", "histogram", "ocr")).when(columns >= 2, names("histogram", "region", "ocr")).otherwise(names("native", "histogram", "ocr"))


def after_failure(failed: Column) -> Column:
    """The strategies to try where one has failed."""
    names = lambda *x: F.array(*map(F.lit, x))
    return F.when(failed == "pdf", names("region", "ocr")).when(failed == "region", names("pdf", "ocr")).when(failed == "ocr", names("pdf", "region")).when(failed == "docx", F.array().cast("array<string>")).otherwise(names("pdf", "ocr"))


def fallback_chain(docs: DataFrame, strategies: dict[str, Strategy], order: Column, data_type: str, least: float = 60.0) -> DataFrame:
    """``docs`` with status, strategy, quality, data and attempts, by the strategies that ``order`` (an array of names) lists for each row.

    A strategy takes rows of ``docs`` and returns each of them once with the columns quality (double), data (``data_type``) and error (string, not null where it
    failed). It is given only the rows that all strategies before it in their order left open: the first result of at least ``least`` is accepted. Where none
    is, the best one stays (of equals the first, with its own data) if its quality is above 0. status: accepted, low_quality, or failed (data null). Names that
    ``strategies`` lacks are passed over without an attempt, as are null ones; rows with no order fail without attempts. Rows are never matched by
    an id, so null and repeated ids are rows like any. Each round's rows are written to the shared checkpoint folder, so that no strategy runs twice on a row.
    """
    names = docs.columns
    start = docs.withColumn("__order", F.filter(F.coalesce(order, F.array().cast("array<string>")), lambda x: x.isin(list(strategies))))
    nothing = F.lit(None).cast(f"struct<strategy:string,quality:double,data:{data_type}>")
    open_ = start.withColumns({"__attempts": F.array().cast(ATTEMPTS), "__best": nothing, "__accepted": F.lit(False)})
    rounds = start.agg(F.max(F.size("__order"))).first()[0] or 0
    done = [open_.where(F.size("__order") == 0)]
    open_ = open_.where(F.size("__order") > 0)
    kept = open_.columns
    for number in range(rounds):
        tried = []
        for name, strategy in strategies.items():
            mine = open_.where(F.col("__order")[number] == name)
            tried.append(strategy(mine).select(*kept, F.lit(name).alias("__strategy"), F.col("quality").cast("double").alias("__quality"), F.col("data").alias("__data"), F.col("error").alias("__error")))
        every = reduce(DataFrame.unionAll, tried)
        quality = F.when(F.col("__error").isNull(), F.coalesce("__quality", F.lit(0.0)))
        attempt = F.struct(F.col("__strategy").alias("strategy"), quality.alias("quality"), F.col("__error").alias("error"))
        mine = F.struct(F.col("__strategy").alias("strategy"), quality.alias("quality"), F.col("__data").cast(data_type).alias("data"))
        better = F.coalesce(quality, F.lit(0.0)) > F.coalesce(F.col("__best")["quality"], F.lit(0.0))
        state = every.withColumns({"__attempts": F.array_append("__attempts", attempt), "__best": F.when(better, mine).otherwise(F.col("__best")), "__accepted": F.coalesce(quality >= least, F.lit(False))}).select(*kept)
        state = cut(state)
        closed = F.col("__accepted") | (F.size("__order") == number + 1)
        done.append(state.where(closed))
        open_ = state.where(~closed)
    every = reduce(DataFrame.unionAll, done)
    status = F.when(F.col("__accepted"), "accepted").when(F.col("__best").isNotNull(), "low_quality").otherwise("failed")
    return every.select(*names, status.alias("status"), F.col("__best")["strategy"].alias("strategy"), F.col("__best")["quality"].alias("quality"), F.col("__best")["data"].alias("data"), F.col("__attempts").alias("attempts"))


def attempt_counts(results: DataFrame) -> DataFrame:
    """(stage, strategy, n_tried, n_failed, n_accepted): what each strategy did in each place of an order."""
    each = results.select("status", F.size("attempts").alias("last"), F.posexplode("attempts").alias("stage", "a"))
    accepted = (F.col("status") == "accepted") & (F.col("stage") + 1 == F.col("last"))
    return each.groupBy((F.col("stage") + 1).alias("stage"), F.col("a.strategy").alias("strategy")).agg(F.count("*").alias("n_tried"), F.count_if(F.col("a.error").isNotNull()).alias("n_failed"), F.count_if(accepted).alias("n_accepted"))
