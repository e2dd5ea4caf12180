"""Operator 6, exact dedup (native): heavy digests by broadcast, the others by shuffle.

1. A digest of the text without white space, and the text's length, are written
   once; texts are not read again.
2. A frequent-items sketch (the Misra-Gries family; Spark's ``approx_top_k``)
   over 64-bit hashes of the digests names candidates: every digest with more
   than a ``1 / tracked`` part of the rows is among those it tracks. The sketches of
   the tasks are combined in two steps.
3. The candidates' groups are counted exactly and their winners found by an
   ordinary aggregation, which combines map-side. These winners, at most
   ``heavy`` hashes' worth, are broadcast; their rows never shuffle.
4. The other digests are shuffled in the ordinary way: their groups are aggregated, which
   also combines map-side, and joined back to the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.shared import cut, known_rows, table, text_hash, text_or_empty, without_rows

#: Deleted before texts are compared: U+0020 and U+0009 to U+000D.
WHITE = " \t\n\x0b\x0c\r"
#: Counters of a task's sketch, and how many candidates are taken from the combined one.
TRACKED, HEAVY = 4096, 1000
#: Into how many groups the tasks' sketches are combined first.
FAN_IN = 64


def normalised(text: Column) -> Column:
    return F.translate(text, WHITE, "")


def heavy_hashes(hashes: DataFrame, column: str, tracked: int = TRACKED, heavy: int = HEAVY) -> DataFrame:
    """The (at most ``heavy``) most frequent values of a bigint column, as a column ``item``."""
    by_task = hashes.groupBy(F.spark_partition_id().alias("task")).agg(F.expr(f"approx_top_k_accumulate({column}, {tracked})").alias("sketch"))
    some = by_task.groupBy((F.col("task") % FAN_IN).alias("some")).agg(F.expr(f"approx_top_k_combine(sketch, {tracked})").alias("sketch"))
    # grouped, as tasks without rows would else hand on sketches without a type
    whole = some.groupBy((F.col("some") >= 0).alias("all")).agg(F.expr(f"approx_top_k_combine(sketch, {tracked})").alias("sketch"))
    return whole.selectExpr(f"inline(approx_top_k_estimate(sketch, {min(heavy, tracked)}))").select("item")


def digests_of(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_sha256, n, h) a row, written once: the digest of the normalised text, length and hash of the original one."""
    own = text_or_empty(text)
    return cut(df.select(F.col(doc_id).alias("doc_id"), F.sha2(normalised(own), 256).alias("text_sha256"), F.length(own).alias("n"), text_hash(text).alias("h")))


def winners_of(digests: DataFrame, tracked: int = TRACKED, heavy: int = HEAVY) -> DataFrame:
    """``digests`` with the winner of each row's group: keep_id, keep_h, group_size."""
    # the most code points, then the smallest id, ids before none; of rows that share an id and a length the one with the least hash
    order = F.struct(F.col("n"), F.col("doc_id").isNotNull().alias("known"), F.bitwise_not("doc_id").alias("small"), F.bitwise_not("h").alias("least"))
    found = (F.max_by(F.struct(F.col("doc_id").alias("keep_id"), F.col("h").alias("keep_h")), order).alias("keep"), F.count("*").alias("group_size"))
    hashed = digests.withColumn("digest", F.xxhash64("text_sha256"))
    heavy_ones = F.broadcast(heavy_hashes(hashed, "digest", tracked, heavy))
    verified = hashed.join(heavy_ones, F.col("digest") == F.col("item"), "left_semi").groupBy("text_sha256").agg(*found)
    winners = F.broadcast(cut(verified))
    hot = digests.join(winners, "text_sha256")
    rest = digests.join(winners, "text_sha256", "left_anti")
    cold = rest.join(rest.groupBy("text_sha256").agg(*found), "text_sha256")
    return hot.unionByName(cold).select("doc_id", "text_sha256", "n", "h", "keep.keep_id", "keep.keep_h", "group_size")


def exact_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", tracked: int = TRACKED, heavy: int = HEAVY) -> DataFrame:
    """One row per row of ``df``: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty, so they equal every text of white space only.
    Longest text (code points) stays, then the smallest doc_id; null ids come
    after all others. Rows that repeat an id are the same document: each is
    returned, and ``kept`` if the id is the one that stays. An empty table gives
    an empty result; other columns, whatever their names, are not read.
    """
    rows = winners_of(digests_of(df, doc_id, text), tracked, heavy)
    return rows.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_copies(df: DataFrame) -> DataFrame:
    """Of each group of equal texts one row of ``df``, with its own columns.

    Rows are told apart by id and text, so a row that repeats the id of a copy but not its text stays, rows without an id
    are copies like any, and of repeated rows one stays, the least in its other columns (which have to be comparable).
    Null texts count as empty. Which row stays: see ``exact_groups``. An empty table gives an empty result.
    """
    rows = cut(winners_of(digests_of(df)).select("doc_id", "h", "keep_id", "keep_h", "group_size"))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("h") == F.col("keep_h"))
    repeated = rows.where(stays & (F.col("group_size") > 1)).groupBy("doc_id", "h").agg(F.count("*").alias("m")).where("m > 1")
    return without_rows(df, known_rows(rows.where(~stays)), cut(repeated.select("doc_id", "h")))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP6_SQL = r"""
with d as (
  select doc_id, sha256(translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) as text_sha256,
         length(coalesce(text, '')) as n
  from documents),
g as (select *, first_value(doc_id) over (partition by text_sha256 order by n desc, doc_id) as keep_id, count(*) over (partition by text_sha256) as group_size from d)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from g
"""
