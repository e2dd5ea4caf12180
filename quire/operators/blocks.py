"""Layout of text blocks: columns and bands of a region, its kind, and splitting a page region by region.

All regions of all pages are split at once, level by level: a level is a few windows over (page, region), so a page's
blocks are shuffled once and no page is worked on as a whole outside Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("doc_id", "page")
#: Levels of splitting, and the least side of a region that is split.
DEPTH, LEAST = 3, 50
#: A column goes on while centres differ by less than this share of the region's width, a band while tops do by that of its height.
COLUMN_SHARE, BAND_SHARE = 0.05, 0.02


def layout_kind(columns: Column, bands: Column) -> Column:
    """vertical, horizontal, hybrid or simple."""
    return F.when((columns == 1) & (bands >= 3), "vertical").when((columns >= 2) & (bands <= 2), "horizontal").when((columns >= 2) & (bands >= 3), "hybrid").otherwise("simple")


def chained(df: DataFrame, name: str, region: list[str], order: list[str], value: Column, apart: Column) -> DataFrame:
    """Adds ``name``: numbers from 0 of chains within a region, in an order; a chain ends where a value differs from the one before by ``apart`` or more."""
    o = Window.partitionBy(*region).orderBy(*order)
    new = F.when(F.abs(value - F.lag(value).over(o)) >= apart, 1).otherwise(0)
    return df.withColumn("__new", new).withColumn(name, F.sum("__new").over(o.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__new")


def with_layout(blocks: DataFrame, region: list[str], width: Column, height: Column) -> DataFrame:
    """Adds column_no, band_no, n_columns, n_bands and kind of each block's region of the given size."""
    every = Window.partitionBy(*region)
    centre = (F.col("x0") + F.col("x1")) / 2
    numbered = chained(blocks, "column_no", region, ["x0", "x1", "top", "bottom"], centre, width * COLUMN_SHARE)
    numbered = chained(numbered, "band_no", region, ["top", "bottom", "x0", "x1"], F.col("top"), height * BAND_SHARE)
    counted = numbered.withColumns({"n_columns": F.max("column_no").over(every) + 1, "n_bands": F.max("band_no").over(every) + 1})
    return counted.withColumn("kind", layout_kind(F.col("n_columns"), F.col("n_bands")))


def block_layout(blocks: DataFrame, keys=KEYS) -> DataFrame:
    """(keys, n_blocks, n_columns, n_bands, kind) of whole pages."""
    found = with_layout(blocks, list(keys), F.col("page_width"), F.col("page_height"))
    return found.groupBy(*keys).agg(F.count("*").alias("n_blocks"), F.first("n_columns").alias("n_columns"), F.first("n_bands").alias("n_bands"), F.first("kind").alias("kind"))


def split_regions(blocks: DataFrame, depth: int = DEPTH, keys=KEYS) -> DataFrame:
    """``blocks`` with path and kind: each region with several columns is split into these, up to ``depth`` times.

    ``path`` names the columns taken from the page down (``/0/1``; '' for the page itself). ``kind`` is that of the region where splitting ends, null
    where that is for its size (a side under ``LEAST``) or for the depth. A column's size is that of its blocks together; each block
    goes with its own column, also where columns overlap.
    """
    region, width, height = [*keys, "path"], F.col("__width"), F.col("__height")
    now = blocks.repartition(*keys).withColumns({"path": F.lit(""), "kind": F.lit(None).cast("string"), "__done": F.lit(False), "__width": F.col("page_width").cast("double"), "__height": F.col("page_height").cast("double")})
    own = now.columns
    for _ in range(depth):
        small = F.col("__done") | (width < LEAST) | (height < LEAST)
        found = with_layout(now.withColumnRenamed("kind", "__before"), region, width, height)
        split = ~small & F.col("kind").isin("horizontal", "hybrid")
        each = Window.partitionBy(*region, "column_no")
        size = lambda hi, lo: F.max(hi).over(each) - F.min(lo).over(each)
        now = found.withColumns({
            "__width": F.when(split, size("x1", "x0")).otherwise(width), "__height": F.when(split, size("bottom", "top")).otherwise(height),
            "kind": F.when(F.col("__done"), F.col("__before")).when(split | small, F.lit(None)).otherwise(F.col("kind")),
            "path": F.when(split, F.concat("path", F.lit("/"), F.col("column_no").cast("string"))).otherwise(F.col("path")), "__done": ~split,
        }).select(*own)
    return now.drop("__done", "__width", "__height")


def third_columns(blocks: DataFrame, keys=KEYS) -> DataFrame:
    """(keys, n_blocks, n_columns): as many columns as thirds of the page with the centres of over two blocks, at least one."""
    centre, width = (F.col("x0") + F.col("x1")) / 2, F.col("page_width")
    held = [F.count_if(centre < width / 3), F.count_if((centre >= width / 3) & (centre < 2 * width / 3)), F.count_if(centre >= 2 * width / 3)]
    return blocks.groupBy(*keys).agg(F.count("*").alias("n_blocks"), F.greatest(F.lit(1), sum((h > 2).cast("int") for h in held)).alias("n_columns"))


def complexity(columns: Column, blocks: Column, images: Column) -> Column:
    """simple, moderate or complex, by points: 0, 2, 4 for one, two, more columns; 0, 1, 2 for under 10, under 30, more blocks; 0, 1, 2 for no, one or two, more images."""
    points = F.when(columns == 1, 0).when(columns == 2, 2).otherwise(4) + F.when(blocks < 10, 0).when(blocks < 30, 1).otherwise(2) + F.when(images == 0, 0).when(images < 3, 1).otherwise(2)
    return F.when(points <= 2, "simple").when(points <= 5, "moderate").otherwise("complex")
