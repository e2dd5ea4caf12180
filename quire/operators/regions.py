"""Valleys of a page's coverage, and horizontal regions of pages by their column structure.

Coverage smoothed over a window is a line between the places where a word's ends enter or leave the window, so it is held as these places only: four rows a word,
whatever the page's width. All sums are of whole numbers, so flat stretches are flat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("doc_id", "page")
#: Smoothing window and least width of valleys within regions; how far a valley must lie below the highest coverage.
WINDOW, VALLEY, DEPTH = 7, 15, 0.3
#: Valleys that part columns at most, the deepest; the least width and words of a column; the least words of a region whose columns are looked at.
CUTS, COLUMN, COLUMN_WORDS, REGION_WORDS = 3, 80, 15, 10
#: White space between regions, separators so near are averaged, the least height of a region, confidence from which regions are joined, and regions kept, the fullest.
SPACE, SAME, HEIGHT, SURE, MOST = 30.0, 10.0, 50.0, 0.7, 5


def smooth_coverage(words: DataFrame, window: int = WINDOW, keys=KEYS) -> DataFrame:
    """(keys, bins, x, x_next, s, d): on x to x_next - 1 the coverage summed over ``window`` pixels is s, s + d, s + 2 d, ...

    A word covers whole pixels from x0 up to before x1, within the page's pixels 0 to bins - 1. Stretches cover the page; ``window`` is odd.
    """
    half = window // 2
    bins = F.floor("page_width").cast("int")
    inside = lambda c: F.greatest(F.lit(0), F.least(F.col(c).cast("int"), bins - 1))
    step = lambda x, d: F.struct(x.alias("x"), F.lit(d).alias("d"))
    a, b = inside("x0"), inside("x1")
    # the sum's slope grows where a word's end enters the window and falls again where it leaves; slopes from before the page count from its first pixel
    ends = F.array(step(a - half, 1), step(a + half + 1, -1), step(b - half, -1), step(b + half + 1, 1), step(F.lit(0), 0))
    steps = words.select(*keys, bins.alias("bins"), F.explode(ends).alias("e")).groupBy(*keys, "bins", F.col("e.x").alias("x")).agg(F.sum("e.d").alias("d"))
    o = Window.partitionBy(*keys).orderBy("x")
    whole = o.rowsBetween(Window.unboundedPreceding, 0)
    sloped = steps.withColumn("slope", F.sum("d").over(whole)).withColumn("x_next", F.coalesce(F.lead("x").over(o), F.col("bins")))
    # s at a stretch's first pixel: all slopes before, each over its length, and the first step of this one
    risen = sloped.withColumn("s", F.sum(F.col("slope") * (F.col("x_next") - F.col("x"))).over(whole) - F.col("slope") * (F.col("x_next") - F.col("x")) + F.col("slope"))
    return risen.where("x >= 0 and x < bins").select(*keys, "bins", "x", F.least("x_next", "bins").alias("x_next"), "s", F.col("slope").alias("d"))


def _last_above(r: Column, limit: Column, before: Column) -> Column:
    """The last pixel of a stretch left of ``before`` where twice the sum is over ``limit``; null where none."""
    end = F.least(r["x_next"], before) - 1
    at_end = r["s"] + r["d"] * (end - r["x"])
    fallen = r["x"] + F.ceil((2 * r["s"] - limit) / (-2 * r["d"])) - 1
    return F.when(end < r["x"], None).when(2 * at_end > limit, end).when((r["d"] < 0) & (2 * r["s"] > limit), fallen.cast("int"))


def _first_above(r: Column, limit: Column, after: Column) -> Column:
    start = F.greatest(r["x"], after + 1)
    at_start = r["s"] + r["d"] * (start - r["x"])
    risen = start + F.floor((limit - 2 * at_start) / (2 * r["d"])) + 1
    return F.when(start >= r["x_next"], None).when(2 * at_start > limit, start).when((r["d"] > 0) & (risen < r["x_next"]), risen.cast("int"))


def coverage_valleys(words: DataFrame, least: int = VALLEY, window: int = WINDOW, keys=KEYS) -> DataFrame:
    """(keys, valleys): structs of start, stop and depth of a page's valleys from left to right; an empty array for pages without any.

    A valley is a lowest stretch between higher ones (its middle pixel, the left of two; the page's edges are none). Of two nearer than ``least`` the lower goes on, of equals the right one. It reaches to the next pixels on both sides whose coverage is over 1.5
    times its own, or the page's edges, and counts if that is at least ``least`` wide and it lies over ``DEPTH`` below the highest coverage.
    """
    o = Window.partitionBy(*keys).orderBy("x")
    stretches = smooth_coverage(words, window, keys)
    # flat stretches take the direction before them; a valley begins with the last falling pixel
    before = F.last(F.when(F.col("d") != 0, F.col("d")), ignorenulls=True).over(o.rowsBetween(Window.unboundedPreceding, -1))
    falls_to = F.last(F.when(F.col("d") != 0, F.struct(F.col("x_next").alias("x"), (F.col("s") + F.col("d") * (F.col("x_next") - F.col("x") - 1)).alias("s"))), ignorenulls=True).over(o.rowsBetween(Window.unboundedPreceding, -1))
    marked = stretches.withColumns({"before": before, "low": falls_to})
    # between pixel low.x - 1, the last one that fell, and pixel x - 1, before the first that rises
    found = (F.col("d") > 0) & (F.col("before") < 0) & (F.col("low.x") >= 2)
    middle = F.floor((F.col("low.x") - 1 + F.col("x") - 1) / 2).cast("int")
    top = F.greatest(F.max(F.greatest("s", F.col("s") + F.col("d") * (F.col("x_next") - F.col("x") - 1))), F.lit(0))
    pages = marked.groupBy(*keys).agg(F.max("bins").alias("bins"), top.alias("top"), F.array_sort(F.collect_list(F.struct("x", "x_next", "s", "d"))).alias("rows"), F.array_sort(F.collect_list(F.when(found, F.struct(F.col("low.s").alias("s"), (-middle).alias("x"))))).alias("minima"))
    apart = F.aggregate("minima", F.array().cast("array<struct<s:bigint,x:int>>"), lambda acc, m: F.when(F.exists(acc, lambda k: F.abs(k["x"] - m["x"]) < least), acc).otherwise(F.array_append(acc, m)))

    def reach(m):
        limit, at = 3 * m["s"], -m["x"]
        left = F.array_max(F.transform("rows", lambda r: _last_above(r, limit, at)))
        right = F.array_min(F.filter(F.transform("rows", lambda r: _first_above(r, limit, at)), lambda x: x.isNotNull()))
        return F.struct(F.coalesce(left, F.lit(0)).alias("start"), F.coalesce(right, F.col("bins") - 1).alias("stop"), (1 - m["s"] / F.col("top")).alias("depth"), at.alias("at"))

    reached = pages.withColumn("apart", apart).withColumn("all", F.when(F.col("top") > 0, F.transform("apart", reach)).otherwise(F.array().cast("array<struct<start:int,stop:int,depth:double,at:int>>")))
    kept = F.filter("all", lambda v: (v["stop"] - v["start"] >= least) & (v["depth"] > DEPTH))
    ordered = F.transform(F.array_sort(F.transform(kept, lambda v: F.struct(v["at"].alias("at"), v["start"].alias("start"), v["stop"].alias("stop"), v["depth"].alias("depth")))), lambda v: F.struct(v["start"].alias("start"), v["stop"].alias("stop"), v["depth"].alias("depth")))
    return reached.select(*keys, "bins", ordered.alias("valleys"))


def valley_columns(valleys: DataFrame, most: int = CUTS, keys=KEYS) -> DataFrame:
    """``valleys`` with columns: structs of x_start and x_end between the middles of the ``most`` deepest valleys, of equals the left ones."""
    deepest = F.slice(F.array_sort(F.transform("valleys", lambda v, i: F.struct((-v["depth"]).alias("d"), i.alias("i"), F.floor((v["start"] + v["stop"]) / 2).cast("double").alias("x")))), 1, most)
    edges = F.array_sort(F.concat(F.array(F.lit(0.0)), F.transform(deepest, lambda v: v["x"]), F.array(F.col("bins").cast("double"))))
    return valleys.withColumn("__e", edges).withColumn("columns", F.transform(F.slice("__e", 1, F.size("__e") - 1), lambda x, i: F.struct(x.alias("x_start"), F.get("__e", i + 1).alias("x_end")))).drop("__e")


def averaged(positions: Column, near: float = SAME) -> Column:
    """Sorted positions, each nearer than ``near`` to the last one averaged into it."""

    def step(acc: Column, x: Column) -> Column:
        met = F.coalesce(x - acc["last"] < near, F.lit(False))
        return F.struct(F.when(met | acc["last"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], acc["last"])).alias("out"), F.when(met, (acc["last"] + x) / 2).otherwise(x).alias("last"))

    start = F.struct(F.array().cast("array<double>").alias("out"), F.lit(None).cast("double").alias("last"))
    return F.aggregate(positions, start, step, lambda acc: F.when(acc["last"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], acc["last"])))


def separators(words: DataFrame, rules: DataFrame | None = None, space: float = SPACE, keys=KEYS) -> DataFrame:
    """(keys, page_width, page_height, separators): where regions of a page part: white space of at least ``space`` between a word and the next by top, and drawn lines.

    ``rules``: (keys, x0, x1, y0, y1) of drawn lines; those over 100 wide and under 5 high count.
    """
    o = Window.partitionBy(*keys).orderBy("top", "bottom")
    spaced = words.select(*keys, "page_width", "page_height", "bottom", F.lead("top").over(o).alias("next"))
    gap = F.when(F.col("next") - F.col("bottom") >= space, (F.col("next") + F.col("bottom")) / 2)
    pages = spaced.groupBy(*keys).agg(F.max("page_width").alias("page_width"), F.max("page_height").alias("page_height"), F.collect_list(gap).alias("ys"))
    if rules is not None:
        flat = rules.where((F.abs(F.col("x1") - F.col("x0")) > 100) & (F.abs(F.col("y1") - F.col("y0")) < 5)).groupBy(*keys).agg(F.collect_set((F.col("y0") + F.col("y1")) / 2).alias("drawn"))
        pages = pages.join(flat, list(keys), "left").withColumn("ys", F.concat("ys", F.coalesce("drawn", F.array().cast("array<double>"))))
    return pages.select(*keys, "page_width", "page_height", averaged(F.array_sort("ys")).alias("separators"))


def page_regions(words: DataFrame, rules: DataFrame | None = None, keys=KEYS, most: int = MOST) -> DataFrame:
    """(keys, region_no, y_start, y_end, n_words, n_columns, columns, confidence): regions of a page between its separators, neighbours of like columns joined, the fullest ``most``.

    A word is in each region that holds its top or bottom. Regions under ``HEIGHT`` high go. Those of fewer than ``REGION_WORDS`` words are one column, with confidence .5; others have the columns
    between their valleys that are at least ``COLUMN`` wide with ``COLUMN_WORDS`` words, or one. One column is sure to .9 without valleys and .6 with; more as far as the deepest valley, .95 at most.
    Neighbours with as many columns, both over ``SURE``, are joined: the first one's columns, confidences averaged one after the other, words added up. Pages without words are not in ``words`` and have no row.
    """
    dealt = words.repartition(*keys)
    pages = separators(dealt, rules, keys=keys)
    edges = F.concat(F.array(F.lit(0.0)), "separators", F.array("page_height"))
    spans = F.transform(F.slice("edges", 1, F.size("edges") - 1), lambda y, i: F.struct(i.alias("no"), y.alias("y_start"), F.get("edges", i + 1).alias("y_end")))
    pages = pages.withColumn("edges", edges).withColumn("spans", F.filter(spans, lambda s: s["y_end"] - s["y_start"] >= HEIGHT))
    inside = lambda s, c: F.col(c).between(s["y_start"], s["y_end"])
    own = dealt.join(pages.select(*keys, "spans"), list(keys)).withColumn("span", F.explode(F.filter("spans", lambda s: inside(s, "top") | inside(s, "bottom"))))
    region = [*keys, "no"]
    held = own.select(*keys, F.col("span.no").alias("no"), "x0", "x1", "page_width")
    counted = held.groupBy(*region).agg(F.count("*").alias("n_words"), F.collect_list((F.col("x0") + F.col("x1")) / 2).alias("centres"))
    found = valley_columns(coverage_valleys(held, keys=region), keys=region)
    every = pages.select(*keys, "page_width", F.explode("spans").alias("s")).select(*keys, "page_width", "s.*").join(counted, region, "left").join(found, region, "left")
    wide = F.filter("columns", lambda c: (c["x_end"] - c["x_start"] >= COLUMN) & (F.size(F.filter("centres", lambda x: (x >= c["x_start"]) & (x < c["x_end"]))) >= COLUMN_WORDS))
    one = F.array(F.struct(F.lit(0.0).alias("x_start"), F.col("page_width").cast("double").alias("x_end")))
    few = F.coalesce("n_words", F.lit(0)) < REGION_WORDS
    looked = every.withColumn("wide", F.when(~few, wide)).withColumn("columns", F.when(few | (F.size("wide") == 0), one).otherwise(F.col("wide")))
    deepest = F.array_max(F.transform("valleys", lambda v: v["depth"]))
    sure = F.when(few, 0.5).when((F.size("columns") == 1) & deepest.isNull(), 0.9).when(F.size("columns") == 1, 0.6).otherwise(F.coalesce(F.least(F.lit(0.95), deepest), F.lit(0.5)))
    rated = looked.select(*region, "y_start", "y_end", F.coalesce("n_words", F.lit(0)).alias("n_words"), F.size("columns").alias("n_columns"), "columns", sure.alias("confidence"))

    o = Window.partitionBy(*keys).orderBy("no")
    same = (F.lag("n_columns").over(o) == F.col("n_columns")) & (F.lag("confidence").over(o) > SURE) & (F.col("confidence") > SURE)
    islands = rated.withColumn("__new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("island", F.sum("__new").over(o.rowsBetween(Window.unboundedPreceding, 0)))
    row = F.array_sort(F.collect_list(F.struct("no", "confidence")))
    mean = F.aggregate(F.slice("cs", 2, F.size("cs")), F.col("cs")[0]["confidence"], lambda acc, c: (acc + c["confidence"]) / 2)
    joined = islands.groupBy(*keys, "island").agg(F.min("y_start").alias("y_start"), F.max("y_end").alias("y_end"), F.sum("n_words").alias("n_words"), F.max("n_columns").alias("n_columns"), F.min_by("columns", "no").alias("columns"), row.alias("cs")).withColumn("confidence", mean)
    fullest = Window.partitionBy(*keys).orderBy(F.desc("n_words"), "y_start")
    kept = joined.withColumn("__r", F.row_number().over(fullest)).where(F.col("__r") <= most)
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("y_start")) - 1
    return kept.select(*keys, number.alias("region_no"), "y_start", "y_end", "n_words", "n_columns", "columns", "confidence")
