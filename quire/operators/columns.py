"""Columns and layout of a page: histograms, gaps, peaks, valleys, assignment of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("doc_id", "page")


def center_histogram(words: DataFrame, width: int = 5, keys=KEYS) -> DataFrame:
    """(keys, bin, n): words by the bin of their centre."""
    return words.groupBy(*keys, F.floor((F.col("x0") + F.col("x1")) / 2 / width).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def equal_width_histogram(df: DataFrame, value: str, high: Column, bins: int, keys=KEYS) -> DataFrame:
    """Bins of equal width from 0 to ``high``, the last closed; values outside go."""
    v = F.col(value)
    at = F.least(F.floor(v / (high / bins)).cast("int"), F.lit(bins - 1))
    return df.where((v >= 0) & (v <= high)).groupBy(*keys, at.alias("bin")).agg(F.count("*").alias("n"))


def coverage_histogram(words: DataFrame, closed: bool = True, keys=KEYS) -> DataFrame:
    """(keys, x, n): how many words cover each pixel from x0 to x1, from where coverage changes to where it next changes.

    +1 and -1 at the ends and a running sum: two rows a word, not one a pixel.
    """
    begin, end = F.floor("x0").cast("int"), F.floor("x1").cast("int") + (1 if closed else 0)
    ends = words.select(*keys, F.explode(F.array(F.struct(begin.alias("x"), F.lit(1).alias("d")), F.struct(end.alias("x"), F.lit(-1).alias("d")))).alias("e"))
    steps = ends.groupBy(*keys, F.col("e.x").alias("x")).agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy(*keys).orderBy("x")
    return steps.select(*keys, "x", F.lead("x").over(w).alias("x_next"), F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("n"))


def dense_bins(histogram: DataFrame, keys=KEYS) -> DataFrame:
    """All bins from the first to the last, those without rows as 0."""
    spans = histogram.groupBy(*keys).agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"))
    grid = spans.select(*keys, F.explode(F.sequence("lo", "hi")).alias("bin"))
    return grid.join(histogram, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("n", F.lit(0)).alias("n"))


def moving_average(bins: DataFrame, before: int, after: int, keys=KEYS) -> DataFrame:
    """Adds smooth: the mean over a frame of ``before`` rows up to ``after``, as if zeros stood beyond the ends."""
    w = Window.partitionBy(*keys).orderBy("bin").rowsBetween(-before, after)
    return bins.withColumn("smooth", F.sum("n").over(w) / (before + after + 1))


def gaussian_smooth(bins: DataFrame, sigma: float = 3.0, reach: int | None = None, keys=KEYS) -> DataFrame:
    """Adds smooth: a sum weighted by a normal curve, zeros beyond the ends."""
    import math

    reach = int(4 * sigma + 0.5) if reach is None else reach
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    total = sum(weights)
    w = Window.partitionBy(*keys).orderBy("bin")
    parts = [F.coalesce(F.lag("n", -k).over(w) if k < 0 else F.lead("n", k).over(w) if k else F.col("n"), F.lit(0)) * (weights[k + reach] / total) for k in range(-reach, reach + 1)]
    return bins.withColumn("smooth", sum(parts[1:], parts[0]))


def peaks(bins: DataFrame, value: str = "smooth", factor: float = 0.5, keys=KEYS) -> DataFrame:
    """Bins above both neighbours and above ``factor`` times the mean."""
    w = Window.partitionBy(*keys)
    o = w.orderBy("bin")
    marked = bins.withColumns({"__b": F.lag(value).over(o), "__a": F.lead(value).over(o), "__m": F.avg(value).over(w)})
    return marked.where((F.col("__b") < F.col(value)) & (F.col("__a") < F.col(value)) & (F.col(value) > factor * F.col("__m"))).drop("__a", "__b", "__m")


def spaced_peaks(found: DataFrame, distance: int, keys=KEYS) -> DataFrame:
    """Peaks at least ``distance`` from the peak kept before, from left to right."""
    kept = F.aggregate(
        F.array_sort(F.collect_list("bin")), F.array().cast("array<int>"),
        lambda acc, b: F.when(F.coalesce(b - F.try_element_at(acc, F.lit(-1)) >= distance, F.lit(True)), F.array_append(acc, b)).otherwise(acc),
    )
    return found.groupBy(*keys).agg(kept.alias("bins")).select(*keys, F.explode("bins").alias("bin"))


def valleys(bins: DataFrame, found: DataFrame, value: str = "smooth", keys=KEYS) -> DataFrame:
    """(keys, left, right, bin, depth_ratio): the lowest bin between each two peaks, and by how much it lies below the lower peak."""
    w = Window.partitionBy(*keys).orderBy("bin")
    pairs = found.select(*keys, F.col("bin").alias("left"), F.lead("bin").over(w).alias("right"), F.col(value).alias("__l"), F.lead(value).over(w).alias("__r")).where("right is not null")
    inside = bins.join(pairs, list(keys)).where((F.col("bin") > F.col("left")) & (F.col("bin") < F.col("right")))
    lowest = inside.groupBy(*keys, "left", "right").agg(F.min(F.struct(F.col(value).alias("v"), "bin")).alias("m"), F.first("__l").alias("l"), F.first("__r").alias("r"))
    low = F.least("l", "r")
    return lowest.select(*keys, "left", "right", F.col("m.bin").alias("bin"), F.when(low > 0, 1 - F.col("m.v") / low).otherwise(0.0).alias("depth_ratio"))


def half_height_widths(bins: DataFrame, found: DataFrame, value: str = "smooth", keys=KEYS) -> DataFrame:
    """(keys, bin, width): how far around a peak the value stays at or above half of it."""
    tops = found.select(*keys, F.col("bin").alias("peak"), F.col(value).alias("top"))
    low = bins.join(tops, list(keys)).where(F.col(value) < F.col("top") / 2)
    ends = low.groupBy(*keys, "peak").agg(F.max(F.when(F.col("bin") < F.col("peak"), F.col("bin"))).alias("a"), F.min(F.when(F.col("bin") > F.col("peak"), F.col("bin"))).alias("b"))
    spans = bins.groupBy(*keys).agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"))
    joined = tops.join(ends, [*keys, "peak"], "left").join(spans, list(keys))
    return joined.select(*keys, F.col("peak").alias("bin"), (F.coalesce("b", F.col("hi") + 1) - F.coalesce("a", F.col("lo") - 1) - 1).alias("width"))


def runs(bins: DataFrame, test: Column, keys=KEYS) -> DataFrame:
    """Run-length encoding: (keys, flag, start, length) of stretches with the same value of ``test``."""
    o = Window.partitionBy(*keys).orderBy("bin")
    f = bins.withColumn("flag", test)
    same = f.withColumn("__g", F.row_number().over(o) - F.row_number().over(Window.partitionBy(*keys, "flag").orderBy("bin")))
    return same.groupBy(*keys, "flag", "__g").agg(F.min("bin").alias("start"), F.count("*").alias("length")).drop("__g")


def gap_columns(bins: DataFrame, page_width: float, share: float = 0.02, keys=KEYS) -> DataFrame:
    """Columns between empty stretches of at least max(3, share of the width), in pixels of the page (margins kept)."""
    gap = max(3, int(share * page_width))
    found = runs(bins, F.col("n") == 0, keys).where(F.col("flag") & (F.col("length") >= gap))
    spans = bins.groupBy(*keys).agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"))
    cuts = spans.join(found.groupBy(*keys).agg(F.collect_list(F.struct("start", "length")).alias("gs")), list(keys), "left")
    starts = F.concat(F.array("lo"), F.transform(F.array_sort(F.coalesce("gs", F.array().cast("array<struct<start:int,length:bigint>>"))), lambda g: (g["start"] + g["length"]).cast("int")))
    ends = F.concat(F.transform(F.array_sort(F.coalesce("gs", F.array().cast("array<struct<start:int,length:bigint>>"))), lambda g: (g["start"] - 1).cast("int")), F.array("hi"))
    return cuts.select(*keys, F.posexplode(F.arrays_zip(starts.alias("x_start"), ends.alias("x_end"))).alias("column_id", "c")).select(*keys, "column_id", F.col("c.x_start"), F.col("c.x_end")).where("x_end >= x_start")


def index_percentile(values: Column, p: float) -> Column:
    """The element at int(n * p) of the sorted values, from 0; differs from percentile_disc where n * p is whole."""
    ordered = F.array_sort(values)
    return F.try_element_at(ordered, (F.least(F.floor(F.size(ordered) * p), F.size(ordered) - 1) + 1).cast("int"))


def merge_close(positions: Column, apart: float, average: bool = False) -> Column:
    """Sorted positions of which one nearer than ``apart`` to the last kept goes, or is averaged into it."""
    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        far = F.coalesce(x - last >= apart, F.lit(True))
        rest = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(far, F.array_append(acc, x)).otherwise(F.array_append(rest, (last + x) / 2) if average else acc)

    return F.aggregate(F.transform(positions, lambda x: x.cast("double")), F.array().cast("array<double>"), step)


def assign_by_center(words: DataFrame, columns: DataFrame, closed: bool = True, keys=KEYS) -> DataFrame:
    """Words with the column that their centre lies in; of several, the first. Columns of a page are few, so Spark may broadcast them."""
    c = (F.col("x0") + F.col("x1")) / 2
    cols = columns.select(*keys, "column_id", "x_start", "x_end").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("column_id", "x_start", "x_end"))).alias("__cs"))
    inside = F.filter("__cs", lambda k: (c >= k["x_start"]) & ((c <= k["x_end"]) if closed else (c < k["x_end"])))
    return words.join(cols, list(keys), "left").withColumn("column_id", F.try_element_at(inside, F.lit(1))["column_id"]).drop("__cs")


def assign_by_overlap(words: DataFrame, columns: DataFrame, share: float = 0.5, keys=KEYS) -> DataFrame:
    """Words with the first column that holds ``share`` of their width, else the one with the nearest centre, of equals the first."""
    cols = columns.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("column_id", "x_start", "x_end"))).alias("__cs"))
    x0, x1 = F.col("x0"), F.col("x1")
    ratio = lambda k: F.greatest(F.least(x1, k["x_end"]) - F.greatest(x0, k["x_start"]), F.lit(0.0)) / F.greatest(x1 - x0, F.lit(1e-9))
    first = F.try_element_at(F.filter("__cs", lambda k: ratio(k) >= share), F.lit(1))["column_id"]
    nearest = F.array_min(F.transform("__cs", lambda k: F.struct(F.abs((x0 + x1) / 2 - (k["x_start"] + k["x_end"]) / 2).alias("d"), k["column_id"].alias("column_id"))))["column_id"]
    return words.join(cols, list(keys), "left").withColumn("column_id", F.coalesce(first, nearest)).drop("__cs")


def merge_small_columns(words: DataFrame, least: int = 10, keys=KEYS) -> DataFrame:
    """Words of columns with fewer than ``least`` words go to the nearest larger column by its mean centre."""
    stats = words.groupBy(*keys, "column_id").agg(F.count("*").alias("n"), F.avg((F.col("x0") + F.col("x1")) / 2).alias("c"))
    pages = stats.groupBy(*keys).agg(F.collect_list(F.struct("column_id", "n", "c")).alias("__cs"))
    large = F.filter("__cs", lambda k: k["n"] >= least)
    own = F.try_element_at(F.filter("__cs", lambda k: k["column_id"] == F.col("column_id")), F.lit(1))
    nearest = F.array_min(F.transform(large, lambda k: F.struct(F.abs(k["c"] - own["c"]).alias("d"), k["column_id"].alias("column_id"))))["column_id"]
    return words.join(pages, list(keys)).withColumn("column_id", F.when(own["n"] >= least, F.col("column_id")).otherwise(F.coalesce(nearest, F.col("column_id")))).drop("__cs")


def assign_regions(words: DataFrame, regions: DataFrame, keys=KEYS) -> DataFrame:
    """Words with every region that their top or bottom lies in: one row for each."""
    inside = F.col("top").between(F.col("y_start"), F.col("y_end")) | F.col("bottom").between(F.col("y_start"), F.col("y_end"))
    return words.join(regions, list(keys)).where(inside)


def whitespace_regions(lines: DataFrame, least: float = 30.0, keys=KEYS) -> DataFrame:
    """(keys, region_no, y_start, y_end, n_lines): stretches between vertical gaps of at least ``least``."""
    o = Window.partitionBy(*keys).orderBy("top", "bottom")
    lowest = F.max("bottom").over(o.rowsBetween(Window.unboundedPreceding, -1))
    marked = lines.withColumn("__n", F.when(F.col("top") - lowest >= least, 1).otherwise(0)).withColumn("region_no", F.sum("__n").over(o.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return marked.groupBy(*keys, "region_no").agg(F.min("top").alias("y_start"), F.max("bottom").alias("y_end"), F.count("*").alias("n_lines"))


def largest(df: DataFrame, by: Column, n: int, order: str, keys=KEYS) -> DataFrame:
    """The ``n`` largest rows of each key by a measure, of equals the first by ``order``."""
    w = Window.partitionBy(*keys).orderBy(by.desc(), order)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def best_overlap(words: DataFrame, spans: DataFrame, tolerance: float = 1.5, keys=KEYS) -> DataFrame:
    """Words with the attributes (column ``attributes``) of the span that overlaps them most among those on their height."""
    s = spans.select(*keys, F.col("x0").alias("s0"), F.col("x1").alias("s1"), F.col("top").alias("st"), F.col("bottom").alias("sb"), "attributes")
    by = words.withColumn("__w", F.monotonically_increasing_id())
    overlap = F.least("x1", "s1") - F.greatest("x0", "s0")
    joined = by.join(s, list(keys)).where((F.col("st") <= F.col("top") + tolerance) & (F.col("sb") >= F.col("bottom") - tolerance) & (overlap > 0))
    best = joined.groupBy("__w").agg(F.max_by("attributes", F.struct(overlap, -F.col("s0"), "attributes")).alias("attributes"))
    return by.join(best, "__w", "left").drop("__w")
