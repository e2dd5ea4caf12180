"""Feature vectors of pages, over a single shuffle of the words.

A word's box is packed into one array before the words are dealt by page, so that all parts of a vector ask for the same columns and
Spark reuses one exchange: every aggregation and window is keyed by the page (and more), and the parts meet in joins on the page
whose sides are dealt alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import layout

KEYS = ("doc_id", "page")
#: Fields of a packed box, in order; boxes compare by these, so words go from top to bottom and from left to right.
BOX = ("top", "x0", "x1", "bottom", "page_width", "page_height")
#: Words whose centres are so near in height are on one line.
LINE = 5.0


def by_page(words: DataFrame, keys=KEYS) -> DataFrame:
    """(keys, box), dealt by page."""
    return words.select(*keys, F.array(*[F.col(c).cast("double") for c in BOX]).alias("box")).repartition(*keys)


def unpacked(boxes: DataFrame, keys=KEYS) -> DataFrame:
    return boxes.select(*keys, *[F.col("box")[i].alias(c) for i, c in enumerate(BOX)])


def centre_lines(boxes: DataFrame, tolerance: float = LINE, keys=KEYS) -> DataFrame:
    """(keys, y, n, x0, x1, page_width): lines, each of the words whose centres lie within the tolerance of its first one's, y.

    Only centres where a line begins are kept while a page's distinct centres are gone over in order.
    """
    centre = (F.col("box")[0] + F.col("box")[3]) / 2
    start = F.array().cast("array<double>")
    begin = F.aggregate(F.array_sort(F.collect_set(centre)), start, lambda acc, y: F.when(F.coalesce(y - F.try_element_at(acc, F.lit(-1)) > tolerance, F.lit(True)), F.array_append(acc, y)).otherwise(acc))
    pages = boxes.groupBy(*keys).agg(begin.alias("begin"))
    own = F.array_max(F.filter("begin", lambda y: y <= centre))
    lined = boxes.join(pages, list(keys)).select(*keys, "box", own.alias("y"))
    box = F.col("box")
    return lined.groupBy(*keys, "y").agg(F.count("*").alias("n"), F.min(box[1]).alias("x0"), F.max(box[2]).alias("x1"), F.max(box[4]).alias("page_width"))


def line_features(lines: DataFrame, full: float = 0.75, keys=KEYS) -> DataFrame:
    """Numbers and widths of a page's lines; variances are those of the whole, 0 for one line."""
    width = F.col("x1") - F.col("x0")
    spaced = lines.withColumn("space", F.col("y") - F.lag("y").over(Window.partitionBy(*keys).orderBy("y")))
    wide = F.count_if(width >= F.col("page_width") * full)
    return spaced.groupBy(*keys).agg(
        (wide / F.count("*")).alias("full_width_line_ratio"), wide.alias("horizontal_lines_count"), F.var_pop("n").alias("line_density_variance"), F.coalesce(F.var_pop("space"), F.lit(0.0)).alias("line_spacing_variance"),
        F.max(width / F.col("page_width")).alias("max_line_width_ratio"), F.min(width / F.col("page_width")).alias("min_line_width_ratio"),
    )


def centre_density(boxes: DataFrame, keys=KEYS) -> DataFrame:
    """(keys, bin, bins, c): words by the bin of their centre, summed over the five bins around; max(200, width / 2) bins over the page.

    Rows stand for bins with words within three bins: all others are nought, as are their neighbours. Centres outside the page go.
    """
    box, bins = F.col("box"), F.greatest(F.lit(200), F.floor(F.col("box")[4] / 2)).cast("int")
    centre = (box[1] + box[2]) / 2
    # a filter before the aggregation would be pushed below the exchange, which could then not be shared
    placed = boxes.select(*keys, bins.alias("bins"), F.least(F.floor(centre * bins / box[4]).cast("int"), bins - 1).alias("at"), ((centre >= 0) & (centre <= box[4])).alias("inside"))
    counted = placed.groupBy(*keys, "bins", "at").agg(F.count_if("inside").alias("n")).where("n > 0")
    spread = counted.withColumn("d", F.explode(F.sequence(F.lit(-3), F.lit(3)))).withColumn("bin", F.col("at") + F.col("d")).where("bin >= 0 and bin < bins")
    return spread.groupBy(*keys, "bins", "bin").agg(F.sum(F.when(F.abs("d") <= 2, F.col("n")).otherwise(0)).alias("c"))


def _beyond(rows: Column, test, at: Column, left: bool) -> Column:
    """The nearest bin on one side of ``at`` that passes the test; rows are (bin, c)."""
    side = F.filter(rows, lambda r: ((r["bin"] < at) if left else (r["bin"] > at)) & test(r["c"]))
    return (F.array_max if left else F.array_min)(F.transform(side, lambda r: r["bin"]))


def density_features(density: DataFrame, keys=KEYS) -> DataFrame:
    """Peaks and valleys of a page's density: bins above or below both neighbours, with heights, depths and widths as shares.

    Heights are relative to the highest bin (at least one word a bin). Peaks count over a fifth of it. A peak reaches as far as the density stays above half its
    height, a valley as far as it stays below the middle between its depth and the top. Equal valleys: the leftmost is the lowest.
    """
    w = Window.partitionBy(*keys)
    o = w.orderBy("bin")
    near = lambda f, step: F.when(f("bin").over(o) == F.col("bin") + step, f("c").over(o)).otherwise(0)
    marked = density.withColumns({"before": near(F.lag, -1), "after": near(F.lead, 1), "top": F.greatest(F.max("c").over(w), F.lit(5))})
    inner = F.col("bin").between(1, F.col("bins") - 2)
    highest = inner & (F.col("c") > F.col("before")) & (F.col("c") > F.col("after"))
    peak = highest & (F.col("c") * 5 > F.col("top"))
    valley = inner & (F.col("c") < F.col("before")) & (F.col("c") < F.col("after"))
    row = F.struct("bin", "c")
    sorted_ = lambda test: F.array_sort(F.collect_list(F.when(test, row)))
    pages = marked.groupBy(*keys).agg(F.max("bins").alias("bins"), F.max("top").alias("top"), F.count_if(highest).alias("n_maxima"), F.array_sort(F.collect_list(row)).alias("rows"), sorted_(peak).alias("peaks"), sorted_(valley).alias("valleys"))
    rows, bins, top = F.col("rows"), F.col("bins"), F.col("top")

    def peak_width(p):
        low = lambda c: c * 2 <= p["c"]
        # a bin without a row has no words near: it is low
        left = F.coalesce(F.greatest(_beyond(rows, low, p["bin"], True), _gap(rows, p["bin"], True)), F.lit(0))
        right = F.coalesce(F.least(_beyond(rows, low, p["bin"], False), _gap(rows, p["bin"], False)), bins - 1)
        return (right - left) / bins

    def valley_width(v):
        high = lambda c: c * 2 >= top + v["c"]
        return (F.coalesce(_beyond(rows, high, v["bin"], False), bins - 1) - F.coalesce(_beyond(rows, high, v["bin"], True), F.lit(0))) / bins

    lowest = F.array_min(F.transform("valleys", lambda v: F.struct(v["c"].alias("c"), v["bin"].alias("bin"))))
    share = lambda name: F.transform(name, lambda x: x["c"] / top)
    return pages.select(
        *keys, top.alias("density_top"), "n_maxima", F.size("peaks").alias("peak_count"), F.transform("peaks", peak_width).alias("peak_widths"), share("peaks").alias("peak_heights"),
        F.when(F.size("peaks") >= 2, (F.col("peaks")[1]["bin"] - F.col("peaks")[0]["bin"]) / bins).otherwise(0.0).alias("peak_separation"),
        F.size("valleys").alias("valley_count"), share("valleys").alias("valley_depths"), F.transform("valleys", valley_width).alias("valley_widths"),
        F.coalesce(lowest["bin"] / bins, F.lit(0.5)).alias("valley_position"), F.coalesce(lowest["c"] / top, F.lit(1.0)).alias("valley_depth_ratio"),
    )


def _gap(rows: Column, at: Column, left: bool) -> Column:
    """The end of the stretch of rows around ``at``, as all beyond it is nought; none where it reaches the page's end."""
    # the rows on one side that have no neighbour further out
    ends = F.filter(rows, lambda r, i: ((r["bin"] < at) & (F.coalesce(F.get(rows, i - 1)["bin"], F.lit(-9)) < r["bin"] - 1)) if left else ((r["bin"] > at) & (F.coalesce(F.get(rows, i + 1)["bin"], r["bin"] + 9) > r["bin"] + 1)))
    return (F.array_max if left else F.array_min)(F.transform(ends, lambda r: r["bin"]))


def overlap_features(boxes: DataFrame, reach: int = 19, size: float = 20.0, keys=KEYS) -> DataFrame:
    """Mean vertical overlap, to the smaller height: of all pairs of a page's words, and of each word and the ``reach`` after it.

    Boxes without height are in no pair. Equal spans are taken once with their number; others meet in the band of ``size`` points where
    their overlap begins, within one aggregation a band.
    """
    spans = boxes.groupBy(*keys, F.col("box")[0].alias("top"), F.col("box")[3].alias("bottom")).agg(F.count_if(F.col("box")[3] > F.col("box")[0]).alias("n")).where("n > 0")
    band = lambda y: F.floor(y / size)
    overlap = lambda a, b: (F.least(a["bottom"], b["bottom"]) - b["top"]) / F.least(a["bottom"] - a["top"], b["bottom"] - b["top"])
    bands = spans.withColumn("band", F.explode(F.sequence(band(F.col("top")), band(F.col("bottom"))))).groupBy(*keys, "band").agg(F.array_sort(F.collect_list(F.struct("top", "bottom", "n"))).alias("spans"))
    # b is after a in (top, bottom) and begins within this band and above a's end
    after = lambda a: F.filter("spans", lambda b: (b["top"] < a["bottom"]) & (band(b["top"]) == F.col("band")) & ((b["top"] > a["top"]) | ((b["top"] == a["top"]) & (b["bottom"] > a["bottom"]))))
    each = lambda a: F.aggregate(after(a), F.lit(0.0), lambda acc, b: acc + overlap(a, b) * a["n"] * b["n"])
    between = bands.select(*keys, F.aggregate(F.transform("spans", each), F.lit(0.0), lambda acc, x: acc + x).alias("o")).groupBy(*keys).agg(F.sum("o").alias("o"))
    within = spans.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("w"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    every = within.join(between, list(keys)).select(*keys, F.when(F.col("n") > 1, (F.col("w") + F.col("o")) / pairs).otherwise(0.0).alias("mean_y_overlap"))

    o = Window.partitionBy(*keys).orderBy("box")
    ahead = boxes.withColumn("next", F.array(*[F.lead("box", k).over(o) for k in range(1, reach + 1)]))
    height = lambda b: b[3] - b[0]
    box = F.col("box")
    met = F.filter("next", lambda b: b.isNotNull() & (F.least(height(box), height(b)) > 0))
    shares = F.transform(met, lambda b: F.greatest(F.lit(0.0), F.least(box[3], b[3]) - F.greatest(box[0], b[0])) / F.least(height(box), height(b)))
    near = ahead.select(*keys, F.size(shares).alias("n"), F.aggregate(shares, F.lit(0.0), lambda acc, x: acc + x).alias("o")).groupBy(*keys).agg(F.coalesce(F.try_divide(F.sum("o"), F.sum("n")), F.lit(0.0)).alias("mean_y_overlap_near"))
    return near.join(every, list(keys), "left").withColumn("mean_y_overlap", F.coalesce("mean_y_overlap", F.lit(0.0)))


def word_features(boxes: DataFrame, keys=KEYS) -> DataFrame:
    """Means over a page's words: width, density, and how far apart the centres of both halves stand against their spread (0 where a half is empty)."""
    box = F.col("box")
    centre, width = (box[1] + box[2]) / 2, F.max(box[4])
    left, right = F.when(centre < box[4] / 2, centre), F.when(centre >= box[4] / 2, centre)
    apart = F.abs(F.avg(right) - F.avg(left)) / width / F.greatest((F.stddev_pop(left) + F.stddev_pop(right)) / width, F.lit(0.01))
    return boxes.groupBy(*keys).agg((F.avg(box[2] - box[1]) / width).alias("avg_word_width_ratio"), (F.count("*") / (width * F.max(box[5]))).alias("text_density"), F.coalesce(apart, F.lit(0.0)).alias("width_bimodality"))


NINE = ("num_columns", "mean_y_overlap", "coverage_gutter", "full_width_line_ratio", "valley_depth_ratio", "horizontal_lines_count", "header_fraction", "avg_word_width_ratio", "line_density_variance")
MORE = ("peak_count", "peak_widths", "peak_heights", "peak_separation", "valley_count", "valley_depths", "valley_widths", "valley_position", "line_spacing_variance", "text_density", "max_line_width_ratio", "min_line_width_ratio", "width_bimodality")


def page_vectors(words: DataFrame, keys=KEYS) -> DataFrame:
    """All features of each page with words: the nine of ``NINE``, the thirteen of ``MORE``, mean_y_overlap_near (of each word and
    the 19 after it), and density_top (the most words, times five, around a bin; at least 5), which heights and depths are relative to.

    A page has two columns where its gutter is open through 0.7 of the bands. Pairs are all taken, none sampled. Words go from top to bottom where their order counts.
    """
    boxes = by_page(words, keys)
    parts = [word_features(boxes, keys), line_features(centre_lines(boxes, keys=keys), keys=keys), overlap_features(boxes, keys=keys), layout.gutter(unpacked(boxes, keys), keys=keys)]
    found = parts[0]
    for part in parts[1:]:
        found = found.join(part, list(keys))
    found = found.join(density_features(centre_density(boxes, keys), keys), list(keys), "left")
    empty = F.array().cast("array<double>")
    return found.withColumns(
        {"num_columns": F.when(F.col("coverage") >= 0.7, 2).otherwise(1), "coverage_gutter": F.col("coverage")}
        | {c: F.coalesce(c, F.lit(0)) for c in ("peak_count", "valley_count")} | {c: F.coalesce(c, empty) for c in ("peak_widths", "peak_heights", "valley_depths", "valley_widths")}
        | {c: F.coalesce(c, F.lit(v)) for c, v in (("peak_separation", 0.0), ("valley_position", 0.5), ("valley_depth_ratio", 1.0))}
    ).select(*keys, *NINE, *MORE, "mean_y_overlap_near", F.coalesce("density_top", F.lit(5)).alias("density_top"))


def layout_types(words: DataFrame, margin: float = 10.0, keys=KEYS) -> DataFrame:
    """(keys, layout_type, num_columns, boundary, method, confidence): each page's layout from its own words (``layout.layout_class``).

    A gutter through .7 of the page's bands, whose height is taken to end ``margin`` below the lowest word, parts it in two columns; else at least three lines that begin left of .3 of the
    page's width and three further right, none of them full-width, do, midway between the rightmost end and the leftmost start of these (boundary is null for one column). The
    valley is the lowest one of the density, 1 where it has not two peaks. Pages without words have no row.
    """
    boxes = by_page(words.select(*keys, *BOX), keys)
    lowest = F.max(F.col("box")[3]).over(Window.partitionBy(*keys)) + margin
    boxes = boxes.withColumn("box", F.concat(F.slice("box", 1, 5), F.array(lowest)))
    lines = centre_lines(boxes, keys=keys)
    full = (F.col("x1") - F.col("x0")) >= 0.75 * F.col("page_width")
    left = ~full & (F.col("x0") < 0.3 * F.col("page_width"))
    right = ~full & ~left
    sides = lines.groupBy(*keys).agg(F.count_if(full).alias("n_full"), F.count_if(left).alias("n_left"), F.count_if(right).alias("n_right"), ((F.max(F.when(left, F.col("x1"))) + F.min(F.when(right, F.col("x0")))) / 2).alias("between"))
    gutters = layout.gutter(unpacked(boxes, keys), keys=keys)
    parts = [sides, overlap_features(boxes, keys=keys).select(*keys, "mean_y_overlap")]
    found = gutters
    for part in parts:
        found = found.join(part, list(keys))
    found = found.join(density_features(centre_density(boxes, keys), keys).select(*keys, "n_maxima", "valley_count", "valley_depth_ratio"), list(keys), "left")
    clear, split = F.col("coverage") >= 0.7, (F.col("n_left") >= 3) & (F.col("n_right") >= 3)
    columns = F.when(clear | split, 2).otherwise(1)
    valley = F.when((F.col("n_maxima") >= 2) & (F.col("valley_count") > 0), F.col("valley_depth_ratio")).otherwise(1.0)
    said = layout.layout_class(columns, F.col("coverage"), F.col("header_fraction"), F.col("n_full"), valley, F.col("mean_y_overlap"))
    return found.select(
        *keys, said["type"].alias("layout_type"), columns.alias("num_columns"), F.when(clear, F.col("gutter_x")).when(split, F.col("between")).alias("boundary"),
        F.when(clear, "gutter").when(split, "y_overlap").otherwise("single_column").alias("method"), said["confidence"].alias("confidence"),
    )
