"""Layout features and rules: page vectors, routing, strategies, thresholds from the data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ("doc_id", "page")


def scanned(chars_per_page: Column, images: Column, chars: Column) -> Column:
    """Few characters a page, or many images and little text."""
    return (chars_per_page < 100) | ((images > 3) & (chars < 500))


def scanned_strict(chars: Column, images: Column, drawings: Column) -> Column:
    return (chars < 50) | ((images > 0) & (chars < 200)) | ((drawings > 50) & (chars < 500))


def scanned_first_page(text: Column) -> Column:
    """Under 50 characters on the first page."""
    return F.length(F.coalesce(text, F.lit(""))) < 50


def scanned_docx(images: Column, paragraphs: Column) -> Column:
    return (images > 3) & (paragraphs < 10)


def route(chars: Column, text_ratio: Column, images: Column) -> Column:
    """native, or ocr for few characters or little text on the page."""
    return F.when((chars <= 100) | (text_ratio < 10) | ((text_ratio < 5) & (images > 0)), "ocr").otherwise("native")


def strategy(file_type: Column, is_scanned: Column, columns: Column) -> Column:
    return (
        F.when(file_type == "docx", "docx").when(file_type == "image", "ocr").when(is_scanned, "ocr").when((file_type == "pdf") & (columns > 1), "pdf_columns").when(file_type == "pdf", "pdf_simple")
    )


def file_type(path: Column) -> Column:
    """By extension; old .doc files can't be read and are unknown."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext == "pdf", "pdf").when(ext == "docx", "docx").when(ext.isin("png", "jpg", "jpeg", "tif", "tiff", "bmp"), "image").when(ext == "txt", "text").otherwise("unknown")


def half_columns(words: DataFrame, share: float = 0.3, keys=KEYS) -> DataFrame:
    """Two columns where both halves of the page hold at least ``share`` of the words."""
    left = F.count_if((F.col("x0") + F.col("x1")) / 2 < F.col("page_width") / 2)
    n = F.count("*")
    return words.groupBy(*keys).agg(n.alias("n"), left.alias("n_left")).withColumn("n_columns", F.when((F.col("n_left") / F.col("n") > share) & (1 - F.col("n_left") / F.col("n") > share), 2).otherwise(1))


def layout_type(columns: Column) -> Column:
    """struct(type, confidence): 1, 2 or 3 and more columns."""
    return F.struct(F.when(columns <= 1, 1).when(columns == 2, 2).otherwise(3).alias("type"), F.when(columns <= 1, 0.9).when(columns == 2, 0.85).otherwise(0.7).alias("confidence"))


def layout_class(columns: Column, gutter: Column, header: Column, full_lines: Column, valley: Column, overlap: Column) -> Column:
    """struct(type, confidence): 1 for one column, 2 for several, 3 for several with full-width lines or a header.

    With a gutter through .7 of the page, at least three full-width lines or a header of over .05 make 3. Else .4 valley (to .3), .35 overlap (to .2) and .25 for
    full-width lines make a score, over .35 for 3.
    """
    wide, clear = full_lines >= 3, gutter >= 0.7
    score = 0.4 * F.least(valley / 0.3, F.lit(1.0)) + 0.35 * F.least(overlap * 5, F.lit(1.0)) + F.when(wide, 0.25).otherwise(0.0)
    kind = F.when(columns == 1, 1).when(clear, F.when(wide | (header > 0.05), 3).otherwise(2)).when(score > 0.35, 3).otherwise(2)
    sure = F.when(columns == 1, 0.9).when(clear, 0.92).otherwise(0.7 + F.least(F.abs(score - 0.5) * 0.4, F.lit(0.25)))
    return F.struct(kind.alias("type"), sure.alias("confidence"))


def side_lines(lines: DataFrame, keys=KEYS) -> DataFrame:
    """Two columns where at least three lines lie left and three right of the middle; counts of left, right and full-width lines."""
    mid = F.col("page_width") / 2
    full = (F.col("x1") - F.col("x0")) >= 0.75 * F.col("page_width")
    left = ~full & (F.col("x0") < 0.6 * mid)
    right = ~full & ~left & (F.col("x0") > 0.4 * mid)
    out = lines.groupBy(*keys).agg(F.count_if(left).alias("n_left"), F.count_if(right).alias("n_right"), F.count_if(full).alias("n_full"))
    return out.withColumn("n_columns", F.when((F.col("n_left") >= 3) & (F.col("n_right") >= 3), 2).otherwise(1))


def band_density(words: DataFrame, bands: int = 60, keys=KEYS) -> DataFrame:
    """(keys, band, n): how many words overlap each of the page's horizontal bands."""
    size = F.col("page_height") / bands
    lo, hi = F.greatest(F.floor(F.col("top") / size), F.lit(0)), F.least(F.floor(F.col("bottom") / size), F.lit(bands - 1))
    return words.where(lo <= hi).select(*keys, F.explode(F.sequence(lo.cast("int"), hi.cast("int"))).alias("band")).groupBy(*keys, "band").agg(F.count("*").alias("n"))


def gutter(words: DataFrame, bins: int = 400, bands: int = 60, zero: float = 0.05, keys=KEYS) -> DataFrame:
    """(keys, coverage, header_fraction, gutter_x): where a vertical gutter stands in the middle of the page and through how many horizontal bands.

    Centres of words are counted in ``bins`` over the width, each bin as the mean of the seven around it. The gutter is
    the first of the emptiest bins in the middle quarter. A band is open where the least density within ten bins of the
    gutter, against the band's greatest (at least 1), is at most ``zero``; bands without words aren't open. The header
    ends at the first max(4, bands // 12) open bands in a row (0 where there are none). Counts are spread to
    neighbouring bins before the aggregation, so nothing is dense but what words touch. Words outside the page's height are in no band.
    """
    half, height = 3, F.col("page_height") / bands
    at = F.least(F.greatest(((F.col("x0") + F.col("x1")) * 0.5 * bins / F.col("page_width")).cast("int"), F.lit(0)), F.lit(bins - 1))
    near = F.sequence(F.greatest(F.col("at") - half, F.lit(0)), F.least(F.col("at") + half, F.lit(bins - 1)))
    placed = words.select(*keys, "top", "bottom", "page_width", height.alias("height"), at.alias("at"))
    middle = [bins // 2 - bins // 8, bins // 2 + bins // 8 - 1]

    pages = placed.groupBy(*keys, "at").agg(F.count("*").alias("n"), F.max("page_width").alias("width")).withColumn("bin", F.explode(near))
    pages = pages.groupBy(*keys, "bin").agg(F.sum("n").alias("n"), F.max("width").alias("width"))
    inside = F.when(F.col("bin").between(*middle), F.struct("bin", "n"))
    pages = pages.groupBy(*keys).agg(F.max("width").alias("width"), F.map_from_entries(F.collect_list(inside)).alias("held"))
    emptiest = F.array_min(F.transform(F.sequence(F.lit(middle[0]), F.lit(middle[1])), lambda b: F.struct(F.coalesce(F.try_element_at("held", b), F.lit(0)).alias("n"), b.alias("bin"))))
    pages = pages.select(*keys, "width", emptiest["bin"].alias("gutter"))

    spread = placed.withColumn("band", F.explode(F.filter(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: (F.col("bottom") > b * F.col("height")) & (F.col("top") < (b + 1) * F.col("height")))))
    spread = spread.groupBy(*keys, "band", "at").agg(F.count("*").alias("n")).withColumn("bin", F.explode(near)).groupBy(*keys, "band", "bin").agg(F.sum("n").alias("n"))
    met = F.col("bin").between(F.col("gutter") - 10, F.col("gutter") + 10)
    least = F.when(F.count_if(met) == 21, F.min(F.when(met, F.col("n")))).otherwise(0) / 7
    open_ = spread.join(pages, list(keys)).groupBy(*keys, "band").agg((least / F.greatest(F.lit(1.0), F.max("n") / 7)).alias("v")).where(F.col("v") <= zero)
    run = max(4, bands // 12)
    rows = open_.groupBy(*keys).agg(F.array_sort(F.collect_list("band")).alias("open"))
    first = F.array_min(F.filter("open", lambda b, i: F.try_element_at("open", i + run) == b + run - 1))
    share = lambda c: F.coalesce(c, F.lit(0)) / bands
    return pages.join(rows, list(keys), "left").select(*keys, share(F.size("open")).alias("coverage"), share(first).alias("header_fraction"), (F.col("gutter") * F.col("width") / bins).alias("gutter_x"))


def mean_overlap(words: DataFrame, size: float = 20.0, keys=KEYS) -> DataFrame:
    """(keys, n_pairs, mean_overlap): vertical overlap to the smaller height over all pairs of a page's words; 0 without pairs.

    Words of no height are in no pair. Equal spans are counted once with their number, and different ones meet only
    in the band of ``size`` points where their overlap begins, so pairs that add nothing are never made.
    """
    spans = words.where("bottom > top").groupBy(*keys, "top", "bottom").agg(F.count("*").alias("n"))
    band = lambda y: F.floor(y / size)
    met = spans.withColumn("band", F.explode(F.sequence(band(F.col("top")), band(F.col("bottom")))))
    other = met.select(*keys, "band", F.col("top").alias("top2"), F.col("bottom").alias("bottom2"), F.col("n").alias("n2"))
    later = (F.col("top2") > F.col("top")) | ((F.col("top2") == F.col("top")) & (F.col("bottom2") > F.col("bottom")))
    pairs = met.join(other, [*keys, "band"]).where(later & (F.col("band") == band(F.col("top2"))) & (F.col("top2") < F.col("bottom")))
    overlap = (F.least("bottom", "bottom2") - F.col("top2")) / F.least(F.col("bottom") - F.col("top"), F.col("bottom2") - F.col("top2"))
    between = pairs.groupBy(*keys).agg(F.sum(overlap * F.col("n") * F.col("n2")).alias("o"))
    within = spans.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("w"))
    n_pairs = (F.coalesce("n", F.lit(0)) * (F.coalesce("n", F.lit(0)) - 1) / 2).cast("bigint")
    total = F.coalesce("w", F.lit(0.0)) + F.coalesce("o", F.lit(0.0))
    pages = words.select(*keys).distinct().join(within, list(keys), "left").join(between, list(keys), "left").withColumn("n_pairs", F.greatest(n_pairs, F.lit(0)))
    return pages.select(*keys, "n_pairs", F.when(F.col("n_pairs") > 0, total / F.col("n_pairs")).otherwise(0.0).alias("mean_overlap"))


def balanced_halves(words: DataFrame, keys=KEYS) -> DataFrame:
    """Two columns where more than ten words begin in each half and the smaller number is over .3 of the larger; pages of up to 20 words have one."""
    right = F.count_if(F.col("x0") >= F.col("page_width") / 2)
    out = words.groupBy(*keys).agg(F.count("*").alias("n"), right.alias("n_right")).withColumn("n_left", F.col("n") - F.col("n_right"))
    two = (F.least("n_left", "n_right") > 10) & (F.least("n_left", "n_right") / F.greatest("n_left", "n_right") > 0.3) & (F.col("n") > 20)
    return out.select(*keys, "n_left", "n_right", F.when(two, 2).otherwise(1).alias("n_columns"))


def pairwise_overlap(lines: DataFrame, reach: int = 19, keys=KEYS, order: str = "line_no") -> DataFrame:
    """(keys, n_pairs, mean_overlap): vertical overlap to the smaller height, of each line and the ``reach`` after it; ``mean_overlap`` takes all pairs.

    Neighbours come by ``lead`` in one ordered window, so the work is in proportion to the lines.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(order)
    box = F.struct("top", "bottom")
    ahead = lines.withColumn("__o", F.array_compact(F.array(*[F.lead(box, k).over(w) for k in range(1, reach + 1)])))
    pairs = ahead.select(*keys, "top", "bottom", F.explode("__o").alias("o"))
    overlap = F.greatest(F.least("bottom", "o.bottom") - F.greatest("top", "o.top"), F.lit(0.0)) / F.greatest(F.least(F.col("bottom") - F.col("top"), F.col("o.bottom") - F.col("o.top")), F.lit(1e-9))
    return pairs.groupBy(*keys).agg(F.count("*").alias("n_pairs"), F.avg(overlap).alias("mean_overlap"))


def bimodality(words: DataFrame, keys=KEYS) -> DataFrame:
    """How far the means of the left and right half's centres lie apart, against their spread; 0 where a half is empty."""
    c, mid = (F.col("x0") + F.col("x1")) / 2, F.col("page_width") / 2
    l, r = F.when(c < mid, c), F.when(c >= mid, c)
    s = words.groupBy(*keys).agg(F.avg(l).alias("ml"), F.avg(r).alias("mr"), F.stddev_pop(l).alias("sl"), F.stddev_pop(r).alias("sr"), F.max("page_width").alias("w"))
    apart = F.abs(F.col("mr") - F.col("ml")) / F.col("w") / F.greatest((F.col("sl") + F.col("sr")) / F.col("w"), F.lit(0.01))
    return s.select(*keys, F.coalesce(apart, F.lit(0.0)).alias("bimodality"))


def page_features(words: DataFrame, keys=KEYS) -> DataFrame:
    """A vector of plain features for each page in one aggregation."""
    w, h = F.col("x1") - F.col("x0"), F.col("bottom") - F.col("top")
    return words.groupBy(*keys).agg(
        F.count("*").alias("n_words"), F.bround(F.avg(w / F.col("page_width")), 4).alias("avg_word_width_ratio"), F.bround(F.avg(h), 4).alias("avg_height"),
        F.bround(F.stddev_pop(h), 4).alias("height_std"), F.bround(F.avg((F.col("top") < 0.15 * F.col("page_height")).cast("double")), 4).alias("share_at_top"),
        F.bround(F.var_pop(F.col("top") / F.col("page_height")), 4).alias("top_variance"),
    )


# Bounds of a measure from the highest down, each with the threshold above it; the last threshold is that below all bounds.
LADDERS = {
    "heading_score": [(0.5, 0.25), (0.3, 0.3), (None, 0.35)],
    "font_ratio": [(1.5, 1.1), (1.2, 1.15), (None, 1.05)],
    "space_ratio": [(2.0, 1.3), (1.5, 1.5), (None, 1.8)],
    "block_area": [(50, 50), (30, 100), (None, 150)],
}
#: Tolerances of columns and bands by the commonest layout of a document's pages, and of all others.
TOLERANCES = {"horizontal": (0.03, 0.03), "vertical": (0.08, 0.015), "hybrid": (0.05, 0.02), None: (0.05, 0.02)}


def rung(name: str, measure: Column) -> Column:
    """The threshold of a ladder for a measure; null for null."""
    steps = LADDERS[name]
    out = F.lit(steps[-1][1])
    for bound, value in reversed(steps[:-1]):
        out = F.when(measure > bound, value).otherwise(out)
    return F.when(measure.isNotNull(), out)


def adaptive_thresholds(lines: DataFrame, pages: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """(key, heading_score, font_ratio, space_ratio, column_tolerance, band_tolerance, block_area): a document's thresholds from its own lines.

    ``lines``: (key, page, height, space_above). Scores go by the spread of heights to their mean, font ratios by the third quartile of heights to their median, space
    ratios likewise by spaces, block areas by lines a page; divisors are at least 1. ``pages``: (key, page, kind) of layouts (``blocks.block_layout``), of which
    the commonest, of equals the one on the earliest page, sets the tolerances.
    """
    ratio = lambda a, b: a / F.greatest(F.lit(1.0), b)
    at = lambda c, q: F.expr(f"percentile({c}, {q})")
    s = lines.groupBy(key).agg(
        ratio(F.stddev_pop("height"), F.avg("height")).alias("spread"), ratio(at("height", 0.75), at("height", 0.5)).alias("font"), ratio(at("space_above", 0.75), at("space_above", 0.5)).alias("space"),
        (F.count("*") / F.countDistinct("page")).alias("dense"),
    )
    if pages is None:
        s = s.withColumn("kind", F.lit(None).cast("string"))
    else:
        counts = pages.groupBy(key, "kind").agg(F.count("*").alias("n"), F.min("page").alias("first"))
        s = s.join(counts.groupBy(key).agg(F.max_by("kind", F.struct("n", -F.col("first"))).alias("kind")), key, "left")
    side = lambda i: reduce(lambda out, k: F.when(F.col("kind") == k, TOLERANCES[k][i]).otherwise(out), [k for k in TOLERANCES if k], F.lit(TOLERANCES[None][i]))
    return s.select(
        key, rung("heading_score", F.col("spread")).alias("heading_score"), rung("font_ratio", F.col("font")).alias("font_ratio"), rung("space_ratio", F.col("space")).alias("space_ratio"),
        side(0).alias("column_tolerance"), side(1).alias("band_tolerance"), rung("block_area", F.col("dense")).alias("block_area"),
    )
