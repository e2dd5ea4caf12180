"""Words to lines: grouping rules, line metrics, reading order.

Frames hold words ``(doc_id, page, [column_id,] text, x0, top, x1, bottom, ...)``;
``keys`` are the columns within which lines are formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("doc_id", "page")


def text_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, line_no from 0, text) of plain texts."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line_no", "text"))


def interval_lines(words: DataFrame, tolerance: float = 0.5, keys=KEYS) -> DataFrame:
    """Adds line_no: a line ends where a word's top lies below all bottoms so far by more than the tolerance."""
    order = Window.partitionBy(*keys).orderBy("top", "x0", "x1", "text")
    lowest = F.max("bottom").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(lowest.isNull() | (F.col("top") > lowest + tolerance), 1).otherwise(0)
    return words.withColumn("__new", new).withColumn("line_no", (F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int")).drop("__new")


def chain_groups(df: DataFrame, keys, value: str, gap: Column | float, order=()) -> DataFrame:
    """Adds group_no: a group ends where the value is more than ``gap`` above the one before it."""
    w = Window.partitionBy(*keys).orderBy(value, *order)
    gap = F.lit(gap) if isinstance(gap, (int, float)) else gap
    new = F.when(F.col(value) - F.lag(value).over(w) > gap, 1).otherwise(0)
    return df.withColumn("__new", new).withColumn("group_no", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__new")


def anchor_numbers(values: Column, tolerance: float) -> Column:
    """For a sorted array: the group of each, a group being all within the tolerance of its *first* value."""
    start = F.struct(F.lit(-1).alias("n"), F.lit(None).cast("double").alias("anchor"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, v: Column) -> Column:
        same = F.coalesce(F.abs(v - acc["anchor"]) <= tolerance, F.lit(False))
        n = F.when(same, acc["n"]).otherwise(acc["n"] + 1)
        return F.struct(n.alias("n"), F.when(same, acc["anchor"]).otherwise(v).alias("anchor"), F.array_append(acc["out"], n).alias("out"))

    return F.aggregate(F.transform(values, lambda v: v.cast("double")), start, step, lambda acc: acc["out"])


def anchor_lines(words: DataFrame, tolerance: float = 5.0, keys=KEYS) -> DataFrame:
    """Adds line_no by anchors: words within the tolerance of the line's first top. A page's words are folded as one array."""
    others = [c for c in words.columns if c not in keys]
    row = F.struct(F.col("top").alias("__t"), F.col("x0").alias("__x"), *[F.col(c).alias(c) for c in others])
    pages = words.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("ws"))
    numbered = pages.withColumn("ns", anchor_numbers(F.transform("ws", lambda w: w["__t"]), tolerance))
    flat = numbered.select(*keys, F.explode(F.arrays_zip("ws", "ns")).alias("z"))
    return flat.select(*keys, *[F.col("z.ws")[c].alias(c) for c in others], F.col("z.ns").alias("line_no"))


def first_fit_lines(words: DataFrame, tolerance: float = 1.5, keys=KEYS) -> DataFrame:
    """Adds line_no: a word joins the first line that its vertical extent overlaps (with the tolerance), lines growing as words join.

    The rule depends on all lines so far, so each page is folded in Python.
    """
    import pandas as pd

    def fold(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values(["top", "x0", "text"], kind="stable")
        spans: list[list[float]] = []
        numbers = []
        for top, bottom in zip(page["top"], page["bottom"]):
            hit = next((i for i, s in enumerate(spans) if bottom >= s[0] - tolerance and top <= s[1] + tolerance), None)
            if hit is None:
                spans.append([top, bottom])
                hit = len(spans) - 1
            else:
                spans[hit] = [min(spans[hit][0], top), max(spans[hit][1], bottom)]
            numbers.append(hit)
        return page.assign(line_no=pd.array(numbers, dtype="int32"))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema)
    return words.groupBy(*keys).applyInPandas(fold, fields + ", line_no int")


def chained_merge(fragments: DataFrame, y: float = 2.0, gap: float = 5.0, keys=KEYS) -> DataFrame:
    """Fragments (text, x0, y0, x1) in order become lines: one whose y0 is within ``y`` of its line's first joins it, after a space if the gap is wide."""
    start = F.array().cast("array<struct<y0:double,x0:double,x1:double,text:string>>")

    def step(acc: Column, w: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        same = F.coalesce(F.abs(w["y0"] - last["y0"]) < y, F.lit(False))
        glued = F.struct(last["y0"].alias("y0"), last["x0"].alias("x0"), F.greatest(last["x1"], w["x1"]).alias("x1"),
                         F.concat(last["text"], F.when(w["x0"] - last["x1"] > gap, " ").otherwise(""), w["text"]).alias("text"))
        kept = F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(start)
        return F.when(same, F.array_append(kept, glued)).otherwise(F.array_append(acc, w))

    pages = fragments.select(*keys, F.struct(F.col("y0").cast("double").alias("y0"), F.col("x0").cast("double").alias("x0"), F.col("x1").cast("double").alias("x1"), "text").alias("w"))
    merged = pages.groupBy(*keys).agg(F.aggregate(F.array_sort(F.collect_list("w")), start, step).alias("ls"))
    return merged.select(*keys, F.posexplode("ls").alias("line_no", "l")).select(*keys, "line_no", "l.*")


def lines_of_words(words: DataFrame, keys=KEYS) -> DataFrame:
    """One row a line: text in order of x0, its box, counts, and metrics of the words (those that the frame has)."""
    by = [*keys, "line_no"]
    ordered = F.array_sort(F.collect_list(F.struct("x0", "text")))
    text = F.concat_ws(" ", F.transform(ordered, lambda w: w["text"]))
    has = set(words.columns)
    extra = []
    if "font_size" in has:
        extra.append(F.avg("font_size").alias("avg_font_size"))
    if "is_bold" in has:
        extra.append(F.avg(F.col("is_bold").cast("double")).alias("bold_ratio"))
    for c in ("font", "font_color"):
        if c in has:  # the most frequent, of equals the smallest
            extra.append(F.mode(c, deterministic=True).alias(f"dominant_{c}"))
    return words.groupBy(*by).agg(
        text.alias("text"), F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"),
        F.avg(F.col("bottom") - F.col("top")).alias("height"), F.count("*").alias("word_count"), F.length(text).alias("char_count"), *extra,
    )


def line_spacing(lines: DataFrame, keys=KEYS, order: str = "line_no") -> DataFrame:
    """Adds space_above and space_below (0 at the ends)."""
    w = Window.partitionBy(*keys).orderBy(order)
    return lines.withColumns({
        "space_above": F.greatest(F.coalesce(F.col("top") - F.lag("bottom").over(w), F.lit(0.0)), F.lit(0.0)),
        "space_below": F.greatest(F.coalesce(F.lead("top").over(w) - F.col("bottom"), F.lit(0.0)), F.lit(0.0)),
    })


def bbox(df: DataFrame) -> DataFrame:
    """Adds width, height and centres of (x0, top, x1, bottom)."""
    return df.withColumns({
        "width": F.col("x1") - F.col("x0"), "height": F.col("bottom") - F.col("top"),
        "x_center": (F.col("x0") + F.col("x1")) / 2, "y_center": (F.col("top") + F.col("bottom")) / 2,
    })


def reading_order(df: DataFrame) -> DataFrame:
    """A position within each document by page, column and top."""
    return df.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "x_start", "top")) - 1)


def split_detections(words: DataFrame) -> DataFrame:
    """A recognised stretch of several words becomes words of equal width."""
    parts = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    wide = words.withColumn("__n", F.size(parts)).select(*[c for c in words.columns if c not in ("text", "x0", "x1")], "x0", "x1", "__n", F.posexplode(parts).alias("__i", "text"))
    step = (F.col("x1") - F.col("x0")) / F.col("__n")
    return wide.select(*[c for c in words.columns if c not in ("x0", "x1")], (F.col("x0") + F.col("__i") * step).alias("x0"), (F.col("x0") + (F.col("__i") + 1) * step).alias("x1"))


def confident(words: DataFrame, least: float = 0.2) -> DataFrame:
    return words.where(F.col("confidence") >= least)
