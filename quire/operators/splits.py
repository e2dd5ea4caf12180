"""Columns of a page from gaps and headers, and columns of a document over its pages."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.columns import index_percentile

KEYS = ("doc_id", "page")
#: The width of a gap that may part columns, and the least width of a column.
GAP, COLUMN = 20.0, 80.0
#: Fewer words are no part of a split column.
PART = 5
#: Columns of pages whose starts are so near are one column of the document.
NEAR = 10.0


def gap_threshold(gaps: Column, gap: float = GAP) -> Column:
    """From the gaps themselves: lower where one is over three times the median, higher where all are under twice it. Percentiles are elements at int(n p)."""
    at = lambda p: index_percentile(gaps, p)
    widest, median = F.array_max(gaps), at(0.5)
    return F.when(widest > median * 3, F.greatest(F.lit(gap * 0.6), at(0.6))).when(widest < median * 2, F.greatest(F.lit(gap * 1.5), at(0.9))).otherwise(F.greatest(F.lit(gap), at(0.75)))


def gap_columns(words: DataFrame, gap: float = GAP, least: float = COLUMN, keys=KEYS) -> DataFrame:
    """(keys, threshold, loosened, separators, columns): a page's columns between its wide gaps.

    A gap is the space between the right end of a word and the left one of the next by left ends. Pages where no gap reaches the threshold but one is over half of ``gap`` are
    looked over again with max(``gap`` / 2, the 60th percentile) (``loosened``). Separators are middles of gaps, of which one nearer than ``least`` to the last kept goes;
    columns are structs of x_start and x_end, of at least ``least`` but for a page with one column. threshold is null on a page without gaps.
    """
    o = Window.partitionBy(*keys).orderBy("x0", "x1")
    space = F.lead("x0").over(o) - F.col("x1")
    spaced = words.select(*keys, "page_width", F.col("x1").alias("end"), space.alias("gap"))
    row = F.struct((F.col("end") + F.col("gap") / 2).alias("at"), "gap")
    pages = spaced.groupBy(*keys).agg(F.max("page_width").alias("width"), F.array_sort(F.collect_list(F.when(F.col("gap") > 0, row))).alias("gs"))
    pages = pages.withColumn("g", F.transform("gs", lambda x: x["gap"]))
    wide = lambda t: F.transform(F.filter("gs", lambda x: x["gap"] >= t), lambda x: x["at"])
    found = pages.withColumn("threshold", F.when(F.size("g") > 0, gap_threshold(F.col("g"), gap))).withColumn("first", F.coalesce(wide(F.col("threshold")), F.array().cast("array<double>")))
    found = found.withColumn("loosened", (F.size("first") == 0) & F.coalesce(F.array_max("g") > gap * 0.5, F.lit(False)))
    found = found.withColumn("every", F.when(F.col("loosened"), wide(F.greatest(F.lit(gap * 0.5), index_percentile(F.col("g"), 0.6)))).otherwise(F.col("first")))
    kept = F.aggregate("every", F.array().cast("array<double>"), lambda acc, x: F.when(F.coalesce(x - F.try_element_at(acc, F.lit(-1)) >= least, F.lit(True)), F.array_append(acc, x)).otherwise(acc))
    found = found.withColumn("separators", kept)
    # a separator too near the left edge begins no column; the last one doesn't if what it would begin is too narrow
    far = F.filter("separators", lambda s: s >= least)
    starts = F.slice(far, 1, F.size(far) - F.when(F.col("width") - F.try_element_at(far, F.lit(-1)) < least, 1).otherwise(0))
    edges = F.concat(F.array(F.lit(0.0)), starts, F.array("width"))
    columns = F.transform(F.slice(edges, 1, F.size(edges) - 1), lambda x, i: F.struct(x.alias("x_start"), F.get(edges, i + 1).alias("x_end")))
    return found.select(*keys, "threshold", "loosened", "separators", columns.alias("columns"))


def name_place(text: Column, name: Column) -> Column:
    """Where a name stands in a text, from 0, case aside; else where the first of its words of over three letters does; null where none."""
    place = lambda x: F.nullif(F.call_function("instr", F.lower(text), F.lower(x)), F.lit(0))
    long = F.filter(F.split(F.lower(name), r"\s+"), lambda w: F.length(w) > 3)
    first = F.try_element_at(F.filter(F.transform(long, place), lambda p: p.isNotNull()), F.lit(1))
    return F.coalesce(place(name), first) - 1


def header_cuts(headers: DataFrame, keys=KEYS) -> DataFrame:
    """(keys, names, cuts) of headers (keys, text, x0, x1, names) that name several sections: names by their places, cuts midway between neighbouring places.

    A place on the page is the share of the text before the name, over the header's width; equal places keep the order of ``names``. Names not found go; with fewer than two left there is no row. Of several headers
    of a page the one with the most names counts, of equals the topmost by the least text.
    """
    at = lambda n: F.col("x0") + name_place(F.col("text"), n) / F.length("text") * (F.col("x1") - F.col("x0"))
    places = F.array_sort(F.filter(F.transform("names", lambda n, i: F.struct(at(n).alias("x"), i.alias("i"), n.alias("name"))), lambda p: p["x"].isNotNull()))
    found = headers.where(F.length("text") > 0).select(*keys, "text", places.alias("ps")).where(F.size("ps") >= 2)
    best = found.groupBy(*keys).agg(F.min_by("ps", F.struct(-F.size("ps"), "text")).alias("ps"))
    cuts = F.transform(F.slice("ps", 2, F.size("ps")), lambda p, i: (p["x"] + F.get("ps", i)["x"]) / 2)
    return best.select(*keys, F.transform("ps", lambda p: p["name"]).alias("names"), cuts.alias("cuts"))


def split_at_headers(words: DataFrame, headers: DataFrame, part: int = PART, keys=KEYS) -> DataFrame:
    """``words`` with column_id and section_hint: each page's words dealt to the parts between its header's cuts.

    A page has one short sorted list of cuts, joined by its key, so a word finds its part by counting the cuts left of its centre; one exactly on a cut is in both parts. Words outside the page are in
    no part. Parts of fewer than ``part`` words go with their words; those left are numbered from 0. Pages without a header of two names found, or of whose parts none is left, stay one column, 0, with no hint.
    """
    centre = (F.col("x0") + F.col("x1")) / 2
    joined = words.join(header_cuts(headers, keys), list(keys), "left")
    low, high = F.size(F.filter("cuts", lambda c: c < centre)), F.size(F.filter("cuts", lambda c: c <= centre))
    inside = (centre >= 0) & (centre <= F.col("page_width"))
    parts = F.when(F.col("cuts").isNull(), F.array(F.lit(-1))).when(inside, F.sequence(low, high)).otherwise(F.array(F.lit(None).cast("int")))
    dealt = joined.withColumn("__part", F.explode(parts))
    n = F.when(F.col("__part").isNotNull(), F.count("__part").over(Window.partitionBy(*keys, "__part")))
    page = Window.partitionBy(*keys)
    counted = dealt.withColumn("__keep", F.coalesce(n >= part, F.lit(False)) | (F.col("__part") == -1)).withColumn("__any", F.max("__keep").over(page))
    # a page that loses all its parts is one column: its words come once
    once = ~F.col("__any") & (F.coalesce("__part", F.lit(0)) == F.coalesce(F.when(inside, low), F.lit(0)))
    left = counted.where(F.col("__keep") | once).withColumn("__own", F.when(F.col("__any"), F.col("__part")).otherwise(-1))
    number = F.dense_rank().over(page.orderBy("__own")) - 1
    hint = F.when(F.col("__own") >= 0, F.get("names", F.col("__own")))
    return left.withColumns({"column_id": number, "section_hint": hint}).drop("names", "cuts", "__part", "__keep", "__any", "__own")


def document_columns(columns: DataFrame, near: float = NEAR, key: str = "doc_id", order=("page", "x_start", "x_end")) -> DataFrame:
    """(key, column_id, x_start, x_end, n): columns of all pages as columns of the document, by left ends.

    Columns are gone through in the given order. One joins the first cluster, by when it began, whose mean start lies within ``near``, and moves its means; else it begins a cluster. Each depends on all
    before, so a document's columns are streamed in order through a fold that holds the clusters only.
    """
    kind = columns.schema[key].dataType.simpleString()

    def fold(batches):
        own, clusters = None, []

        def close():
            rows = sorted((s / n, e / n, n) for s, e, n in clusters)
            arrays = [pa.array([own] * len(rows), key_type), pa.array(range(len(rows)), pa.int32()), *[pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.float64(), pa.float64(), pa.int64()))]]
            return pa.RecordBatch.from_arrays(arrays, names=[key, "column_id", "x_start", "x_end", "n"])

        for batch in batches:
            key_type = batch.schema.field(key).type
            for now, start, end in zip(*[batch[c].to_pylist() for c in (key, "x_start", "x_end")]):
                if clusters and now != own:
                    yield close()
                    clusters = []
                own = now
                met = next((c for c in clusters if abs(start - c[0] / c[2]) <= near), None)
                if met is None:
                    clusters.append([start, end, 1])
                else:
                    met[0], met[1], met[2] = met[0] + start, met[1] + end, met[2] + 1
        if clusters:
            yield close()

    sides = columns.select(key, *order[:1], F.col("x_start").cast("double").alias("x_start"), F.col("x_end").cast("double").alias("x_end"))
    return sides.repartition(key).sortWithinPartitions(key, *order).mapInArrow(fold, f"{key} {kind}, column_id int, x_start double, x_end double, n bigint")
