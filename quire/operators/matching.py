"""Headings matched exactly, then by likeness of vectors through an index that gives the same answers as comparing all.

Unit vectors lie in cells around centres taken from the vocabulary. With angles as distances, a variant in a cell of radius r around c is at least angle(q, c) - r
from a query q, so after the nearest cells are searched only cells that could still hold something better are.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.headings import header_like
from quire.operators.learning import cosine
from quire.session import cut

#: Gives a column ``vector`` (array of numbers) for a table's column ``text``; null where there is none.
Encoder = Callable[[DataFrame], DataFrame]

#: Cells of an index at most, cells searched first, variants in one row of a cell, and what angles may be off by.
CELLS, PROBES, BLOCK, SLACK = 256, 2, 1024, 1e-6


def letter_counts(df: DataFrame) -> DataFrame:
    """The simplest encoder: how often each of a to z stands in the text, once lower-cased; null for texts without. Others (language models) are given as functions."""
    names = df.columns

    def work(batches):
        for batch in batches:
            found = [np.bincount(np.frombuffer(x.encode(), np.uint8), minlength=256)[97:123].astype(float) if x else None for x in batch["__low"].to_pylist()]
            vectors = pa.array([None if v is None or not v.any() else v for v in found], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.select(names).columns, vectors], names=[*names, "vector"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.withColumn("__low", F.lower("text")).mapInArrow(work, f"{fields}, vector array<double>")


def _units(column: pa.Array) -> np.ndarray:
    """Rows of unit length."""
    rows = np.array(column.to_pylist(), np.float64)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


class CellIndex:
    """Variants (canon, vector) in cells; ``centres`` (at most ``cells`` vectors) lie on the driver and in every task, the variants in blocks in a table."""

    def __init__(self, variants: DataFrame, cells: int = CELLS):
        self.variants = variants.where("vector is not null").select("canon", "vector").distinct()
        n = self.variants.count()
        wanted = min(cells, int(np.ceil(np.sqrt(n))))
        # the centres: variants spread by a hash of their vectors, so the same ones each time
        found = self.variants.select("vector", "canon", F.xxhash64("vector").alias("h")).orderBy("h", "canon").limit(wanted).select("vector").distinct().toArrow()
        self.size = n
        if not n:
            return
        self.centres = _units(found["vector"])
        placed = cut(self._placed(self.variants))
        radii = {r["cell"]: float(np.arccos(np.clip(r["nearest"], -1, 1))) for r in placed.groupBy("cell").agg(F.min("near").alias("nearest")).collect()}
        self.radius = np.array([radii.get(i, -np.inf) for i in range(len(self.centres))])
        block = F.floor((F.row_number().over(Window.partitionBy("cell").orderBy("canon", "vector")) - 1) / BLOCK).cast("int")
        self.blocks = placed.withColumn("block", block).groupBy("cell", "block").agg(F.collect_list(F.struct("canon", "vector")).alias("held"))

    def _placed(self, vectors: DataFrame) -> DataFrame:
        """Adds cell and near (the cosine to its centre)."""
        centres = self.centres

        def work(batches):
            for batch in batches:
                if batch.num_rows:
                    near = _units(batch["vector"]) @ centres.T
                    at = near.argmax(1)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32()), pa.array(near[np.arange(len(at)), at])], names=[*batch.schema.names, "cell", "near"])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)
        return vectors.mapInArrow(work, f"{fields}, cell int, near double")

    def _cells(self, queries: DataFrame, first: bool, probes: int) -> DataFrame:
        """(vector, cell): the nearest ``probes`` cells of each query, or all others whose bound reaches what it has found (column ``similarity``)."""
        centres, radius = self.centres, self.radius

        def work(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                near = _units(batch["vector"]) @ centres.T
                near[:, np.isinf(radius)] = -2  # cells without variants
                order = np.argsort(-near, axis=1, kind="stable")[:, :probes]
                mark = np.zeros(near.shape, bool)
                np.put_along_axis(mark, order, True, 1)
                if not first:
                    # the least angle that a member can have; 0 within the cell's radius
                    least = np.maximum(np.arccos(np.clip(near, -1, 1)) - np.where(np.isinf(radius), 0, radius), 0)
                    mark = ~mark & (np.cos(least) + SLACK >= np.array(batch["similarity"].to_pylist(), np.float64)[:, None])
                mark &= near > -2
                rows, cells = np.nonzero(mark)
                yield pa.RecordBatch.from_arrays([batch["vector"].take(pa.array(rows)), pa.array(cells, pa.int32())], names=["vector", "cell"])

        kind = queries.schema["vector"].dataType.simpleString()
        return queries.mapInArrow(work, f"vector {kind}, cell int")

    def _scored(self, asked: DataFrame) -> DataFrame:
        """The best of the cells asked: (vector, b) with b a struct of the negative similarity and the canon."""
        score = F.transform("held", lambda x: F.struct((-F.bround(cosine(F.col("vector"), x["vector"]), 9)).alias("d"), x["canon"].alias("canon")))
        return asked.join(self.blocks, "cell").select("vector", F.array_min(score).alias("b")).groupBy("vector").agg(F.min("b").alias("b"))

    def best(self, queries: DataFrame, probes: int = PROBES, exact: bool = True) -> DataFrame:
        """(vector, canon, similarity) for the distinct vectors of ``queries``: the most alike variant, of equals the first name.

        Without ``exact`` only the nearest cells are searched, which may miss the best.
        """
        asked = queries.where("vector is not null").select("vector").distinct()
        if not self.size:
            return asked.select("vector", F.lit(None).cast("string").alias("canon"), F.lit(None).cast("double").alias("similarity")).where(F.lit(False))
        found = self._scored(self._cells(asked, True, probes))
        if exact:
            found = cut(found)
            rest = self._cells(found.select("vector", (-F.col("b.d")).alias("similarity")), False, probes)
            found = found.unionAll(self._scored(rest)).groupBy("vector").agg(F.min("b").alias("b"))
        return found.select("vector", F.col("b.canon").alias("canon"), (-F.col("b.d")).alias("similarity"))


def match_sections(headings: DataFrame, vocab: DataFrame, encode: Encoder = letter_counts, least: float = 0.75, cells: int = CELLS, once: bool = False) -> DataFrame:
    """``headings`` (with column heading) with canon, confidence and match: 'exact' (1.0) by a variant's name, else 'similar' by its vector from ``least`` on.

    Case and surrounding space don't count. Below ``least`` canon and match are null and confidence is the best likeness all the same (0 without a vector). Only distinct headings
    that no name matches are encoded and looked up; give very frequent ones once, with their counts, and say so by ``once``: then rows are encoded where they stand and never shuffled by their text. Of a variant with several canonical names, and of equally alike ones, the first name is taken.
    """
    key = F.lower(F.trim("heading"))
    names = vocab.select(F.lower(F.trim("variant")).alias("__v"), F.col("canon").alias("__e")).groupBy("__v").agg(F.min("__e").alias("__e"))
    exact = headings.withColumn("__k", key).join(names, F.col("__k") == F.col("__v"), "left").drop("__v")
    variants = encode(vocab.select("canon", F.lower("variant").alias("text"))).select("canon", "vector")
    if once:
        placed = cut(encode(exact.withColumn("text", F.when(F.col("__e").isNull(), F.col("__k")))))
        found = CellIndex(variants, cells).best(placed).select(F.col("vector").alias("__w"), F.col("canon").alias("__a"), "similarity")
        return _said(placed.join(found, F.col("vector") == F.col("__w"), "left"), headings.columns, least)
    open_ = encode(exact.where("__e is null and __k is not null").select(F.col("__k").alias("text")).distinct()).select(F.col("text").alias("__t"), "vector")
    open_ = cut(open_)
    found = CellIndex(variants, cells).best(open_)
    alike = open_.join(found.withColumnRenamed("vector", "__w"), F.col("vector") == F.col("__w")).select("__t", F.col("canon").alias("__a"), "similarity")
    return _said(exact.join(alike, F.col("__k") == F.col("__t"), "left"), headings.columns, least)


def _said(joined: DataFrame, names: list[str], least: float) -> DataFrame:
    sure = F.coalesce("similarity", F.lit(0.0))
    return joined.select(
        *[F.col(f"`{c}`") for c in names], F.coalesce("__e", F.when(sure >= least, F.col("__a"))).alias("canon"), F.when(F.col("__e").isNotNull(), 1.0).otherwise(sure).alias("confidence"),
        F.when(F.col("__e").isNotNull(), "exact").when(sure >= least, "similar").alias("match"), F.col("__a").alias("nearest"),
    )


def new_sections(stats: DataFrame, vocab: DataFrame, encode: Encoder = letter_counts, least: float = 0.9, similar: float = 0.6) -> DataFrame:
    """Proposals (``learning.proposals``: heading, freq, ...) with verdict and similar_to: 'covered' where a known section is alike to ``least``, else 'new'.

    similar_to names the nearest section over ``similar``, for review.
    """
    found = match_sections(stats, vocab, encode, least)
    return found.select(*[F.col(f"`{c}`") for c in stats.columns], F.when(F.col("match").isNotNull(), "covered").otherwise("new").alias("verdict"), F.when(F.col("confidence") > similar, F.coalesce("canon", "nearest")).alias("similar_to"))


def lessons(lines: DataFrame, vocab: DataFrame, encode: Encoder = letter_counts) -> DataFrame:
    """(canon, variant): what results teach. ``lines``: (section, text) where section is 'Unknown Sections' and text one of its lines, or section a heading as found (text is not read).

    An unknown line that looks like a header and is alike to a section from .65 to under .85 becomes its variant; a section's own heading does from .85 on. Variants that are held already, case aside, teach nothing; each comes once.
    """
    unknown = F.col("section") == "Unknown Sections"
    headings = lines.select(F.when(unknown, F.col("text")).otherwise(F.col("section")).alias("heading"), unknown.alias("unknown")).where(F.trim("heading") != "").where(~F.col("unknown") | header_like("heading")).distinct()
    found = match_sections(headings, vocab, encode, 0.65).where("match = 'similar'")
    taught = found.where(F.when(F.col("unknown"), F.col("confidence") < 0.85).otherwise(F.col("confidence") >= 0.85))
    return taught.select("canon", F.lower(F.trim("heading")).alias("variant")).distinct()
