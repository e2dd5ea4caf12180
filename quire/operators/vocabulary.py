"""Vocabularies as small tables: (variant, nosep, canon, prio).

The built-in one holds the names of the sections alone; the headings of a
language or trade are given as rows (``section_rows``), or read from JSON
(``sources.read_vocabulary``). Where two canonical names
share a variant the later one wins, at the variant's first place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.text import despaced

#: The names that sections have.
SECTIONS = [
    "Contact Information", "Summary", "Skills", "Experience", "Projects", "Education", "Certifications", "Achievements",
    "Publications", "Research", "Languages", "Volunteer", "Hobbies", "Additional Information", "References", "Declarations",
]


def section_rows(variants: dict[str, list[str]] | None = None) -> list[tuple[str, str, int]]:
    """(variant, canon, prio) in order, repeated variants included; without variants each section's own name."""
    held = {name: [name] for name in SECTIONS} if variants is None else variants
    found = [(v.lower(), canon) for canon, vs in held.items() for v in vs]
    return [(v, canon, i) for i, (v, canon) in enumerate(found)]


def vocabulary(spark: SparkSession, rows: list[tuple[str, str, int]] | None = None) -> DataFrame:
    """The table of rows (variant, canon, prio), each variant once."""
    raw = spark.createDataFrame(section_rows() if rows is None else rows, "variant string, canon string, prio int")
    return unique_variants(raw)


def unique_variants(raw: DataFrame) -> DataFrame:
    """The last canonical name of each variant at its first priority, with the variant's despaced form."""
    own = raw.withColumn("variant", F.lower(F.trim("variant")))
    kept = own.groupBy("variant").agg(F.max_by("canon", "prio").alias("canon"), F.min("prio").alias("prio"))
    return kept.select("variant", despaced("variant").alias("nosep"), "canon", "prio")


def extend(base: DataFrame, learned: DataFrame, fallback: str = "Additional Information") -> DataFrame:
    """Base and learned rows (variant, canon); a canonical name that the base lacks becomes ``fallback``."""
    known = base.select("canon").distinct().withColumn("__k", F.lit(True))
    start = F.lit(1 << 20)
    more = learned.join(known, "canon", "left").select("variant", F.when(F.col("__k"), F.col("canon")).otherwise(fallback).alias("canon"), start.cast("int").alias("prio"))
    return unique_variants(base.select("variant", "canon", "prio").unionByName(more))


def new_variants(learned: DataFrame, existing: DataFrame) -> DataFrame:
    """Learned (canon, variant) rows not held yet, letter case aside, each once: what is to be appended."""
    key = [F.lower("variant").alias("__v"), F.col("canon").alias("__c")]
    first = Window.partitionBy(F.lower("variant"), "canon").orderBy("variant")
    once = learned.withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r")
    return once.join(existing.select(*key).distinct(), (F.lower("variant") == F.col("__v")) & (F.col("canon") == F.col("__c")), "left_anti")
