"""Lines to sections: forward fill, merges, pivots, checks of unknown sections."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import word_count

#: The name of lines before the first heading, by preset; None drops them.
PRESETS = {"seg": "Contact Information", "grouped": "Contact Information", "splitter": "Unknown", "fallback": "Unsegmented", "scored": None}


def segment(lines: DataFrame, canon: str = "canon", order=("line_no",), key: str = "doc_id", preset: str = "seg") -> DataFrame:
    """Adds section and section_id: the last heading at or above each line. Every line lands in exactly one section."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    filled = lines.withColumn("section", F.last(canon, ignorenulls=True).over(w)).withColumn("section_id", F.count(canon).over(w).cast("int"))
    first = PRESETS[preset]
    return filled.where("section is not null") if first is None else filled.withColumn("section", F.coalesce("section", F.lit(first)))


def section_table(segmented: DataFrame, order: str = "line_no", key: str = "doc_id", canon: str = "canon", keep_empty: bool = False) -> DataFrame:
    """(key, section_id, section, content, n_lines): heading lines are not content; sections without content go unless they are kept."""
    line = F.when(F.col(canon).isNull(), F.struct(F.col(order).alias("o"), F.col("text").alias("text")))
    made = segmented.groupBy(key, "section_id", "section").agg(F.array_sort(F.collect_list(line)).alias("ls"))
    out = made.select(key, "section_id", "section", F.concat_ws("\n", F.transform("ls", lambda x: x["text"])).alias("content"), F.size("ls").alias("n_lines"))
    return out if keep_empty else out.where("n_lines > 0")


def merge_equal(sections: DataFrame, key: str = "doc_id", separator: str = "\n") -> DataFrame:
    """One row for each name, in the order of first appearance."""
    made = sections.groupBy(key, "section").agg(F.min("section_id").alias("section_id"), F.array_sort(F.collect_list(F.struct("section_id", "content"))).alias("cs"), F.sum("n_lines").alias("n_lines"))
    return made.select(key, "section_id", "section", F.concat_ws(separator, F.transform("cs", lambda x: x["content"])).alias("content"), F.col("n_lines").cast("bigint").alias("n_lines"))


def merge_adjacent(segmented: DataFrame, order: str = "line_no", key: str = "doc_id") -> DataFrame:
    """Adds run_id: neighbouring sections of one name count as one; a heading repeated within it is a line of content."""
    w = Window.partitionBy(key).orderBy(order)
    new = F.when(F.lag("section").over(w).eqNullSafe(F.col("section")), 0).otherwise(1)
    return segmented.withColumn("__n", new).withColumn("run_id", F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__n")


def pivot_sections(sections: DataFrame, names: list[str], key: str = "doc_id") -> DataFrame:
    """A column for each name, of several sections the first; names are given, so no pass is needed to find them."""
    return sections.groupBy(key).pivot("section", names).agg(F.min_by("content", "section_id"))


# Names that clear a section, and what dates look like.
COMMON = [
    "experience", "education", "skills", "summary", "work experience", "professional experience", "technical skills", "core competencies",
    "projects", "certifications", "achievements", "employment",
]
DATED = r"\d{4}|\d{1,2}/\d{1,2}|\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"


def unknown_reasons(sections: DataFrame, similarity: str | None = None, n_words: str = "n_words", has_header: str | None = None) -> DataFrame:
    """Adds unknown_reason: why a section's name looks wrong; null if it doesn't.

    A common name that it holds, or that holds it, clears it first. Sections of
    at most two lines count as few only with at most five words in all (column
    ``n_words``) and, where ``has_header`` is given, only with a header line.
    """
    name = F.lower(F.col("section"))
    common = reduce(or_, [F.contains(name, F.lit(x)) | F.contains(F.lit(x), name) for x in COMMON])
    few = (F.col("n_lines") <= 2) & (F.col(n_words) <= 5)
    if has_header:
        few &= F.col(has_header)
    reason = (
        F.when(common, None).when(F.length(name) <= 2, "too_short").when(F.regexp(name, F.lit(DATED)), "date")
        .when(word_count(name) > 8, "too_long").when(few, "few_lines")
    )
    if similarity:
        s = F.col(similarity)
        reason = reason.when((s > 0.6) & (s < 0.8), "ambiguous")
    return sections.withColumn("unknown_reason", reason)


def corrections(flagged: DataFrame) -> DataFrame:
    """Adds suggestion for each reason."""
    r = F.col("unknown_reason")
    return flagged.withColumn("suggestion", F.when(r == "ambiguous", "USE_SIMILAR").when(r.isin("too_short", "few_lines"), "MERGE_WITH_NEXT").when(r.isin("date", "too_long"), "TREAT_AS_CONTENT"))


def reclassify(sections: DataFrame, guesses: DataFrame, least: float = 0.7) -> DataFrame:
    """Unknown sections take the name guessed (doc_id, section_id, canon, confidence) for their first line."""
    g = guesses.where(F.col("confidence") > least).select("doc_id", "section_id", F.col("canon").alias("__c"))
    return sections.join(g, ["doc_id", "section_id"], "left").withColumn("section", F.when(F.lower("section").startswith("unknown"), F.coalesce("__c", "section")).otherwise(F.col("section"))).drop("__c")
