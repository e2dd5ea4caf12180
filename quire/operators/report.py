"""Status, quality, summaries, comparisons, upserts: the reporting side."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import col


def text_status(c, least: int = 50) -> Column:
    """success, or empty for texts of fewer than ``least`` characters once trimmed."""
    return F.when(F.length(F.trim(F.coalesce(col(c), F.lit("")))) >= least, "success").otherwise("empty")


def section_frequency(sections: DataFrame, top: int = 10, key: str = "doc_id") -> DataFrame:
    """The most frequent names with the number of documents that have them; ties by name."""
    return sections.groupBy("section").agg(F.countDistinct(key).alias("n_docs"), F.count("*").alias("n_sections")).orderBy(F.desc("n_docs"), "section").limit(top)


def batch_summary(results: DataFrame, by: list[str] = ()) -> DataFrame:
    """Totals of (status, seconds, error): success, empty, failure, average time; an error is one that is not null."""
    return results.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "success").alias("successful"), F.count_if(F.col("status") == "empty").alias("empty"),
        F.count_if(F.col("error").isNotNull()).alias("failed"), F.avg("seconds").alias("avg_seconds"),
    )


def document_stats(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    return lines.groupBy(key).agg(F.countDistinct("page").alias("n_pages"), F.countDistinct("page", "column_id").alias("n_columns"), F.count("*").alias("n_lines"), F.sum("word_count").alias("n_words"))


#: A line of more characters is a sign of jumbled text.
JUMBLED = 500


def quality_points(sections: Column, lines: Column, has_name: Column, has_email: Column, has_phone: Column, longest: Column) -> Column:
    """0 to 100: sections 40/30/15 from 5/3/1, lines 30/20/10 from 30/15/5, email 7, phone 7, name 6, and 10, or 5 with a line (``longest``) of over ``JUMBLED`` characters."""
    return (
        F.when(sections >= 5, 40).when(sections >= 3, 30).when(sections >= 1, 15).otherwise(0)
        + F.when(lines >= 30, 30).when(lines >= 15, 20).when(lines >= 5, 10).otherwise(0)
        + F.when(has_name, 6).otherwise(0) + F.when(has_email, 7).otherwise(0) + F.when(has_phone, 7).otherwise(0) + F.when(longest > JUMBLED, 5).otherwise(10)
    )


def quality_share(sections: Column, lines: Column, has_contact: Column) -> Column:
    """0 to 1: sections .4/.25/.1 from 5/3/1, lines .4/.25/.1 from 30/15/5, contact .2."""
    return (
        F.when(sections >= 5, 0.4).when(sections >= 3, 0.25).when(sections >= 1, 0.1).otherwise(0.0)
        + F.when(lines >= 30, 0.4).when(lines >= 15, 0.25).when(lines >= 5, 0.1).otherwise(0.0) + F.when(has_contact, 0.2).otherwise(0.0)
    )


def quality_issues(sections: Column, lines: Column, has_contact: Column) -> Column:
    """no_sections for none, few_lines for under five, no_contact."""
    return F.array_compact(F.array(F.when(sections == 0, "no_sections"), F.when(lines < 5, "few_lines"), F.when(~has_contact, "no_contact")))


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new``, and those of ``existing`` whose key it lacks."""
    return existing.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def not_done(all_: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return all_.join(done.select(*keys), keys, "left_anti")


def compare(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Full outer comparison of two results: assessment by which has the key and whether the values agree."""
    a, b = left.select(key, F.col(value).alias("left_value")), right.select(key, F.col(value).alias("right_value"))
    j = a.withColumn("__a", F.lit(True)).join(b.withColumn("__b", F.lit(True)), key, "full_outer")
    said = F.when(F.col("__b").isNull(), "left_only").when(F.col("__a").isNull(), "right_only").when(F.col("left_value").eqNullSafe(F.col("right_value")), "equal").otherwise("different")
    return j.select(key, "left_value", "right_value", said.alias("assessment"))


def best_attempt(attempts: DataFrame, key: str = "doc_id", least: float = 60.0) -> DataFrame:
    """Of each document's attempts (priority, quality, ...): the first that reaches ``least``, else the best, of equals the first; its data with its score."""
    enough = F.when(F.col("quality") >= least, 0).otherwise(1)
    w = Window.partitionBy(key).orderBy(enough, F.when(enough == 0, F.col("priority")), F.desc("quality"), "priority")
    return attempts.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def fragmentation(entities: DataFrame, by: list[str] = ()) -> DataFrame:
    """Counts of entities, and rates of word parts, single letters and low scores."""
    n = F.count("*")
    return entities.groupBy(*by).agg(
        n.alias("n"), (F.count_if(F.col("word").startswith("##")) / n).alias("part_rate"), (F.count_if(F.length("word") <= 1) / n).alias("single_rate"), (F.count_if(F.col("score") < 0.5) / n).alias("low_rate")
    )


def blank_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds blank (null or blank after trimming) and populated: the names of the columns that are not."""
    held = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != ""
    return df.withColumn("populated", F.array_compact(F.array(*[F.when(held(c), c) for c in columns])))


def validate_features(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Adds validation_errors (names of columns out of their range or null) and is_valid."""
    bad = lambda c, lo, hi: F.when(F.col(c).isNull() | ~F.col(c).between(lo, hi), c)
    out = df.withColumn("validation_errors", F.array_compact(F.array(*[bad(c, *r) for c, r in ranges.items()])))
    return out.withColumn("is_valid", F.size("validation_errors") == 0)


def as_json(results: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, json): [{section, lines}] of each document in order."""
    made = results.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("section_id", "section", F.split("content", "\n").alias("lines")))).alias("ss"))
    return made.select(key, F.to_json(F.transform("ss", lambda s: F.struct(s["section"].alias("section"), s["lines"].alias("lines")))).alias("json"))


def contact_from_lines(lines: DataFrame, fields: dict[str, Column], head: int = 40, key: str = "doc_id", order=("page", "line_no")) -> DataFrame:
    """One row a document: for each field the match (a column over ``lines``) of the first line that has one,
    among the first ``head`` lines of the first page, else in the whole document.
    """
    w = Window.partitionBy(key).orderBy(*order)
    numbered = lines.select(key, order[0], F.row_number().over(w).alias("__n"), F.min(order[0]).over(Window.partitionBy(key)).alias("__p"), *[c.alias(f"__{name}") for name, c in fields.items()])
    near = (F.col("__n") <= head) & (F.col(order[0]) == F.col("__p"))
    best = lambda name: F.min(F.when(F.col(f"__{name}").isNotNull(), F.struct((~near).cast("int").alias("far"), F.col("__n").alias("n"), F.col(f"__{name}").alias("v"))))
    return numbered.groupBy(key).agg(*[best(name)["v"].alias(name) for name in fields])


# What company names hold, anywhere in them.
COMPANY_SIGNS = [
    "corporation", "corp", "company", "inc", "ltd", "limited", "pvt", "solutions", "technologies", "systems", "services", "group",
    "permanente", "hospital", "medical", "health", "institute",
]


def best_location(entities: DataFrame, cities: list[str], key: str = "doc_id") -> DataFrame:
    """Of the places that hold no sign of a company, the first that is a known city, else the first; documents without any have no row."""
    word = F.lower(F.trim("word"))
    places = entities.where("entity_group = 'LOCATION'").where(~reduce(or_, [F.contains(word, F.lit(x)) for x in COMPANY_SIGNS]))
    return places.groupBy(key).agg(F.min(F.struct((~word.isin(cities)).cast("int").alias("unknown"), "pos", "word"))["word"].alias("location"))


ISSUES = ("no_experience_section", "no_experiences_extracted", "no_contact", "few_sections", "no_name")


def assess_extraction(sections: DataFrame, parsed: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_sections, n_experiences, issues, assessment): what segmentation found in a document against what extraction did; documents of either side.

    ``sections``: (key, section), one row a name; ``parsed``: (key, name, email, mobile, n_experiences). issues are in the order of ``ISSUES``: no section that names
    experience; one, but no experiences; neither a section of contacts or a summary nor an address or number; under two sections; no name. assessment: failed without sections,
    segmentation_only without experiences, else both. Empty texts count as none.
    """
    low, name = F.lower("section"), F.col("section")
    own = sections.groupBy(key).agg(F.count_distinct(name).alias("n_sections"), F.coalesce(F.bool_or(F.contains(low, F.lit("experience"))), F.lit(False)).alias("__e"), F.coalesce(F.bool_or(name.isin("Contact Information", "Summary")), F.lit(False)).alias("__c"))
    both = own.join(parsed.select(key, "name", "email", "mobile", "n_experiences"), key, "full_outer")
    n, k = F.coalesce("n_sections", F.lit(0)), F.coalesce("n_experiences", F.lit(0))
    experience, contact = F.coalesce("__e", F.lit(False)), F.coalesce("__c", F.lit(False))
    none = lambda c: F.coalesce(c, F.lit("")) == ""
    held = [~experience, experience & (k == 0), ~contact & none("email") & none("mobile"), n < 2, none("name")]
    said = F.when(n == 0, "failed").when(k == 0, "segmentation_only").otherwise("both")
    return both.select(key, n.alias("n_sections"), k.alias("n_experiences"), F.array_compact(F.array(*[F.when(h, x) for h, x in zip(held, ISSUES)])).alias("issues"), said.alias("assessment"))


def distribution(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """(by, counts as a map, most_common): how often each value occurs, of equals the smallest is the most common."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(value), F.col("n"))))).alias("counts"), F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v")))["v"].alias("most_common"))
