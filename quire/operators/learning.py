"""Vocabularies learned from documents: matches, proposals, registries, patterns, similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.headings import false_heading


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a) * dot(b, b)), F.lit(1e-12))


#: Variants that one row of a block of the vocabulary holds.
VARIANTS = 1024


def best_similar(queries: DataFrame, variants: DataFrame, least: float = 0.75) -> DataFrame:
    """Adds canon and similarity: the variant (canon, vector) most like each query's vector, null canon below ``least``.

    Distinct query vectors meet the vocabulary in blocks of about ``VARIANTS`` variants, so a row's size is bounded
    whatever the vocabulary; each block gives its best and the best of those stays. Of equals the first name is taken.
    Queries without a vector, and all where there are no variants, have null canon and similarity.
    """
    blocks = max(1, -(-variants.count() // VARIANTS))
    block = F.pmod(F.xxhash64("canon", "vector"), F.lit(blocks))
    held = variants.where("vector is not null").groupBy(block.alias("__block")).agg(F.collect_list(F.struct("canon", "vector")).alias("__vs"))
    asked = queries.where("vector is not null").select("vector").distinct().withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    scored = F.transform("__vs", lambda x: F.struct((-F.bround(cosine(F.col("vector"), x["vector"]), 9)).alias("d"), x["canon"].alias("canon")))
    met = asked.join(held, "__block").select("vector", F.array_min(scored).alias("__b")).groupBy("vector").agg(F.min("__b").alias("__b"))
    met = met.withColumnRenamed("vector", "__v")
    found = queries.join(met, F.col("vector") == F.col("__v"), "left")
    return found.select(*[F.col(f"`{c}`") for c in queries.columns], F.when(-F.col("__b.d") >= least, F.col("__b.canon")).alias("canon"), (-F.col("__b.d")).alias("similarity"))


def heading_statistics(headings: DataFrame, vocab: DataFrame, min_freq: int = 3) -> DataFrame:
    """(heading, freq, canon, context_words, verdict): matched, false_positive, proposed or uncertain.

    ``headings``: (heading, context_words) rows, one an occurrence.
    """
    own = headings.withColumn("heading", F.lower(F.trim("heading"))).where("heading <> ''")
    stats = own.groupBy("heading").agg(F.count("*").alias("freq"), F.avg("context_words").alias("context_words"))
    joined = stats.join(vocab.select(F.col("variant").alias("heading"), "canon"), "heading", "left")
    verdict = F.when(F.col("canon").isNotNull(), "matched").when(false_heading("heading", F.col("context_words")), "false_positive").when(F.col("freq") >= min_freq, "proposed").otherwise("uncertain")
    return joined.withColumn("verdict", verdict)


def proposals(stats: DataFrame, false_positives: DataFrame | None = None) -> DataFrame:
    """Headings proposed as new sections, without those registered as false."""
    out = stats.where("verdict = 'proposed'")
    return out if false_positives is None else out.join(false_positives.select("heading"), "heading", "left_anti")


# Words that tell a section, in the order in which they are tried, and how sure they are.
JOB_WORDS = [
    "developer", "engineer", "analyst", "manager", "architect", "consultant", "specialist", "lead", "senior", "junior", "intern", "trainee",
    "qa", "tester", "designer", "programmer", "scientist", "researcher", "coordinator", "administrator", "director", "officer", "assistant", "associate",
]
SIGNS = [
    ("Projects", ["project", "portfolio", "work sample", "case study"], 0.8),
    ("Education", ["university", "college", "school", "degree", "bachelor", "master", "phd", "diploma"], 0.8),
    ("Certifications", ["certification", "certificate", "certified", "license", "training"], 0.8),
    ("Skills", ["skill", "expertise", "proficiency", "competenc", "technical", "knowledge"], 0.75),
]


def learn_from_pattern(c: Column) -> Column:
    """struct(canon, confidence) by the first sign that the text holds, null without one or for null.

    Jobs come first: the first job word held decides, .9 where the text ends in it, else .75.
    """
    low = F.lower(F.trim(c))
    guess = lambda canon, confidence: F.struct(F.lit(canon).alias("canon"), confidence.alias("confidence"))
    rungs = [(F.contains(low, F.lit(w)), guess("Experience", F.when(F.endswith(low, F.lit(w)), 0.9).otherwise(0.75))) for w in JOB_WORDS]
    rungs += [(F.regexp(low, F.lit("|".join(words))), guess(canon, F.lit(sure))) for canon, words, sure in SIGNS]
    return F.coalesce(*[F.when(held, value) for held, value in rungs])


def add_variants(vocab: DataFrame, headings: DataFrame, least: float = 0.8) -> DataFrame:
    """Rows (canon, variant) that patterns give for headings the vocabulary lacks."""
    guess = headings.select(F.lower(F.trim("heading")).alias("variant")).distinct().withColumn("g", learn_from_pattern(F.col("variant"))).where(F.col("g.confidence") >= least)
    return guess.join(vocab.select("variant"), "variant", "left_anti").select(F.col("g.canon").alias("canon"), "variant")


def observed(lines: DataFrame, similar: DataFrame, low: float = 0.65, high: float = 0.85) -> DataFrame:
    """What a run teaches: unknown lines of middling similarity are for review, known ones from ``high`` on are variants."""
    j = lines.join(similar, "heading")
    return j.withColumn("lesson", F.when(F.col("similarity") >= high, "variant").when(F.col("similarity") >= low, "review")).where("lesson is not null")
