"""Recognised entities to experiences: merging of word parts, the state machine, skills, totals.

Frames hold (doc_id, pos, word, entity_group, score). A document's entities
are folded as one array by higher-order functions, so nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import alpha_ratio, tokens

# Words that are no entity, and words that are no skill.
NOISE = ["the", "and", "or", "in", "at", "to", "for", "of", "a", "an"]
NOT_SKILLS = [
    "the", "and", "or", "in", "at", "to", "for", "of", "a", "an", "with", "from", "by", "on", "as", "is", "are", "was", "were",
    "been", "be", "have", "has", "had", "do", "does", "did",
]
_ENTITY = "struct<pos:int,word:string,entity_group:string,score:double,n:int,short:boolean>"
_EXPERIENCE = "struct<company:string,role:string,from_date:string,to_date:string,skills:array<string>>"


def _arrays(entities: DataFrame, key: str) -> DataFrame:
    row = F.struct(F.col("pos").cast("int").alias("pos"), "word", "entity_group", F.col("score").cast("double").alias("score"))
    return entities.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("es"))


def merge_word_parts(entities: DataFrame, key: str = "doc_id") -> DataFrame:
    """Parts that begin with ## join the word before; so does one entity of the same group and at most three letters right after its start. Scores are averaged."""

    def step(acc: Column, e: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        part = F.startswith(e["word"], F.lit("##"))
        short = (last["n"] == 1) & (last["entity_group"] == e["entity_group"]) & (F.length(e["word"]) <= 3)
        joined = F.struct(last["pos"].alias("pos"), F.concat(last["word"], F.when(part, F.replace(e["word"], F.lit("##"), F.lit(""))).otherwise(e["word"])).alias("word"),
                          last["entity_group"].alias("entity_group"), (last["score"] + e["score"]).alias("score"), (last["n"] + 1).alias("n"), F.lit(True).alias("short"))
        fresh = F.struct(e["pos"].alias("pos"), e["word"].alias("word"), e["entity_group"].alias("entity_group"), e["score"].alias("score"), F.lit(1).alias("n"), F.lit(False).alias("short"))
        rest = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(F.coalesce((F.size(acc) > 0) & (part | short), F.lit(False)), F.array_append(rest, joined)).otherwise(F.array_append(acc, fresh))

    merged = _arrays(entities, key).select(key, F.explode(F.aggregate("es", F.array().cast(f"array<{_ENTITY}>"), step)).alias("e"))
    return merged.select(key, "e.pos", F.trim("e.word").alias("word"), "e.entity_group", (F.col("e.score") / F.col("e.n")).alias("score"))


def clean_word(c: Column) -> Column:
    return F.trim(F.btrim(F.regexp_replace(F.replace(c, F.lit("##"), F.lit("")), r"\s+", " "), F.lit(".,;:!?-_*~` ")))


def sound(entities: DataFrame, least: float = 0.0) -> DataFrame:
    """Drops word parts, single letters, noise words, short technical words of low score, and scores below ``least``."""
    w = F.col("word")
    return entities.where(
        ~w.startswith("##") & (F.length(F.trim(w)) > 1) & ~((F.col("entity_group") == "TECH") & (F.length(w) <= 2) & (F.col("score") < 0.7))
        & ~F.lower(w).isin(NOISE) & (F.col("score") >= least)
    )


def ordered_distinct(df: DataFrame, keys: list, order: str = "pos") -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def experiences(entities: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, exp_no, company, role, from_date, to_date, skills) by walking over the entities.

    A company, or a role of more than four letters, opens an experience; either fills
    the open one if it has none. After two dates the next company or role closes it. Kept
    are those with a company of more than three letters or a role of more than five, and a date.
    """
    empty = F.array().cast(f"array<{_EXPERIENCE}>")
    null = F.lit(None).cast("string")

    def make(company=null, role=null, begin=null, end=null, skills=None) -> Column:
        return F.struct(company.alias("company"), role.alias("role"), begin.alias("from_date"), end.alias("to_date"), (F.array().cast("array<string>") if skills is None else skills).alias("skills"))

    def state(done: Column, now: Column, dates: Column) -> Column:
        return F.struct(done.alias("done"), now.alias("now"), dates.alias("dates"))

    def step(acc: Column, e: Column) -> Column:
        text, now, dates, group = clean_word(e["word"]), acc["now"], acc["dates"], e["entity_group"]
        closed = F.array_append(acc["done"], now)
        skip = (F.length(text) <= 2) & (e["score"] < 0.6)
        company = (group == "COMPANY") & ((F.length(text) > 3) | (e["score"] > 0.75))
        role = (group == "ROLE") & (F.length(text) > 4)
        filled = lambda **x: make(*(x.get(k, now[f]) for k, f in (("c", "company"), ("r", "role"), ("b", "from_date"), ("e", "to_date"), ("s", "skills"))))
        zero = F.lit(0)
        return (
            F.when(skip, acc)
            .when(company & now.isNotNull() & (dates >= 2), state(closed, make(company=text), zero))
            .when(company & now.isNull(), state(acc["done"], make(company=text), zero))
            .when(company & now["company"].isNull(), state(acc["done"], filled(c=text), dates))
            .when(role & now.isNull(), state(acc["done"], make(role=text), zero))
            .when(role & now["role"].isNull(), state(acc["done"], filled(r=text), dates))
            .when(role & (dates >= 2), state(closed, make(role=text), zero))
            .when((group == "DATE") & now.isNotNull() & now["from_date"].isNull(), state(acc["done"], filled(b=text), dates + 1))
            .when((group == "DATE") & now.isNotNull() & now["to_date"].isNull(), state(acc["done"], filled(e=text), dates + 1))
            .when((group == "TECH") & now.isNotNull() & (F.length(text) > 1), state(acc["done"], filled(s=F.array_append(now["skills"], text)), dates))
            .otherwise(acc)
        )

    start = state(empty, F.lit(None).cast(_EXPERIENCE), F.lit(0))
    walked = _arrays(entities, key).select(key, F.aggregate("es", start, step, lambda acc: F.when(acc["now"].isNotNull(), F.array_append(acc["done"], acc["now"])).otherwise(acc["done"])).alias("xs"))
    valid = F.filter("xs", lambda x: ((F.coalesce(F.length(x["company"]), F.lit(0)) > 3) | (F.coalesce(F.length(x["role"]), F.lit(0)) > 5)) & (x["from_date"].isNotNull() | x["to_date"].isNotNull()))
    return walked.select(key, F.posexplode(valid).alias("exp_no", "x")).select(key, "exp_no", "x.*")


def experiences_by_company(entities: DataFrame, key: str = "doc_id", least: float = 0.6) -> DataFrame:
    """The simpler rule: a row for each company, with the document's first good role and first two good dates."""
    good = lambda g: F.when((F.col("entity_group") == g) & (F.col("score") > least), F.struct("pos", "word"))
    dates = F.array_sort(F.collect_list(good("DATE")))
    own = entities.groupBy(key).agg(F.coalesce(F.min(good("ROLE")), F.min(F.when(F.col("entity_group") == "ROLE", F.struct("pos", "word")))).alias("r"), dates.alias("ds"))
    companies = entities.where("entity_group = 'COMPANY'").select(key, "pos", F.col("word").alias("company"))
    date = lambda i: F.try_element_at(F.col("ds"), F.lit(i))["word"]
    return companies.join(own, key).select(key, "pos", "company", F.col("r.word").alias("role"), date(1).alias("from_date"), date(2).alias("to_date"))


def clean_skills(skills: Column, most: int = 40) -> Column:
    """Each skill once, letter case aside; no short, long, common or numeric ones; order is kept."""
    tidy = F.filter(
        F.transform(skills, lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))),
        lambda s: F.length(s).between(2, most) & ~F.lower(s).isin(NOT_SKILLS) & ~F.startswith(s, F.lit("##")) & ~F.regexp(s, F.lit(r"^\d+$")),
    )
    return F.aggregate(
        tidy, F.array().cast("array<string>"), lambda acc, s: F.when(F.exists(acc, lambda x: F.lower(x) == F.lower(s)), acc).otherwise(F.array_append(acc, s))
    )


def clean_company(c: Column) -> Column:
    return F.trim(F.rtrim(F.regexp_replace(c, r"\s+", " "), F.lit(".,;:-")))


def allot_evenly(items: DataFrame, parts: int, key: str = "doc_id", order: str = "pos") -> DataFrame:
    """Adds part: the items in order dealt to ``parts`` parts, what is over to the first ones."""
    return items.withColumn("part", F.ntile(parts).over(Window.partitionBy(key).orderBy(order)))


def primary_role(exps: DataFrame, key: str = "doc_id") -> DataFrame:
    """The first role that is known."""
    return exps.groupBy(key).agg(F.min_by("role", F.when(F.col("role").isNotNull(), F.col("exp_no"))).alias("primary_role"))


def total_years(exps: DataFrame, explicit: DataFrame, key: str = "doc_id") -> DataFrame:
    """Years that the text names (key, explicit_years), else the months' sum over 12."""
    summed = exps.groupBy(key).agg(F.bround(F.sum("duration_months") / 12, 1).alias("__s"))
    return explicit.join(summed, key, "left").select(key, F.coalesce(F.when(F.col("explicit_years") > 0, F.col("explicit_years")), "__s", F.lit(0.0)).alias("total_years"))


# Labels that are no person, and words of jobs.
LABELS = [
    "email", "phone", "mobile", "resume", "cv", "address", "location", "objective", "summary", "experience", "education", "skills",
    "profile", "contact", "linkedin", "github", "portfolio",
]
JOBS = ["engineer", "developer", "manager", "analyst", "consultant", "specialist"]


def best_person(people: DataFrame, texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, name, points): the likeliest of a document's recognised persons (key, pos, word); documents without one above zero points have no row.

    Names of one word and labels don't count. Points: twice (5 - i) where the name first stands in line i (from 0) of the
    first five of ``texts`` (key, text), unless that line holds a label; 3 for two to four words; -5 for a word of jobs; twice the share
    of letters and spaces; 2 where every word begins in upper case. Ties: the earlier position.
    """
    name, low = F.col("word"), F.lower("word")
    words = tokens("word")
    heads = texts.select(key, F.slice(F.split(F.coalesce("text", F.lit("")), "\n"), 1, 5).alias("__lines"))
    joined = people.join(heads, key, "left").withColumn("__lines", F.coalesce("__lines", F.array().cast("array<string>")))
    marked = F.transform("__lines", lambda line, i: F.when(F.contains(line, name), F.struct(i.alias("i"), F.lower(line).alias("line"))))
    at = F.try_element_at(F.array_compact(marked), F.lit(1))
    placed = F.when(at.isNotNull() & ~F.regexp(at["line"], F.lit("|".join(LABELS))), (5 - at["i"]) * 2).otherwise(0)
    points = (
        placed + F.when(F.size(words).between(2, 4), 3).otherwise(0) - F.when(F.regexp(low, F.lit("|".join(JOBS))), 5).otherwise(0)
        + 2 * alpha_ratio("word") + F.when(F.forall(words, lambda w: F.regexp(w, F.lit(r"^\p{Lu}"))), 2).otherwise(0)
    )
    scored = joined.where(~low.isin(LABELS) & (F.size(words) >= 2)).select(key, "pos", "word", points.alias("points")).where("points > 0")
    first = F.struct("points", -F.col("pos"))
    return scored.groupBy(key).agg(F.max_by("word", first).alias("name"), F.max("points").alias("points"))
