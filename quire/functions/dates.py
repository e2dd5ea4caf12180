"""Dates, durations and rounding as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import col, first_of

MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
PRESENT = r"(?i)\b(present|current|now|ongoing|till date)\b"
MONTH = r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"


def month_number(c) -> Column:
    """By the first three letters; 1 if they name no month."""
    at = F.array_position(F.lit(MONTHS), F.lower(F.substring(F.trim(col(c)), 1, 3)))
    return F.when(at > 0, at).otherwise(1).cast("int")


def parse_month(c, as_of: str | Column) -> Column:
    """A date as ``YYYY-MM``: words for the present give ``as_of`` (a date); also ``Mon YYYY``, ``MM/YYYY``, ``YYYY-MM``, ``YYYY``; else null."""
    c = F.coalesce(col(c), F.lit(""))
    today = F.date_format(F.to_date(F.lit(as_of)) if isinstance(as_of, str) else as_of, "yyyy-MM")
    pad = lambda m: F.lpad(m.cast("string"), 2, "0")
    named = first_of(c, MONTH + r"[\s.,'-]*((?:19|20)\d{2})", group=2)
    slashed = first_of(c, r"\b(0?[1-9]|1[0-2])[/.-]((?:19|20)\d{2})\b", group=2)
    iso = first_of(c, r"\b((?:19|20)\d{2}-(?:0[1-9]|1[0-2]))\b", group=1)
    return F.coalesce(
        F.when(F.regexp(c, F.lit(PRESENT)), today),
        F.when(named.isNotNull(), F.concat(named, F.lit("-"), pad(month_number(F.regexp_extract(c, MONTH, 1))))),
        iso,
        F.when(slashed.isNotNull(), F.concat(slashed, F.lit("-"), pad(first_of(c, r"\b(0?[1-9]|1[0-2])[/.-](?:19|20)\d{2}\b", group=1).cast("int")))),
        F.concat(first_of(c, r"\b((?:19|20)\d{2})\b", group=1), F.lit("-01")),
    )


def date_as_written(c) -> Column:
    """The part of a text that is a date, in lower case and not normalised: word and year, MM/YYYY or year; ``Present`` for words for it; else the whole text. Null for none."""
    low = F.lower(F.trim(col(c)))
    now = F.regexp(low, F.lit("present|current|now|till date"))
    return F.when(F.length(col(c)) > 0, F.when(now, "Present").otherwise(F.coalesce(first_of(low, r"(?U)\w+\s+\d{4}", r"\d{1,2}/\d{4}", r"\d{4}", group=0), low)))


def months_between_ym(begin, end) -> Column:
    """Whole months from one ``YYYY-MM`` to another; 0 if negative or unknown."""
    part = lambda c, a, n: F.substring(col(c), a, n).try_cast("int")
    months = (part(end, 1, 4) - part(begin, 1, 4)) * 12 + part(end, 6, 2) - part(begin, 6, 2)
    return F.greatest(F.coalesce(months, F.lit(0)), F.lit(0))


def years_of(months) -> Column:
    """Half-even, one decimal."""
    return F.bround(col(months) / 12, 1)


def explicit_years(c) -> Column:
    """The first number that the text gives as years of experience."""
    unit = r"\+?\s*(?:years?|yrs?)"
    number = r"(\d+\.?\d*)"
    found = first_of(
        c, rf"(?i){number}{unit}(?:\s+of)?(?:\s+professional)?(?:\s+experience)", rf"(?i)experience[:\s]+{number}{unit}", rf"(?i)total\s+experience[:\s]+{number}{unit}", group=1
    )
    return found.try_cast("double")


def extrapolate(count, sampled, pages) -> Column:
    """A count on the first pages carried on to all."""
    return F.floor(col(count) * col(pages) / F.greatest(col(sampled), F.lit(1))).cast("bigint")
