"""Column expressions for cleaning and measuring text; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bullets that are written alike, and dashes.
BULLETS, DASHES = "[•●▪◦‣∙·▶►■□✓✔❖➢➤]", "[–—−]"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def none_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def tokens(c) -> Column:
    """Words between white space; none for null and blank text."""
    return F.filter(F.split(F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\s+", " ")), " "), lambda w: w != "")


def normalize_text(c) -> Column:
    """Bullets to "• ", dashes to "-", control characters dropped, white space to one space."""
    c = F.regexp_replace(F.coalesce(col(c), F.lit("")), BULLETS, "• ")
    c = F.regexp_replace(F.regexp_replace(c, DASHES, "-"), r"\s+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[\x00-\x1f\x7f]", ""), " {2,}", " "))


def clean_heading(c, glue_mixed: bool = False) -> Column:
    """Text as headings are compared.

    Letters that stand each for itself are joined when all words are such; with
    ``glue_mixed`` also a run of them with the longer word that follows ("E Xperience").
    """
    c = F.coalesce(col(c), F.lit(""))
    words = tokens(c)
    single = F.size(words) > 1
    spaced = single & F.forall(words, lambda w: F.regexp(w, F.lit(r"^\p{L}$")))
    if glue_mixed:
        folded = F.aggregate(
            words, F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("run")),
            lambda acc, w: F.when(F.regexp(w, F.lit(r"^\p{L}$")), F.struct(acc["done"].alias("done"), F.concat(acc["run"], w).alias("run")))
            .when((acc["run"] != "") & F.regexp(w, F.lit(r"^\p{L}+$")), F.struct(F.array_append(acc["done"], F.concat(acc["run"], w)).alias("done"), F.lit("").alias("run")))
            .otherwise(F.struct(F.array_append(F.when(acc["run"] != "", F.array_append(acc["done"], acc["run"])).otherwise(acc["done"]), w).alias("done"), F.lit("").alias("run"))),
            lambda acc: F.array_join(F.when(acc["run"] != "", F.array_append(acc["done"], acc["run"])).otherwise(acc["done"]), " "),
        )
        c = F.when(single, folded).otherwise(c)
    else:
        c = F.when(spaced, F.array_join(words, "")).otherwise(c)
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[•·|]", " "), "&", " and "), "[—–]", "-")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9\s:.-]", " "), r"\s+", " "))


def heading_key(c, glue_mixed: bool = False) -> Column:
    """``clean_heading`` without a last colon, in lower case."""
    return F.lower(F.trim(F.regexp_replace(clean_heading(c, glue_mixed), ":$", "")))


def despaced(c) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), "[^a-z0-9]+", "")


def letters(c) -> Column:
    return F.regexp_count(F.coalesce(col(c), F.lit("")), F.lit(r"\p{L}"))


def uppercase_ratio(c) -> Column:
    """Upper-case letters to letters; 0 without letters."""
    n = letters(c)
    return F.when(n > 0, F.regexp_count(col(c), F.lit(r"\p{Lu}")) / n).otherwise(0.0)


def titlecase_ratio(c) -> Column:
    words = tokens(c)
    return F.when(F.size(words) > 0, F.size(F.filter(words, lambda w: F.regexp(w, F.lit(r"^\p{Lu}")))) / F.size(words)).otherwise(0.0)


def alpha_ratio(c, also: str = "") -> Column:
    """Letters, white space and the characters of ``also`` (a class's inside) to all."""
    c = F.coalesce(col(c), F.lit(""))
    return F.when(F.length(c) > 0, F.regexp_count(c, F.lit(rf"[\p{{L}}\s{also}]")) / F.length(c)).otherwise(0.0)


def digit_count(c) -> Column:
    return F.regexp_count(F.coalesce(col(c), F.lit("")), F.lit("[0-9]"))


def digit_ratio(c) -> Column:
    n = F.length(F.coalesce(col(c), F.lit("")))
    return F.when(n > 0, digit_count(c) / n).otherwise(0.0)


def word_count(c) -> Column:
    return F.size(tokens(c))


def line_count(c) -> Column:
    c = F.coalesce(col(c), F.lit(""))
    return F.when(c == "", 0).otherwise(F.regexp_count(c, F.lit("\n")) + 1)


def chars_without_space(c) -> Column:
    return F.length(F.regexp_replace(F.coalesce(col(c), F.lit("")), " ", ""))


def preview(c, window: int = 500, n: int = 200) -> Column:
    """The first ``n`` of the first ``window`` characters on one line, with dots where it is full."""
    short = F.substring(F.regexp_replace(F.substring(F.coalesce(col(c), F.lit("")), 1, window), "\n", " "), 1, n)
    return F.when(F.length(short) == n, F.concat(short, F.lit("..."))).otherwise(short)


def truncate(c, n: int = 120) -> Column:
    return F.when(F.length(col(c)) > n, F.concat(F.substring(col(c), 1, n), F.lit("…"))).otherwise(col(c))


def sanitize_cell(c) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""))


def chunks(c, size: int = 512) -> Column:
    """An array of stretches of ``size`` characters."""
    c = F.coalesce(col(c), F.lit(""))
    starts = F.when(F.length(c) > 0, F.sequence(F.lit(1), F.length(c), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(c, i, F.lit(size)))


def first_of(c, *patterns: str, group: int = 0) -> Column:
    """The first match of the first pattern that matches; null if none does."""
    return F.coalesce(*[none_if_empty(F.regexp_extract(F.coalesce(col(c), F.lit("")), p, group)) for p in patterns])


def color_parts(c) -> Column:
    """A packed colour as struct(r, g, b)."""
    part = lambda shift, name: F.shiftright(col(c), shift).bitwiseAND(F.lit(255)).alias(name)
    return F.struct(part(16, "r"), part(8, "g"), part(0, "b"))


def is_bold_font(c) -> Column:
    return F.coalesce(F.regexp(F.lower(col(c)), F.lit("bold|heavy|black|medium|demi|bd$")), F.lit(False))


def is_italic_font(c) -> Column:
    return F.coalesce(F.regexp(F.lower(col(c)), F.lit("italic|oblique")), F.lit(False))


def extension(c) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(col(c), F.lit("")), r"(\.[A-Za-z0-9]+)$", 1))


def sanitize_filename(c) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"^.*[/\\]", ""), r"[^A-Za-z0-9._-]", "_")


def format_file_size(c) -> Column:
    n = col(c).cast("double")
    return F.when(n < 1024, F.format_string("%.1f B", n)).when(n < 1048576, F.format_string("%.1f KB", n / 1024)).when(
        n < 1073741824, F.format_string("%.1f MB", n / 1048576)).otherwise(F.format_string("%.1f GB", n / 1073741824))


def local_path(c) -> Column:
    """``file://`` dropped; ``C:\\x`` becomes ``/mnt/c/x``."""
    c = F.regexp_replace(col(c), "^file://", "")
    drive = F.regexp_extract(c, r"^([A-Za-z]):[\\/]", 1)
    return F.when(drive != "", F.concat(F.lit("/mnt/"), F.lower(drive), F.lit("/"), F.regexp_replace(F.substring(c, 4, 1 << 20), r"\\", "/"))).otherwise(c)


def flatten_json_line(c) -> Column:
    """A line that is a JSON object becomes its values, others stay."""
    held = F.from_json(col(c), "map<string,string>")
    return F.when(F.regexp(col(c), F.lit(r"^\s*\{")) & held.isNotNull(), F.concat_ws(" ", F.map_values(held))).otherwise(col(c))


def list_to_csv(c) -> Column:
    return F.concat_ws(",", F.transform(col(c), lambda x: x.cast("string")))
