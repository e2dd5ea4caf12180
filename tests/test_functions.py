import pytest
from pyspark.sql import functions as F

from quire.functions import contact, dates, text


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "c string").select(make(F.col("c")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("E X P E R I E N C E", "experience"), ("E Xperience", "experience"), ("S K I L L S", "skills"), ("P R O J E C T S", "projects"),
        ("E D U C A T I O N", "education"), ("WORK EXPERIENCE", "work experience"), ("Professional Summary", "professional summary"),
        ("Skills:", "skills"), ("Tools & Tech", "tools and tech"), ("", ""), (None, ""), ("   ", ""),
    ],
)
def test_heading_key(spark, raw, expected):
    assert one(spark, raw, lambda c: text.heading_key(c, glue_mixed=True)) == expected


def test_measures_of_null_and_empty(spark):
    for value in (None, ""):
        assert one(spark, value, text.word_count) == 0
        assert one(spark, value, text.line_count) == 0
        assert one(spark, value, text.uppercase_ratio) == 0.0
        assert one(spark, value, text.alpha_ratio) == 0.0
        assert one(spark, value, text.chunks) == []


def test_chunks_and_preview(spark):
    assert [len(x) for x in one(spark, "x" * 1030, text.chunks)] == [512, 512, 6]
    assert one(spark, "a\nb", text.preview) == "a b"
    assert one(spark, "y" * 300, text.preview) == "y" * 200 + "..."
    assert one(spark, "y" * 121, text.truncate) == "y" * 120 + "…"


def test_paths_and_sizes(spark):
    assert one(spark, r"C:\a\b.pdf", text.local_path) == "/mnt/c/a/b.pdf"
    assert one(spark, "file:///x/y", text.local_path) == "/x/y"
    assert one(spark, "2048", text.format_file_size) == "2.0 KB"
    assert one(spark, "a/b c?.Pdf", text.extension) == ".pdf"
    assert one(spark, '{"a": "x", "b": 2}', text.flatten_json_line) == "x 2"
    assert one(spark, "{broken", text.flatten_json_line) == "{broken"


@pytest.mark.parametrize(
    "raw, expected",
    [("Jan 2020", "2020-01"), ("September 2019", "2019-09"), ("03/2018", "2018-03"), ("2017", "2017-01"), ("Present", "2025-06"), ("2016-11", "2016-11"), ("soon", None), (None, None), ("", None)],
)
def test_parse_month(spark, raw, expected):
    assert one(spark, raw, lambda c: dates.parse_month(c, "2025-06-30")) == expected


def test_durations(spark):
    row = spark.createDataFrame([("2019-11", "2021-02"), ("2021-02", "2019-11"), (None, "2020-01")], "a string, b string").select(dates.months_between_ym("a", "b").alias("m")).collect()
    assert [r["m"] for r in row] == [15, 0, 0]
    assert one(spark, "Over 5.5+ years of professional experience", dates.explicit_years) == 5.5
    assert one(spark, "experience: 7 yrs", dates.explicit_years) == 7.0
    assert one(spark, "none", dates.explicit_years) is None


def located(c):
    return contact.location(c, ["Delhi", "New Delhi", "Pune"])


def test_contact(spark):
    said = "Jane Doe\nEmail: jane.doe@example.com\nMobile: +91-98765 43210\nLocation: Pune"
    assert one(spark, said, contact.email) == "jane.doe@example.com"
    assert one(spark, said, contact.mobile) == "+919876543210"
    assert one(spark, said, located) == "Pune"
    assert one(spark, "x\nIn new delhi now", located) == "New Delhi" and one(spark, "City: Pune, India", located) == "Pune"
    assert one(spark, "call +91 (044) 5550-0199 now", contact.phone) == "+91 (044) 5550-0199"
    assert one(spark, "at https://www.LinkedIn.com/in/jane-doe?x=1, ok", contact.linkedin) == "https://www.LinkedIn.com/in/jane-doe?x=1"
    assert one(spark, "github.com/jane;", contact.github) == "github.com/jane"
    assert one(spark, said, contact.name_from_text) == "Jane Doe"
    assert one(spark, "RESUME\nJANE DOE\nx", contact.name_from_text) == "JANE DOE"
    assert one(spark, "jane.doe@example.com", contact.name_from_email) == "Jane Doe"
    assert one(spark, "/tmp/jane_doe_resume_2024.pdf", contact.name_from_filename) == "Jane Doe"
    for make in (contact.email, contact.mobile, contact.phone, contact.linkedin, contact.github, located, contact.name_from_text, contact.name_from_email, contact.name_from_filename):
        assert one(spark, None, make) is None
    assert one(spark, "+1 (743) 555-3824", contact.normalize_phone) == "+1 743 555 3824"
    assert one(spark, "12345", contact.normalize_phone) is None


def test_best_name(spark):
    pick = lambda *c: one(spark, "", lambda _: contact.best_name(*[(F.lit(n).cast("string"), w) for n, w in c]))
    assert pick(("Jane Doe", 2.5), ("Jane Doe Smith", 2.0)) == "Jane Doe Smith"
    assert pick((None, 3.0), ("Jane", 2.5), ("John Roe", 1.5)) == "John Roe"
    assert pick((None, 3.0)) is None


def test_experience_section(spark):
    body = "Name\nWork Experience\n" + "built things. " * 6 + "\nEducation\nschool"
    found = one(spark, body, contact.experience_section)
    assert found.startswith("Work Experience") and "school" not in found
    assert one(spark, "nothing here", contact.experience_section) == "nothing here"
