import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n string, f string, score string"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes documents with columns whose names the operators use inside."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", 0, "n", "f", "s") for i, t in rows], DOCS)

    return make


LONG = "the quick brown fox jumps over the lazy dog, again and again. " * 40_000


@pytest.fixture(scope="session")
def awkward(documents):
    """Nulls, empty and long texts, repeated rows and ids, white space of all kinds."""
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, LONG), (5, "x" * 300_000), (6, "Hello world, it's me"), (6, "Hello world, it's me"), (7, "Hello world, it's me"), (None, "no id"), (8, "<|endoftext|>a <|endoftext|>"), (9, "é\u00a0ß \U0001f600\u2003中文  12³\x1c \x85 '"), (10, "a  b \n c")]
    return documents(rows)
