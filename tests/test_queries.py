"""Every query with SQL against DuckDB, on the smallest dataset."""

import os

import duckdb
import pytest

from quire.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    got = sorted((tuple(plain(x) for x in r) for r in df.select(*[f"`{c}`" for c in sorted(df.columns)]).collect()), key=repr)
    if name not in catalog.oracle_sql():
        assert df.columns
        return
    rel = duck.sql(catalog.oracle_sql()[name])
    at = [rel.columns.index(c) for c in sorted(df.columns)]
    assert sorted(rel.columns) == sorted(df.columns)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_phones_of_seven_digits(spark, tmp_path):
    texts = ["call 9.179.169 now", "or +91 (044) 5550-0199", "nothing"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalog.queries()["phone_normalized"](spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [tuple(r) for r in found] == [(0, "9.179.169", "9 179 169"), (1, "+91 (044) 5550-0199", "+91 044 5550 0199")]


def test_vocabulary_comes_from_parts(spark, tmp_path):
    rows = [(1, "Red bolt", "PROMO TIN", "Brand#2", 30), (2, "blue nut", "SMALL TIN", "Brand#1", 3), (3, "red bolt", "PROMO TIN", "Brand#1", 40)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    found = {r["variant"]: (r["nosep"], r["canon"], r["prio"]) for r in catalog.queries()["vocabulary_extend"](spark, str(tmp_path)).collect()}
    last = 1 << 20
    assert found == {"promo tin": ("promotin", "Brand#1", 1), "small tin": ("smalltin", "Brand#1", 2), "red bolt": ("redbolt", "Brand#1", last), "blue nut": ("bluenut", "Additional Information", last)}


def test_blank_lines_match_marks_alone(spark, tmp_path):
    texts = ["Intro\n\n...", "Intro\n...\n  \nintro words", "...\nIntro", "x\n\n", "", "- - -"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.sql(catalog.oracle_sql()["heading_vocab_join"]).fetchall()
    found = catalog.queries()["heading_vocab_join"](spark, str(tmp_path)).select("canon", "match", "n").collect()
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr) and any(m == "despaced" for _, m, _ in want)


@pytest.mark.parametrize("sent", [1 << 22, -1])
def test_distinct_keys_alone_are_stored(spark, tmp_path, monkeypatch, sent):
    from quire.plans import document_queries

    texts = ["Intro\nthe intro of it\n...", "the intro itself\nno match","Intro\nIntro\n\nin tro", "intro:\nusage\n- - -", "usage\nthe usage, intro", "usage\n..."] * 3 + ["once the intro\nusage or not"]
    spark.createDataFrame([(i % 13, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    stored, cut = [], document_queries.cut
    monkeypatch.setattr(document_queries, "cut", lambda df: stored.append(out := cut(df)) or out)
    monkeypatch.setattr(document_queries, "SENT", sent, raising=False)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.sql(catalog.oracle_sql()["heading_vocab_join"]).fetchall()
    found = catalog.queries()["heading_vocab_join"](spark, str(tmp_path)).select("canon", "match", "n").collect()
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr) and {m for _, m, _ in want} >= {"exact", "despaced", "token"}
    keys = [r["key"] for r in stored[0].collect()]
    assert len(keys) == len(set(keys)) and len(keys) < sum(t.count("\n") + 1 for t in texts)
