"""Operators 12 and 13 against plain loops."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quire.llm import line_dedup, source_audit

WHITE = " \t\n\x0b\x0c\r"


def plain_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_dedup(rows, least=40, documents=5):
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[plain_lower(line.strip(WHITE))].add(i)
    keeper = {k: max(ids, key=lambda i: (i is not None, i or 0)) for k, ids in holders.items() if len(k) >= least and len(ids) >= documents}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if keeper.get(plain_lower(x.strip(WHITE)), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def dedup(df, **options):
    return sorted((tuple(r) for r in line_dedup.dedup_lines(df, **options).select("doc_id", "n_lines", "n_dropped", "kept").collect()), key=repr)


L = ["Repeated Line Number %d over many of the documents" % n for n in range(6)] + ["É Ü ß lines that are not only of plain letters, NUMBER seven"]


def line_rows():
    rng = random.Random(3)
    rows = []
    for i in range(60):
        lines = [rng.choice(L) if rng.random() < 0.5 else "a line of its own, which is long enough, number %d" % rng.randrange(10**6) for _ in range(rng.randrange(8))]
        rows.append((i, "\n".join(rng.choice(["", " ", "\t\x0b"]) + (x.upper() if rng.random() < 0.2 else x) + rng.choice(["", "\r", "  "]) for x in lines)))
    return rows


def test_lines_against_a_loop(spark, documents):
    rows = line_rows() + [(None, L[0]), (None, L[1] + "\n" + L[0]), (7, L[0]), (7, L[0]), (100, None), (101, ""), (102, "\n\n"), (103, "short\n" * 9)]
    rows += [(n, "x" * 39) for n in range(200, 206)] + [(n, "y" * 40) for n in range(300, 304)] + [(n, "z" * 40 + "\n" + "z" * 40) for n in range(400, 405)]
    rows += [(n, " " + "w" * 40) for n in range(500, 503)] + [(n, "w" * 40) for n in range(503, 506)]
    wanted = sorted(plain_dedup(rows), key=repr)
    df = documents(rows).repartition(5)
    assert dedup(df, bits=1 << 20) == wanted
    # a full filter suspects every line, and no keeper is broadcast: the same result
    assert dedup(df, bits=64, frequent=0) == wanted
    assert dedup(df, bits=1 << 20, frequent=3) == wanted


def test_lines_of_awkward_documents(spark, awkward):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert dedup(awkward, bits=1 << 20) == sorted(plain_dedup(rows), key=repr)


def test_lines_of_an_empty_table(spark, documents):
    assert dedup(documents([]), bits=1 << 20) == []


def test_one_line_in_all_documents(spark, documents):
    rows = [(n, L[0] + "\n" + str(n)) for n in range(3000)]
    got = dedup(documents(rows).repartition(9), bits=1 << 20)
    assert sum(r[2] for r in got) == 2999 and (2999, 2, 0, L[0] + "\n2999") in got


def test_only_repeats_are_suspected(spark, documents):
    rows = [(n, "a line that only one of these documents holds: %d" % n) for n in range(500)] + [(n, L[0]) for n in range(500, 510)]
    own = documents(rows).repartition(4).selectExpr("doc_id", "xxhash64(text) as h", "text")
    assert line_dedup.suspected_lines(own, 1 << 24).select("doc_id").distinct().count() == 10


def test_filter_never_misses():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 2**63, 5000).astype(np.uint64)
    one = line_dedup.Bloom(1 << 20)
    one.add(hashes)
    assert one.holds(hashes).all() and line_dedup.Bloom(1 << 20).holds(hashes).sum() == 0
    assert one.holds(rng.integers(0, 2**63, 5000).astype(np.uint64)).mean() < 0.01


# Operator 13


def plain_audit(rows, least=3, top=200):
    """The contract word for word, in whole numbers of any size."""
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", plain_lower(text or ""))) for text, lang, source in rows]
    out = []
    for lang in {x for x, _, _ in docs}:
        held = Counter(t for x, _, words in docs if x == lang for t in set(words))
        kept = [t for t, n in held.items() if n >= least]
        count = defaultdict(Counter)
        for x, source, words in docs:
            if x == lang:
                count[source].update(w for w in words if held[w] >= least)
        p, whole = {}, Counter()
        for c in count.values():
            whole.update(c)
        for name, c in [*count.items(), (None, whole)]:
            n = sum(c.values())
            p[name] = {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}
        f = lambda a, b: (a - b) * (a - b) // b
        for s in count:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in count if o != s]
            out += [(lang, s, "pair", o, -v, n) for n, (v, _, o) in enumerate(sorted(pairs), 1)]
            terms = [(-f(p[s][t], p[None][t]), t.encode(), t) for t in kept if count[s][t] and p[s][t] > p[None][t]]
            out += [(lang, s, "term", t, -v, n) for n, (v, _, t) in enumerate(sorted(terms)[:top], 1)]
    return sorted(out)


AUDIT = "text string, lang string, source string, n string, value string, p string, term string, vector string"


def audit(spark, rows, **options):
    df = spark.createDataFrame([(*r, "n", "v", "p", "t", "x") for r in rows], AUDIT).repartition(4)
    return sorted(tuple(r) for r in source_audit.audit_sources(df, **options).collect())


def audit_rows(n=150):
    rng = random.Random(5)
    words = ["the", "of", "A", "b'c", "Ärger", "été", "x_y", "日本", "word joined", "KK"] + ["w" + chr(97 + i % 26) * (1 + i // 26) for i in range(80)]
    rows = []
    for _ in range(n):
        weights = [1 / (1 + i) for i in range(len(words))]
        rows.append((" ".join(rng.choices(words, weights, k=rng.randrange(60))), rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "a", "b", "c", "ü", None])))
    return rows


def test_audit_against_a_loop(spark):
    rows = audit_rows() + [("", "xx", "one"), (None, "xx", "two"), ("only here", "yy", "alone"), (None, None, None), ("same same", "zz", "p"), ("same same", "zz", "p"), ("same same", "zz", "q")]
    assert audit(spark, rows) == plain_audit(rows)
    assert audit(spark, rows, top=3) == plain_audit(rows, top=3)


def test_audit_of_many_sources_and_small_stretches(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(" ".join(rng.choices(["k" + chr(97 + i) for i in range(20)], k=30)), "en", f"s{rng.randrange(40)}") for _ in range(200)]
    monkeypatch.setattr(source_audit, "PAIRS", 300)
    monkeypatch.setattr(source_audit, "HELD", 50)
    monkeypatch.setattr(source_audit, "STRETCH", 16)
    assert audit(spark, rows) == plain_audit(rows)


def test_audit_of_an_empty_table(spark):
    assert audit(spark, []) == []


def test_audit_of_awkward_documents(spark, awkward):
    rows = [(r.text, r.lang, r.source) for r in awkward.collect()]
    got = sorted(tuple(r) for r in source_audit.audit_sources(awkward).collect())
    assert got == plain_audit(rows)


@pytest.mark.parametrize("count,total", [(0, 1), (0, 7), (5, 6), (10**6, 10**9), (10**12, 10**15), (8 * 10**15, 9 * 10**15 - 1)])
def test_parts_are_exact(spark, count, total):
    wanted = 1 + 10**9 * (count + 1) // total
    assert int(source_audit.parts_of_scale(np.array([count]), np.array([total]))[0]) == wanted
    from pyspark.sql import functions as F

    column = source_audit.parts_of_scale_column(F.col("c"), F.col("t"))
    assert spark.createDataFrame([(count, total)], "c bigint, t bigint").select(column).first()[0] == wanted


def test_terms_are_whole_over_stretches(monkeypatch):
    monkeypatch.setattr(source_audit, "STRETCH", 3)
    text = "Ab cdEF-gh é日 \x85x y z 1a2 " * 5
    got = [w.decode() for part in source_audit.terms_of(text) for w in part]
    assert got == re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", plain_lower(text))
