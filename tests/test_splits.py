"""Columns from gaps and headers, and of documents, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import splits
from tests.test_pages import page_of, random_boxes


def plain_gap_columns(boxes, width=612.0, gap=20.0, least=80.0):
    """(threshold, loosened, separators, columns) of one page."""
    sides = sorted((b[2], b[3]) for b in boxes)
    spaces = [(b[0] - a[1], (a[1] + b[0]) / 2) for a, b in zip(sides, sides[1:]) if b[0] - a[1] > 0]
    if not spaces:
        return None, False, [], [(0.0, width)]
    g = sorted(s for s, _ in spaces)
    at = lambda p: g[int(len(g) * p)]
    if g[-1] > at(0.5) * 3:
        threshold = max(gap * 0.6, at(0.6))
    elif g[-1] < at(0.5) * 2:
        threshold = max(gap * 1.5, at(0.9))
    else:
        threshold = max(gap, at(0.75))
    wide, loosened = [x for s, x in spaces if s >= threshold], False
    if not wide and g[-1] > gap * 0.5:
        wide, loosened = [x for s, x in spaces if s >= max(gap * 0.5, at(0.6))], True
    kept = []
    for x in wide:
        if not kept or x - kept[-1] >= least:
            kept.append(x)
    columns, start = [], 0.0
    for x in kept:
        if x - start >= least:
            columns.append((start, x))
            start = x
    if width - start >= least:
        columns.append((start, width))
    elif columns:
        columns[-1] = (columns[-1][0], width)
    else:
        columns = [(0.0, width)]
    return threshold, loosened, kept, columns


PAGES = {
    "narrow gap": [(50, 240), (270, 460)], "uniform": [(x, x + 40) for x in range(0, 600, 52)], "one word": [(10, 30)], "overlapping": [(10, 300), (20, 400), (30, 610)], "near the right edge": [(10, 100), (120, 520), (580, 600)],
    "near the left edge": [(0, 20), (60, 300), (400, 600)], "beyond the page": [(0, 100), (200, 570), (630, 680), (740, 800)], "two words": [(0, 10), (22, 40)],
}


def test_gap_columns_against_a_loop(spark):
    boxes = [(n, 0, float(a), float(b), 1.0, 9.0) for n, sides in enumerate(PAGES.values(), 100) for a, b in sides] + random_boxes(11, 30, 40)
    got = {(r["doc_id"], r["page"]): r for r in splits.gap_columns(page_of(spark, boxes)).collect()}
    loosened = 0
    for key in {(b[0], b[1]) for b in boxes}:
        threshold, loose, kept, columns = plain_gap_columns([b for b in boxes if (b[0], b[1]) == key])
        r = got[key]
        assert (r["threshold"], r["loosened"], r["separators"]) == (threshold, loose, kept), key
        assert [tuple(c) for c in r["columns"]] == columns, key
        loosened += loose
    assert loosened > 0


HEADERS = [
    ("WORK EXPERIENCE        SKILLS", 50.0, 560.0, ["Skills", "Experience and Work"]), ("EDUCATION   PROJECTS   AWARDS", 40.0, 580.0, ["education", "projects", "awards"]), ("SUMMARY", 0.0, 50.0, ["summary"]),
    ("SKILLS", 0.0, 90.0, ["skills", "no such name"]), ("SKILLS SKILLS", 10.0, 600.0, ["skills", "SKILLS"]), ("", 0.0, 9.0, ["a", "b"]),
]


def plain_split(boxes, header, width=612.0, part=5):
    """{index of a box: [(column, hint)]}."""
    text, x0, x1, names = header
    places = []
    for i, name in enumerate(names):
        at = text.lower().find(name.lower())
        if at < 0:
            at = next((p for p in (text.lower().find(w) for w in name.lower().split() if len(w) > 3) if p >= 0), -1)
        if at >= 0 and text:
            places.append((x0 + at / len(text) * (x1 - x0), i, name))
    places.sort()
    if len(places) < 2:
        return {i: [(0, None)] for i in range(len(boxes))}
    cuts = [(a[0] + b[0]) / 2 for a, b in zip(places, places[1:])]
    bounds = list(zip([0.0, *cuts], [*cuts, width]))
    kept = [(own, p[2]) for (lo, hi), p in zip(bounds, places) if len(own := [i for i, b in enumerate(boxes) if lo <= (b[2] + b[3]) / 2 <= hi]) >= part]
    if not kept:
        return {i: [(0, None)] for i in range(len(boxes))}
    out = {}
    for column, (own, name) in enumerate(kept):
        for i in own:
            out.setdefault(i, []).append((column, name))
    return out


def test_header_split_against_a_loop(spark):
    rng = random.Random(3)
    pages = {}
    for n in range(24):
        header = HEADERS[n % len(HEADERS)]
        pages[n] = header, [(n, 0, x, x + rng.choice([10.0, 20.0, 4.0]), 5.0, 9.0) for x in (float(rng.randrange(-30, 640)) for _ in range(rng.choice([3, 8, 40])))]
    # a word exactly on a cut is in both parts
    pages[90] = ("aaaa bbbb", 0.0, 900.0, ["aaaa", "bbbb"]), [(90, 0, 240.0 + d, 260.0 + d, 0.0, 1.0) for d in (0, -20, -20, -20, -20, 20, 20, 20, 20)]
    boxes = [b for _, own in pages.values() for b in own]
    heads = spark.createDataFrame([(n, 0, *h) for n, (h, _) in pages.items()], "doc_id long, page int, text string, x0 double, x1 double, names array<string>")
    got = {}
    for r in splits.split_at_headers(page_of(spark, boxes), heads).collect():
        got.setdefault((r["doc_id"], r["text"]), []).append((r["column_id"], r["section_hint"]))
    wanted, number = {}, 0
    for n, (header, own) in pages.items():
        for i, columns in plain_split(own, header).items():
            wanted[(n, f"w{number + i}")] = columns
        number += len(own)
    assert {k: sorted(v, key=repr) for k, v in got.items()} == {k: sorted(v, key=repr) for k, v in wanted.items()}
    assert any(len(v) == 2 for v in got.values())


def test_split_without_headers_and_of_the_fullest_header(spark):
    words = page_of(spark, [(1, 0, 10.0 * i, 10.0 * i + 5, 0.0, 1.0) for i in range(50)])
    none = spark.createDataFrame([], "doc_id long, page int, text string, x0 double, x1 double, names array<string>")
    assert splits.split_at_headers(words, none).select("column_id").distinct().collect() == [(0,)]
    two = spark.createDataFrame([(1, 0, "SKILLS AWARDS", 0.0, 500.0, ["skills", "awards"]), (1, 0, "A SKILLS AWARDS", 0.0, 500.0, ["a", "skills", "awards"])], none.schema)
    assert splits.header_cuts(two).first()["names"] == ["a", "skills", "awards"]


def test_document_columns_against_a_loop(spark):
    rng = random.Random(8)
    rows = [(d, p, float(rng.randrange(0, 120)), float(rng.randrange(300, 420))) for d in range(7) for p in range(9) for _ in range(rng.randrange(4))] + [(None, 0, 1.0, 2.0), (None, 1, 5.0, 6.0)]
    wanted = []
    for d in {r[0] for r in rows}:
        clusters = []
        for _, _, start, end in sorted(r for r in rows if r[0] == d):
            near = [c for c in clusters if abs(start - sum(x for x, _ in c) / len(c)) <= 10]
            (near[0] if near else clusters.append([]) or clusters[-1]).append((start, end))
        means = sorted((sum(x for x, _ in c) / len(c), sum(y for _, y in c) / len(c), len(c)) for c in clusters)
        wanted += [(d, i, pytest.approx(s), pytest.approx(e), n) for i, (s, e, n) in enumerate(means)]
    df = spark.createDataFrame(rows, "doc_id long, page int, x_start double, x_end double").repartition(5)
    got = [tuple(r) for r in splits.document_columns(df).orderBy("doc_id", "column_id").collect()]
    assert got == sorted(wanted, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert splits.document_columns(df.where(F.lit(False))).count() == 0
