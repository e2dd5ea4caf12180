"""Valleys and regions of pages against plain loops over pixels."""

import random

import pytest

from quire.operators import regions
from tests.test_pages import page_of, random_boxes


def plain_valleys(boxes, width=612.0, window=7, least=15):
    """[(start, stop, depth)] over a dense histogram; sums of whole numbers."""
    bins = int(width)
    hist = [0] * bins
    for b in boxes:
        lo, hi = (max(0, min(int(x), bins - 1)) for x in (b[2], b[3]))
        for x in range(lo, hi):
            hist[x] += 1
    h = [sum(hist[max(0, x - window // 2) : x + window // 2 + 1]) for x in range(bins)]
    minima, x = [], 1
    while x < bins - 1:
        if h[x - 1] > h[x]:
            end = x
            while end < bins - 1 and h[end + 1] == h[x]:
                end += 1
            if end < bins - 1 and h[end + 1] > h[x]:
                minima.append((x + end) // 2)
            x = end + 1
        else:
            x += 1
    kept = []
    for m in sorted(minima, key=lambda m: (h[m], -m)):
        if all(abs(m - k) >= least for k in kept):
            kept.append(m)
    out, top = [], max(h)
    for m in sorted(kept):
        left = right = m
        while left > 0 and h[left] <= h[m] * 1.5:
            left -= 1
        while right < bins - 1 and h[right] <= h[m] * 1.5:
            right += 1
        if top and right - left >= least and 1 - h[m] / top > 0.3:
            out.append((left, right, 1 - h[m] / top))
    return out


def plain_columns(valleys, width=612.0):
    cuts = sorted([0.0, *[float((a + b) // 2) for a, b, _ in sorted(valleys, key=lambda v: -v[2])[:3]], float(int(width))])
    return list(zip(cuts, cuts[1:]))


def plain_regions(boxes, width=612.0, height=792.0, drawn=()):
    by_top = sorted(boxes, key=lambda b: (b[4], b[5]))
    ys = sorted([(a[5] + b[4]) / 2 for a, b in zip(by_top, by_top[1:]) if b[4] - a[5] >= 30] + list(drawn))
    merged = []
    for y in ys:
        if merged and y - merged[-1] < 10:
            merged[-1] = (merged[-1] + y) / 2
        else:
            merged.append(y)
    found, edges = [], [0.0, *merged, height]
    for lo, hi in zip(edges, edges[1:]):
        if hi - lo < 50:
            continue
        own = [b for b in boxes if lo <= b[4] <= hi or lo <= b[5] <= hi]
        if len(own) < 10:
            found.append([lo, hi, len(own), [(0.0, width)], 0.5])
            continue
        valleys = plain_valleys(own, width)
        columns = [(a, z) for a, z in plain_columns(valleys, width) if z - a >= 80 and sum(a <= (b[2] + b[3]) / 2 < z for b in own) >= 15] or [(0.0, width)]
        sure = (0.6 if valleys else 0.9) if len(columns) == 1 else min(0.95, max(v[2] for v in valleys))
        found.append([lo, hi, len(own), columns, sure])
    joined = []
    for r in found:
        if joined and len(joined[-1][3]) == len(r[3]) and joined[-1][4] > 0.7 and r[4] > 0.7:
            p = joined[-1]
            joined[-1] = [p[0], r[1], p[2] + r[2], p[3], (p[4] + r[4]) / 2]
        else:
            joined.append(r)
    if len(joined) > 5:
        joined = sorted(sorted(joined, key=lambda r: -r[2])[:5], key=lambda r: r[0])
    return joined


def column_page(key, starts, tops, rng, n=6):
    return [(key, 0, x + 25.0 * k + rng.randrange(3), x + 25.0 * k + 18.0 + rng.randrange(5), float(y), y + 10.0) for y in tops for x in starts for k in range(n)]


def pages():
    rng = random.Random(2)
    two, one, three = (20.0, 330.0), (20.0, 180.0, 340.0), (10.0, 220.0, 430.0)
    out = column_page(1, two, range(20, 700, 14), rng)
    out += column_page(2, one, range(20, 100, 14), rng) + column_page(2, two, range(180, 400, 14), rng) + column_page(2, two, range(450, 500, 14), rng) + column_page(2, three, range(560, 780, 14), rng)
    for k in range(9):
        out += column_page(3, two if k % 2 else one, range(20 + 85 * k, 60 + 85 * k, 14), rng, 3 + k % 4)
    return out + [(4, 0, 10.0, 20.0, 5.0, 9.0), (5, 0, 10.0, 10.0, 5.0, 9.0), (6, 0, -40.0, 700.0, 1.0, 2.0), (6, 1, 0.0, 3.0, 1.0, 2.0), (6, 1, 609.0, 615.0, 1.0, 2.0)]


def test_valleys_against_pixels(spark):
    boxes = random_boxes(21, 40, 30) + [(9, p, *b[2:]) for p in range(3) for b in random_boxes(30 + p, 1, 300)] + pages()
    got = {(r["doc_id"], r["page"]): r for r in regions.valley_columns(regions.coverage_valleys(page_of(spark, boxes))).collect()}
    total = 0
    for key in {(b[0], b[1]) for b in boxes}:
        wanted = plain_valleys([b for b in boxes if (b[0], b[1]) == key])
        assert [(v["start"], v["stop"], pytest.approx(v["depth"])) for v in got[key]["valleys"]] == wanted, key
        assert [tuple(c) for c in got[key]["columns"]] == plain_columns(wanted), key
        total += len(wanted)
    assert total > 30


def test_regions_against_a_loop(spark):
    boxes = pages() + random_boxes(40, 12, 100)
    drawn = [(2, 0, 10.0, 400.0, 300.0, 301.0), (2, 0, 10.0, 60.0, 310.0, 311.0), (3, 0, 0.0, 600.0, 77.0, 77.0), (1, 0, 0.0, 500.0, 330.0, 330.0)]
    rules = spark.createDataFrame(drawn, "doc_id long, page int, x0 double, x1 double, y0 double, y1 double")
    got = {}
    for r in regions.page_regions(page_of(spark, boxes), rules).orderBy("region_no").collect():
        got.setdefault((r["doc_id"], r["page"]), []).append((r["y_start"], r["y_end"], r["n_words"], [tuple(c) for c in r["columns"]], r["confidence"]))
    kinds = set()
    for key in {(b[0], b[1]) for b in boxes}:
        ys = [(y0 + y1) / 2 for d, p, x0, x1, y0, y1 in drawn if (d, p) == key and x1 - x0 > 100]
        wanted = plain_regions([b for b in boxes if (b[0], b[1]) == key], drawn=ys)
        assert [(*r[:4], pytest.approx(r[4])) for r in got.get(key, [])] == [tuple(r) for r in wanted], key
        kinds |= {len(r[3]) for r in wanted}
    assert kinds >= {1, 2} and any(len(v) == 5 for v in got.values())


def test_regions_of_no_words(spark):
    assert regions.page_regions(page_of(spark, [])).count() == 0
