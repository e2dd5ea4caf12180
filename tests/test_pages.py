"""Page vectors, block splitting and fallback chains against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import blocks, fallback, page_vectors

WORDS = "doc_id long, page int, text string, x0 double, x1 double, top double, bottom double, page_width double, page_height double"


def page_of(spark, boxes, width=612.0, height=792.0):
    """boxes: (doc_id, page, x0, x1, top, bottom)."""
    return spark.createDataFrame([(d, p, f"w{i}", a, b, t, u, width, height) for i, (d, p, a, b, t, u) in enumerate(boxes)], WORDS)


def random_boxes(seed, pages=6, n=60):
    rng = random.Random(seed)
    out = []
    for page in range(pages):
        for _ in range(rng.randrange(1, n)):
            x, y = float(rng.randrange(0, 580)), float(rng.randrange(0, 770))
            out.append((page % 2, page, x, x + rng.randrange(1, 60), y, y + rng.randrange(0, 25)))
    return out


def plain_split(rows, width, height, path="", depth=0):
    """{text: (path, kind)} by recursion over one region's rows (text, x0, x1, top, bottom)."""
    if depth == 3 or width < 50 or height < 50:
        return {r[0]: (path, None) for r in rows}

    def chains(order, value, apart):
        groups = []
        for r in sorted(rows, key=order):
            if groups and abs(value(r) - value(groups[-1][-1])) < apart:
                groups[-1].append(r)
            else:
                groups.append([r])
        return groups

    columns = chains(lambda r: (r[1], r[2], r[3], r[4]), lambda r: (r[1] + r[2]) / 2, width * 0.05)
    bands = chains(lambda r: (r[3], r[4], r[1], r[2]), lambda r: r[3], height * 0.02)
    if len(columns) < 2:
        kind = "vertical" if len(bands) >= 3 else "simple"
        return {r[0]: (path, kind) for r in rows}
    out = {}
    for n, own in enumerate(columns):
        out |= plain_split(own, max(r[2] for r in own) - min(r[1] for r in own), max(r[4] for r in own) - min(r[3] for r in own), f"{path}/{n}", depth + 1)
    return out


def test_split_regions_against_recursion(spark):
    boxes = random_boxes(1, 8, 120) + [(9, 0, 10.0, 60.0, 5.0, 9.0)]
    df = page_of(spark, boxes)
    wanted = {}
    for key in {(b[0], b[1]) for b in boxes}:
        rows = [(f"w{i}", a, b, t, u) for i, (d, p, a, b, t, u) in enumerate(boxes) if (d, p) == key]
        wanted |= plain_split(rows, 612.0, 792.0)
    got = {r["text"]: (r["path"], r["kind"]) for r in blocks.split_regions(df).collect()}
    assert got == wanted
    assert len({p for p, _ in got.values()}) > 10


def test_split_regions_of_no_blocks(spark):
    assert blocks.split_regions(page_of(spark, [])).count() == 0


@pytest.mark.parametrize("columns,n,images,said", [(1, 5, 0, "simple"), (1, 40, 0, "simple"), (2, 9, 0, "simple"), (2, 10, 0, "moderate"), (3, 9, 1, "moderate"), (3, 10, 1, "complex"), (1, 30, 3, "moderate"), (3, 30, 3, "complex")])
def test_complexity_points(spark, columns, n, images, said):
    assert spark.range(1).select(blocks.complexity(F.lit(columns), F.lit(n), F.lit(images))).first()[0] == said


def plain_vector(boxes, width=612.0, height=792.0):
    """The features that need no gutter, word for word."""
    boxes = sorted(boxes, key=lambda b: (b[4], b[2], b[3], b[5]))
    bins = max(200, int(width / 2))
    centres = [(b[2] + b[3]) / 2 for b in boxes]
    hist = [0] * bins
    for c in centres:
        if 0 <= c <= width:
            hist[min(int(c * bins / width), bins - 1)] += 1
    smooth = [sum(hist[max(0, i - 2) : i + 3]) for i in range(bins)]
    top = max(5, max(smooth))

    def width_of(i, inside):
        left = right = i
        while left > 0 and inside(smooth[left]):
            left -= 1
        while right < bins - 1 and inside(smooth[right]):
            right += 1
        return right - left

    inner = range(1, bins - 1)
    peaks = [i for i in inner if smooth[i] > smooth[i - 1] and smooth[i] > smooth[i + 1] and smooth[i] * 5 > top]
    valleys = [i for i in inner if smooth[i] < smooth[i - 1] and smooth[i] < smooth[i + 1]]
    lines = {}
    for b in sorted(boxes, key=lambda b: (b[4] + b[5]) / 2):
        y = (b[4] + b[5]) / 2
        lines.setdefault(next((k for k in lines if abs(y - k) <= 5), y), []).append(b)
    widths = [max(b[3] for b in own) - min(b[2] for b in own) for own in lines.values()]
    variance = lambda v: sum((x - sum(v) / len(v)) ** 2 for x in v) / len(v) if v else 0.0
    ys = sorted(lines)

    def overlap(reach):
        found = []
        for i, a in enumerate(boxes):
            for b in boxes[i + 1 : i + 1 + reach]:
                least = min(a[5] - a[4], b[5] - b[4])
                if least > 0:
                    found.append(max(0.0, min(a[5], b[5]) - max(a[4], b[4])) / least)
        return sum(found) / len(found) if found else 0.0

    return {
        "mean_y_overlap": overlap(len(boxes)), "mean_y_overlap_near": overlap(19), "full_width_line_ratio": sum(w >= 0.75 * width for w in widths) / len(widths), "horizontal_lines_count": sum(w >= 0.75 * width for w in widths),
        "line_density_variance": variance([len(x) for x in lines.values()]), "line_spacing_variance": variance([b - a for a, b in zip(ys, ys[1:])]), "max_line_width_ratio": max(widths) / width, "min_line_width_ratio": min(widths) / width,
        "avg_word_width_ratio": sum(b[3] - b[2] for b in boxes) / len(boxes) / width, "text_density": len(boxes) / (width * height), "peak_count": len(peaks), "valley_count": len(valleys), "peak_separation": (peaks[1] - peaks[0]) / bins if len(peaks) > 1 else 0.0,
        "peak_widths": [width_of(i, lambda v, i=i: v * 2 > smooth[i]) / bins for i in peaks], "peak_heights": [smooth[i] / top for i in peaks], "valley_depths": [smooth[i] / top for i in valleys],
        "valley_widths": [width_of(i, lambda v, i=i: v * 2 < top + smooth[i]) / bins for i in valleys], "valley_position": min(valleys, key=lambda i: smooth[i]) / bins if valleys else 0.5, "valley_depth_ratio": min([smooth[i] for i in valleys]) / top if valleys else 1.0,
    }


def test_vectors_against_loops(spark):
    rng = random.Random(4)
    dense = [(7, 0, x, x + 20.0, float(y), y + 10.0) for y in range(50, 700, 15) for x in (50.0, 90.0, 320.0 + rng.randrange(6), 420.0, 470.0)]
    boxes = random_boxes(2) + random_boxes(3, 3, 200) + dense + [(8, 0, 10.0, 20.0, 5.0, 5.0), (8, 1, -50.0, -40.0, 0.0, 9.0), (8, 2, 0.0, 612.0, 3.0, 9.0)]
    got = {(r["doc_id"], r["page"]): r for r in page_vectors.page_vectors(page_of(spark, boxes)).collect()}
    keys = {(b[0], b[1]) for b in boxes}
    assert set(got) == keys
    for key in keys:
        for name, value in plain_vector([b for b in boxes if (b[0], b[1]) == key]).items():
            assert got[key][name] == pytest.approx(value), (key, name)
    assert got[(7, 0)]["num_columns"] == 2
    assert sum(r["peak_count"] for r in got.values()) > 5 and sum(r["valley_count"] for r in got.values()) > 5


def test_vectors_share_one_exchange(spark):
    df = page_vectors.page_vectors(page_of(spark, random_boxes(5)))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.find("+- == Initial Plan ==")] if "== Initial Plan ==" in plan else plan
    dealt = [line for line in final.splitlines() if "Exchange hashpartitioning" in line and "ReusedExchange" not in line]
    assert len(dealt) == 1 and final.count("ReusedExchange") >= 5


def rated(quality, data, error=None):
    def work(df):
        seen.append(0)
        return df.withColumns({"quality": quality, "data": data, "error": F.lit(error) if error is None or isinstance(error, str) else error})

    seen = []
    return work


def test_chain_stops_where_a_result_is_good(spark):
    docs = spark.createDataFrame([(1, 70.0, 90.0), (2, 10.0, 65.0), (3, 10.0, 20.0), (3, 10.0, 20.0), (None, 30.0, 30.0), (5, None, 0.0)], "doc_id long, a double, b double")
    strategies = {"a": rated(F.col("a"), F.lit("A")), "b": rated(F.col("b"), F.lit("B"))}
    got = fallback.fallback_chain(docs, strategies, F.array(F.lit("a"), F.lit("none"), F.lit("b")), "string").orderBy("doc_id").collect()
    said = {r["doc_id"]: (r["status"], r["strategy"], r["quality"], r["data"], len(r["attempts"])) for r in got}
    assert len(got) == 6
    assert said == {1: ("accepted", "a", 70.0, "A", 1), 2: ("accepted", "b", 65.0, "B", 2), 3: ("low_quality", "b", 20.0, "B", 2), None: ("low_quality", "a", 30.0, "A", 2), 5: ("failed", None, None, None, 2)}


def test_chain_gives_a_strategy_open_rows_only(spark):
    docs = spark.range(100).selectExpr("id as doc_id", "id % 10 as k")
    met = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(k):
        met.add(1)
        return 80.0

    strategies = {"a": rated(F.when(F.col("k") < 7, 100.0).otherwise(0.0), F.lit(1)), "b": rated(counted("k"), F.lit(2))}
    got = fallback.fallback_chain(docs, strategies, F.array(F.lit("a"), F.lit("b")), "int")
    assert got.where("strategy = 'b'").count() == 30 and got.count() == 100
    assert met.value == 30


def test_chain_keeps_errors_and_rows_without_an_order(spark):
    docs = spark.createDataFrame([(1, "pdf"), (2, "docx"), (3, None)], "doc_id long, failed string")
    strategies = {"region": rated(F.lit(99.0), F.lit(1), "no table"), "ocr": rated(F.lit(61.0), F.lit(2)), "pdf": rated(F.lit(5.0), F.lit(3))}
    got = {r["doc_id"]: r for r in fallback.fallback_chain(docs, strategies, fallback.after_failure(F.col("failed")), "int").collect()}
    assert [(a["strategy"], a["quality"], a["error"]) for a in got[1]["attempts"]] == [("region", None, "no table"), ("ocr", 61.0, None)] and got[1]["status"] == "accepted"
    assert got[2]["status"] == "failed" and got[2]["attempts"] == []
    assert [a["strategy"] for a in got[3]["attempts"]] == ["pdf", "ocr"]
    counts = {tuple(r) for r in fallback.attempt_counts(fallback.fallback_chain(docs, strategies, fallback.after_failure(F.col("failed")), "int")).collect()}
    assert counts == {(1, "region", 1, 1, 0), (2, "ocr", 2, 0, 2), (1, "pdf", 1, 0, 0)}


def test_chain_of_an_empty_table(spark):
    assert fallback.fallback_chain(spark.createDataFrame([], "doc_id long"), {"a": rated(F.lit(1.0), F.lit(1))}, F.array(F.lit("a")), "int").count() == 0
