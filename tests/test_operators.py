import io
import random
import zipfile

from pyspark.sql import functions as F

from quire.operators import columns, entities, headings, layout, learning, lines, report, sections, vocabulary
from quire.sources import readers, sinks

WORD = "doc_id long, page int, text string, x0 double, x1 double, top double, bottom double, page_width double, page_height double"


HEADINGS = {
    "Summary": ["summary"],
    "Skills": ["skills", "technical skills", "language skills"],
    "Experience": ["experience", "work experience", "professional experience", "work history", "project experience"],
    "Projects": ["projects", "project experience"],
    "Education": ["education"],
    "Achievements": ["achievements", "extracurricular activities"],
    "Languages": ["language skills"],
    "Hobbies": ["extracurricular activities"],
}


def small_vocabulary(spark):
    return vocabulary.vocabulary(spark, vocabulary.section_rows(HEADINGS))


def two_columns(spark):
    rows = [(1, 0, f"l{i}", 50.0, 280.0, 100.0 + 15 * i, 112.0 + 15 * i, 595.0, 842.0) for i in range(20)]
    rows += [(1, 0, f"r{i}", 320.0, 550.0, 100.0 + 15 * i, 112.0 + 15 * i, 595.0, 842.0) for i in range(20)]
    return spark.createDataFrame(rows, WORD)


def test_gap_columns_finds_two(spark):
    cover = columns.coverage_histogram(two_columns(spark))
    bins = columns.dense_bins(cover.where("n > 0").select("doc_id", "page", F.explode(F.sequence(F.col("x"), F.col("x_next") - 1)).alias("bin"), "n"))
    got = columns.gap_columns(bins, 595.0).orderBy("column_id").collect()
    assert [(r["x_start"], r["x_end"]) for r in got] == [(50, 280), (320, 550)]
    own = columns.assign_by_center(two_columns(spark), columns.gap_columns(bins, 595.0))
    assert {(r["column_id"], r["n"]) for r in own.groupBy("column_id").agg(F.count("*").alias("n")).collect()} == {(0, 20), (1, 20)}


def test_interval_lines_equal_the_sequential_rule(spark):
    rng = random.Random(5)
    rows = [(d, 0, f"w{i}", float(rng.randint(0, 500)), 510.0, t := float(rng.randint(0, 300)), t + rng.randint(5, 20), 600.0, 800.0) for d in range(10) for i in range(40)]
    got = {(r["doc_id"], r["text"]): r["line_no"] for r in lines.interval_lines(spark.createDataFrame(rows, WORD), 1.0).collect()}
    for d in range(10):
        low, n = None, -1
        for r in sorted((r for r in rows if r[0] == d), key=lambda r: (r[5], r[3], r[4], r[2])):
            if low is None or r[5] > low + 1.0:
                n += 1
            low = r[6] if low is None else max(low, r[6])
            assert got[d, r[2]] == n


def test_anchor_lines_equal_the_sequential_rule(spark):
    rng = random.Random(6)
    rows = [(d, 0, f"w{i}", float(i), 510.0, float(rng.randint(0, 200)), 210.0, 600.0, 800.0) for d in range(6) for i in range(30)]
    got = {(r["doc_id"], r["text"]): r["line_no"] for r in lines.anchor_lines(spark.createDataFrame(rows, WORD), 5.0).collect()}
    for d in range(6):
        anchor, n = None, -1
        for r in sorted((r for r in rows if r[0] == d), key=lambda r: (r[5], r[3])):
            if anchor is None or abs(r[5] - anchor) > 5:
                anchor, n = r[5], n + 1
            assert got[d, r[2]] == n


def test_chained_merge(spark):
    rows = [(1, 0, "a", 10.0, 0.0, 8.0), (1, 0, "b", 10.5, 20.0, 30.0), (1, 0, "c", 11.0, 31.0, 40.0), (1, 0, "d", 30.0, 0.0, 9.0)]
    got = lines.chained_merge(spark.createDataFrame(rows, "doc_id long, page int, text string, y0 double, x0 double, x1 double")).orderBy("line_no").collect()
    assert [r["text"] for r in got] == ["a bc", "d"]


def test_split_detections_and_bbox(spark):
    w = spark.createDataFrame([(1, 0, "ab cd", 0.0, 10.0, 0.0, 2.0, 600.0, 800.0)], WORD)
    got = lines.split_detections(w).orderBy("x0").collect()
    assert [(r["text"], r["x0"], r["x1"]) for r in got] == [("ab", 0.0, 5.0), ("cd", 5.0, 10.0)]
    assert lines.bbox(w).first()["x_center"] == 5.0


def test_headings_and_vocabulary(spark):
    vocab = small_vocabulary(spark)
    kept = {r["variant"]: r["canon"] for r in vocab.collect()}
    assert kept["extracurricular activities"] == "Hobbies" and kept["project experience"] == "Projects" and kept["language skills"] == "Languages"
    rows = [(1, "EXPERIENCE"), (2, "T e c h n i c a l"), (3, "S K I L L S"), (4, "Work-History:"), (5, "EXPERIENCE SKILLS"), (6, "hello there"), (7, ""), (8, None)]
    got = {r["line_id"]: (r["canon"], r["match"]) for r in headings.match_headings(spark.createDataFrame(rows, "line_id int, text string"), vocab).collect()}
    assert got[1] == ("Experience", "exact") and got[3] == ("Skills", "exact") and got[4] == ("Experience", "despaced") and got[5] == ("Experience", "token")
    assert got[2] == got[6] == got[7] == got[8] == (None, None)


def test_built_in_vocabulary_holds_the_names_of_sections(spark):
    kept = {r["variant"]: r["canon"] for r in vocabulary.vocabulary(spark).collect()}
    assert len(kept) == len(vocabulary.SECTIONS) and kept["contact information"] == "Contact Information"


def test_candidate_headings(spark):
    cols = "doc_id long, t string, font_size double, space_above double, width_ratio double, upper_ratio double, bold_ratio double, word_count int"
    plain = [(1, f"p{i}", 12.0, 10.0, 0.5, 0.1, 0.2, 4) for i in range(5)]
    rows = plain + [(1, "bad", 6.0, 1.0, 0.95, 0.0, 0.0, 9), (1, "bold", 6.0, 1.0, 0.95, 0.0, 0.4, 9), (1, "null", None, 1.0, 0.95, 0.0, 0.0, 9)]
    rows += [(2, "only", 0.0, 0.0, 0.95, 0.0, 0.0, 9)]
    got = {r["t"] for r in headings.candidate_headings(spark.createDataFrame(rows, cols)).collect()}
    assert got == {f"p{i}" for i in range(5)} | {"bold", "null", "only"}


def test_multi_section_headers(spark):
    rows = [(1, "EXPERIENCE SKILLS"), (2, "WORK HISTORY     TECHNICAL SKILLS"), (3, "PROFESSIONAL EXPERIENCE EDUCATION"), (4, "PROJECTS AND ACHIEVEMENTS"), (5, "SUMMARY")]
    found = headings.ngram_sections(spark.createDataFrame(rows, "line_id int, text string"), small_vocabulary(spark))
    got = {}
    for r in found.orderBy("line_id", "pos").collect():
        got.setdefault(r["line_id"], []).append(r["canon"])
    assert got == {1: ["Experience", "Skills"], 2: ["Experience", "Skills"], 3: ["Experience", "Education"], 4: ["Projects", "Achievements"]}


def test_every_line_lands_in_one_section(spark):
    said = "Jane Doe\nSUMMARY\nshort\nEXPERIENCE\nmade\nmore\nSKILLS\n"
    d = lines.text_lines(spark.createDataFrame([(1, said), (2, ""), (3, None)], "doc_id long, text string"))
    seg = sections.segment(headings.match_headings(d, small_vocabulary(spark)))
    assert seg.count() == d.count()
    got = [(r["section"], r["content"]) for r in sections.section_table(seg.where("doc_id = 1")).orderBy("section_id").collect()]
    assert got == [("Contact Information", "Jane Doe"), ("Summary", "short"), ("Experience", "made\nmore"), ("Skills", "")]
    assert sections.segment(headings.match_headings(d, small_vocabulary(spark)), preset="scored").where("section = 'Contact Information'").count() == 0


def state_machine(es):
    """The rules of ``entities.experiences`` as a loop."""
    done, now, dates = [], None, 0
    for word, group, score in es:
        t = " ".join(word.replace("##", "").split()).strip(".,;:!?-_*~` ")
        if len(t) <= 2 and score < 0.6:
            continue
        if group == "COMPANY" and (len(t) > 3 or score > 0.75):
            if now and dates >= 2:
                done.append(now)
                now, dates = None, 0
            if now is None:
                now, dates = {"c": t, "r": None, "d": [], "s": []}, 0
            elif now["c"] is None:
                now["c"] = t
        elif group == "ROLE" and len(t) > 4:
            if now is None:
                now, dates = {"c": None, "r": t, "d": [], "s": []}, 0
            elif now["r"] is None:
                now["r"] = t
            elif dates >= 2:
                done.append(now)
                now, dates = {"c": None, "r": t, "d": [], "s": []}, 0
        elif group == "DATE" and now and len(now["d"]) < 2:
            now["d"].append(t)
            dates += 1
        elif group == "TECH" and now and len(t) > 1:
            now["s"].append(t)
    done += [now] if now else []
    return [x for x in done if (len(x["c"] or "") > 3 or len(x["r"] or "") > 5) and x["d"]]


def test_experience_state_machine_equals_the_loop(spark):
    rng = random.Random(9)
    words = ["Acme Corp", "IBM", "Engineer", "Lead", "2019", "Jan 2020", "Py", "Spark", "##x", "a"]
    rows = [(d, i, rng.choice(words), rng.choice(["COMPANY", "ROLE", "DATE", "TECH"]), rng.random()) for d in range(40) for i in range(rng.randint(1, 25))]
    got = {}
    for r in entities.experiences(spark.createDataFrame(rows, "doc_id long, pos int, word string, entity_group string, score double")).orderBy("doc_id", "exp_no").collect():
        got.setdefault(r["doc_id"], []).append((r["company"], r["role"], [x for x in (r["from_date"], r["to_date"]) if x], r["skills"]))
    want = {d: [(x["c"], x["r"], x["d"], x["s"]) for x in state_machine([r[2:] for r in rows if r[0] == d])] for d in range(40)}
    assert got == {d: x for d, x in want.items() if x}


def test_skills_totals_and_roles(spark):
    s = spark.createDataFrame([(["Java", "java", " the ", "x", "12", "C  sharp", "##ing"],)], "s array<string>")
    assert s.select(entities.clean_skills(F.col("s")).alias("x")).first()["x"] == ["Java", "C sharp"]
    exps = spark.createDataFrame([(1, 0, None, 7), (1, 1, "Dev", 11)], "doc_id long, exp_no int, role string, duration_months int")
    assert entities.primary_role(exps).first()["primary_role"] == "Dev"
    assert [r["total_years"] for r in entities.total_years(exps, spark.createDataFrame([(1, None), (2, 3.0)], "doc_id long, explicit_years double")).orderBy("doc_id").collect()] == [1.5, 3.0]


def asked(spark, values, make):
    return [r["x"] for r in spark.createDataFrame(list(enumerate(values)), "i int, c string").select("i", make(F.col("c")).alias("x")).orderBy("i").collect()]


def test_learning(spark):
    said = ["Senior Developer", "developer of things", "University of X", "Certified in Y", "Skills matrix", "Portfolio", "Poems", "", None]
    got = [tuple(x) if x else None for x in asked(spark, said, learning.learn_from_pattern)]
    assert got == [("Experience", 0.9), ("Experience", 0.75), ("Education", 0.8), ("Certifications", 0.8), ("Skills", 0.75), ("Projects", 0.8), None, None, None]
    vocab = small_vocabulary(spark)
    new = learning.add_variants(vocab, spark.createDataFrame([("Senior Developer",), ("skills",)], "heading string"))
    assert [tuple(r) for r in new.collect()] == [("Experience", "senior developer")]
    assert vocabulary.new_variants(new, new).count() == 0


def test_false_headings(spark):
    said = ["Details", "Details of work", "Google Inc.", "Our solutions", "technologies", "ab", "Top 10", "Principal work"]
    assert asked(spark, said, lambda c: headings.false_heading(c, F.lit(5.0))) == [True, False, True, False, False, True, True, True]
    assert asked(spark, ["Awards won"], lambda c: headings.false_heading(c, F.lit(2.5))) == [True]
    assert asked(spark, ["Awards won"], lambda c: headings.false_heading(c, F.lit(None).cast("double"))) == [False]


def test_unknown_reasons(spark):
    rows = [("work", 1, 1, None), ("Skill", 1, 1, None), ("ab", 9, 90, None), ("May notes", 9, 90, None), ("on 12/3", 9, 90, None), ("Odd", 2, 5, None), ("Odd", 2, 6, None), ("Odd", 3, 5, None), ("Hobby", 9, 90, 0.7), ("Hobby", 9, 90, 0.8)]
    got = sections.unknown_reasons(spark.createDataFrame(rows, "section string, n_lines int, n_words int, s double"), "s").collect()
    assert [r["unknown_reason"] for r in got] == [None, None, "too_short", "date", "date", "few_lines", None, None, "ambiguous", None]


def test_best_person(spark):
    texts = spark.createDataFrame([(1, "Resume of Ann Lee\nJane Doe\nx"), (2, None), (3, "")], "doc_id long, text string")
    people = [(1, 0, "Ann Lee"), (1, 1, "Jane Doe"), (1, 2, "Email"), (2, 0, "Senior Engineer"), (2, 1, "jane roe"), (3, 0, "Single")]
    got = entities.best_person(spark.createDataFrame(people, "doc_id long, pos int, word string"), texts).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["name"], r["points"]) for r in got] == [(1, "Jane Doe", 15.0), (2, "jane roe", 5.0)]


def test_best_similar_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(learning, "VARIANTS", 3)
    rng = random.Random(3)
    vs = [(f"v{i}", [rng.gauss(0, 1) for _ in range(4)]) for i in range(20)]
    qs = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(15)]
    qs += [(15, qs[0][1]), (16, None)]
    got = {r["id"]: r["canon"] for r in learning.best_similar(spark.createDataFrame(qs, "id int, vector array<double>"), spark.createDataFrame(vs, "canon string, vector array<double>"), -1.0).collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    assert got == {i: (min(vs, key=lambda v: (-round(cos(q, v[1]), 9), v[0]))[0] if q else None) for i, q in qs}


def test_reports(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "f string, label int")
    got = report.upsert(old, spark.createDataFrame([("b", 3), ("c", 4)], "f string, label int"), ["f"])
    assert sorted(map(tuple, got.collect())) == [("a", 1), ("b", 3), ("c", 4)]
    r = spark.createDataFrame([("success", 1.0, None), ("empty", 2.0, None), ("error", 3.0, "x")], "status string, seconds double, error string")
    assert tuple(report.batch_summary(r).first()) == (3, 1, 1, 1, 2.0)
    assert report.blank_columns(spark.createDataFrame([(" ", "x")], "a string, b string"), ["a", "b"]).first()["populated"] == ["b"]


def test_layout_rules(spark):
    f = layout.page_features(two_columns(spark)).first()
    assert f["n_words"] == 40
    assert layout.half_columns(two_columns(spark)).first()["n_columns"] == 2


def docx(paragraphs):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f'<w:p><w:r><w:rPr>{"<w:b/>" if b else ""}<w:sz w:val="24"/></w:rPr><w:t>{t}</w:t></w:r></w:p>' for t, b in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_sources(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx([("SKILLS", True), ("", False), ("Spark", False)]))
    (tmp_path / "b.txt").write_text("hello\nworld")
    (tmp_path / "c.docx").write_bytes(b"broken")
    found = readers.list_files(spark, str(tmp_path), content=True)
    assert sorted(r["file_type"] for r in found.collect()) == ["docx", "docx", "text"]
    got = readers.decode(found.where("file_type = 'docx'"), readers.docx_lines, readers.LINE_SCHEMA).orderBy("line_no").collect()
    assert [(r["text"], r["bold_ratio"], r["font_size"]) for r in got] == [("SKILLS", 1.0, 12.0), ("Spark", 0.0, 12.0)]
    named = readers.decode(found, readers.docx_lines, readers.LINE_SCHEMA, lambda p, c: iter([(p, 0, "plain", "", 0.0, 11.0, 0.0)] if p.endswith(".txt") else []), status=True)
    said = sorted((r["path"][-6:], r["text"], r["decode_status"].split(":")[0]) for r in named.collect())
    assert said == [("/b.txt", "plain", "fallback"), ("a.docx", "SKILLS", "ok"), ("a.docx", "Spark", "ok"), ("c.docx", None, "BadZipFile")]
    heads = spark.createDataFrame([(bytearray(b"%PDF-1.7"),), (bytearray(b"PK"),)], "content binary")
    assert [r["x"] for r in heads.select(readers.is_pdf(F.col("content")).alias("x")).collect()] == [True, False]
    assert readers.read_texts(spark, str(tmp_path / "b.txt")).first()["text"] == "hello\nworld"
    (tmp_path / "v.json").write_text('{"sections": {"Skills": {"variants": ["skills", "tools"], "confidence_threshold": 0.7}}}')
    assert [r["variant"] for r in readers.read_vocabulary(spark, str(tmp_path / "v.json")).orderBy("prio").collect()] == ["skills", "tools"]
    (tmp_path / "l.jsonl").write_text('{"canonical": "Skills", "header": "Kit"}\nnot json\n{"section": "Skills", "text": "Craft"}\n')
    assert sorted(r["variant"] for r in readers.read_learned(spark, str(tmp_path / "l.jsonl")).collect()) == ["Craft", "Kit"]
    (tmp_path / "latin.csv").write_bytes("name\nJosé\n".encode("latin-1"))
    assert readers.read_csv(spark, str(tmp_path / "latin.csv")).first()["name"] == "José"
    rows = spark.createDataFrame([(1, 'a "b",\x07c', "x" * 300)], "doc_id long, t string, p string")
    sinks.write_csv(rows, str(tmp_path / "out"), {"p": 200})
    back = readers.read_csv(spark, str(tmp_path / "out")).first()
    assert back["t"] == 'a "b",c' and len(back["p"]) == 200


def test_stream_runs_each_file_once(spark, tmp_path):
    from quire.streaming.ingest import run_batches, stream_documents

    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for part in range(2):
        spark.createDataFrame([(part * 2 + i, "SKILLS\nspark") for i in range(2)], "doc_id long, text string").coalesce(1).write.mode("append").parquet(src)
        run_batches(stream_documents(spark, src), lambda b: lines.text_lines(b), out, check).awaitTermination()
    assert spark.read.parquet(out).count() == 8


def test_gutter_and_overlap_of_all_pairs(spark):
    """Ten lines over the full width, then fifty in two columns; and an empty table."""
    rows = [(1, 0, "w", float(x), x + 8.0, 10.0 * i + 1, 10.0 * i + 9, 400.0, 600.0) for i in range(60) for x in range(0, 390, 5) if i < 10 or not 170 < x < 230]
    page = spark.createDataFrame(rows, WORD)
    found = layout.gutter(page).first()
    assert (round(found["coverage"], 6), round(found["header_fraction"], 6)) == (round(50 / 60, 6), round(10 / 60, 6)) and 174 < found["gutter_x"] < 234
    assert layout.gutter(page.limit(0)).count() == 0
    few = spark.createDataFrame([(1, 0, "a", 0.0, 1.0, 0.0, 10.0, 9.0, 9.0), (1, 0, "b", 0.0, 1.0, 5.0, 25.0, 9.0, 9.0), (1, 0, "c", 0.0, 1.0, 0.0, 10.0, 9.0, 9.0), (2, 0, "d", 0.0, 1.0, 3.0, 3.0, 9.0, 9.0)], WORD)
    assert sorted(tuple(r) for r in layout.mean_overlap(few).collect()) == [(1, 0, 3, (0.5 + 0.5 + 1) / 3), (2, 0, 0, 0.0)]
