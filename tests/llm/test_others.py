import itertools
import os
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import ball_tree, html_text, quality, url_filter
from tests.test_queries import DATA, TABLES

# --- operator 2

PAGE = """<html><head><title>T</title><script>var x = "<p>no</p>";</script></head><body class="page"><header><h1>Site</h1><ul><li><a href=/>Home</a></ul></header>
<div id="cookie-notice"><p>We use cookies. Accept all of them please, they are good for you and us all, very good.</p></div>
<main><article><header><h1>Title &amp; more</h1></header><p>First   para<br>second&nbsp;line &lt;b&gt; it's <em>em</em>ph.<ul><li>item one<li>item two</ul><div class="ad">Buy now</div><p>Last one</article>
<section class="comments"><p>Nice post, I liked that one very much, thank you so much for writing it all up!</p></section></main>
<aside class="sidebar"><p>Related stuff</p></aside><form><label>Mail</label><input></form><footer>(c)</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Title & more\nFirst para second line <b> it's emph.\nitem one\nitem two\nLast one"
    for page in ("", "<", "<p", "<p title='", "<!-- open", "<script>x", "<div></div>", "</p></div>", "&"):
        assert isinstance(html_text.main_text(page), str)
    assert html_text.main_text("<body><nav><a href=x>a</a></nav></body>") == ""
    assert html_text.main_text("<p>one<p>two</p><!-- <p>three</p> -->") == "one\ntwo"
    assert html_text.main_text('<article><p>one <span style="display: none">x</span><span class="ad">y</span><button>z</button>two <b>three</article>') == "one two three"


LONG = "A paragraph that is long enough to be taken for prose of an article, with some more words in it, so that it counts as such."


@pytest.mark.parametrize("page", [
    '<div class="content has-sidebar"><p>{}</p></div>', '<article class="post comments-open"><p>{}</p></article>', '<main class="no-ads"><p>{}</p></main>', '<main id="legal-history"><p>{}</p></main>',
    '<article><div class="related-work"><p>{}</p></div></article>', '<body class="comments sidebar"><p>{}</p></body>', '<form><div class="content"><p>{}</p></div></form>', '<div class="sidebar"><article><p>{}</p></article></div>',
    '<div class="widget"><main><p>{}</p></main></div><div class="ad">Buy</div>', '<article><p>{}</p><section class="comments"><article><p>Nice one, I have read it all and liked it much.</p></article></section></article>',
    '<article><script src=/x/>var a = "<p>b</p>";</script><p>{}</p></article>', '<article><p>{}</p><div class="post-comments"><p>One more that says nothing.</p></div><aside>See this</aside></article>',
    '<article><p>{}</p></article><div class="cookie-notice">We use them</div><div class="relatedPosts"><p>Others</p></div><ol class="comment-list"><li>Well said</ol>',
])
def test_names_of_elements(page):
    """A name that only holds a word for boilerplate, or stands on a wrapper of the article, takes nothing away; whole names do."""
    assert html_text.main_text(page.format(LONG)) == LONG


def test_raw_and_unclosed_elements():
    assert html_text.main_text(f"<div><button>open<p>{LONG}</p></div><p>{LONG}") == f"open\n{LONG}\n{LONG}"
    assert html_text.main_text(f"<article><p>{LONG}<p>a <math><mi>x</mi><mo>=</mo><mn>2</mn></math> b<svg/> c<svg><title>d</title></svg><iframe>e</article>") == f"{LONG}\na x=2 b c e"
    assert html_text.main_text(f"<p>{LONG}</p><script>open <p>x</p>") == LONG


def test_cut_decides():
    """A short block between long ones is boilerplate by its own evidence, and stays by its neighbours; without them it goes."""
    page = f"<div>{LONG}</div><div>* * *</div><div>{LONG}</div>"
    assert html_text.main_text(page) == f"{LONG}\n* * *\n{LONG}" and html_text.main_text("<div>* * *</div>") == ""
    assert [b.evidence > 0 for b, _ in html_text.labelled(page)] == [True, False, True]


@pytest.mark.parametrize("many", [1, 2, 3, 4, 8])
@pytest.mark.parametrize("page", ["<form>{}</form>", '<div class="widget">{}</div>', '<div class="notice">{}</div>', '<nav><a href=x>a</a></nav><h1></h1><form><div class="widget">{}</div></form><footer>(c)</footer>'])
def test_boxes_hold_articles_of_every_length(page, many):
    for text in (LONG, "Short one."):
        assert html_text.main_text(page.format(f"<p>{text}</p>" * many)) == "\n".join([text] * many)


@pytest.mark.parametrize("page, text", [
    ('<p>Short one.</p><div class="notice"><p>We use them.</p></div>', "Short one."), ('<div>Short one.</div><form><p>Your mail</p></form>', "Short one."), ('<div class="ad"><p>Buy now.</p></div>', ""),
    ('<div class="cookie-notice"><p>We use them.</p></div>', ""), ("<p>see <a href=x>this link</a></p>", "see this link"), ("<body><div>short</div></body>", "short"), ("<p><a href=x>Home</a> | <a href=y>About</a></p>", ""),
    (f"<p>{LONG}</p><ul><li>a</li><li>b</li></ul><p>{LONG}</p>", f"{LONG}\na\nb\n{LONG}"), (f'<article><p>{LONG}</p><div class="user-reviews"><p>Nice.</p></div><div class="PrevNext"><a href=x>Before</a></div></article>', LONG),
    (f'<article><p>{LONG}</p><section id="feedback"><p>Well said.</p></section></article>', LONG), (f'<article><p>{LONG}</p><div id="next-steps"><p>{LONG}</p></div></article>', f"{LONG}\n{LONG}"),
])
def test_short_content(page, text):
    assert html_text.main_text(page) == text


def test_items_stay_by_their_neighbours():
    """List items are boilerplate by their own evidence; between paragraphs the cut keeps them, alone it doesn't."""
    page = f"<p>{LONG}</p><ul><li>a</li><li>b</li></ul><p>{LONG}</p>"
    assert [b.evidence > 0 for b, _ in html_text.labelled(page)] == [True, False, False, True]
    assert [keep for _, keep in html_text.labelled(page)] == [True] * 4 and html_text.main_text("<ul><li>a</li><li>b</li></ul>") == ""


def random_page(rng):
    """A page of at most a dozen texts."""

    def part(depth):
        tag = rng.choice("div section ul article p li nav aside h2 table td main".split())
        name = rng.choice(["", "", ' class="related-work"', ' class="ad"', ' class="content"', ' id="comments"', ' class="legal-notes share"'])
        inner = "".join(part(depth + 1) if depth < 3 and rng.random() < 0.5 else rng.choice(["word ", LONG, '<a href="/">link</a> ', "a few words "]) for _ in range(rng.randint(1, 3)))
        return f"<{tag}{name}>{inner}</{tag}>"

    return "".join(part(0) for _ in range(2))


def test_whole_pages_by_brute_force():
    """The text of a page is that of the cheapest labelling, of equal ones the one with the fewest content blocks."""
    rng, changed, tried = random.Random(5), 0, 0
    for _ in range(400):
        page = random_page(rng)
        pairs = html_text.labelled(page)
        if len(pairs) > 10:
            continue
        blocks = [b for b, _ in pairs]
        capacity, links = [round(html_text.SCALE * b.evidence) for b in blocks], html_text.edges(blocks)
        cost = lambda side: sum(abs(e) for e, s in zip(capacity, side) if s != (e > 0)) + sum(c for i, j, c in links if side[i] != side[j])
        best = min(itertools.product((False, True), repeat=len(blocks)), key=lambda side: (cost(side), sum(side)))
        assert html_text.main_text(page) == "\n".join(b.text for b, keep in zip(blocks, best) if keep)
        changed += sum((c > 0) != keep for c, keep in zip(capacity, best))
        tried += len(blocks)
    assert tried > 1000 and changed > 20


def test_long_and_deep_pages():
    assert html_text.main_text("<article>" + "<p>abc def</p><div class=ad>ad</div>" * 3000 + "</article>").count("abc def") == 3000
    assert html_text.main_text("<div>" * 5000 + "<p>a paragraph that is long enough to be a text</p>").startswith("a paragraph")
    for page in ("<div>" * 20_000 + "x" + "</div>" * 20_000, "<div>x" * 20_000, "<b><p>x" * 20_000, "<button>x" * 20_000):
        began = time.process_time()
        html_text.main_text(page)
        assert time.process_time() - began < 2


def test_minimum_cut_by_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(1, 8)
        evidence = [rng.randint(-9, 9) for _ in range(n)]
        links = [(i, j, rng.randint(1, 6)) for i in range(n) for j in range(i) if rng.random() < 0.4]
        cost = lambda side: sum(abs(e) for e, s in zip(evidence, side) if s != (e > 0)) + sum(c for i, j, c in links if side[i] != side[j])
        assert cost(html_text.source_side(evidence, links)) == min(map(cost, itertools.product((False, True), repeat=n)))


def test_extract_text(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (2, None, "", "x"), (3, "u", PAGE, "x"), (3, "u", PAGE, "x"), (None, "v", "<p>é</p>", "x")], "page_id long, url string, html string, text string")
    rows = html_text.extract_text(df).collect()
    assert [(r["page_id"], r["url"], r["n_chars"] == len(r["text"])) for r in rows] == [(1, "u", True), (2, None, True), (3, "u", True), (3, "u", True), (None, "v", True)]
    assert rows[4]["text"] == "é" and rows[0]["text"] == "" and rows[2]["text"].startswith("Title")
    assert html_text.extract_text(df.limit(0)).count() == 0


# --- operator 8


def verdict(url):
    """The rules as a loop."""
    url = url or ""
    host, path = "", ""
    if "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fit = [(r, v) for h, p, r, v in (("net", "/", "net/", "block"), ("example.net", "/en/", "example.net/en/", "allow"), ("example.com", "/de/", "example.com/de/", "block"), ("org", "/fr/", "org/fr/", "allow"))
           if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, key=lambda x: len(x[0]), default=(None, None))
    import re

    spam = any(re.search("(?i)(?:^|[^a-z0-9])" + "[^a-z0-9]".join(r.tokens) + "(?:[^a-z0-9]|$)", host + path) for r in url_filter.WORD_RULES)
    return host, path, best[0], best[1] or ("block" if spam else "allow")


URLS = [None, "", "no scheme", "http://", "https://a.Example.NET/en/1", "https://example.net/en", "https://example.net/EN/", "http://net", "http://net/", "http://x.net?q", "http://internet/", "http://a.org/fr/x#y", "http://example.com/de/", "http://xexample.com/de/",
        "http://spam-farm.example.org/fr/", "http://spam-farm.example.org/de/", "http://www.cheap-pills.example.com/a", "http://cheappills.com/", "ftp://a://b/c", "http://h/a b\nc", "http://x/CASINO/online-casino", "http://x.org/" + "a" * 100_000, "http://café.net/en/"]


@pytest.mark.parametrize("inline", [2000, 1])
def test_judge_urls(spark, inline):
    df = spark.createDataFrame([(i, u, "old", "r") for i, u in enumerate(URLS + URLS[4:6])], "page_id long, url string, host string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(df, [*url_filter.HOST_RULES, *url_filter.WORD_RULES], max_inline=inline).collect()}
    assert got == {i: verdict(u) for i, u in enumerate(URLS + URLS[4:6])}
    assert url_filter.judge_urls(df.limit(0), list(url_filter.HOST_RULES), max_inline=inline).count() == 0


def test_rules_lie_under_their_rarest_token():
    index = url_filter.index_by_rarest([url_filter.word_rule("a", "b"), url_filter.word_rule("b", "c")], {"a": 5, "b": 2, "c": 2})
    assert {k: len(v) for k, v in index.items()} == {"b": 2}
    with pytest.raises(ValueError):
        url_filter.index_by_rarest([url_filter.Rule("x", "block", ())], {})


# --- operator 7


def brute_top(rows, k=20):
    out = []
    for q, v in {(i, v) for i, v in rows if i % 20 == 0}:
        best = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q))[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("shard, block, span", [(8192, 16384, 9), (40, 3, 2), (40, 3, 1 << 29)])
def test_top_k(spark, shard, block, span):
    rng = random.Random(span)
    rows = [(i, tuple(rng.randint(-span, span) for _ in range(5))) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, v array<long>")
    assert sorted(tuple(r) for r in ball_tree.top_k(df, shard=shard, block=block).collect()) == brute_top(rows)


def test_top_k_ties_beyond_doubles(spark):
    """Scores of over 2^53 that many rows share: the k-th score, as a double, may be greater than itself."""
    rng = random.Random(4)
    kinds = [tuple(rng.randint(-(1 << 29), 1 << 29) for _ in range(5)) for _ in range(12)]
    rows = [(i, rng.choice(kinds)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, v array<long>")
    assert sorted(tuple(r) for r in ball_tree.top_k(df, shard=40, block=3).collect()) == brute_top(rows)


def test_top_k_small_and_odd_tables(spark):
    raw = [(0, [0.5, float("nan")], 1), (1, None, 1), (2, [1.0, None], 1), (20, [0.51, -0.01], 1), (21, [1.0, 0.0], 1), (None, [1.0, 1.0], 1), (22, [float("inf"), 0.0], 1), (23, [1.0, 0.0], 1)]
    v = ball_tree.integer_vectors(spark.createDataFrame(raw, "vec_id long, embedding array<float>, label int"))
    assert sorted(r["id"] for r in v.collect()) == [20, 21, 23]
    assert [tuple(r) for r in ball_tree.top_k(v).orderBy("rank").collect()] == [(20, 1, 21, 2048), (20, 2, 23, 2048)]
    assert ball_tree.top_k(v.limit(0)).count() == 0
    assert ball_tree.top_k(v.where("id = 20")).count() == 0


# --- operator 5


def test_features_of_odd_texts():
    assert all(np.isfinite(quality.features(t)).all() and len(quality.features(t)) == len(quality.NAMES) for t in ("", " ", "x" * 3_000_000, "\ud800", "é" * 10, "!!! " * 1000))


def test_bradley_terry_learns_and_falls_back():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, len(quality.NAMES)))
    good = x[:, 0] - x[:, 3] > -1
    model = quality.bradley_terry(x, good)
    strength = x @ np.array(model.weights)
    assert ((strength > model.threshold) == good).mean() > 0.97
    for labels, sign in ((np.ones(3, bool), 1), (np.zeros(3, bool), -1), (np.zeros(0, bool), 0)):
        flat = quality.bradley_terry(x[: len(labels)], labels)
        assert np.sign(flat.slope * (0 - flat.threshold)) == sign


def test_all_pairs_of_all_rows_count(spark):
    """Held against the plain loss over all pairs, and rows in Spark against the same rows in arrays."""
    rng = np.random.default_rng(3)
    x = np.abs(rng.normal(size=(400, len(quality.NAMES))))
    good = x[:, 0] + 0.5 * x[:, 2] - x[:, 3] + 0.5 * rng.normal(size=400) > 0.1
    model = quality.bradley_terry(x, good)
    scale = x.std(axis=0) + 1e-6
    d = ((x[good][:, None] - x[~good][None]) / scale).reshape(-1, x.shape[1])
    w = np.array(model.weights) * scale
    slope = d.T @ (1 / (1 + np.exp(-(d @ w))) - 1) / len(d) + quality.RIDGE * w
    assert np.abs(slope).max() < 1e-3 and np.abs(w).max() > 0.1
    ordered = np.sort(x @ np.array(model.weights))
    assert abs(model.threshold - ordered[(~good).sum() - 1 : (~good).sum() + 1].mean()) < 1e-9
    ids = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5][:400]
    held = spark.createDataFrame([(i, r.tolist()) for i, r in zip(ids, x)], "doc_id long, x array<double>")
    assert quality.learn(held.repartition(7), spark.createDataFrame([(i, int(g)) for i, g in zip(ids, good)], "doc_id long, quality int")) == model


@pytest.mark.parametrize("few", [1, 4096])
def test_ranks_are_exact(spark, monkeypatch, few):
    monkeypatch.setattr(quality, "FEW", few)
    monkeypatch.setattr(quality, "BINS", 4)
    values = [0.1, 0.1, 0.1, -7.5, 1e9, 3.0, 3.0 + 1e-15, 2.0]
    df = spark.createDataFrame([(v,) for v in values], "s double")
    assert [quality.ranked(df, k) for k in range(len(values))] == sorted(values)


def test_quality_of_documents(spark, documents, awkward):
    rng = random.Random(1)
    words = ["the", "of", "lamp", "river", "house,", "green."]
    good = [(i, " ".join(rng.choice(words) for _ in range(60))) for i in range(0, 300)]
    bad = [(i, " ".join(rng.choice(words).upper() + "!!" for _ in range(60))) for i in range(300, 400)]
    df = documents([*good, *bad]).unionByName(awkward.where("doc_id is null or doc_id in (1, 2, 3)").withColumn("doc_id", F.col("doc_id") + 1000))
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(400)] + [(None, 1, 0), (5, None, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.score_documents(df, labels).collect()
    assert len(rows) == df.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    own = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 400 and r["held_out"]]
    assert len(own) > 40 and sum(r["predicted"] == int(r["doc_id"] < 300) for r in own) >= 0.98 * len(own)
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns
    assert quality.score_documents(df.limit(0), labels).count() == 0
    assert quality.score_documents(df, labels.limit(0)).where("predicted = 0").count() == 0


def test_labels_of_held_out_rows_are_not_learned_from(spark, documents):
    df = documents([(i, "plain words here" if i % 2 else "LOUD!! LOUD!!") for i in range(200)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    turned = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    score = lambda l: {r["doc_id"]: r["score"] for r in quality.score_documents(df, l).collect()}
    assert score(labels) == score(turned)


# --- the registered queries


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["op6_exact_dedup", "op7_topk_search", "op8_url_filter"])
def test_against_sql(spark, name):
    import duckdb

    from quire.llm import registry

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    df = registry.queries()[name](spark, DATA)
    want = con.sql(registry.oracle_sql()[name])
    at = [want.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_held_out_accuracy(spark):
    from quire.llm import registry

    folder = DATA.replace("sf0.001", "sf0.01")
    rows = registry.queries()["op5_quality"](spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.95 * len(rows)


def test_quality_repeated_id_takes_no_places(spark, documents):
    good = [(i, "the lamp and the river walk of stone. " * (i % 5 + 1)) for i in range(101, 140)]
    bad = [(i, "BUY!! NOW!! $$$ 111 " * (i % 5 + 1)) for i in range(201, 240)]
    hot = next(i for i in range(1, 50) if zlib.crc32(str(i).encode()) % 5)
    labels = spark.createDataFrame([(i, int(i < 200)) for i, _ in good + bad + [(hot, "")]], "doc_id long, quality int")
    once = good + bad + [(hot, good[0][1])]
    learned = [quality.learn(quality.featured(documents(rows)), labels, 100) for rows in (once, once + [(hot, good[0][1])] * 400)]
    assert learned[0] == learned[1] and any(learned[0].weights)


def test_features_do_not_depend_on_stretches():
    for text in ("alpha beta gamma " * 3000, "one\ntwo!!! two three  " * 500 + "x" * 5000 + " end", "nowhitespace" * 900, ""):
        whole = quality.features(text)
        assert all(np.allclose(quality.features(text, stretch), whole, rtol=1e-12) for stretch in (1, 7, 100, 4096))


def test_keep_good_goes_row_by_row(spark):
    """Rows that share an id are judged each by its text, rows without an id too."""
    rng = np.random.default_rng(4)
    good = lambda: " ".join(rng.choice(["the", "river", "walks", "along.", "stone", "house,"], 30))
    bad = lambda: "!!! ".join(rng.choice(["BUY", "NOW", "CHEAP"], 30))
    known = [(i, good() if i < 60 else bad()) for i in range(120)]
    more = [(1, bad()), (100, good()), (None, good()), (None, bad()), (300, known[0][1]), (300, known[0][1])]
    df = spark.createDataFrame([(i, t, 0.5) for i, t in known + more], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(2, 119) if i != 100], "doc_id long, quality int")
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted(rows, key=str) == sorted([(i, t) for i, t in known + more if "!!!" not in t], key=str)
