"""Queries over word geometry, which is derived from ``events`` by plain arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import blocks, columns, headings, layout, lines, page_vectors, regions, splits
from quire.session import table

Q, SQL = {}, {}
KEYS = ["doc_id", "page"]

WORDS_SQL = """words as (
  select user_id as doc_id, cast(event_id % 4 as integer) as page, event_type || '-' || event_id as text, cast(event_id * 37 % 560 as double) as x0, cast(event_id * 37 % 560 + 10 + event_id % 40 as double) as x1,
    cast(event_id * 53 % 700 as double) as top, cast(event_id * 53 % 700 + 10 + event_id % 3 as double) as bottom, 612.0::double as page_width, 792.0::double as page_height,
    cast(8 + event_id % 5 as double) as font_size, event_id % 7 = 0 as is_bold, event_type as font from events)"""
LINES_SQL = """numbered as (
  select *, case when top > max(bottom) over w + 0.5 or max(bottom) over w is null then 1 else 0 end as new from words window w as (partition by doc_id, page order by top, x0, x1, text rows between unbounded preceding and 1 preceding)),
lined as (select *, cast(sum(new) over (partition by doc_id, page order by top, x0, x1, text rows unbounded preceding) - 1 as integer) as line_no from numbered),
ls as (select doc_id, page, line_no, string_agg(text, ' ' order by x0, text) as text, min(x0) as x0, min(top) as top, max(x1) as x1, max(bottom) as bottom, avg(bottom - top) as height, count(*) as word_count,
  cast(length(string_agg(text, ' ' order by x0, text)) as integer) as char_count, avg(font_size) as avg_font_size, avg(case when is_bold then 1.0 else 0.0 end) as bold_ratio from lined group by doc_id, page, line_no)"""
BINS_SQL = """hist as (select doc_id, page, cast(floor((x0 + x1) / 2 / 5) as integer) as bin, count(*) as n from words group by all),
dense as (select s.doc_id, s.page, cast(s.bin as integer) as bin, coalesce(h.n, 0) as n from (select doc_id, page, unnest(range(min(bin), max(bin) + 1)) as bin from hist group by doc_id, page) s left join hist h using (doc_id, page, bin))"""
SMOOTH_SQL = "smooth as (select *, sum(n) over (partition by doc_id, page order by bin rows between {b} preceding and {a} following) / {k}.0 as smooth from dense)"
PEAKS_SQL = """marked as (select *, lag(smooth) over o as b, lead(smooth) over o as a, avg(smooth) over (partition by doc_id, page) as m from smooth window o as (partition by doc_id, page order by bin)),
peaks as (select doc_id, page, bin, smooth from marked where b < smooth and a < smooth and smooth > 0.5 * m)"""
COLUMNS_SQL = "cols(column_id, x_start, x_end) as (values (0, 0.0::double, 200.0::double), (1, 200.0::double, 400.0::double), (2, 410.0::double, 620.0::double))"


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def words(spark, sf):
    e = F.col("event_id")
    x0, top = e * 37 % 560, e * 53 % 700
    return table(spark, sf, "events").select(
        F.col("user_id").alias("doc_id"), (e % 4).cast("int").alias("page"), F.concat_ws("-", "event_type", e.cast("string")).alias("text"), x0.cast("double").alias("x0"), (x0 + 10 + e % 40).cast("double").alias("x1"),
        top.cast("double").alias("top"), (top + 10 + e % 3).cast("double").alias("bottom"), F.lit(612.0).alias("page_width"), F.lit(792.0).alias("page_height"),
        (8 + e % 5).cast("double").alias("font_size"), (e % 7 == 0).alias("is_bold"), F.col("event_type").alias("font"),
    )


def page_lines(spark, sf):
    return lines.lines_of_words(lines.interval_lines(words(spark, sf)))


def page_columns(spark, sf):
    c = [(0, 0.0, 200.0), (1, 200.0, 400.0), (2, 410.0, 620.0)]
    struct = F.array(*[F.struct(F.lit(i).alias("column_id"), F.lit(a).alias("x_start"), F.lit(b).alias("x_end")) for i, a, b in c])
    return words(spark, sf).select(*KEYS).distinct().select(*KEYS, F.explode(struct).alias("c")).select(*KEYS, "c.*")


def smooth(spark, sf, before=2, after=1):
    return columns.moving_average(columns.dense_bins(columns.center_histogram(words(spark, sf))), before, after)


@query(f"with {WORDS_SQL}, {BINS_SQL} select doc_id, page, bin, n from hist")
def hist_bins(spark, sf):
    return columns.center_histogram(words(spark, sf))


@query(f"with {WORDS_SQL} select doc_id, page, cast(least(floor(x0 / (page_width / 20)), 19) as integer) as bin, count(*) as n from words where x0 between 0 and page_width group by all")
def hist_equal_width(spark, sf):
    return columns.equal_width_histogram(words(spark, sf), "x0", F.col("page_width"), 20)


@query(f"""with {WORDS_SQL}, p as (select doc_id, page, unnest(range(cast(x0 as integer), cast(x1 as integer) + 1)) as x from words)
select doc_id, page, cast(x as integer) as x, count(*) as n from p group by all""")
def hist_coverage(spark, sf):
    stretches = columns.coverage_histogram(words(spark, sf)).where("n > 0")
    return stretches.select(*KEYS, F.explode(F.sequence(F.col("x"), F.col("x_next") - 1)).alias("x"), "n")


@query(f"with {WORDS_SQL}, {BINS_SQL}, {SMOOTH_SQL.format(b=2, a=1, k=4)} select doc_id, page, bin, n, round(smooth, 6)::double as smooth from smooth")
def moving_avg_asym(spark, sf):
    return smooth(spark, sf).select(*KEYS, "bin", "n", F.round("smooth", 6).alias("smooth"))


@query(f"with {WORDS_SQL}, {BINS_SQL}, {SMOOTH_SQL.format(b=2, a=2, k=5)}, {PEAKS_SQL} select doc_id, page, bin, round(smooth, 6)::double as smooth from peaks")
def peaks(spark, sf):
    return columns.peaks(smooth(spark, sf, 2, 2)).select(*KEYS, "bin", F.round("smooth", 6).alias("smooth"))


@query(f"""with {WORDS_SQL}, {BINS_SQL}, {SMOOTH_SQL.format(b=2, a=2, k=5)}, {PEAKS_SQL},
pairs as (select doc_id, page, bin as l, lead(bin) over o as r, smooth as lv, lead(smooth) over o as rv from peaks window o as (partition by doc_id, page order by bin)),
low as (select p.doc_id, p.page, l, r, lv, rv, min(s.smooth) as v, arg_min(s.bin, s.smooth * 1000000 + s.bin) as bin from pairs p join smooth s on s.doc_id = p.doc_id and s.page = p.page and s.bin > l and s.bin < r where r is not null group by all)
select doc_id, page, l as "left", r as "right", bin, round(1 - v / least(lv, rv), 6)::double as depth_ratio from low""")
def valleys_between_peaks(spark, sf):
    s = smooth(spark, sf, 2, 2)
    return columns.valleys(s, columns.peaks(s)).withColumn("depth_ratio", F.round("depth_ratio", 6))


@query(f"""with {WORDS_SQL}, {BINS_SQL}, f as (select *, n = 0 as flag from dense),
g as (select *, row_number() over (partition by doc_id, page order by bin) - row_number() over (partition by doc_id, page, flag order by bin) as g from f)
select doc_id, page, flag, min(bin) as start, count(*) as length from g group by doc_id, page, flag, g""")
def rle_runs(spark, sf):
    return columns.runs(columns.dense_bins(columns.center_histogram(words(spark, sf))), F.col("n") == 0)


@query(f"""with {WORDS_SQL}, v as (select doc_id, page, list_sort(list(x1 - x0)) as v from words group by all)
select doc_id, page, v[least(cast(floor(len(v) * 0.5) as integer), len(v) - 1) + 1] as p50, v[least(cast(floor(len(v) * 0.75) as integer), len(v) - 1) + 1] as p75, v[least(cast(floor(len(v) * 0.9) as integer), len(v) - 1) + 1] as p90 from v""")
def index_percentiles(spark, sf):
    v = words(spark, sf).groupBy(*KEYS).agg(F.collect_list(F.col("x1") - F.col("x0")).alias("v"))
    return v.select(*KEYS, *[columns.index_percentile(F.col("v"), p).alias(f"p{int(p * 100)}") for p in (0.5, 0.75, 0.9)])


@query(f"""with {WORDS_SQL}, g as (select *, case when top - lag(top) over (partition by doc_id, page order by top, text) > 15 then 1 else 0 end as new from words),
n as (select *, cast(sum(new) over (partition by doc_id, page order by top, text rows unbounded preceding) as integer) as group_no from g)
select doc_id, page, group_no, count(*) as n, min(top) as lo, max(top) as hi from n group by all""")
def chain_clusters(spark, sf):
    g = lines.chain_groups(words(spark, sf), KEYS, "top", 15.0, ["text"])
    return g.groupBy(*KEYS, "group_no").agg(F.count("*").alias("n"), F.min("top").alias("lo"), F.max("top").alias("hi"))


@query(f"with {WORDS_SQL}, {LINES_SQL} select doc_id, page, line_no, text, x0, top, x1, bottom, round(height, 6) as height, word_count, char_count, round(avg_font_size, 6) as avg_font_size, round(bold_ratio, 6)::double as bold_ratio from ls")
def interval_merge_lines(spark, sf):
    f = page_lines(spark, sf)
    return f.select(*KEYS, "line_no", "text", "x0", "top", "x1", "bottom", F.round("height", 6).alias("height"), "word_count", "char_count", F.round("avg_font_size", 6).alias("avg_font_size"), F.round("bold_ratio", 6).alias("bold_ratio"))


@query(f"""with recursive {WORDS_SQL}, o as (select *, row_number() over (partition by doc_id, page order by top, x0, text) as i from words),
walk as (select doc_id, page, i, text, top as anchor, 0 as line_no from o where i = 1 union all
  select o.doc_id, o.page, o.i, o.text, case when abs(o.top - w.anchor) <= 5 then w.anchor else o.top end, case when abs(o.top - w.anchor) <= 5 then w.line_no else w.line_no + 1 end from walk w join o on o.doc_id = w.doc_id and o.page = w.page and o.i = w.i + 1)
select doc_id, page, text, cast(line_no as integer) as line_no from walk""")
def anchor_lines(spark, sf):
    return lines.anchor_lines(words(spark, sf), 5.0).select(*KEYS, "text", "line_no")


@query(f"""with {WORDS_SQL}, {LINES_SQL} select doc_id, page, line_no, greatest(coalesce(top - lag(bottom) over o, 0), 0)::double as space_above, greatest(coalesce(lead(top) over o - bottom, 0), 0)::double as space_below
from ls window o as (partition by doc_id, page order by line_no)""")
def line_spacing_lag_lead(spark, sf):
    return lines.line_spacing(page_lines(spark, sf)).select(*KEYS, "line_no", "space_above", "space_below")


@query(f"""with {WORDS_SQL}, {COLUMNS_SQL} select doc_id, page, text, (select min(column_id) from cols where (x0 + x1) / 2 between x_start and x_end) as column_id from words""")
def column_interval_join(spark, sf):
    return columns.assign_by_center(words(spark, sf), page_columns(spark, sf)).select(*KEYS, "text", "column_id")


@query(f"""with {WORDS_SQL}, {COLUMNS_SQL},
first as (select w.text, min(column_id) as c from words w, cols where greatest(least(x1, x_end) - greatest(x0, x_start), 0) / greatest(x1 - x0, 1e-9) >= 0.5 group by 1),
near as (select w.text, arg_min(column_id, abs((x0 + x1) / 2 - (x_start + x_end) / 2) * 10 + column_id) as c from words w, cols group by 1)
select doc_id, page, w.text, coalesce(f.c, n.c) as column_id from words w left join first f using (text) join near n using (text)""")
def nearest_column(spark, sf):
    return columns.assign_by_overlap(words(spark, sf), page_columns(spark, sf)).select(*KEYS, "text", "column_id")


@query(f"""with {WORDS_SQL}, w as (select *, cast(floor(x0 / 80) as integer) as column_id from words),
s as (select doc_id, page, column_id, count(*) as n, avg((x0 + x1) / 2) as c from w group by all)
select w.doc_id, w.page, w.text, case when o.n >= 3 then w.column_id else coalesce((select arg_min(b.column_id, row(abs(b.c - o.c), b.column_id)) from s b where b.doc_id = w.doc_id and b.page = w.page and b.n >= 3), w.column_id) end as column_id
from w join s o on o.doc_id = w.doc_id and o.page = w.page and o.column_id = w.column_id""")
def small_columns_merged(spark, sf):
    w = words(spark, sf).withColumn("column_id", F.floor(F.col("x0") / 80).cast("int"))
    return columns.merge_small_columns(w, 3).select(*KEYS, "text", "column_id")


@query(f"""with {WORDS_SQL}, sp as (select doc_id, page, x0 + 5 as s0, x1 + 25 as s1, top - 1 as st, bottom + 1 as sb, text as attributes from words),
j as (select w.doc_id, w.page, w.text, sp.attributes, row_number() over (partition by w.text order by least(w.x1, s1) - greatest(w.x0, s0) desc, s0, sp.attributes desc) as r from words w join sp on w.doc_id = sp.doc_id and w.page = sp.page
  and st <= w.top + 1.5 and sb >= w.bottom - 1.5 and least(w.x1, s1) - greatest(w.x0, s0) > 0)
select w.doc_id, w.page, w.text, j.attributes from words w left join j on j.text = w.text and j.r = 1""")
def argmax_overlap(spark, sf):
    w = words(spark, sf)
    spans = w.select(*KEYS, (F.col("x0") + 5).alias("x0"), (F.col("x1") + 25).alias("x1"), (F.col("top") - 1).alias("top"), (F.col("bottom") + 1).alias("bottom"), F.col("text").alias("attributes"))
    return columns.best_overlap(w, spans).select(*KEYS, "text", "attributes")


REGIONS_SQL = """regioned as (select *, case when top - max(bottom) over (partition by doc_id, page order by top, bottom rows between unbounded preceding and 1 preceding) >= 30 then 1 else 0 end as new from ls),
rn as (select *, cast(sum(new) over (partition by doc_id, page order by top, bottom rows unbounded preceding) as integer) as region_no from regioned),
regions as (select doc_id, page, region_no, min(top) as y_start, max(bottom) as y_end, count(*) as n_lines from rn group by doc_id, page, region_no)"""


@query(f"with {WORDS_SQL}, {LINES_SQL}, {REGIONS_SQL} select * from regions")
def whitespace_regions(spark, sf):
    return columns.whitespace_regions(page_lines(spark, sf))


@query(f"""with {WORDS_SQL}, {LINES_SQL}, {REGIONS_SQL}, k as (select *, row_number() over (partition by doc_id, page order by n_lines desc, region_no) as r from regions)
select doc_id, page, region_no, n_lines from k where r <= 2""")
def largest_regions(spark, sf):
    found = columns.whitespace_regions(page_lines(spark, sf))
    return columns.largest(found, F.col("n_lines"), 2, "region_no").select(*KEYS, "region_no", "n_lines")


@query(f"""with {WORDS_SQL}, {LINES_SQL}, {REGIONS_SQL} select w.doc_id, w.page, region_no, count(*) as n from words w join regions r on r.doc_id = w.doc_id and r.page = w.page
and (w.top between y_start and y_end or w.bottom between y_start and y_end) group by all""")
def region_assignment(spark, sf):
    regions = columns.whitespace_regions(page_lines(spark, sf))
    return columns.assign_regions(words(spark, sf), regions).groupBy(*KEYS, "region_no").agg(F.count("*").alias("n"))


@query(f"""with {WORDS_SQL}, {LINES_SQL} select a.doc_id, a.page, count(*) as n_pairs, round(avg(greatest(least(a.bottom, b.bottom) - greatest(a.top, b.top), 0) / greatest(least(a.bottom - a.top, b.bottom - b.top), 1e-9)), 6)::double as mean_overlap
from ls a join ls b on a.doc_id = b.doc_id and a.page = b.page and b.line_no - a.line_no between 1 and 19 group by all""")
def pairwise_overlap_mean(spark, sf):
    return layout.pairwise_overlap(page_lines(spark, sf)).withColumn("mean_overlap", F.round("mean_overlap", 6))


@query(f"""with {WORDS_SQL}, s as (select doc_id, page, avg(case when (x0 + x1) / 2 < 306 then (x0 + x1) / 2 end) as ml, avg(case when (x0 + x1) / 2 >= 306 then (x0 + x1) / 2 end) as mr,
 stddev_pop(case when (x0 + x1) / 2 < 306 then (x0 + x1) / 2 end) as sl, stddev_pop(case when (x0 + x1) / 2 >= 306 then (x0 + x1) / 2 end) as sr from words group by all)
select doc_id, page, round(coalesce(abs(mr - ml) / 612 / greatest((sl + sr) / 612, 0.01), 0), 6) as bimodality from s""")
def bimodality(spark, sf):
    return layout.bimodality(words(spark, sf)).withColumn("bimodality", F.round("bimodality", 6))


@query(f"""with {WORDS_SQL} select doc_id, page, count(*) as n_words, round_even(avg((x1 - x0) / page_width), 4) as avg_word_width_ratio, round_even(avg(bottom - top), 4) as avg_height, round_even(stddev_pop(bottom - top), 4) as height_std,
 round_even(avg(case when top < 0.15 * page_height then 1.0 else 0.0 end)::double, 4) as share_at_top, round_even(var_pop(top / page_height), 4) as top_variance from words group by all""")
def page_features(spark, sf):
    return layout.page_features(words(spark, sf))


@query(f"""with {WORDS_SQL}, b as (select doc_id, page, unnest(range(greatest(cast(floor(top / (page_height / 60)) as integer), 0), least(cast(floor(bottom / (page_height / 60)) as integer), 59) + 1)) as band from words)
select doc_id, page, cast(band as integer) as band, count(*) as n from b group by all""")
def band_density(spark, sf):
    return layout.band_density(words(spark, sf))


@query(f"""with {WORDS_SQL}, {LINES_SQL}, k as (select *, (x1 - x0) >= 459 as f, x0 < 183.6 as l, x0 > 122.4 as r from ls),
c as (select doc_id, page, count(*) filter (not f and l) as n_left, count(*) filter (not f and not l and r) as n_right, count(*) filter (f) as n_full from k group by all)
select *, case when n_left >= 3 and n_right >= 3 then 2 else 1 end as n_columns from c""")
def side_lines(spark, sf):
    return layout.side_lines(page_lines(spark, sf).withColumn("page_width", F.lit(612.0)))


@query(f"""with {WORDS_SQL}, c as (select doc_id, page, count(*) as n, count(*) filter ((x0 + x1) / 2 < 306) as n_left from words group by all)
select *, case when n_left / n > 0.3 and 1 - n_left / n > 0.3 then 2 else 1 end as n_columns from c""")
def half_columns(spark, sf):
    return layout.half_columns(words(spark, sf))


@query(f"""with recursive {WORDS_SQL}, o as (select doc_id, page, x0, row_number() over (partition by doc_id, page order by x0, text) as i from words),
walk as (select doc_id, page, i, x0 as last, 1 as kept from o where i = 1 union all
 select o.doc_id, o.page, o.i, case when o.x0 - w.last >= 80 then o.x0 else w.last end, case when o.x0 - w.last >= 80 then w.kept + 1 else w.kept end from walk w join o on o.doc_id = w.doc_id and o.page = w.page and o.i = w.i + 1)
select doc_id, page, cast(max(kept) as integer) as n_kept, max(last) as last from walk group by all""")
def separators_merged(spark, sf):
    kept = words(spark, sf).groupBy(*KEYS).agg(columns.merge_close(F.array_sort(F.collect_list("x0")), 80.0).alias("k"))
    return kept.select(*KEYS, F.size("k").alias("n_kept"), F.array_max("k").alias("last"))


GAPS_SQL = f"""{WORDS_SQL},
spaces as (select doc_id, page, x1, lead(x0) over (partition by doc_id, page order by x0, x1) - x1 as gap from words),
gs as (select doc_id, page, list(gap order by gap) filter (where gap > 0) as g, max(gap) as widest from spaces group by all),
ps as (select *, g[cast(floor(len(g) * 0.5::double) as integer) + 1] as p50, g[cast(floor(len(g) * 0.6::double) as integer) + 1] as p60, g[cast(floor(len(g) * 0.75::double) as integer) + 1] as p75, g[cast(floor(len(g) * 0.9::double) as integer) + 1] as p90 from gs),
ts as (select *, case when widest > p50 * 3 then greatest(12.0, p60) when widest < p50 * 2 then greatest(30.0, p90) else greatest(20.0, p75) end as threshold from ps where len(g) > 0),
us as (select *, widest < threshold and widest > 10 as loosened from ts),
seps as (select s.doc_id, s.page, x1 + gap / 2 as sep, row_number() over (partition by s.doc_id, s.page order by x1 + gap / 2) as i from spaces s join us on us.doc_id = s.doc_id and us.page = s.page where gap >= case when loosened then greatest(10.0, p60) else threshold end),
kept as (select doc_id, page, i, sep as last, true as keep from seps where i = 1 union all
  select s.doc_id, s.page, s.i, case when s.sep - k.last >= 80 then s.sep else k.last end, s.sep - k.last >= 80 from kept k join seps s on s.doc_id = k.doc_id and s.page = k.page and s.i = k.i + 1),
edges as (select doc_id, page, 0.0::double as x from (select distinct doc_id, page from words) union all
  select doc_id, page, last from kept where keep and last >= 80 qualify not (612 - last < 80 and row_number() over (partition by doc_id, page order by i desc) = 1))"""


@query(f"""with recursive {GAPS_SQL} select w.doc_id, w.page, round(threshold, 6)::double as threshold, coalesce(loosened, false) as loosened, cast(count(k.i) as integer) as n_separators
from (select distinct doc_id, page from words) w left join us using (doc_id, page) left join kept k on k.doc_id = w.doc_id and k.page = w.page and k.keep group by all""")
def gap_separators(spark, sf):
    found = splits.gap_columns(words(spark, sf))
    return found.select(*KEYS, F.round("threshold", 6).alias("threshold"), "loosened", F.size("separators").alias("n_separators"))


@query(f"with recursive {GAPS_SQL} select doc_id, page, cast(row_number() over o - 1 as integer) as column_id, x as x_start, coalesce(lead(x) over o, 612) as x_end from edges window o as (partition by doc_id, page order by x)")
def gap_columns(spark, sf):
    found = splits.gap_columns(words(spark, sf))
    return found.select(*KEYS, F.posexplode("columns").alias("column_id", "c")).select(*KEYS, "column_id", "c.x_start", "c.x_end")


#: A header for each page: its text, place and the names it holds.
HEADERS_SQL = """heads(k, text, x0, x1, names) as (values (0, 'WORK EXPERIENCE        SKILLS', 50.0::double, 560.0::double, ['Skills', 'Experience and Work']), (1, 'EDUCATION   PROJECTS   AWARDS', 40.0, 580.0, ['education', 'projects', 'awards']),
  (2, 'SUMMARY', 50.0, 200.0, ['summary']), (3, 'LANGUAGES | HOBBIES', 300.0, 310.0, ['languages', 'references', 'hobbies'])),
placed as (select k, name, text, x0, x1, i, case when instr(lower(text), lower(name)) > 0 then instr(lower(text), lower(name)) else list_filter(list_transform(list_filter(string_split(lower(name), ' '), lambda w: length(w) > 3), lambda w: instr(lower(text), w)), lambda p: p > 0)[1] end as p
  from (select *, unnest(names) as name, unnest(range(len(names))) as i from heads)),
xs as (select k, name, i, x0 + (p - 1) / length(text) * (x1 - x0) as x from placed where p is not null),
parts as (select k, name, row_number() over o - 1 as part, coalesce((x + lag(x) over o) / 2, 0) as lo, coalesce((x + lead(x) over o) / 2, 612) as hi, count(*) over (partition by k) as n from xs window o as (partition by k order by x, i))"""


@query(f"""with {WORDS_SQL}, {HEADERS_SQL},
dealt as (select w.*, part, name, count(part) over (partition by doc_id, page, part) as m from words w join parts p on p.k = w.page and p.n >= 2 and (w.x0 + w.x1) / 2 between lo and hi),
good as (select *, dense_rank() over (partition by doc_id, page order by part) - 1 as c from dealt where m >= 5),
every as (select doc_id, page, text, c as column_id, name as section_hint from good union all select doc_id, page, text, 0, null from words w where not exists (select 1 from good g where g.doc_id = w.doc_id and g.page = w.page))
select doc_id, page, text, cast(column_id as integer) as column_id, section_hint from every""")
def header_columns(spark, sf):
    """Words of pages split at headers; a page's header goes by its number."""
    heads = [(0, "WORK EXPERIENCE        SKILLS", 50.0, 560.0, ["Skills", "Experience and Work"]), (1, "EDUCATION   PROJECTS   AWARDS", 40.0, 580.0, ["education", "projects", "awards"]), (2, "SUMMARY", 50.0, 200.0, ["summary"]), (3, "LANGUAGES | HOBBIES", 300.0, 310.0, ["languages", "references", "hobbies"])]
    w = words(spark, sf)
    given = spark.createDataFrame(heads, "page int, text string, x0 double, x1 double, names array<string>")
    headers = w.select(*KEYS).distinct().join(given, "page")
    return splits.split_at_headers(w, headers).select(*KEYS, "text", "column_id", "section_hint")


@query()
def first_fit_lines(spark, sf):
    fitted = lines.first_fit_lines(words(spark, sf).select(*KEYS, "text", "x0", "top", "bottom"))
    return fitted.groupBy(*KEYS, "line_no").agg(F.count("*").alias("n"))


@query(f"""with recursive {GAPS_SQL}, cols as (select doc_id, page, x as x_start, coalesce(lead(x) over (partition by doc_id, page order by x), 612) as x_end from edges),
o as (select *, row_number() over (partition by doc_id order by page, x_start, x_end) as i from cols),
walk as (select doc_id, i, [struct_pack(s := x_start, e := x_end, n := 1)] as cs from o where i = 1 union all
  select o.doc_id, o.i, case when list_position(list_transform(w.cs, lambda c: abs(o.x_start - c.s / c.n) <= 10), true) > 0
    then list_transform(w.cs, lambda c, k: case when k = list_position(list_transform(w.cs, lambda d: abs(o.x_start - d.s / d.n) <= 10), true) then struct_pack(s := c.s + o.x_start, e := c.e + o.x_end, n := c.n + 1) else c end)
    else list_append(w.cs, struct_pack(s := o.x_start, e := o.x_end, n := 1)) end from walk w join o on o.doc_id = w.doc_id and o.i = w.i + 1),
last as (select doc_id, unnest(cs) as c from walk qualify row_number() over (partition by doc_id order by i desc) = 1)
select doc_id, cast(row_number() over (partition by doc_id order by c.s / c.n, c.e / c.n, c.n) - 1 as integer) as column_id, round(c.s / c.n, 6)::double as x_start, round(c.e / c.n, 6)::double as x_end, cast(c.n as bigint) as n from last""")
def global_columns(spark, sf):
    found = splits.gap_columns(words(spark, sf)).select(*KEYS, F.explode("columns").alias("c")).select(*KEYS, "c.x_start", "c.x_end")
    return splits.document_columns(found).select("doc_id", "column_id", F.round("x_start", 6).alias("x_start"), F.round("x_end", 6).alias("x_end"), "n")


def _split_sql(depth=3):
    """Levels of splitting, each over the regions of the one before."""
    parts = ["r0 as (select doc_id, page, text, x0, x1, top, bottom, '' as path, null::varchar as kind, false as done, page_width as w, page_height as h from words)"]
    for k in range(depth):
        parts.append(f"""m{k} as (select *, case when abs((x0 + x1) / 2 - lag((x0 + x1) / 2) over (partition by doc_id, page, path order by x0, x1, top, bottom, text)) >= w * 0.05::double then 1 else 0 end as nc,
  case when abs(top - lag(top) over (partition by doc_id, page, path order by top, bottom, x0, x1, text)) >= h * 0.02::double then 1 else 0 end as nb from r{k}),
n{k} as (select *, cast(sum(nc) over (partition by doc_id, page, path order by x0, x1, top, bottom, text rows unbounded preceding) as integer) as col, cast(sum(nc) over p + 1 as integer) as cols, cast(sum(nb) over p + 1 as integer) as bands
  from m{k} window p as (partition by doc_id, page, path)),
s{k} as (select *, case when cols = 1 and bands >= 3 then 'vertical' when cols >= 2 and bands <= 2 then 'horizontal' when cols >= 2 then 'hybrid' else 'simple' end as found, done or w < 50 or h < 50 as small from n{k}),
t{k} as (select *, not small and found in ('horizontal', 'hybrid') as split from s{k}),
u{k} as (select *, max(x1) over c - min(x0) over c as w2, max(bottom) over c - min(top) over c as h2 from t{k} window c as (partition by doc_id, page, path, col)),
r{k + 1} as (select doc_id, page, text, x0, x1, top, bottom, case when split then path || '/' || col else path end as path, case when done then kind when split or small then null else found end as kind, not split as done,
  case when split then w2 else w end as w, case when split then h2 else h end as h from u{k})""")
    return ",\n".join(parts)


@query(f"with {WORDS_SQL}, {_split_sql()} select doc_id, page, text, path, kind from r3")
def recursive_layout(spark, sf):
    return blocks.split_regions(words(spark, sf)).select(*KEYS, "text", "path", "kind")


@query(f"with {WORDS_SQL}, {_split_sql(1)} select doc_id, page, count(*) as n_blocks, any_value(cols) as n_columns, any_value(bands) as n_bands, any_value(found) as kind from t0 group by all")
def block_layouts(spark, sf):
    return blocks.block_layout(words(spark, sf))


@query(f"""with {WORDS_SQL}, t as (select doc_id, page, count(*) as n, count(*) filter (where is_bold) as images, (count(*) filter (where (x0 + x1) / 2 < 204) > 2)::int + (count(*) filter (where (x0 + x1) / 2 >= 204 and (x0 + x1) / 2 < 408) > 2)::int
  + (count(*) filter (where (x0 + x1) / 2 >= 408) > 2)::int as k from words group by all),
p as (select *, case k when 3 then 4 when 2 then 2 else 0 end + case when n < 10 then 0 when n < 30 then 1 else 2 end + case when images = 0 then 0 when images < 3 then 1 else 2 end as points from t)
select doc_id, page, n as n_blocks, greatest(k, 1) as n_columns, case when points <= 2 then 'simple' when points <= 5 then 'moderate' else 'complex' end as complexity from p""")
def page_complexity(spark, sf):
    """Bold words stand for images."""
    w = words(spark, sf)
    found = blocks.third_columns(w).join(w.groupBy(*KEYS).agg(F.count_if("is_bold").alias("images")), KEYS)
    return found.select(*KEYS, "n_blocks", "n_columns", blocks.complexity(F.col("n_columns"), F.col("n_blocks"), F.col("images")).alias("complexity"))


GUTTER_SQL = """placed as (select *, page_height / 60 as height, least(greatest(cast(trunc((x0 + x1) * 0.5 * 400 / page_width) as integer), 0), 399) as spot from words),
gl as (select p.doc_id, p.page, b.bin, count(*) filter (where abs(p.spot - b.bin) <= 3) as n from placed p cross join (select unnest(range(150, 250)) as bin) b group by all),
mid as (select doc_id, page, bin as gutter from gl qualify row_number() over (partition by doc_id, page order by n, bin) = 1),
banded as (select doc_id, page, spot, cast(band as integer) as band from placed cross join (select unnest(range(0, 60)) as band) where bottom > band * height and top < (band + 1) * height),
dens as (select d.doc_id, d.page, d.band, b.bin, count(*) filter (where abs(d.spot - b.bin) <= 3) as n from banded d cross join (select unnest(range(0, 400)) as bin) b group by all),
vals as (select doc_id, page, band, (min(n) filter (where bin between gutter - 10 and gutter + 10) / 7.0::double) / greatest(1.0, max(n) / 7.0::double) as v from dens join mid using (doc_id, page) group by all),
low as (select *, band - row_number() over (partition by doc_id, page order by band) as island from vals where v <= 0.05),
runs as (select doc_id, page, min(band) as first, count(*) as n from low group by doc_id, page, island),
agg as (select doc_id, page, sum(n) as n, min(first) filter (where n >= 5) as first from runs group by all)"""


@query(f"""with {WORDS_SQL}, {GUTTER_SQL}
select doc_id, page, round(coalesce(n, 0) / 60.0::double, 9) as coverage, round(coalesce(first, 0) / 60.0::double, 9) as header_fraction, round(gutter * 612.0::double / 400, 9) as gutter_x from mid left join agg using (doc_id, page)""")
def gutter_bands(spark, sf):
    return layout.gutter(words(spark, sf)).select(*KEYS, *[F.round(c, 9).alias(c) for c in ("coverage", "header_fraction", "gutter_x")])


@query(f"""with {WORDS_SQL}, r as (select *, row_number() over () as i from words),
p as (select a.doc_id, a.page, greatest(least(a.bottom, b.bottom) - greatest(a.top, b.top), 0) / least(a.bottom - a.top, b.bottom - b.top) as o from r a join r b on a.doc_id = b.doc_id and a.page = b.page and a.i < b.i),
m as (select doc_id, page, count(*) as n_pairs, avg(o) as mean_overlap from p group by all)
select doc_id, page, coalesce(n_pairs, 0) as n_pairs, round(coalesce(mean_overlap, 0), 6) as mean_overlap from (select distinct doc_id, page from words) left join m using (doc_id, page)""")
def mean_overlap_all_pairs(spark, sf):
    return layout.mean_overlap(words(spark, sf)).withColumn("mean_overlap", F.round("mean_overlap", 6))


@query(f"""with {WORDS_SQL}, c as (select doc_id, count(*) filter (where x0 < 306) as n_left, count(*) filter (where x0 >= 306) as n_right from words group by 1)
select *, case when n_left > 10 and n_right > 10 and least(n_left, n_right) / greatest(n_left, n_right) > 0.3 then 2 else 1 end as n_columns from c""")
def balanced_halves(spark, sf):
    return layout.balanced_halves(words(spark, sf), keys=("doc_id",))


@query(f"""with {WORDS_SQL}, {LINES_SQL}, sp as (select *, greatest(coalesce(top - lag(bottom) over (partition by doc_id, page order by line_no), 0), 0)::double as space_above from ls),
st as (select *, avg(height) over p as mh, avg(space_above) over p as ms, count(*) over p as n, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) as letters, length(regexp_replace(text, '[^A-Z]', '', 'g')) as upper_,
  list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') as ws from sp window p as (partition by doc_id, page)),
sc as (select doc_id, page, line_no, round(case when text like '%click%' then 0.4 else 0 end + case when len(ws) <= 8 and length(text) <= 60 then 0.15 else 0 end
  + case when upper_ / greatest(letters, 1) > 0.7 then 0.2 when len(list_filter(ws, lambda w: regexp_matches(w, '^[A-Z]'))) / greatest(len(ws), 1) > 0.8 then 0.15 else 0 end
  + case when text like '%:' then 0.1 else 0 end + case when height > 1.15::double * mh then 0.1 else 0 end + case when space_above > 1.3::double * ms then 0.15 else 0 end + case when line_no < least(5.0::double, n * 0.1::double) then 0.05 else 0 end, 4)::double as score from st)
select *, score >= 0.25 as is_heading from sc""")
def ocr_heading_score(spark, sf):
    from pyspark.sql import Window

    page = Window.partitionBy(*KEYS)
    spaced = lines.line_spacing(page_lines(spark, sf)).withColumns({"mh": F.avg("height").over(page), "ms": F.avg("space_above").over(page), "n": F.count("*").over(page)})
    c = F.col
    scored = headings.ocr_score(c("text"), F.contains("text", F.lit("click")), c("line_no"), c("n"), c("height"), c("mh"), c("space_above"), c("ms"))
    return spaced.select(*KEYS, "line_no", scored.alias("score")).withColumn("is_heading", F.col("score") >= 0.25)


VECTORS_SQL = f"""{WORDS_SQL}, {GUTTER_SQL.replace('runs as', 'open_runs as').replace('from runs', 'from open_runs')},
gutters as (select doc_id, page, coalesce(n, 0) / 60.0::double as coverage_gutter, coalesce(first, 0) / 60.0::double as header_fraction from mid left join agg using (doc_id, page)),
halves as (select *, (x0 + x1) / 2 as xc from words),
means as (select doc_id, page, avg(x1 - x0) / 612 as avg_word_width_ratio, count(*) / (612 * 792.0::double) as text_density,
  coalesce(abs(avg(xc) filter (where xc >= 306) - avg(xc) filter (where xc < 306)) / 612 / greatest((stddev_pop(xc) filter (where xc < 306) + stddev_pop(xc) filter (where xc >= 306)) / 612, 0.01), 0) as width_bimodality
  from halves group by all),
ys as (select doc_id, page, y, row_number() over (partition by doc_id, page order by y) as i from (select distinct doc_id, page, (top + bottom) / 2 as y from words)),
walk as (select doc_id, page, i, y, y as anchor from ys where i = 1 union all
  select v.doc_id, v.page, v.i, v.y, case when v.y - w.anchor <= 5 then w.anchor else v.y end from walk w join ys v on v.doc_id = w.doc_id and v.page = w.page and v.i = w.i + 1),
cls as (select w.doc_id, w.page, k.anchor as y, count(*) as n, max(x1) - min(x0) as width from words w join walk k on k.doc_id = w.doc_id and k.page = w.page and k.y = (w.top + w.bottom) / 2 group by all),
clines as (select *, y - lag(y) over (partition by doc_id, page order by y) as space from cls),
lf as (select doc_id, page, count(*) filter (where width >= 459) / count(*) as full_width_line_ratio, count(*) filter (where width >= 459) as horizontal_lines_count, var_pop(n) as line_density_variance,
  coalesce(var_pop(space), 0) as line_spacing_variance, max(width / 612) as max_line_width_ratio, min(width / 612) as min_line_width_ratio from clines group by all),
pos as (select *, row_number() over (partition by doc_id, page order by top, x0, x1, bottom) as i, bottom - top as h from words),
ov as (select a.doc_id, a.page, b.i - a.i as d, greatest(least(a.bottom, b.bottom) - greatest(a.top, b.top), 0) / least(a.h, b.h) as o from pos a join pos b on a.doc_id = b.doc_id and a.page = b.page and a.i < b.i where least(a.h, b.h) > 0),
om as (select doc_id, page, avg(o) as mean_y_overlap, avg(o) filter (where d <= 19) as mean_y_overlap_near from ov group by all),
spots as (select doc_id, page, least(cast(floor(xc * 306 / 612) as integer), 305) as bin from halves),
grid as (select p.doc_id, p.page, g.bin, count(a.bin) as c from (select distinct doc_id, page from words) p cross join (select unnest(range(306)) as bin) g
  left join spots a on a.doc_id = p.doc_id and a.page = p.page and abs(a.bin - g.bin) <= 2 group by all),
sm as (select *, lag(c) over o as b, lead(c) over o as a, greatest(max(c) over (partition by doc_id, page), 5) as m from grid window o as (partition by doc_id, page order by bin)),
pk as (select p.doc_id, p.page, p.bin, p.c, p.m, coalesce(max(g.bin) filter (where g.bin < p.bin), 0) as l, coalesce(min(g.bin) filter (where g.bin > p.bin), 305) as r
  from (select * from sm where c > b and c > a and c * 5 > m) p left join sm g on g.doc_id = p.doc_id and g.page = p.page and g.c * 2 <= p.c group by all),
vl as (select p.doc_id, p.page, p.bin, p.c, p.m, coalesce(max(g.bin) filter (where g.bin < p.bin), 0) as l, coalesce(min(g.bin) filter (where g.bin > p.bin), 305) as r
  from (select * from sm where c < b and c < a) p left join sm g on g.doc_id = p.doc_id and g.page = p.page and g.c * 2 >= p.m + p.c group by all),
pf as (select doc_id, page, count(*) as peak_count, string_agg(cast(r - l as varchar), ',' order by bin) as peak_widths, string_agg(cast(c as varchar), ',' order by bin) as peak_heights, list(bin order by bin) as bins from pk group by all),
vf as (select doc_id, page, count(*) as valley_count, string_agg(cast(r - l as varchar), ',' order by bin) as valley_widths, string_agg(cast(c as varchar), ',' order by bin) as valley_depths,
  arg_min(bin, c * 1000 + bin) / 306 as valley_position, min(c / m) as valley_depth_ratio from vl group by all),
vectors as (select * exclude (bins), case when coverage_gutter >= 0.7 then 2 else 1 end as num_columns, case when len(bins) >= 2 then (bins[2] - bins[1]) / 306 else 0 end as peak_separation
  from gutters join means using (doc_id, page) join lf using (doc_id, page) left join om using (doc_id, page) left join pf using (doc_id, page) left join vf using (doc_id, page))"""


def rounded(names):
    return [F.round(c, 6).alias(c) for c in names]


@query(f"""with recursive {VECTORS_SQL} select doc_id, page, num_columns, round(coalesce(mean_y_overlap, 0), 6)::double as mean_y_overlap, round(coverage_gutter, 6)::double as coverage_gutter,
round(full_width_line_ratio, 6)::double as full_width_line_ratio, round(coalesce(valley_depth_ratio, 1), 6)::double as valley_depth_ratio, horizontal_lines_count, round(header_fraction, 6)::double as header_fraction,
round(avg_word_width_ratio, 6)::double as avg_word_width_ratio, round(line_density_variance, 6)::double as line_density_variance from vectors""")
def page_vector_9(spark, sf):
    whole = ("num_columns", "horizontal_lines_count")
    return page_vectors.page_vectors(words(spark, sf)).select(*KEYS, *whole, *rounded([c for c in page_vectors.NINE if c not in whole]))


@query(f"""with recursive {VECTORS_SQL} select doc_id, page, num_columns, round(coalesce(mean_y_overlap_near, 0), 6)::double as mean_y_overlap, round(coverage_gutter, 6)::double as coverage_gutter,
round(full_width_line_ratio, 6)::double as full_width_line_ratio, round(coalesce(valley_depth_ratio, 1), 6)::double as valley_depth_ratio, horizontal_lines_count, round(header_fraction, 6)::double as header_fraction,
round(avg_word_width_ratio, 6)::double as avg_word_width_ratio, round(line_density_variance, 6)::double as line_density_variance,
cast(coalesce(peak_count, 0) as integer) as peak_count, coalesce(peak_widths, '') as peak_widths, coalesce(peak_heights, '') as peak_heights, round(peak_separation, 6)::double as peak_separation,
cast(coalesce(valley_count, 0) as integer) as valley_count, coalesce(valley_depths, '') as valley_depths, coalesce(valley_widths, '') as valley_widths, round(coalesce(valley_position, 0.5), 6)::double as valley_position,
round(line_spacing_variance, 6)::double as line_spacing_variance, round(text_density, 9)::double as text_density, round(max_line_width_ratio, 6)::double as max_line_width_ratio,
round(min_line_width_ratio, 6)::double as min_line_width_ratio, round(width_bimodality, 6)::double as width_bimodality from vectors""")
def page_vector_22(spark, sf):
    v = page_vectors.page_vectors(words(spark, sf)).withColumn("mean_y_overlap", F.col("mean_y_overlap_near"))
    # lists as text: widths in bins of the page's 306, heights in fifths of words, as both engines write them alike
    joined = lambda name, unit: F.array_join(F.transform(name, lambda x: F.round(x * unit).cast("int").cast("string")), ",").alias(name)
    lists = [joined("peak_widths", 306), joined("valley_widths", 306), joined("peak_heights", F.col("density_top")), joined("valley_depths", F.col("density_top"))]
    whole = ("num_columns", "horizontal_lines_count", "peak_count", "valley_count")
    plain = [c for c in (*page_vectors.NINE, *page_vectors.MORE) if c not in whole and not c.endswith(("_widths", "_heights", "_depths")) and c != "text_density"]
    return v.select(*KEYS, *whole, *rounded(plain), F.round("text_density", 9).alias("text_density"), *lists)


def _valleys_sql(source, keys):
    """Valleys over dense pixels of a table (keys, x0, x1), whose pages are 612 wide."""
    same = " and ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    return f"""px as (select {keys}, unnest(range(greatest(0, least(cast(trunc(x0) as integer), 611)), greatest(0, least(cast(trunc(x1) as integer), 611)))) as x from {source}),
cov as (select {keys}, x, count(*) as n from px group by all),
dense_px as (select g.*, coalesce(n, 0) as n from (select {keys}, unnest(range(612)) as x from (select distinct {keys} from {source})) g left join cov using ({keys}, x)),
hs as (select *, sum(n) over (partition by {keys} order by x rows between 3 preceding and 3 following) as h from dense_px),
hl as (select *, case when h <> lag(h) over (partition by {keys} order by x) then 1 else 0 end as turn from hs),
hg as (select *, sum(turn) over (partition by {keys} order by x rows unbounded preceding) as g from hl),
flats as (select {keys}, g, min(x) as a, max(x) as z, any_value(h) as h from hg group by all),
turned as (select *, lag(h) over o as b4, lead(h) over o as af from flats window o as (partition by {keys} order by g)),
minima as (select {keys}, (a + z) // 2 as at_x, h, row_number() over (partition by {keys} order by h, (a + z) // 2 desc) as i from turned where b4 > h and af > h),
picked as (select {keys}, i, [at_x] as kept from minima where i = 1 union all
  select {", ".join("b." + k for k in keys.split(", "))}, b.i, case when len(list_filter(a.kept, lambda q: abs(q - b.at_x) < 15)) = 0 then list_append(a.kept, b.at_x) else a.kept end from picked a join minima b on {same} and b.i = a.i + 1),
chosen as (select {keys}, unnest(kept) as at_x from picked qualify row_number() over (partition by {keys} order by i desc) = 1),
tops as (select {keys}, max(h) as top from hs group by all),
reached as (select {", ".join("a." + k for k in keys.split(", "))}, a.at_x, m.h, top, coalesce(max(b.x) filter (where b.x < a.at_x and 2 * b.h > 3 * m.h), 0) as start, coalesce(min(b.x) filter (where b.x > a.at_x and 2 * b.h > 3 * m.h), 611) as stop
  from chosen a join minima m using ({keys}, at_x) join tops using ({keys}) join hs b on {same} group by all),
valleys as (select {keys}, at_x, start, stop, 1 - h / top as depth from reached where stop - start >= 15 and 1 - h / top > 0.3)"""


@query(f"with recursive {WORDS_SQL}, {_valleys_sql('words', 'doc_id, page')} select doc_id, page, cast(start as integer) as start, cast(stop as integer) as stop, round(depth, 6)::double as depth from valleys")
def coverage_valleys(spark, sf):
    found = regions.coverage_valleys(words(spark, sf)).select(*KEYS, F.explode("valleys").alias("v"))
    return found.select(*KEYS, "v.start", "v.stop", F.round("v.depth", 6).alias("depth"))


@query(f"""with recursive {WORDS_SQL},
gap_ys as (select doc_id, page, (bottom + next) / 2 as y from (select *, lead(top) over (partition by doc_id, page order by top, bottom) as next from words) where next - bottom >= 30),
ruled as (select doc_id, page, y from gap_ys union all select distinct doc_id, page, 55.0 + 100 * page from words),
ny as (select *, row_number() over (partition by doc_id, page order by y) as i from ruled),
fold as (select doc_id, page, i, y as last, []::double[] as done from ny where i = 1 union all
  select n.doc_id, n.page, n.i, case when n.y - f.last < 10 then (f.last + n.y) / 2 else n.y end, case when n.y - f.last < 10 then f.done else list_append(f.done, f.last) end from fold f join ny n on n.doc_id = f.doc_id and n.page = f.page and n.i = f.i + 1),
bounds as (select doc_id, page, list_concat([0.0::double], done, [last], [792.0::double]) as es from fold qualify row_number() over (partition by doc_id, page order by i desc) = 1),
spans as (select doc_id, page, no, es[no + 1] as y_start, es[no + 2] as y_end from (select *, unnest(range(len(es) - 1)) as no from bounds) where es[no + 2] - es[no + 1] >= 50),
own as (select doc_id, page, no, x0, x1, (x0 + x1) / 2 as xc from words join spans using (doc_id, page) where top between y_start and y_end or bottom between y_start and y_end),
{_valleys_sql('own', 'doc_id, page, no')},
ns as (select doc_id, page, no, count(*) as n from own group by all),
cuts as (select doc_id, page, no, (start + stop) // 2 as x from valleys qualify row_number() over (partition by doc_id, page, no order by depth desc, at_x) <= 3 union all select doc_id, page, no, unnest([0, 612]) from ns),
cs as (select *, lead(x) over (partition by doc_id, page, no order by x) as z from cuts),
wide as (select c.doc_id, c.page, c.no, c.x, c.z from cs c join own o on o.doc_id = c.doc_id and o.page = c.page and o.no = c.no and o.xc >= c.x and o.xc < c.z where c.z - c.x >= 80 group by all having count(*) >= 15),
ws as (select doc_id, page, no, count(*) as k, string_agg(x || '-' || z, ',' order by x) as cols from wide group by all),
ds as (select doc_id, page, no, max(depth) as deepest from valleys group by all),
rated as (select s.*, coalesce(n, 0) as n, case when coalesce(n, 0) < 10 or k is null then 1 else k end as k, case when coalesce(n, 0) < 10 or k is null then '0-612' else cols end as cols,
  case when coalesce(n, 0) < 10 then 0.5 when coalesce(k, 1) = 1 and deepest is null then 0.9 when coalesce(k, 1) = 1 then 0.6 else least(0.95, deepest) end::double as sure
  from spans s left join ns using (doc_id, page, no) left join ws using (doc_id, page, no) left join ds using (doc_id, page, no)),
isl as (select *, case when lag(k) over o = k and lag(sure) over o > 0.7 and sure > 0.7 then 0 else 1 end as new from rated window o as (partition by doc_id, page order by no)),
num as (select *, sum(new) over (partition by doc_id, page order by no rows unbounded preceding) as island from isl),
pos as (select *, row_number() over o as i, count(*) over (partition by doc_id, page, island) as m from num window o as (partition by doc_id, page, island order by no)),
joined as (select doc_id, page, island, min(y_start) as y_start, max(y_end) as y_end, sum(n) as n_words, max(k) as n_columns, arg_min(cols, no) as cols, sum(sure * case when i = 1 then power(0.5, m - 1) else power(0.5, m - i + 1) end) as confidence from pos group by all),
best as (select * from joined qualify row_number() over (partition by doc_id, page order by n_words desc, y_start) <= 5)
select doc_id, page, cast(row_number() over (partition by doc_id, page order by y_start) - 1 as integer) as region_no, round(y_start, 6)::double as y_start, round(y_end, 6)::double as y_end, cast(n_words as bigint) as n_words, cast(n_columns as integer) as n_columns,
  cols as columns, round(confidence, 6)::double as confidence from best""")
def page_regions(spark, sf):
    """Regions of all pages, each with a drawn line at a height that goes by its number."""
    w = words(spark, sf)
    y = 55.0 + 100 * F.col("page")
    rules = w.select(*KEYS).distinct().select(*KEYS, F.lit(10.0).alias("x0"), F.lit(600.0).alias("x1"), y.alias("y0"), y.alias("y1"))
    found = regions.page_regions(w, rules)
    said = F.array_join(F.transform("columns", lambda c: F.concat_ws("-", c["x_start"].cast("int").cast("string"), c["x_end"].cast("int").cast("string"))), ",")
    return found.select(*KEYS, "region_no", *[F.round(c, 6).alias(c) for c in ("y_start", "y_end", "confidence")], "n_words", "n_columns", said.alias("columns"))


THRESHOLDS_SQL = f"""{WORDS_SQL}, {LINES_SQL}, {_split_sql(1)},
sp as (select *, greatest(coalesce(top - lag(bottom) over (partition by doc_id, page order by line_no), 0), 0)::double as space_above from ls),
st as (select doc_id, stddev_pop(height) / greatest(1, avg(height)) as spread, quantile_cont(height, 0.75) / greatest(1, quantile_cont(height, 0.5)) as font, quantile_cont(space_above, 0.75) / greatest(1, quantile_cont(space_above, 0.5)) as space,
  count(*) / count(distinct page) as dense from sp group by 1),
kinds as (select doc_id, page, any_value(found) as kind from t0 group by all),
kc as (select doc_id, kind, count(*) as n, min(page) as first from kinds group by all),
common as (select doc_id, arg_min(kind, row(-n, first)) as kind from kc group by 1),
ths as (select doc_id, case when spread > 0.5 then 0.25 when spread > 0.3 then 0.3 else 0.35 end::double as heading_score, case when font > 1.5 then 1.1 when font > 1.2 then 1.15 else 1.05 end::double as font_ratio,
  case when space > 2 then 1.3 when space > 1.5 then 1.5 else 1.8 end::double as space_ratio, case kind when 'horizontal' then 0.03 when 'vertical' then 0.08 else 0.05 end::double as column_tolerance,
  case kind when 'horizontal' then 0.03 when 'vertical' then 0.015 else 0.02 end::double as band_tolerance, case when dense > 50 then 50 when dense > 30 then 100 else 150 end as block_area from st join common using (doc_id))"""


def _thresholds(spark, sf):
    return layout.adaptive_thresholds(lines.line_spacing(page_lines(spark, sf)), blocks.block_layout(words(spark, sf)))


@query(f"with {THRESHOLDS_SQL} select * from ths")
def adaptive_thresholds(spark, sf):
    return _thresholds(spark, sf)


@query(f"""with {THRESHOLDS_SQL},
ms as (select sp.*, len(string_split(text, ' ')) as n_words, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) as letters, length(regexp_replace(text, '[^A-Z]', '', 'g')) as uppers, height / avg(height) over p as fr,
  case when avg(space_above) over p > 0 then space_above / avg(space_above) over p end as sr from sp window p as (partition by doc_id, page)),
ps as (select doc_id, page, line_no, heading_score, case when text like '%click%' then 0.4 else 0 end as k, case when n_words <= 8 and length(text) <= 50 then 0.15 else 0 end as l, case when uppers / greatest(letters, 1) > 0.7 then 0.2 else 0 end as c,
  case when text like '%5' then 0.1 else 0 end as co, case when fr > font_ratio then 0.1 else 0 end + case when sr > space_ratio then 0.15 else 0 end + case when line_no < 3 then 0.05 else 0 end as o from ms join ths using (doc_id)),
ss as (select *, round((k + l + c + co + o)::double, 6) as score from ps)
select doc_id, page, line_no, score, score >= heading_score or k >= 0.4 or (c >= 0.15 and co > 0 and l > 0) as is_heading from ss""")
def adaptive_headings(spark, sf):
    """Lines scored against their documents' thresholds; a last digit of 5 stands for a colon."""
    from pyspark.sql import Window

    page, c = Window.partitionBy(*KEYS), F.col
    spaced = lines.line_spacing(page_lines(spark, sf)).join(_thresholds(spark, sf), "doc_id")
    text = F.when(F.endswith("text", F.lit("5")), F.regexp_replace("text", "5$", ":")).otherwise(c("text"))
    parts = headings.adaptive_parts(text, F.contains("text", F.lit("click")), c("height") / F.avg("height").over(page), F.try_divide("space_above", F.avg("space_above").over(page)), c("line_no"), c("font_ratio"), c("space_ratio"))
    scored = spaced.withColumn("parts", parts)
    return scored.select(*KEYS, "line_no", headings.adaptive_score(c("parts")).alias("score"), headings.adaptive_heading(c("parts"), c("heading_score")).alias("is_heading"))


LAYOUT_SQL = VECTORS_SQL.replace("words as (", "raw_words as (", 1).replace("from events)", "from events),\nwords as (select * replace (max(bottom) over (partition by doc_id, page) + 10 as page_height) from raw_words)", 1)


@query(f"""with recursive {LAYOUT_SQL},
sided as (select k.doc_id, k.page, k.anchor as y, min(x0) as x0, max(x1) as x1 from words w join walk k on k.doc_id = w.doc_id and k.page = w.page and k.y = (w.top + w.bottom) / 2 group by all),
sides as (select doc_id, page, count(*) filter (where x1 - x0 >= 459) as n_full, count(*) filter (where x1 - x0 < 459 and x0 < 183.6) as n_left, count(*) filter (where x1 - x0 < 459 and x0 >= 183.6) as n_right,
  (max(x1) filter (where x1 - x0 < 459 and x0 < 183.6) + min(x0) filter (where x1 - x0 < 459 and x0 >= 183.6)) / 2 as between_ from sided group by all),
maxima as (select doc_id, page, count(*) filter (where c > b and c > a) as n_maxima, min(c / m) filter (where c < b and c < a) as lowest from sm group by all),
every as (select s.doc_id, s.page, coverage_gutter as g, header_fraction as h, gutter * 612.0::double / 400 as gx, n_full, n_left >= 3 and n_right >= 3 as split, between_, case when n_maxima >= 2 then coalesce(lowest, 1) else 1 end as v, coalesce(mean_y_overlap, 0) as o
  from sides s join gutters using (doc_id, page) join mid using (doc_id, page) left join om using (doc_id, page) left join maxima using (doc_id, page)),
rated as (select *, 0.4::double * least(v / 0.3::double, 1) + 0.35::double * least(o * 5, 1) + case when n_full >= 3 then 0.25::double else 0 end as s from every)
select doc_id, page, cast(case when not (g >= 0.7 or split) then 1 when g >= 0.7 then case when n_full >= 3 or h > 0.05 then 3 else 2 end when s > 0.35::double then 3 else 2 end as integer) as layout_type, case when g >= 0.7 or split then 2 else 1 end as num_columns,
  round(case when g >= 0.7 then gx when split then between_ end, 6)::double as boundary, case when g >= 0.7 then 'gutter' when split then 'y_overlap' else 'single_column' end as method,
  round(case when not (g >= 0.7 or split) then 0.9 when g >= 0.7 then 0.92 else 0.7::double + least(abs(s - 0.5) * 0.4, 0.25) end, 6)::double as confidence from rated""")
def layout_types(spark, sf):
    found = page_vectors.layout_types(words(spark, sf))
    return found.select(*KEYS, "layout_type", "num_columns", F.round("boundary", 6).alias("boundary"), "method", F.round("confidence", 6).alias("confidence"))
