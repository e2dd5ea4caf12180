"""Operator 13, source divergence audit with duplicate count columns taken once.

1. Each task counts terms by language and source; one shuffle by (language, term) brings a term's counts together as a
   sparse vector: the sources that hold it, with their counts. Terms in enough documents are kept.
2. Terms with identical vectors are grouped: a distinct vector and its multiplicity. A pair of sources is evaluated once for each
   distinct vector, times its multiplicity.
3. With f(p, q) = floor((p - q)^2 / q) and p0 the probability of a count of nought, a pair's sum over all terms is, exactly,

       V f(p0, q0) + sum over terms that s holds of f(p, q0) - f(p0, q0) + sum over terms that t holds of f(p0, q) - f(p0, q0)
       + sum over terms that both hold of f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0),

   so a vector costs the square of the sources that hold it, and the one-sided sums go over a source's distinct counts.
4. The most telling terms of each source are ranked by a window with a limit, which Spark applies before it shuffles.

The sources of the languages, with a number each, are held by every task: S of them where the result has S^2 rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.shared import cut, summed, table

#: A term is kept in a language where so many of its documents hold it.
LEAST_DOCUMENTS = 3
#: Terms reported for each source.
TOP = 200
#: Probabilities are in parts of this number.
SCALE = 1_000_000_000
#: Terms that a task counts before it hands them on; bytes of a text that are split at once; pairs that are evaluated at once.
HELD, STRETCH, PAIRS = 400_000, 1 << 22, 1 << 20
#: Letters stay, A to Z lower-cased, as do all bytes of characters beyond ASCII; all else parts terms.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, in stretches."""
    raw, start = text.encode().translate(_LETTERS), 0
    while start < len(raw):
        stop = raw.find(b" ", start + STRETCH)
        yield raw[start : stop if stop >= 0 else len(raw)].split()
        start = stop if stop >= 0 else len(raw)


def term_vectors(df: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, term, vector): the kept terms, each with (source, n) of the sources that hold it, sorted.

    A row of each language has no term; its vector names all the language's sources, with counts of nought.
    """
    own = df.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())

    def rows(held: dict):
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            for start in range(0, len(terms), 1 << 15):
                part = terms[start : start + (1 << 15)]
                size = len(part)
                columns = ([lang] * size, [source] * size, pa.array(part, pa.binary()).cast(pa.string()), [n[t] for t in part], [docs[t] for t in part])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "source", "term", "n", "docs"])

    def count(batches):
        groups, held, size = set(), {}, 0
        for batch in batches:
            for lang, source, text in zip(*[batch[c] for c in ("lang", "source", "text")]):
                group = (lang.as_py(), source.as_py())
                groups.add(group)
                n, docs = held.setdefault(group, (Counter(), Counter()))
                before, distinct = len(n), set()
                for words in terms_of(text.as_py()):
                    n.update(words)
                    distinct.update(words)
                docs.update(distinct)
                size += len(n) - before
                if size > HELD:
                    yield from rows(held)
                    held, size = {}, 0
        yield from rows(held)
        some = sorted(groups)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(([g[0] for g in some], [g[1] for g in some], [None] * len(some), [0] * len(some), [0] * len(some)), kinds)], names=["lang", "source", "term", "n", "docs"])

    counted = own.mapInArrow(count, "lang string, source string, term string, n bigint, docs bigint").repartition("lang", "term")
    by_source = counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    vectors = by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("vector"))
    return vectors.where(F.col("term").isNull() | (F.col("docs") >= least)).drop("docs")


def parts_of_scale(count, total):
    """1 + floor(SCALE (count + 1) / total) in 64 bits, by long division in base 1000: exact for totals below 9e15."""
    out, rest = (count + 1) // total, (count + 1) % total
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return out + 1


def parts_of_scale_column(count: Column, total: Column) -> Column:
    """The same as a column."""
    div = lambda a, b: F.call_function("div", a, b)
    out, rest = div(count + 1, total), (count + 1) % total
    for _ in range(3):
        out, rest = out * 1000 + div(rest * 1000, total), (rest * 1000) % total
    return out + 1


def divergence(p, q):
    """floor((p - q)^2 / q); p and q are at most SCALE + 1, so the square fits."""
    return (p - q) ** 2 // q


class Sources:
    """The sources of one language, sorted, with their totals: what all tasks hold."""

    def __init__(self, names: list[str], totals: list[int], terms: int):
        self.names, self.terms = pa.array(names, pa.string()), terms
        self.whole = np.array(totals, np.int64) + terms
        # where no term is kept all sums are nought, whatever the probabilities
        self.none = parts_of_scale(np.zeros(len(names), np.int64), np.maximum(self.whole, 1))


def sources_of(vectors: DataFrame) -> tuple[dict[str, Sources], DataFrame]:
    """By language; and the same as a table (lang, source, whole, lang_whole), where the wholes are totals plus the number of kept terms."""
    kept = vectors.where("term is not null")
    entries = kept.select("lang", F.explode("vector").alias("e")).groupBy("lang", F.col("e.source").alias("source")).agg(F.sum("e.n").alias("n"))
    named = vectors.where("term is null").select("lang", F.explode("vector.source").alias("source"))
    totals = named.join(entries, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"))
    terms = {r["lang"]: r["count"] for r in kept.groupBy("lang").count().collect()}
    by_lang: dict[str, list] = {}
    for r in totals.collect():
        by_lang.setdefault(r["lang"], []).append((r["source"], r["n"]))
    found = {lang: Sources([s for s, _ in sorted(own, key=lambda x: x[0])], [n for _, n in sorted(own, key=lambda x: x[0])], terms.get(lang, 0)) for lang, own in by_lang.items()}
    rows = [(lang, s, n + terms.get(lang, 0), sum(n for _, n in own) + terms.get(lang, 0)) for lang, own in by_lang.items() for s, n in own]
    return found, vectors.sparkSession.createDataFrame(rows, "lang string, source string, whole bigint, lang_whole bigint")


PAIR = "lang string, source string, item string, value bigint"


def _pair_rows(lang: str, own: Sources, s: np.ndarray, t: np.ndarray, value: np.ndarray) -> Iterator[pa.RecordBatch]:
    for start in range(0, len(s), 1 << 16):
        part = slice(start, start + (1 << 16))
        columns = [pa.array([lang] * len(s[part]), pa.string()), own.names.take(pa.array(s[part])), own.names.take(pa.array(t[part])), pa.array(value[part])]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "item", "value"])


def common_terms(distinct: DataFrame, shared) -> DataFrame:
    """What terms that both sources of a pair hold add to its sum: parts of it, to be summed up."""

    def pairs_within(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (i, j) of entries within the same vector."""
        each = np.repeat(lengths, lengths)
        i = np.repeat(np.arange(len(each)), each)
        first = np.repeat(np.repeat(np.cumsum(lengths) - lengths, lengths), each)
        return i, first + np.arange(len(i)) - np.repeat(np.cumsum(each) - each, each)

    def evaluate(own: Sources, s, p, m, i, j):
        a, b = s[i], s[j]
        mark = a != b
        i, j, a, b = i[mark], j[mark], a[mark], b[mark]
        p0, q0 = own.none[a], own.none[b]
        value = divergence(p[i], p[j]) - divergence(p[i], q0) - divergence(p0, p[j]) + divergence(p0, q0)
        return a.astype(np.int64) * len(own.names) + b, m[i] * value

    def work(batches):
        held: dict[str, tuple[list, list]] = {}

        def flush(lang):
            keys, values = summed(*held.pop(lang))
            width = len(shared.value[lang].names)
            return _pair_rows(lang, shared.value[lang], keys // width, keys % width, values)

        for batch in batches:
            for lang in batch["lang"].unique().to_pylist():
                own, rows = shared.value[lang], batch.filter(pc.equal(batch["lang"], lang))
                lengths, entries = pc.list_value_length(rows["vector"]).to_numpy().astype(np.int64), rows["vector"].flatten()
                s = pc.index_in(entries.field("source"), own.names).to_numpy()
                p = parts_of_scale(entries.field("n").to_numpy(), own.whole[s])
                m = np.repeat(rows["m"].to_numpy(), lengths)
                keys, values = held.setdefault(lang, ([], []))
                starts, done = np.cumsum(lengths) - lengths, 0
                while done < len(lengths):
                    n = max(1, int(np.searchsorted(np.cumsum(lengths[done:] ** 2), PAIRS, "right")))
                    low, high = int(starts[done]), int(starts[done + n - 1] + lengths[done + n - 1])
                    part = slice(low, high)
                    if n == 1:  # a vector of many sources by rows of its square
                        step = max(1, PAIRS // max(1, high - low))
                        blocks = [(np.repeat(np.arange(x, min(x + step, high - low)), high - low), np.tile(np.arange(high - low), min(step, high - low - x))) for x in range(0, high - low, step)]
                    else:
                        blocks = [pairs_within(lengths[done : done + n])]
                    for i, j in blocks:
                        k, v = summed(*([x] for x in evaluate(own, s[part], p[part], m[part], i, j)))
                        keys.append(k), values.append(v)
                        if sum(map(len, keys)) > 2 * PAIRS:
                            k, v = summed(keys, values)
                            held[lang] = keys, values = ([k], [v])
                            if len(k) > PAIRS:
                                yield from flush(lang)
                                keys, values = held.setdefault(lang, ([], []))
                    done += n
        for lang in list(held):
            if held[lang][0]:
                yield from flush(lang)

    return distinct.mapInArrow(work, PAIR)


def one_sided_terms(histograms: DataFrame, shared) -> DataFrame:
    """What terms of one source add to its pairs, both ways round, and the sum over all terms as if no source held them."""

    def work(batches):
        for batch in batches:
            for lang, source, n, m in zip(*[batch[c].to_pylist() for c in ("lang", "source", "n", "m")]):
                own = shared.value[lang]
                s = pc.index(own.names, source).as_py()
                m = np.array(m or [], np.int64)
                p, p0 = parts_of_scale(np.array(n or [], np.int64), own.whole[s]), own.none[s]
                step = max(1, PAIRS // max(1, len(m)))
                for start in range(0, len(own.names), step):
                    t = np.arange(start, min(start + step, len(own.names)))
                    t = t[t != s]
                    q0 = own.none[t]
                    there = own.terms * divergence(p0, q0)
                    back = np.zeros(len(t), np.int64)
                    if len(m):
                        there += ((divergence(p[None], q0[:, None]) - divergence(p0, q0)[:, None]) * m).sum(1)
                        back += ((divergence(q0[:, None], p[None]) - divergence(q0, p0)[:, None]) * m).sum(1)
                    yield from _pair_rows(lang, own, np.full(len(t), s), t, there)
                    yield from _pair_rows(lang, own, t, np.full(len(t), s), back)

    return histograms.mapInArrow(work, PAIR)


def pair_divergences(vectors: DataFrame, sources: dict[str, Sources]) -> DataFrame:
    """(lang, source, item, value): for each source of a language the divergence from each other one, over all kept terms."""
    shared = vectors.sparkSession.sparkContext.broadcast(sources)
    distinct = cut(vectors.where("term is not null").groupBy("lang", "vector").agg(F.count("*").alias("m")))
    counts = distinct.select("lang", "m", F.explode("vector").alias("e")).groupBy("lang", F.col("e.source").alias("source"), F.col("e.n").alias("n")).agg(F.sum("m").alias("m"))
    by_source = counts.groupBy("lang", "source").agg(F.collect_list(F.struct("n", "m")).alias("c"))
    named = vectors.where("term is null").select("lang", F.explode("vector.source").alias("source"))
    histograms = named.join(by_source, ["lang", "source"], "left").select("lang", "source", F.col("c.n").alias("n"), F.col("c.m").alias("m"))
    parts = common_terms(distinct, shared).unionAll(one_sided_terms(histograms, shared))
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def telling_terms(vectors: DataFrame, totals: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank): the terms of each source that are likelier there than in the language, by divergence from it."""
    whole = F.aggregate("vector", F.lit(0).cast("bigint"), lambda acc, e: acc + e["n"])
    entries = vectors.where("term is not null").select("lang", "term", whole.alias("all"), F.explode("vector").alias("e")).select("lang", F.col("e.source").alias("source"), "term", "e.n", "all")
    scored = entries.join(totals, ["lang", "source"]).withColumns({"p": parts_of_scale_column(F.col("n"), F.col("whole")), "q": parts_of_scale_column(F.col("all"), F.col("lang_whole"))})
    value = F.call_function("div", (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q"))
    likelier = scored.where("p > q").select("lang", "source", F.col("term").alias("item"), value.alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return likelier.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def audit_sources(df: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """Divergences between the sources of each language, and each source's most telling terms: lang, source, part, item, value, rank.

    ``df`` has text, lang and source; null ones are ''. Each row is a document, repeated rows and ids too. Terms are runs of ASCII letters and of
    all characters beyond ASCII; only A to Z are lower-cased. A language keeps terms that at least ``least`` of its documents hold. Sources without terms
    take part; a language with one source has no pairs, and where no term is kept its pairs have value 0. Ties go to the item that is less in
    UTF-8. An empty table gives an empty result; other columns are not read.
    """
    vectors = cut(term_vectors(df, least))
    sources, totals = sources_of(vectors)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_divergences(vectors, sources).withColumn("rank", F.row_number().over(order))
    both = [x.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, x in (("pair", pairs), ("term", telling_terms(vectors, totals, top)))]
    return both[0].unionAll(both[1])


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
with d as (
  select row_number() over () as i, coalesce(lang, '') as lang, coalesce(source, '') as source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
  from documents),
w as (select i, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
k as (select lang, term, count(*) as n from w group by all having count(distinct i) >= 3),
v as (select lang, count(*) as v, sum(n) as n from k group by lang),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*) as n from w semi join k using (lang, term) group by all),
t as (select g.lang, g.source, coalesce(sum(c.n), 0) as n from g left join c using (lang, source) group by all),
p as (
  select k.lang, t.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (t.n + v.v)::hugeint as p,
         1 + (1000000000::hugeint * (k.n + 1)) // (v.n + v.v)::hugeint as q
  from k join t using (lang) join v using (lang) left join c on c.lang = k.lang and c.source = t.source and c.term = k.term),
pairs as (
  select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
every as (
  select a.lang, a.source, b.source as item, coalesce(x.value, 0)::bigint as value
  from g a join g b on a.lang = b.lang and a.source <> b.source left join pairs x on x.lang = a.lang and x.source = a.source and x.item = b.source),
terms as (select lang, source, term as item, (((p - q) * (p - q)) // q)::bigint as value from p where n > 0 and p > q)
select lang, source, 'pair' as part, item, value, (row_number() over (partition by lang, source order by value desc, item))::integer as rank from every
union all
select lang, source, 'term', item, value, (row_number() over (partition by lang, source order by value desc, item))::integer as rank from terms
qualify rank <= 200
"""
