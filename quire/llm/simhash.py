"""Operator 3, SimHash near-dedup: fingerprints linked by Golay-code fuzzy hashing.

Fingerprints of 64 bits with at most two differing bits are linked. Work is on
distinct fingerprints; copies never meet.

* A fingerprint has three segments of 21, 21 and 22 bits. Of three segments with at most two
  errors in all, one has none; going round, one segment has none while
  the next has at most one (2+0+0, 1+1+0 and 1+0+0 all give such a pair).
* The binary Golay code [23, 12, 7] is perfect: every word of 23 bits lies within
  three bits of exactly one codeword. The codewords nearest to a word and to its
  23 neighbours give one index, or six, and two words that differ in one bit have
  an index in common. A key is (which pair, the exact segment, an index of the next):
  three to eighteen keys a fingerprint.
* Rows are dealt by key and sorted; a task streams over them and verifies the
  pairs of each key. A key that more than ``BUCKET`` fingerprints share is left to an exact
  way without pairs: its fingerprints are grouped by the words within one bit of them (65
  each), for two fingerprints share such a word exactly if they differ in at most two bits,
  and no word has more than 65 of them.
* Links make components (see ``components``).

``drop_near_copies``, the pipeline's stage, takes these links of fingerprints as candidates, verifies them, and adds those that two
bits miss: texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8 are linked.

* Further candidates share a band of five least hashes. Of pairs with a similarity of 0.8 a part
  of (1 - 0.8^5)^40 = 1.2e-7 shares none of the 40 bands, of more similar ones less.
* Work is on distinct sets; only sets with a candidate are made a second time, and
  every link is verified by the sets themselves.
* In every band all sets are compared with ``PIVOTS`` of them first, those with the fewest rare
  shingles; only pairs that then lie in different components are compared further, for
  others can't change the groups. Of bands that more than ``BUCKET`` sets share these are the pairs
  that share a rare shingle, and those that don't have too many rare ones to be similar. Nothing is capped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.components import components
from quire.llm.shared import cut, known_rows, release, table, text_hash, text_or_empty, without_rows

#: White space between words; a word is a run of other characters.
WHITE = " \t\n\x0b\x0c\r"
#: Words of a shingle, XXH64's seed.
WORDS, SEED = 3, 42
#: Fingerprints that a key may have for its pairs to be compared.
BUCKET = 64
#: Words that are hashed at a time.
STRETCH = 1 << 16
#: The stage's shingles; bands and least hashes of a band; sets of a band that all its others are compared with first.
STAGE_WORDS, BANDS, ROWS, PIVOTS = 5, 40, 5, 4
#: Sets of full bands that may have a rare shingle.
RARE = 16
#: Shingles whose hashes are permuted at a time.
CHUNK = 1 << 11
#: The Golay code's generator x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, its length, and the segments' widths.
GENERATOR, LENGTH, SEGMENTS = 0b110001110101, 23, (21, 21, 22)

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: str) -> list[str]:
    """Words after lower-casing A-Z; ``str.split`` knows more white space than the six characters, so they are cut at those."""
    for c in WHITE[1:]:
        text = text.replace(c, " ")
    return [w for w in text.translate(_LOWER).split(" ") if w]


def fingerprint(text: str) -> int:
    """The SimHash as an unsigned number."""
    from xxhash import xxh64_intdigest

    words = words_of(text)
    if not words:
        return 0
    size = min(WORDS, len(words))
    total, shingles = np.zeros(64, np.int64), len(words) - size + 1
    for at in range(0, shingles, STRETCH):
        own = words[at : min(at + STRETCH, shingles) + size - 1]
        joined = map(" ".join, zip(*(own[i:] for i in range(size))))
        hashes = np.array([xxh64_intdigest(s, SEED) for s in joined], "<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > shingles, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, f): the fingerprint as a bigint."""
    own = df.select(text_or_empty(text).alias("text"), F.col(doc_id).alias("doc_id"))

    def work(batches):
        for batch in batches:
            prints = np.array([fingerprint(x.as_py()) for x in batch.column(0)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(prints)], names=["doc_id", "f"])

    return own.mapInArrow(work, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, f bigint")


class Golay:
    """Decoding of words of 23 bits to the indices (12 bits) of near codewords."""

    def __init__(self) -> None:
        self.high = self._remainders(np.arange(1 << 12, dtype=np.int64) << 11)
        errors = [0, *(1 << i for i in range(LENGTH))]
        errors += [a | b for i, a in enumerate(errors[1:]) for b in errors[i + 2 :]]
        errors += [1 << i | 1 << j | 1 << k for i in range(LENGTH) for j in range(i) for k in range(j)]
        #: The error of each syndrome; there is one of at most three bits for each of the 2048.
        self.error = np.zeros(1 << 11, np.int64)
        self.error[self.syndrome(np.array(errors))] = errors
        around = np.array([0, *(1 << i for i in range(LENGTH))])
        self.around = [sorted({int(x) for x in self.index(np.array(e) ^ around)}) for e in self.error]

    @staticmethod
    def _remainders(words: np.ndarray) -> np.ndarray:
        for bit in range(LENGTH - 1, 10, -1):
            words = np.where(words >> bit & 1, words ^ (GENERATOR << (bit - 11)), words)
        return words

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        return self.high[words >> 11] ^ (words & 0x7FF)

    def index(self, words: np.ndarray) -> np.ndarray:
        """Of the nearest codeword: its upper 12 bits."""
        return (words ^ self.error[self.syndrome(words)]) >> 11

    def near(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The indices of ``words`` and their neighbours: (which word, index), each index once a word.

        The code is linear, so indices are those of the nearest codeword changed by what stands around the error alone.
        """
        syndromes = self.syndrome(words)
        table, many = np.full((1 << 11, 6), -1, np.int64), np.array([len(x) for x in self.around])
        for s, own in enumerate(self.around):
            table[s, : len(own)] = own
        found = table[syndromes]
        held = np.arange(6) < many[syndromes][:, None]
        return np.nonzero(held)[0], (found ^ self.index(words)[:, None])[held]


def keys_of(prints: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``prints``, key) of all keys of fingerprints (uint64)."""
    parts, at = [], 0
    for width in SEGMENTS:
        parts.append((prints >> np.uint64(at)).astype(np.int64) & ((1 << width) - 1))
        at += width
    owners, keys = [], []
    for i in range(3):
        owner, index = golay.near(parts[(i + 1) % 3])
        owners.append(owner)
        keys.append(np.int64(i) << 36 | parts[i][owner] << 12 | index)
    return np.concatenate(owners), np.concatenate(keys)


def links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b): pairs of fingerprints that connect all that differ in at most two bits; ``distinct`` has them once each as f."""

    def keyed(batches):
        golay = Golay()
        for batch in batches:
            prints = batch.column(0).to_numpy().astype(np.int64)
            owner, key = keys_of(prints.view(np.uint64), golay)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(prints[owner])], names=["key", "f"])

    def verified(batches):
        """Pairs of keys with up to ``bucket`` fingerprints; (f, null) for each of the others'."""
        rest = np.zeros((0, 2), np.int64)
        for batch in batches:
            rows = np.concatenate([rest, np.stack([c.to_numpy() for c in batch.columns], 1)])
            whole = int(np.searchsorted(rows[:, 0], rows[-1, 0], "left")) if len(rows) else 0
            if len(rows) - whole > bucket:  # the last key is a large one whatever follows: keep so many rows that this stays known
                keep = len(rows) - bucket - 1
                yield _pairs(rows[:keep], rows, bucket)
                rest = rows[keep:]
            else:
                yield _pairs(rows[:whole], rows[:whole], bucket)
                rest = rows[whole:]
        yield _pairs(rest, rest, bucket)

    keys = distinct.mapInArrow(keyed, "key bigint, f bigint")
    found = cut(keys.repartition("key").sortWithinPartitions("key", "f").mapInArrow(verified, "a bigint, b bigint").distinct())
    crowded = found.where("b is null").select(F.col("a").alias("f"))
    near = crowded.select("f", F.explode(F.lit([0, *(1 << i if i < 63 else -(1 << 63) for i in range(64))])).alias("flip"))
    words = near.groupBy(F.col("f").bitwiseXOR(F.col("flip")).alias("word")).agg(F.min("f").alias("a"), F.collect_list("f").alias("own")).where(F.size("own") > 1)
    return found.where("b is not null").unionByName(words.select("a", F.explode("own").alias("b")).where("a <> b"))


def _pairs(rows: np.ndarray, context: np.ndarray, bucket: int) -> pa.RecordBatch:
    """``rows`` sorted by key; ``context`` begins with them and tells how large the last key is at least."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    crowd = np.zeros(0, np.int64)
    if len(rows):
        key, prints = rows[:, 0], rows[:, 1].view(np.uint64)
        size = np.searchsorted(context[:, 0], key, "right") - np.searchsorted(context[:, 0], key, "left")
        crowd = np.unique(rows[size > bucket, 1])
        at, d = np.flatnonzero((size > 1) & (size <= bucket)), 1
        while len(at := at[at + d < len(rows)]) and len(at := at[key[at] == key[at + d]]):
            near = at[np.bitwise_count(prints[at] ^ prints[at + d]) <= 2]
            a.append(rows[near, 1])
            b.append(rows[near + d, 1])
            d += 1
    pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0)
    nulls = pa.nulls(len(crowd), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([pairs[:, 0], crowd])), pa.concat_arrays([pa.array(np.ascontiguousarray(pairs[:, 1])), nulls])], names=["a", "b"])


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket: int = BUCKET) -> DataFrame:
    """One row per row of ``df``: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over links, a document's own
    included. Null and empty texts have fingerprint zero and are linked as any other.
    Null ids are kept and have no say in component_id, which is null only where
    all ids of a component are. Repeated rows are copies. An empty table gives
    an empty result; other columns are not read.
    """
    prints = cut(fingerprints(df, doc_id, text))
    distinct = cut(prints.groupBy("f").agg(F.min("doc_id").alias("least")))
    classes = components(links(distinct.select("f"), bucket))
    named = classes.join(distinct, classes["node"] == distinct["f"]).select("f", "component", "least")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = named.select("f", "component").join(least, "component").select(F.col("f").alias("g"), "component_id")
    known = cut(distinct.join(linked, F.col("f") == F.col("g"), "left").select(F.col("f").alias("g"), F.coalesce("component_id", "least").alias("component_id")).repartition(F.xxhash64("g")))  # dealt so that the join below deals both sides anew and can split hot fingerprints
    return prints.join(known, F.col("f") == F.col("g")).select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


_RANDOM = np.random.default_rng(SEED)
_MIX = _RANDOM.integers(0, 1 << 64, 8, dtype=np.uint64) | np.uint64(1)
_TIMES = _RANDOM.integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32) | np.uint32(1)
_PLUS = _RANDOM.integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32)
_BAND = _RANDOM.integers(0, 1 << 64, BANDS, dtype=np.uint64)


def shingle_set(text: str, size: int = STAGE_WORDS) -> np.ndarray:
    """Hashes (uint64) of the distinct shingles; a text of fewer words is one shingle, one without words has none."""
    from xxhash import xxh64_intdigest

    words = words_of(text)
    size = min(size, len(words))
    hashes = np.array([xxh64_intdigest(w, SEED) for w in words], np.uint64)
    total = np.zeros(len(words) - size + 1 if words else 0, np.uint64)
    for i in range(size):
        total += hashes[i : i + len(total)] * _MIX[i]
    total ^= total >> np.uint64(32)
    total *= _MIX[-1]
    return np.unique(total ^ total >> np.uint64(29))


def set_name(own: np.ndarray) -> int:
    """A signed number that names a set of shingles."""
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(own.tobytes(), SEED)).view(np.int64))


def band_keys(own: np.ndarray) -> np.ndarray:
    """The keys (bigint) of a set's bands; none of an empty set."""
    if not len(own):
        return np.zeros(0, np.int64)
    upper, least = (own >> np.uint64(32)).astype(np.uint32), np.full(len(_TIMES), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(upper), CHUNK):
        least = np.minimum(least, (upper[None, at : at + CHUNK] * _TIMES + _PLUS).min(axis=1))
    return ((least.reshape(BANDS, ROWS) * _MIX[:ROWS]).sum(axis=1, dtype=np.uint64) ^ _BAND).view(np.int64)


def similar_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket: int = BUCKET, pivots: int = PIVOTS, bands: int = BANDS) -> DataFrame:
    """One row per row of ``df``: doc_id, h (a hash of the text), component (a number of its group), component_id: the smallest doc_id reachable over similarities of at least 0.8.

    Candidates are fingerprints that differ in at most two bits, and sets that share one of ``bands`` bands. Texts without words are copies of one another. Null ids have no say in component_id.
    """
    own = df.select(text_or_empty(text).alias("text"), F.col(doc_id).alias("doc_id"), text_hash(text).alias("h"))

    def banded(batches):
        for batch in batches:
            sets = [shingle_set(x.as_py()) for x in batch.column(0)]
            columns = [pa.array([set_name(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([band_keys(s)[:bands] for s in sets], pa.list_(pa.int64()))]
            columns.append(pa.array(np.array([fingerprint(x.as_py()) for x in batch.column(0)], np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), *columns], names=["doc_id", "h", "f", "n", "keys", "p"])

    rows = cut(own.mapInArrow(banded, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, h bigint, f bigint, n bigint, keys array<bigint>, p bigint"))
    distinct = rows.groupBy("f").agg(F.min("doc_id").alias("least"))
    keyed = rows.groupBy("f").agg(F.first("n").alias("n"), F.first("keys").alias("keys")).select("f", "n", F.explode("keys").alias("key"))
    same = Window.partitionBy("key")
    shared = cut(keyed.select("key", "f", "n", F.count("*").over(same).alias("m")).where("m > 1"))
    release(df.sparkSession)
    by_print = cut(_by_print(rows, bucket))
    release(df.sparkSession)
    wanted = rows.join(shared.select("f").union(by_print.select("f_a")).union(by_print.select("f_b")).distinct(), "f", "left_semi").select("h").distinct()

    def whole(batches):
        for batch in batches:
            sets = [shingle_set(x.as_py()) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([set_name(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["f", "shingles"])

    sets = cut(own.join(wanted, "h", "left_semi").select("text").mapInArrow(whole, "f bigint, shingles array<bigint>").dropDuplicates(["f"]))
    more = F.col("m") > pivots + 1  # of fewer sets the pivots meet all
    release(df.sparkSession)
    full = shared.where((F.col("m") > bucket) & more).select("f").distinct()
    # Of the sets of full bands those that share a rare shingle are compared for that; for all other pairs the rare ones bound
    # the similarity. The set with the fewest is the likeliest centre.
    own_shingles = sets.join(full, "f", "left_semi").select("f", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    rare = cut(own_shingles.join(own_shingles.groupBy("s").agg(F.count("*").alias("c")).where(F.col("c") <= RARE), "s"))
    lone = full.join(rare.groupBy("f").agg(F.count("*").alias("u")), "f", "left").select(F.col("f").alias("g"), F.coalesce("u", F.lit(0)).alias("u"))
    bounded = shared.join(lone, F.col("f") == F.col("g"), "left").select("key", "f", "n", "m", "u")
    shared = cut(bounded.withColumn("r", F.row_number().over(same.orderBy("u", "f"))))
    release(df.sparkSession)
    first, second = (shared.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("f", "n", "u", "r")]) for x in "ab")
    both = F.col("u_a").isNotNull() & F.col("u_b").isNotNull()  # rare shingles are counted among the sets of full bands
    close = 9 * F.when(both, F.least(F.col("n_a") - F.col("u_a"), F.col("n_b") - F.col("u_b"))).otherwise(F.least("n_a", "n_b")) >= 4 * (F.col("n_a") + F.col("n_b"))
    pairs = first.where(F.col("r_a") <= pivots).join(second, "key").where("r_a < r_b").where(close)
    classes = cut(components(_similar(pairs.select("f_a", "f_b").unionByName(by_print), sets)))
    release(df.sparkSession)
    later = shared.where(more)
    if not later.isEmpty():
        known = classes.select(F.col("node").alias("f"), "component")
        placed = later.join(known, "f", "left").select("key", "f", "n", "u", "r", F.coalesce("component", "f").alias("c"))
        several = placed.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("key")
        placed = cut(placed.join(several, "key", "left_semi"))
        first, second = (placed.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("f", "n", "u", "r", "c")]) for x in "ab")
        rest = first.where(F.col("r_a") > pivots).join(second, "key").where("r_a < r_b and c_a <> c_b").where(close).select("f_a", "f_b")
        apart = rare.where("c > 1").join(known, "f", "left").select("s", "f", "n", F.coalesce("component", "f").alias("c"))
        first, second = (apart.select("s", *[F.col(c).alias(f"{c}_{x}") for c in ("f", "n", "c")]) for x in "ab")
        by_rare = first.join(second, "s").where("f_a < f_b and c_a <> c_b and 5 * n_a >= 4 * n_b and 5 * n_b >= 4 * n_a").select("f_a", "f_b")
        found = cut(_similar(rest.unionByName(by_rare), sets))
        if not found.isEmpty():
            classes = cut(components(classes.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(found)))
    named = classes.join(distinct, F.col("node") == F.col("f")).select("f", "component", "least")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = named.join(least, "component").select(F.col("f").alias("g"), "component", "component_id")
    known = cut(distinct.join(linked, F.col("f") == F.col("g"), "left").select(F.col("f").alias("g"), F.coalesce("component", "f").alias("component"), F.coalesce("component_id", "least").alias("component_id")))
    return rows.join(known, F.col("f") == F.col("g")).select("doc_id", "h", "component", "component_id")


def _by_print(rows: DataFrame, bucket: int) -> DataFrame:
    """(f_a, f_b): sets whose texts' fingerprints (p) are linked; the least set of a fingerprint stands for it, and is paired with its others."""
    known = cut(rows.where("n > 0").select("p", "f").distinct())
    named = cut(known.groupBy("p").agg(F.min("f").alias("own")))
    x, y = (named.select(F.col("p").alias(s), F.col("own").alias(f"f_{s}")) for s in "ab")
    near = links(named.select(F.col("p").alias("f")), bucket).join(x, "a").join(y, "b").select("f_a", "f_b")
    return near.unionByName(known.join(named, "p").select(F.col("own").alias("f_a"), F.col("f").alias("f_b"))).where("f_a <> f_b")


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): of pairs (f_a, f_b) those whose sets have a similarity of at least 0.8."""
    x, y = (sets.select(F.col("f").alias(f"f_{s}"), F.col("shingles").alias(f"set_{s}")) for s in "ab")
    both = pairs.select("f_a", "f_b").distinct().join(x, "f_a").join(y, "f_b")
    return both.where(9 * F.size(F.array_intersect("set_a", "set_b")) >= 4 * (F.size("set_a") + F.size("set_b"))).select(F.col("f_a").alias("a"), F.col("f_b").alias("b"))


def drop_near_copies(df: DataFrame) -> DataFrame:
    """Of each group of near copies (``similar_groups``) one row of ``df``, the one with the smallest doc_id, with its own columns.

    Rows are told apart by id and text: of several texts with the smallest id one stays, the one with the least hash; rows
    without an id stay only where a group has no others; of repeated rows one stays, the least in its other
    columns (which have to be comparable). Null texts count as empty, and all texts without words are one group. An
    empty table gives an empty result.
    """
    rows = cut(similar_groups(df))
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("keep_id"), F.col("h").alias("keep_h"))).alias("keep"), F.count("*").alias("size"))
    judged = rows.join(cut(first.where("size > 1")), "component")  # written, so that the join deals both sides anew and can split large groups
    stays = F.col("doc_id").eqNullSafe(F.col("keep.keep_id")) & (F.col("h") == F.col("keep.keep_h"))
    repeated = judged.where(stays).groupBy("doc_id", "h").agg(F.count("*").alias("m")).where("m > 1")
    return without_rows(df, known_rows(judged.where(~stays)), cut(repeated.select("doc_id", "h")))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
