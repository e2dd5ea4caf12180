"""Operator 12, line dedup by two Bloom filters.

1. Each task puts the hashes of its rows' lines into a filter of hashes seen once, and those that it meets
   again into a second one. Filters are merged in segments of ``SEGMENT`` bytes: what two
   tasks' first filters share joins the second. The merged second filter, of at most ``BITS`` bits, is broadcast.
2. Only lines that it may hold (suspected repeats) are shuffled, as digests. Their documents are counted exactly and the one
   that keeps the line is chosen.
3. Each document gets the numbers of its lines to drop by one join on its id and a hash of its text.

A filter that is too small for the corpus suspects more lines; the result stays the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.shared import cut, most_frequent, table, text_hash, text_or_empty

#: Bits of each filter (64 MB), the places that a hash takes in it, and the bytes of a filter that are merged at once.
BITS, PLACES, SEGMENT = 1 << 29, 2, 1 << 18
#: Hashes that a task collects before it puts them into its filters.
HELD = 2_000_000
#: Lines of fewer code points stay; so do those in fewer documents.
LEAST_CHARS, LEAST_DOCUMENTS = 40, 5
#: Lines whose keepers are broadcast at most: the ones in most documents.
FREQUENT = 100_000
#: Stripped from both ends of a line: U+0020 and U+0009 to U+000D.
WHITE = " \t\n\x0b\x0c\r"
#: How A to Z are lower-cased.
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def line_key(line: str) -> str:
    key = line.strip(WHITE)
    # most keys are ASCII, where lower() does the same and is faster
    return key.lower() if key.isascii() else key.translate(LOWER)


def keys_of(text: str, least: int) -> dict[str, list[int]]:
    """The keys of at least ``least`` code points, each with the numbers of its lines."""
    found: dict[str, list[int]] = {}
    for number, line in enumerate(text.split("\n")):
        if len(line) >= least and len(key := line_key(line)) >= least:
            found.setdefault(key, []).append(number)
    return found


def places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each hash: one row for each of its places."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return np.stack([(hashes + np.uint64(k) * step * np.uint64(0x9E3779B1)) % np.uint64(bits) for k in range(PLACES)]).astype(np.int64)


class Bloom:
    """A filter over 64-bit hashes, in packed bits."""

    def __init__(self, bits: int):
        self.bits, self.packed = bits, np.zeros(bits // 8, np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        for at in places(hashes, self.bits):
            np.bitwise_or.at(self.packed, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for at in places(hashes, self.bits):
            found &= (self.packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return found


def repeated_hashes(texts: DataFrame, bits: int = BITS, least: int = LEAST_CHARS) -> DataFrame:
    """The filter of hashes seen twice, in segments: (segment, twice)."""
    width = min(SEGMENT, bits // 8)

    def collect(batches):
        once, twice, held, n = Bloom(bits), Bloom(bits), [], 0

        def put(found: np.ndarray) -> None:
            distinct, counts = np.unique(found, return_counts=True)
            twice.add(distinct[(counts > 1) | once.holds(distinct)])
            once.add(distinct)

        for batch in batches:
            for text in batch.column(0):
                new = [xxhash.xxh3_64_intdigest(k.encode()) for k in keys_of(text.as_py(), least)]
                held.append(np.array(new, np.uint64))
                n += len(new)
                if n > HELD:
                    put(np.concatenate(held))
                    held, n = [], 0
        if held:
            put(np.concatenate(held))
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for s in range(bits // 8 // width):
            part = slice(s * width, (s + 1) * width)
            if once.packed[part].any():
                row = [[s], [squeeze(once.packed[part].tobytes())], [squeeze(twice.packed[part].tobytes())]]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, (pa.int32(), pa.binary(), pa.binary()))], names=["segment", "once", "twice"])

    def merge(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor().decompress
        once, twice = np.zeros(width, np.uint8), np.zeros(width, np.uint8)
        for batch in rows:
            for a, b in zip(batch["once"], batch["twice"]):
                new = np.frombuffer(open_(a.as_py()), np.uint8)
                twice |= np.frombuffer(open_(b.as_py()), np.uint8) | (once & new)
                once |= new
        if twice.any():
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([zstandard.ZstdCompressor(level=1).compress(twice.tobytes())], pa.binary())], names=["segment", "twice"])

    return texts.mapInArrow(collect, "segment int, once binary, twice binary").groupBy("segment").applyInArrow(merge, "segment int, twice binary")


def suspected_lines(own: DataFrame, bits: int = BITS, least: int = LEAST_CHARS) -> DataFrame:
    """Lines of ``own`` (doc_id, h, text) that the second filter may hold: doc_id, h, digest, lines (their numbers)."""
    width = min(SEGMENT, bits // 8)
    # at most bits / 8 bytes, compressed
    shared = own.sparkSession.sparkContext.broadcast({r["segment"]: bytes(r["twice"]) for r in repeated_hashes(own.select("text"), bits, least).collect()})

    def work(batches):
        twice = Bloom(bits)
        for s, raw in shared.value.items():
            twice.packed[s * width : (s + 1) * width] = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
        for batch in batches:
            at, digests, lines = [], [], []
            for i, text in enumerate(batch["text"]):
                found = keys_of(text.as_py(), least)
                raw = [k.encode() for k in found]
                hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in raw], np.uint64)
                for key, numbers, held in zip(raw, found.values(), twice.holds(hashes)):
                    if held:
                        at.append(i), digests.append(hashlib.blake2b(key, digest_size=16).digest()), lines.append(numbers)
            rows = batch.select(["doc_id", "h"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(digests, pa.binary()), pa.array(lines, pa.list_(pa.int32()))], names=["doc_id", "h", "digest", "lines"])

    return own.mapInArrow(work, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, h bigint, digest binary, lines array<int>")


def kept_by(suspects: DataFrame, documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """(digest, keeper, n): lines in at least ``documents`` documents, with the largest id among them (no id is less than any)."""
    once = suspects.select("digest", "doc_id").distinct()
    return once.groupBy("digest").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= documents)


def lines_to_drop(suspects: DataFrame, documents: int = LEAST_DOCUMENTS, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, h, dropped): the numbers of the lines that each text loses."""
    confirmed = cut(kept_by(suspects, documents))
    least, rest = most_frequent(confirmed, "n", frequent)
    parts = [suspects.join(F.broadcast(confirmed.where(F.col("n") >= least)), "digest")]  # at most ``frequent`` rows
    if rest:
        parts.append(suspects.join(confirmed.where(F.col("n") < least), "digest"))
    every = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    lost = every.where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    # a set of lists, as rows that repeat id and text give the same ones
    return lost.groupBy("doc_id", "h").agg(F.sort_array(F.flatten(F.collect_set("lines"))).alias("dropped"))


def dedup_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_CHARS, documents: int = LEAST_DOCUMENTS, bits: int = BITS, frequent: int = FREQUENT) -> DataFrame:
    """One row per row: doc_id, n_lines (before dropping), n_dropped, kept (the text without the dropped lines).

    Lines end at \\n only; a null or empty text is one empty line. A line's key is the line without white space (U+0020, U+0009 to
    U+000D) at both ends, A to Z lower-cased. Keys of at least ``least`` code points that at least ``documents`` different ids hold
    stay in the largest of these ids only, there in all their lines; repeated rows with one id are one document. A null id is an id less than all others. A text
    that loses all its lines becomes empty. An empty table gives an empty result; other columns are not read.
    """
    own = df.select(F.col(doc_id).alias("doc_id"), text_hash(text).alias("h"), text_or_empty(text).alias("text"))
    drop = lines_to_drop(cut(suspected_lines(own, bits, least)), documents, frequent)
    same = F.col("o.doc_id").eqNullSafe(F.col("d.doc_id")) & (F.col("o.h") == F.col("d.h"))
    joined = own.alias("o").join(drop.alias("d"), same, "left").select("o.doc_id", "o.text", "d.dropped")

    def work(batches):
        for batch in batches:
            kept, n_lines, n_dropped = [], [], []
            for text, dropped in zip(batch["text"], batch["dropped"]):
                text, gone = text.as_py(), set(dropped.as_py() or ())
                n_lines.append(text.count("\n") + 1), n_dropped.append(len(gone))
                kept.append("\n".join([x for i, x in enumerate(text.split("\n")) if i not in gone]) if gone else text)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept"])

    return joined.mapInArrow(work, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, n_lines bigint, n_dropped bigint, kept string")


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = r"""
with l as (
  select doc_id, unnest(range(len(lines))) as i, unnest(lines) as line
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents)),
k as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from l),
f as (select key, max(doc_id) as keeper from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
m as (select k.*, f.key is not null and k.doc_id <> f.keeper as gone from k left join f using (key))
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from m group by doc_id
"""
