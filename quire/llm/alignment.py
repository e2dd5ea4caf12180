"""Operator 11, cross-tokenizer alignment by an event sweep.

1. Each text is encoded by both tokenizers. Every token ends at a byte offset; such
   an end is an event. The events of both sides are one table (their union), packed: a row
   holds the ids of one side that end within one window of ``WINDOW`` bytes, as
   ends follow from ids and the vocabulary's sizes.
2. The table is repartitioned by document and sorted by window and side within
   partitions. A state machine reads this stream: its state is a window and the open group,
   whatever the length of the text. A group closes where both sides end, and
   that end links the two tokens.
3. Links are counted over all documents by id pair. The most frequent pairs (at most
   ``FREQUENT``) are broadcast, all others joined.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.shared import cut, most_frequent, summed, table, text_hash, text_or_empty, tokenizer_path
from quire.llm.units import UnitEncoder, byte_letters, stretches

#: Bytes of text whose token ends make up one row of events.
WINDOW = 8192
#: Id pairs whose counts are broadcast at most (17 bytes each).
FREQUENT = 1_000_000
#: Links that a task or a document holds before it sums them up by id pair.
HELD = 2_000_000
#: Rows of a record batch that the stages hand on.
ROWS = 1 << 16
#: The place of a text among the rows: its id, a hash of it, and the task that read it. Equal rows of a task are copies.
ROW = ["doc_id", "h", "task"]

_SIDE_IN_TEXT = re.compile("[^▁]▁")


class Vocabulary:
    """One tokenizer: ids of space + text as plain text, and the bytes of each id."""

    def __init__(self, name: str):
        path = name if os.path.isabs(name) else tokenizer_path(name)
        self.tokens, self.encode = self._byte_level(path) if path.endswith(".json") else self._pieces(path)
        if b"" in self.tokens:
            raise ValueError("tokens without bytes end nowhere")
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.kind = "<u2" if len(self.tokens) <= 1 << 16 else "<u4"

    @staticmethod
    def _byte_level(path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        tokenizer.encode_special_tokens = True  # their strings in texts are plain text
        encoder, letters = UnitEncoder(tokenizer), byte_letters()
        added = set(encoder.added)
        tokens = [b""] * len(encoder.sizes)
        for token, i in tokenizer.get_vocab(with_added_tokens=True).items():
            tokens[i] = token.encode() if token in added else bytes(letters[c] for c in token)
        ids = encoder.by_rank or (lambda text: tokenizer.encode(text, add_special_tokens=False).ids)
        return tokens, lambda text: [ids(x) for x in stretches(" " + text)]

    @staticmethod
    def _pieces(path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if "".join(model.encode("a", out_type=str)) != "▁a":
            raise ValueError("a piece model that adds a space before texts is wanted here")
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        tokens = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        # no piece goes on over a space after another character: each stretch can be encoded for itself, the space before it being the one that the model adds
        apart = not any(_SIDE_IN_TEXT.search(p) for p in pieces)

        def encode(text: str) -> list[list[int]]:
            first, *rest = stretches(text) if apart else [text]
            return [model.encode(first), *[model.encode(x[1:]) for x in rest]] if text else []

        return tokens, encode

    def ids(self, text: str) -> tuple[np.ndarray, bool]:
        """The ids of space + ``text``, and whether their bytes are those of space + ``text``."""
        parts = self.encode(text)
        joined = (b"".join(map(self.tokens.__getitem__, ids)) for ids in parts)
        wanted, at = (" " + text).encode(), 0
        for found in joined:
            if not wanted.startswith(found, at):
                return np.zeros(0, self.kind), False
            at += len(found)
        return np.concatenate([np.array(x, self.kind) for x in parts]) if parts else np.zeros(0, self.kind), at == len(wanted)

    def windows(self, ids: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(window, the ids that end in it)."""
        of = (np.cumsum(self.sizes[ids]) - 1) // WINDOW
        cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(ids)]
        for a, b in zip(cuts, cuts[1:]):
            yield int(of[a]), ids[a:b].tobytes()


@lru_cache(maxsize=4)
def vocabulary(name: str) -> Vocabulary:
    """Kept for the worker's next tasks."""
    return Vocabulary(name)


def token_events(df: DataFrame, a: str, b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The token ends of both sides: doc_id, h, task, window, side (0 for ``a``, 1 for ``b``), ids.

    A text without tokens (see ``align``) has one row, of no ids.
    """
    own = df.select(F.col(doc_id).alias("doc_id"), text_hash(text).alias("h"), F.spark_partition_id().alias("task"), text_or_empty(text).alias("text"))

    def work(batches):
        sides = [vocabulary(a), vocabulary(b)]
        for batch in batches:
            at, window, side, ids = [], [], [], []
            for i, one in enumerate(batch["text"]):
                one = one.as_py()
                found = [v.ids(one) for v in sides] if one else []
                events = [(w, s, x) for s, v in enumerate(sides) for w, x in v.windows(found[s][0])] if found and all(same for _, same in found) else [(0, 0, b"")]
                for w, s, x in events:
                    at.append(i), window.append(w), side.append(s), ids.append(x)
            rows = batch.select(ROW).take(pa.array(at, pa.int64()))
            for start in range(0, len(at), 1024):
                part = slice(start, start + 1024)
                columns = [pa.array(window[part], pa.int32()), pa.array(side[part], pa.int8()), pa.array(ids[part], pa.binary())]
                yield pa.RecordBatch.from_arrays([*rows.slice(start, 1024).columns, *columns], names=[*ROW, "window", "side", "ids"])

    return own.mapInArrow(work, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, h bigint, task int, window int, side tinyint, ids binary")


def by_document(events: DataFrame) -> DataFrame:
    return events.repartition(*ROW).sortWithinPartitions(*ROW, "window", "side")


class Closed:
    """The groups that close in one window: ids of both sides, the group (from 0) of each, and the ends of the groups."""

    def __init__(self, a, b, group_a, group_b, ends):
        self.a, self.b, self.group_a, self.group_b, self.ends = a, b, group_a, group_b, ends

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """The two ids that end together at each group's end."""
        count = np.arange(len(self.ends))
        return self.a[np.searchsorted(self.group_a, count, "right") - 1], self.b[np.searchsorted(self.group_b, count, "right") - 1]


class Sweep:
    """The state machine over one document's windows: byte offsets reached by both sides and the ids of the open group."""

    def __init__(self, a: Vocabulary, b: Vocabulary):
        self.sides, self.at, self.open = (a, b), [0, 0], [np.zeros(0, np.int64)] * 2
        self.seen = [0, 0]

    def window(self, ids: list[np.ndarray]) -> Closed:
        ends = []
        for s, v in enumerate(self.sides):
            e = self.at[s] + np.cumsum(v.sizes[ids[s]])
            if len(e):
                self.at[s] = int(e[-1])
            self.seen[s] += len(e)
            ends.append(e)
        both = np.intersect1d(*ends, assume_unique=True)
        groups, closed = [], []
        for s, e in enumerate(ends):
            every = np.concatenate([self.open[s], ids[s].astype(np.int64)])
            # ids of the open group ended before this window: they go to its first group
            of = np.concatenate([np.zeros(len(self.open[s]), np.int64), np.searchsorted(both, e)])
            n = int(np.searchsorted(of, len(both)))
            groups.append(of[:n]), closed.append(every[:n])
            self.open[s] = every[n:]
        return Closed(closed[0], closed[1], groups[0], groups[1], both)


def documents_of(batches, a: str, b: str) -> Iterator[tuple[tuple, int, Sweep, Iterator[Closed]]]:
    """(row, number of copies seen so far as a list of one number, state, its windows' closed groups); windows must be read before the next document."""
    sides = (vocabulary(a), vocabulary(b))

    def stream():
        for batch in batches:
            columns = [batch[c].to_pylist() for c in (*ROW, "window", "side", "ids")]
            for doc_id, h, task, window, side, ids in zip(*columns):
                yield (doc_id, h, task), window, side, ids

    rows = stream()
    held = next(rows, None)

    def windows(own: tuple, state: Sweep, copies: list[int]) -> Iterator[Closed]:
        nonlocal held
        before = None
        while held and held[0] == own:
            now, ids = held[1], [np.zeros(0, v.kind) for v in sides]
            while held and held[0] == own and held[1] == now:
                if held[1:3] == before:
                    copies[0] += held[1:3] == (0, 0)  # an equal row's events
                else:
                    ids[held[2]] = np.frombuffer(held[3], sides[held[2]].kind)
                before, held = held[1:3], next(rows, None)
            yield state.window(ids)

    while held:
        own, state, copies = held[0], Sweep(*sides), [1]
        yield own, copies, state, windows(own, state, copies)


def align_groups(df: DataFrame, a: str, b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The aligned groups: doc_id, number (from 0), start, stop (bytes of space + text), a_ids, b_ids.

    ``element_at(a_ids, -1)`` and ``element_at(b_ids, -1)`` are the linked tokens of a group: they end together. Texts
    without tokens (see ``align``) have no groups. The groups of a repeated row come once for each of its copies.
    """
    events = by_document(token_events(df, a, b, doc_id, text))

    def work(batches):
        for own, copies, _, windows in documents_of(batches, a, b):
            done, number = 0, 0
            for x in windows:
                starts, n = np.concatenate([[done], x.ends[:-1]]) if len(x.ends) else x.ends, len(x.ends)
                lists = [pa.ListArray.from_arrays(pa.array(np.searchsorted(g, np.arange(n + 1)), pa.int32()), pa.array(i, pa.int32())) for g, i in ((x.group_a, x.a), (x.group_b, x.b))]
                numbers = pa.array(np.arange(number, number + n), pa.int64())
                # copies of a row are known once its first window was read
                for _ in range(copies[0]):
                    yield pa.RecordBatch.from_arrays([pa.array([own[0]] * n, kind), numbers, pa.array(starts, pa.int64()), pa.array(x.ends, pa.int64()), *lists], names=["doc_id", "number", "start", "stop", "a_ids", "b_ids"])
                number += n
                done = int(x.ends[-1]) if n else done

    kind = pa.string() if events.schema["doc_id"].dataType.simpleString() == "string" else pa.int64()
    return events.mapInArrow(work, f"doc_id {events.schema['doc_id'].dataType.simpleString()}, number bigint, start bigint, stop bigint, a_ids array<int>, b_ids array<int>")


class Written:
    """``a1,a2|b1;a3|b2,b3`` of a document, hashed as it grows."""

    def __init__(self, size_a: int, size_b: int):
        self.a = [np.array([f"{mark}{i}" for i in range(size_a)], object) for mark in ",;"]
        self.b = [np.array([f"{mark}{i}" for i in range(size_b)], object) for mark in ",|"]

    def text(self, x: Closed) -> str:
        """Begins with the mark before its first group."""
        out = np.empty(len(x.a) + len(x.b), object)
        for ids, group, place, marks in (
            (x.a, x.group_a, np.searchsorted(x.group_b, x.group_a), self.a),
            (x.b, x.group_b, np.searchsorted(x.group_a, x.group_b, "right"), self.b),
        ):
            first = np.diff(group, prepend=-1) > 0
            out[np.arange(len(ids)) + place] = np.where(first, marks[1][ids], marks[0][ids])
        return "".join(out.tolist())


@lru_cache(maxsize=2)
def written(size_a: int, size_b: int) -> Written:
    return Written(size_a, size_b)


def packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending keys as differences, with their counts."""
    small = "<u4" if not len(keys) or max(int(keys[-1]), int(counts.max())) < 1 << 32 else "<u8"
    return small[-1].encode() + zstandard.ZstdCompressor(level=1).compress(np.diff(keys, prepend=0).astype(small).tobytes() + counts.astype(small).tobytes())


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), f"<u{raw[:1].decode()}").astype(np.int64)
    n = len(both) // 2
    return np.cumsum(both[:n]), both[n:]


SUMMARY = "copies bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, links binary"


def summaries(events: DataFrame, a: str, b: str) -> DataFrame:
    """One row per text of the events: numbers, digest of the groups, and its links by id pair (packed)."""

    def work(batches):
        va, vb = vocabulary(a), vocabulary(b)
        as_text, width = written(len(va.tokens), len(vb.tokens)), len(vb.tokens)
        out: list[tuple] = []
        for own, copies, state, windows in documents_of(batches, a, b):
            digest, n_groups, held = hashlib.sha256(), 0, []
            keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for x in windows:
                if not len(x.ends):
                    continue
                digest.update(as_text.text(x)[0 if n_groups else 1 :].encode())
                n_groups += len(x.ends)
                ids_a, ids_b = x.links()
                keys.append(ids_a * width + ids_b), counts.append(np.ones(len(ids_a), np.int64))
                if sum(map(len, keys)) > HELD:
                    keys, counts = ([k] for k in summed(keys, counts))
            out.append((*own, copies[0], *state.seen, n_groups, n_groups, digest.hexdigest() if n_groups else "", packed(*summed(keys, counts))))
            if len(out) == 512:
                yield rows_of(out)
                out = []
        if out:
            yield rows_of(out)

    def rows_of(out):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[*ROW, *[c.split()[0] for c in SUMMARY.split(", ")]])

    doc_kind = events.schema["doc_id"].dataType.simpleString()
    kinds = [pa.string() if doc_kind == "string" else pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.string(), pa.binary()]
    return events.mapInArrow(work, f"doc_id {doc_kind}, h bigint, task int, {SUMMARY}")


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, n): how many links of all documents hold an id pair."""

    def work(batches):
        keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            for copies, raw in zip(batch["copies"].to_pylist(), batch["links"].to_pylist()):
                k, n = unpacked(raw)
                keys.append(k), counts.append(n * copies)
            if sum(map(len, keys)) > HELD:
                keys, counts = ([x] for x in summed(keys, counts))
                if len(keys[0]) > HELD // 2:
                    yield from parts(keys[0], counts[0])
                    keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        yield from parts(*summed(keys, counts))

    def parts(keys, counts):
        for start in range(0, len(keys), ROWS):
            part = slice(start, start + ROWS)
            yield pa.RecordBatch.from_arrays([pa.array(keys[part]), pa.array(counts[part])], names=["pair", "n"])

    return links.select("copies", "links").mapInArrow(work, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def with_counts(texts: DataFrame, width: int, frequent: int = FREQUENT) -> DataFrame:
    """``texts`` (see ``summaries``) with n_best and count_sum in place of the packed links; one row for each copy."""
    counted = cut(pair_counts(texts))
    # one row a B id at most, so never more than the vocabulary holds
    best = F.broadcast(counted.groupBy((F.col("pair") % width).alias("b")).agg(F.max("n").alias("most")))
    pairs = counted.join(best, F.col("pair") % width == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    least, rest = most_frequent(counted, "n", frequent)
    heavy = pairs.where(F.col("n") >= least).toArrow()  # at most ``frequent`` rows
    order = np.argsort(heavy["pair"].to_numpy())
    shared = texts.sparkSession.sparkContext.broadcast(tuple(heavy[c].to_numpy()[order] for c in ("pair", "n", "best")))
    names = [f for f in texts.columns if f != "links"]

    def look_up(batches, rest_only: bool):
        pair, count, is_best = shared.value
        for batch in batches:
            sums, other = [], []
            for raw in batch["links"].to_pylist():
                keys, n = unpacked(raw)
                at = np.searchsorted(pair, keys)
                at[at == len(pair)] = 0
                known = pair[at] == keys if len(pair) else np.zeros(len(keys), bool)
                if rest_only:
                    other.append((keys[~known], n[~known]))
                    continue
                n, at = n[known], at[known]
                sums.append((int(n[is_best[at]].sum()), int((n * count[at]).sum())))
            if not rest_only:
                yield pa.RecordBatch.from_arrays([*batch.select(names).columns, *[pa.array([s[i] for s in sums], pa.int64()) for i in (0, 1)]], names=[*names, "n_best", "count_sum"])
                continue
            own = batch.select(ROW).take(pa.array(np.repeat(np.arange(len(other)), [len(k) for k, _ in other])))
            for start in range(0, own.num_rows, ROWS):
                columns = [pa.array(np.concatenate([o[i] for o in other])[start : start + ROWS]) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own.slice(start, ROWS).columns, *columns], names=[*ROW, "pair", "m"])

    fields = {f.name: f"{f.name} {f.dataType.simpleString()}" for f in texts.schema.fields}
    found = texts.mapInArrow(lambda x: look_up(x, False), ", ".join([*[fields[c] for c in names], "n_best bigint", "count_sum bigint"]))
    if rest:
        # a pair beyond the broadcast ones is in few documents, so no key of this join is hot
        open_links = texts.select(*ROW, "links").mapInArrow(lambda x: look_up(x, True), ", ".join([*[fields[c] for c in ROW], "pair bigint", "m bigint"]))
        more = open_links.join(pairs.where(F.col("n") < least), "pair").groupBy(*ROW).agg(F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("more_best"), F.sum(F.col("m") * F.col("n")).alias("more_sum"))
        same = [F.col(f"f.{c}").eqNullSafe(F.col(f"m.{c}")) for c in ROW]
        joined = found.alias("f").join(more.alias("m"), same[0] & same[1] & same[2], "left")
        found = joined.select(*[f"f.{c}" for c in names], *[(F.col(f"f.{c}") + F.coalesce(F.col(f"m.{d}"), F.lit(0))).alias(c) for c, d in (("n_best", "more_best"), ("count_sum", "more_sum"))])
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).drop("copies", "copy", "h", "task")


def align(df: DataFrame, a: str, b: str, doc_id: str = "doc_id", text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """One row per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``a`` is a byte-level BPE file (.json) that encodes space + text, ``b`` a piece model (.model) that adds the space
    itself. Null and empty texts, and texts that the joined bytes of either side's tokens don't give back (such as those with U+2581), have
    no tokens: all numbers 0, the digest ''. Repeated rows are documents each, and count so in the links; null ids are kept. Id
    pairs that tie for the highest count of their B id are all its best. An empty table gives an empty result. Other columns are
    not read. The groups themselves: ``align_groups``.
    """
    texts = cut(summaries(by_document(token_events(df, a, b, doc_id, text)), a, b))
    return with_counts(texts, len(vocabulary(b).tokens), frequent)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", "piece_bpe_32k.model")
