"""Operator 10, BPE encoding and decoding by forced boundaries.

A pair of bytes that stands inside no token of the vocabulary can never be
merged over, so the place between the two bytes is a cut whatever stands around
it. Pre-tokens are cut at all such places, the fragments are encoded each for
itself by merges in rank order, and the ids are concatenated. Fragments are
short and repeat, so a worker keeps those it has met.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.shared import table, text_or_empty, tokenizer_path
from quire.llm.units import PATTERN, byte_letters, stretches, units

#: Entries of each of a worker's caches: fragments, and units of text.
CACHED = 150_000


class Remembered(dict):
    """Values by key, made when they are first asked for; emptied when full. Long keys are not kept."""

    def __init__(self, make: Callable, limit: int, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest = make, limit, longest

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


class ForcedBoundaryBpe:
    """A byte-level BPE tokenizer read from a ``tokenizers`` file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"] or spec["normalizer"] or model["ignore_merges"]:
            raise ValueError("only plain byte-level BPE files are read here")
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"]):
            raise ValueError("added tokens that take in their surroundings are not read here")
        self.ids = {raw(k): v for k, v in model["vocab"].items() if k not in self.added}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {(raw(a), raw(b)): i for i, (a, b) in enumerate(merges)}
        self.tokens = [b""] * (1 + max([*self.ids.values(), *self.added.values()]))
        for token, i in [*self.ids.items(), *((k.encode(), v) for k, v in self.added.items())]:
            self.tokens[i] = token
        self.decimal = [str(i) for i in range(len(self.tokens))]
        inner = {(a, b) for t in self.ids for a, b in zip(t, t[1:])}
        self.forced = frozenset((a, b) for a in range(256) for b in range(256) if (a, b) not in inner)
        self.fragment_ids = self._by_rank([raw(a) + raw(b) for a, b in merges]) or self.merge
        self.split_words = regex.compile(PATTERN).findall
        # longest first, as one added token may begin with another
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else lambda x: [x]
        self.by_unit = not any(k.split() != [k] for k in self.added)
        self.fragments = Remembered(lambda fragment: tuple(self.fragment_ids(fragment)), CACHED)
        self.by_text = Remembered(self._encode, CACHED)

    def _by_rank(self, merged: list[bytes]) -> Callable[[bytes], list[int]] | None:
        """tiktoken's encoder of single fragments, where ids are in the order of the merges; it does what ``merge`` does, in native code."""
        order = [self.ids[m] for m in merged]
        if order != sorted(set(order)) or order and order[0] < 256 or any(self.ids.get(bytes([b]), 256) >= 256 for b in range(256)):
            return None
        import tiktoken

        return tiktoken.Encoding("fragments", pat_str=PATTERN, mergeable_ranks=self.ids, special_tokens={})._encode_single_piece

    def cut(self, word: bytes) -> list[bytes]:
        """``word`` cut between all two bytes that no token has side by side."""
        forced = self.forced
        if forced.isdisjoint(zip(word, word[1:])):
            return [word]
        at = [0, *[i for i, pair in enumerate(zip(word, word[1:]), 1) if pair in forced], len(word)]
        return [word[i:j] for i, j in zip(at, at[1:])]

    def merge(self, fragment: bytes) -> tuple[int, ...]:
        """Merges by lowest rank first, all places of that pair from left to right."""
        if (whole := self.ids.get(fragment)) is not None and len(fragment) == 1:
            return (whole,)
        parts, ranks = [fragment[i : i + 1] for i in range(len(fragment))], self.ranks
        if len(parts) > 64:
            return self._merge_long(parts)
        while len(parts) > 1:
            best = min(zip(parts, parts[1:]), key=lambda pair: ranks.get(pair, 1 << 40))
            if best not in ranks:
                break
            parts = self._joined(parts, best)
        return tuple(self.ids[p] for p in parts)

    @staticmethod
    def _joined(parts: list[bytes], pair: tuple[bytes, bytes]) -> list[bytes]:
        out, i, last = [], 0, len(parts) - 1
        while i <= last:
            if i < last and (parts[i], parts[i + 1]) == pair:
                out.append(parts[i] + parts[i + 1])
                i += 2
            else:
                out.append(parts[i])
                i += 1
        return out

    def _merge_long(self, parts: list[bytes]) -> tuple[int, ...]:
        """The same with a heap of pairs, for fragments so long that looking over all pairs each time would be quadratic."""
        from heapq import heapify, heappop, heappush

        n, ranks = len(parts), self.ranks
        left, right, alive = [i - 1 for i in range(n)], [i + 1 for i in range(n)], [True] * n
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
        heapify(heap)
        while heap:
            _, i, a, b = heappop(heap)
            j = right[i] if alive[i] else n
            if j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], right[i] = a + b, False, right[j]
            if right[j] < n:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y < n and (r := ranks.get((parts[x], parts[y]))) is not None:
                    heappush(heap, (r, x, parts[x], parts[y]))
        return tuple(self.ids[p] for p, live in zip(parts, alive) if live)

    def _words(self, text: str) -> list[str]:
        # a space and Latin letters are one pre-token; the pattern is asked about all else
        if text[:1] == " " and text[1:].isalpha() and (text.isascii() or max(text) < "\u0250"):
            return [text]
        return self.split_words(text)

    def _encode(self, text: str) -> tuple[int, ...]:
        out: list[int] = []
        for piece in self.split_added(text) if any(a in text for a in self.added) else (text,):
            if piece in self.added:
                out.append(self.added[piece])
                continue
            for word in self._words(piece):
                for fragment in self.cut(word.encode("utf-8")):
                    out.extend(self.fragments[fragment])
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        if not self.by_unit:
            return list(self._encode(text))
        return list(chain.from_iterable(ids for stretch in stretches(text) for ids in map(self.by_text.__getitem__, units(stretch))))

    def decode(self, ids: list[int]) -> str:
        """Bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(name: str) -> ForcedBoundaryBpe:
    """Kept for the worker's next tasks, with what its caches hold."""
    return ForcedBoundaryBpe(name if os.path.isabs(name) else tokenizer_path(name))


def encode_documents(df: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: doc_id, ids (array of int) and decoded (the text that the ids stand for).

    Null texts count as empty (no ids). Repeated rows and null ids are kept, an
    empty table gives an empty result; other columns are not read.
    """
    return _mapped(df, tokenizer, doc_id, text, "ids array<int>, decoded string", lambda bpe, ids: (ids, bpe.decode(ids)), (pa.list_(pa.int32()), pa.string()))


def digest_documents(df: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """As ``encode_documents``, but n_tokens, ids_sha256 (decimal ids joined by commas) and decoded_sha256."""

    def digest(bpe: ForcedBoundaryBpe, ids: list[int]):
        joined = ",".join(map(bpe.decimal.__getitem__, ids))
        return len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(bpe.decode(ids).encode("utf-8")).hexdigest()

    return _mapped(df, tokenizer, doc_id, text, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", digest, (pa.int64(), pa.string(), pa.string()))


def _mapped(df, tokenizer, doc_id, text, columns, make, kinds) -> DataFrame:
    own = df.select(text_or_empty(text).alias("text"), F.col(doc_id).alias("doc_id"))

    def work(batches):
        bpe = load(tokenizer)
        for batch in batches:
            rows = [make(bpe, bpe.encode(x.as_py())) for x in batch.column(0)]
            arrays = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(1), *arrays], names=["doc_id", *[c.split()[0] for c in columns.split(", ")]])

    return own.mapInArrow(work, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, {columns}")


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents"), "byte_bpe_50k.json")
