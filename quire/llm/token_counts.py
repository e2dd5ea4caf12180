"""Operator 1, token counts: a two-tier lookup on the map side.

Tier one is a compact table from frequent pre-tokens (units, see ``units``) to
their number of tokens, broadcast to all workers. Tier two is a bounded cache in each worker for
all others, filled by the tokenizers library. No pre-token is ever shuffled: each
task sums its rows up in a Misra-Gries summary, and these, a row of bounded size a task,
are merged in two steps. Units of more than ``LONGEST`` characters are in no
summary, table or cache. The tables only save work; counts do not depend on what
is in them, so equally frequent units need no order.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.shared import table, text_or_empty, tokenizer_path
from quire.llm.units import LONGEST, BoundedCache, UnitEncoder, stretches, units

#: Pre-tokens that a task's summary holds at most while counting, and hands on.
SUMMARY, REPORTED = 100_000, 2000
#: Pre-tokens in merged summaries and the broadcast table (16,384 of at most 64 characters), and in a worker's own cache.
FREQUENT, CACHED = 16_384, 200_000
#: Into how many groups the tasks' summaries are merged first.
FAN_IN = 64
#: A text with more tokens is over the limit.
LIMIT = 512


def load_tokenizer(name: str):
    """The tokenizer without truncation, padding and threads; a path, or a name of an installed vocabulary."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(name if os.path.isabs(name) else tokenizer_path(name))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache(maxsize=2)
def unit_encoder(name: str) -> UnitEncoder:
    """Kept for the worker's next tasks."""
    return UnitEncoder(load_tokenizer(name))


def cuttable(tokenizer) -> bool:
    """Whether texts may be encoded unit by unit: a byte-level pattern, nothing rewritten, no added token with white space."""
    import json

    spec = json.loads(tokenizer.to_str())
    before, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    plain = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not spec.get("normalizer")
    return bool(plain) and not any(x["content"].split() != [x["content"]] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in added)


def _rows(batch: pa.RecordBatch) -> list[str]:
    return batch.column(0).to_pylist()


def shrink(held: Counter, most: int) -> Counter:
    """The Misra-Gries step: the same is taken from all counters, so that at most ``most`` are left."""
    if len(held) <= most:
        return held
    least = sorted(held.values(), reverse=True)[most]
    return Counter({k: v - least for k, v in held.items() if v > least})


def summary_row(number: int, held: Counter) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((number, list(held), list(held.values())), kinds)], names=["part", "units", "counts"])


SUMMARY_ROW = "part bigint, units array<string>, counts array<bigint>"


def frequent_units(texts: DataFrame, summary: int = SUMMARY, reported: int = REPORTED, frequent: int = FREQUENT) -> list[str]:
    """The most frequent units, by Misra-Gries summaries of all rows; at most ``frequent`` come to the driver."""

    def summarise(batches):
        from pyspark import TaskContext

        held: Counter = Counter()
        for batch in batches:
            for text in _rows(batch):
                for stretch in stretches(text):
                    held.update(u for u in units(stretch) if len(u) <= LONGEST)
                    if len(held) > 2 * summary:
                        held = shrink(held, summary)
        if held:
            yield summary_row(TaskContext.get().partitionId(), shrink(held, reported))

    def merge(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in rows:
            for found, counts in zip(batch["units"].to_pylist(), batch["counts"].to_pylist()):
                for k, v in zip(found, counts):
                    held[k] += v
                held = shrink(held, frequent)
        yield summary_row(key[0].as_py(), held)

    some = texts.mapInArrow(summarise, SUMMARY_ROW).groupBy((F.col("part") % FAN_IN).alias("some")).applyInArrow(merge, SUMMARY_ROW)
    whole = some.groupBy((F.col("part") * 0).alias("all")).applyInArrow(merge, SUMMARY_ROW).first()
    return whole["units"] if whole else []


def whole_counter(tokenizer: str):
    """Counts the tokens of texts that can't be cut into units; the tokenizer is read once."""
    loaded = load_tokenizer(tokenizer)
    return lambda texts: [len(x.ids) for x in loaded.encode_batch_fast(texts, add_special_tokens=False)]


def count_tokens(df: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per row: doc_id, n_bytes, n_tokens, over_limit.

    Null texts count as empty (0 bytes, 0 tokens). Repeated rows and ids are each
    counted, null ids are kept; there are no ties. An empty table gives an empty result. Other
    columns are not read.
    """
    own = df.select(text_or_empty(text).alias("text"), F.col(doc_id).alias("doc_id"))
    loaded = load_tokenizer(tokenizer)
    by_unit = cuttable(loaded)
    first: list[str] = frequent_units(own.select("text")) if by_unit else []
    lengths = unit_encoder(tokenizer).counts(first) if first else []
    broadcast = df.sparkSession.sparkContext.broadcast(dict(zip(first, lengths, strict=True)))

    def count(batches):
        cache = BoundedCache(CACHED, broadcast.value)
        encode = unit_encoder(tokenizer).counts if by_unit else whole_counter(tokenizer)
        for batch in batches:
            counts = []
            for one in _rows(batch):
                total = 0
                for stretch in stretches(one) if by_unit else ():
                    total += sum(cache.values_of(units(stretch), encode))
                counts.append(total if by_unit else encode([one])[0])
            n_bytes = pa.compute.cast(pa.compute.binary_length(batch.column(0)), pa.int64())
            n_tokens = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(1), n_bytes, n_tokens, pa.compute.greater(n_tokens, limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(count, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), "byte_bpe_50k.json")
