"""Operator 9, best-fit packing by a configuration linear program.

Pieces matter to the packing only by their length, so the driver sees a
histogram of at most ``capacity`` lengths, however many documents there are. A
configuration is a multiset of lengths that fits one sequence. The program
"fewest configurations that cover the histogram" is solved by multiplicative
weights: a length's weight falls with the share of its pieces that is covered, and a
knapsack by dynamic programming prices, for every length as the longest, the configuration
that is worth most under the current weights. The solution is rounded down to whole
numbers of copies; what is left is a smaller program of the same kind, solved and rounded in its
turn. Where nearly all numbers are below one, some configurations are taken once, those with the
longest pieces first. Rounding down wastes volume where most numbers are small. So where the plan has more sequences than a
lower bound on any packing, whole plans follow: the longest pieces left take the configuration that is worth most with them, prices
are found anew as pieces run out, and from plan to plan weights rise by what stays empty beside a length. The
best plan is taken. So every piece, at every size of table, gets its place from a priced configuration.

Copies of a configuration get consecutive sequence numbers, so the solution is a
list of ranges: "ranks ``start .. start + copies - 1`` among the pieces of this length
lie at this offset of sequences ``first ...``". The list's size depends on the
solver's parameters, not on the data. Pieces get their rank within their length
in groups of bounded size: a length with many pieces is dealt out by a hash.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.shared import cut, table, text_or_empty
from quire.llm.token_counts import cuttable, load_tokenizer, unit_encoder
from quire.llm.units import BoundedCache, stretches

#: Tokens of a sequence, and the id that ends a document.
CAPACITY, END = 2048, 0
CACHED = 150_000
#: Of the solver: rounds of a program at most, how fast weights fall, how much hard lengths count besides the length
#: itself and how steeply that rises, a round's bound on the copies of a length (a part of the round's sequences), and the
#: share of what is left that each rounding takes at least.
ROUNDS, RATE, HARD, STEEP, PART, SHARE = 20, 4.0, 1.0, 6, 8, 0.1
#: Of plans rounded longest pieces first: how many at most, in how many parts, and the power of a length that is its first worth.
PLANS, BATCHES, RISING = 2, 40, 1.02
#: Groups in which pieces are ranked: no smaller than this many rows, about so many groups in all.
GROUP_ROWS, GROUPS = 256, 65_536

Configuration = tuple[tuple[int, int], ...]


@dataclass(frozen=True)
class Plan:
    """Where the pieces of each length go: parallel arrays, sorted by (length, start)."""

    length: np.ndarray
    start: np.ndarray
    first_sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence numbers and offsets of pieces, by length and rank (from 0) among the pieces of that length."""
        lo = np.searchsorted(self.length, lengths, "left")
        hi = np.searchsorted(self.length, lengths, "right")
        while (open_ := hi - lo > 1).any():  # a binary search for all pieces at once
            mid = (lo + hi) // 2
            right = open_ & (self.start[np.minimum(mid, len(self.start) - 1)] <= ranks)
            lo, hi = np.where(right, mid, lo), np.where(open_ & ~right, mid, hi)
        return self.first_sequence[lo] + ranks - self.start[lo], self.offset[lo]


class Prices:
    """A knapsack over lengths with bounded numbers of copies; a row of ``took`` for each package (length, copies), shortest first.

    Bounds are split into powers of two, so there are at most ``log2`` packages a length, and a byte of ``took`` for
    each package and each fill.
    """

    def __init__(self, worth: np.ndarray, bound: np.ndarray, capacity: int):
        self.capacity, self.packages = capacity, []
        for length in np.flatnonzero((worth > 0) & (bound > 0)).tolist():
            many, k = min(int(bound[length]), capacity // length), 1
            while many > 0:
                self.packages.append((length, min(k, many)))
                many -= k
                k *= 2
        best = np.zeros(capacity + 1)
        self.took = np.zeros((len(self.packages), capacity + 1), bool)
        #: What the best configuration is worth that has this package and of the others only those before it.
        self.whole = np.empty(len(self.packages))
        for i, (length, k) in enumerate(self.packages):
            size, value = length * k, worth[length] * k
            self.whole[i] = best[capacity - size] + value
            found = best[: capacity + 1 - size] + value
            better = found > best[size:] + 1e-12
            self.took[i, size:] = better
            np.copyto(best[size:], found, where=better)

    def configuration(self, i: int) -> Configuration:
        """The best one whose last package is ``i``."""
        length, k = self.packages[i]
        held, room = Counter({length: k}), self.capacity - length * k
        for j in range(i - 1, -1, -1):
            if room == 0:
                break
            if self.took[j, room]:
                length, k = self.packages[j]
                held[length] += k
                room -= length * k
        return tuple(sorted(held.items(), reverse=True))


def lower_bound(left: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs: the greatest over all t of what the pieces of at least ``t`` need.

    Those over half the capacity can't share a sequence with one another, those over ``capacity - t`` with none; the others of at least
    ``t`` need what volume is left beside the first.
    """
    sizes, half = np.arange(len(left)), capacity // 2
    number, volume = np.cumsum(left), np.cumsum(sizes * left)
    t = np.arange(half + 1)
    large = number[-1] - number[half]
    between = number[capacity - t] - number[half]
    room = between * capacity - (volume[capacity - t] - volume[half])
    small = volume[half] - np.concatenate([[0], volume])[t]
    return int((large + np.maximum(0, -(-(small - room) // capacity))).max())


def longest_first(left: np.ndarray, worth: np.ndarray, capacity: int) -> Counter:
    """Whole copies of priced configurations for all pieces of ``left``: the longest pieces take the configuration that is worth most with
    them, as often as what is left allows; prices are found anew for each of about ``BATCHES`` parts of the volume."""
    left, chosen, sizes = left.copy(), Counter(), np.arange(len(left))
    quota = max(1, int((sizes * left).sum() / capacity / BATCHES))
    while left.any():
        prices, best, given = Prices(worth, left, capacity), {}, 0
        for i, (length, _) in enumerate(prices.packages):
            if length not in best or prices.whole[i] > prices.whole[best[length]] + 1e-12:
                best[length] = i
        for length in sorted(best, reverse=True):
            if given >= quota:
                break
            if not left[length]:
                continue
            conf = prices.configuration(best[length])
            k = min(quota - given, *(int(left[size]) // n for size, n in conf))
            if not k:
                break  # what it was priced with is used up
            chosen[conf] += k
            given += k
            for size, n in conf:
                left[size] -= k * n
    return chosen


def raised(worth: np.ndarray, plan: Counter, capacity: int) -> np.ndarray:
    """Weights of the next plan: a length's weight rises with the share that stays empty of the sequences that hold it."""
    empty, many = np.zeros(len(worth)), np.zeros(len(worth))
    for conf, k in plan.items():
        room = 1 - sum(length * n for length, n in conf) / capacity
        for length, n in conf:
            empty[length] += room * n * k
            many[length] += n * k
    return worth * np.exp(np.divide(empty, many, out=np.zeros(len(worth)), where=many > 0))


def fractional(left: np.ndarray, base: np.ndarray, hard: np.ndarray, capacity: int, rounds: int) -> dict[Configuration, float]:
    """A fractional packing of ``left`` (how many pieces of each length, from 0) by multiplicative weights.

    A length is worth ``base``, and a part of that more which is ``hard`` at first and falls by the share of its pieces
    that is covered. A round gives an even part of all sequences
    to the configurations that are worth most, within the pieces that are not covered yet.
    """
    sizes, held, open_ = np.arange(len(left)), left > 0, left.astype(float)
    quota = (sizes * left).sum() / capacity / rounds
    copies: dict[Configuration, float] = {}
    for _ in range(rounds):
        live = open_ > 1e-6 * left.max()
        if not live.any():
            break
        share = np.divide(open_, left, out=np.zeros(len(left)), where=held)
        worth = np.where(live, base * (1 + hard * np.exp(RATE * (share - share[live].max()))), 0.0)
        bound = np.where(live, np.maximum(1, left // max(1.0, quota / PART)), 0).astype(np.int64)
        prices, given = Prices(worth, bound, capacity), 0.0
        for i in np.argsort(-prices.whole, kind="stable").tolist():
            if given >= quota:
                break
            length = prices.packages[i][0]
            if open_[length] <= 0:
                continue
            conf = prices.configuration(i)
            step = min(quota - given, max(quota / 64, left[length] / rounds), *(open_[size] / n for size, n in conf))
            if step > 0:
                copies[conf] = copies.get(conf, 0.0) + step
                given += step
                for size, n in conf:
                    open_[size] -= n * step
    return copies


def round_down(copies: dict[Configuration, float], left: np.ndarray, capacity: int) -> list[tuple[Configuration, int]]:
    """Whole numbers of copies within ``left``, from which they are taken.

    Where that is less than ``SHARE`` of what is left, further ones are taken once each, those with the longest pieces first.
    """
    wanted, out = SHARE * (np.arange(len(left)) * left).sum() / capacity, []

    def take(conf: Configuration, most: int) -> int:
        k = min(most, *(int(left[length]) // n for length, n in conf))
        if k:
            out.append((conf, k))
            for length, n in conf:
                left[length] -= k * n
        return k

    given = sum(take(conf, int(copies[conf])) for conf in sorted(copies, key=lambda c: (-copies[c], c)))
    for conf in sorted(copies, key=lambda c: [(-length, -n) for length, n in c]):
        if given >= wanted:
            break
        given += take(conf, 1)
    return out


def rounded(left: np.ndarray, base: np.ndarray, hard: np.ndarray, capacity: int) -> Counter:
    """Copies of configurations for all pieces of ``left``; each program leaves less to the next."""
    left, chosen = left.copy(), Counter()
    while left.any():
        need = (np.arange(len(left)) * left).sum() / capacity
        for conf, k in round_down(fractional(left, base, hard, capacity, max(2, min(ROUNDS, int(need / 8) + 1))), left, capacity):
            chosen[conf] += k
    return chosen


def configurations(left: np.ndarray, capacity: int) -> list[tuple[Configuration, int]]:
    """Configurations with their copies for all pieces of ``left``; where rounding down leaves more of them than any packing needs,
    the best of that plan and up to ``PLANS`` that are rounded longest pieces first."""
    sizes, least = np.arange(len(left)), lower_bound(left, capacity)
    plan = rounded(left, sizes.astype(float), HARD * (sizes / capacity) ** STEEP, capacity)
    worth = (sizes / capacity) ** RISING
    for _ in range(PLANS):
        if plan.total() <= least:
            break
        other = longest_first(left, worth, capacity)
        plan, worth = min(plan, other, key=Counter.total), raised(worth, other, capacity)
    return sorted(plan.items(), reverse=True)


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """A plan for the whole histogram, as ranges of ranks."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    whole = [(((capacity, 1),), int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    chosen = whole + configurations(left, capacity)
    ranked, ranges, sequences = Counter(), [], 0
    for conf, k in chosen:
        offset = 0
        for length, n in conf:
            for _ in range(n):
                ranges.append((length, ranked[length], sequences, offset))
                ranked[length] += k
                offset += length
        sequences += k
    ranges.sort()
    columns = np.array(ranges, np.int64).reshape(-1, 4).T
    return Plan(*(np.ascontiguousarray(c) for c in columns), sequences)


def piece_documents(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces; the first of a document that is cut takes what is over."""
    own = df.select(text_or_empty(text).alias("text"), F.col(doc_id).alias("doc_id"))
    kind = own.schema["doc_id"].dataType.simpleString()
    by_unit = cuttable(load_tokenizer(tokenizer))

    def pieces(batches):
        cache, tail = BoundedCache(CACHED), np.array([end], "<u4").tobytes()
        encoder = unit_encoder(tokenizer) if by_unit else None
        encode = None if by_unit else whole_encoder(tokenizer)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, one in enumerate(batch.column(0).to_pylist()):
                parts = [encoder.stretch_ids(s, cache) for s in stretches(one)] if by_unit else encode([one])
                ids = memoryview(b"".join([*parts, tail]))
                n = len(ids) // 4
                at, number = 0, 0
                while at < n:
                    size = ((n - 1) % capacity + 1) if at == 0 else capacity
                    row.append(i), piece.append(number), start.append(at), length.append(size)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                    at, number = at + size, number + 1
            owner = batch.column(1).take(pa.array(row, pa.int64()))
            numbers = [pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays([owner, *numbers], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return own.mapInArrow(pieces, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def whole_encoder(tokenizer: str):
    """Encodes texts that can't be cut into units; the tokenizer is read once."""
    loaded = load_tokenizer(tokenizer)
    return lambda texts: [np.array(x.ids, "<u4").tobytes() for x in loaded.encode_batch_fast(texts, add_special_tokens=False)]


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS, groups: int = GROUPS) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ...) with sequence_id and offset; columns of these two names are replaced.

    Lengths are 1 to ``capacity``. Equal pieces, also of repeated rows, get places
    each; ties are broken by doc_id and piece. An empty table gives an empty result. Other columns,
    whatever their names, are handed on.
    """
    names = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    # columns by number, as a function over batches can't be given names of every kind
    held = cut(pieces.select("doc_id", "piece", "length", *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]))
    histogram = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.count("*").alias("n")).collect()}
    size = max(group_rows, sum(histogram.values()) // groups)
    dealt = [max(1, -(-histogram.get(length, 0) // size)) for length in range(capacity + 1)]
    salted = held.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece"), F.element_at(F.lit(dealt), (F.col("length") + 1).cast("int"))).cast("int"))
    before, running = {}, Counter()
    counts = salted.groupBy("length", "group").agg(F.count("*").alias("n")).collect()  # about ``groups`` rows at most, and one a length
    for r in sorted(counts):
        before[r["length"], r["group"]] = running[r["length"]]
        running[r["length"]] += r["n"]
    keys = sorted(before)
    base = np.cumsum([0, *dealt])  # (length, group) as one number
    offsets = np.zeros(int(base[-1]), np.int64)
    for length, group in keys:
        offsets[base[length] + group] = before[length, group]
    known = pieces.sparkSession.sparkContext.broadcast((solve(histogram, capacity), base, offsets))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "group").orderBy("doc_id", "piece")))
    numbered = [f"c{i}" for i in range(len(names))]

    def place(batches):
        plan, base, offsets = known.value
        for batch in batches:
            length, group, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "group", "rank"))
            sequence, offset = plan.place(length, offsets[base[length] + group] + rank - 1)
            kept = [batch.column(batch.schema.get_field_index(c)) for c in numbered]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*numbered, "sequence_id", "offset"])

    fields = ", ".join(f"{c} {held.schema[c].dataType.simpleString()}" for c in numbered)
    return ranked.mapInArrow(place, f"{fields}, sequence_id bigint, offset bigint").toDF(*names, "sequence_id", "offset")


def pack_documents(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents as pieces in sequences. Null texts count as empty: a piece of the end id alone. Other columns are not read."""
    return pack_pieces(piece_documents(df, tokenizer, capacity, end, doc_id, text), capacity)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), "byte_bpe_50k.json")
