"""Operator 5, quality classifier: Bradley-Terry ranking on pairs of labelled documents.

Every document gets features of its whole text in one pass. In every pair (better, worse)
of labelled rows "better is preferred" with the probability
``sigmoid(w . (x_better - x_worse))``, whose mean logistic loss over all pairs gives ``w``. A
Newton step takes one pass over the labelled rows: tasks add up first and second moments of the rows by label and
cell of strength, in whole numbers, and all pairs of two cells have the strengths of the cells' means. A
document's strength is ``w . x``. The threshold is a quantile of the strengths of all
rows it was learned from: the share of worse ones among them, found by narrowing a histogram. Strengths become scores by a
logistic curve that passes through ``CUT`` at that threshold, so that "score >= CUT"
says "above the quantile".
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from quire.llm.shared import cut, table, text_hash, text_or_empty

#: A score that counts as good.
CUT = 0.3
#: Of the fit: Newton steps at most, the weight of the squared norm, cells of strength.
STEPS, RIDGE, CELLS = 12, 1e-3, 256
#: Features are added up as multiples of 1 / UNIT, so that sums do not depend on their order.
UNIT = 1 << 16
#: Rows whose moments are made at a time; strengths that may come to the driver, and cells of a histogram of them.
ROWS_AT_A_TIME, FEW, BINS = 4096, 4096, 4096
#: Characters of a text that are looked at together.
STRETCH = 1 << 20

NAMES = (
    "lower", "upper", "digits", "white", "lines", "bang", "pipe", "symbols", "other_marks", "stops", "beyond_ascii", "long_runs",
    "repeated_neighbours", "distinct_words", "capital_words", "word_length", "log_words", "empty",
)
_WHITE = re.compile(r"\s")
_MARKS = re.compile(r"([!?#$%&*|=_~^<>{}\[\]\\/+@-])\1\1")


def _share(counts: np.ndarray, letters: str) -> int:
    return int(counts[np.frombuffer(letters.encode(), np.uint8)].sum())


def stretches(text: str, size: int) -> Iterator[str]:
    """``text`` in stretches of about ``size`` characters that begin at white space, so that no word or run of marks is cut."""
    at = 0
    while len(text) - at > size and (cut := _WHITE.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def features(text: str, stretch: int = STRETCH) -> list[float]:
    """Shares of kinds of characters and words; square roots make small shares tell.

    Long texts are looked at in stretches, all of them; the features don't depend on these. Distinct words of a text of
    several stretches are counted by 64-bit hashes.
    """
    n_bytes = n_words = same = distinct = capital = letters = runs = 0
    counts, before, hashes = np.zeros(256, np.int64), None, []
    for part in stretches(text, stretch):
        raw = part.encode("utf-8", "replace")
        counts += np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        words = part.split()
        n_bytes, n_words, letters = n_bytes + len(raw), n_words + len(words), letters + sum(map(len, words))
        same += sum(map(str.__eq__, words, words[1:])) + (bool(words) and words[0] == before)
        own = set(words)
        distinct += len(own)
        hashes.append(np.fromiter(map(hash, own), np.int64, len(own)))
        before = words[-1] if words else before
        capital += sum(map(str.isupper, words))
        runs += len(_MARKS.findall(part))
    if len(hashes) > 1:
        distinct = len(np.unique(np.concatenate(hashes)))
    size, many = max(n_bytes, 1), max(n_words, 1)
    marks = [
        int(counts[97:123].sum()), int(counts[65:91].sum()), int(counts[48:58].sum()), _share(counts, " \t\r"), int(counts[10]), _share(counts, "!"),
        _share(counts, "|"), _share(counts, "#$%&*"), _share(counts, "()[]{}<>=+_~^/\\@\"':;-"), _share(counts, ".,"), int(counts[128:].sum()),
    ]
    return [
        *(math.sqrt(x / size) for x in marks), math.sqrt(min(1.0, runs / many)), math.sqrt(same / many), distinct / many / (1 + math.log1p(n_words) / 10),
        math.sqrt(capital / many), math.log1p(letters / many), math.log1p(n_words), float(n_words == 0),
    ]


def featured(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, h, x) a row: the hash of the text and an array of doubles."""
    own = df.select(text_or_empty(text).alias("text"), F.col(doc_id).alias("doc_id"), text_hash(text).alias("h"))

    def work(batches):
        for batch in batches:
            rows = [features(x.as_py()) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "h", "x"])

    return own.mapInArrow(work, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, h bigint, x array<double>")


@dataclass(frozen=True)
class Model:
    """Score = sigmoid(slope * (weights . x - threshold) + logit(CUT)); ``weights`` apply to plain features."""

    weights: tuple[float, ...]
    threshold: float
    slope: float

    def score(self, x: str = "x"):
        return 1.0 / (1.0 + F.exp(-(self.slope * (strength(self.weights, x) - self.threshold) + math.log(CUT / (1 - CUT)))))


_UPPER = np.triu_indices(len(NAMES))


def strengths(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Added up feature by feature, so that a row's does not depend on other rows."""
    total = np.zeros(len(x))
    for j, w in enumerate(weights):
        total += x[:, j] * w
    return total


def moments(x: np.ndarray, good: np.ndarray, weights: np.ndarray, centre: float, spread: float, cells: int) -> np.ndarray:
    """(2 * cells, ...) whole numbers: rows, sums of features and of their products by cell of strength and label."""
    total = np.zeros((2 * cells, 1 + len(NAMES) + len(_UPPER[0])), np.int64)
    for at in range(0, len(x), ROWS_AT_A_TIME):
        own = x[at : at + ROWS_AT_A_TIME]
        place = 1 / (1 + np.exp(-np.clip((strengths(own, weights) - centre) / spread, -40, 40))) if spread > 0 else np.zeros(len(own))
        slot = 2 * np.minimum((place * cells).astype(np.int64), cells - 1) + good[at : at + ROWS_AT_A_TIME]
        v = np.rint(own * UNIT).astype(np.int64)
        block, order = np.concatenate([np.ones((len(v), 1), np.int64), v, v[:, _UPPER[0]] * v[:, _UPPER[1]]], axis=1), np.argsort(slot, kind="stable")
        found, starts = np.unique(slot[order], return_index=True)
        total[found] += np.add.reduceat(block[order], starts, axis=0)
    return total


def fitted(measure: Callable[[np.ndarray, float, float], np.ndarray], ranked: Callable[[np.ndarray, int], float]) -> Model:
    """The model; ``measure(weights, centre, spread)`` gives the moments of all rows, ``ranked(weights, k)`` the k-th least strength (from 0)."""
    d = len(NAMES)

    def parts(sums: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of worse and better rows: counts, sums and products of the cells that have some."""
        out = []
        for label in (0, 1):
            own = sums[label::2]
            own = own[own[:, 0] > 0].astype(float)
            square = np.zeros((len(own), d, d))
            square[:, _UPPER[0], _UPPER[1]] = square[:, _UPPER[1], _UPPER[0]] = own[:, 1 + d :] / UNIT**2
            out.append((own[:, 0], own[:, 1 : 1 + d] / UNIT, square))
        return out

    worse, better = now = parts(measure(np.zeros(d), 0.0, 0.0))
    n_worse, n_better = worse[0].sum(), better[0].sum()
    if not n_worse or not n_better:
        return Model((0.0,) * d, 0.0 if n_worse + n_better == 0 else -1.0 if n_better else 1.0, 1.0)
    mean = sum(part[1].sum(axis=0) for part in now) / (n_worse + n_better)
    spread = sum(part[2].sum(axis=0) for part in now) / (n_worse + n_better) - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(spread), 0)) + 1e-6
    w = np.zeros(d)
    for step in range(STEPS):  # Newton's method on the mean logistic loss of all pairs
        raw = w / scale
        if step:
            now = parts(measure(raw, float(mean @ raw), math.sqrt(max(raw @ spread @ raw, 0.0))))
        (n_e, x_e, s_e), (n_c, x_c, s_c) = ((n, x / scale, s / np.outer(scale, scale)) for n, x, s in now)
        p = 1 / (1 + np.exp(-np.clip((x_c @ w / n_c)[:, None] - (x_e @ w / n_e)[None, :], -40, 40)))
        v, pairs = p * (1 - p), n_worse * n_better
        gradient = (((p - 1) @ n_e) @ x_c - (n_c @ (p - 1)) @ x_e) / pairs + RIDGE * w
        both = x_c.T @ v @ x_e
        hessian = (np.tensordot(v @ n_e, s_c, 1) + np.tensordot(n_c @ v, s_e, 1) - both - both.T) / pairs + RIDGE * np.eye(d)
        change = np.linalg.solve(hessian, gradient)
        w -= change
        if np.abs(change).max() < 1e-7:
            break
    raw = w / scale
    # The quantile at the share of worse rows, in the middle of the gap there.
    k = int(n_worse)
    threshold = (ranked(raw, k - 1) + ranked(raw, k)) / 2

    def middle(n: np.ndarray, x: np.ndarray) -> float:
        """The median by cells."""
        own = x @ raw / n
        order = np.argsort(own, kind="stable")
        return float(own[order][np.searchsorted(np.cumsum(n[order]), n.sum() / 2)])

    apart = middle(*now[1][:2]) - middle(*now[0][:2])
    return Model(tuple(raw.tolist()), threshold, 8.0 / max(abs(apart), 1e-6))


def bradley_terry(x: np.ndarray, good: np.ndarray, cells: int = CELLS) -> Model:
    """Learns from features and labels (true: better). With one label only all documents get it; without any all pass, with the score ``CUT``."""
    return fitted(lambda w, centre, spread: moments(x, good.astype(np.int64), w, centre, spread, cells), lambda w, k: float(np.partition(strengths(x, w), k)[k]))


def labelled(x: DataFrame, labels: DataFrame) -> DataFrame:
    """(x, good): the rows that are learned from, each id and label once, with its least features; null labels and ids don't count."""
    known = labels.select("doc_id", F.col("quality").alias("quality")).where("quality is not null").where(~held_out()).distinct()
    return x.join(known, "doc_id").groupBy("doc_id", "quality").agg(F.min("x").alias("x")).select("x", (F.col("quality") == 1).cast("bigint").alias("good"))


def learn(x: DataFrame, labels: DataFrame, cells: int = CELLS) -> Model:
    """From ``x`` (doc_id, x) and ``labels`` (doc_id, quality). Rows with a null label or id don't count.

    Only rows whose crc32(doc_id as text) mod 5 is not 0 are learned from, all of
    them. A repeated id counts once, with its least features.
    """
    known = cut(labelled(x, labels))

    def measure(weights: np.ndarray, centre: float, spread: float) -> np.ndarray:
        def own(batches):
            total = np.zeros((2 * cells, 1 + len(NAMES) + len(_UPPER[0])), np.int64)
            for batch in batches:
                rows = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
                total += moments(rows, batch.column(1).to_numpy(zero_copy_only=False), weights, centre, spread, cells)
            held = np.flatnonzero(total[:, 0])
            yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(list(total[held]), pa.list_(pa.int64()))], names=["slot", "sums"])

        def together(rows: pa.Table) -> pa.Table:
            whole = np.array(rows["sums"].to_pylist(), object).sum(axis=0)  # may be too large for 64 bits
            return pa.table({"slot": rows["slot"][:1], "sums": pa.array([[float(n) for n in whole]], pa.list_(pa.float64()))})

        out = np.zeros((2 * cells, 1 + len(NAMES) + len(_UPPER[0])))
        for r in known.mapInArrow(own, "slot bigint, sums array<bigint>").groupBy("slot").applyInArrow(together, "slot bigint, sums array<double>").collect():
            out[r["slot"]] = r["sums"]
        return out

    return fitted(measure, lambda weights, k: ranked(known.select(strength(weights).alias("s")), k))


def strength(weights: Iterable[float], x: str = "x") -> Column:
    return F.aggregate(F.zip_with(F.col(x), F.lit([float(w) for w in weights]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)


def ranked(values: DataFrame, k: int) -> float:
    """The k-th least (from 0) of the doubles s, exactly: a histogram is narrowed to the cell that holds it, until few are left."""
    low, high = values.agg(F.min("s"), F.max("s")).first()
    while low < high:
        inside = values.where(F.col("s").between(low, high))
        cell = F.least(F.floor((F.col("s") - low) / (high - low) * BINS), F.lit(BINS - 1))
        for r in inside.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min("s").alias("low"), F.max("s").alias("high")).orderBy("cell").collect():
            if k < r["n"]:
                break
            k -= r["n"]
        low, high = r["low"], r["high"]
        if low < high and r["n"] <= FEW:
            return sorted(x["s"] for x in values.where(F.col("s").between(low, high)).collect())[k]
    return low


def held_out():
    """crc32 of the id in decimal, mod 5, is 0; null ids count as held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))


def score_documents(df: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``df``: doc_id, held_out, score, predicted (1 if score >= 0.3), h (a hash of the text).

    Null texts count as empty and are scored like any. Repeated rows get equal
    scores, and so do equal texts; there are no ties to break. An empty table gives an empty result; columns other than
    doc_id and text are not read.
    """
    x = cut(featured(df))
    model = learn(x, labels)
    return x.select("doc_id", held_out().alias("held_out"), model.score().alias("score"), "h").withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def keep_good(df: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``df`` that are predicted good, with their own columns.

    Every row is judged by its own text: of rows that share an id those with rejected texts go, rows without an
    id are judged as all others, repeated rows stay or go together. Features are made twice, for what is learned from and in the narrow pass that scores and keeps rows; no text is shuffled or written. Null texts count as empty. An empty table gives an
    empty result; other columns may have any names.
    """
    model = learn(featured(df.select("doc_id", "text").where(~held_out())), labels)
    # columns by number, as a function over batches can't be given names of every kind
    names = df.columns
    own = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], text_or_empty().alias("text"))
    kept = StructType([*own.schema.fields[:-1], StructField("x", ArrayType(DoubleType()))])

    def work(batches):
        for batch in batches:
            rows = [features(x.as_py()) for x in batch.column(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, pa.list_(pa.float64()))], names=kept.names)

    return own.mapInArrow(work, kept).where(model.score() >= CUT).drop("x").toDF(*names)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("h")
