"""Quality scores by a factorisation machine over hashed words, structure statistics and size metadata.

score = sigmoid(b + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)): all pairs of
features interact through vectors of rank ``rank``, in time linear in a text's distinct words.

Defined results: null and empty texts have only the statistics' zero values and still get a
score; repeated rows score alike; without a usable label every score is 0.5; labels, language, source and id never enter; of several labels of an
id the least counts; a null id is in no held-out fold; an empty table gives no rows; a text of any length is read whole; other columns, whatever
their names, pass unread.  The sample that a machine is fitted on holds TRAIN_ROWS documents at most, as hashed words: some hundred
bytes a distinct word, so several hundred megabytes if all of them are very long.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.folds import held_out, labelled_sample
from tallyspark.llm.statistics import FEATURES, counts, features
from tallyspark.llm.text_arrays import Texts, map_texts, pieces, quoted, row_of

#: Labelled documents that a model is fitted on at most.
TRAIN_ROWS = 6000
WORD_BUCKETS = 1 << 14


@dataclass
class Sparse:
    """Rows of (index, value) pairs: row i has the entries first[i]..first[i+1]."""

    index: np.ndarray
    value: np.ndarray
    first: np.ndarray

    def rows(self, chosen: np.ndarray) -> Sparse:
        sizes = np.diff(self.first)[chosen]
        to = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(to[-1]) + np.repeat(self.first[chosen] - to[:-1], sizes)
        return Sparse(self.index[at], self.value[at], to)


def word_features(piece: Texts) -> Sparse:
    """Damped counts of hashed words, each text scaled to length one."""
    _, _, first = piece.words()
    keys = (row_of(first) * WORD_BUCKETS) | (piece.word_hashes() >> np.uint64(50)).astype(np.int64)
    keys, n = np.unique(keys, return_counts=True)
    row, value = keys // WORD_BUCKETS, np.log1p(n)
    size = np.sqrt(np.bincount(row, value**2, minlength=len(piece)))
    return Sparse(keys % WORD_BUCKETS, (value / size[row]).astype(np.float32), np.searchsorted(row, np.arange(len(piece) + 1)))


@dataclass
class Machine:
    """Weights; indices from WORD_BUCKETS on are the statistics, shifted and scaled by ``mean`` and ``scale``."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def scaled(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.scale, -4, 4).astype(np.float32) / np.sqrt(len(FEATURES)).astype(np.float32)

    def raw(self, words: Sparse, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the sigmoid, and the sums of v_if x_i."""
        n, row = len(stats), row_of(words.first)
        wide = self.scaled(stats)
        v, v2 = self.factors[words.index], self.factors[WORD_BUCKETS:]
        xv = v * words.value[:, None]
        sums = np.stack([np.bincount(row, xv[:, f], minlength=n) for f in range(v.shape[1])], axis=1) + wide @ v2
        squares = np.bincount(row, (xv * xv).sum(axis=1), minlength=n) + (wide**2) @ (v2**2).sum(axis=1)
        first_order = np.bincount(row, self.linear[words.index] * words.value, minlength=n) + wide @ self.linear[WORD_BUCKETS:]
        return self.bias + first_order + 0.5 * ((sums**2).sum(axis=1) - squares), sums

    def score(self, piece: Texts) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(word_features(piece), features(counts(piece)))[0], -40, 40)))


def fit(words: Sparse, stats: np.ndarray, y: np.ndarray, rank: int = 4, epochs: int = 12, batch: int = 64, seed: int = 3) -> Machine:
    """Weights by Adam on the logistic loss with weight decay."""
    rng = np.random.default_rng(seed)
    size = WORD_BUCKETS + len(FEATURES)
    m = Machine(0.0, np.zeros(size, np.float32), rng.normal(0, 0.02, (size, rank)).astype(np.float32), np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
    if not len(y) or y.min() == y.max():
        m.bias = 0.0 if not len(y) else (4.0 if y[0] else -4.0)
        m.factors[:] = 0
        return m
    m.mean, m.scale = stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-6)
    m.bias = float(np.log(y.mean() / (1 - y.mean())))
    moment = {k: [np.zeros_like(a), np.zeros_like(a)] for k, a in (("linear", m.linear), ("factors", m.factors))}
    bias_moment, t = [0.0, 0.0], 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            chosen = order[at : at + batch]
            part, s = words.rows(chosen), stats[chosen]
            raw, sums = m.raw(part, s)
            error = (1 / (1 + np.exp(-np.clip(raw, -40, 40))) - y[chosen]) / len(chosen)
            row, wide = row_of(part.first), m.scaled(s)
            index = np.concatenate([part.index, np.tile(np.arange(WORD_BUCKETS, size), len(chosen))])
            value = np.concatenate([part.value, wide.ravel()])
            row = np.concatenate([row, np.repeat(np.arange(len(chosen)), len(FEATURES))])
            g = error[row] * value
            touched, inverse = np.unique(index, return_inverse=True)
            linear = np.bincount(inverse, g)
            each = g[:, None] * (sums[row] - m.factors[index] * value[:, None])
            factors = np.stack([np.bincount(inverse, each[:, f]) for f in range(rank)], axis=1)
            t += 1
            rate = 0.02 * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            for name, weights, grad in (("linear", m.linear, linear), ("factors", m.factors, factors)):
                a, b = moment[name]
                grad = grad + 1e-5 * weights[touched]
                a[touched] = 0.9 * a[touched] + 0.1 * grad
                b[touched] = 0.999 * b[touched] + 0.001 * grad**2
                weights[touched] -= (rate * a[touched] / (np.sqrt(b[touched]) + 1e-8)).astype(np.float32)
            g0 = float(error.sum())
            bias_moment = [0.9 * bias_moment[0] + 0.1 * g0, 0.999 * bias_moment[1] + 0.001 * g0 * g0]
            m.bias -= rate * bias_moment[0] / (bias_moment[1] ** 0.5 + 1e-8)
    return m


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = TRAIN_ROWS) -> Machine:
    """A machine fitted on at most ``most`` labelled documents outside the held-out fold; executors make the features."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            w, s = word_features(piece), features(counts(piece))
            lists = lambda values, first: pa.LargeListArray.from_arrays(pa.array(first, pa.int64()), pa.array(values))
            stats = lists(s.ravel(), np.arange(len(piece) + 1) * len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([lists(w.index.astype(np.int32), w.first).cast(pa.list_(pa.int32())), lists(w.value, w.first).cast(pa.list_(pa.float32())), stats, piece.rows.column("label").cast(pa.int32())], ["i", "x", "s", "y"])

    rows = map_texts(labelled_sample(docs, labels, label, most), run, "i array<int>, x array<float>, s array<double>, y int").limit(most).toArrow().combine_chunks()
    if not rows.num_rows:
        return fit(Sparse(np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(1, np.int64)), np.zeros((0, len(FEATURES))), np.zeros(0))
    flat = lambda name: rows.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    first = np.concatenate([[0], np.cumsum(rows.column("i").combine_chunks().value_lengths().to_numpy(zero_copy_only=False))])
    stats, y = flat("s").reshape(-1, len(FEATURES)), rows.column("y").to_numpy().astype(np.float64)
    order = np.lexsort((y, *stats.T))  # the same order however rows arrive
    return fit(Sparse(flat("i").astype(np.int64), flat("x"), first).rows(order), stats[order], y[order])


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", rest: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, score) of every whole text, with the columns in ``rest`` as rest_0, rest_1, ..., so that no name can clash or need quoting."""
    names = [f"rest_{i}" for i in range(len(rest))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            kept = [piece.rows.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([piece.rows.column("doc_id"), pa.array(machine.score(piece)), *kept], ["doc_id", "score", *names])

    base = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text"), *[F.col(quoted(c)).alias(n) for n, c in zip(names, rest)])
    return map_texts(base, run, "doc_id long, score double" + "".join(f", {n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, rest)))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if the score is 0.5 or more) of every row."""
    scored = score(docs, train(docs, labels, label, most))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = TRAIN_ROWS) -> DataFrame:
    """Rows of ``docs``, unchanged, that the classifier doesn't reject."""
    names = tuple(docs.columns)
    scored = score(docs, train(docs, labels, label, most), rest=names)
    return scored.filter("score >= 0.5").select(*[F.col(f"rest_{i}").alias(c) for i, c in enumerate(names)])
