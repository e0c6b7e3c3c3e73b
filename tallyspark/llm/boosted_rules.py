"""Quality rules: exact base rules, then gradient-boosted trees over document statistics.

Trees are grown on histograms and flattened into numpy arrays of nodes, and all texts of a piece walk all trees
together.  On features with a sign in MONOTONE the score never rises (-1) or falls (1) as the feature grows: a split that
breaks the order is not taken, and the midpoint of its children bounds what stands below them.

Defined results: null or empty text has no words and fails the base rules; without a usable label
the trees keep all; repeated rows are judged alike; labels are read in training only; a null id stays null; of equally good splits the first
feature and cut wins; an empty table gives no rows; a text of any length is read whole; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.folds import labelled_sample
from tallyspark.llm.statistics import FEATURES, counts, features
from tallyspark.llm.text_arrays import map_texts, pieces

TRAIN_ROWS = 20000
#: More symbols, repeated words, repeated lines or capitals never help a text.
MONOTONE = {"symbols": -1, "repeat_words": -1, "dup_lines": -1, "upper": -1}
BASE = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass
class Trees:
    """Node arrays of shape (trees, nodes); a leaf is its own child."""

    bias: float
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        n, trees = len(x), len(self.feature)
        at, tree, row = np.zeros((n, trees), np.int32), np.arange(trees)[None, :], np.arange(n)[:, None]
        for _ in range(self.depth):
            low = x[row, self.feature[tree, at]] <= self.cut[tree, at]
            at = np.where(low, self.left[tree, at], self.right[tree, at])
        return self.bias + self.value[tree, at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 48, least: int = 10, reg: float = 1.0, monotone: dict[str, int] | None = None) -> Trees:
    """Boosting on the logistic loss with Newton steps."""
    signs = np.array([(MONOTONE if monotone is None else monotone).get(f, 0) for f in FEATURES])
    nodes = 2 ** (depth + 1) - 1
    flat = Trees(0.0, np.zeros((trees, nodes), np.int32), np.zeros((trees, nodes)), np.tile(np.arange(nodes, dtype=np.int32), (trees, 1)), np.tile(np.arange(nodes, dtype=np.int32), (trees, 1)), np.zeros((trees, nodes)), depth)
    if not len(y) or y.min() == y.max():
        flat.bias = 4.0 if not len(y) or y[0] else -4.0
        return flat
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    code = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    flat.bias = float(np.log(y.mean() / (1 - y.mean())))
    raw = np.full(len(y), flat.bias)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        work = [(0, np.arange(len(y)), -np.inf, np.inf, 0)]
        while work:
            node, rows, low, high, level = work.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            flat.value[t, node] = rate * np.clip(-gs / (hs + reg), low, high)
            if level == depth or len(rows) < 2 * least:
                continue
            best = (1e-6, None)
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                k = code[rows, f]
                gl, hl, nl = (np.cumsum(np.bincount(k, w, minlength=len(c) + 1))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                vl, vr = np.clip(-gl / (hl + reg), low, high), np.clip(-(gs - gl) / (hs - hl + reg), low, high)
                gain = gl**2 / (hl + reg) + (gs - gl) ** 2 / (hs - hl + reg) - gs**2 / (hs + reg)
                gain[(nl < least) | (len(rows) - nl < least) | (signs[f] * (vr - vl) < 0)] = -1
                j = int(np.argmax(gain))
                if gain[j] > best[0]:
                    best = (gain[j], (f, j, vl[j], vr[j]))
            if best[1] is None:
                continue
            f, j, vl, vr = best[1]
            flat.feature[t, node], flat.cut[t, node], flat.left[t, node], flat.right[t, node] = f, cuts[f][j], 2 * node + 1, 2 * node + 2
            goes, mid = code[rows, f] <= j, (vl + vr) / 2
            bounds = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[int(signs[f])]
            work += [(2 * node + 1, rows[goes], *bounds[0], level + 1), (2 * node + 2, rows[~goes], *bounds[1], level + 1)]
        one = Trees(0.0, *(a[t : t + 1] for a in (flat.feature, flat.cut, flat.left, flat.right, flat.value)), depth)
        raw += one.raw(x)
    return flat


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = TRAIN_ROWS) -> Trees:
    """Trees fitted on at most ``most`` labelled documents outside the held-out fold."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            x = features(counts(piece))
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, f]) for f in range(len(FEATURES))), piece.rows.column("label").cast(pa.int32())], [*FEATURES, "y"])

    rows = map_texts(labelled_sample(docs, labels, label, most), run, ", ".join(f"{f} double" for f in FEATURES) + ", y int").limit(most).toArrow()
    x = np.stack([rows.column(f).to_numpy() for f in FEATURES], axis=1)
    y = rows.column("y").to_numpy().astype(np.float64)
    order = np.lexsort((y, *x.T))  # the same order however rows arrive
    return fit(x[order], y[order])


def judge(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text", least_words: int = 20, most_repeat_percent: int = 30, threshold: float = 0.5) -> DataFrame:
    """doc_id, n_words, the base counts, base_failed, score, kept of every whole text."""
    names = ["doc_id", "n_words", *BASE, "base_failed", "score", "kept"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            c = counts(piece)
            failed = (c["n_words"] < least_words) | (100 * c["n_repeat_words"] > most_repeat_percent * c["n_words"])
            score = trees.score(features(c))
            yield pa.RecordBatch.from_arrays([piece.rows.column("doc_id"), *(pa.array(c[k].astype(np.int64)) for k in ("n_words", *BASE)), pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))], names)

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_texts(base, run, "doc_id long, n_words long, " + ", ".join(f"{k} long" for k in BASE) + ", base_failed boolean, score double, kept boolean")
