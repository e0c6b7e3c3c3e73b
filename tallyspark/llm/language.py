"""Language identification by a bidirectional gated recurrent network over bytes, trained here in numpy.

A text's bytes are cut in segments of ``SEGMENT``, each read with ``CONTEXT`` bytes of the text on either side: the forward
state comes from those before, the backward state from those behind.  Every position gets language probabilities from both states there, and a document's
probabilities are the mean over all its positions.  Training is backpropagation through time on all segments of a bounded sample of documents.

Defined results: ``und`` with score 0 where the text is null or has no letter, or where no label was
learned; ties go to the first language in order; repeated rows are labelled alike; rows without a
language, and the held-out fold, are never learned from; a null id is in no held-out fold; an empty table gives no rows; other columns, whatever
their names, are not read.  All of a text's positions are labelled, in memory of about its own length besides a fixed number of segments.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.folds import held_out, labelled_sample
from tallyspark.llm.text_arrays import Texts, map_texts, per_row, pieces, spread

SEGMENT, CONTEXT = 256, 32
HIDDEN = 8
#: Documents that the network learns from at most, each of them whole.
TRAIN_ROWS = 400
#: Segments that training goes through, over and over if the sample has fewer; every one is used once at least.
TRAIN_SEGMENTS = 24_000
#: Stands for places after a segment's end; its update gate keeps the state.
PAD = 256


@dataclass
class Network:
    """Weights by direction (0 forward, 1 backward); inputs are rows of a table by byte."""

    languages: list[str]
    gates: np.ndarray  # (2, 2, 257, H): input to the update and the reset gate
    inputs: np.ndarray  # (2, 257, H): input to the candidate
    u_gates: np.ndarray  # (2, 2, H, H)
    u_inputs: np.ndarray  # (2, H, H)
    out: np.ndarray  # (2H, L)
    bias: np.ndarray  # (L,)

    def weights(self) -> list[np.ndarray]:
        return [self.gates, self.inputs, self.u_gates, self.u_inputs, self.out, self.bias]


def new_network(languages: list[str], seed: int = 5) -> Network:
    rng = np.random.default_rng(seed)
    f = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
    h, n = HIDDEN, len(languages)
    net = Network(languages, f(1, 2, 2, 257, h), f(0.5, 2, 257, h), f(0.6, 2, 2, h, h), f(0.3, 2, h, h), f(0.3, 2 * h, n), np.zeros(n, np.float32))
    _hold(net)
    return net


def _hold(net: Network) -> None:
    net.gates[:, 0, PAD], net.gates[:, 1, PAD], net.inputs[:, PAD] = -40, 0, 0


def run_states(net: Network, codes: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """States (2, T, B, H), both in the text's order, of ``codes`` (T, B); the trace for training if asked for."""
    steps, batch = codes.shape
    h = np.zeros((2, batch, HIDDEN), np.float32)
    states, trace = np.empty((2, steps, batch, HIDDEN), np.float32), []
    half, quarter = np.float32(0.5), np.float32(0.25)
    for t in range(steps):
        ahead, back = codes[t], codes[steps - 1 - t]
        # The update gate is the share of the new candidate. Gates use the hard sigmoid, clip(a / 4 + 1 / 2, 0, 1).
        zr = np.matmul(h[:, None], net.u_gates)
        for gate in (0, 1):
            zr[0, gate] += net.gates[0, gate].take(ahead, axis=0)
            zr[1, gate] += net.gates[1, gate].take(back, axis=0)
        zr *= quarter
        zr += half
        np.maximum(zr, 0, out=zr)
        np.minimum(zr, 1, out=zr)
        un = np.matmul(h, net.u_inputs)
        n = un * zr[:, 1]
        n[0] += net.inputs[0].take(ahead, axis=0)
        n[1] += net.inputs[1].take(back, axis=0)
        np.tanh(n, out=n)
        if keep:
            trace.append((h, zr, un, n, ahead, back))
        h = h + zr[:, 0] * (n - h)
        states[0, t], states[1, steps - 1 - t] = h[0], h[1]
    return states, trace


def position_probabilities(net: Network, codes: np.ndarray, context: int = 0) -> np.ndarray:
    """(T, B, L) language probabilities at every position but the first and last ``context``, which only lead the states in."""
    states, _ = run_states(net, codes)
    states = states[:, context : len(codes) - context]
    raw = states[0] @ net.out[:HIDDEN]
    raw += states[1] @ net.out[HIDDEN:]
    raw += net.bias
    np.clip(raw, -30, 30, out=raw)
    np.exp(raw, out=raw)
    raw /= raw.sum(axis=2, keepdims=True)
    return raw


def gradients(net: Network, codes: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean loss over positions, and its gradients by backpropagation through time."""
    steps, batch = codes.shape
    states, trace = run_states(net, codes, keep=True)
    both = np.concatenate([states[0], states[1]], axis=2)
    raw = both @ net.out + net.bias
    raw -= raw.max(axis=2, keepdims=True)
    p = np.exp(raw)
    p /= p.sum(axis=2, keepdims=True)
    real = codes != PAD
    total = max(1, int(real.sum()))
    loss = -float((np.log(np.maximum(p[:, np.arange(batch), target], 1e-9)) * real).sum()) / total
    p[:, np.arange(batch), target] -= 1
    p *= (real / total)[:, :, None]
    grads = [np.zeros_like(w) for w in net.weights()]
    g_gates, g_inputs, g_ug, g_ui, g_out, g_bias = grads
    g_out += both.reshape(-1, 2 * HIDDEN).T @ p.reshape(-1, p.shape[2]).astype(np.float32)
    g_bias += p.sum(axis=(0, 1))
    d_both = p.astype(np.float32) @ net.out.T
    carry = np.zeros((2, batch, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        h, zr, un, n, ahead, back = trace[t]
        z, r = zr[:, 0], zr[:, 1]
        d = carry + np.stack([d_both[t, :, :HIDDEN], d_both[steps - 1 - t, :, HIDDEN:]])
        dn = d * z * (1 - n * n)
        dun = dn * r
        dzr = np.stack([d * (n - h), dn * un], axis=1) * ((zr > 0) & (zr < 1)) * np.float32(0.25)
        carry = d * (1 - z) + np.matmul(dun, net.u_inputs.transpose(0, 2, 1)) + np.matmul(dzr, net.u_gates.transpose(0, 1, 3, 2)).sum(axis=1)
        g_ug += np.matmul(h.transpose(0, 2, 1)[:, None], dzr)
        g_ui += np.matmul(h.transpose(0, 2, 1), dun)
        for k, bytes_ in ((0, ahead), (1, back)):
            np.add.at(g_gates[k, 0], bytes_, dzr[k, 0])
            np.add.at(g_gates[k, 1], bytes_, dzr[k, 1])
            np.add.at(g_inputs[k], bytes_, dn[k])
    g_gates[:, :, PAD], g_inputs[:, PAD] = 0, 0
    return loss, grads


def fit(segments: np.ndarray, target: np.ndarray, languages: list[str], epochs: int = 4, batch: int = 128, seed: int = 5) -> Network:
    """A network trained with Adam; ``segments`` is (n, SEGMENT) with PAD after the end."""
    net, rng = new_network(languages, seed), np.random.default_rng(seed)
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in net.weights()]
    t = 0
    for _ in range(epochs):
        order = rng.permutation(len(target))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            _, grads = gradients(net, np.ascontiguousarray(segments[chosen].T), target[chosen])
            size = np.sqrt(sum(float((g**2).sum()) for g in grads))
            t += 1
            rate = 0.015 * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            for w, g, (a, b) in zip(net.weights(), grads, moments):
                g = g * min(1.0, 1.0 / max(size, 1e-9))
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                w -= (rate * a / (np.sqrt(b) + 1e-8)).astype(np.float32)
            _hold(net)
    return net


def segments_of(data: np.ndarray, offsets: np.ndarray, begin: int = 0, end: int | None = None, context: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The segments of a piece from ``begin`` to ``end`` as (n, SEGMENT + 2 context) codes, and their number by row; PAD lies outside the text."""
    sizes = np.diff(offsets)
    each = -(-sizes // SEGMENT)
    starts = (np.repeat(offsets[:-1], each) + SEGMENT * (spread(np.zeros(len(each), np.int64), each)))[begin:end]
    heads, ends = (np.repeat(o, each)[begin:end] for o in (offsets[:-1], offsets[1:]))
    at = starts[:, None] + np.arange(-context, SEGMENT + context)
    inside = (at >= heads[:, None]) & (at < ends[:, None])
    codes = np.full(at.shape, PAD, np.int16)
    codes[inside] = data[at[inside]]
    return codes, each


def has_letter(piece: Texts) -> np.ndarray:
    """Whether each text has a letter."""
    ascii_ = ((piece.data | 0x20) >= 97) & ((piece.data | 0x20) <= 122) & (piece.data < 128)
    out = per_row(ascii_, piece.offsets) > 0
    raw = piece.data.tobytes()
    for k in np.flatnonzero(~out & (per_row(piece.data >= 0xC0, piece.offsets) > 0)):
        out[k] = any(ch.isalpha() for ch in raw[piece.offsets[k] : piece.offsets[k + 1]].decode())
    return out


def document_probabilities(net: Network, piece: Texts, batch: int = 1024) -> np.ndarray:
    """(rows, L): mean over all positions of a text; zero rows for empty ones."""
    each = -(-np.diff(piece.offsets) // SEGMENT)
    sums = np.zeros((int(each.sum()), len(net.languages)))
    for at in range(0, len(sums), batch):
        part = np.ascontiguousarray(segments_of(piece.data, piece.offsets, at, at + batch, CONTEXT)[0].T)
        p = position_probabilities(net, part, CONTEXT)
        p[part[CONTEXT:-CONTEXT] == PAD] = 0
        sums[at : at + batch] = p.sum(axis=0)
    first = np.concatenate([[0], np.cumsum(each)])
    total = np.stack([per_row(sums[:, k], first) for k in range(sums.shape[1])], axis=1)
    return total / np.maximum(np.diff(piece.offsets), 1)[:, None]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = TRAIN_ROWS) -> Network | None:
    """A network from at most ``most`` documents with a language outside the held-out fold; None if there is none.

    Executors cut each whole text in segments.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            _, each = segments_of(piece.data, piece.offsets, 0, 0)
            kept = np.repeat(has_letter(piece), each)
            owner = np.repeat(np.arange(len(piece)), each)
            for at in range(0, len(kept), 4096):
                good = np.flatnonzero(kept[at : at + 4096])
                codes, _ = segments_of(piece.data, piece.offsets, at, at + 4096)
                yield pa.RecordBatch.from_arrays([pa.array([row.tobytes() for row in codes[good]], pa.binary()), piece.rows.column("label").take(pa.array(owner[at + good]))], ["codes", "label"])

    rows = map_texts(labelled_sample(base, base.filter("text is not null"), "lang", most), run, "codes binary, label string").toArrow()
    if not rows.num_rows:
        return None
    labels = rows.column("label").to_pylist()
    learned = sorted(zip(rows.column("codes").to_pylist(), labels))  # the same order however rows arrive
    languages = sorted(set(labels))
    codes = np.frombuffer(b"".join(c for c, _ in learned), np.int16).reshape(-1, SEGMENT)
    return fit(codes, np.array([languages.index(x) for _, x in learned]), languages, epochs=max(1, min(6, TRAIN_SEGMENTS // len(codes))))


def predict(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every whole text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", 1 << 20):
            languages, score = np.full(len(piece), "und", object), np.zeros(len(piece))
            if net is not None:
                p = document_probabilities(net, piece)
                known = has_letter(piece)
                languages = np.where(known, np.array(net.languages, object)[p.argmax(axis=1)], "und")
                score = np.where(known, np.clip(p.max(axis=1), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([piece.rows.column("doc_id"), pa.array(languages, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = map_texts(base, run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
