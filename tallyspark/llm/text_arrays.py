"""Vectorised views of text columns inside a task: bytes, words and hashes as numpy arrays.

A batch of texts is one UTF-8 buffer with row offsets.  Words are maximal runs
of bytes outside ``\\x20 \\x09-\\x0D``; null texts count as empty.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of an Arrow batch sent to a Python worker. Spark's own bound is 64 MiB, which a task holds several times over.
BATCH_BYTES = 4 << 20
#: A piece of a batch ends once it has this many bytes of text; a longer text is a piece of its own.
PIECE_BYTES = 1 << 20

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_BASES = {"byte": 0x9E3779B97F4A7C15, "word": 0xD1342543DE82EF95, "other": 0xAF251AF3B0F025B5}
_POWERS: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _powers(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of an odd base and of its inverse, modulo 2**64."""
    if kind not in _POWERS or len(_POWERS[kind][0]) < n:
        size, base = max(n, 1 << 16), _BASES[kind]
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps, dtype=np.uint64))
        _POWERS[kind] = (both[0], both[1])
    up, down = _POWERS[kind]
    return up[:n], down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the public SplitMix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RunHash:
    """Hashes of arbitrary runs [start, end) of a sequence from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, values: np.ndarray, kind: str):
        self.up, self.down = _powers(kind, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values.astype(np.uint64) * self.up[:-1], dtype=np.uint64, out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Texts:
    """One piece of a text column: ``data`` (UTF-8 bytes), ``offsets`` (rows + 1) and the rows themselves."""

    def __init__(self, rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, between: np.ndarray = IS_SPACE):
        self.rows, self.data, self.offsets, self.between = rows, data, offsets, between
        self._words: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def column(self, name: str) -> np.ndarray:
        return self.rows.column(name).to_numpy(zero_copy_only=False)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts and ends of all words, and for each row the index of its first word (rows + 1 entries)."""
        if self._words is None:
            n = len(self.data)
            space = np.ones(n + 2, bool)
            space[1:-1] = self.between[self.data]
            before, after = space[:-2].copy(), space[2:].copy()
            edges = self.offsets
            before[edges[edges < n]] = True
            after[edges[edges > 0] - 1] = True
            word = ~space[1:-1]
            starts, ends = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
            self._words = starts, ends, np.searchsorted(starts, self.offsets)
        return self._words

    def word_hashes(self) -> np.ndarray:
        starts, ends, _ = self.words()
        return RunHash(self.data.astype(np.uint64) + np.uint64(1), "byte").of(starts, ends)

    def strings(self) -> list[bytes]:
        raw = self.data.tobytes()
        o = self.offsets.tolist()
        return [raw[a:b] for a, b in zip(o, o[1:])]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column, nulls as empty texts."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets is not None and len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterable[pa.RecordBatch], text: str, limit: int = PIECE_BYTES) -> Iterator[Texts]:
    """Each batch as pieces of about ``limit`` bytes, so that a task's memory doesn't follow the batch size."""
    for batch in batches:
        data, offsets = utf8(batch.column(text))
        at, n = 0, batch.num_rows
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield Texts(batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
            at = to


def map_texts(df: DataFrame, run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` in batches of at most about BATCH_BYTES, or of a single text where that is longer.

    Sets the session's bound, as plans read it when they run; a smaller bound set before stays.
    """
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    number, unit = re.fullmatch(r"(-?[0-9]+)([a-z]?)[a-z]*", conf.get(name).lower()).groups()
    if not 0 < int(number) << 10 * "bkmgtp".find(unit or "b") <= BATCH_BYTES:
        conf.set(name, f"{BATCH_BYTES}b")
    return df.mapInArrow(run, schema)


def quoted(name: str) -> str:
    """A column's name for ``F.col``, whatever is in it."""
    return "`" + name.replace("`", "``") + "`"


def per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over each row's range first[i]..first[i+1], empty ranges included."""
    sums = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "iub" else np.float64)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def row_of(first: np.ndarray) -> np.ndarray:
    """For each item the row whose range it lies in."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the first byte of each character in valid UTF-8, and the code points."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.int32)
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    cp = lead.copy()
    for low, high, mask, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0x100, 0x07, 3)):
        wide = np.flatnonzero((lead >= low) & (lead < high))
        if len(wide):
            value = lead[wide] & mask
            for k in range(1, more + 1):
                value = (value << 6) | (padded[at[wide] + k] & 0x3F)
            cp[wide] = value
    return at, cp


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each run, one run after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - before, lengths)
