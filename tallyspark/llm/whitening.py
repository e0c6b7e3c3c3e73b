"""Whitening of integer vectors by a bidiagonal qd solver.

Each vector is an exact row of whole numbers.  The different ones are the fit list; their sums are exact longs.  Centred rows are
reduced to a triangle R by QR of blocks in tasks, and triangles by QR of stacks of them, so nothing but triangles of the vectors' own length
moves.  R'R is the list's scatter without its products being formed.  Of R alone, whose size is the vectors' length and not the data's, the driver then makes:

* a bidiagonal matrix B by Householder reflections from both sides;
* the squares of B's singular values to high relative accuracy, by differential quotient-difference steps with shifts (dqds);
* for each, the vector by a twisted factorisation of B'B less the value, started where the twist is least, and turned back by the reflections.

Defined results: null vectors, and those with null or non-finite entries, take no part; nor do those of another length than most rows have (ties: the greater
length); repeated rows count once in the fit and are each returned; components without spread (below 1e-13 of the greatest) are left out, so copies of one vector
give no rows, and neither does an empty table; entries count to 2**40, larger ones are an error, as are deviations beyond a long; ids may be null and other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.scratch import stored
from tallyspark.llm.vectors import commonest_length, finite, matrix

SCALE, SHIFT = 64, 1_000_000
#: Rows that a task stacks on its triangle at once, and triangles stacked in one task.
BLOCK_ROWS, STACK = 2048, 16
_EPS = float(np.finfo(float).eps)


def whole_numbers(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, x): floor(64 c) + 1000000 of every entry of vectors that take part."""
    good = rows.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v")).filter(finite(F.col("v")))
    good = good.filter(F.size("v") == commonest_length(good, "v"))
    return good.select("vec_id", F.transform("v", lambda c: F.floor(c * float(SCALE)) + SHIFT).alias("x"))


def _sums(fit: DataFrame) -> tuple[int, np.ndarray]:
    """Number of rows and exact sums by dimension."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            x = matrix(batch.column(0), np.int64)
            n, total = n + len(x), x.sum(0) if total is None else total + x.sum(0)
        if n:
            yield pa.RecordBatch.from_pydict({"i": np.arange(len(total)), "n": np.full(len(total), n), "s": total})

    parts = fit.select("x").mapInArrow(run, "i long, n long, s long")
    rows = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("i").collect()  # as many rows as dimensions
    return (rows[0]["n"], np.array([r["s"] for r in rows], np.int64)) if rows else (0, np.zeros(0, np.int64))


def triangle(fit: DataFrame, mean: np.ndarray) -> np.ndarray:
    """R of a QR factorisation of the centred rows: by blocks in tasks, then stacks of triangles until one is left."""
    d = len(mean)

    def reduce_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for batch in batches:
            x = matrix(batch.column(0), np.int64)
            for at in range(0, len(x), BLOCK_ROWS):
                r = np.linalg.qr(np.vstack([r, x[at : at + BLOCK_ROWS] - mean]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_pydict({"r": pa.array([r.ravel()])})

    def stack(rows: pd.DataFrame) -> pd.DataFrame:
        r = np.linalg.qr(np.concatenate([np.asarray(x).reshape(-1, d) for x in rows["r"]]), mode="r")
        return pd.DataFrame({"r": [r.ravel()]})

    parts = stored(fit.select("x").mapInArrow(reduce_rows, "r array<double>"), "whitening-triangles")
    while (n := parts.count()) > 1:
        dealt = parts.withColumn("g", F.pmod(F.monotonically_increasing_id().bitwiseXOR(F.shiftright(F.monotonically_increasing_id(), 33)), F.lit(-(-n // STACK))))
        parts = stored(dealt.groupBy("g").applyInPandas(stack, "r array<double>"), "whitening-triangles")
    r = np.asarray(parts.first()["r"]).reshape(-1, d)
    return np.vstack([r, np.zeros((max(0, d - len(r)), d))])


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, w): diagonal and superdiagonal of U' R W, and W, by Householder reflections."""
    m, d = np.array(r, float), r.shape[1]
    w = np.eye(d)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        size = np.linalg.norm(x)
        if not size:
            return None
        v = x / size
        v[0] += np.copysign(1.0, v[0])
        return v / np.linalg.norm(v)

    for k in range(d):
        if (v := reflector(m[k:, k])) is not None:
            m[k:, k:] -= 2 * np.outer(v, v @ m[k:, k:])
        if k + 1 < d and (v := reflector(m[k, k + 1 :])) is not None:
            m[k:, k + 1 :] -= 2 * np.outer(m[k:, k + 1 :] @ v, v)
            w[:, k + 1 :] -= 2 * np.outer(w[:, k + 1 :] @ v, v)
    return np.diag(m).copy(), np.diag(m, 1).copy(), w


def _step(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One dqds step: the new q and e, and the d it went through; a negative d tells that the shift was beyond the least value."""
    n = len(q)
    qs, es, ds = np.empty(n), np.empty(n - 1), np.empty(n)
    d = q[0] - shift
    for k in range(n - 1):
        ds[k] = d
        qs[k] = top = d + e[k]
        t = q[k + 1] / top if top else 0.0
        es[k] = e[k] * t
        d = d * t - shift
    ds[-1] = qs[-1] = d
    return qs, es, ds


def dqds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squares of the singular values of the bidiagonal matrix (a, b), falling, each to high relative accuracy.

    The shift is 1 over the sum of 1/d of an unshifted step, that is 1 over the trace of the inverse: never beyond the least value.
    """
    found: list[float] = []
    todo = [(a.astype(float) ** 2, b.astype(float) ** 2, 0.0)]
    while todo:
        q, e, sigma = todo.pop()
        while len(q) > 1:
            small = e <= (8 * _EPS) ** 2 * (sigma + np.minimum(q[:-1], q[1:]))
            if small.any():
                cut = int(np.flatnonzero(small)[-1]) + 1
                todo.append((q[:cut], e[: cut - 1], sigma))
                q, e = q[cut:], e[cut:]
                continue
            if q[0] < q[-1] / 1.5:
                q, e = q[::-1].copy(), e[::-1].copy()
            plain_q, plain_e, d = _step(q, e, 0.0)
            shift = 0.0 if (d <= 0).any() else float(1 / np.sum(1 / d)) * (1 - 4 * len(q) * _EPS)
            if shift > sigma * _EPS:
                next_q, next_e, d = _step(q, e, shift)
                if (d >= 0).all():
                    q, e, sigma = next_q, next_e, sigma + shift
                    continue
            q, e = plain_q, plain_e
        found.append(sigma + (float(q[0]) if len(q) else 0.0))
    return np.sort(np.array(found))[::-1]


def _twisted(q: np.ndarray, low: np.ndarray, value: float) -> tuple[np.ndarray, float]:
    """Unit vector z and the correction of ``value`` from the twisted factorisation of L D L' less the value, D = q, L's subdiagonal ``low``."""
    n = len(q)
    tiny = np.finfo(float).tiny * 1e30
    plus, minus, s, p = np.zeros(max(n - 1, 0)), np.zeros(max(n - 1, 0)), np.empty(n), np.empty(n)
    s[0] = -value
    for i in range(n - 1):
        top = s[i] + q[i]
        top = top if abs(top) > tiny else -tiny
        plus[i] = low[i] * q[i] / top
        s[i + 1] = plus[i] * low[i] * s[i] - value
    p[-1] = q[-1] - value
    for i in range(n - 2, -1, -1):
        low_part = low[i] * low[i] * q[i] + p[i + 1]
        low_part = low_part if abs(low_part) > tiny else -tiny
        t = q[i] / low_part
        minus[i] = low[i] * t
        p[i] = p[i + 1] * t - value
    twist = s + p + value
    r = int(np.argmin(np.abs(twist)))
    z = np.zeros(n)
    z[r] = 1.0
    for i in range(r - 1, -1, -1):
        z[i] = -plus[i] * z[i + 1]
    for i in range(r, n - 1):
        z[i + 1] = -minus[i] * z[i]
    size = float(np.linalg.norm(z))
    return z / size, float(twist[r]) / size**2


def directions(a: np.ndarray, b: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Columns: unit eigenvectors of B'B for the given values, falling.

    A value is corrected by the twist until that no longer counts.  Values that agree to 1e-3 or better belong to a cluster, whose vectors
    are freed of those found before by two further solutions with the tridiagonal matrix, so that they stay at right angles.
    """
    d, floor = len(a), max(float(np.abs(a).max(initial=0)), float(np.abs(b).max(initial=0)))
    diag = np.where(np.abs(a) > _EPS * floor, a, _EPS * floor)
    q, low = diag * diag, b / diag[:-1]
    square = np.zeros((d, d))
    square[np.arange(d), np.arange(d)] = q + np.concatenate([[0.0], b * b])
    square[np.arange(d - 1), np.arange(1, d)] = square[np.arange(1, d), np.arange(d - 1)] = diag[:-1] * b
    out = np.zeros((d, len(values)))
    first = 0
    for k, value in enumerate(values):
        if k and values[k - 1] - value > 1e-3 * values[k - 1]:
            first = k
        z, off = _twisted(q, low, value)
        for _ in range(3):
            if abs(off) <= _EPS * value:
                break
            z, off = _twisted(q, low, value := value + off) if k == first else (z, 0.0)
        if k > first:
            near = out[:, first:k]
            nudged = square - (value * (1 + 4 * _EPS * (k - first))) * np.eye(d)
            for start in (z, np.cos(np.arange(d) * (k + 1.0)), np.cos(np.arange(d) ** 2 * (k + 0.5))):
                z = start - near @ (near.T @ start)
                if np.linalg.norm(z) < 1e-6:
                    continue
                for _ in range(3):
                    z = np.linalg.solve(nudged, z / np.linalg.norm(z))
                    z /= np.linalg.norm(z)
                    z -= near @ (near.T @ z)
                    z -= near @ (near.T @ z)
                z /= np.linalg.norm(z)
                if np.linalg.norm(square @ z - value * z) <= 1e-10 * values[0]:
                    break
        out[:, k] = z
    return out


def components(r: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(e, v, trace): the greatest eigenvalues of R'R / n, falling, unit eigenvectors as columns, and the trace of all."""
    a, b, w = bidiagonal(r)
    values = dqds(a, b)
    kept = values[: min(most, int(np.sum(values > 1e-13 * values[0])))] if len(values) and values[0] > 0 else values[:0]
    if not len(kept):
        return kept, np.zeros((len(a), 0)), 0.0
    v = w @ directions(a, b, kept)
    v *= np.where(v[np.abs(v).argmax(0), np.arange(v.shape[1])] < 0, -1.0, 1.0)
    return kept / n, v, float(values.sum()) / n


def _identity_error(fit: DataFrame, n: int, mean: np.ndarray, turn: np.ndarray) -> float:
    """Largest absolute entry of the whitened fit list's covariance less the identity."""
    k = turn.shape[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, product, some = np.zeros(k), np.zeros((k, k)), False
        for batch in batches:
            w = (matrix(batch.column(0), np.int64) - mean) @ turn
            total, product, some = total + w.sum(0), product + w.T @ w, True
        if some:
            yield pa.RecordBatch.from_pydict({"i": np.arange(k + k * k), "s": np.concatenate([total, product.ravel()])})

    rows = fit.select("x").mapInArrow(run, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()  # k + k * k rows
    sums = np.array([r["s"] for r in rows]) / n
    covariance = sums[k:].reshape(k, k) - np.outer(sums[:k], sums[:k])
    return float(np.abs(covariance - np.eye(k)).max())


def whiten(rows: DataFrame, most: int = 16, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """A row by vector and component, as the module tells: vec_id, component, n, deviation, whitened, explained, identity_error."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    x = stored(whole_numbers(rows, id_col, vec_col).withColumn("vec_id", F.col("vec_id").cast("long")), "whitening-rows")
    fit = stored(x.select("x").distinct(), "whitening-fit")
    n, sums = _sums(fit)
    if not n:
        return rows.sparkSession.createDataFrame([], schema)
    mean = sums / n
    e, v, trace = components(triangle(fit, mean), n, most)
    if not len(e):
        return rows.sparkSession.createDataFrame([], schema)
    turn = v / np.sqrt(e)
    error, explained, k = _identity_error(fit, n, mean, turn), e / trace, len(e)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = len(batch)
            w = (matrix(batch.column("x"), np.int64) - mean) @ turn
            each = lambda values: np.tile(values, m)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))), pa.array(each(np.arange(1, k + 1, dtype=np.int32))), batch.column("deviation").take(pa.array(np.repeat(np.arange(m), k))), pa.array(w.ravel()), pa.array(each(explained))], ["vec_id", "component", "deviation", "whitened", "explained"])

    total = F.array(*[F.lit(int(s)) for s in sums])
    far = F.aggregate(F.zip_with("x", total, lambda c, s: (c * F.lit(int(n)) - s) * (c * F.lit(int(n)) - s)), F.lit(0).cast("long"), lambda acc, y: acc + y)
    out = x.withColumn("deviation", far).mapInArrow(run, "vec_id long, component int, deviation long, whitened double, explained double")
    return out.select("vec_id", "component", F.lit(int(n)).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(error).alias("identity_error"))
