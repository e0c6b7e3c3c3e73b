"""Text clean-up of whole Arrow columns, as bytes in numpy: what ``text.py`` says of one value, for all values of a batch at once."""

from __future__ import annotations

import re
import string

import numpy as np
import pyarrow as pa

from tallyspark.functions.text import SCAN_DIGITS, SCAN_LETTERS, STOP_WORDS

_FOLDS = bytes.maketrans(SCAN_LETTERS.encode(), SCAN_DIGITS.encode())
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_IS_LETTER, _IS_DIGIT = (np.isin(np.arange(256), np.frombuffer(kept.encode(), np.uint8)) for kept in (string.ascii_letters + string.digits, string.digits))
_FIRST_NUMBER, _WORD = re.compile(r"-?[0-9]+(?:\.[0-9]+)?"), re.compile("[a-z0-9]+")
#: What ``is_blank`` takes for white space.
BLANKS = " \t\n\x0b\f\r\u00a0\u2007\u202f"


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins, and an end."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8), offsets - offsets[0]


def _kept(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that are kept, and where each text begins among them."""
    if keep.all():
        return data, offsets
    return data[keep], np.concatenate([np.zeros(1, np.int32), np.cumsum(keep, dtype=np.int32)])[offsets]


def _column(data: np.ndarray | bytes, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])


def letters(column: pa.Array) -> tuple[pa.Array, pa.Array]:
    """``mx_text`` of a column without nulls, and that folded as by ``scan_fold``."""
    data, offsets = _bytes(column)
    if (data > 127).any():  # letters beyond ASCII whose lower case is in it
        data, offsets = _bytes(pa.array([x.lower() for x in column.to_pylist()], pa.string()))
    data, offsets = _kept(data, offsets, _IS_LETTER[data])
    low = _LOWER[data].tobytes()
    return _column(low, offsets), _column(low.translate(_FOLDS), offsets)


def numbers(column: pa.Array) -> np.ndarray:
    """``mx_number`` of a column without nulls; NaN where there is none."""
    data, offsets = _bytes(column)
    data, offsets = _kept(data, offsets, data != ord(","))
    if not len(data):
        return np.full(len(column), np.nan)
    begin, end = offsets[:-1], offsets[1:]
    padded = np.append(data, np.zeros(2, np.uint8))
    digit = _IS_DIGIT[padded]
    edges = np.flatnonzero(digit[1:] != digit[:-1]) + 1  # where runs of digits begin and end, by turns
    runs = np.concatenate([np.zeros(int(digit[0]), np.int64), edges])
    run_begins, run_ends = runs[::2], runs[1::2]

    def digits_from(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the first digits from a place on begin and end, within their text."""
        run = np.minimum(np.searchsorted(run_ends, at, side="right"), max(len(run_ends) - 1, 0))
        none = (run_ends[run] <= at) if len(run_ends) else np.ones(len(at), bool)
        first = np.where(none, end, np.minimum(np.maximum(run_begins[run], at), end)) if len(run_ends) else end
        return first, np.where(none, end, np.maximum(np.minimum(run_ends[run], end), first)) if len(run_ends) else end

    first, last = digits_from(begin)
    part = (last < end) & (padded[last] == ord(".")) & digit[np.minimum(last + 1, len(data))] & (last + 1 < end)
    if part.any():
        last = np.where(part, digits_from(np.minimum(last + 1, end))[1], last)
    first = first - ((first > begin) & (padded[first - 1] == ord("-")) & (first < end))
    size = len(data) + 1
    turns = np.bincount(first, minlength=size)[:size].astype(np.int8) - np.bincount(last, minlength=size)[:size].astype(np.int8)
    span, at = _kept(data, offsets, np.cumsum(turns, dtype=np.int32)[: len(data)] > 0)
    out, found = np.full(len(column), np.nan), last > first
    texts = _column(span.tobytes(), at).cast(pa.large_string()).filter(pa.array(found))
    try:
        out[found] = texts.cast(pa.float64()).to_numpy(zero_copy_only=False)
    except pa.ArrowInvalid:  # more digits than a double holds
        out[found] = [float(x) for x in texts.to_pylist()]
    return out


def values(column: pa.Array) -> list[bytes]:
    """The texts of a column without nulls, one by one."""
    data, offsets = _bytes(column)
    data, ends = data.tobytes(), offsets.tolist()
    return [data[a:b] for a, b in zip(ends, ends[1:])]


def words(text: str) -> list[str]:
    """``mx_words`` of a text."""
    return [w for w in _WORD.findall(text.lower()) if w not in STOP_WORDS]


def by_pair(f, first: pa.Array, second: pa.Array) -> np.ndarray:
    """``f`` of the two values of each row, each different pair worked out once."""
    first, second = first.dictionary_encode(), second.dictionary_encode()
    ours, theirs = first.dictionary.to_pylist(), second.dictionary.to_pylist()
    pair = first.indices.to_numpy().astype(np.int64) * len(theirs) + second.indices.to_numpy()
    different, at = np.unique(pair, return_inverse=True)
    return np.array([f(ours[k // len(theirs)], theirs[k % len(theirs)]) for k in different.tolist()])[at]
