"""Counts that describe a text's structure, for a whole piece of texts at once."""

from __future__ import annotations

import numpy as np

from tallyspark.llm.text_arrays import RunHash, Texts, mix, per_row, row_of

_SYMBOL, _UPPER, _LOWER, _DIGIT, _PUNCT = (np.zeros(256, bool) for _ in range(5))
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER[65:91], _LOWER[97:123], _DIGIT[48:58] = True, True, True
_PUNCT[list(b".,;:!?")] = True


def counts(piece: Texts, window: int = 8) -> dict[str, np.ndarray]:
    """Whole numbers for each row.

    n_words; word_chars (code points in words); n_symbols (``#*$%&|<>``); n_dup_lines (lines with a word that equal
    an earlier one); n_repeat_words (words in ``window``-word windows found twice or more in the text); n_lines (lines with
    a word); n_distinct (different words); n_upper, n_lower, n_digits, n_marks (ASCII); n_wide (other characters); n_bytes.
    """
    data, offsets = piece.data, piece.offsets
    starts, ends, first = piece.words()
    row = row_of(first)
    hashes = piece.word_hashes()
    total = lambda flags: per_row(flags, offsets)
    heads = (data & 0xC0) != 0x80
    is_space = per_row_space(piece)
    out = {"n_words": np.diff(first), "n_symbols": total(_SYMBOL[data]), "n_upper": total(_UPPER[data]), "n_lower": total(_LOWER[data])}
    out |= {"n_digits": total(_DIGIT[data]), "n_marks": total(_PUNCT[data]), "n_wide": total(data >= 0xC0), "n_bytes": np.diff(offsets)}
    out["word_chars"] = total(heads) - is_space

    salt = mix(np.arange(1, len(piece) + 1).astype(np.uint64))
    distinct = np.unique(hashes ^ salt[row], return_index=True)[1]
    out["n_distinct"] = np.bincount(row[distinct], minlength=len(piece))

    covered = np.zeros(len(hashes) + 1, np.int64)
    if len(hashes) >= window:
        begin = np.flatnonzero(row[: len(row) - window + 1] == row[window - 1 :])
        grams = RunHash(hashes, "word").of(begin, begin + window) ^ salt[row[begin]]
        order = np.argsort(grams)
        same = grams[order[1:]] == grams[order[:-1]]
        twice = np.zeros(len(begin), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(covered, begin[twice], 1)
        np.add.at(covered, begin[twice] + window, -1)
    out["n_repeat_words"] = per_row(np.cumsum(covered)[:-1] > 0, first)

    cut = np.flatnonzero(data == 0x0A)
    begin, end = np.sort(np.concatenate([offsets[:-1], cut + 1])), np.sort(np.concatenate([cut, offsets[1:]]))
    full = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
    begin, end = begin[full], end[full]
    owner = np.searchsorted(offsets, begin, "right") - 1
    lines = RunHash(data.astype(np.uint64) + np.uint64(1), "byte").of(begin, end) ^ salt[owner]
    out["n_lines"] = np.bincount(owner, minlength=len(piece))
    once = np.unique(lines, return_index=True)[1]
    out["n_dup_lines"] = out["n_lines"] - np.bincount(owner[once], minlength=len(piece))
    return out


def per_row_space(piece: Texts) -> np.ndarray:
    """White-space bytes of each row."""
    from tallyspark.llm.text_arrays import IS_SPACE

    return per_row(IS_SPACE[piece.data], piece.offsets)


#: Features of the models, in order.
FEATURES = ("log_words", "word_length", "symbols", "upper", "digits", "marks", "wide", "distinct", "repeat_words", "dup_lines", "line_words", "space")


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    """Ratios of the counts, a row for each text and a column for each of FEATURES; all zero where a denominator is."""
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["n_bytes"], 1)
    letters, lines = np.maximum(c["n_upper"] + c["n_lower"], 1), np.maximum(c["n_lines"], 1)
    columns = (np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / words, c["n_upper"] / letters, c["n_digits"] / chars, c["n_marks"] / words)
    columns += (c["n_wide"] / chars, c["n_distinct"] / words, c["n_repeat_words"] / words, c["n_dup_lines"] / lines, np.log1p(c["n_words"] / lines), 1 - c["word_chars"] / chars)
    return np.stack(columns, axis=1).astype(np.float64)
