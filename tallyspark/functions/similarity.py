"""Similarity of many pairs of short texts at once, by longest matching blocks, in numpy.

The ratio of a pair is twice the letters in matching blocks over the letters of both.  The blocks are the longest run of letters that both share (of equal
ones the first in the one, then in the other), and the same again left and right of it.  Pairs lie in a padded grid of code points; a
work list holds the stretches still to be compared, of all pairs together, and each round finds the longest run of every stretch in it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Cells of a grid worked on at once.
CELLS = 1 << 22


def code_grid(texts: Sequence[str], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts in rows padded with ``pad``, and the lengths."""
    sizes = np.array([len(t) for t in texts], np.int64)
    grid = np.full((len(texts), int(sizes.max(initial=0))), pad, np.int32)
    grid[np.arange(grid.shape[1]) < sizes[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.int32)
    return grid, sizes


def _longest_runs(a: np.ndarray, b: np.ndarray, work: np.ndarray) -> np.ndarray:
    """(length, place in a, place in b) of the longest common run of each stretch (pair, a from, a to, b from, b to) of the work list."""
    pair, a0, a1, b0, b1 = work.T
    columns = np.arange(b.shape[1])
    inside = (columns >= b0[:, None]) & (columns < b1[:, None])
    theirs, ours = b[pair], a[pair]
    run = np.zeros((len(work), b.shape[1] + 1), np.int32)
    best, rows = np.zeros((len(work), 3), np.int64), np.arange(len(work))
    for i in range(int(a0.min()), int(a1.max())):
        same = inside & (theirs == ours[:, i : i + 1]) & ((a0 <= i) & (i < a1))[:, None]
        run[:, 1:] = np.where(same, run[:, :-1] + 1, 0)
        j = np.argmax(run, axis=1)
        length = run[rows, j]
        better = length > best[:, 0]
        best[better] = np.stack([length, i - length + 1, j - length], axis=1)[better]
    return best


def matched_letters(a: np.ndarray, a_sizes: np.ndarray, b: np.ndarray, b_sizes: np.ndarray) -> np.ndarray:
    """Letters in matching blocks of each pair of rows."""
    total = np.zeros(len(a), np.int64)
    zero = np.zeros(len(a), np.int64)
    work = np.stack([np.arange(len(a)), zero, a_sizes, zero, b_sizes], axis=1)
    step = max(1, CELLS // (b.shape[1] + 1))
    while True:
        work = work[(work[:, 1] < work[:, 2]) & (work[:, 3] < work[:, 4])]
        if not len(work):
            return total
        best = np.concatenate([_longest_runs(a, b, work[at : at + step]) for at in range(0, len(work), step)])
        work, best = work[best[:, 0] > 0], best[best[:, 0] > 0]
        np.add.at(total, work[:, 0], best[:, 0])
        length, i, j = best.T
        left, right = work.copy(), work.copy()
        left[:, 2], left[:, 4] = i, j
        right[:, 1], right[:, 3] = i + length, j + length
        work = np.concatenate([left, right])


def ratios(first: Sequence[str], second: Sequence[str]) -> np.ndarray:
    """Ratio of each pair; two empty texts are alike."""
    a, a_sizes = code_grid(first, -1)
    b, b_sizes = code_grid(second, -2)
    both = a_sizes + b_sizes
    return np.where(both > 0, 2.0 * matched_letters(a, a_sizes, b, b_sizes) / np.maximum(both, 1), 1.0)


def _letters(texts: Sequence[str], alphabet: np.ndarray) -> np.ndarray:
    """How often each text has each letter."""
    grid, sizes = code_grid(texts, -1)
    row, column = np.nonzero(grid >= 0)
    place = row * len(alphabet) + np.searchsorted(alphabet, grid[row, column])
    counts = np.bincount(place, minlength=len(texts) * len(alphabet)).reshape(len(texts), len(alphabet))
    return counts.astype(np.int8 if grid.shape[1] < 128 else np.int32)  # small counts take a quarter of the time below


def most_similar(values: Sequence[str], tokens: Sequence[Sequence[str]]) -> tuple[np.ndarray, list[str]]:
    """For each value the greatest ratio with one of its tokens, and that token, of equal ones the least; 0 and '' without tokens.

    The letters in common bound a ratio from above: first each value meets its token of greatest bound, then only
    those whose bound is as great as what that one gave.
    """
    value_at, value_names = _numbered(values)
    flat = [t for part in tokens for t in part]
    token_at, token_names = _numbered(flat)
    owner = np.repeat(np.arange(len(values)), [len(part) for part in tokens])
    best, chosen = np.zeros(len(values)), [""] * len(values)
    if not len(flat):
        return best, chosen
    alphabet = np.unique(code_grid([*value_names, *token_names], 0)[0])
    ours, theirs = _letters(value_names, alphabet), _letters(token_names, alphabet)
    sizes = np.array([len(v) for v in value_names])[value_at][owner] + np.array([len(t) for t in token_names])[token_at]
    common = np.concatenate([np.minimum(ours[value_at[owner[at : at + 65536]]], theirs[token_at[at : at + 65536]]).sum(1, dtype=np.int64) for at in range(0, len(flat), 65536)])
    bound = np.where(sizes > 0, 2.0 * common / np.maximum(sizes, 1), 1.0)
    order = np.lexsort((token_at, -bound, owner))
    first = order[np.unique(owner[order], return_index=True)[1]]
    rated = np.full(len(flat), -1.0)
    rated[first] = _rate(values, flat, owner, first)
    best[owner[first]] = rated[first]
    again = np.flatnonzero((bound >= best[owner]) & (rated < 0))
    rated[again] = _rate(values, flat, owner, again)
    order = np.lexsort((token_at, -rated, owner))
    for k in order[np.unique(owner[order], return_index=True)[1]].tolist():
        best[owner[k]] = rated[k]
        chosen[owner[k]] = flat[k] if rated[k] > 0 else ""
    return best, chosen


#: Places of a-z and 0-9 in counts of letters; anything else shares one.
_PLACE = np.array([c - 97 if 97 <= c < 123 else c - 22 if 48 <= c < 58 else 36 for c in range(256)], np.int64)


def _counts(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How often each stretch of ASCII letters and digits has each."""
    within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.repeat(np.arange(len(sizes)) * 37, sizes) + _PLACE[data[np.repeat(starts, sizes) + within]]
    return np.bincount(at, minlength=len(sizes) * 37).reshape(len(sizes), 37).astype(np.int8 if sizes.max(initial=0) < 128 else np.int32)


def most_similar_words(values: Sequence[str], lines: Sequence[bytes], width: int, least: float = 0.0) -> tuple[np.ndarray, list[str]]:
    """``most_similar`` for words of lines (ASCII letters and digits; a space before and behind each) whose length is within ``width`` of the value's.

    A ratio below ``least`` counts as none: a word whose letters in common rule out more is not compared.
    """
    best, chosen = np.zeros(len(values)), [""] * len(values)
    data, plain = np.frombuffer(b"".join(lines), np.uint8), [v.encode() for v in values]
    word = data != 32
    starts = np.flatnonzero(word[1:] & ~word[:-1]) + 1
    sizes = np.flatnonzero(word[:-1] & ~word[1:]) + 1 - starts
    owner = np.searchsorted(np.cumsum([len(line) for line in lines]), starts, side="right")
    ours = np.array([len(v) for v in plain], np.int64)
    near = np.abs(sizes - ours[owner]) <= width
    starts, sizes, owner = starts[near], sizes[near], owner[near]
    if not len(starts):
        return best, chosen
    letters = _counts(np.frombuffer(b"".join(plain), np.uint8), np.cumsum(ours) - ours, ours)
    small = letters.dtype == np.int8 and sizes.max() < 128  # sums fit what they are of, which takes a quarter of the time
    pieces = [slice(at, at + 8192) for at in range(0, len(starts), 8192)]
    common = np.concatenate([np.minimum(letters[owner[p]], _counts(data, starts[p], sizes[p])).sum(1, dtype=np.int8 if small else np.int64) for p in pieces])
    bound = 2.0 * common / np.maximum(sizes + ours[owner], 1)
    likely = (bound >= least) & (common > 0)
    starts, sizes, owner, bound = starts[likely], sizes[likely], owner[likely], bound[likely]
    order = np.lexsort((-bound, owner))
    first = order[np.unique(owner[order], return_index=True)[1]]
    rated = np.full(len(starts), -1.0)
    words = {}

    def rate(pairs: np.ndarray) -> None:
        keys = []
        for k, start, size in zip(pairs.tolist(), starts[pairs].tolist(), sizes[pairs].tolist()):
            words[k] = data[start : start + size].tobytes().decode()
            keys.append((values[owner[k]], words[k]))
        different = list(dict.fromkeys(keys))
        found = dict(zip(different, ratios([a for a, _ in different], [b for _, b in different]).tolist())) if different else {}
        rated[pairs] = [found[key] for key in keys]

    rate(first)
    best[owner[first]] = rated[first]
    rate(np.flatnonzero((bound >= best[owner]) & (rated < 0)))
    best[:] = 0.0
    for k, token in words.items():
        at, ratio = owner[k], rated[k]
        if ratio > best[at] or ratio == best[at] and ratio > 0 and token < chosen[at]:
            best[at], chosen[at] = ratio, token
    return best, chosen


def _numbered(texts: Sequence[str]) -> tuple[np.ndarray, list[str]]:
    """Places of texts among the different ones in order, and these."""
    names = sorted(set(texts))
    place = {t: i for i, t in enumerate(names)}
    return np.array([place[t] for t in texts], np.int64), names


def _rate(values: Sequence[str], flat: Sequence[str], owner: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Ratios of pairs, each different one worked out once."""
    keys = [(values[owner[k]], flat[k]) for k in pairs.tolist()]
    different = list(dict.fromkeys(keys))
    place = {key: i for i, key in enumerate(different)}
    found = ratios([a for a, _ in different], [b for _, b in different]) if different else np.zeros(0)
    return found[[place[key] for key in keys]] if keys else np.zeros(0)
