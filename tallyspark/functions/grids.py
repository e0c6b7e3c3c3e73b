"""Values at labels in sheets of cells, for all documents of an Arrow batch at once.

Cells are read as columns: each different text is tidied and compared with the labels once, and neighbours are places in arrays.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BLANK = "[ \\t\\n\\x0B\\f\\r\\x{00A0}\\x{2007}\\x{202F}]+"


class Cells(NamedTuple):
    """Cells in order of document, sheet, row and column; ``doc``, ``sheet`` and ``r`` are told of each row."""

    doc: np.ndarray
    sheet: np.ndarray
    r: np.ndarray
    row: np.ndarray
    c: np.ndarray
    text: pa.Array


class Label(NamedTuple):
    """A label of a template's field, ``place`` being that of the field's column in the result."""

    template: int
    place: int
    order: int
    label: str
    length: int
    tabular: bool


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _owners(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each element of lists, the list it is in and its place there."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    return owner, np.arange(len(owner)) - (np.cumsum(lengths) - lengths)[owner]


def of_texts(texts: pa.Array) -> Cells:
    """Cells of flattened texts: lines, then parts between three blanks."""
    lines = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    doc, r = _owners(_lengths(lines))
    parts = pc.split_pattern(lines.flatten(), "   ")
    row, c = _owners(_lengths(parts))
    return Cells(doc, np.zeros(len(doc), np.int64), r, row, c, parts.flatten())


def of_rows(rows: pa.Array) -> Cells:
    """Cells of arrays of rows (sheet, r, cells), these being arrays of (c, text)."""
    doc, flat = _owners(_lengths(rows))[0], rows.flatten()
    lists = pc.struct_field(flat, "cells")
    row, cells = _owners(_lengths(lists))[0], lists.flatten()
    whole = lambda x, name: pc.struct_field(x, name).to_numpy(zero_copy_only=False).astype(np.int64)
    return Cells(doc, whole(flat, "sheet"), whole(flat, "r"), row, whole(cells, "c"), pc.fill_null(pc.struct_field(cells, "text"), ""))


class _Texts:
    """The different texts of a batch, tidied, with what each has to do with the labels."""

    def __init__(self, text: pa.Array, labels: Sequence[str]):
        coded = text.dictionary_encode()
        self.code = coded.indices.to_numpy(zero_copy_only=False)
        self.tidy = pc.utf8_trim(pc.replace_substring_regex(coded.dictionary, pattern=_BLANK, replacement=" "), characters=" ")
        ascii_only = pc.all(pc.string_is_ascii(self.tidy)).as_py() is not False
        low = pc.ascii_lower(self.tidy) if ascii_only else pa.array([x.lower() for x in self.tidy.to_pylist()], pa.string())
        key = pc.utf8_rtrim(low, characters=" :#.")
        self.blank = pc.equal(self.tidy, "").to_numpy(zero_copy_only=False)
        self.at = {label: k for k, label in enumerate(labels)}
        #: By text and label: whether the text begins with it, is it, and whether it is it or goes on as behind a label.
        self.starts, self.equal = (np.zeros((len(key), len(labels)), bool) for _ in range(2))
        for k, label in enumerate(labels):
            self.starts[:, k] = pc.starts_with(key, pattern=label).to_numpy(zero_copy_only=False)
        self.named = self.starts.copy()
        for k, label in enumerate(labels):
            some = np.flatnonzero(self.starts[:, k])
            after = pc.utf8_slice_codeunits(key.take(pa.array(some)), len(label), len(label) + 1)
            self.equal[some, k] = pc.equal(after, "").to_numpy(zero_copy_only=False)
            self.named[some, k] = pc.is_in(after, value_set=pa.array(["", ":", "-", "=", " ", "."])).to_numpy(zero_copy_only=False)

    def take(self, cells: np.ndarray) -> pa.Array:
        return self.tidy.take(pa.array(self.code[cells]))


def _beside(cells: Cells, at: np.ndarray, right: int) -> Iterator[np.ndarray]:
    """Next cells of the row, one by one in order, by place; -1 where there is none."""
    for step in range(1, len(cells.c)):
        near = np.minimum(at + step, len(cells.c) - 1)
        within = (at + step < len(cells.c)) & (cells.row[near] == cells.row[at]) & (cells.c[near] <= cells.c[at] + right)
        if not within.any():
            return
        yield np.where(within & (cells.c[near] > cells.c[at]), near, -1)


def _beneath(cells: Cells, at: np.ndarray, below: int) -> Iterator[np.ndarray]:
    """Cells of the same column in the next rows, in order."""
    row, least = cells.row[at], cells.c.min(initial=0)
    width = cells.c.max(initial=0) - least + 1
    place = cells.row * width + cells.c - least
    for down in range(1, below + 1):
        near = np.minimum(row + down, len(cells.doc) - 1)
        within = (row + down < len(cells.doc)) & (cells.doc[near] == cells.doc[row]) & (cells.sheet[near] == cells.sheet[row]) & (cells.r[near] <= cells.r[row] + below)
        want = near * width + cells.c[at] - least
        first = np.searchsorted(place, want)
        for more in range(len(place)):
            found = np.minimum(first + more, len(place) - 1)
            there = within & (first + more < len(place)) & (place[found] == want)
            if not there.any():
                break
            yield np.where(there, found, -1)


def _first_value(texts: _Texts, neighbours: Iterator[np.ndarray], known: np.ndarray, own: int, n: int) -> np.ndarray:
    """The first filled neighbour that isn't a label; -1 if none, or as soon as another field's cell comes first."""
    others = known.copy()
    others[own] = False
    out, open_ = np.full(n, -1), np.ones(n, bool)
    for cell in neighbours:
        some = np.flatnonzero(open_ & (cell >= 0))
        code = texts.code[cell[some]]
        some, code = some[~texts.blank[code]], code[~texts.blank[code]]
        elsewhere, label = (texts.named[code] & others).any(axis=1), (texts.equal[code] & known).any(axis=1)
        out[some[~elsewhere & ~label]] = cell[some[~elsewhere & ~label]]
        open_[some[elsewhere | ~label]] = False
    return out


def values_at_labels(cells: Cells, template: np.ndarray, labels: Sequence[Label], known: Sequence[Sequence[str]], columns: int, right: int, below: int) -> list[pa.Array]:
    """By column, each document's value or null: of filled values at a field's labels the first by label, sheet, row and column.

    A cell's rest, else its neighbours, below first when tabular.
    """
    texts = _Texts(cells.text, sorted({x.label for x in labels} | {x for names in known for x in names}))
    masks = [np.isin(np.array(list(texts.at)), np.array(list(names), dtype=str)) for names in known]
    wanted = sorted({texts.at[x.label] for x in labels})
    hits = np.flatnonzero(texts.starts[:, wanted].any(axis=1)[texts.code]) if len(texts.code) else np.zeros(0, np.int64)
    starts, kinds = texts.starts[texts.code[hits]], template[cells.doc[cells.row[hits]]]
    found: list[list] = [[] for _ in range(columns)]
    for x in labels:
        own = texts.at[x.label]
        at = hits[starts[:, own] & (kinds == x.template)]
        if not len(at):
            continue
        value = pc.utf8_slice_codeunits(pc.utf8_trim(pc.utf8_slice_codeunits(texts.take(at), x.length), characters=" :-#./\t"), 0, 300)
        bare = np.flatnonzero(pc.equal(value, "").to_numpy(zero_copy_only=False))
        if len(bare):
            ways = [lambda at: _beside(cells, at, right), lambda at: _beneath(cells, at, below)]
            chosen = np.full(len(bare), -1)
            for way in reversed(ways) if x.tabular else ways:
                rest = np.flatnonzero(chosen < 0)
                chosen[rest] = _first_value(texts, way(at[bare[rest]]), masks[x.template], own, len(rest))
            taken = np.full(len(at), -1)
            taken[bare] = chosen
            beside = pc.utf8_slice_codeunits(texts.take(np.maximum(taken, 0)), 0, 300)
            value = pc.if_else(pa.array(taken >= 0), beside, value)
        full = np.flatnonzero(pc.not_equal(value, "").to_numpy(zero_copy_only=False))
        found[x.place].append((cells.doc[cells.row[at[full]]], np.full(len(full), x.order), at[full], value.take(pa.array(full))))
    out = []
    for parts in found:
        if not parts:
            out.append(pa.nulls(len(template), pa.string()))
            continue
        doc, order, cell = (np.concatenate([p[k] for p in parts]) for k in range(3))
        best = np.lexsort((cell, order, doc))
        best = best[np.unique(doc[best], return_index=True)[1]]
        place = np.full(len(template), -1)
        place[doc[best]] = best
        out.append(pa.concat_arrays([p[3] for p in parts]).take(pa.array(place, mask=place < 0)))
    return out
