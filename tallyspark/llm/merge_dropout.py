"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding.

A text is split before each run of blanks, as no piece spans a blank after another character, and each
part is merged by an agenda: the best-scored adjacent pair, the leftmost of equals, is merged first.  With
dropout, a candidate (seed, document id, the part's place in the text and three borders) is skipped for good if its
keyed hash falls below the rate, so each occurrence of a word is cut for itself, and a text's segmentation is a
function of seed and id.  Rate 0 gives the library's own pieces.

Many parts are merged at once in numpy: parts of a piece of texts by width, one merge of each part a step.  Parts
over ``LONG`` characters go through a heap instead, with the same result.  Equal parts are merged once where no
candidate is dropped: the candidates met without dropout tell, as none of them dropped means the same merges.

Decoding is lossless for every text: characters outside the vocabulary, and the blank symbol U+2581 itself,
become byte pieces.  Defined results: null and empty texts have no pieces and decode to the empty text; repeated rows encode alike;
rows without id share one key; of equal candidates the leftmost merges first; an empty table gives no rows; other columns, whatever their names, are not read.
A text of any length is encoded whole, PART_BYTES at a time; only a part without blanks needs memory by its own length.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.text_arrays import RunHash, Texts, code_points, map_texts, mix, pieces, spread

BLANK = 0x2581
LONG = 64
_NONE = np.int32(2**31 - 1)
#: Bytes of text worked on at once; a task needs about 300 times as much. Fewer cost more time, as equal parts are merged once each time.
PART_BYTES = 1 << 21


class Vocabulary:
    """Symbols and merges of a BPE model: symbol ids, merged pair -> (rank, id), bytes of ids."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        kind = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) for i in range(n)]
        self.byte = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        ids = {p: i for i, p in enumerate(names) if not kind[i]}
        if any("▁" in p.lstrip("▁") for p in ids):
            raise ValueError("a piece spans a blank")
        order = {s: r for r, s in enumerate(sorted({model.get_score(i) for i in ids.values()}, reverse=True))}
        pairs = {}
        for p, i in ids.items():
            for k in range(1, len(p)):
                if p[:k] in ids and p[k:] in ids:
                    pairs[ids[p[:k]] * n + ids[p[k:]]] = (order[model.get_score(i)], i)
        self.n = n
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], np.int32)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()], np.int32)
        self.pairs = pairs
        self.symbol = np.full(0x110000, -1, np.int32)
        for p, i in ids.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        self.symbol[ord(" ")] = self.symbol[BLANK]
        self.symbol[BLANK] = -1
        raw = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else b"" if kind[i] else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.sizes = np.array([len(r) for r in raw], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.pool = np.frombuffer(b"".join(raw), np.uint8)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged id) of pairs; rank _NONE where they don't merge."""
        key = left.astype(np.int64) * self.n + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        fits = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(fits, self.ranks[at], _NONE), self.merged[at]


def _dropped(part: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray, rate: float) -> np.ndarray:
    """Whether the keyed hash of a candidate lies below the rate; borders are symbol places in the part."""
    u = np.uint64
    h = mix(part ^ mix((start.astype(u) << u(42)) ^ (middle.astype(u) << u(21)) ^ end.astype(u)))
    return (h >> u(11)).astype(np.float64) < rate * float(1 << 53)


def merge_many(vocab: Vocabulary, grid: np.ndarray, part: np.ndarray, rate: float, met: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Merge rows of equal width at once: (symbols left-aligned, their number).

    ``met`` takes the candidates met: arrays of (row, start, middle, end).
    """
    n, width = grid.shape
    out, size = grid.copy(), np.full(n, width, np.int64)
    if width < 2:
        return out, size
    live = np.arange(n)
    sym, key = grid.copy(), part
    border = np.tile(np.arange(width + 1, dtype=np.int16), (n, 1))
    rank, made = vocab.look_up(sym[:, :-1], sym[:, 1:])
    if met is not None:
        row, at = np.nonzero(rank < _NONE)
        met.append((row, at, at + 1, at + 2))
    if rate:
        drop = _dropped(key[:, None], border[:, :-2], border[:, 1:-1], border[:, 2:], rate)
        rank[drop] = _NONE
    while len(live):
        best = rank.argmin(axis=1)
        rows = np.arange(len(live))
        open_ = rank[rows, best] < _NONE
        if not open_.all():
            done = ~open_
            w = sym.shape[1]
            out[live[done], :w], size[live[done]] = sym[done], w
            live, sym, key, border, rank, made, best = (a[open_] for a in (live, sym, key, border, rank, made, best))
            rows = np.arange(len(live))
            if not len(live):
                break
        w = sym.shape[1]
        sym[rows, best] = made[rows, best]
        keep = np.ones((len(live), w), bool)
        keep[rows, best + 1] = False
        sym = sym[keep].reshape(len(live), w - 1)
        edge = np.ones((len(live), w + 1), bool)
        edge[rows, best + 1] = False
        border = border[edge].reshape(len(live), w)
        if w == 2:
            out[live, :1], size[live] = sym, 1
            break
        gone = np.ones((len(live), w - 1), bool)
        gone[rows, best] = False
        rank, made = rank[gone].reshape(len(live), w - 2), made[gone].reshape(len(live), w - 2)
        for shift in (-1, 0):
            at = best + shift
            ok = np.flatnonzero((at >= 0) & (at < w - 2))
            j = at[ok]
            r, m = vocab.look_up(sym[ok, j], sym[ok, j + 1])
            if met is not None:
                fits = np.flatnonzero(r < _NONE)
                i, k = ok[fits], j[fits]
                met.append((live[i], border[i, k], border[i, k + 1], border[i, k + 2]))
            if rate:
                r[_dropped(key[ok], border[ok, j], border[ok, j + 1], border[ok, j + 2], rate)] = _NONE
            rank[ok, j], made[ok, j] = r, m
    return out, size


def merge_long(vocab: Vocabulary, symbols: np.ndarray, part: int, rate: float) -> list[int]:
    """The same by a heap, for one long part."""
    sym: list[int | None] = symbols.tolist()
    n = len(sym)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    key = np.array([part], np.uint64)
    heap: list[tuple[int, int, int, int, int]] = []

    def offer(a: int) -> None:
        b = after[a] if a >= 0 else n
        if a < 0 or b >= n:
            return
        found = vocab.pairs.get(sym[a] * vocab.n + sym[b]) if sym[a] >= 0 and sym[b] >= 0 else None
        if found is None:
            return
        if rate and _dropped(key, np.array([a]), np.array([b]), np.array([after[b]]), rate)[0]:
            return
        heapq.heappush(heap, (found[0], a, b, after[b], found[1]))

    for a in range(n - 1):
        offer(a)
    while heap:
        _, a, b, end, made = heapq.heappop(heap)
        if sym[a] is None or sym[b] is None or after[a] != b or after[b] != end or vocab.pairs.get(sym[a] * vocab.n + sym[b], (0, -1))[1] != made:
            continue
        sym[a], sym[b] = made, None
        after[a] = end
        if end < n:
            before[end] = a
        offer(before[a])
        offer(a)
    return [s for s in sym if s is not None]


class _Merged:
    """Pieces of parts, in one pool; parts are rows of (start, size) in ``symbols``."""

    def __init__(self, vocab: Vocabulary, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray, parts: np.ndarray, rate: float, met: list | None = None):
        pools: list[np.ndarray] = [np.zeros(0, np.int32)]
        self.start, self.size, used = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64), 0
        order = np.argsort(sizes, kind="stable")
        bounds = np.searchsorted(sizes[order], np.arange(1, LONG + 2))
        for width in range(1, LONG + 1):
            chosen = order[bounds[width - 1] : bounds[width]]
            if len(chosen):
                grid = symbols[starts[chosen][:, None] + np.arange(width)]
                # An unknown character carries its place until the end, below -1.
                grid = np.where(grid < 0, -2 - np.arange(width, dtype=np.int32), grid)
                seen: list | None = None if met is None else []
                merged, size = merge_many(vocab, grid, parts[chosen], rate, seen)
                if met is not None:
                    met += [(chosen[row], *borders) for row, *borders in seen]
                flat = merged[np.arange(width) < size[:, None]]
                self.start[chosen], self.size[chosen] = used + np.cumsum(size) - size, size
                pools.append(flat)
                used += len(flat)
        for k in order[bounds[LONG] :].tolist():
            grid = symbols[starts[k] : starts[k] + sizes[k]]
            ids = np.array(merge_long(vocab, np.where(grid < 0, -2 - np.arange(len(grid), dtype=np.int32), grid), int(parts[k]), rate), np.int32)
            self.start[k], self.size[k] = used, len(ids)
            pools.append(ids)
            used += len(ids)
        self.pool = np.concatenate(pools)


def _untouched(word: np.ndarray, words: int, parts: np.ndarray, met: list, rate: float) -> np.ndarray:
    """Whether no candidate of a part (of the word of that number) is dropped; ``met`` are those of the words."""
    if not met:
        return np.ones(len(parts), bool)
    of, start, middle, end = (np.concatenate(c) for c in zip(*met))
    order = np.argsort(of, kind="stable")
    start, middle, end = start[order], middle[order], end[order]
    count = np.bincount(of, minlength=words)
    begin, each = (np.cumsum(count) - count)[word], count[word]
    at, part = spread(begin, each), np.repeat(np.arange(len(parts)), each)
    drop = _dropped(parts[part], start[at], middle[at], end[at], rate)
    clean = np.ones(len(parts), bool)
    clean[part[drop]] = False
    return clean


def encode_piece(vocab: Vocabulary, piece: Texts, doc: np.ndarray, rate: float, seed: int, before: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """(ids of all texts in a row, first id of each text, number of parts); ``doc`` are the texts' document ids.

    With ``before`` the piece is the rest of one text, from a blank on, behind so many parts.
    """
    full = np.flatnonzero(np.diff(piece.offsets))
    if not len(full):
        return np.zeros(0, np.int32), np.zeros(len(piece) + 1, np.int64), 0
    # A blank stands before each text that isn't empty.
    at, cp = code_points(piece.data)
    lead = np.searchsorted(at, piece.offsets[full])
    cp = cp if before else np.insert(cp, lead, 0x20)
    begin = lead if before else lead + np.arange(len(full))
    owner = np.zeros(len(cp), np.int64)
    owner[begin] = np.diff(full, prepend=0)
    owner = np.cumsum(owner)
    blank = cp == 0x20
    first = blank.copy()
    first[1:] &= ~blank[:-1]
    first[begin] = True
    starts = np.flatnonzero(first)
    sizes = np.diff(np.append(starts, len(cp)))
    # A part's key: seed, document id and its place in the text.
    salt = mix(doc.astype(np.uint64) ^ mix(np.array([seed], np.int64).view(np.uint64)))
    place = before + np.arange(len(starts)) - np.searchsorted(starts, begin)[np.searchsorted(full, owner[starts])]
    parts = mix(salt[owner[starts]] + place.astype(np.uint64))
    words, where, back = np.unique(RunHash(cp.astype(np.uint64) + np.uint64(1), "byte").of(starts, starts + sizes), return_index=True, return_inverse=True)

    symbols = vocab.symbol[cp]
    # Long parts have a merge each under dropout.
    shared = np.flatnonzero(sizes[where] <= LONG) if rate else np.arange(len(words))
    met: list | None = [] if rate else None
    plain = _Merged(vocab, symbols, starts[where[shared]], sizes[where[shared]], np.zeros(len(shared), np.uint64), 0, met)
    number = np.full(len(words), -1)
    number[shared] = np.arange(len(shared))
    word = number[back]
    touched = word < 0
    if rate:
        some = np.flatnonzero(~touched)
        touched[some] = ~_untouched(word[some], len(shared), parts[some], met, rate)
    own = np.flatnonzero(touched)
    cut = _Merged(vocab, symbols, starts[own], sizes[own], parts[own], rate)
    rest = np.flatnonzero(~touched)
    begins, each = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    begins[rest], each[rest] = plain.start[word[rest]], plain.size[word[rest]]
    begins[own], each[own] = cut.start + len(plain.pool), cut.size
    ids = np.concatenate([plain.pool, cut.pool])[spread(begins, each)]
    part_owner = owner[starts]
    # Unknown characters become their bytes.
    which = np.flatnonzero(ids < 0)
    row = np.repeat(part_owner, each)
    if len(which):
        place = np.repeat(starts, each)[which] + (-2 - ids[which])
        raw = [chr(c).encode() for c in cp[place].tolist()]
        width = np.ones(len(ids), np.int64)
        width[which] = [len(r) for r in raw]
        ids, row = np.repeat(ids, width), np.repeat(row, width)
        ids[ids < 0] = vocab.byte[np.frombuffer(b"".join(raw), np.uint8)]
    return ids, np.searchsorted(row, np.arange(len(piece) + 1)), len(starts)


def encode_texts(vocab: Vocabulary, piece: Texts, doc: np.ndarray, rate: float, seed: int, part_bytes: int = PART_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in a row, first id of each text); a single long text goes from blank to blank."""
    if len(piece) > 1 or len(piece.data) <= part_bytes:
        return encode_piece(vocab, piece, doc, rate, seed)[:2]
    blank = piece.data == 0x20
    cuts = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    at, parts, found = 0, 0, []
    while at < len(piece.data):
        k = np.searchsorted(cuts, at + part_bytes)
        to = int(cuts[k]) if k < len(cuts) else len(piece.data)
        ids, _, n = encode_piece(vocab, Texts(piece.rows, piece.data[at:to], np.array([0, to - at])), doc, rate, seed, parts)
        found.append(ids)
        at, parts = to, parts + n
    ids = np.concatenate(found)
    return ids, np.array([0, len(ids)])


def decode_ids(vocab: Vocabulary, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row and their offsets; the blank before each text is taken off."""
    size = vocab.sizes[ids]
    data = vocab.pool[spread(vocab.starts[ids], size)]
    offsets = np.concatenate([[0], np.cumsum(size)])[first]
    full = np.diff(offsets) > 0
    data = np.delete(data, offsets[:-1][full])
    return data, offsets - np.concatenate([[0], np.cumsum(full)])


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def encode(docs: DataFrame, model_path: str, rate: float = 0.1, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, ids array<int>, lossless): lossless tells whether the pieces decode to the very text; ``part_bytes`` changes memory and time alone."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model_path)
        for piece in pieces(batches, "text", part_bytes):
            ids_in = piece.rows.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            ids, first = encode_texts(vocab, piece, ids_in.view(np.uint64), rate, seed, part_bytes)
            data, offsets = decode_ids(vocab, ids, first)
            same = np.diff(offsets) == np.diff(piece.offsets)
            if same.all():
                wrong = np.flatnonzero(data != piece.data)
                same[np.searchsorted(piece.offsets, wrong, "right") - 1] = False
            else:
                mine, theirs = data.tobytes(), piece.data.tobytes()
                same = np.array([mine[a:b] == theirs[c:d] for a, b, c, d in zip(offsets, offsets[1:], piece.offsets, piece.offsets[1:])])
            lists = pa.LargeListArray.from_arrays(pa.array(first.astype(np.int64)), pa.array(ids.astype(np.int32))).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([piece.rows.column("doc_id"), lists, pa.array(same)], ["doc_id", "ids", "lossless"])

    return map_texts(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, ids array<int>, lossless boolean")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model_path)
        for batch in batches:
            lists = batch.column("ids")
            sizes = np.array([x or 0 for x in lists.value_lengths().to_pylist()], np.int64)
            data, offsets = decode_ids(vocab, lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)]))
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([raw[a:b] for a, b in zip(offsets, offsets[1:])], pa.binary()).cast(pa.string())], ["doc_id", "text"])

    return map_texts(encoded.select("doc_id", "ids"), run, "doc_id long, text string")
