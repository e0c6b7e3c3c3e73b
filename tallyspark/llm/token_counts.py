"""Token counts of a byte-level BPE vocabulary by compiled finite-state transducers.

Two deterministic transducers are compiled from a public tokenizer file:

* The *splitter* reads character classes and marks where pre-tokens begin, as the byte-level
  pre-tokenizer's pattern does.  It has 13 states.  A text is cut in chunks; each
  chunk's map from start state to end state is built for all states at once, the maps
  compose in a parallel prefix scan, and every chunk then knows its start state.
* The *counter* reads the bytes of one pre-token and annotates each transition with
  a number of emitted tokens.  An encoding is right exactly if no merge crosses the border of two adjacent
  tokens, which the merge table decides, so the open encodings of a
  prefix are a finite set (last token, trie node, tokens so far); such sets, their least
  count emitted, are the states.  There are too many to list them all, so they are made when first met, into arrays that
  all chunks of a batch then step through together.  A chunk's map (state, count) is constant where a boundary opens
  the chunk; maps of the chunks within a long run hold the entry states that the chunk before can leave, and compose in a
  parallel prefix scan like the splitter's.

Defined results: a null text counts as empty (no bytes, no tokens); added tokens that stand in
a text count as one token each, as the library's default has it; repeated rows each give a row, ties can't
arise; a null id stays null; an empty table gives no rows; other columns, whatever their names, are not read.
A text of any length is worked through whole; beyond 4 MiB in slices that end where a token surely does, so in memory of about 40 times a slice.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.text_arrays import Texts, code_points, map_texts, per_row, pieces, spread

# Classes of characters. R, V, L, E and the finals s t m d matter in English contractions only.
LETTER, FINAL, R, V, L, E, NUMBER, SPACE, WHITE, OTHER, QUOTE, CONT, RESET = range(13)
# States of the splitter, named for what was read last.
(BEGIN, ONE_SPACE, ONE_WHITE, MORE_SPACE, MORE_WHITE, IN_LETTERS, IN_NUMBERS, IN_OTHER, AT_QUOTE, QUOTE_R, QUOTE_V, QUOTE_L, CONTRACTED) = range(13)
CHUNK = 256


def splitter_table() -> np.ndarray:
    """Next state by (state, class)."""
    letters = (LETTER, FINAL, R, V, L, E)
    table = np.zeros((13, 13), np.uint8)
    for state in range(13):
        for kind in range(13):
            if kind == CONT:
                to = state
            elif kind == RESET:
                to = BEGIN
            elif kind in (SPACE, WHITE):
                more = state in (ONE_SPACE, ONE_WHITE, MORE_SPACE, MORE_WHITE)
                to = (MORE_SPACE if kind == SPACE else MORE_WHITE) if more else (ONE_SPACE if kind == SPACE else ONE_WHITE)
            elif state == AT_QUOTE and kind in (FINAL, R, V, L):
                to = {FINAL: CONTRACTED, R: QUOTE_R, V: QUOTE_V, L: QUOTE_L}[kind]
            elif (state, kind) in ((QUOTE_R, E), (QUOTE_V, E), (QUOTE_L, L)):
                to = CONTRACTED
            elif kind in letters:
                to = IN_LETTERS
            elif kind == NUMBER:
                to = IN_NUMBERS
            elif kind == QUOTE and state not in (ONE_SPACE, MORE_SPACE, IN_OTHER, AT_QUOTE):
                to = AT_QUOTE
            else:
                to = IN_OTHER
            table[state, kind] = to
    return table


def class_table() -> np.ndarray:
    """Class of each code point, from the Unicode properties letter, number and white space."""
    major = np.array([unicodedata.category(chr(c))[0] for c in range(0x110000)])
    table = np.select([major == "L", major == "N"], [LETTER, NUMBER], OTHER).astype(np.uint8)
    table[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = WHITE
    for kind, chars in ((FINAL, "stmd"), (R, "r"), (V, "v"), (L, "l"), (E, "e"), (SPACE, " "), (QUOTE, "'")):
        table[[ord(c) for c in chars]] = kind
    return table


def through(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """``table`` (at most 256 bytes) at each of the bytes x."""
    return np.frombuffer(x.tobytes().translate(table.astype(np.uint8).tobytes().ljust(256, b"\0")), np.uint8).reshape(x.shape)


def scan_edges(classes: np.ndarray, table: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """The transition taken at each class from BEGIN, as (state before) * classes + class: chunk maps and a parallel prefix scan over them."""
    n, (states, width) = len(classes), table.shape
    count = max(1, -(-n // chunk))
    grid = np.full(count * chunk, CONT, np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(count, chunk).T)
    # States are kept times ``width``, so that an addition makes an edge of state and class.
    step_to = (table * width).ravel()
    maps = np.tile(np.arange(states, dtype=np.uint8) * np.uint8(width), (count, 1))
    for column in grid:
        maps = through(step_to, maps + column[:, None])
    maps = maps // np.uint8(width)
    step = 1
    while step < count:  # inclusive scan: maps[i] becomes the map of chunks 0..i
        maps = np.concatenate([maps[:step], np.take_along_axis(maps[step:], maps[:-step], axis=1)])
        step *= 2
    now = np.concatenate([[BEGIN], maps[:-1, BEGIN]]).astype(np.uint8) * np.uint8(width)
    out = np.empty((chunk, count), np.uint8)
    for k, column in enumerate(grid):
        out[k] = now + column
        now = through(step_to, out[k])
    return out.T.ravel()[:n]


def boundary_table(table: np.ndarray) -> np.ndarray:
    """By edge: 1 if a pre-token begins at the class read, 2 if one began at the class before it after all."""
    white, quoted = (ONE_SPACE, ONE_WHITE, MORE_SPACE, MORE_WHITE), (QUOTE_R, QUOTE_V, QUOTE_L)
    out = np.zeros(table.shape, np.uint8)
    for before in range(table.shape[0]):
        for kind in range(table.shape[1]):
            after = int(table[before, kind])
            if kind in (CONT, RESET):
                begins = False
            elif kind in (SPACE, WHITE):
                begins = before not in white
            elif before in white:
                begins = before in (ONE_WHITE, MORE_WHITE)
            elif before in quoted:  # with the quote, or with the letter that turned out to begin a word
                begins = after not in (CONTRACTED, IN_LETTERS)
            elif before == AT_QUOTE:
                begins = after not in (CONTRACTED, IN_OTHER, *quoted)
            else:
                begins = after != before or before == CONTRACTED
            # The last of several white characters stands apart; so does the letter after a quote that begins no contraction.
            late = kind not in (CONT, RESET, SPACE, WHITE) and before in (MORE_SPACE, MORE_WHITE)
            late = late or (before in quoted and after != CONTRACTED)
            out[before, kind] = begins | late << 1
    return out.ravel()


def boundaries(edges: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Whether a pre-token begins at each place."""
    found = through(flags, edges)
    begins = (found & 1).astype(bool)
    begins[:-1] |= found[1:] > 1
    return begins


class Counter:
    """The counting transducer of one vocabulary: transitions made when first met.

    ``merges`` maps a pair of tokens to (rank, the token it makes).
    """

    #: Entries of the transition table before it starts anew.
    MOST = 48 << 20
    #: Entry states that the map of a chunk within a long run holds at most.
    ENTRIES = 8

    def __init__(self, vocab: dict[bytes, int], merges: dict[tuple[int, int], tuple[int, int]]):
        self.rank = {a << 20 | b: rank for (a, b), (rank, _) in merges.items()}
        last = float("inf")
        #: Tokens at a token's right and left edge as it is built, each with the rank of the merge that takes it up.
        self.right = {vocab[bytes([b])]: ((vocab[bytes([b])], last),) for b in range(256)}
        self.left = dict(self.right)
        absent: set[int] = set()
        for (a, b), (rank, made) in sorted(merges.items(), key=lambda m: m[1][0]):
            absent.update(x for x in (a, b) if x not in self.right)  # tokens that no text gives, so neither does this merge
            # What a pair makes is a token of its own bytes unless another merge breaks the pair first.
            if not absent & {a, b} and made not in self.right and self.parts_stand(a, b, rank):
                if made in absent:
                    raise ValueError("a merge stands before those that make its parts")
                self.right[made] = (made, last), (b, rank), *self.right[b][1:]
                self.left[made] = (made, last), (a, rank), *self.left[a][1:]
        self.child: dict[int, int] = {}
        self.token, parent = [-1], [0]
        for word, i in vocab.items():
            if i not in self.right:
                continue
            node = 0
            for x in word:
                key = node << 8 | x
                if key not in self.child:
                    self.child[key] = len(self.token)
                    self.token.append(-1)
                    parent.append(node)
                node = self.child[key]
            self.token[node] = i
        self.below: list[list[int]] = [[] for _ in self.token]
        for node in range(len(self.token) - 1, 0, -1):
            up = parent[node] if self.token[node] >= 0 else 0
            while up and len(self.below[up]) <= 3:
                self.below[up].append(self.token[node])
                up = parent[up]
        self.reset()

    def reset(self) -> None:
        self.paired: dict[int, bool] = {}
        self.kept: dict[tuple[int, int], int | None] = {}
        self.alike: dict[tuple, int] = {}
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.columns = np.full(256, -1, np.int32)
        self.n_columns = 0
        self.next = np.full((1024, 16), -1, np.int32)
        self.emit = np.zeros((1024, 16), np.int8)
        self.final = np.zeros(1024, np.int16)
        self.state(((-1, 0, 0),))

    def parts_stand(self, a: int, b: int, before: float) -> bool:
        """Whether no merge of a rank below ``before`` crosses the border of tokens a and b.

        A merge crosses if its two sides stand at the border at once: neither has been taken up by
        a merge within its own token, where of equal ranks the one further left comes first.
        """
        rank = self.rank
        for p, p_end in self.right[a]:
            for q, q_end in self.left[b]:
                r = rank.get(p << 20 | q)
                if r is not None and r < p_end and r <= q_end and r < before:
                    return False
        return True

    def fits(self, last: int, token: int) -> bool:
        """Whether the two tokens, side by side, are the encoding of their bytes."""
        if last < 0:
            return True
        key = last << 20 | token
        found = self.paired.get(key)
        if found is None:
            found = self.paired[key] = self.parts_stand(last, token, float("inf"))
        return found

    def canonical(self, last: int, node: int) -> int | None:
        """A last token that behaves as this one below the node; None if nothing below can follow."""
        if last < 0 or len(self.below[node]) > 3:
            return last
        key = last, node
        if key not in self.kept:
            fit = tuple([self.fits(last, t) for t in self.below[node]])
            self.kept[key] = self.alike.setdefault((node, fit), last) if True in fit else None
        return self.kept[key]

    def state(self, key: tuple) -> int:
        found = self.ids.get(key)
        if found is None:
            self.ids[key] = found = len(self.states)
            self.states.append(key)
            if found >= len(self.next):
                more = len(self.next) // 2
                self.next = np.concatenate([self.next, np.full((more, self.next.shape[1]), -1, np.int32)])
                self.emit = np.concatenate([self.emit, np.zeros((more, self.emit.shape[1]), np.int8)])
                self.final = np.concatenate([self.final, np.zeros(more, np.int16)])
            self.final[found] = next(k for _, node, k in key if node == 0)
        return found

    def make(self, state: int, byte: int) -> tuple[int, int]:
        """(state after the byte, tokens emitted): the least count of the open encodings moves to the transition."""
        opened, child, tokens = [], self.child, self.token
        for last, node, k in self.states[state]:
            to = child.get(node << 8 | byte)
            if to is None:
                continue
            same = self.canonical(last, to) if self.below[to] else None
            if same is not None:
                opened.append((same, to, k))
            token = tokens[to]
            if token >= 0 and self.fits(last, token):
                opened.append((token, 0, k + 1))
        least = min([k for _, _, k in opened])
        if least:
            opened = [(last, node, k - least) for last, node, k in opened]
        opened.sort()
        return self.state(tuple(opened)), least

    def open_columns(self, data: np.ndarray) -> None:
        for byte in np.flatnonzero(np.bincount(data, minlength=256)):
            if self.columns[byte] < 0:
                if self.n_columns == self.next.shape[1]:
                    wide = min(256, 2 * self.n_columns)
                    self.next = np.concatenate([self.next, np.full((len(self.next), wide - self.n_columns), -1, np.int32)], axis=1)
                    self.emit = np.concatenate([self.emit, np.zeros((len(self.emit), wide - self.n_columns), np.int8)], axis=1)
                self.columns[byte] = self.n_columns
                self.n_columns += 1

    def walk(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each chunk's map applied to the state that it is entered with: (state after it, tokens emitted)."""
        order = np.argsort(-size.astype(np.int16), kind="stable")
        begin, shrink = begin[order], -size[order]
        state, total = entry[order].astype(np.int32), np.zeros(len(begin), np.int32)
        column = self.columns[data]
        for k in range(-int(shrink[0]) if len(shrink) else 0):
            live = int(np.searchsorted(shrink, -k, "left"))
            at, wide = begin[:live] + k, self.next.shape[1]
            edge = state[:live].astype(np.int64) * wide + column[at]
            to = self.next.ravel().take(edge)
            missing = np.flatnonzero(to < 0)
            if len(missing):
                new, back = np.unique(state[missing].astype(np.int64) << 8 | data[at[missing]], return_inverse=True)
                made = [self.make(x >> 8, x & 255) for x in new.tolist()]
                row, col = new >> 8, self.columns[new & 255]
                self.next[row, col], self.emit[row, col] = [m[0] for m in made], [m[1] for m in made]
                to[missing] = self.next[row, col][back]
            total[:live] += self.emit.ravel().take(edge)
            state[:live] = to
        after, emitted = np.empty(len(begin), np.int32), np.empty(len(begin), np.int64)
        after[order], emitted[order] = state, total
        return after, emitted

    def count(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of each run of bytes between boundaries.

        Runs are cut in chunks.  A chunk behind a boundary has a constant map (state and count whatever came before);
        the maps of later chunks of long runs compose with it in a parallel prefix scan, see ``follow``.
        """
        if self.next.size > self.MOST:
            self.reset()
        self.open_columns(data)
        chunks = -(-lengths // CHUNK)
        first = np.cumsum(chunks) - chunks
        place = spread(np.zeros(len(chunks), np.int64), chunks)
        begin = np.repeat(starts, chunks) + CHUNK * place
        size = np.minimum(np.repeat(starts + lengths, chunks) - begin, CHUNK)
        state, emitted = np.zeros(len(begin), np.int32), np.zeros(len(begin), np.int64)
        heads, later = np.flatnonzero(place == 0), np.flatnonzero(place)
        state[heads], emitted[heads] = self.walk(data, begin[heads], size[heads], state[heads])
        if len(later):
            state[later], emitted[later] = self.follow(data, begin[later], size[later], place[later] == 1, state[later - 1])
        return per_row(emitted, np.append(first, len(begin))) + self.final[state[first + chunks - 1]]

    def follow(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, head: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state after, tokens emitted) of chunks that follow each other; one marked ``head`` is entered with its ``entry``.

        A chunk's map holds as many entry states as may matter: the start state, as a guess, and all that the map of the
        chunk before leaves.  Encodings from different states soon agree, so two or three entries are the rule.
        Maps of all chunks grow side by side until they are closed, and then compose in a prefix scan.  One with ``ENTRIES`` of them
        takes no more guesses; where the true state is not among them it takes the place of one, and the scan is run again.
        """
        n, rows = len(begin), np.arange(len(begin))
        enters, leaves, counts = (np.full((n, self.ENTRIES), -1, t) for t in (np.int32, np.int32, np.int64))
        enters[:, 0] = np.where(head, entry, 0)
        joined = np.append(~head[1:], False)  # whether the next chunk follows this one
        todo = rows, np.zeros(n, np.int64)
        sure = False
        while True:
            while len(todo[0]):
                at, slot = todo
                leaves[at, slot], counts[at, slot] = self.walk(data, begin[at], size[at], enters[at, slot])
                at, left = at[joined[at]] + 1, leaves[at, slot][joined[at]]
                new = (enters[at] != left[:, None]).all(axis=1)
                key = np.unique(at[new] << 32 | left[new])
                at, left = key >> 32, key & 0xFFFFFFFF
                # New states of one chunk take its free places one after the other.
                nth = np.arange(len(at)) - np.searchsorted(at, at)
                slot = (enters[at] >= 0).sum(axis=1) + nth
                slot = np.minimum(slot, self.ENTRIES - 1) if sure else slot
                fits = slot < self.ENTRIES
                todo = at[fits], slot[fits]
                enters[todo] = left[fits]
            # A map takes the place of an entry in its own chunk to that in the next; ENTRIES stands for one that isn't there.
            same = (leaves[:-1, :, None] == enters[1:, None, :]) & (leaves[:-1, :, None] >= 0)
            maps = np.full((n, self.ENTRIES + 1), self.ENTRIES, np.int64)
            maps[1:, :-1] = np.where(same.any(axis=2), same.argmax(axis=2), self.ENTRIES)
            maps[head] = 0
            step = 1
            while step < n:  # inclusive scan, as that of the splitter's maps
                maps = np.concatenate([maps[:step], np.take_along_axis(maps[step:], maps[:-step], axis=1)])
                step *= 2
            slot = maps[:, 0]
            lost = np.flatnonzero((slot == self.ENTRIES) & np.append(0, slot[:-1] != self.ENTRIES).astype(bool))
            if not len(lost):
                return leaves[rows, slot], counts[rows, slot]
            sure, last = True, np.full(len(lost), self.ENTRIES - 1)
            enters[lost, last] = leaves[lost - 1, slot[lost - 1]]
            todo = lost, last


class TokenCounter:
    """Both transducers of a tokenizer file in the tokenizers library's JSON form."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError("only byte-level BPE without normalizer or prefix space can be compiled")
        # The file writes each byte as a printable character: printable Latin-1 as it is, the rest from 256 up.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        char = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(sorted({*range(256)} - {*shown}))}
        raw = lambda s: bytes(char[c] for c in s)
        vocab = {raw(s): i for s, i in spec["model"]["vocab"].items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        merges = {(vocab[raw(a)], vocab[raw(b)]): (rank, vocab[raw(a) + raw(b)]) for rank, (a, b) in enumerate(pairs)}
        self.added = sorted((t["content"].encode() for t in spec["added_tokens"]), key=len, reverse=True)
        self.classes, self.table, self.counter = class_table(), splitter_table(), Counter(vocab, merges)
        self.flags = boundary_table(self.table)

    def count(self, piece: Texts) -> np.ndarray:
        """Tokens of each text of a piece."""
        extra = np.zeros(len(piece), np.int64)
        data, offsets = piece.data, piece.offsets
        # Texts and the parts between added tokens are parted by a byte that UTF-8 never has.
        raw = data.tobytes()
        found = any(t in raw for t in self.added)
        if found:
            parts = []
            for k, text in enumerate(piece.strings()):
                for t in self.added:
                    extra[k] += text.count(t)
                    text = text.replace(t, b"\xff")
                parts.append(text)
            sizes = np.array([len(p) for p in parts], np.int64)
            data = np.frombuffer(b"\xff".join(parts) + b"\xff", np.uint8)
        else:
            sizes = np.diff(offsets)
            data = np.insert(data, offsets[1:], 0xFF)
        ends = np.cumsum(sizes + 1)
        at, cp = code_points(data)
        classes = self.classes[np.where(data[at] == 0xFF, 0, cp)]
        classes[data[at] == 0xFF] = RESET
        begins = at[boundaries(scan_edges(classes, self.table), self.flags)]
        stops = np.flatnonzero(data == 0xFF)
        limit = stops[np.searchsorted(stops, begins)]
        to = np.minimum(np.append(begins[1:], len(data)), limit)
        counts = self.counter.count(data, begins, to - begins)
        return per_row(counts, np.concatenate([[0], np.searchsorted(begins, ends)])) + extra


    def count_long(self, piece: Texts, limit: int) -> np.ndarray:
        """The same, a text of over ``limit`` bytes in slices of about that length.

        A slice ends before a space between two ASCII letters: the splitter always parts them there, so the slices' counts add. Without such a
        place the slice goes on.  Added tokens have no space, so none lies across.
        """
        if len(piece) > 1 or len(piece.data) <= limit or any(b" " in t for t in self.added):
            return self.count(piece)
        data, at, total = piece.data, 0, np.zeros(1, np.int64)
        while at < len(data):
            to = _safe_cut(data, at + limit)
            total += self.count(Texts(piece.rows, data[at:to], np.array([0, to - at])))
            at = to
        return total


def _safe_cut(data: np.ndarray, at: int, window: int = 1 << 16) -> int:
    """The first place from ``at`` on with a space there and ASCII letters on both sides, or the end."""
    letter = lambda x: ((x | 0x20) >= 97) & ((x | 0x20) <= 122)
    while at < len(data) - 1:
        part = data[at : at + window + 1]
        found = np.flatnonzero((part[:-1] == 0x20) & letter(data[at - 1 : at - 2 + len(part)]) & letter(part[1:]))
        if len(found):
            return at + int(found[0])
        at += len(part) - 1
    return len(data)


_COUNTERS: dict[str, TokenCounter] = {}


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every whole text; the file's path must be readable on executors."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _COUNTERS:
            _COUNTERS[tokenizer_path] = TokenCounter(tokenizer_path)
        for piece in pieces(batches, "text", 4 << 20):
            yield pa.RecordBatch.from_arrays([piece.rows.column("doc_id"), pa.array(np.diff(piece.offsets)), pa.array(_COUNTERS[tokenizer_path].count_long(piece, 4 << 20))], ["doc_id", "n_bytes", "n_tokens"])

    return map_texts(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, n_bytes long, n_tokens long")
