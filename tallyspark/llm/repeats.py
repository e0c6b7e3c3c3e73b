"""Exact repeated passages between and within documents, by seeds that are extended both ways.

A window is ``length`` consecutive words.  Each window picks an anchor: the least of the
hashes of its ``gram``-word runs (winnowing), so equal windows pick equal anchors.  A document's
anchors come with the longest extension both ways whose windows all picked them.
Documents are joined on anchors that stand in two places or more; of an anchor's places those of one
extension are one side of the comparison, however many they are, so no pairs are made:

1. Places are counted by (anchor, hash of the extended text).  An extension that stands
   in two places is repeated as a whole.
2. Where an anchor has several different extensions, one place of each is read again and the extensions are
   compared on both sides of the anchor, as far as windows around it reach: a window that two of them share is repeated.
3. Repeated windows of a document merge to its maximal repeats, see ``repeated_spans``.

A passage in a third of all documents costs a row for each anchor and batch of texts: places are combined within
a batch and stay there, and only what tells batches and extensions apart is shuffled.  Both sides of each join on anchors or windows are
shuffled for the join alone, so that Spark can split a common key.

Defined results: null or empty text has no words; a text shorter than the window has no window;
rows repeated under one id each count as a place; equal documents all lose what they share; an empty table gives no rows; a null id
stays null; a text of any length is read whole, in memory of about 100 times its bytes; other columns pass unread, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.scratch import stored
from tallyspark.llm.text_arrays import RunHash, Texts, map_texts, mix, per_row, pieces, quoted, row_of, spread

#: A packed run is first window << SHIFT | number of windows.
SHIFT = 12


def _sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive keys, by doubling."""
    out, have = keys, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def anchored_runs(piece: Texts, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, anchor hash, hash of the extended text, first window within the row, windows) of a piece's anchors."""
    _, _, first = piece.words()
    hashes = piece.word_hashes()
    n, width = len(hashes), length - gram + 1
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    place = np.arange(n) - np.repeat(first[:-1], np.diff(first))
    runs = RunHash(hashes, "word")
    at = np.arange(n - gram + 1)
    grams = runs.of(at, at + gram)
    # Order by the hash's high bits; of equal ones the last in the window wins. Positions need 28 bits.
    keys = ((grams >> np.uint64(28)) << np.uint64(28)) | (np.uint64((1 << 28) - 1) - (place[: len(grams)].astype(np.uint64) & np.uint64((1 << 28) - 1)))
    least = _sliding_least(keys, width)
    row = row_of(first)
    starts = np.flatnonzero(row[: n - length + 1] == row[length - 1 :])
    if not len(starts):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    picked = least[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (picked[1:] != picked[:-1]) | (starts[1:] != starts[:-1] + 1) | (row[starts[1:]] != row[starts[:-1]])
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(starts)))
    begin = starts[head]
    owner = row[begin]
    anchor = first[owner] + ((np.uint64((1 << 28) - 1) - (picked[head] & np.uint64((1 << 28) - 1))).astype(np.int64))
    text = mix(runs.of(begin, begin + size + length - 1) ^ (anchor - begin).astype(np.uint64))
    return owner, grams[anchor].view(np.int64), text.view(np.int64), place[begin], size


#: What a batch of texts gives: a row for each different (anchor, ext) in it, n of whose places lie in the batch. The
#: places themselves stand in the batch's first row: documents by row, and each place's row, run and number of (anchor, ext).
BATCHES = "anchor long, ext long, batch long, at int, n int, docs array<long>, tkeys array<int>, rows array<int>, runs array<long>, ats array<int>"


def _batches(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Anchors of (doc_id, tkey, text), combined within each batch."""
    kinds = [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for piece in pieces(batches, "text"):
            owner, anchor, text, begin, size = anchored_runs(piece, length, gram)
            if not len(owner):
                continue
            order = np.lexsort((text, anchor))
            a, t = anchor[order], text[order]
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (t[1:] != t[:-1])])
            head = np.flatnonzero(new)
            at = np.empty(len(order), np.int32)
            at[order] = np.cumsum(new) - 1
            held = (piece.rows.column("doc_id").to_pylist(), piece.rows.column("tkey").to_numpy(), owner.astype(np.int32), begin << SHIFT | size, at)
            rest = [pa.array([x] + [None] * (len(head) - 1), kind) for x, kind in zip(held, kinds)]
            keys = [pa.array(a[head]), pa.array(t[head]), pa.array(np.full(len(head), number)), pa.array(np.arange(len(head), dtype=np.int32)), pa.array(np.diff(np.append(head, len(order))).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*keys, *rest], ["anchor", "ext", "batch", "at", "n", "docs", "tkeys", "rows", "runs", "ats"])
            number += 1

    return map_texts(docs, run, BATCHES)


def _runs_of(batches: DataFrame, chosen: DataFrame, once: bool) -> DataFrame:
    """(doc_id, tkey, runs, singles) of the places of chosen (batch, at, alone), or of the first place of each with ``once``."""
    by_batch = chosen.groupBy("batch").agg(F.collect_list(F.struct("at", "alone")).alias("c")).select("batch", F.col("c.at").alias("chosen"), F.col("c.alone").alias("alone"))
    places = batches.filter("at = 0").select("batch", "docs", "tkeys", "rows", "runs", "ats").join(by_batch, "batch").drop("batch")

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k in range(part.num_rows):
                of = lambda c: part.column(c)[k].values.to_numpy(zero_copy_only=False)  # noqa: E731,B023
                ats, rows, alone = of("ats"), of("rows"), np.zeros(int(of("ats").max()) + 1, np.int8)
                alone[of("chosen")] = 1 + of("alone").astype(np.int8)
                keep = np.zeros(len(ats), bool)
                keep[np.unique(ats, return_index=True)[1] if once else slice(None)] = True
                keep &= alone[ats] > 0
                place = np.flatnonzero(keep)
                row, first = np.unique(rows[place], return_index=True)
                ends = np.append(first, len(place)).astype(np.int32)
                lists = lambda x: pa.ListArray.from_arrays(pa.array(ends), pa.array(x))  # noqa: E731,B023
                ids, keys = (part.column(c)[k].values.take(pa.array(row)) for c in ("docs", "tkeys"))
                yield pa.RecordBatch.from_arrays([ids, keys, lists(of("runs")[place]), lists(alone[ats[place]] == 2)], ["doc_id", "tkey", "runs", "singles"])

    return map_texts(places, run, "doc_id long, tkey int, runs array<long>, singles array<boolean>")


def _unpacked(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column."""
    lists = lists.cast(pa.large_list(lists.type.value_type))
    values = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = np.array([0 if x is None else x for x in lists.value_lengths().to_pylist()], np.int64)
    return values, np.concatenate([[0], np.cumsum(sizes)])


def _windows(joined: DataFrame, length: int) -> DataFrame:
    """Rows (w1, w2, places, doc_id, tkey, start) for each window of the runs in column ``runs`` (run, places)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            _, _, first = piece.words()
            hashes = piece.word_hashes()
            packed, offsets = _unpacked(piece.rows.column("runs"))
            single, _ = _unpacked(piece.rows.column("singles"))
            owner = row_of(offsets)
            begin, size = packed >> SHIFT, packed & ((1 << SHIFT) - 1)
            starts = spread(first[owner] + begin, size)
            which = np.repeat(owner, size)
            w1 = RunHash(hashes, "word").of(starts, starts + length)
            w2 = RunHash(mix(hashes), "other").of(starts, starts + length)
            take = pa.array(which)
            alone = np.repeat(single, size).astype(bool)
            for at in range(0, max(1, len(starts)), 1 << 17):
                cut = slice(at, at + (1 << 17))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w1.view(np.int64)[cut]), pa.array(w2.view(np.int64)[cut]), pa.array(alone[cut]), piece.rows.column("doc_id").take(take[cut]), piece.rows.column("tkey").take(take[cut]), pa.array((starts - first[which])[cut])],
                    ["w1", "w2", "alone", "doc_id", "tkey", "start"],
                )

    return map_texts(joined, run, "w1 long, w2 long, alone boolean, doc_id long, tkey int, start long")


def repeated_runs(docs: DataFrame, length: int = 35, gram: int = 8) -> DataFrame:
    """(doc_id, tkey, runs): packed runs of repeated windows by document; ``docs`` has doc_id, text and tkey."""
    if not 0 < gram <= length or length - gram + 1 >= 1 << SHIFT:
        raise ValueError(f"gram is from 1 to length, and a window has fewer than {1 << SHIFT} grams")
    key = ["anchor", "ext"]
    batches = stored(_batches(docs, length, gram), "repeats-batches")
    anchors = batches.select("anchor", "ext", "batch", "at", "n")
    # Most anchors stand in one place only; they go before anything else is shuffled with them.
    met = anchors.groupBy("anchor").agg(F.sum("n").alias("n"), F.min("ext").alias("lo"), F.max("ext").alias("hi")).filter("n > 1")
    met = stored(met.select("anchor", (F.col("lo") != F.col("hi")).alias("several")), "repeats-met")
    shared = stored(anchors.join(met, "anchor"), "repeats-shared")
    # Of an anchor with one extension all places are repeated; else it takes two places of the same extension.
    several = shared.filter("several")
    texts = stored(several.groupBy(*key).agg(F.sum("n").alias("places"), F.min(F.struct("batch", "at")).alias("first")), "repeats-texts")
    again = several.join(texts.filter("places > 1").select(*key), key).select("batch", "at")
    whole = _runs_of(batches, shared.filter("not several").select("batch", "at").unionByName(again).withColumn("alone", F.lit(False)), once=False)

    by_doc = _runs_of(batches, texts.select("first.batch", "first.at", (F.col("places") == 1).alias("alone")), once=True)
    by_doc = by_doc.groupBy("doc_id", "tkey").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.flatten(F.collect_list("singles")).alias("singles"))
    # A row repeated under one id and text has its twin as another place, so one of them is enough here.
    once = docs.join(by_doc, docs.doc_id.eqNullSafe(by_doc.doc_id) & (docs.tkey == by_doc.tkey)).select(docs.doc_id, docs.tkey, "text", "runs", "singles")
    windows = stored(_windows(once, length), "repeats-windows")
    twice = windows.groupBy("w1", "w2").agg((F.max(F.when(~F.col("alone"), 1).otherwise(0)) * 2 + F.count_if("alone")).alias("places")).filter("places > 1")
    parts = windows.filter("alone").join(stored(twice.select("w1", "w2"), "repeats-twice"), ["w1", "w2"])
    parts = parts.groupBy("doc_id", "tkey").agg(F.collect_list(F.shiftleft("start", SHIFT) + 1).alias("runs"))
    return whole.select("doc_id", "tkey", "runs").unionByName(parts).groupBy("doc_id", "tkey").agg(F.flatten(F.collect_set("runs")).alias("runs"))  # equal rows give equal lists


def _joined(docs: DataFrame, id_col: str, text_col: str, length: int, gram: int, rest: tuple[str, ...] = ()) -> DataFrame:
    """Documents (doc_id, text, and the columns in ``rest`` as rest_0, rest_1, ...) with the packed runs of their repeated windows."""
    base = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text"), *[F.col(quoted(c)).alias(f"rest_{i}") for i, c in enumerate(rest)])
    base = base.withColumn("tkey", F.hash("text"))
    found = repeated_runs(base.select("doc_id", "tkey", "text"), length, gram)
    return base.join(found, base.doc_id.eqNullSafe(found.doc_id) & (base.tkey == found.tkey), "left").select(base.doc_id, "text", "runs", *[f"rest_{i}" for i in range(len(rest))])


def _gone(piece: Texts, length: int) -> np.ndarray:
    """Whether a repeated window covers each word of a piece with ``runs``."""
    starts, _, first = piece.words()
    packed, offsets = _unpacked(piece.rows.column("runs"))
    begin = first[row_of(offsets)] + (packed >> SHIFT)
    edge = np.zeros(len(starts) + 1, np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + (packed & ((1 << SHIFT) - 1)) + length - 1, -1)
    return np.cumsum(edge)[:-1] > 0


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 35, gram: int = 8) -> DataFrame:
    """(doc_id, first_word, n_words): a row for each maximal run of words that repeated windows cover."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            _, _, first = piece.words()
            gone = np.concatenate([[False], _gone(piece, length), [False]])
            heads = np.zeros(len(gone), bool)
            heads[first] = True  # a span ends with its text
            begin = np.flatnonzero(gone[1:-1] & (~gone[:-2] | heads[:-2]))
            stop = np.flatnonzero(gone[1:-1] & (~gone[2:] | heads[1:-1])) + 1
            owner = np.searchsorted(first, begin, "right") - 1
            yield pa.RecordBatch.from_arrays([piece.rows.column("doc_id").take(pa.array(owner)), pa.array(begin - first[owner]), pa.array(stop - begin)], ["doc_id", "first_word", "n_words"])

    return map_texts(_joined(docs, id_col, text_col, length, gram), run, "doc_id long, first_word long, n_words long")


def _cut(docs: DataFrame, id_col: str, text_col: str, length: int, gram: int, rest: tuple[str, ...] = (), layout: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept and rest_0, rest_1, ...; with ``layout`` a text that loses nothing stays as it is."""
    names = [f"rest_{i}" for i in range(len(rest))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            starts, ends, first = piece.words()
            gone = _gone(piece, length)
            removed = per_row(gone, first)
            raw, keep, whole = piece.data.tobytes(), ~gone, piece.rows.column("text")
            kept = []
            for k in range(len(piece)):
                a, b = int(first[k]), int(first[k + 1])
                if layout and not removed[k]:
                    kept.append(raw[piece.offsets[k] : piece.offsets[k + 1]] if whole[k].is_valid else None)
                elif a == b:
                    kept.append(b"")
                elif not removed[k]:
                    kept.append(b" ".join(raw[starts[a] : ends[b - 1]].split()))
                else:
                    words = raw[starts[a] : ends[b - 1]].split()
                    kept.append(b" ".join([words[i] for i in np.flatnonzero(keep[a:b]).tolist()]))
            arrays = [piece.rows.column("doc_id"), pa.array(np.diff(first)), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*arrays, *[piece.rows.column(c) for c in names]], ["doc_id", "n_words", "n_removed", "kept", *names])

    return map_texts(_joined(docs, id_col, text_col, length, gram, rest), run, "doc_id long, n_words long, n_removed long, kept string" + "".join(f", {n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, rest)))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 35, gram: int = 8) -> DataFrame:
    """A row for each document: doc_id, n_words, n_removed, kept (the words left, joined by one space).

    Each word that a repeated window covers is removed; what is repeated is judged on the input.
    """
    return _cut(docs, id_col, text_col, length, gram)


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 35, gram: int = 8, chars_col: str = "n_chars") -> DataFrame:
    """Rows of ``docs`` under its columns, whose texts lack what is repeated; ``chars_col``, if there is one, follows.

    A text that loses nothing stays as it is, white space and null included.
    """
    rest = tuple(c for c in docs.columns if c != text_col)
    cut = _cut(docs, id_col, text_col, length, gram, rest, layout=True)
    place = {c: F.col(f"rest_{i}") for i, c in enumerate(rest)}
    column = lambda c: F.col("kept") if c == text_col else F.when(F.col("n_removed") > 0, F.char_length("kept")).otherwise(place[c]) if c == chars_col else place[c]
    return cut.select(*[column(c).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
