"""Links between texts whose word-shingle sets are similar: min-wise bands give candidates, whole sets decide.

This is operator 10's route to wide radii.  Texts at a similarity of 0.8 differ in about
ten of 64 fingerprint bits; pivot distances of random texts rarely differ by more than
that, so pivot tables discard nothing there, and bit blocks short enough to be shared
would hold a large part of a corpus each.

A text's words are lower-cased (A-Z); its set holds its distinct shingles (fewer words than
a shingle: the whole sequence; no word: the empty set).  Equal sets count as one text.
Two sets share one of 25 bands of 6 min-wise hashes with probability 1 - (1 - s**6)**25,
0.9995 at similarity s = 0.8; only pairs that share none are never compared.  Bands are worked in two steps:

* Star: each text meets the leaders of its bucket, at most 8 of them, so a group of copies of any size costs
  its own length.  Candidates are verified on the whole sets.
* Texts of buckets that still hold several components go through one join on early
  shingles (prefix, position and length filters), which meets every similar pair across components.

Every document's bands are kept, but whole sets only of texts that share a bucket.

Defined results: null and empty texts have the empty set and are equal to each other; rows repeated under one id are one
document; a null id gives no edge; an empty table gives none; other columns are not read; a set holds all shingles of a
text, however long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.components import connected_components
from tallyspark.llm.scratch import stored
from tallyspark.llm.text_arrays import RunHash, Texts, map_texts, mix, pieces

BANDS, ROWS = 25, 6
#: Texts of a bucket that all others of it meet.
LEADERS = 8


def _lists(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))


def text_sets(piece: Texts, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, one text after the other, and how many each has."""
    capital = (piece.data >= 0x41) & (piece.data <= 0x5A)
    lowered = Texts(piece.rows, np.where(capital, piece.data | 0x20, piece.data).astype(np.uint8), piece.offsets)
    words, first = RunHash(lowered.word_hashes(), "word"), lowered.words()[2]
    sets = []
    for a, b in zip(first[:-1], first[1:]):
        starts = np.arange(a, max(b - shingle + 1, min(a + 1, b)))
        sets.append(np.unique(words.of(starts, np.minimum(starts + shingle, b))))
    return np.concatenate([np.zeros(0, np.uint64), *sets]), np.array([len(s) for s in sets], np.int64)


def band_keys(flat: np.ndarray, sizes: np.ndarray, seed: int = 11) -> np.ndarray:
    """(texts with a shingle, BANDS) keys that name a band and its min-wise hashes."""
    begin = (np.cumsum(sizes) - sizes)[sizes > 0]
    random = np.random.default_rng(seed).integers(0, 1 << 64, (BANDS, ROWS, 2), dtype=np.uint64)
    keys = np.zeros((len(begin), BANDS), np.uint64)
    for band in range(BANDS):
        for flip, factor in random[band]:
            least = np.minimum.reduceat((flat ^ flip) * (factor | np.uint64(1)), begin)
            keys[:, band] = mix(keys[:, band] * np.uint64(0xD1342543DE82EF95) + least + np.uint64(band))
    return keys


def _named(piece: Texts, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes and sizes of a piece's sets, and a name of each set."""
    flat, sizes = text_sets(piece, shingle)
    some, name = sizes > 0, np.zeros(len(piece), np.uint64)
    if some.any():
        name[some] = mix(np.add.reduceat(mix(flat), (np.cumsum(sizes) - sizes)[some]) + sizes[some].astype(np.uint64))
    return flat, sizes, name.view(np.int64)


def signatures(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """(doc_id, s, n, bands) of each row of (doc_id, text): the set's name, its size and band keys, none for an empty set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", 1 << 20):
            flat, sizes, name = _named(piece, shingle)
            keys = band_keys(flat, sizes) if len(flat) else np.zeros((0, BANDS), np.uint64)
            columns = [piece.rows.column("doc_id"), pa.array(name), pa.array(sizes.astype(np.int32)), _lists(keys.view(np.int64).ravel(), np.where(sizes > 0, BANDS, 0))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "s", "n", "bands"])

    return map_texts(docs, run, "doc_id long, s long, n int, bands array<long>")


def whole_sets(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """(s, shingles), once for each set of (doc_id, text) rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", 1 << 20):
            flat, sizes, name = _named(piece, shingle)
            yield pa.RecordBatch.from_arrays([pa.array(name), _lists(flat.view(np.int64), sizes)], ["s", "shingles"])

    return map_texts(docs, run, "s long, shingles array<long>").groupBy("s").agg(F.first("shingles").alias("shingles"))


def _verified(pairs: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of ``pairs`` whose whole sets reach the similarity."""
    pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    pairs = stored(pairs, "minwise-pairs")
    left, right = held.select(F.col("s").alias("a"), F.col("shingles").alias("x")), held.select(F.col("s").alias("b"), F.col("shingles").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    both = pairs.join(left, "a").join(right, "b")
    return stored(both.filter(shared >= similarity * (F.size("x") + F.size("y") - shared)).select("a", "b"), "minwise-links")


def _long_enough(similarity: float) -> Column:
    return F.least("n", "other_n") >= similarity * F.greatest("n", "other_n")


def _prefix_pairs(texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of texts (s, root, shingles) of different roots that hold every pair of that similarity.

    All sets are put in one order, shingles of fewest roots first.  Of two similar sets the first
    common shingle stands so early that enough of each is left from there on: ``rest`` shingles,
    itself included, at least s of the longer set, 2s / (1 + s) of the shorter, s / (1 + s) of both sizes.
    """
    texts = texts.select("s", "root", F.array_distinct("shingles").alias("shingles")).withColumn("n", F.size("shingles"))
    each = stored(texts.select("s", "root", "n", F.explode("shingles").alias("t")), "minwise-shingles")
    # Shingles of a single root come first and meet nothing, so their number is enough.
    roots = stored(each.select("t", "root").distinct().groupBy("t").agg(F.count("*").alias("roots")).filter("roots > 1"), "minwise-shared")
    listed = each.join(roots, "t").groupBy("s", "root", "n").agg(F.sort_array(F.collect_list(F.struct("roots", "t"))).alias("l"))
    rest = F.size("l") - F.col("at")
    early = listed.select("s", "root", "n", F.posexplode("l").alias("at", "e"), "l").select("s", "root", "n", F.col("e.t").alias("t"), rest.alias("rest"))
    early = stored(early.filter(F.col("rest") + 1e-6 >= similarity * F.col("n")), "minwise-early")
    short = early.filter(F.col("rest") + 1e-6 >= 2 * similarity / (1 + similarity) * F.col("n"))
    short = short.select("t", F.col("s").alias("b"), F.col("root").alias("b_root"), F.col("n").alias("b_n"), F.col("rest").alias("b_rest"))
    # Roots meet before texts do, so that texts of one root never meet each other.
    met = early.join(short.select("t", "b_root").distinct(), "t").filter("root <> b_root").join(short, ["t", "b_root"])
    longer = (F.col("n") > F.col("b_n")) | ((F.col("n") == F.col("b_n")) & (F.col("s") > F.col("b")))
    enough = F.least("rest", "b_rest") + 1e-6 >= similarity / (1 + similarity) * (F.col("n") + F.col("b_n"))
    return met.filter(longer & enough).select(F.col("s").alias("a"), "b")


def similar_links(named: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float = 0.8) -> DataFrame:
    """Edges (a, b) between names of (s, n, bands); ``sets_of`` gives (s, shingles) of a frame of names."""
    keyed = named.select("s", "n", F.explode("bands").alias("key"))
    # The least text of each share of a bucket leads it; shares are by name, so copies in several buckets have leaders in common.
    least = [F.min(F.when(F.pmod("s", F.lit(LEADERS)) == k, F.struct("s", "n"))) for k in range(LEADERS)]
    met = keyed.groupBy("key").agg(F.count("*").alias("size"), F.array_compact(F.array(*least)).alias("leaders")).filter("size > 1")
    rows = stored(keyed.join(stored(met.select("key", "leaders"), "minwise-buckets"), "key"), "minwise-rows")
    held = stored(sets_of(stored(rows.select("s").distinct(), "minwise-names")), "minwise-sets")
    star = rows.select("s", "n", F.explode("leaders").alias("l")).select("s", "n", F.col("l.s").alias("other"), F.col("l.n").alias("other_n"))
    found = _verified(star.filter(_long_enough(similarity)).select(F.col("s").alias("a"), F.col("other").alias("b")), held, similarity)

    roots = connected_components(found, "a", "b").select(F.col("node").alias("s"), "root")
    rooted = stored(rows.select("s", "key").join(roots, "s", "left").withColumn("root", F.coalesce("root", "s")), "minwise-rooted")
    mixed = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key")
    across = rooted.join(stored(mixed, "minwise-mixed"), "key").select("s", "root").distinct().join(held, "s")
    return found.unionByName(_verified(_prefix_pairs(across, similarity), held, similarity))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """Edges (a, b) of document ids, a > b, that connect documents whose sets are equal or similar."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id is not null")
    each = stored(signatures(base, shingle), "minwise-texts")
    named = stored(each.groupBy("s").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("bands").alias("bands")), "minwise-named")

    def sets_of(names: DataFrame) -> DataFrame:
        ids = named.join(names, "s", "left_semi").select(F.col("least").alias("doc_id"))
        return whole_sets(base.join(ids, "doc_id", "left_semi"), shingle).join(names, "s", "left_semi")

    least = named.select("s", "least")
    equal = each.join(least, "s").filter("doc_id > least").select(F.col("doc_id").alias("a"), F.col("least").alias("b"))
    links = similar_links(named.select("s", "n", "bands"), sets_of, similarity)
    ids = links.join(least.select(F.col("s").alias("a"), F.col("least").alias("x")), "a").join(least.select(F.col("s").alias("b"), F.col("least").alias("y")), "b")
    return equal.unionByName(ids.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))).filter("a > b").distinct()
