"""SimHash near-duplicates with pivot distance tables.

Fingerprints of 64 bits link at ``max_bits`` (1 or 2) or fewer differing bits;
a document's component is what links reach from it.  The work runs on distinct
fingerprints, so copies cost one aggregation, however many there are.

Links are found in two ways that together lose none:

* Bits are cut in ``max_bits + 2`` blocks; linked fingerprints agree in two blocks at
  least, so each fingerprint has a bucket for each pair of blocks (32 bits of key at two differing bits: an average
  bucket of random fingerprints passes 32 only beyond 10**11 of them).  In a bucket of at most ``bucket_rows`` fingerprints,
  pairs meet, each side with its precomputed distances to the pivots.  A pair whose distance to some
  pivot differs by more than ``max_bits`` is discarded (triangle inequality); survivors
  are verified on the fingerprints.
* A larger bucket is a dense family: many different fingerprints that differ in the other half of their bits alone.  It is
  not paired, as pairs would grow with its square.  Each of its
  fingerprints names itself and its 64 one-bit neighbours; two within two bits share one
  of these names, at most 65 fingerprints bear a name, and each is linked to the least of
  them.  With ``max_bits`` 1 the star's edges are verified before use.

Defined results: null or empty text (or no word) has fingerprint zero and links like any
other; fewer words than a shingle make one shingle; a repeated id yields one row for each
of its rows; a null id gets its group's component, or null where it is alone; an empty table gives no rows; other columns are not read;
a text of any length is hashed whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.components import connected_components
from tallyspark.llm.minwise import similar_documents
from tallyspark.llm.scratch import stored
from tallyspark.llm.text_arrays import Texts, map_texts, pieces

BITS = 64
#: Shingles whose bits are spread out at once.
BLOCK = 1 << 17


def text_fingerprints(piece: Texts, shingle: int) -> np.ndarray:
    """Fingerprints of a piece of texts: a bit is 1 if set in over half of the shingles' XXH64 values."""
    out = np.zeros(len(piece), np.uint64)
    starts, ends, first = piece.words()
    count = np.diff(first)
    raw, h = piece.data.tobytes().lower(), xxhash.xxh64_intdigest
    single = bool(np.all((starts[1:] - ends[:-1] == 1) & (piece.data[ends[:-1]] == 0x20))) if len(starts) > 1 else True
    hashes: list[int] = []
    sizes = np.zeros(len(piece), np.int64)
    s, e = starts.tolist(), ends.tolist()
    for row in np.flatnonzero(count):
        a, b = int(first[row]), int(first[row + 1])
        k = min(shingle, b - a)
        if single:
            hashes += [h(raw[x:y], 42) for x, y in zip(s[a : b - k + 1], e[a + k - 1 : b])]
        else:
            words = raw[s[a] : e[b - 1]].split()
            joined = b" ".join(words)
            to = np.cumsum([len(w) + 1 for w in words]).tolist()
            hashes += [h(joined[x : y - 1], 42) for x, y in zip([0, *to[: b - a - k]], to[k - 1 :])]
        sizes[row] = b - a - k + 1
    values, owner = np.array(hashes, dtype=">u8"), np.repeat(np.arange(len(piece)), sizes)
    votes = np.zeros((len(piece), BITS), np.int64)
    for at in range(0, len(values), BLOCK):
        rows, begin = np.unique(owner[at : at + BLOCK], return_index=True)
        bits = np.unpackbits(values[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1)
        votes[rows] += np.add.reduceat(bits, begin, axis=0, dtype=np.int32)
    out[:] = np.packbits(2 * votes > sizes[:, None], axis=1).view(">u8").ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint as a signed long) of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", 1 << 20):
            yield pa.RecordBatch.from_arrays([piece.rows.column("doc_id"), pa.array(text_fingerprints(piece, shingle).view(np.int64))], ["doc_id", "fp"])

    return map_texts(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, fp long")


def pivot_fingerprints(n: int, seed: int = 7) -> list[int]:
    """``n`` reference fingerprints, as signed longs."""
    return np.random.default_rng(seed).integers(-(1 << 63), (1 << 63) - 1, n, dtype=np.int64).tolist()


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(distinct: DataFrame, max_bits: int = 2, n_pivots: int = 12, bucket_rows: int = 32) -> DataFrame:
    """Edges (a, b), a > b, that connect exactly what fingerprints within ``max_bits`` bits connect."""
    if max_bits not in (1, 2):
        raise ValueError("max_bits is 1 or 2")
    blocks = max_bits + 2
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    block = lambda i: F.shiftrightunsigned("fp", cuts[i]).bitwiseAND(F.lit((1 << cuts[i + 1] - cuts[i]) - 1))
    both = F.array(*[F.struct(F.lit(i * blocks + j).alias("block"), F.shiftleft(block(i), cuts[j + 1] - cuts[j]).bitwiseOR(block(j)).alias("bits")) for i in range(blocks) for j in range(i)])
    keyed = distinct.select("fp", F.explode(both).alias("b")).select("fp", "b.block", "b.bits")
    sized = stored(keyed.groupBy("block", "bits").agg(F.count("*").alias("n")).filter("n > 1"), "simhash-sizes")
    met = stored(keyed.join(sized, ["block", "bits"]), "simhash-buckets")

    pivots = pivot_fingerprints(n_pivots)
    table = F.struct(*[_distance(F.col("fp"), F.lit(p)).cast("tinyint").alias(f"d{j}") for j, p in enumerate(pivots)])
    small = met.filter(F.col("n") <= bucket_rows).select("block", "bits", "fp", table.alias("t"))
    a, b = small.alias("a"), small.alias("b")
    near = reduce(lambda x, y: x & y, [F.abs(F.col(f"a.t.d{j}").cast("int") - F.col(f"b.t.d{j}").cast("int")) <= max_bits for j in range(n_pivots)])
    pairs = (
        a.join(b, (F.col("a.block") == F.col("b.block")) & (F.col("a.bits") == F.col("b.bits")) & (F.col("a.fp") > F.col("b.fp")) & near)
        .filter(_distance(F.col("a.fp"), F.col("b.fp")) <= max_bits)
        .select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    )

    large = met.filter(F.col("n") > bucket_rows).select("fp").distinct()
    around = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << i) - (1 << 64 if i == 63 else 0))) for i in range(BITS)])
    named = large.select("fp", F.explode(around).alias("name"))
    if max_bits == 1:
        star = named.join(large.select(F.col("fp").alias("name")), "name").select(F.greatest("fp", "name").alias("a"), F.least("fp", "name").alias("b")).filter("a > b")
    else:
        star = named.groupBy("name").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1).select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).filter("a > b")
    return pairs.unionByName(star).distinct()


def _prints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of all rows, and the different ones with their least id."""
    prints = stored(fingerprints(docs, id_col, text_col, shingle), "simhash-prints")
    return prints, stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2, n_pivots: int = 12, bucket_rows: int = 32) -> DataFrame:
    """(doc_id, fp, component_id): a row per document; component_id is the least doc_id that links reach."""
    prints, distinct = _prints(docs, id_col, text_col, shingle)
    roots = connected_components(links(distinct.select("fp"), max_bits, n_pivots, bucket_rows), "a", "b")
    rooted = distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = stored(rooted.join(least, "root").select("fp", "component_id"), "simhash-components")
    return prints.join(ids, "fp").select("doc_id", "fp", "component_id")


def document_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2, n_pivots: int = 12, bucket_rows: int = 32) -> DataFrame:
    """Edges (a, b) of document ids that connect what ``near_duplicates`` puts in one component; a null id has none."""
    prints, distinct = _prints(docs, id_col, text_col, shingle)
    least = distinct.filter("least is not null")
    equal = prints.join(least, "fp").filter("doc_id > least").select(F.col("doc_id").alias("a"), F.col("least").alias("b"))
    side = lambda c, to: least.select(F.col("fp").alias(c), F.col("least").alias(to))
    linked = links(least.select("fp"), max_bits, n_pivots, bucket_rows).join(side("a", "x"), "a").join(side("b", "y"), "b")
    return equal.unionByName(linked.select(F.col("x").alias("a"), F.col("y").alias("b")))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, words: int = 5, **options) -> DataFrame:
    """Rows of ``docs`` that stay when one document of each group does: that with the least id.

    A group is what links connect: fingerprints within ``max_bits`` bits, and sets of
    ``words``-word shingles with a Jaccard similarity of ``similarity`` or more, which
    fingerprints alone don't reach (see ``minwise``).  Rows repeated under the id that
    stays all stay, and so do rows without id.
    """
    edges = document_links(docs, id_col, text_col, **options).unionByName(similar_documents(docs, id_col, text_col, words, similarity))
    gone = connected_components(edges, "a", "b").filter("node <> root").select(F.col("node").alias(id_col))
    return docs.join(gone, docs[id_col] == gone[id_col], "left_anti")
