"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are joined on shared seeds, runs of ``least`` tokens.  For each pair that shares enough of them, tiles
are laid as running Karp-Rabin greedy string tiling does: the longest matches between unmarked tokens are
marked first, none overlaps another in the item or in the document, and the search length shrinks until ``least``.
The covered share of the item's tokens decides, so passages in another order are caught as well.

Tokens are runs of ASCII letters and digits or any non-ASCII characters, lower-cased.

Scale: documents are read once, whatever the benchmark's size.  A table of at most ``TABLE_BITS`` bits tells which seeds no item
has; only the others, with the few tokens that they hold, are stored and shuffled.  A seed that very many documents hold is one
key of a plain join, which Spark can split.  Of the pairs, only those go on whose shared seeds could cover the threshold.

Defined results: null or empty texts share nothing; items of fewer than ``least`` tokens can't be told from
chance and match nothing; items repeated under one id count as separate items of that id; repeated documents each give rows; of equally long
matches the first in the item, then in the document is marked first; an empty table on either side gives no pair; a null id stays null;
texts of any length are read whole; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.scratch import stored
from tallyspark.llm.text_arrays import RunHash, Texts, map_texts, pieces, row_of

LEAST = 5
THRESHOLD = 0.6
#: Bits of the table of seeds that goes to all tasks, at most: 16 MiB.
TABLE_BITS = 1 << 27

_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False


def _lowered(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[Texts]:
    """Pieces with texts lower-cased and cut in tokens; ``rows`` keeps the batch as it came."""
    for batch in batches:
        low = pc.utf8_lower(pc.fill_null(batch.column("text"), ""))
        at = 0
        for piece in pieces([pa.RecordBatch.from_arrays([low], ["text"])], "text", limit):
            n = len(piece)
            yield Texts(batch.slice(at, n), piece.data, piece.offsets, _BETWEEN)
            at += n


def tiles(item: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (item start, text start, length) between two token sequences given as hashes."""
    free_item, free_text = np.ones(len(item), bool), np.ones(len(text), bool)
    out: list[tuple[int, int, int]] = []
    item_runs, text_runs = RunHash(item, "word"), RunHash(text, "word")
    length = max(least, min(len(item), len(text)) // 2)
    while length >= least:
        matches, longest = _matches(item, text, free_item, free_text, item_runs, text_runs, length)
        if longest > 2 * length:
            length = longest
            continue
        queue = [(-size, i, j) for size, i, j in matches]
        heapq.heapify(queue)
        while queue:
            size, i, j = heapq.heappop(queue)
            free = free_item[i : i - size] & free_text[j : j - size]
            if free.all():
                free_item[i : i - size] = False
                free_text[j : j - size] = False
                out.append((i, j, -size))
            else:  # what is left of an overlapped match may still be long enough
                edge = np.concatenate([[False], free, [False]])
                for x, y in zip(np.flatnonzero(~edge[:-1] & edge[1:]).tolist(), np.flatnonzero(edge[:-1] & ~edge[1:]).tolist()):
                    if y - x >= length:
                        heapq.heappush(queue, (x - y, i + x, j + x))
        if length == least:
            break
        length = max(least, length // 2) if length > 2 * least else least
    return out


def _matches(item: np.ndarray, text: np.ndarray, free_item: np.ndarray, free_text: np.ndarray, item_runs: RunHash, text_runs: RunHash, length: int) -> tuple[list[tuple[int, int, int]], int]:
    """Maximal matches of at least ``length`` unmarked tokens, and the longest's length."""

    def windows(free: np.ndarray, runs: RunHash) -> tuple[np.ndarray, np.ndarray]:
        blocked = np.concatenate([[0], np.cumsum(~free)])
        at = np.flatnonzero(blocked[length:] == blocked[:-length]) if len(free) >= length else np.zeros(0, np.int64)
        return at, runs.of(at, at + length)

    (at_item, h_item), (at_text, h_text) = windows(free_item, item_runs), windows(free_text, text_runs)
    table: dict[int, list[int]] = {}
    for i, h in zip(at_item.tolist(), h_item.tolist()):
        table.setdefault(h, []).append(i)
    hit = np.flatnonzero(np.isin(h_text, h_item))
    found, longest, reached = [], 0, {}
    for j, h in zip(at_text[hit].tolist(), h_text[hit].tolist()):
        for i in table[h]:
            if reached.get(j - i, -1) > j:  # inside a match on the same diagonal
                continue
            n = min(len(item) - i, len(text) - j)
            stop = np.flatnonzero((item[i : i + n] != text[j : j + n]) | ~free_item[i : i + n] | ~free_text[j : j + n])
            size = int(stop[0]) if len(stop) else n
            if size < length:  # the hashes agreed by chance
                continue
            reached[j - i] = j + size
            found.append((size, i, j))
            longest = max(longest, size)
    return found, longest


def _grams(hashes: np.ndarray, n: int) -> np.ndarray:
    at = np.arange(max(0, len(hashes) - n + 1))
    return RunHash(hashes, "word").of(at, at + n)


def _tokens_of(items: DataFrame, least: int) -> DataFrame:
    """(item, item_id, tokens): token hashes of the items (item, item_id, text) that have ``least`` tokens or more."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _lowered(batches, 1 << 20):
            _, _, first = piece.words()
            hashes = piece.word_hashes().view(np.int64)
            long = np.flatnonzero(np.diff(first) >= least)
            rows = piece.rows.take(pa.array(long))
            yield pa.RecordBatch.from_arrays([rows.column("item"), rows.column("item_id"), pa.array([hashes[first[k] : first[k + 1]] for k in long], pa.list_(pa.int64()))], ["item", "item_id", "tokens"])

    return map_texts(items, run, "item long, item_id long, tokens array<long>")


def _seeds_of(items: DataFrame, least: int) -> DataFrame:
    """(seed, item, n, n_tokens): the seeds of each item, and how often each stands in it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, tokens in zip(batch.column("item").to_pylist(), batch.column("tokens")):
                tokens = tokens.values.to_numpy()
                seeds, n = np.unique(_grams(tokens.view(np.uint64), least).view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(seeds), pa.array(np.full(len(n), item)), pa.array(n.astype(np.int32)), pa.array(np.full(len(n), len(tokens), np.int32))], ["seed", "item", "n", "n_tokens"])

    return items.select("item", "tokens").mapInArrow(run, "seed long, item long, n int, n_tokens int")


def _seed_table(seeds: DataFrame) -> np.ndarray:
    """For each value of a seed's low bits whether some seed has them; at most TABLE_BITS, 16 for each seed if that is less."""
    bits, wanted = 1 << 16, 16 * seeds.count()
    while bits < min(TABLE_BITS, wanted):
        bits *= 2
    low = F.col("seed").bitwiseAND(F.lit(bits - 1)) + 1
    # A row for each 32,768 bits, 4 KiB each.
    parts = seeds.groupBy(F.bitmap_bucket_number(low).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(low)).alias("b")).collect()
    table = np.zeros((max(1, bits // 32768), 4096), np.uint8)
    for part in parts:
        table[part.k - 1] = np.frombuffer(part.b, np.uint8)
    return table.ravel()


def _met_seeds(base: DataFrame, table: np.ndarray, least: int) -> DataFrame:
    """(uid, doc_id, places, seeds, tokens) of documents with seeds of the table: places and values of these, and the tokens in them in order."""
    mask = np.uint64(8 * len(table) - 1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _lowered(batches, 1 << 20):
            _, _, first = piece.words()
            hashes, row = piece.word_hashes(), row_of(first)
            if len(hashes) < least:
                continue
            grams = _grams(hashes, least)
            low = (grams & mask).astype(np.int64)
            at = np.flatnonzero((table[low >> 3] >> (low & 7).astype(np.uint8) & 1).astype(bool) & (row[: len(grams)] == row[least - 1 :]))
            if not len(at):
                continue
            held = np.unique((at[:, None] + np.arange(least)).ravel())
            rows, begin = np.unique(row[at], return_index=True)
            ends, cut = np.append(begin[1:], len(at)), np.append(np.searchsorted(row[held], rows), len(held))
            grams, tokens = grams[at].view(np.int64), hashes[held].view(np.int64)
            lists = lambda values, of: pa.array([values[a:b] for a, b in of])
            spans = list(zip(begin, ends))
            kept = piece.rows.take(pa.array(rows))
            columns = [pa.array([at[a:b] - first[r] for (a, b), r in zip(spans, rows)]), lists(grams, spans), lists(tokens, zip(cut[:-1], cut[1:]))]
            yield pa.RecordBatch.from_arrays([kept.column("uid"), kept.column("doc_id"), *columns], ["uid", "doc_id", "places", "seeds", "tokens"])

    return map_texts(base, run, "uid long, doc_id long, places array<long>, seeds array<long>, tokens array<long>")


def _laid(pairs: DataFrame, least: int, threshold: float) -> DataFrame:
    """Tiles of pairs, each row with the document's met seeds and the item's tokens, that reach the threshold."""
    tile = pa.struct([("item_start", pa.int32()), ("doc_start", pa.int32()), ("length", pa.int32())])
    kinds = [("uid", pa.int64()), ("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_tokens", pa.int64()), ("n_covered", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.list_(tile))]
    schema = pa.schema(kinds)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                places, seeds, tokens, item = (batch.column(c)[k].values.to_numpy() for c in ("places", "seeds", "tokens", "item_tokens"))
                item = item.view(np.uint64)
                held = np.unique((places[:, None] + np.arange(least)).ravel())
                at = np.unique((places[np.isin(seeds, _grams(item, least).view(np.int64))][:, None] + np.arange(least)).ravel())
                # Only tokens of this item's seeds can lie in a tile; a value that no token has stands wherever some are left out.
                gaps = np.flatnonzero(np.diff(at) > 1) + 1
                text = np.insert(tokens[np.searchsorted(held, at)].view(np.uint64), gaps, np.arange(len(gaps), dtype=np.uint64) * 2 + 1)
                where = np.insert(at, gaps, -1)
                laid = tiles(item, text, least)
                covered = sum(t[2] for t in laid)
                if covered >= threshold * len(item):
                    named = [{"item_start": i, "doc_start": int(where[j]), "length": n} for i, j, n in laid]
                    out.append((*(batch.column(c)[k].as_py() for c in ("uid", "doc_id", "item_id")), len(item), covered, covered / len(item), named))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return map_texts(pairs, run, "uid long, doc_id long, item_id long, n_tokens long, n_covered long, coverage double, tiles array<struct<item_start:int,doc_start:int,length:int>>")


def _rare_seeds(seeds: DataFrame, documents: DataFrame, least: int, threshold: float) -> DataFrame:
    """(seed, item, n, wanted, spared): each item's seeds without its commonest ones.

    A shared seed covers ``least`` tokens of the item at most wherever it stands in it, so a pair that reaches the threshold shares ``wanted``
    places at least.  Seeds that stand in fewer places than that, together ``spared``, can't make a pair; these are the seeds that
    most documents have (``documents``: seed, often), so a common phrase joins no documents with items.
    """
    wanted = F.ceil(F.col("n_tokens") * threshold / least - 1e-9)
    by = Window.partitionBy("item").orderBy(F.desc("often"), "seed").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = seeds.join(documents, "seed").withColumns({"wanted": wanted, "upto": F.sum("n").over(by)})
    spare = F.col("upto") < F.col("wanted")
    ranked = ranked.withColumn("spared", F.coalesce(F.max(F.when(spare, F.col("upto"))).over(Window.partitionBy("item")), F.lit(0)))
    return ranked.filter(~spare).select("seed", "item", "n", "wanted", "spared")


def _pairs(base: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, least: int, threshold: float, once: bool = False) -> DataFrame:
    """Contaminated pairs of documents (uid, doc_id, text), which are read once; ``once`` where a uid may stand for several equal ones."""
    rows = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    items = stored(_tokens_of(rows, least), "decontamination-items")
    seeds = stored(_seeds_of(items, least), "decontamination-seeds")
    met = _met_seeds(base, _seed_table(seeds), least)
    met = stored(met.dropDuplicates(["uid", "doc_id"]) if once else met, "decontamination-met")
    held = met.select("uid", F.explode(F.array_distinct("seeds")).alias("seed"))
    rare = stored(_rare_seeds(seeds, held.groupBy("seed").agg(F.count("*").alias("often")), least, threshold), "decontamination-rare")
    shared = held.join(rare, "seed").groupBy("uid", "item").agg(F.sum("n").alias("n"), F.first("wanted").alias("wanted"), F.first("spared").alias("spared"))
    likely = stored(shared.filter(F.col("n") + F.col("spared") >= F.col("wanted")).select("uid", "item"), "decontamination-likely")
    sides = likely.join(met, "uid").join(items.select("item", "item_id", F.col("tokens").alias("item_tokens")), "item")
    return _laid(sides.select("uid", "doc_id", "item_id", "places", "seeds", "tokens", "item_tokens"), least, threshold)


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = LEAST, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_tokens, n_covered, coverage, tiles) of pairs whose coverage reaches the threshold.

    tiles: array of (item_start, doc_start, length) in tokens.
    """
    base = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return _pairs(base, benchmark, item_col, item_text_col, least, threshold).drop("uid")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = LEAST, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs``, unchanged, that cover no benchmark item to the threshold.

    A text decides for all its rows, so rows are told by a hash of the text; Spark broadcasts the hashes of contaminated texts while these are few.
    """
    text = F.col(text_col).cast("string")
    base = docs.select(F.xxhash64(text).alias("uid"), F.hash(text).cast("long").alias("doc_id"), text.alias("text"))
    bad = stored(_pairs(base, benchmark, item_col, item_text_col, least, threshold, once=True).select("uid", "doc_id").distinct(), "decontamination-bad")
    return docs.join(bad, (F.xxhash64(docs[text_col].cast("string")) == bad["uid"]) & (F.hash(docs[text_col].cast("string")).cast("long") == bad["doc_id"]), "left_anti")
