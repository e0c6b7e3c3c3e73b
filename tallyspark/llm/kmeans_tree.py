"""Approximate nearest neighbours by cosine over a hierarchical k-means tree, searched best bin first.

* **Items** are the different vectors, each with its ``k + 1`` least ids, so that any number of copies is one item; no more than ``k`` others
  of equal score can be among a query's ``k`` nearest.
* **The tree** is fitted on a sample: the root's branches on the driver, on at most about ROOT_SAMPLE vectors; each branch's subtree in a task of its own, on
  FIT_ROWS vectors a leaf.  Leaves grow with the items, one to LEAF_ROWS, up to MAX_LEAVES: that bounds the sample and the tree, which is all that is
  broadcast.  Every item is then taken down the tree to its leaf.
* **Search**: a query puts the root's branches in a priority queue, takes the nearest node, and puts that one's branches in, until it has visited enough leaves.
  Queries and items meet by leaf; leaves beyond PIECE_ROWS items, or visits, are cut in pieces, and each piece of the one meets each of the other.
* **Calibration**: SAMPLE_QUERIES items are compared with all items exactly; the number of leaves to visit is widened by a quarter until
  the leaves visited hold the wanted share of their true neighbours.

Scores are worked out in double precision on the vectors themselves.

Defined results: null vectors, zero vectors and those with null or non-finite entries take no part, nor do those of another length than most have (ties: the greater length),
nor rows without id; repeated rows count once; an id with several vectors is near where any of them is; ties go to the smaller id; fewer candidates than ``k`` are all
returned; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.scratch import stored
from tallyspark.llm.vectors import commonest_length, finite, matrix

BRANCHES, LEAF_ROWS, MAX_LEAVES = 16, 256, 16_384
ROOT_SAMPLE, FIT_ROWS = 16_384, 32
SAMPLE_QUERIES = 160
PIECE_ROWS = 8192
#: Candidates by matrix product whose scores are worked out again, one like the other, beyond those returned.
SPARE = 8


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _clusters(units: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(centres, cluster by row) of spherical k-means; clusters without rows are dropped."""
    centres = units[rng.choice(len(units), min(k, len(units)), replace=False)]
    for step in range(rounds + 1):
        own = np.argmax(units @ centres.T, axis=1)
        used, own = np.unique(own, return_inverse=True)
        if step == rounds:
            return centres[used], own
        sums = np.zeros((len(used), units.shape[1]))
        np.add.at(sums, own, units)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centres[used])
    raise AssertionError


def _subtree(units: np.ndarray, leaves: int, rng: np.random.Generator, path: tuple[int, ...]) -> list[tuple[tuple[int, ...], np.ndarray]]:
    """(path, centre) of the nodes below ``path``; a node without any is a leaf."""
    if leaves <= 1 or len(units) < 2:
        return []
    centres, own = _clusters(units, min(BRANCHES, leaves), rng)
    if len(centres) < 2:
        return []
    out = []
    for c, centre in enumerate(centres):
        rows = units[own == c]
        out.append(((*path, c), centre))
        out += _subtree(rows, round(leaves * len(rows) / len(units)), rng, (*path, c))
    return out


class Tree:
    """Nodes by path; ``children[i]`` and ``centres[i]`` of inner node i, ``leaf[i]`` the number of a leaf or -1."""

    def __init__(self, nodes: list[tuple[tuple[int, ...], np.ndarray]]):
        nodes = sorted([((), None), *nodes], key=lambda x: (len(x[0]), x[0]))
        place = {path: i for i, (path, _) in enumerate(nodes)}
        self.children: list[list[int]] = [[] for _ in nodes]
        for path, _ in nodes[1:]:
            self.children[place[path[:-1]]].append(place[path])
        self.centres = [np.array([nodes[c][1] for c in kids]) for kids in self.children]
        ends = [i for i, kids in enumerate(self.children) if not kids]
        self.leaf = np.full(len(nodes), -1)
        self.leaf[ends] = np.arange(len(ends))
        self.n_leaves = len(ends)

    def assign(self, units: np.ndarray) -> np.ndarray:
        """Leaf of each row: at every node the nearest branch."""
        out, todo = np.zeros(len(units), np.int64), [(0, np.arange(len(units)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            best = np.argmax(units[rows] @ self.centres[node].T, axis=1)
            todo += [(self.children[node][c], rows[best == c]) for c in np.unique(best)]
        return out

    def visit(self, unit: np.ndarray) -> Iterator[int]:
        """Leaves in best-bin-first order."""
        queue = [(-2.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                yield int(self.leaf[node])
                continue
            for near, child in zip((self.centres[node] @ unit).tolist(), self.children[node]):
                heapq.heappush(queue, (-near, child))


def _share(name: str, part: float) -> Column:
    """Whether a hash of the vector lies in the given share of all hashes."""
    return F.pmod(F.xxhash64(name), F.lit(1 << 30)) < int(min(1.0, part) * (1 << 30))


def _items(rows: DataFrame, k: int) -> DataFrame:
    """(v, ids): different vectors with their ``k + 1`` least ids."""
    each = Window.partitionBy("v").orderBy("id")
    return rows.withColumn("_r", F.row_number().over(each)).filter(F.col("_r") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def fit_tree(items: DataFrame, n: int, seed: int = 11) -> Tree:
    """A tree over a sample of ``items`` (column v), as the module tells."""
    leaves = max(1, min(MAX_LEAVES, n // LEAF_ROWS))
    if leaves == 1:
        return Tree([])
    sample = items.filter(_share("v", ROOT_SAMPLE / n)).select("v").toPandas()  # about ROOT_SAMPLE vectors
    root = _units(np.array(sample["v"].tolist(), float))
    centres, _ = _clusters(root, min(BRANCHES, leaves), np.random.default_rng(seed))
    top = Tree([((c,), centre) for c, centre in enumerate(centres)])
    wanted = min(n, FIT_ROWS * leaves)
    per_row = leaves / wanted

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([pa.array(top.assign(_units(matrix(batch.column("v"), float)))), batch.column("v")], ["branch", "v"])

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        branch, units = int(rows["branch"].iloc[0]), _units(np.array(rows["v"].tolist(), float))
        units = units[np.lexsort(units.T[:4])]
        nodes = _subtree(units, round(len(units) * per_row), np.random.default_rng(seed + branch), (branch,))
        return pd.DataFrame({"path": [list(p) for p, _ in nodes], "centre": [list(c) for _, c in nodes]}, dtype=object)

    dealt = items.filter(_share("v", wanted / n)).select("v").mapInArrow(deal, "branch long, v array<double>")
    below = dealt.groupBy("branch").applyInPandas(fit, "path array<int>, centre array<double>").collect()  # at most about MAX_LEAVES nodes and those above
    return Tree([((c,), centre) for c, centre in enumerate(centres)] + [(tuple(r["path"]), np.array(r["centre"])) for r in below])


def _with_leaf(items: DataFrame, tree) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([pa.array(tree.value.assign(_units(matrix(batch.column("v"), float)))), batch.column("v"), batch.column("ids")], ["leaf", "v", "ids"])

    return items.mapInArrow(run, "leaf long, v array<double>, ids array<long>")


def _true_leaves(indexed: DataFrame, asked: list[tuple[list[float], list[int]]], k: int) -> list[tuple[int, int]]:
    """(query, leaf) of each of the ``k`` nearest items to each asked item, from all items, block by block."""
    asks, own = _units(np.array([v for v, _ in asked], float)), np.array([ids[0] for _, ids in asked])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(asks), k), -3.0)
        leaf = np.full((len(asks), k), -1)
        for batch in batches:
            if not len(batch):
                continue
            first = np.array([x[0] for x in batch.column("ids").to_pylist()])
            near = asks @ _units(matrix(batch.column("v"), float)).T
            near[(own[:, None] == first[None, :]) & (near > 1 - 1e-12)] = -3.0
            both = np.hstack([best, near])
            where = np.hstack([leaf, np.broadcast_to(batch.column("leaf").to_numpy(), near.shape)])
            at = np.argpartition(-both, k - 1, axis=1)[:, :k]
            best, leaf = np.take_along_axis(both, at, 1), np.take_along_axis(where, at, 1)
        q, j = np.nonzero(leaf >= 0)
        yield pa.RecordBatch.from_pydict({"q": q, "near": best[q, j], "leaf": leaf[q, j]})

    ranked = indexed.mapInArrow(run, "q long, near double, leaf long").withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("near"), "leaf")))
    return [(r["q"], r["leaf"]) for r in ranked.filter(F.col("_r") <= k).select("q", "leaf").collect()]  # k * SAMPLE_QUERIES rows


def calibrated_visits(indexed: DataFrame, tree: Tree, k: int, recall: float) -> int:
    """How many leaves to visit, so that they hold ``recall`` of the sample queries' true neighbours."""
    if tree.n_leaves == 1:
        return 1
    asked = [(r["v"], r["ids"]) for r in indexed.orderBy(F.xxhash64("v"), "v").limit(SAMPLE_QUERIES).select("v", "ids").collect()]
    places = [{leaf: i for i, leaf in enumerate(tree.visit(u))} for u in _units(np.array([v for v, _ in asked], float))]
    ranks = np.array([places[q][leaf] for q, leaf in _true_leaves(indexed, asked, k)])
    visits = 1
    while visits < tree.n_leaves and len(ranks) and np.mean(ranks < visits) < recall:
        visits = min(tree.n_leaves, visits + max(1, visits // 4))
    return visits


def _routed(asked: DataFrame, tree, sizes: np.ndarray, visits: int, k: int) -> DataFrame:
    """(leaf, q, v): each query with the leaves that it visits: ``visits``, and more while they hold no ``k + 1`` items."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, row = [], []
            for i, unit in enumerate(_units(matrix(batch.column("v"), float)) if len(batch) else ()):
                seen = 0
                for count, x in enumerate(tree.value.visit(unit)):
                    if count >= visits and seen > k:
                        break
                    seen += int(sizes[x])
                    leaf.append(x)
                    row.append(i)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), batch.column("q").take(at), batch.column("v").take(at)], ["leaf", "q", "v"])

    return asked.select("q", "v").mapInArrow(run, "leaf long, q long, v array<double>")


def _pieces(spark, counts: DataFrame, name: str) -> DataFrame:
    return counts.select("leaf", F.greatest(F.lit(1), F.ceil(F.col("n") / PIECE_ROWS)).cast("int").alias(name))


def _search(visits: DataFrame, indexed: DataFrame, k: int) -> DataFrame:
    """(q, found): the ``k + 1`` nearest (score, id) of each query in the leaves that it visits, best first."""
    spark = visits.sparkSession
    per_leaf = lambda df: df.groupBy("leaf").agg(F.count("*").alias("n"))
    cuts = stored(_pieces(spark, per_leaf(indexed), "cut").join(_pieces(spark, per_leaf(visits), "times"), "leaf"), "tree-pieces")
    every = lambda count, name: F.explode(F.sequence(F.lit(0), F.col(count) - 1)).alias(name)
    of = lambda key, count: F.pmod(F.xxhash64(key), F.col(count)).cast("int")
    have = indexed.join(cuts, "leaf").select("leaf", of("v", "cut").alias("a"), every("times", "b"), "v", "ids")
    want = visits.join(cuts, "leaf").select("leaf", every("cut", "a"), of("q", "times").alias("b"), "q", "v")

    def meet(asks: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(asks) or not len(rows):
            return pd.DataFrame({"q": [], "found": []}, dtype=object)
        x, ids = np.array(rows["v"].tolist(), float), rows["ids"].tolist()
        x /= np.abs(x).max(1, keepdims=True)
        sizes, out = np.linalg.norm(x, axis=1), []
        for at in range(0, len(asks), 512):
            y = np.array(asks["v"].iloc[at : at + 512].tolist(), float)
            y /= np.abs(y).max(1, keepdims=True)
            own = np.linalg.norm(y, axis=1)
            near = (y @ x.T) / (own[:, None] * sizes)
            few = min(len(x), k + 1 + SPARE)
            best = np.argpartition(-near, few - 1, axis=1)[:, :few]
            score = np.clip((y[:, None, :] * x[best]).sum(2) / (own[:, None] * sizes[best]), -1.0, 1.0)
            for places, scores in zip(best.tolist(), score.tolist()):
                pairs = sorted((-s, int(i)) for p, s in zip(places, scores) for i in ids[p])[: k + 1]
                out.append([{"score": -s, "id": i} for s, i in pairs])
        return pd.DataFrame({"q": asks["q"], "found": out})

    part = want.groupBy("leaf", "a", "b").cogroup(have.groupBy("leaf", "a", "b")).applyInPandas(meet, "q long, found array<struct<score:double,id:long>>")
    order = lambda x: F.struct((-x.score).alias("s"), x.id.alias("id"))
    best = F.slice(F.array_sort(F.transform(F.flatten(F.collect_list("found")), order)), 1, k + 1)
    return part.groupBy("q").agg(F.transform(best, lambda x: F.struct((-x.s).alias("score"), x.id.alias("id"))).alias("found"))


def nearest(rows: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = 0.96) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found to each row that fulfils ``queries``, itself left out."""
    spark, schema = rows.sparkSession, "query_id long, rank int, vec_id long, score double"
    good = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    good = good.filter(F.col("id").isNotNull() & finite(F.col("v")) & F.exists("v", lambda c: c != 0))
    good = stored(good.filter(F.size("v") == commonest_length(good, "v")).groupBy("id", "v").agg(F.max("asks").alias("asks")), "tree-rows")
    items = stored(_items(good, k), "tree-items")
    n = items.count()
    if not n:
        return spark.createDataFrame([], schema)
    tree = fit_tree(items, n)
    shared = spark.sparkContext.broadcast(tree)  # at most MAX_LEAVES leaves and the nodes above
    indexed = stored(_with_leaf(items, shared), "tree-leaves")
    sizes = np.zeros(tree.n_leaves, np.int64)
    for r in indexed.groupBy("leaf").agg(F.count("*").alias("n")).collect():  # at most MAX_LEAVES rows
        sizes[r["leaf"]] = r["n"]
    visits = calibrated_visits(indexed, tree, k, recall)
    asking = good.filter("asks")
    asked = stored(asking.select("v").distinct().withColumn("q", F.monotonically_increasing_id()), "tree-queries")
    found = _search(stored(_routed(asked, shared, sizes, visits, k), "tree-visits"), indexed, k)
    of_ids = asking.select(F.col("id").alias("query_id"), "v").join(asked, "v").select("query_id", "q").join(found, "q")
    pairs = of_ids.select("query_id", F.explode("found").alias("f")).filter("f.id <> query_id").groupBy("query_id", F.col("f.id").alias("vec_id")).agg(F.max("f.score").alias("score"))
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int"))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
