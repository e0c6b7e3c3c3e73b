"""Merkle manifest of a dataset as a persistent path-copying tree.

A row's leaf is the SHA-256 of its fields; the leaves of a source make a tree of fan-out 16 with a subroot, and the
subroots, in order of their source, make the tree of the whole with its root.  A change of one leaf is a version of
the tree: it copies the leaf's ancestors, one node a level, and shares every other node with the tree that it comes from.

The work goes by aligned blocks of 16**3 nodes (``depth`` levels).  A block is made from its nodes in one task; blocks' roots are the nodes of the
next levels, until each tree has one node.  From the top down, each block then gets the siblings on its root's way up.  So a
version's ancestors inside its block and, through the siblings handed down, those above it are made where its leaf is, and nothing
larger than a block and its way up meets in one task.

Leaves are numbered by a range sort on (source, id) and counts by part, so a source of any share of the rows is no single task.

Defined results: null fields count as ``-`` and null sources are the first tree; null ids come first in it; rows of one id go by
their leaf, and equal rows change places freely; a text of any length is one field; a lone leaf is its own subroot, and a lone subroot the root;
an empty table gives no rows; columns that aren't named fields are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.scratch import stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Children of a node, and levels of a block.
FAN, DEPTH = 16, 3
WIDTH = 64


def digest_of(values: Sequence[Column]) -> Column:
    """SHA-256 in hex over fields, each ``-`` if null, else its UTF-8 length, a colon and its text."""
    parts = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in (v.cast("string") for v in values)]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaves(docs: DataFrame, fields: Sequence[str] = FIELDS, tree_col: str = "source", id_col: str = "doc_id", changes: Mapping[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """(tree, id, leaf, changed): each row's leaf and, for rows that fulfil ``where``, the leaf with ``changes`` put in place of fields."""
    own = {f: F.col(f"`{f}`") for f in fields}
    changed = F.when(where, digest_of(list((own | dict(changes or {})).values()))) if where is not None else F.lit(None).cast("string")
    tree, name = F.col(f"`{tree_col}`"), F.col(f"`{id_col}`")
    return docs.select(F.when(tree.isNull(), "").otherwise(F.concat(F.lit("="), tree.cast("string"))).alias("tree"), name.cast("long").alias("id"), digest_of(list(own.values())).alias("leaf"), changed.alias("changed"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``pos``, the place 0.. within the tree, and ``n``, the tree's size.

    A sort by range, then counts by part and tree: one row for each of both, never a tree in one task.
    """
    keyed = stored(rows, "merkle-rows").withColumn("_r", F.monotonically_increasing_id())
    dealt = keyed.repartitionByRange("tree", *order, "_r").sortWithinPartitions("tree", *order, "_r").drop("_r")
    dealt = stored(dealt.withColumn("_m", F.monotonically_increasing_id()), "merkle-sorted").withColumn("_p", F.shiftright("_m", 33))
    runs = dealt.groupBy("_p", "tree").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    of_tree = Window.partitionBy("tree")
    runs = runs.select("_p", "tree", "_first", (F.sum("_n").over(of_tree.orderBy("_p")) - F.col("_n")).alias("_before"), F.sum("_n").over(of_tree).alias("n"))
    return dealt.join(runs, ["_p", "tree"]).withColumn("pos", F.col("_before") + F.col("_m") - F.col("_first")).drop("_p", "_m", "_first", "_before")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _runs(nodes: list[str], n: int, depth: int) -> list[list[str]]:
    """Joined runs of a block by level, and last its root alone: to a single node where the tree's ``n`` nodes are one block, else ``depth`` levels."""
    out: list[list[str]] = []
    whole = n <= FAN**depth
    while len(nodes) > 1 if whole else len(out) < depth:
        out.append(["".join(nodes[i : i + FAN]) for i in range(0, len(nodes), FAN)])
        nodes = [_sha(run) for run in out[-1]]
    return [*out, nodes]


def _with_block(nodes: DataFrame, depth: int) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("pos", 4 * depth))


def _block_roots(nodes: DataFrame, depth: int) -> DataFrame:
    """(tree, pos, n, digest) of the blocks of nodes."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        tree, block, n = rows["tree"].iloc[0], rows["block"].iloc[0], int(rows["n"].iloc[0])
        top = _runs(rows.sort_values("pos")["digest"].tolist(), n, depth)[-1][0]
        return pd.DataFrame({"tree": [tree], "pos": [block], "n": [-(-n // FAN**depth)], "digest": [top]})

    return _with_block(nodes.select("tree", "pos", "n", "digest"), depth).groupBy("tree", "block").applyInPandas(run, "tree string, pos long, n long, digest string")


def _climb(nodes: DataFrame, depth: int) -> list[DataFrame]:
    """Tables of nodes from the given ones up, a row a block each, until every tree has ended in a row with ``n`` of 1."""
    tables = [nodes]
    while True:
        tables.append(stored(_block_roots(tables[-1].filter("n > 1") if len(tables) > 1 else nodes, depth), "merkle-nodes"))
        if tables[-1].filter("n > 1").isEmpty():
            return tables


_WAY = "siblings array<string>, places array<int>"


def _ways_in_block(digests: list[str], n: int, depth: int, up_siblings: list[str], up_places: list[int]) -> tuple[list[list[str]], list[list[int]]]:
    """For each node of a block the others of its run at each level, and its place among them, followed by the block's own way up."""
    levels = _runs(digests, n, depth)[:-1]
    siblings, places = [], []
    for i in range(len(digests)):
        s, p, at = [], [], i
        for runs in levels:
            at, k = divmod(at, FAN)
            run = runs[at]
            s.append(run[: WIDTH * k] + run[WIDTH * (k + 1) :])
            p.append(k)
        siblings.append(s + up_siblings)
        places.append(p + up_places)
    return siblings, places


def _copies(leaf: str, siblings: list[str], places: list[int]) -> list[str]:
    """Ancestors of a leaf from its parent to the root, each made from the node below and that one's siblings."""
    out = []
    for others, k in zip(siblings, places):
        leaf = _sha(others[: WIDTH * k] + leaf + others[WIDTH * k :])
        out.append(leaf)
    return out


def _ways(nodes: DataFrame, above: DataFrame, depth: int, carry: str = "", versions: bool = False) -> DataFrame:
    """Way up of each node; ``above`` has that of its block by (tree, pos), with the subroot and root it ends in.

    ``carry`` names further columns of nodes, as a schema; ``versions`` adds ``copied``, made from ``changed`` or else the node.
    """
    extra = [c.split()[0] for c in carry.split(",")] if carry else []

    def run(rows: pd.DataFrame, up: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos", ignore_index=True)
        if not len(rows) or not len(up):
            return pd.DataFrame({c: [] for c in ["tree", "pos", "n", "digest", "siblings", "places", "subroot", "root", *extra, *["copied"] * versions]}, dtype=object)
        one = up.iloc[0]
        siblings, places = _ways_in_block(rows["digest"].tolist(), int(rows["n"].iloc[0]), depth, list(one["siblings"]), [int(x) for x in one["places"]])
        out = rows[["tree", "pos", "n", "digest", *extra]].assign(siblings=siblings, places=places, subroot=one["subroot"], root=one["root"])
        if versions:
            starts = rows["changed"].where(rows["changed"].notna(), rows["digest"])
            out["copied"] = [_copies(*x) for x in zip(starts, siblings, places)]
        return out

    blocks = above.select("tree", F.col("pos").alias("block"), "siblings", "places", "subroot", "root")
    schema = f"tree string, pos long, n long, digest string, {_WAY}, subroot string, root string" + (f", {carry}" if carry else "") + (", copied array<string>" if versions else "")
    return _with_block(nodes.select("tree", "pos", "n", "digest", *extra), depth).groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInPandas(run, schema)


def _descend(tables: list[DataFrame], tops: DataFrame, depth: int, carry: str = "", versions: bool = False) -> DataFrame:
    """Ways up of all nodes of ``tables[0]``; ``tops`` has the way that each tree's last node goes on with."""
    above = None
    for k in range(len(tables) - 1, 0, -1):
        ended = tables[k].filter("n = 1").join(tops, "tree").select("tree", "pos", "siblings", "places", "subroot", "root")
        above = ended if above is None else ended.unionByName(_ways(tables[k].filter("n > 1"), above, depth).select(*ended.columns))
        above = stored(above, "merkle-ways")
    return _ways(tables[0], above, depth, carry, versions)


def _ended(tables: list[DataFrame]) -> DataFrame:
    """(tree, digest) of each tree's last node."""
    out = tables[1].filter("n = 1")
    for t in tables[2:]:
        out = out.unionByName(t.filter("n = 1"))
    return out.select("tree", "digest")


def proofs(rows: DataFrame, depth: int = DEPTH) -> DataFrame:
    """A row a leaf of ``leaves``: its place, subroot, root, way up and ancestors.

    Columns: id, tree, pos, n, leaf, changed, subroot, root, ``siblings`` (others of the run, level by level), ``places`` (own place in the
    run), ``copied`` (the nodes of the version that the changed leaf makes, parent to root; for an unchanged leaf the shared nodes made anew from the way up).
    """
    placed = stored(numbered(rows, "id", "leaf"), "merkle-leaves").withColumnRenamed("leaf", "digest")
    trees = _climb(placed, depth)
    sources = stored(numbered(_ended(trees).withColumnsRenamed({"tree": "name", "digest": "leaf"}).withColumn("tree", F.lit("")), "name"), "merkle-sources").withColumnRenamed("leaf", "digest")
    whole = _climb(sources, depth)
    none = {"siblings": F.array().cast("array<string>"), "places": F.array().cast("array<int>")}
    tops = _ended(whole).select("tree", F.col("digest").alias("root"), F.lit("").alias("subroot")).withColumns(none)
    ways = stored(_descend(whole, tops, depth, "name string"), "merkle-tops")
    tops = ways.select(F.col("name").alias("tree"), "siblings", "places", F.col("digest").alias("subroot"), "root")
    return _descend(trees, tops, depth, "id long, changed string", versions=True).withColumnRenamed("digest", "leaf")


def verified(found: DataFrame) -> DataFrame:
    """``proofs`` with ``proof_sha256`` over the siblings, ``folded_root`` of the leaf's version, and whether that is still the root."""
    top = F.coalesce(F.try_element_at("copied", F.lit(-1)), "changed", "leaf")
    out = found.withColumns({"proof_sha256": F.sha2(F.array_join("siblings", "").cast("binary"), 256), "folded_root": top})
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def version_nodes(found: DataFrame) -> DataFrame:
    """(version, tree, level, pos, digest): the nodes that each changed leaf's version has of its own; all others are those of the tree before.

    Levels count from the leaf's parent, 1, through the subroot up to the root; ``pos`` is the place within a source's tree, null above the subroot.
    """
    depth = F.when(F.col("n") > 1, F.ceil(F.log2("n") / 4 - 1e-12)).otherwise(0)
    rows = found.filter("changed is not null").select(F.col("id").alias("version"), "tree", F.col("pos").alias("_leaf"), depth.alias("_depth"), F.posexplode("copied").alias("_k", "digest"))
    level = F.col("_k") + 1
    return rows.select("version", "tree", level.alias("level"), F.when(level <= F.col("_depth"), F.expr("shiftright(_leaf, 4 * (_k + 1))")).alias("pos"), "digest")


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
