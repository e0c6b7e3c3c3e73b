"""Merkle manifest, whitening and nearest neighbours against brute force."""

import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import kmeans_tree, merkle, queries, whitening

SF = "/root/testdata/sf0.001"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(nodes, fan=16):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + fan])) for i in range(0, len(levels[-1]), fan)])
    return levels


def siblings_of(levels, i):
    out = []
    for nodes in levels[:-1]:
        first = i // 16 * 16
        out.append((nodes[first:i], nodes[i + 1 : first + 16]))
        i //= 16
    return out


def plain_manifest(rows):
    """Sorted (doc_id, leaf, subroot, root, proof, folded root, verified) of rows of FIELDS."""
    trees = {}
    for row in rows:
        tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
        changed = (*row[:4], row[4].translate(LOWER)) if tampered and row[4] is not None else row
        trees.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, plain_leaf(row), plain_leaf(changed), row[0]))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in names:
        trees[s].sort(key=lambda x: x[:3])
        built[s] = plain_tree([x[2] for x in trees[s]])
    top = plain_tree([built[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (_, _, leaf, node, doc_id) in enumerate(trees[s]):
            way = siblings_of(built[s], i) + siblings_of(top, k)
            for left, right in way:
                node = sha("".join([*left, node, *right]))
            proof = sha("".join("".join(left + right) for left, right in way))
            out.append((doc_id, leaf, built[s][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=repr)


def spark_manifest(docs, **options):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    found = merkle.proofs(merkle.leaves(docs, changes={"text": merkle.ascii_lower(F.col("text"))}, where=tampered), **options)
    rows = merkle.verified(found).select(F.col("id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    return sorted((tuple(r) for r in rows), key=repr)


def test_manifest_query_matches_plain_trees(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(*FIELDS).collect()]
    got = sorted((tuple(r) for r in queries.op13_merkle_manifest(spark, SF).collect()), key=repr)
    assert got == plain_manifest(rows) and {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("depth", [1, 2])
def test_manifest_of_many_blocks_and_sources(spark, depth):
    # Blocks of 16 and 256 nodes, so that trees of a few hundred leaves have upper versions; 40 sources, so that their tree has two levels.
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 40}", "en", i, f"Text {i} ABC" * (i % 7)) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(7)
    assert spark_manifest(docs, depth=depth) == plain_manifest(rows)


def test_manifest_edges(spark):
    rows = [
        (None, None, None, None, None), (1, None, "en", 1, ""), (2, "a", None, 3, "B" * 300_000), (3, "a", "en", None, "Ünïcode ▁ 漢字 🎉"), (3, "a", "en", None, "Ünïcode ▁ 漢字 🎉"),
        (3, "a", "fr", 2, "same id"), (4, "", "en", 2, "blank source"), (5, "é", "en", 2, "X"), (6, "z", "en", 2, "lone"),
    ]
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, pos int, tree string, `a.b` string")
    assert spark_manifest(docs) == plain_manifest(rows)
    assert spark_manifest(docs.limit(0)) == []
    lone = docs.filter("doc_id = 6")
    assert spark_manifest(lone) == plain_manifest([rows[-1]]) and spark_manifest(lone)[0][1] == spark_manifest(lone)[0][3]


def test_versions_share_all_other_nodes(spark):
    rows = [(i, "s", "en", i, f"Text {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    found = merkle.proofs(merkle.leaves(docs, changes={"text": F.lower("text")}, where=F.col("doc_id").isin(7, 250)))
    copies = {(r.version, r.level, r.pos): r.digest for r in merkle.version_nodes(found).collect()}
    base = plain_tree([plain_leaf(r) for r in rows])
    for version in (7, 250):
        changed = plain_tree([plain_leaf((*r[:4], r[4].lower()) if r[0] == version else r) for r in rows])
        own = {(version, level, pos): x for level, nodes in enumerate(changed) if level for pos, x in enumerate(nodes) if x != base[level][pos]}
        assert own == {k: v for k, v in copies.items() if k[0] == version} and len(own) == 3


def plain_whitening(x, most=16):
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    v = centred.T @ centred / n
    e, vectors = np.linalg.eigh(v)
    e, vectors = e[::-1][:most], vectors[:, ::-1][:, :most]
    return n, sums, (x - sums / n) @ vectors / np.sqrt(e), e / np.trace(v)


def test_whitening_query_matches_plain(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.floor(64 * np.array([r.embedding for r in rows], float)).astype(np.int64) + 1_000_000
    n, sums, want, explained = plain_whitening(x)
    out = queries.op12_whitening(spark, SF).toPandas()
    assert len(out) == 16 * len(x) and set(out.n) == {n} and out.identity_error.nunique() == 1 and out.identity_error.max() < 1e-9
    got = out.pivot(index="vec_id", columns="component", values="whitened").sort_index().to_numpy()
    assert np.abs(got * np.sign((got * want).sum(0)) - want).max() < 1e-8
    first = out[out.component == 1].sort_values("vec_id")
    assert first.deviation.tolist() == ((n * x - sums) ** 2).sum(1).tolist()
    assert np.abs(out[out.vec_id == 0].sort_values("component").explained - explained).max() < 1e-10


def test_whitening_edges(spark):
    nan, inf = math.nan, math.inf
    rows = [(1, [1.0, 2.0, 0.0]), (1, [1.0, 2.0, 0.0]), (2, [3.0, 2.5, 0.0]), (None, [0.0, -1.0, 0.0]), (3, None), (4, []), (5, [1.0, None, 2.0]), (6, [nan, 1.0, 2.0]), (7, [1.0, -inf, 2.0]), (8, [1.0])]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, x int, `a.b` int")
    out = whitening.whiten(table).toPandas()
    # Three different vectors in a plane: two components for each of four rows; the third has no spread.
    assert sorted(out.component.value_counts().items()) == [(1, 4), (2, 4)] and set(out.n) == {3} and out.identity_error.max() < 1e-12
    assert whitening.whiten(table.limit(0)).count() == 0 and whitening.whiten(table.filter("vec_id = 1")).count() == 0


@pytest.mark.parametrize("kind", ["plain", "graded", "reverse", "clusters", "low rank", "repeated", "identity", "close pairs"])
def test_qd_solver_matches_dense_eigenvalues(kind):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 48))
    turned = lambda s: np.linalg.qr(x)[0] @ np.diag(s) @ np.linalg.qr(rng.normal(size=(48, 48)))[0]
    wilkinson = np.diag(np.abs(np.arange(-10, 11)) + 12.0) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)
    data = {
        "plain": x, "graded": x * np.logspace(0, -5, 48), "reverse": x * np.logspace(-5, 0, 48), "clusters": turned([5.0] * 10 + [1.0] * 38), "low rank": x[:10],
        "repeated": np.hstack([x[:, :40], x[:, :8]]), "identity": np.eye(12), "close pairs": np.linalg.cholesky(wilkinson).T,
    }[kind]
    r = np.linalg.qr(data, mode="r")
    r = np.vstack([r, np.zeros((r.shape[1] - len(r), r.shape[1]))])
    e, v, trace = whitening.components(r, 10, r.shape[1])
    scatter = r.T @ r / 10
    assert np.abs(e - np.linalg.eigvalsh(scatter)[::-1][: len(e)]).max() < 1e-12 * e[0] and len(e) == np.linalg.matrix_rank(r, tol=np.sqrt(1e-13 * 10 * e[0]))
    assert np.abs(scatter @ v - v * e).max() < 1e-11 * e[0] and np.abs(v.T @ v - np.eye(len(e))).max() < 1e-10 and abs(trace - np.trace(scatter)) < 1e-12 * trace


def test_small_singular_values_keep_their_digits():
    # The Kahan matrix's least singular value is far below the rounding of its products; a bidiagonal one of powers of two is known by hand.
    a, b = 2.0 ** -np.arange(0, 40, 2), np.zeros(19)
    assert np.abs(whitening.dqds(a, b) / a**2 - 1).max() < 1e-14
    b = a[:-1] / 4
    dense = np.diag(a) + np.diag(b, 1)
    exact = np.linalg.svd(dense, compute_uv=False) ** 2
    assert np.abs(whitening.dqds(a, b) / exact - 1)[:8].max() < 1e-12
    assert abs(np.prod(whitening.dqds(a, b)) / np.prod(a**2) - 1) < 1e-12


def plain_nearest(rows, k=5):
    """(query, rank) -> (id, score) for rows of different ids."""
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    out = {}
    for i in np.flatnonzero(ids % 50 == 0):
        near = unit @ unit[i]
        order = [j for j in np.lexsort((ids, -near.round(12))) if j != i][:k]
        out |= {(int(ids[i]), r): (int(ids[j]), near[j]) for r, j in enumerate(order, 1)}
    return out


def recall(got, want):
    hits = [{v[0] for key, v in want.items() if key[0] == q} & {v[0] for key, v in got.items() if key[0] == q} for q in {key[0] for key in want}]
    return sum(map(len, hits)) / len(want)


def test_nearest_query_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in queries.op11_nearest_neighbours(spark, "/root/testdata/sf0.1").collect()}
    want = plain_nearest(rows)
    assert set(got) == set(want) and recall(got, want) >= 0.9
    x = dict(rows)
    for (q, _), (i, score) in got.items():
        a, b = np.array(x[q], float), np.array(x[i], float)
        assert i != q and abs(score - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12


def test_nearest_with_many_leaves_pieces_and_copies(spark, monkeypatch):
    for name, value in (("LEAF_ROWS", 16), ("PIECE_ROWS", 10), ("ROOT_SAMPLE", 300)):
        monkeypatch.setattr(kmeans_tree, name, value)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    x = np.vstack([centres[i % 12] + 0.2 * rng.normal(size=8) for i in range(800)] + [np.ones(8)] * 400)
    rows = [(i, v.tolist()) for i, v in zip(rng.permutation(1200).tolist(), x)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in kmeans_tree.nearest(table, F.col("vec_id") % 50 == 0).collect()}
    want = plain_nearest(rows)
    copies = {i for i, v in rows if v == [1.0] * 8}
    assert set(got) == set(want) and recall(got, want) >= 0.9
    assert all(got[key] == (pytest.approx(v[0]), pytest.approx(v[1])) for key, v in want.items() if key[0] in copies)


def test_nearest_edges(spark):
    nan = math.nan
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (100, None), (6, [nan, 1.0]), (None, [1.0, 1.0]), (7, [1.0]), (150, []), (8, [1.0, None])]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, leaf int, `a.b` int")
    got = [tuple(r) for r in kmeans_tree.nearest(table, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 50, 1.0), (0, 4, 3, 0.0), (50, 1, 0, 1.0), (50, 2, 1, 1.0), (50, 3, 2, 1.0), (50, 4, 3, 0.0)]
    assert kmeans_tree.nearest(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert kmeans_tree.nearest(table.filter("vec_id = 50"), F.col("vec_id") % 50 == 0).count() == 0


def test_common_phrases_make_no_pairs(spark):
    """A phrase of most documents and of every item is no seed to join on; contaminated pairs are found as before."""
    from tallyspark.llm import decontamination

    phrase = "as everybody knows by now"
    item = lambda i: f"{phrase} " + " ".join(f"q{i}w{k}" for k in range(20))
    rows = [(i, f"start{i} {phrase} end{i}") for i in range(300)] + [(1000 + i, f"x{i} {item(i)} y{i}") for i in range(5)] + [(2000, " ".join(f"q7w{k}" for k in range(16)))]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, item(i)) for i in range(40)], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.n_covered) for r in decontamination.contaminated_pairs(docs, bench).collect())
    assert got == [(1000 + i, i, 25) for i in range(5)] + [(2000, 7, 16)]
    items = decontamination._tokens_of(bench.select(F.col("item_id").alias("item"), "item_id", "text"), 5)
    seeds = decontamination._seeds_of(items, 5)
    often = seeds.groupBy("seed").agg(F.count("*").alias("often"))
    rare = decontamination._rare_seeds(seeds, often, 5, 0.6)
    assert rare.groupBy("seed").count().agg(F.max("count")).first()[0] == 1 and {(r.wanted, r.spared) for r in rare.collect()} == {(3, 2)}
