"""Training-data operators against brute force, round trips, the tokenizers' libraries and held-out labels."""

import collections
import hashlib
import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
import zstandard

from tallyspark.llm import boosted_rules, components, decontamination, factorisation, host_reputation, language, merge_dropout, minwise, queries, repeats, simhash, statistics, token_counts, warc
from tallyspark.llm.scratch import scratch_path, stored

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls, empty texts, a long text, ties, repeated rows.
EDGES = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", "s", 4), (4, "one", "en", "s", 3), (4, "one", "en", "s", 3), (5, "One", "en", "s", 3),
    (6, "a b c d e f g h " * 6000, "en", "s", 96000), (7, "x " * 60 + "tail", "en", "s", 124), (8, "x " * 60 + "other", "en", "s", 125), (None, "no id here", "en", "s", 10), (9, "Ünïcode ▁ 漢字 🎉\r\n" * 3, "fr", "s", 60),
]


@pytest.fixture(scope="module")
def edges(spark):
    # Extra columns whose names operators use inside.
    rows = [(*r, "fp", 1, "runs", "dot") for r in EDGES]
    return spark.createDataFrame(rows, DOCS + ", label string, tkey int, runs string, `a.b` string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def words_of(text):
    return (text or "").encode().split()


def brute_fingerprint(text, k=3):
    w = words_of((text or "").encode().lower().decode())
    shingles = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, bits=2):
    parent = {f: f for f in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    each = list(parent)
    for i, a in enumerate(each):
        for b in each[:i]:
            if (a ^ b).bit_count() <= bits:
                parent[find(a)] = find(b)
    return {f: find(f) for f in each}


def test_simhash_edges_and_empty(edges, empty):
    rows = simhash.near_duplicates(edges).collect()
    assert len(rows) == len(EDGES)
    by_id = {r.doc_id: r for r in rows}
    for doc_id, text, *_ in EDGES:
        assert by_id[doc_id].fp & (2**64 - 1) == brute_fingerprint(text)
    assert by_id[1].component_id == by_id[2].component_id == by_id[3].component_id == 1
    assert by_id[5].component_id == 4
    assert simhash.near_duplicates(empty).count() == 0
    clash = edges.selectExpr("*", "1 AS node", "2 AS a", "3 AS root")
    assert simhash.keep_one_of_each(clash).columns == clash.columns
    assert sorted((r.doc_id for r in simhash.keep_one_of_each(clash).collect()), key=str) == sorted([1, 4, 4, 6, 7, 9, None], key=str)  # 8 has the fingerprint of 7


@pytest.mark.parametrize("bucket_rows", [0, 3, 1000])
@pytest.mark.parametrize("bits", [1, 2])
def test_simhash_links_lose_nothing(spark, bucket_rows, bits):
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    prints = set(seeds)
    for s in seeds[:6]:  # dense balls and chains
        x = s
        for _ in range(40):
            x ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64) if rng.random() < 0.5 else 0)
            prints.add(x)
            if rng.random() < 0.5:
                x = s
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    got = components.connected_components(simhash.links(df, bits, bucket_rows=bucket_rows), "a", "b").collect()
    root = {r.node: r.root for r in got}
    want = brute_components(prints, bits)
    groups = lambda f: sorted(sorted(v) for v in _invert(f).values() if len(v) > 1)
    assert groups({signed(k): v for k, v in want.items()}) == groups(root)


def brute_similar(texts, k=5, similarity=0.8):
    """Pairs of ids whose sets of k-word shingles reach the similarity."""
    sets = []
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets.append((i, {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else {()}))
    return [(i, j) for n, (i, a) in enumerate(sets) for j, b in sets[:n] if len(a & b) >= similarity * len(a | b)]


def brute_groups(ids, pairs):
    """Least ids of what pairs connect."""
    least = {i: i for i in ids}
    while True:
        before = dict(least)
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
        if least == before:
            return {i for i, m in least.items() if i == m}


def near_copies(rng):
    """Families of edited copies, short texts and unrelated texts that share a long passage."""
    vocabulary = [f"w{n}" for n in range(3000)]
    passage, texts = rng.choices(vocabulary, k=150), []
    for family in range(12):
        base = rng.choices(vocabulary, k=rng.choice([8, 60, 300]))
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 40))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    texts += [" ".join(passage + rng.choices(vocabulary, k=rng.randrange(5, 60))) for _ in range(120)]
    texts += [" ".join(rng.choices(vocabulary, k=40)) for _ in range(30)]
    texts += ["One two", "one two", "one", "", None, texts[0], texts[0]]
    return list(enumerate(texts))


@pytest.mark.parametrize("leaders", [1, 8])
def test_similar_documents_match_brute_force(spark, monkeypatch, leaders):
    monkeypatch.setattr(minwise, "LEADERS", leaders)
    texts = near_copies(random.Random(9))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    edges = [(r.a, r.b) for r in minwise.similar_documents(docs).collect()]
    ids, pairs = [i for i, _ in texts], brute_similar(texts)
    assert brute_groups(ids, edges) == brute_groups(ids, pairs) == brute_groups(ids, pairs + edges)
    stay = {r.doc_id for r in simhash.keep_one_of_each(docs).collect()}
    prints = {i: brute_fingerprint(t) for i, t in texts}
    close = [(i, j) for i in prints for j in prints if j < i and (prints[i] ^ prints[j]).bit_count() <= 2]
    assert stay == brute_groups(ids, pairs + close)


def test_large_buckets_lose_nothing(spark):
    # Chains of sliding windows: only neighbours are similar, and all of a chain share their one bucket.
    chains, length = 6, 100
    rows = [(n, 20, [n // length], list(range(9999 * (n // length) + 2 * (n % length), 9999 * (n // length) + 2 * (n % length) + 20))) for n in range(chains * length)]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "s long, n int, bands array<long>, shingles array<long>")
    edges = {(r.a, r.b) for r in minwise.similar_links(df.drop("shingles"), lambda names: df.join(names, "s").select("s", "shingles")).collect()}
    assert edges == {(n, n - 1) for n in range(chains * length) if n % length}


def test_early_shingles_meet_all_similar_sets(spark):
    rng, sets = random.Random(4), []
    for _ in range(8):
        base = rng.sample(range(-2000, 2000), rng.choice([5, 9, 40]))
        sets += [rng.sample(base, len(base) - rng.randrange(len(base) // 4 + 1)) + rng.sample(range(3000, 9000), rng.randrange(len(base) // 4 + 1)) for _ in range(20)]
    roots = [rng.randrange(100) for _ in sets]
    rows = spark.createDataFrame([(i, r, x) for i, (r, x) in enumerate(zip(roots, sets))], "s long, root long, shingles array<long>")
    got = {(max(r), min(r)) for r in minwise._prefix_pairs(rows, 0.8).collect()}
    similar = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    want = {(i, j) for i in range(len(sets)) for j in range(i) if roots[i] != roots[j] and similar(set(sets[i]), set(sets[j]))}
    assert want and want <= got
    assert all(roots[i] != roots[j] for i, j in got)


def test_fingerprint_chain_matches_brute_force(spark):
    texts = near_copies(random.Random(12))
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), bucket_rows=4).collect()}
    prints = {i: brute_fingerprint(t) for i, t in texts}
    root = brute_components(set(prints.values()))
    least = {}
    for i in sorted(prints):
        least.setdefault(root[prints[i]], i)
    assert got == {i: (f, least[root[f]]) for i, f in prints.items()}
    assert len(set(least.values())) < len(texts) - 20


def test_similar_documents_edges_and_empty(edges, empty):
    pairs = {(r.a, r.b) for r in minwise.similar_documents(edges).collect()}
    assert pairs == {(2, 1), (3, 1), (5, 4)}
    assert minwise.similar_documents(empty).count() == 0


def _invert(mapping):
    out = collections.defaultdict(list)
    for k, v in mapping.items():
        out[v].append(k)
    return out


def brute_repeats(rows, length=35):
    seen = collections.Counter(tuple(w[i : i + length]) for _, t, *_ in rows for w in [words_of(t)] for i in range(len(w) - length + 1))
    out = []
    for doc_id, t, *_ in rows:
        w = words_of(t)
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        out.append((doc_id, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out, key=str)


def test_repeats_match_brute_force(spark, edges, empty, docs):
    got = [tuple(r) for r in repeats.without_repeats(edges).select("doc_id", "n_words", "n_removed", "kept").collect()]
    assert sorted(got, key=str) == brute_repeats(EDGES)
    assert repeats.without_repeats(empty).count() == 0
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    rng = random.Random(2)
    alphabet = ["u", "v", "w"]
    rows += [(1000 + i, " ".join(rng.choice(alphabet) for _ in range(rng.randrange(120)))) for i in range(30)]
    planted = " ".join(f"p{i}" for i in range(60))
    rows += [(2000 + i, f"start{i} {planted} end{i}") for i in range(25)] + [(3000, None)] * 2
    got = [tuple(r) for r in repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == brute_repeats(rows)
    short = [tuple(r) for r in repeats.without_repeats(spark.createDataFrame(rows[-60:], "doc_id long, text string"), length=6, gram=3).collect()]
    assert sorted(short, key=str) == brute_repeats(rows[-60:], 6)


def test_repeated_spans_and_cut_texts(spark, edges, empty):
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(1, f"a  b\n{passage} c", 7), (2, f"{passage}", 7), (3, f"{passage} {passage}", 7), (4, " as \t it was ", 7), (5, None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    spans = sorted((r.doc_id, r.first_word, r.n_words) for r in repeats.repeated_spans(docs).collect())
    assert spans == [(1, 2, 40), (2, 0, 40), (3, 0, 80)]
    cut = {r.doc_id: (r.text, r.n_chars) for r in repeats.cut_repeats(docs).collect()}
    assert cut == {1: ("a b c", 5), 2: ("", 0), 3: ("", 0), 4: (" as \t it was ", 7), 5: (None, 7)}
    kept = repeats.cut_repeats(edges)
    assert kept.schema.simpleString() == edges.schema.simpleString() and kept.count() == len(EDGES)
    assert repeats.cut_repeats(empty).count() == repeats.repeated_spans(empty).count() == 0
    for length, gram in ((5, 6), (5000, 3)):
        with pytest.raises(ValueError):
            repeats.without_repeats(docs, length=length, gram=gram)


def test_token_counts_equal_the_library(spark, edges, empty, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(1)
    chars = " \n\t'sStredlvmxé漢1٣!_- 　\x1c\x85🎉"
    texts = ["".join(rng.choice(chars) for _ in range(rng.randrange(50))) for _ in range(1500)]
    texts += ["".join(chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(40)) for _ in range(100)]
    texts += ["<|endoftext|>a  <|endoftext|> b", "we'll they've I'm 're don't'' 'tis ''s", "a" * 3000, " " * 600]
    rows = [(i, t) for i, t in enumerate(texts)] + [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path).collect())
    library = Tokenizer.from_file(path)
    want = sorted((i, len(t.encode()), len(e.ids)) for (i, t), e in zip(rows, library.encode_batch([t for _, t in rows], add_special_tokens=False)))
    assert got == want
    first = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(edges, path).collect()}
    assert first[1] == first[2] == (0, 0)
    assert token_counts.count_tokens(empty, path).count() == 0


def test_long_texts_are_counted_in_slices():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    counter, library, rng = token_counts.TokenCounter(path), Tokenizer.from_file(path), random.Random(3)
    words = ["don't", "Stop", "x1", "é漢", "'tis", "a", "<|endoftext|>", "\n", "  ", "1 2", "we'll"]
    for text in (" ".join(rng.choice(words) for _ in range(4000)), "a" * 5000, "a b" * 2000, "no cut 1 2 3 " + "9 " * 3000):
        piece = one_piece([text])
        want = len(library.encode(text, add_special_tokens=False).ids)
        assert [int(counter.count_long(piece, limit)[0]) for limit in (50, 997, 10**7)] == [want] * 3


@pytest.mark.parametrize("entries", [1, 2, 8])
def test_chunk_maps_of_long_runs_compose(monkeypatch, entries):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_counts.Counter, "ENTRIES", entries)
    path = public_tokenizers.path("byte_bpe_50k.json")
    counter, library, rng = token_counts.TokenCounter(path), Tokenizer.from_file(path), random.Random(5)
    texts = ["".join(rng.choice(letters) for _ in range(n)) for letters in ("ab", "etaoin", "é漢字x", "=-", "a") for n in (255, 256, 257, 513, 9000)]
    texts += ["abcabd" * 3000, "ha" * 4000 + " " + "na" * 700]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert counter.count(one_piece(texts)).tolist() == want


def test_scan_agrees_with_a_plain_walk():
    table, rng = token_counts.splitter_table(), np.random.default_rng(0)
    classes = rng.integers(0, 13, 5000).astype(np.uint8)
    state, want = token_counts.BEGIN, []
    for c in classes:
        state = table[state, c]
        want.append(state)
    assert (table.ravel()[token_counts.scan_edges(classes, table, 64)] == want).all()


def test_counter_borders_equal_encoding():
    # The rule for borders against the merges themselves, on a vocabulary whose merges often compete.
    rng = random.Random(7)
    for _ in range(12):
        vocab, merges = {bytes([b]): b for b in range(256)}, {}
        while len(merges) < 25:
            a, b = rng.choice([w for w in vocab if set(w) <= set(b"ab")]), rng.choice([w for w in vocab if set(w) <= set(b"ab")])
            if len(a + b) <= 8 and a + b not in vocab:
                merges[vocab[a], vocab[b]] = (len(merges), len(vocab))
                vocab[a + b] = len(vocab)

        def encode(word):
            ids = list(word)
            while found := min(((merges[p][0], k) for k, p in enumerate(zip(ids, ids[1:])) if p in merges), default=None):
                ids[found[1] : found[1] + 2] = [merges[ids[found[1]], ids[found[1] + 1]][1]]
            return ids

        counter = token_counts.Counter(vocab, merges)
        assert set(counter.right) == {i for w, i in vocab.items() if encode(w) == [i]}
        words = ["".join(rng.choice("ab") for _ in range(rng.choice([1, 2, 3, 5, 9, 40, 300]))).encode() for _ in range(30)]
        data = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.array([len(w) for w in words])
        assert counter.count(data, np.cumsum(sizes) - sizes, sizes).tolist() == [len(encode(w)) for w in words]


def test_merge_dropout(spark, edges, empty, docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [(r.doc_id, r.text) for r in docs.limit(60).collect()] + [(500, "  two   blanks \n"), (501, "🎉é漢\x00"), (502, " " * 200), (503, "z" * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plain = {r.doc_id: list(r.ids) for r in merge_dropout.encode(df, path, rate=0).collect()}
    assert all(plain[i] == model.encode(t) for i, t in rows)
    dropped = merge_dropout.encode(df, path, rate=0.2, seed=3).collect()
    assert all(r.lossless for r in dropped) and any(list(r.ids) != plain[r.doc_id] for r in dropped)
    assert {r.doc_id: list(r.ids) for r in dropped} == {r.doc_id: list(r.ids) for r in merge_dropout.encode(df.repartition(3), path, rate=0.2, seed=3).collect()}
    assert {r.doc_id: list(r.ids) for r in dropped} != {r.doc_id: list(r.ids) for r in merge_dropout.encode(df, path, rate=0.2, seed=4).collect()}
    coded = merge_dropout.encode(edges, path)
    assert sorted((r.doc_id or 0, r.text) for r in merge_dropout.decode(coded, path).collect()) == sorted((r[0] or 0, r[1] or "") for r in EDGES)
    assert all(r.lossless for r in coded.collect())
    assert merge_dropout.encode(empty, path).count() == 0


def test_dropout_cuts_each_occurrence_for_itself(spark):
    path, rate, seed = public_tokenizers.path("piece_bpe_32k.model"), 0.2, 3
    vocab, word = merge_dropout.vocabulary(path), "international"
    rows = [(i, " ".join([word] * 50 + ["the"] * 50)) for i in range(20)] + [(30, "y" * 90)]
    coded = {r.doc_id: list(r.ids) for r in merge_dropout.encode(spark.createDataFrame(rows, "doc_id long, text string"), path, rate=rate, seed=seed).collect()}
    assert len({tuple(coded[i]) for i in range(20)}) == 20  # equal texts differ by id
    cuts = set()
    for doc_id, text in rows:
        salt, want = merge_dropout.mix(np.array([doc_id], np.uint64) ^ merge_dropout.mix(np.array([seed], np.uint64))), []
        for place, part in enumerate(text.split(" ")):
            symbols = vocab.symbol[[0x20, *map(ord, part)]]
            want.append(merge_dropout.merge_long(vocab, symbols, int(merge_dropout.mix(salt + np.uint64(place))[0]), rate))
            cuts |= {tuple(want[-1])} if part == word else set()
        assert coded[doc_id] == [x for p in want for x in p]
    assert len(cuts) > 20


def naive_merge(vocab, symbols, part, rate):
    """Agenda merging written out: at each step the best of all adjacent pairs whose candidate isn't skipped."""
    spans = [(k, k + 1, int(x) if x >= 0 else -2 - k) for k, x in enumerate(symbols)]
    while True:
        open_ = []
        for k, ((a, m, x), (_, b, y)) in enumerate(zip(spans, spans[1:])):
            found = vocab.pairs.get(x * vocab.n + y) if x >= 0 and y >= 0 else None
            word = int(merge_dropout.mix(np.array([part], np.uint64) ^ merge_dropout.mix(np.array([(a << 42) ^ (m << 21) ^ b], np.uint64)))[0]) >> 11
            if found and word >= rate * 2**53:
                open_.append((found[0], k, found[1]))
        if not open_:
            return [x for _, _, x in spans]
        _, k, made = min(open_)
        spans[k : k + 2] = [(spans[k][0], spans[k + 1][1], made)]


def test_dropout_equals_naive_merging(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    vocab = merge_dropout.vocabulary(path)
    rng = random.Random(6)
    for rate in (0.2, 0.7):
        for n in (1, 2, 7, 15, 40, 80):
            symbols = vocab.symbol[[0x20, *rng.choices([ord(c) for c in "theinaorsé漢"], k=n)]]
            key = rng.getrandbits(63)
            want = naive_merge(vocab, symbols, key, rate)
            grid = np.where(symbols < 0, -2 - np.arange(len(symbols), dtype=np.int32), symbols)
            assert merge_dropout.merge_long(vocab, grid, key, rate) == want
            merged, size = merge_dropout.merge_many(vocab, grid[None], np.array([key], np.uint64), rate)
            assert merged[0, : size[0]].tolist() == want


def test_a_long_text_encodes_as_a_whole():
    import pyarrow as pa

    from tallyspark.llm.text_arrays import pieces

    vocab = merge_dropout.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    text = "  long  texts é▁ go from blank to blank\n" * 60
    (piece,) = pieces([pa.RecordBatch.from_arrays([pa.array([text])], ["text"])], "text")
    doc = np.array([5], np.uint64)
    whole = merge_dropout.encode_texts(vocab, piece, doc, 0.3, 1)[0].tolist()
    for limit in (1, 50, 777):
        assert merge_dropout.encode_texts(vocab, piece, doc, 0.3, 1, limit)[0].tolist() == whole


def test_merge_by_heap_equals_merge_by_grid():
    vocab = merge_dropout.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(4)
    grid = vocab.symbol[rng.choice([ord(c) for c in "thein aors"], (200, 12))]
    part = rng.integers(0, 1 << 62, 200).astype(np.uint64)
    for rate in (0.0, 0.3):
        merged, size = merge_dropout.merge_many(vocab, grid, part, rate)
        for k in range(200):
            assert merge_dropout.merge_long(vocab, grid[k], int(part[k]), rate) == merged[k, : size[k]].tolist()


def brute_tiles(p, d, least):
    mp, md, total = [0] * len(p), [0] * len(d), 0
    while True:
        best, found = least - 1, []
        for i in range(len(p)):
            for j in range(len(d)):
                k = 0
                while i + k < len(p) and j + k < len(d) and p[i + k] == d[j + k] and not mp[i + k] and not md[j + k]:
                    k += 1
                if k > best:
                    best, found = k, [(i, j)]
                elif k == best and k >= least:
                    found.append((i, j))
        if best < least:
            return total
        for i, j in found:
            if not any(mp[i : i + best]) and not any(md[j : j + best]):
                mp[i : i + best], md[j : j + best], total = [1] * best, [1] * best, total + best


def test_tiles_match_brute_force():
    rng = random.Random(3)
    for _ in range(150):
        a, least = rng.choice([3, 6, 20]), rng.choice([2, 3, 5])
        p, d = ([rng.randrange(a) for _ in range(rng.randrange(1, 40))] for _ in range(2))
        assert sum(t[2] for t in decontamination.tiles(np.array(p, np.uint64), np.array(d, np.uint64), least)) == brute_tiles(p, d, least)


def test_decontamination(spark, edges, empty):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    w = item.split()
    turned = " ".join(w[10:] + ["filler"] + w[:10])
    rows = [(1, f"before {item} after"), (2, f"x {turned.upper()}, y"), (3, " ".join(w[:7]) + " nothing else"), (4, None), (5, ""), (1, f"before {item} after")]
    bench = spark.createDataFrame([(10, item), (11, None), (12, "too short"), (13, item)], "item_id long, text string")
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.n_covered, len(r.tiles)) for r in decontamination.contaminated_pairs(d, bench).collect())
    assert got == [(1, 10, 20, 1), (1, 10, 20, 1), (1, 13, 20, 1), (1, 13, 20, 1), (2, 10, 20, 2), (2, 13, 20, 2)]
    assert sorted(r.doc_id for r in decontamination.without_contaminated(d, bench).collect()) == [3, 4, 5]
    assert decontamination.contaminated_pairs(edges, bench).count() == 0
    assert decontamination.contaminated_pairs(empty, bench).count() == 0
    assert decontamination.contaminated_pairs(d, bench.limit(0)).count() == 0
    assert decontamination.without_contaminated(edges, bench).columns == edges.columns
    clash = d.selectExpr("*", "1 AS uid", "2 AS item_id", "3 AS seeds")
    assert sorted(r.doc_id for r in decontamination.without_contaminated(clash, bench.selectExpr("*", "1 AS item")).collect()) == [3, 4, 5]


def test_contaminated_pairs_match_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)] + ["a", "b"] * 20
    items = [(i, rng.choices(words, k=rng.choice([4, 5, 6, 12, 30]))) for i in range(25)] + [(30, ["x", "y"] * 10)]
    docs = []
    for i in range(60):
        text = rng.choices(words, k=rng.randrange(40))
        for _ in range(rng.randrange(4)):
            w = rng.choice(items)[1]
            a, b = sorted(rng.choices(range(len(w) + 1), k=2))
            at = rng.randrange(len(text) + 1)
            text[at:at] = w[a:b] if rng.random() < 0.5 else w[len(w) // 2 :] + w[: len(w) // 2]
        docs.append((i, text))
    want = {(d, i): c for d, t in docs for i, w in items if len(w) >= 5 and (c := brute_tiles(w, t, 5)) >= 0.6 * len(w)}
    frame = lambda rows, name: spark.createDataFrame([(i, ", ".join(w).upper()) for i, w in rows], f"{name} long, text string")
    for bits in (1 << 27, 1 << 16):
        monkeypatch.setattr(decontamination, "TABLE_BITS", bits)
        got = decontamination.contaminated_pairs(frame(docs, "doc_id"), frame(items, "item_id")).collect()
        assert {(r.doc_id, r.item_id): r.n_covered for r in got} == want and len(want) > 20
    texts, passages = dict(docs), dict(items)
    assert all(texts[r.doc_id][t.doc_start : t.doc_start + t.length] == passages[r.item_id][t.item_start : t.item_start + t.length] for r in got for t in r.tiles)


def test_warc_round_trip(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    extra = [(9001, "http://a/", None), (9002, None, ""), (9003, "http://b/\r\nX: y", "same"), (9004, "http://c/", "same"), (9004, "http://c/", "same"), (None, "http://d/", "same"), (9005, "http://e/", "ü" * 300000)]
    rows = [tuple(r) for r in pages.collect()] + extra
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = scratch_path(spark, "warc-test")
    manifest = stored(warc.write_archives(df.coalesce(1), folder), "manifest-test")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(manifest, folder).collect()), key=str)
    top = {}
    for i, _, h in rows:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in rows:
        body, t = (h or "").encode(), top[h or ""]
        first = i == t
        want.append((i, len(body), warc.base32_sha1(body), "response" if first else "revisit", None if first else t))
    assert got == sorted(want, key=str)
    files = [r.path for r in manifest.collect() if r.records > 40]
    assert files
    data = open(files[0], "rb").read()
    assert data[:4] == b"\x5d\x2a\x4d\x18"  # the dictionary's skippable frame
    size = int.from_bytes(data[4:8], "little")
    one = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size])).decompressobj()
    assert one.decompress(data[8 + size :]).startswith(b"WARC/1.1\r\n") and one.unused_data  # records are frames of their own
    none = stored(warc.write_archives(df.limit(0), scratch_path(spark, "warc-none")), "manifest-none")
    assert warc.read_archives(none, folder).count() == 0


def test_archive_of_one_record_has_a_dictionary_too():
    class Sink(io.BytesIO):
        def close(self):
            self.kept = self.getvalue()

    sink = Sink()
    writer = warc.ArchiveWriter(sink)
    writer.add(warc.record_bytes(1, "u", b"body", warc.base32_sha1(b"body"), None, False, "2024-01-01T00:00:00Z"))
    writer.close()
    assert [h["WARC-Type"] for h, _ in warc.read_archive(io.BytesIO(sink.kept))] == ["response"]
    assert sink.kept[:4] == b"\x5d\x2a\x4d\x18"
    size = int.from_bytes(sink.kept[4:8], "little")
    assert sink.kept[8 : 8 + size].startswith(b"WARC/1.1") and len(sink.kept) < 8 + size + 120  # the record is little more than a copy


def test_statistics_match_brute_force(docs):
    import pyarrow as pa

    from tallyspark.llm.text_arrays import pieces

    texts = [r[1] for r in EDGES] + [r.text for r in docs.collect()] + ["a b\na b\n\na b \n *|$ <>\n"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    c = [statistics.counts(p) for p in pieces([batch], "text", 5000)]
    c = {k: np.concatenate([x[k] for x in c]) for k in c[0]}
    for i, t in enumerate(texts):
        t = t or ""
        w = words_of(t)
        at = collections.defaultdict(list)
        for j in range(len(w) - 7):
            at[tuple(w[j : j + 8])].append(j)
        rep = {j + k for v in at.values() if len(v) > 1 for j in v for k in range(8)}
        lines, dup = set(), 0
        for line in t.split("\n"):
            if line.encode().split():
                dup += line in lines
                lines.add(line)
        want = (len(w), sum(len(x.decode()) for x in w), sum(ch in "#*$%&|<>" for ch in t), dup, len(rep), len(set(w)))
        assert tuple(int(c[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct")) == want


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


@pytest.fixture(scope="module")
def larger(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


def test_quality_classifier_held_out(larger, edges, empty, labels):
    docs, marks = larger
    got = {r.doc_id: r for r in factorisation.classify(docs, marks).collect()}
    assert all(r.held_out == fold(i) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    held = [(r.quality, got[r.doc_id].predicted) for r in marks.collect() if fold(r.doc_id)]
    assert np.mean([a == b for a, b in held]) > 0.93
    assert len(factorisation.classify(edges, labels).collect()) == len(EDGES)
    assert factorisation.classify(empty, labels).count() == 0
    assert {r.score for r in factorisation.classify(edges, labels.limit(0)).collect()} == {0.5}
    kept = factorisation.keep_good(edges, labels)
    assert kept.columns == edges.columns


def one_piece(texts):
    import pyarrow as pa

    from tallyspark.llm.text_arrays import pieces

    (piece,) = pieces([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])], "text", 1 << 30)
    return piece


def test_quality_scores_equal_all_pairs(larger):
    # The score from texts, with every pair of features written out.
    docs, marks = larger
    m = factorisation.train(docs, marks)
    texts = [r.text for r in docs.limit(3).collect()] + ["one two two three", "", None]
    piece = one_piece(texts)
    stats, first, hashes = statistics.features(statistics.counts(piece)), piece.words()[2], piece.word_hashes()
    for k, got in enumerate(m.score(piece)):
        n = collections.Counter((hashes[first[k] : first[k + 1]] >> np.uint64(50)).tolist())
        size = sum(np.log1p(c) ** 2 for c in n.values()) ** 0.5
        x = {i: np.log1p(c) / size for i, c in n.items()}
        x |= {factorisation.WORD_BUCKETS + j: max(-4, min(4, (v - m.mean[j]) / m.scale[j])) / len(statistics.FEATURES) ** 0.5 for j, v in enumerate(stats[k])}
        raw, each = m.bias + sum(float(m.linear[i]) * v for i, v in x.items()), list(x.items())
        raw += sum(float(m.factors[i] @ m.factors[j]) * v * w for a, (i, v) in enumerate(each) for j, w in each[:a])
        assert abs(got - 1 / (1 + np.exp(-raw))) < 1e-4


def test_language_probabilities_equal_a_plain_walk():
    net = language.new_network(["a", "b", "c"])
    texts = ["bonjour le monde, é漢 " * 33, "x", "", "y" * language.SEGMENT]
    got = language.document_probabilities(net, one_piece(texts), batch=2)
    for text, p in zip(texts, got):
        raw, total = text.encode(), np.zeros(3)
        for at in range(0, len(raw), language.SEGMENT):
            end = min(at + language.SEGMENT, len(raw))
            states = [[], []]
            lead_in = range(max(0, at - language.CONTEXT), end), range(min(len(raw), at + language.SEGMENT + language.CONTEXT) - 1, at - 1, -1)
            for way, order in enumerate(lead_in):
                h = np.zeros(language.HIDDEN)
                for t in order:
                    z, r = (np.clip((net.gates[way, g, raw[t]] + h @ net.u_gates[way, g]) / 4 + 0.5, 0, 1) for g in (0, 1))
                    h = h + z * (np.tanh(net.inputs[way, raw[t]] + r * (h @ net.u_inputs[way])) - h)
                    if at <= t < end:
                        states[way].append(h)
            for f, b in zip(states[0], states[1][::-1]):
                e = np.exp(np.concatenate([f, b]) @ net.out + net.bias)
                total += e / e.sum()
        assert np.allclose(p, total / max(1, len(raw)), atol=1e-4)


def test_factorisation_machine_identity_equals_all_pairs():
    rng = np.random.default_rng(0)
    n = 40
    first = np.arange(n + 1) * 5
    words = factorisation.Sparse(np.concatenate([rng.permutation(50)[:5] for _ in range(n)]), rng.random(5 * n).astype(np.float32), first)
    stats = rng.random((n, len(statistics.FEATURES)))
    m = factorisation.fit(words, stats, (rng.random(n) < 0.5).astype(float), epochs=2)
    raw, _ = m.raw(words, stats)
    for i in range(n):
        x = np.zeros(len(m.linear))
        np.add.at(x, words.index[first[i] : first[i + 1]], words.value[first[i] : first[i + 1]])
        x[factorisation.WORD_BUCKETS :] = m.scaled(stats[i : i + 1])[0]
        pairs = sum(float(m.factors[a] @ m.factors[b]) * x[a] * x[b] for a in np.flatnonzero(x) for b in np.flatnonzero(x) if a < b)
        assert abs(raw[i] - (m.bias + float(m.linear @ x) + pairs)) < 1e-4


def test_quality_rules(larger, edges, empty, labels):
    docs, marks = larger
    trees = boosted_rules.train(docs, marks)
    rows = {r.doc_id: r for r in boosted_rules.judge(docs, trees).collect()}
    held = [(r.quality == 1, rows[r.doc_id].score >= 0.5) for r in marks.collect() if fold(r.doc_id)]
    assert np.mean([a == b for a, b in held]) > 0.93
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and (not r.kept or not r.base_failed) for r in rows.values())
    x = np.random.default_rng(1).random((200, len(statistics.FEATURES))) * 3
    for name, sign in boosted_rules.MONOTONE.items():
        f, last = statistics.FEATURES.index(name), None
        for v in np.linspace(0, 3, 25):
            x[:, f] = v
            raw = trees.raw(x)
            assert last is None or (sign * (raw - last) >= -1e-9).all()
            last = raw
    edge = {r.doc_id: r for r in boosted_rules.judge(edges, trees).collect()}
    assert edge[1].n_words == 0 and edge[1].base_failed and not edge[1].kept and edge[6].base_failed
    assert boosted_rules.judge(empty, trees).count() == 0
    assert boosted_rules.train(docs, marks.limit(0)).raw(x)[0] > 0


def test_flattened_trees_equal_a_plain_walk():
    rng = np.random.default_rng(3)
    x = np.round(rng.random((600, len(statistics.FEATURES))), 2)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + 0.3 * rng.random(600) > 0.9).astype(float)
    trees = boosted_rules.fit(x, y, trees=12)
    assert (trees.left != np.arange(trees.left.shape[1])).any(axis=1).all()  # each tree has split

    def walk(t, row):
        node = 0
        while trees.left[t, node] != node:
            node = trees.left[t, node] if row[trees.feature[t, node]] <= trees.cut[t, node] else trees.right[t, node]
        return trees.value[t, node]

    edge = np.where(rng.random(x.shape) < 0.5, rng.choice(trees.cut.ravel(), x.shape), x)  # values that are just a cut go left
    for rows in (x, edge):
        want = [trees.bias + sum(walk(t, row) for t in range(12)) for row in rows]
        assert np.allclose(trees.raw(rows), want, rtol=0, atol=1e-12)
    assert np.mean((trees.score(x) >= 0.5) == (y == 1)) > 0.9


def test_language(larger, edges, empty):
    docs, _ = larger
    net = language.train(docs)
    rows = {r.doc_id: r for r in language.predict(docs, net).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [rows[i].lang_pred == truth[i] for i in truth if fold(i)]
    assert np.mean(held) > 0.95
    edge = {r.doc_id: r for r in language.predict(edges, net).collect()}
    assert edge[1].lang_pred == edge[2].lang_pred == edge[3].lang_pred == "und" and edge[1].score == 0
    assert edge[9].lang_pred in net.languages and 0 <= edge[9].score <= 1
    assert language.predict(empty, net).count() == 0
    assert language.train(empty) is None
    assert {r.lang_pred for r in language.predict(edges, None).collect()} == {"und"}


def test_language_gradients():
    net = language.new_network(["a", "b", "c"])
    codes = np.random.default_rng(0).integers(0, 256, (5, 3)).astype(np.int16)
    codes[3:, 1] = language.PAD
    target = np.array([0, 1, 2])
    _, grads = language.gradients(net, codes, target)
    for w, g in zip(net.weights(), grads):
        at = np.unravel_index(np.argmax(np.abs(g)), w.shape)
        old, step = w[at], 1e-2
        w[at] = old + step
        up = language.gradients(net, codes, target)[0]
        w[at] = old - step
        down = language.gradients(net, codes, target)[0]
        w[at] = old
        assert abs(g[at] - (up - down) / (2 * step)) < 1e-3


def test_host_reputation(spark):
    rows = [(i, f"http://bad.site.org/x{i}") for i in range(60)] + [(100 + i, f"https://Good.site.org/y{i}?q") for i in range(60)] + [(300 + i, f"http://h{i}.net.com/") for i in range(5)]
    rows += [(900, None), (901, "no scheme"), (902, "http://"), (903, "http://a.example.net/en/p"), (904, "http://a.example.net/de/p#f"), (905, "http://notexample.net"), (906, "http://x.org/fr/"), (906, "http://x.org/fr/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    outcomes = spark.createDataFrame([(i, True) for i in range(60)] + [(0, False), (1, None), (None, True)] + [(100 + i, i % 30 == 0) for i in range(60)], "page_id long, bad boolean")
    got = {r.page_id: r for r in host_reputation.judge_urls(pages, outcomes).collect()}
    assert got[5].verdict == "block" and got[105].verdict == "allow" and got[105].host == "good.site.org" and got[105].path == "/y5"
    assert got[900].host == "" and got[900].path == "" and got[901].host == "" and got[902].verdict == "allow"
    assert (got[903].rule, got[903].verdict) == ("example.net/en/", "allow")
    assert (got[904].rule, got[904].verdict) == ("net/", "block")
    assert got[905].rule is None and got[905].path == ""  # no path to start with "/"
    assert (got[906].rule, got[906].verdict) == ("org/fr/", "allow")
    assert host_reputation.judge_urls(pages, outcomes).count() == len(rows)
    assert host_reputation.judge_urls(pages.limit(0), outcomes).count() == 0
    assert {r.verdict for r in host_reputation.judge_urls(pages.filter("page_id < 900"), outcomes.limit(0)).collect()} == {"allow"}


def test_names_used_inside_do_not_clash(spark):
    pages = spark.createDataFrame([(1, "http://a.b/x", "same"), (2, "http://a.b/y", "same"), (3, None, None)], "page_id long, url string, html string")
    clash = pages.selectExpr("*", "1 AS payload", "2 AS digest", "3 AS response", "4 AS n", "5 AS host", "6 AS bad", "7 AS path", "8 AS lower")
    folder = scratch_path(spark, "warc-clash")
    read = warc.read_archives(stored(warc.write_archives(clash, folder), "manifest-clash"), folder).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in read) == [(1, "revisit", 2), (2, "response", None), (3, "response", None)]
    outcomes = spark.createDataFrame([(1, True, 1), (2, True, 1)], "page_id long, bad boolean, host int")
    assert sorted(r.host for r in host_reputation.judge_urls(clash, outcomes).collect()) == ["", "a.b", "a.b"]


def test_country_suffixes(spark):
    hosts = spark.createDataFrame([("x.a.co.uk", 40, 40), ("y.b.co.uk", 40, 0), ("z.b.co.uk", 0, 0), ("co.uk", 0, 0), ("uk", 0, 0), ("", 0, 0)], "host string, n long, bad long")
    got = {r.host: r.blocked for r in host_reputation.reputations(hosts).collect()}
    assert got["x.a.co.uk"] and not got["y.b.co.uk"] and not got["z.b.co.uk"] and len(got) == 6


@pytest.fixture(scope="module")
def small_corpus(spark, tmp_path_factory):
    """A folder of tables: some real documents, copies, a shared passage and a benchmark item."""
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    rows = [tuple(r) for r in docs.collect()]
    good = next(t for _, t, *_ in rows if t and len(t.split()) > 80)
    passage, item = " ".join(f"wort{i}" for i in range(50)), spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    more = [(9000, good + " end", "en", "s", 1), (9001, good + " " + passage, "en", "s", 1), (9002, f"{passage} {rows[5][1]}", "en", "s", 1), (9003, f"{rows[7][1]} {item}", "en", "s", 1), (9004, None, None, None, None), (9005, "", "en", "s", 0)]
    spark.createDataFrame(rows + more, docs.schema).write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_pipeline_stages_match_brute_force(spark, small_corpus):
    import corpus_pipeline as pipeline

    read = lambda name: spark.read.parquet(f"{small_corpus}/{name}.parquet")
    docs, rows = read("documents"), lambda df: {r.doc_id: r for r in df.collect()}
    stages = dict(pipeline.STAGES)
    good = stages["quality"](spark, docs, small_corpus)
    scores = {r.doc_id: r.score for r in factorisation.classify(docs, read("labels")).collect()}
    assert set(rows(good)) == {i for i, x in scores.items() if x >= 0.5} and good.columns == docs.columns
    texts = [(i, r.text) for i, r in rows(good).items()]
    prints = {i: brute_fingerprint(t) for i, t in texts}
    pairs = brute_similar(texts) + [(i, j) for i in prints for j in prints if j < i and (prints[i] ^ prints[j]).bit_count() <= 2]
    one = stored(stages["near_duplicates"](spark, good, small_corpus), "one")
    assert set(rows(one)) == brute_groups([i for i, _ in texts], pairs) and one.columns == docs.columns
    cut = stored(stages["substrings"](spark, one, small_corpus), "cut")
    want = {i: (text, removed) for i, _, removed, text in brute_repeats([(i, r.text) for i, r in rows(one).items()])}
    assert {i: r.text for i, r in rows(cut).items()} == {i: want[i][0] if want[i][1] else r.text for i, r in rows(one).items()} and cut.columns == docs.columns
    clean = stages["decontaminated"](spark, cut, small_corpus)
    bad = {r.doc_id for r in decontamination.contaminated_pairs(cut, read("benchmark")).collect()}
    assert set(rows(clean)) == set(rows(cut)) - bad and clean.columns == docs.columns
    end = rows(pipeline.run(spark, small_corpus))
    assert set(end) == set(rows(clean)) and all(r.lossless for r in end.values())
    again = rows(stages["encoded"](spark, clean, small_corpus))
    assert {i: list(r.ids) for i, r in end.items()} == {i: list(r.ids) for i, r in again.items()}


def test_pipeline_on_empty_tables_and_more_columns(spark, small_corpus, edges):
    import corpus_pipeline as pipeline

    empty = spark.read.parquet(f"{small_corpus}/documents.parquet").limit(0)
    for name, stage in pipeline.STAGES:
        assert stage(spark, empty, small_corpus).count() == 0
        if name != "encoded":
            assert stage(spark, edges, small_corpus).columns == edges.columns


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(150)] + [(500, 501), (501, 500)], "a long, b long")
    got = {r.node: r.root for r in components.connected_components(edges, "a", "b").collect()}
    assert all(got[i] == 0 for i in range(151)) and got[501] == got[500] == 500
    assert components.connected_components(edges.limit(0), "a", "b").count() == 0


def test_op5_digest(spark):
    rows = {r.doc_id: r for r in queries.op5_substring_dedup(spark, SF).collect()}
    kept = {r.doc_id: r.kept for r in repeats.without_repeats(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert all(r.kept_sha256 == hashlib.sha256(kept[i].encode()).hexdigest() for i, r in rows.items())


def test_pipeline_stages_on_given_documents(spark, labels):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(150)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    good = stored(corpus_pipeline.quality(spark, docs, SF), "t1")
    assert good.columns == docs.columns and good.count() <= docs.count()
    single = stored(corpus_pipeline.near_duplicates(spark, good, SF), "t2")
    texts = [(r.doc_id, r.text) for r in good.collect()]
    prints = {i: brute_fingerprint(t) for i, t in texts}
    root = brute_components(set(prints.values()))
    want = brute_groups([i for i, _ in texts], [*brute_similar(texts), *((i, min(v)) for v in _invert({i: root[f] for i, f in prints.items()}).values() for i in v)])
    assert {r.doc_id for r in single.collect()} == want
    cut = stored(corpus_pipeline.substrings(spark, single, SF), "t3")
    rows = [(r.doc_id, r.text) for r in single.collect()]
    gone = {i: (n, kept) for i, _, n, kept in brute_repeats(rows)}
    texts = dict(rows)
    assert {r.doc_id: r.text for r in cut.collect()} == {i: (texts[i] if n == 0 else kept) for i, (n, kept) in gone.items()}
    assert cut.columns == docs.columns
    clean = stored(corpus_pipeline.decontaminated(spark, cut, SF), "t4")
    found = {r.doc_id for r in decontamination.contaminated_pairs(cut, bench).collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in cut.collect()} - found
    assert all(r.lossless for r in corpus_pipeline.encoded(spark, clean, SF).collect())
