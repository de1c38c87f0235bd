"""Near duplicates of texts and vectors against brute force."""

import random

import numpy as np
import pytest

from tests.conftest import TESTDATA
from tidemark.llm import embeddings, ngram_join
from tidemark.llm.common import words_of
from tidemark.llm.components import components
from tidemark.llm.queries import op2_ngram_join, op10_embeddings


def closure(links, nodes):
    least = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            for x in (a, b):
                if least[x] != m:
                    least[x], changed = m, True
    return least


def plain_text_links(texts):
    sets = {}
    for d, t in texts.items():
        w = words_of(t)
        s = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        if s:
            sets[d] = s
    where = {}
    for d, s in sets.items():
        for g in s:
            where.setdefault(g, []).append(d)
    near = {tuple(sorted((a, b))) for ds in where.values() for i, a in enumerate(ds) for b in ds[i + 1 :]}
    return {(a, b) for a, b in near if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}


def check_texts(rows, texts):
    links = plain_text_links(texts)
    degree = dict.fromkeys(texts, 0)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    least = closure(links, texts)
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in rows} == {d: (least[d], degree[d]) for d in texts}
    return links


def test_op2(spark, sf, texts):
    rows = op2_ngram_join(spark, sf).collect()
    assert len(rows) == len(texts) and check_texts(rows, texts)


def edited(words, n, rng):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return " ".join(out)


def test_groups_of_near_copies(spark, monkeypatch):
    """A large group near the threshold, cut into many blocks, and one of exact copies."""
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    rng = random.Random(5)
    base = [f"b{rng.randrange(3000)}" for _ in range(120)]
    texts = {i: edited(base, rng.randrange(5), rng) for i in range(150)}
    texts |= {1000 + i: "the same text again and again here" for i in range(60)}
    texts |= {2000 + i: " ".join(f"q{rng.randrange(10**6)}" for _ in range(50)) for i in range(40)}
    texts |= {3000: "short one", 3001: "Short, ONE!", 3002: "one short"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = ngram_join.near_duplicates(df).collect()
    assert len(check_texts(rows, texts)) > 2000


def test_isolated_link_beside_a_hot_group(spark):
    """Two texts of similarity exactly 0.8 that share no label of 8 values are found, however many close copies there are."""
    for k in range(5000):
        words = [f"p{k}q{i}" for i in range(44)]
        pair = [" ".join(words[:36]), " ".join(words)]
        x, y = ngram_join.signatures([ngram_join.shingles(t) for t in pair])
        if not (x == y).reshape(ngram_join.TREES, ngram_join.DEPTH).all(1).any():
            break
    else:
        pytest.fail("no such pair")
    rng = random.Random(8)
    base = [f"b{i}" for i in range(300)]
    texts = {i: edited(base, 1, rng) for i in range(100)} | {1000: pair[0], 1001: pair[1]}
    rows = ngram_join.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert (1000, 1001) in check_texts(rows, texts)


def test_shingles_and_signatures():
    a, b = ngram_join.shingles("a b c d e f g"), ngram_join.shingles("A, b; c d e f g")
    assert len(a) == 3 and (a == b).all() and len(ngram_join.shingles("a b")) == 1 and len(ngram_join.shingles(None)) == 0
    # The same words at another place of a text have the same hash.
    assert set(ngram_join.shingles("c d e f g")) <= set(a)
    rng = np.random.default_rng(1)
    x = np.unique(rng.integers(1, 2**63, 1000, dtype=np.uint64))
    y = np.concatenate([x[: int(len(x) * 0.9)], rng.integers(1, 2**63, 10, dtype=np.uint64)])
    s = ngram_join.signatures([x, np.unique(y)])
    exact = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    assert abs((s[0] == s[1]).mean() - exact) < 0.08
    assert ngram_join.met(np.array(0.8), 6) > 0.9999 > ngram_join.met(np.array(0.8), 7)


def test_op2_odd_rows(odd, empty):
    rows = ngram_join.near_duplicates(odd).collect()
    got = sorted((r["doc_id"] or 0, r["class_id"], r["n_links"]) for r in rows if r["doc_id"])
    assert len(rows) == 11 and got == [(1, 1, 0), (2, 2, 0), (3, 3, 2), (4, 3, 2), (4, 3, 2), (5, 5, 0), (6, 6, 0), (7, 7, 0), (8, 8, 0)]
    assert [(r["class_id"], r["n_links"]) for r in rows if r["doc_id"] is None] == [(None, 0)] * 2
    assert ngram_join.near_duplicates(empty).count() == 0


def test_repeated_ids(spark):
    """Each row links by its own text, whichever rows share its id."""
    a = " ".join(f"w{i}" for i in range(40))
    rows = [(1, a), (1, " ".join(f"v{i}" for i in range(40))), (3, a + " more"), (1, a)]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == [(1, 1, 0), (1, 1, 2), (1, 1, 2), (3, 1, 2)]


def test_depth_stops_by_size():
    """The least similarity of small sets is that of brute force, and prefixes meet it with the target chance."""
    from fractions import Fraction

    for n in range(1, 40):
        possible = [Fraction(c, n + m - c) for m in range(1, 80) for c in range(1, min(n, m) + 1) if Fraction(c, n + m - c) >= Fraction(4, 5)]
        assert ngram_join.least_similarity(n) == pytest.approx(float(min(possible)))
    stop = ngram_join.depths(ngram_join.RECALL)
    assert stop[6] > stop[-1] == 6 and all(ngram_join.met(np.array(ngram_join.least_similarity(n)), int(d)) >= ngram_join.RECALL for n, d in enumerate(stop) if n)


@pytest.mark.parametrize("batch", [7, 1000])
def test_tries_match_prefixes(batch):
    """Stars over sorted labels join what has equal prefixes of the depth of both, also over cuts of batches and partitions."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    n = 400
    labels = rng.integers(0, 3, (n, 2, 32)).astype(np.uint8)
    labels[:, :, :20] = 1
    size = rng.integers(4, 9, n)
    stop = ngram_join.depths(ngram_join.RECALL)
    rows = sorted((bytes([t]) + labels[i, t].tobytes(), i, int(size[i])) for i in range(n) for t in range(2))
    edges, cuts = [], {}
    for part in (rows[:300], rows[300:310], rows[310:]):
        batches = [pa.record_batch([pa.array(c, k) for c, k in zip(zip(*part[i : i + batch]), (pa.binary(), pa.int64(), pa.int32()))], names=["k", "n", "s"]) for i in range(0, len(part), batch)]
        for b in ngram_join._tries(stop)(iter(batches)):
            for a, to, depth, prefix in zip(*(c.to_pylist() for c in b.columns)):
                if prefix is None:
                    edges.append((a, to))
                else:
                    cuts.setdefault((depth, prefix), []).append(a)
    edges += [(a, x[0]) for x in cuts.values() for a in x]
    want = []
    for i in range(n):
        for j in range(i):
            k = 4 * int(max(stop[size[i]], stop[size[j]]))
            if any((labels[i, t, :k] == labels[j, t, :k]).all() for t in range(2)):
                want.append((i, j))
    assert want and closure(edges, range(n)) == closure(want, range(n))


def test_rows_grow_with_blocks(spark, monkeypatch, tmp_path):
    """Rows that verification moves for a group of n near copies: n, and a row for each pair of blocks, not n a block."""
    monkeypatch.setattr(ngram_join, "BLOCK", 32)
    counts = {}
    for n in (128, 512):
        rng = random.Random(n)
        base = [f"b{i}" for i in range(150)]
        texts = {i: edited(base, 1, rng) for i in range(n)}
        made = []
        keep = ngram_join.Scratch.written
        monkeypatch.setattr(ngram_join.Scratch, "written", lambda self, df, name, made=made, keep=keep: (out := keep(self, df, name), made.append((name, out.count())))[0])
        rows = ngram_join.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
        monkeypatch.setattr(ngram_join.Scratch, "written", keep)
        assert {r["n_links"] for r in rows} == {n - 1}
        counts[n] = max(k for name, k in made if name != "tries" and name != "edges")
    assert counts[512] <= 5 * counts[128]


def test_packed_blocks():
    rng = np.random.default_rng(2)
    block = ngram_join.Block.of([(int(rng.integers(-(2**62), 2**62)), int(rng.integers(1, 9)), np.unique(rng.integers(0, 5000, int(rng.integers(1, 300)), dtype=np.uint64))) for _ in range(50)])
    back = ngram_join.Block.unpacked(block.packed())
    assert all((getattr(back, c) == getattr(block, c)).all() for c in ("nodes", "copies", "roots")) and all((x == y).all() for x, y in zip(back.sets, block.sets))


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(90)] + [(5000, i) for i in range(5001, 5200)]
    nodes = {n for e in edges for n in e if e[0] != e[1]}
    df = spark.createDataFrame([*edges, (7, None), (None, None)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(df).collect()}
    assert got == {k: v for k, v in closure(edges, {n for e in edges for n in e}).items() if k in nodes}
    assert components(df.limit(0)).count() == 0


def plain_vectors(vectors):
    good = {i: np.array(v, float) for i, v in vectors.items() if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = list(good)
    scaled = {i: v / np.abs(v).max() for i, v in good.items()}
    unit = {i: v / np.linalg.norm(v) for i, v in scaled.items()}
    unit = np.array([unit[i] for i in ids])
    a, b = np.nonzero(np.triu(unit @ unit.T >= 0.95, 1))
    return {(ids[i], ids[j]) for i, j in zip(a, b)}


def check_vectors(rows, vectors):
    links = plain_vectors(vectors)
    degree = dict.fromkeys(vectors, 0)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    least = closure(links, vectors)
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rows} == {i: (degree[i], least[i]) for i in vectors}
    return links


def test_op10(spark):
    sf = f"{TESTDATA}/sf0.1"
    vectors = {r["vec_id"]: list(r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    rows = op10_embeddings(spark, sf).collect()
    check_vectors(rows, vectors)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in rows)


def test_recall_near_the_threshold(spark, monkeypatch):
    """Pairs at and just above 0.95, the hardest to find, in many small blocks."""
    monkeypatch.setattr(embeddings, "BLOCK", 64)
    rng = np.random.default_rng(4)
    base = embeddings.unit_vectors(rng.normal(size=(700, 24)))
    way = rng.normal(size=base.shape)
    way -= (way * base).sum(1, keepdims=True) * base
    way = embeddings.unit_vectors(way)
    c = 0.951
    x = np.concatenate([base, c * base + np.sqrt(1 - c**2) * way])
    vectors = {i: v.tolist() for i, v in enumerate(x)}
    rows = embeddings.near_duplicates(spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")).collect()
    links = plain_vectors(vectors)
    found = sum(r["n_links"] for r in rows) / 2
    assert len(links) >= 700 and 0.99 * len(links) <= found <= len(links)


def test_groups_of_vectors(spark, monkeypatch):
    """Copies, scaled copies and tight groups, in many blocks: every link and component is found."""
    monkeypatch.setattr(embeddings, "BLOCK", 32)
    rng = np.random.default_rng(6)
    base = rng.normal(size=(30, 32))
    x = [b + 0.1 * rng.normal(size=32) * (i % 3) for b in base for i in range(12)] + [base[0]] * 80 + [3 * base[1]] * 5
    vectors = {int(k): v.tolist() for k, v in zip(rng.permutation(len(x)), x)}
    rows = embeddings.near_duplicates(spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")).collect()
    assert len(check_vectors(rows, vectors)) > 3000


def test_op10_odd_rows(spark):
    vectors = {1: [1.0, 0.0], 2: [2.0, 0.0], 3: None, 4: [], 5: [0.0, 0.0], 6: [1.0, None], 7: [float("nan"), 1.0], 8: [float("inf"), 1.0], 9: [1.0, 0.1], 10: [0.0, 1.0], 11: [1e-200, 1e-200], 12: [1.0, 0.0]}
    df = spark.createDataFrame([(k, v, "u", 1) for k, v in vectors.items()], "vec_id long, embedding array<double>, unit string, rep int")
    rows = embeddings.near_duplicates(df).collect()
    assert len(rows) == 12
    check_vectors(rows, vectors)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0
    assert [r["component_id"] for r in embeddings.near_duplicates(df.where("vec_id IN (3, 5)")).orderBy("vec_id").collect()] == [3, 5]
    other = embeddings.near_duplicates(spark.createDataFrame([(None, [1.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<double>")).collect()
    assert len(other) == 4 and [r["component_id"] for r in other if r["vec_id"] is None] == [None]


def test_neighbours_in_a_small_subspace(spark):
    """Vectors of 64 dimensions that lie in four: neighbours at the threshold are found there too."""
    rng = np.random.default_rng(11)
    base = embeddings.unit_vectors(rng.normal(size=(1500, 4)))
    way = rng.normal(size=base.shape)
    way = embeddings.unit_vectors(way - (way * base).sum(1, keepdims=True) * base)
    x = np.concatenate([base, 0.952 * base + np.sqrt(1 - 0.952**2) * way]) @ np.linalg.qr(rng.normal(size=(64, 4)))[0].T
    vectors = {i: v.tolist() for i, v in enumerate(x)}
    rows = embeddings.near_duplicates(spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")).collect()
    links = plain_vectors(vectors)
    assert 0.995 * len(links) <= sum(r["n_links"] for r in rows) / 2 <= len(links)


def test_two_levels_of_lists(spark, monkeypatch):
    """More lists than first-level centroids: every list number stands for a sum of two, and neighbours are found."""
    monkeypatch.setattr(embeddings, "CENTROIDS", 6)
    rng = np.random.default_rng(12)
    x = embeddings.unit_vectors(rng.normal(size=(900, 16)))
    index = embeddings.Index.fit(x, 30)
    assert index.lists == 30
    at, _, _, visits = index.encode(x)
    all_centroids = index.centroids(np.arange(index.lists))
    d = embeddings.distances(x, all_centroids)
    assert (np.take_along_axis(d, at[:, None], 1)[:, 0] <= d.min(1) + 1e-9).all() and all(a not in v for v, a in zip(visits, at))
    vectors = {i: v.tolist() for i, v in enumerate(np.concatenate([x, x + 0.02 * rng.normal(size=x.shape)]))}
    rows = embeddings.near_duplicates(spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>")).collect()
    links = plain_vectors({i: np.array(v, np.float32).astype(float).tolist() for i, v in vectors.items()})
    assert len(links) >= 900 and 0.999 * len(links) <= sum(r["n_links"] for r in rows) / 2 <= len(links)


def test_repeated_vector_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (2, [5.0, 0.0])]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(1, 0, 1), (1, 2, 1), (2, 2, 1), (2, 2, 1)]


def test_vectors_of_several_lengths(spark, monkeypatch):
    """Near pairs and scaled copies of every length are found: two lengths with an index each, and rare ones without."""
    monkeypatch.setattr(embeddings, "LEAST", 100)
    monkeypatch.setattr(embeddings, "BLOCK", 32)
    rng = np.random.default_rng(9)
    x = []
    for dimension, n in ((24, 120), (16, 80), (9, 30), (2, 3)):
        base = rng.normal(size=(n, dimension))
        x += [*base, *(base * 2 + 0.05 * rng.normal(size=base.shape))]
    vectors = {int(k): v.tolist() for k, v in zip(rng.permutation(len(x)), x)}
    rows = embeddings.near_duplicates(spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")).collect()
    links = plain_vectors_by_length(vectors)
    degree = dict.fromkeys(vectors, 0)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    least = closure(links, vectors)
    assert {len(vectors[a]) for a, _ in links} == {24, 16, 9, 2}
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rows} == {i: (degree[i], least[i]) for i in vectors}


def plain_vectors_by_length(vectors):
    return set().union(*(plain_vectors({i: v for i, v in vectors.items() if len(v) == n}) for n in {len(v) for v in vectors.values()}))


@pytest.mark.parametrize("dimension", [3, 64])
def test_lookup_bounds_true_distance(dimension):
    rng = np.random.default_rng(0)
    x = embeddings.unit_vectors(rng.normal(size=(500, dimension)))
    index = embeddings.Index.fit(x, 8)
    at, codes, error, _ = index.encode(x)
    for k in range(8):
        mine = np.flatnonzero(at == k)
        d = index.lookup(x[:50], k, codes[mine])
        true = np.sqrt(embeddings.distances(x[:50], x[mine]))
        assert (np.abs(d - true) <= error[mine][None] + 1e-3).all()
