import random
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.queries import op1_sharding
from tidemark.llm.sharding import CapacityTree, balanced, best_fit_decreasing, shard, size_class


def plain_best_fit(sizes, capacity):
    """One item at a time over a plain list."""
    bins = []
    for size in sizes:
        fits = [i for i, left in enumerate(bins) if left >= size]
        if fits:
            i = min(fits, key=lambda i: (bins[i], i))
        else:
            bins.append(max(capacity, size))
            i = len(bins) - 1
        bins[i] -= size
    return sorted(bins)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60), st.integers(20, 60))
def test_runs_pack_as_single_items_do(items, capacity):
    items = sorted(items, reverse=True)
    runs, bins = best_fit_decreasing(sorted(Counter(items).items(), reverse=True), capacity)
    left = [None] * bins
    for size, n, b in runs:
        left[b] = (max(capacity, size) if left[b] is None else left[b]) - size * n
    assert sorted(left) == plain_best_fit(items, capacity)


def test_tree_stays_balanced():
    tree, keys, rng = CapacityTree(), [], random.Random(1)
    for i in range(3000):
        if keys and rng.random() < 0.4:
            k = keys.pop(rng.randrange(len(keys)))
            tree.remove(k)
        else:
            k = (rng.randrange(500), i)
            keys.append(k)
            tree.add(k)
        size = rng.randrange(500)
        assert tree.tightest(size) == min((k for k in keys if k[0] >= size), default=None)
    assert tree.root.height <= 1.45 * len(keys).bit_length() + 2
    with pytest.raises(KeyError):
        tree.remove((10**6, 0))


def test_balanced_with_a_giant():
    runs = balanced([(1000, 1), (7, 50), (3, 100)], 4)
    fill = defaultdict(int)
    for size, n, b in runs:
        fill[b] += size * n
    rest = sorted(fill.values())[:-1]
    assert max(fill.values()) == 1000 and len(fill) == 4 and max(rest) - min(rest) <= 7


def check(rows, texts):
    place = {}
    slots = defaultdict(list)
    for r in rows:
        text = texts[r["doc_id"]] or ""
        data = text.encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 8, zlib.crc32(data))
        assert place.setdefault(text, r["shard"]) == r["shard"]
        slots[r["shard"]].append(r["slot"])
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))


def test_query(spark, sf, texts):
    rows = op1_sharding(spark, sf).collect()
    check(rows, texts)
    fill = Counter()
    for r in rows:
        fill[r["shard"]] += r["size"]
    assert sorted(r["doc_id"] for r in rows) == sorted(texts) and set(fill) == set(range(24))
    group = Counter()
    for t in texts.values():
        group[t] += len((t or "").encode()) + 8
    mean = sum(fill.values()) / 24
    assert max(fill.values()) <= max(mean * 1.02, max(group.values()))


def test_capacity(spark, docs, texts):
    rows = shard(docs, shards=None, capacity=40_000).collect()
    check(rows, texts)
    fill, groups = Counter(), defaultdict(set)
    for r in rows:
        fill[r["shard"]] += r["size"]
        groups[r["shard"]].add(r["text_crc32"])
    assert all(n <= 40_000 or len(groups[s]) == 1 for s, n in fill.items())
    assert len(fill) <= -(-sum(fill.values()) // 40_000) + len([1 for s in fill if fill[s] > 40_000]) + 2
    with pytest.raises(ValueError):
        shard(docs, shards=2, capacity=5)


def test_odd_rows(odd, empty):
    rows = shard(odd, shards=3).collect()
    assert len(rows) == 11 and len({(r["shard"], r["slot"]) for r in rows}) == 11
    assert shard(empty).count() == 0


def test_large_sizes_round_up(spark):
    """Groups of 32 kB and more share classes of 14 leading bits, never smaller than the group; a capacity holds."""
    sizes = [8, 32_767, 32_768, 32_769, 65_535, 65_536, 65_541, 10**6 + 1, 2**40 + 12345]
    rows = spark.createDataFrame([(s,) for s in sizes], "bytes long").select("bytes", size_class("bytes").alias("class")).collect()
    assert all(r["bytes"] <= r["class"] <= r["bytes"] * (1 + 2**-13) and (r["bytes"] >= 32_768 or r["class"] == r["bytes"]) for r in rows)
    assert len({r["class"] for r in rows if r["bytes"] in (65_536, 65_541)}) == 2 and {r["class"] % 4 for r in rows if 65_536 <= r["bytes"] < 131_072} == {0}
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, "x" * rng.randrange(30_000, 200_000) + str(i)) for i in range(60)], "doc_id long, text string")
    fill = Counter()
    for r in shard(docs, shards=None, capacity=600_000).collect():
        fill[r["shard"]] += r["size"]
    assert len(fill) >= 10 and max(fill.values()) <= 600_000 and sum(v > 300_000 for v in fill.values()) >= len(fill) - 1
    assert set(fill) == set(range(len(fill)))
