"""N-gram Jaccard join: a MinHash LSH forest, then exact verification.

1. Each text becomes its set of word five-grams (hashes). Texts with equal sets are one class.
2. Each class gets TREES labels of DEPTH MinHash values. All labels are sorted tree by tree, which is the prefix trie of
   each tree in its depth-first order: classes under one trie node stand next to each other.
3. A class's matched prefixes begin at full length and are shortened until the worst link that it can have meets it
   in some tree with the target chance. A set of n five-grams can't have every similarity (one of 7 has none between
   0.8 and 0.857), so short texts stop at longer prefixes; all others stop at the length that a link of similarity
   exactly 0.8 needs. No class stops earlier because others have close copies.
4. Classes connected by matched prefixes form components, and each is verified exactly: a small one at once, a large one
   in blocks of bounded size that are packed into one row each, so rows grow with the number of blocks. No list of
   pairs leaves a task, only each class's number of links and a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD_TABLE, Scratch, shuffle_partitions, slices, small, unused, written
from tidemark.llm.components import components

WORDS = 5
SIMILARITY = 0.8
TREES, DEPTH = 32, 8
#: Chance of every link, the worst included, to meet in a tree.
RECALL = 0.9999
#: Classes, and shingles on average, in a block of the verification.
BLOCK, BLOCK_SHINGLES = 128, 1_000_000
#: Shingles in a block's local vocabulary that are multiplied at once.
COLUMNS = 4096

_random = np.random.default_rng(20240)
_LETTERS = _random.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(int(_random.integers(2**62, 2**63)) | 5)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_MULTIPLY = _random.integers(1, 2**63, TREES * DEPTH, dtype=np.uint64) | np.uint64(1)
_ADD = _random.integers(1, 2**63, TREES * DEPTH, dtype=np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 1 << 16)
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word n-grams; of all words if there are fewer; none without words.

    One polynomial hash over the normalised bytes gives every n-gram as a difference of two prefix sums.
    """
    parts = text.encode("utf-8", "replace").translate(WORD_TABLE).split() if text else []
    if not parts:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    power, inverse = _power(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTERS[data] * power)])
    ends = np.flatnonzero(data == 32)
    begins = np.concatenate([[0], ends[:-1] + 1])
    k = max(1, len(parts) - words + 1)
    first, last = begins[:k], ends[min(words, len(parts)) - 1 :]
    h = (sums[last] - sums[first]) * inverse[first]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return np.unique(h)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """TREES * DEPTH MinHash values of each set, a row each; sets must not be empty."""
    out = np.empty((len(sets), TREES * DEPTH), np.uint32)
    i = 0
    while i < len(sets):
        j, n = i, 0
        while j < len(sets) and (j == i or n < 16_384):
            n += len(sets[j])
            j += 1
        lengths = [len(s) for s in sets[i:j]]
        values = np.concatenate(sets[i:j])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        for m in range(TREES * DEPTH):
            out[i:j, m] = np.minimum.reduceat((values * _MULTIPLY[m] + _ADD[m]) >> np.uint64(32), starts)
        i = j
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, a text, as digest, size and signature of its set."""
    for batch in slices(batches, -1):
        sets = [shingles(t) for t in batch.column(-1).to_pylist()]
        full = [i for i, s in enumerate(sets) if len(s)]
        made = signatures([sets[i] for i in full])
        sigs: list[bytes | None] = [None] * len(sets)
        for row, i in zip(made, full):
            sigs[i] = row.tobytes()
        digest = [digest_of(s) if len(s) else None for s in sets]
        yield pa.record_batch(
            [*batch.columns[:-1], pa.array(digest, pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array(sigs, pa.binary())],
            names=[*batch.schema.names[:-1], "digest", "size", "sig"],
        )


def digest_of(shingle_set: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingle_set.tobytes())


def met(similarity: np.ndarray, depth: int) -> np.ndarray:
    """The chance that two sets of this similarity share a prefix of this depth in some tree."""
    return 1 - (1 - similarity**depth) ** TREES


def least_similarity(size: int) -> float:
    """The least similarity from SIMILARITY on that a set of this size can have with a set of any size."""
    found = 1.0
    for other in range(int(np.ceil(size * SIMILARITY)), int(size / SIMILARITY) + 1):
        common = int(np.ceil(SIMILARITY * (size + other) / (1 + SIMILARITY) - 1e-9))
        if common <= min(size, other):
            found = min(found, common / (size + other - common))
    return found


def depth_for(recall: float, similarity: float = SIMILARITY) -> int:
    """The longest prefix at which a link of this similarity meets with this chance. It depends on no other link, so that
    groups of close copies don't decide for isolated ones."""
    return next((d for d in range(DEPTH, 1, -1) if float(met(np.array(similarity), d)) >= recall), 1)


#: Sizes whose least similarity is worked out; sets of more shingles get the depth of SIMILARITY.
SMALL = 64


def depths(recall: float) -> np.ndarray:
    """The prefix length of sets by size, up to SMALL."""
    return np.array([depth_for(recall, least_similarity(max(1, min(n, SMALL)))) if n < SMALL else depth_for(recall) for n in range(SMALL + 1)])


class _Level:
    """At the trie nodes of one depth: a star from a node's first class to those whose prefixes stop there."""

    def __init__(self, depth: int):
        self.depth, self.width = depth, 1 + 4 * depth
        self.head: bytes | None = None  # the first node, and its first class
        self.first: int | None = None
        self.last: np.ndarray | None = None  # the key of the last row, and the first class of its node
        self.anchor: tuple[int, int] | None = None

    def edges(self, keys: np.ndarray, nodes: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """keys: the next labels in sorted order, each with its tree before it; own: the depth at which a class stops."""
        if self.anchor:  # the first class of the node that the rows before ended in stands for all of it
            keys = np.concatenate([self.last[None], keys])
            nodes, own = np.append(self.anchor[0], nodes), np.append(self.anchor[1], own)
        prefix = keys[:, : self.width]
        segment = np.concatenate([[0], np.cumsum((prefix[1:] != prefix[:-1]).any(1))])
        mine = np.flatnonzero(own <= self.depth)
        center = np.full(segment[-1] + 1, -1, np.int64)
        center_own = center.copy()
        at, which = np.unique(segment[mine], return_index=True)
        center[at], center_own[at] = nodes[mine[which]], own[mine[which]]
        to = center[segment[mine]]
        linked = (to != nodes[mine]) & ((own[mine] == self.depth) | (center_own[segment[mine]] == self.depth))
        if self.head is None:
            self.head = prefix[0].tobytes()
        if self.first is None and center[0] >= 0 and prefix[0].tobytes() == self.head:
            self.first = int(center[0])
        self.last, self.anchor = keys[-1].copy(), (int(center[-1]), int(center_own[-1])) if center[-1] >= 0 else None
        return nodes[mine[linked]], to[linked]

    def borders(self) -> list[tuple[int, bytes, int]]:
        """The nodes that a partition begins and ends in, which may go on in its neighbours."""
        out = [(self.depth, self.head, self.first)] if self.first is not None else []
        return out + ([(self.depth, self.last[: self.width].tobytes(), self.anchor[0])] if self.anchor else [])


def _tries(stop: np.ndarray):
    """Edges of sorted (key, node, size) rows, then the borders of the partition; stop: depths by size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = [_Level(int(d)) for d in np.unique(stop)]
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(0)
            ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
            keys = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(len(column), -1)
            nodes = batch.column(1).to_numpy()
            own = stop[np.minimum(batch.column(2).to_numpy(), len(stop) - 1)]
            for level in levels:
                a, b = level.edges(keys, nodes, own)
                yield _edges(a, b, np.zeros(len(a), np.int32), [None] * len(a))
        found = [x for level in levels for x in level.borders()]
        yield _edges([x[2] for x in found], [None] * len(found), [x[0] for x in found], [x[1] for x in found])

    return run


def _edges(a, b, depth, prefix) -> pa.RecordBatch:
    columns = [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(depth, pa.int32()), pa.array(prefix, pa.binary())]
    return pa.record_batch(columns, names=["a", "b", "depth", "prefix"])


def forest_edges(classes: DataFrame, scratch: Scratch, recall: float = RECALL) -> DataFrame:
    """a, b: classes (node, size, sig) joined where their prefixes match in some tree, as stars.

    One range shuffle sorts all labels, with the class as last key, so a node under which many classes stand is cut
    over partitions; the stars at cut places are joined by a table of two nodes a partition and depth.
    """
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    key = F.concat(F.expr("substring(trees, tree + 1, 1)"), F.expr(f"substring(sig, tree * {4 * DEPTH} + 1, {4 * DEPTH})"))
    # Of fewer shingles than this, only equal sets have the similarity.
    labelled = classes.where(F.col("size") >= int(np.ceil(SIMILARITY / (1 - SIMILARITY) - 1e-9)))
    labels = labelled.select("node", "size", "sig", F.lit(bytes(range(TREES))).alias("trees"), tree).select(key.alias("key"), "node", "size")
    dealt = labels.repartitionByRange(shuffle_partitions(classes.sparkSession), "key", "node").sortWithinPartitions("key", "node")
    found = scratch.written(dealt.mapInArrow(_tries(depths(recall)), "a long, b long, depth int, prefix binary"), "tries")
    cut = found.where("prefix IS NOT NULL").select("depth", "prefix", "a")
    least = cut.groupBy("depth", "prefix").agg(F.min("a").alias("b"))
    across = cut.join(least, ["depth", "prefix"]).where("a <> b").select("a", "b")
    return found.where("prefix IS NULL").select("a", "b").unionByName(across).distinct()


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices over the shingles that occur on both sides."""
    a, b = np.concatenate(left), np.concatenate(right)
    both = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)))
    rows = [np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in (left, right)]
    places = [np.searchsorted(both, v) for v in (a, b)]
    keep = [(p < len(both)) & (both[np.minimum(p, len(both) - 1)] == v) if len(both) else np.zeros(len(v), bool) for p, v in zip(places, (a, b))]
    for start in range(0, len(both), COLUMNS):
        parts = []
        for s, p, r, k in zip((left, right), places, rows, keep):
            m = k & (p >= start) & (p < start + COLUMNS)
            dense = np.zeros((len(s), min(COLUMNS, len(both) - start)), np.float32)
            dense[r[m], p[m] - start] = 1
            parts.append(dense)
        out += parts[0] @ parts[1].T
    return out


@dataclass
class Block:
    """Some classes of a component: their nodes, numbers of rows, sets, and the least node of each one's local group."""

    nodes: np.ndarray
    copies: np.ndarray
    sets: list[np.ndarray]
    roots: np.ndarray

    @staticmethod
    def of(members: list[tuple[int, int, np.ndarray]]) -> Block:
        nodes = np.array([x[0] for x in members], np.int64)
        return Block(nodes, np.array([x[1] for x in members], np.int64), [x[2] for x in members], nodes.copy())

    def linked(self, other: Block) -> np.ndarray:
        """Which of these have the similarity with which of the others."""
        inner = _overlaps(self.sets, other.sets)
        sizes, theirs = (np.array([len(s) for s in b.sets], np.float64) for b in (self, other))
        return inner >= SIMILARITY * (sizes[:, None] + theirs[None] - inner) - 1e-9

    def verify(self) -> np.ndarray:
        """Of each class the number of linked rows inside the block; the roots follow the links."""
        linked = self.linked(self)
        np.fill_diagonal(linked, False)
        far = np.iinfo(np.int64).max
        while True:
            least = np.minimum(self.roots, np.where(linked, self.roots[None], far).min(1, initial=far))
            if (least == self.roots).all():
                return linked @ self.copies
            self.roots = least

    def packed(self) -> bytes:
        """The block in one value: its vocabulary, and each set as steps through it. Near copies have the same steps, which
        compress well."""
        vocabulary, places = np.unique(np.concatenate(self.sets), return_inverse=True)
        lengths = np.array([len(x) for x in self.sets], np.int64)
        steps = np.diff(places, prepend=0).astype(np.int32)
        starts = np.cumsum(lengths) - lengths
        steps[starts] = places[starts]
        head = np.stack([self.nodes, self.copies, self.roots, lengths])
        data = np.array([len(self.sets), len(vocabulary)], np.int64).tobytes() + head.tobytes() + vocabulary.tobytes() + steps.tobytes()
        return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)

    @staticmethod
    def unpacked(value: bytes) -> Block:
        data = pa.decompress(value[8:], int.from_bytes(value[:8], "little"), codec="zstd", asbytes=True)
        n, words = np.frombuffer(data, np.int64, 2)
        nodes, copies, roots, lengths = np.frombuffer(data, np.int64, 4 * n, 16).reshape(4, n)
        vocabulary = np.frombuffer(data, np.uint64, words, 16 + 32 * n)
        steps = np.frombuffer(data, np.int32, -1, 16 + 32 * n + 8 * words)
        return Block(nodes, copies, [vocabulary[np.cumsum(s)] for s in np.split(steps, np.cumsum(lengths)[:-1])], roots)


def between(home: Block, guest: Block) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Of two blocks' classes the numbers of rows linked across, and edges that join the local groups which links join."""
    linked = home.linked(guest)
    i, j = np.nonzero(linked)
    parent: dict[int, int] = {}

    def find(n: int) -> int:
        while parent.setdefault(n, n) != n:
            n = parent[n]
        return n

    edges = []
    for p, q in np.unique(np.stack([home.roots[i], guest.roots[j]], 1), axis=0).tolist():
        p, q = find(p), find(q)
        if p != q:
            parent[max(p, q)] = min(p, q)
            edges.append((p, q))
    return linked @ guest.copies, linked.T @ home.copies, edges


#: Length bands: sets of similarity 0.8 or more lie in one band or in neighbouring ones.
BAND = "cast(floor(ln(size) / ln(1 / 0.8) + 1e-9) as int)"


def verify(members: DataFrame, texts: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Exact links among the classes of each component: node, links, and edges a, b that connect what links connect. links
    counts rows, so a class of n copies counts n times; a class may have several rows, which add up.

    members: node, component, copies, size, key, digest; texts: key, text, from which a class takes any row of its key
    whose set has its digest. A component of at most BLOCK classes and BLOCK_SHINGLES is one block. A larger one is
    dealt to length bands and hashed blocks of about that size; each block is verified by itself where it is gathered,
    and goes, packed into one row, to each other block of its band and the next. What two blocks find is a row of counts for
    each of them, added up by block, and an edge for each two local groups that meet.
    """
    size = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    whole = members.groupBy("component").agg(F.count("*").alias("n"), F.sum("size").alias("shingles")).select("component", size)
    large = scratch.written(whole.where("blocks > 1").select("component", F.lit(True).alias("large")), "large")
    banded = members.join(small(large, large.count()), "component", "left").withColumn("band", F.expr(f"if(large, {BAND}, 0)"))
    here = banded.where("large").groupBy("component", "band").agg(F.count("*").alias("n"), F.sum("size").alias("shingles")).select("component", "band", size)
    here = scratch.written(here, "bands")
    above = here.select("component", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above"))
    below = here.select("component", (F.col("band") + 1).alias("band"), F.col("blocks").alias("below"))
    dealt = here.join(above, ["component", "band"], "left").join(below, ["component", "band"], "left")
    dealt = scratch.written(dealt, "blocks")
    placed = banded.join(small(dealt, dealt.count()), ["component", "band"], "left").fillna({"blocks": 1, "above": 0, "below": 0})
    placed = placed.withColumn("block", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
    places = ["component", "band", "block", "blocks", "above", "below"]

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies of a text give its class one row a task
        for batch in slices(batches, 0):
            rows, sets = [], []
            for i, (text, digest, node) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
                if node not in seen:
                    found = shingles(text)
                    if digest_of(found) == digest:
                        seen.add(node)
                        rows.append(i)
                        sets.append(found.tobytes())
            yield pa.record_batch([*batch.take(pa.array(rows, pa.int64())).columns[2:], pa.array(sets, pa.binary())], names=[*batch.schema.names[2:], "shingles"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        members: dict[int, tuple] = {}
        key: tuple | None = None

        def finish() -> None:
            if not members:
                return
            block = Block.of(list(members.values()))
            links = block.verify()
            out.extend((None,) * 7 + x for x in zip(block.nodes.tolist(), links.tolist(), block.roots.tolist()) if x[1])
            if key[3] > 1 or key[4] or key[5]:
                out.append((*key, block.packed(), None, None, None))

        for batch in batches:
            for *at, node, copies, data in zip(*(c.to_pylist() for c in batch.columns)):
                if tuple(at) != key:
                    finish()
                    key, members = tuple(at), {}
                members[node] = node, copies, np.frombuffer(data, np.uint64)
                if len(out) >= 1000:
                    yield _rows(out, BLOCKS)
                    out = []
        finish()
        yield _rows(out, BLOCKS)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit: tuple | None = None
        other: bytes = b""
        for batch in batches:
            out: list[tuple] = []
            for *key, bundle in zip(*(c.to_pylist() for c in batch.columns)):
                if tuple(key) == unit:
                    home, guest = Block.unpacked(other), Block.unpacked(bundle)
                    *counts, edges = between(home, guest)
                    if edges:
                        out.extend((int(x.nodes[0]), x.nodes.tobytes(), n.astype(np.int64).tobytes(), None, None) for x, n in zip((home, guest), counts))
                        out.extend((None, None, None, a, b) for a, b in edges)
                unit, other = tuple(key), bundle
            yield _rows(out, COUNTS)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: int | None = None
        nodes = total = np.zeros(0, np.int64)
        for batch in batches:
            out: list[tuple] = []
            for first, names, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if first != block:
                    out.extend(zip(nodes.tolist(), total.tolist()))
                    block, nodes, total = first, np.frombuffer(names, np.int64), np.zeros(len(names) // 8, np.int64)
                total = total + np.frombuffer(counts, np.int64)
            yield _rows(out, LINKS)
        yield _rows(list(zip(nodes.tolist(), total.tolist())), LINKS)

    texts = texts.join(placed.select("key", "digest", *places, "node", "copies"), "key").select("text", "digest", F.col("node").alias("own"), *places, "node", "copies")
    sets = texts.mapInArrow(shingled, "own long, component long, band int, block int, blocks int, above int, below int, node long, copies long, shingles binary").drop("own")
    gathered = sets.repartition("component", "band", "block").sortWithinPartitions("component", "band", "block")
    first = scratch.written(gathered.mapInArrow(blocks, _ddl(BLOCKS)), "first")
    # Pairs of blocks i, j of one band (up = 0), or i of the band and j of the next one (up = 1).
    units = F.expr(
        """concat(
        transform(filter(sequence(0, blocks - 1), j -> j <> block), j -> struct(band, least(block, j) as i, greatest(block, j) as j, 0 as up)),
        transform(filter(sequence(0, above), j -> j < above), j -> struct(band, block as i, j as j, 1 as up)),
        transform(filter(sequence(0, below), i -> i < below), i -> struct(band - 1 as band, i as i, block as j, 1 as up)))"""
    )
    packed = first.where("bundle IS NOT NULL").select("component", "bundle", F.explode(units).alias("u")).select("component", "u.*", "bundle")
    unit = ["component", "band", "i", "j", "up"]
    across = packed.select(*unit, "bundle").repartition(*unit).sortWithinPartitions(*unit).mapInArrow(pairs, _ddl(COUNTS))
    across = scratch.written(across, "across")
    own = first.where("node IS NOT NULL")
    # A block goes by its first node.
    sums = across.where("first IS NOT NULL").select("first", "nodes", "counts").repartition("first").sortWithinPartitions("first").mapInArrow(added, _ddl(LINKS))
    links = own.select("node", "links").unionByName(sums.where("links > 0"))
    edges = own.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(across.where("first IS NULL").select("a", "b"))
    return links, edges


LINKS = {"node": pa.int64(), "links": pa.int64()}
COUNTS = {"first": pa.int64(), "nodes": pa.binary(), "counts": pa.binary(), "a": pa.int64(), "b": pa.int64()}
BLOCKS = {"component": pa.int64(), "band": pa.int32(), "block": pa.int32(), "blocks": pa.int32(), "above": pa.int32(), "below": pa.int32(), "bundle": pa.binary(), **LINKS, "root": pa.int64()}


def _ddl(kinds: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{c} {'binary' if pa.types.is_binary(k) else 'int' if k == pa.int32() else 'long'}" for c, k in kinds.items())


def _rows(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * len(kinds), kinds.values())], names=list(kinds))


def _signed(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Of each row: doc_id, two hashes of its text, and the digest, size and signature of its set; and the texts by the
    first of the hashes."""
    text = F.col(text_col)
    keys = F.xxhash64(text).alias("key"), F.xxhash64(F.lit(7), text).alias("key2")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *keys, text.alias("text"))
    signed = scratch.written(rows.mapInArrow(_sign, "doc_id long, key long, key2 long, digest binary, size int, sig binary"), "signed")
    return signed, rows.select("key", "text")


def _linked(signed: DataFrame, texts: DataFrame, least: Column, recall: float, scratch: Scratch) -> DataFrame:
    """digest, copies, least, component, links of each class of these rows: the least value of its rows, and, null without
    links, its component and its number of linked rows outside it. A written table."""
    of = signed.groupBy("digest").agg(
        F.count("*").alias("copies"), F.min(least).alias("least"), F.min("key").alias("key"), F.first("size").alias("size"), F.first("sig").alias("sig")
    )
    classes = scratch.written(of.withColumn("node", F.monotonically_increasing_id()), "classes")
    edges = scratch.written(forest_edges(classes.select("node", "size", "sig"), scratch, recall), "edges")
    found = components(edges, scratch)
    members = scratch.written(classes.drop("sig", "least").join(found, "node"), "members")
    links, joins = verify(members, texts, scratch)
    groups = components(joins, scratch)
    totals = links.groupBy("node").agg(F.sum("links").alias("links")).join(groups, "node", "left")
    return scratch.written(classes.select("node", "digest", "copies", "least").join(totals, "node", "left").drop("node"), "linked")


def near_duplicates(docs: DataFrame, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, n_links of each row: class_id is the least doc_id that the document reaches over links,
    itself included; n_links is its number of other rows whose five-word shingles have similarity 0.8 or more.

    Words are runs of ASCII digits, letters (case folded) and non-ASCII characters; a text of fewer than five is
    one shingle. Texts without words, nulls included, link with nothing. Rows without an id get a null class and
    no links, and nobody links with them. A doc_id on several rows is as many documents: each row has the links of its
    own text, and each class the least of its rows' ids. Columns other than the two named are ignored; an empty table
    gives no rows. The result is a written table.

    Cost: one scan for signatures, which cross one shuffle to their classes and, as 32 labels, one to the tries; one scan
    and shuffle of texts to verify. Copies of one text combine before the first shuffle; the joins by key and
    digest leave hot keys to Spark's skew handling. Work inside a component of n different texts is quadratic in n, as
    every link is counted; rows are a block's, n / BLOCK, times the blocks that it meets.
    """
    with Scratch(docs.sparkSession) as scratch:
        signed, texts = _signed(docs, scratch, id_col, text_col)
        found = _linked(signed.where("doc_id IS NOT NULL AND digest IS NOT NULL"), texts, F.col("doc_id"), recall, scratch)
        of = scratch.written(found.where("component IS NOT NULL").groupBy("component").agg(F.min("least").alias("class_id")), "of")
        table = found.join(small(of, of.count()), "component", "left").select(
            "digest", F.coalesce("class_id", "least").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
        )
        table = scratch.written(table, "table")
        keys = signed.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
        return written(
            keys.join(table, "digest", "left").select(
                "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
            ),
            "near_duplicates",
        )


def one_of_each(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """The rows of docs, with all their columns, that near duplicates leave: of each group that links join, one row, that of
    the least doc_id, a row without one being last; of rows alike in id and text, any one.

    Here rows without an id and rows that share one count as documents of their own. Texts without words, nulls
    included, link with nothing and all stay. An empty table gives no rows; columns other than doc_id and text may have any name.

    Cost: that of near_duplicates, and a join of docs with the rows that go, which is a broadcast if those are few.
    """
    with Scratch(docs.sparkSession) as scratch:
        signed, texts = _signed(docs, scratch, "doc_id", "text")
        named = signed.where("digest IS NOT NULL")
        own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "key2")
        found = _linked(named, texts, own, recall, scratch)
        of = scratch.written(found.where("component IS NOT NULL").groupBy("component").agg(F.min("least").alias("stays")), "of")
        stays = found.join(small(of, of.count()), "component", "left").select("digest", F.coalesce("stays", "least").alias("stays"))
        rows = named.groupBy("digest", "doc_id", "key", "key2").agg(F.count("*").alias("rows")).join(stays, "digest")
        goes = (own != F.col("stays")).alias("goes")
        marked = rows.select("doc_id", "key", "key2", goes, "rows").where("goes OR rows > 1")
        marked = written(marked, "marked")  # read by the result
    a, b, c = (unused(n, docs.columns) for n in ("_id", "_key", "_key2"))
    keyed = docs.withColumns({b: F.xxhash64("text"), c: F.xxhash64(F.lit(7), F.col("text"))})

    def of_rows(which: str) -> tuple[DataFrame, Column]:
        part = marked.where(which)
        at = small(part.select(F.col("doc_id").alias(a), F.col("key").alias(f"{b}r"), F.col("key2").alias(f"{c}r")), part.count())
        return at, F.col("doc_id").cast("long").eqNullSafe(at[a]) & (keyed[b] == at[f"{b}r"]) & (keyed[c] == at[f"{c}r"])

    once = keyed.join(*of_rows("true"), "left_anti")
    several = keyed.join(*of_rows("NOT goes"), "left_semi").dropDuplicates(["doc_id", b, c])
    return once.unionByName(several).select(*docs.columns)
