"""Sharding: best-fit-decreasing bin packing of indivisible groups.

Groups (equal texts) are sorted by size, and each enters the bin with the tightest remaining capacity that
still holds it, found in a balanced tree. The packing works on a histogram of sizes instead of on groups:
groups of one size are interchangeable, and best fit puts equal sizes into one bin until it is full, so one
tree search places a run of groups. The histogram is bounded at any corpus size (see `size_class`); which
group takes which place of a run is settled by a distributed rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, ranked, small, written

#: Sizes below 2**(MANTISSA + 1) are exact classes; above, a class is a size rounded up to MANTISSA leading bits.
MANTISSA = 14


class _Node:
    __slots__ = ("key", "left", "right", "height")

    def __init__(self, key: tuple[int, int]):
        self.key, self.left, self.right, self.height = key, None, None, 1


class CapacityTree:
    """An AVL tree of (remaining capacity, bin)."""

    def __init__(self) -> None:
        self.root: _Node | None = None

    def add(self, key: tuple[int, int]) -> None:
        self.root = self._add(self.root, key)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """The least key with at least this much capacity left."""
        node, best = self.root, None
        while node:
            if node.key[0] >= size:
                node, best = node.left, node.key
            else:
                node = node.right
        return best

    def remove(self, key: tuple[int, int]) -> None:
        self.root = self._remove(self.root, key)

    @staticmethod
    def _h(node: _Node | None) -> int:
        return node.height if node else 0

    def _turn(self, node: _Node, left: bool) -> _Node:
        if left:
            top = node.right
            node.right, top.left = top.left, node
        else:
            top = node.left
            node.left, top.right = top.right, node
        for x in (node, top):
            x.height = 1 + max(self._h(x.left), self._h(x.right))
        return top

    def _even(self, node: _Node) -> _Node:
        node.height = 1 + max(self._h(node.left), self._h(node.right))
        lean = self._h(node.left) - self._h(node.right)
        if lean > 1:
            if self._h(node.left.left) < self._h(node.left.right):
                node.left = self._turn(node.left, True)
            return self._turn(node, False)
        if lean < -1:
            if self._h(node.right.right) < self._h(node.right.left):
                node.right = self._turn(node.right, False)
            return self._turn(node, True)
        return node

    def _add(self, node: _Node | None, key: tuple[int, int]) -> _Node:
        if node is None:
            return _Node(key)
        if key < node.key:
            node.left = self._add(node.left, key)
        else:
            node.right = self._add(node.right, key)
        return self._even(node)

    def _remove(self, node: _Node | None, key: tuple[int, int]) -> _Node | None:
        if node is None:
            raise KeyError(key)
        if key < node.key:
            node.left = self._remove(node.left, key)
        elif key > node.key:
            node.right = self._remove(node.right, key)
        elif node.left is None or node.right is None:
            return node.left or node.right
        else:
            least = node.right
            while least.left:
                least = least.left
            node.key = least.key
            node.right = self._remove(node.right, least.key)
        return self._even(node)


def best_fit_decreasing(
    sizes: list[tuple[int, int]], capacity: int, most_bins: int | None = None
) -> tuple[list[tuple[int, int, int]], int] | None:
    """Pack (size, count) classes, sorted by size from the largest, into bins of a fixed capacity.

    Returns runs (size, count, bin) in packing order and the number of bins; None if that number would pass
    most_bins. A group larger than the capacity gets a bin of its own.
    """
    tree, bins, runs = CapacityTree(), 0, []
    for size, count in sizes:
        while count:
            fit = tree.tightest(size)
            if fit is None:
                if bins == most_bins:
                    return None
                left, place = max(capacity, size), bins
                bins += 1
            else:
                left, place = fit
                tree.remove(fit)
            n = min(count, left // size) if size else count
            runs.append((size, n, place))
            count -= n
            tree.add((left - n * size, place))
    return runs, bins


def balanced(sizes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int]]:
    """Runs (size, count, bin) over a fixed number of bins of nearly equal size.

    A group as large as an equal share of what is left keeps a bin for itself. The rest goes to the other
    bins by best fit decreasing under the least capacity that needs no further bin, found by bisection.
    """
    sizes = [list(x) for x in sizes]
    total = sum(s * n for s, n in sizes)
    runs, used = [], 0
    while sizes and shards - used > 1 and sizes[0][0] * (shards - used) >= total:
        size = sizes[0][0]
        runs.append((size, 1, used))
        used, total = used + 1, total - size
        sizes[0][1] -= 1
        if not sizes[0][1]:
            sizes.pop(0)
    rest = [tuple(x) for x in sizes]
    if not rest:
        return runs
    bins = shards - used
    low = max(-(-total // bins), rest[0][0])
    step, found = 0, None
    while found is None:  # gallop up from the mean, then bisect
        high = low + step
        found = best_fit_decreasing(rest, high, bins)
        step = step * 2 if step else max(1, low // 100_000)
    floor = low + (step // 4 if step > 2 else 0)
    while high - floor > max(1, low // 1_000_000):
        middle = (floor + high) // 2
        tried = best_fit_decreasing(rest, middle, bins)
        if tried:
            high, found = middle, tried
        else:
            floor = middle
    return runs + [(s, n, b + used) for s, n, b in found[0]]


def size_class(name: str) -> Column:
    """The size in this column, rounded up to MANTISSA leading bits: at most 2**MANTISSA classes for each doubling."""
    unit = F.expr(f"shiftleft(1L, greatest(0, length(bin(`{name}`)) - {MANTISSA + 1}))")
    return F.expr(f"cast(`{name}` as long)") + F.pmod(-F.col(name), unit)


def document_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of each row: its id, size (UTF-8 bytes + 8), CRC-32 and SHA-256 of the text; null counts as no bytes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
    )


def shard(
    docs: DataFrame,
    shards: int | None = 24,
    capacity: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Every row of docs with its shard and its slot there: doc_id, size, text_crc32, shard int, slot long.

    Give `shards` for that many shards of nearly equal bytes, or `capacity` for as few shards of at most so
    many bytes as best fit decreasing finds. Rows of equal texts stay together; null texts count as empty
    ones and stay with those. A group larger than a share, or than the capacity, has a shard of its own.
    Ties break by text digest, then doc_id. Repeated rows each get a slot; an empty table gives no rows; null
    ids are kept; columns other than the two named are ignored.

    Cost: one scan of the texts; then digests only: one aggregation, two range shuffles, and a join on the
    digest, whose hot keys are left to Spark's skew handling: rows there are some 60 bytes. The result is a written table.
    """
    if (shards is None) == (capacity is None):
        raise ValueError("give shards or capacity")
    with Scratch(docs.sparkSession) as scratch:
        return written(_placed(scratch.written(document_keys(docs, id_col, text_col), "keys"), shards, capacity, scratch), "shards")


def _placed(keys: DataFrame, shards: int | None, capacity: int | None, scratch: Scratch) -> DataFrame:
    spark = keys.sparkSession
    groups = keys.groupBy("digest").agg(F.sum("size").alias("bytes"))
    groups = ranked(groups.withColumn("class", size_class("bytes")), [F.desc("class"), F.asc("digest")], scratch)
    groups = scratch.written(groups.select("digest", "class", "rank"), "groups")
    sizes = sorted(((r["class"], r["count"]) for r in groups.groupBy("class").count().collect()), reverse=True)
    runs = balanced(sizes, shards) if shards else best_fit_decreasing(sizes, capacity)[0]
    runs = sorted(runs, key=lambda r: -r[0])  # stable: the order of ranks, which is by class from the largest
    starts = np.concatenate([[0], np.cumsum([n for _, n, _ in runs])])[:-1].astype(np.int64) if runs else np.zeros(0, np.int64)
    plan = spark.sparkContext.broadcast((starts, np.array([b for _, _, b in runs], np.int32)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, bins = plan.value
        for b in batches:
            at = np.searchsorted(first, b.column("rank").to_numpy(), side="right") - 1
            yield pa.record_batch([b.column("digest"), pa.array(bins[at])], names=["digest", "shard"])

    placed = groups.select("digest", "rank").mapInArrow(place, "digest binary, shard int")
    rows = ranked(keys.join(placed, "digest"), [F.asc("shard"), F.asc("digest"), F.asc("doc_id")], scratch)
    counts = sorted((r["shard"], r["count"]) for r in rows.groupBy("shard").count().collect())
    base, total = [], 0
    for s, n in counts:
        base.append((s, total))
        total += n
    base_df = spark.createDataFrame(base, "shard int, _base long")
    return rows.join(small(base_df, len(base)), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.col("_base")).alias("slot")
    )
