"""Embedding near-dedup: product quantisation with coarse inverted lists, and an exact cosine rerank.

Equal vectors are one class. Each class's unit vector is stored in the inverted list of its nearest coarse centroid, with
the codes of its residual in subspaces and the residual's exact reconstruction error. Where there are more lists than a
sample can fit centroids for, a centroid is the sum of one of a first and one of a second level. A class also visits every
list whose centroid is nearly as near as its own: by how much is set from synthetic neighbours at exactly the
threshold, in any direction and in the data's own ones, so that the target share of the worst-placed true neighbours lies
in a visited list. A pair is found if either visits the other's list; if both do, it counts in the later one. There, table
lookups give the distance to each stored reconstruction; a pair is kept for the rerank unless distance minus reconstruction error already exceeds
the threshold's distance, so this filter loses nothing. The rerank computes cosines in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, hashed_sample, small, written
from tidemark.llm.components import components

SIMILARITY = 0.95
#: Vectors that the index is fitted on: those of least hash.
SAMPLE = 20_000
#: Subspaces and codes in each.
SUBSPACES, CODES = 8, 256
#: Shares of synthetic neighbours exactly at the threshold that visited lists must hold: in random directions, and in the
#: direction of other vectors, which are much further from their lists.
RECALL, RECALL_INSIDE = 0.9995, 0.995
#: Vector lengths of which each gets a fitted index, those of most classes, and the classes that a length needs for one.
FITTED, LEAST = 16, 1024
#: First-level centroids at most, and distances to lists that are worked out at once.
CENTROIDS, CELLS = 4096, 4_000_000
#: Stored vectors in one unit of work, and visitors that are compared at once.
BLOCK, VISITORS = 4096, 512
#: More than there are numbers of lists, below or above 0.
SPREAD = 2**32


def unit_vectors(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """k centroids of x (of fewer points, the points); an empty cluster takes a random point."""
    k = min(k, len(x))
    centroids = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = nearest(x, centroids)
        counts = np.bincount(at, minlength=k)
        sums = np.stack([np.bincount(at, weights=x[:, d], minlength=k) for d in range(x.shape[1])], 1)
        full = counts > 0
        centroids[full] = sums[full] / counts[full, None]
        if (~full).any():
            centroids[~full] = x[rng.choice(len(x), (~full).sum())]
    return centroids


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of y."""
    return np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * x @ y.T, 0)


def nearest(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.concatenate([distances(x[i : i + 4096], y).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


@dataclass
class Index:
    coarse: np.ndarray
    fine: np.ndarray
    """The second level, added to each centroid of the first; list i * len(fine) + j belongs to coarse[i] + fine[j]."""
    books: np.ndarray  # subspace, code, dimension
    margin: float
    """How much further than the nearest centroid, in squared distance, the centroid of a visited list may be."""

    @property
    def lists(self) -> int:
        return len(self.coarse) * len(self.fine)

    @staticmethod
    def fit(sample: np.ndarray, lists: int, similarity: float = SIMILARITY, recall: float = RECALL, seed: int = 7) -> Index:
        """Fit on unit vectors. The dimension is padded to a multiple of SUBSPACES by zeros."""
        rng = np.random.default_rng(seed)
        coarse = kmeans(sample, min(lists, CENTROIDS, max(1, len(sample) // 4)), rng)
        second = -(-lists // len(coarse))
        near = sample - coarse[nearest(sample, coarse)]
        fine = kmeans(near, second, rng) if second > 1 else np.zeros((1, sample.shape[1]))
        index = Index(coarse, fine, np.zeros((SUBSPACES, 1, 1)), 0.0)
        residuals = padded(sample - index.centroids(index.own(sample)))
        width = residuals.shape[1] // SUBSPACES
        books = []
        for s in range(SUBSPACES):
            book = kmeans(residuals[:, s * width : (s + 1) * width], CODES, rng, 8)
            books.append(np.concatenate([book, np.repeat(book[:1], CODES - len(book), 0)]))
        index.books = np.stack(books)
        index.margin = neighbour_margin(sample, index, similarity, recall, rng)
        return index

    def centroids(self, lists: np.ndarray) -> np.ndarray:
        return self.coarse[lists // len(self.fine)] + self.fine[lists % len(self.fine)]

    def to_lists(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Squared distances of the rows of x to the centroids of all lists, some rows at a time, with the first one's number."""
        between = 2 * self.coarse @ self.fine.T + (self.fine**2).sum(1)[None]
        step = max(1, CELLS // self.lists)
        for i in range(0, len(x), step):
            part = x[i : i + step]
            d = distances(part, self.coarse)[:, :, None] - 2 * (part @ self.fine.T)[:, None, :] + between[None]
            yield i, d.reshape(len(part), -1)

    def own(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([d.argmin(1) for _, d in self.to_lists(x)]) if len(x) else np.zeros(0, int)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Own list, codes, reconstruction error and the other lists to visit of each vector."""
        at, visits = [], []
        for _, d in self.to_lists(x):
            own = d.argmin(1)
            at.append(own)
            near = d <= d.min(1, keepdims=True) + self.margin
            visits.extend(n[n != o] for n, o in zip(map(np.flatnonzero, near), own))
        at = np.concatenate(at) if at else np.zeros(0, int)
        residuals = padded(x - self.centroids(at))
        width = residuals.shape[1] // SUBSPACES
        codes = np.stack([nearest(residuals[:, s * width : (s + 1) * width], self.books[s]) for s in range(SUBSPACES)], 1).astype(np.uint8)
        rebuilt = np.concatenate([self.books[s][codes[:, s]] for s in range(SUBSPACES)], 1)
        return at, codes, np.linalg.norm(residuals - rebuilt, axis=1), visits

    def lookup(self, x: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Distances of visitors x to the reconstructions of vectors stored in a list, by table lookups."""
        residuals = padded(x - self.centroids(np.array([at])))
        width = residuals.shape[1] // SUBSPACES
        # One row a stored vector: a row of a table is gathered at once.
        out = np.zeros((len(codes), len(x)), np.float32)
        for s in range(SUBSPACES):
            table = distances(self.books[s], residuals[:, s * width : (s + 1) * width]).astype(np.float32)
            out += table[codes[:, s]]
        return np.sqrt(out, out=out).T


@dataclass
class Indexes:
    """The index of each vector length. Lists are numbered on from one fitted index to the next; a length without one
    has a single list, numbered by the length below 0, in which all is compared."""

    fitted: dict[int, tuple[Index, int]]  # dimension: index, number of its first list

    def of(self, dimension: int) -> tuple[Index, int]:
        if dimension in self.fitted:
            return self.fitted[dimension]
        width = (dimension + SUBSPACES - 1) // SUBSPACES
        # Everything is stored as zero with its norm as error, so the table lookups keep every pair for the rerank.
        return Index(np.zeros((1, dimension)), np.zeros((1, dimension)), np.zeros((SUBSPACES, 1, width)), 0.0), -dimension


def padded(x: np.ndarray) -> np.ndarray:
    extra = -x.shape[1] % SUBSPACES
    return np.pad(x, ((0, 0), (0, extra))) if extra else x


def neighbour_margin(sample: np.ndarray, index: Index, similarity: float, recall: float, rng: np.random.Generator) -> float:
    """How much further, over the sample, the centroid of a neighbour's list is from a vector than that of its own: a
    quantile for neighbours at exactly this cosine, in random directions (recall) or towards other vectors of the sample
    (RECALL_INSIDE), whichever is more. The latter lie in the data's own subspace, where the lists are."""
    most = 0.0
    for way, share in ((rng.normal(size=sample.shape), recall), (sample[rng.permutation(len(sample))], min(recall, RECALL_INSIDE))):
        way = way - (way * sample).sum(1, keepdims=True) * sample
        norms = np.linalg.norm(way, axis=1, keepdims=True)
        other = similarity * sample + np.sqrt(1 - similarity**2) * way / np.where(norms > 1e-9, norms, 1)
        theirs = index.own(other)
        excess = [d[np.arange(len(d)), theirs[i : i + len(d)]] - d.min(1) for i, d in index.to_lists(sample)]
        most = max(most, float(np.quantile(np.concatenate(excess), share)))
    return most + 1e-9


def _compare(index: Index, stored: list[tuple], visitors: list[tuple] | None, at: int, kind: type, similarity: float) -> Iterator[tuple[int, int, int]]:
    """For each class with links found here: its id, linked rows to count, and for the components the least id of its
    local group. Items are (rep, copies, vector bytes, own list, codes, error, visited lists); `at` is the list that stores
    them in the index, and None for visitors compares those stored with each other. Visitors at home here meet each stored
    one of a greater id only; visitors of a later list those that don't visit that list themselves."""
    rep = np.array([s[0] for s in stored])
    copies = np.array([s[1] for s in stored], np.int64)
    vectors = units_of([s[2] for s in stored], kind)
    codes = np.frombuffer(b"".join(s[4] for s in stored), np.uint8).reshape(len(stored), -1)
    reach = np.sqrt(2 - 2 * similarity) + np.array([s[5] for s in stored]) + 1e-6
    home = stored[0][3]
    visited = np.unique(np.concatenate([np.array([[i, k] for k in s[6]], np.int64).reshape(-1, 2) for i, s in enumerate(stored)]) @ np.array([SPREAD, 1]))
    counts: dict[int, int] = {}
    parent: dict[int, int] = {}

    def find(n: int) -> int:
        while parent.setdefault(n, n) != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    def count(nodes: np.ndarray, links: np.ndarray) -> None:
        for n, k in zip(nodes.tolist(), links.tolist()):
            if k:
                counts[n] = counts.get(n, 0) + k

    others = stored if visitors is None else visitors
    for i in range(0, len(others), VISITORS):
        part = others[i : i + VISITORS]
        x = vectors[i : i + VISITORS] if visitors is None else units_of([v[2] for v in part], kind)
        own = np.array([v[0] for v in part])
        lists = np.array([v[3] for v in part], np.int64)
        meets = (lists != home)[None] | (own[None] < rep[:, None])
        b, a = np.nonzero((index.lookup(x, at, codes).T <= reach[:, None]) & meets)
        cosine = np.empty(len(a))
        for k in range(0, len(a), 65536):
            cosine[k : k + 65536] = np.einsum("ij,ij->i", x[a[k : k + 65536]], vectors[b[k : k + 65536]])
        keep = (cosine >= similarity) & ~((lists[a] > home) & np.isin(b * SPREAD + lists[a], visited))
        a, b = a[keep], b[keep]
        theirs = np.array([v[1] for v in part], np.int64)
        count(own, np.bincount(a, weights=copies[b], minlength=len(part)).astype(np.int64))
        count(rep, np.bincount(b, weights=theirs[a], minlength=len(rep)).astype(np.int64))
        for u, v in zip(own[a].tolist(), rep[b].tolist()):
            p, q = find(u), find(v)
            if p != q:
                parent[max(p, q)] = min(p, q)
    for n in list(parent):
        yield n, counts.get(n, 0), find(n)


def units_of(values: list[bytes], kind: type) -> np.ndarray:
    """Unit vectors in double precision of equally long vectors' bytes."""
    x = np.frombuffer(b"".join(values), kind).reshape(len(values), -1).astype(np.float64)
    return unit_vectors(x / np.abs(x).max(1, keepdims=True))


def near_duplicates(
    vectors: DataFrame, similarity: float = SIMILARITY, sample: int = SAMPLE, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """vec_id, n_links, component_id of each row: links to other rows of cosine >= similarity, and the least vec_id
    reachable over links, itself included.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; others link with
    vectors of their own length. Rows without an id have no links and a null
    component. Each row of a repeated vec_id has the links of its own vector. Columns other than the two named are ignored; an empty
    table gives no rows. The result is a written table.

    Cost: vectors, in their own precision, are written once per class and cross one shuffle to their list and to the lists
    that they visit. The index of a length is fitted on at most `sample` classes; the number of lists is the root of that of
    classes. The FITTED lengths of most classes have an index if they have LEAST classes (the most common one always);
    the classes of any other length are all compared with each other, in blocks. A list's stored vectors are dealt to blocks
    of about BLOCK, whatever its size.
    """
    spark = vectors.sparkSession
    usable = (
        F.col("vector").isNotNull()
        & (F.size("vector") > 0)
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vector", lambda x: x != 0)
    )
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    kind = np.float32 if single else np.float64
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("vector"))
    rows = rows.withColumn("vector", F.when(F.col("vec_id").isNotNull() & usable, F.col("vector")))

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1)
            ends = np.cumsum(pa.compute.list_value_length(values).fill_null(0).to_numpy())
            parts = np.split(values.flatten().to_numpy().astype(kind), ends[:-1]) if len(ends) else []
            out = [v.tobytes() if len(v) else None for v in parts]
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "vector"])

    with Scratch(spark) as scratch:
        units = scratch.written(rows.mapInArrow(raw, "vec_id long, vector binary"), "units")
        classes = units.where("vector IS NOT NULL").groupBy("vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
        classes = scratch.written(classes.select(F.monotonically_increasing_id().alias("rep"), "least", "copies", "vector"), "classes")
        width = np.dtype(kind).itemsize
        sizes = classes.groupBy(F.length("vector").alias("bytes")).count().orderBy(F.desc("count"), "bytes").limit(FITTED).collect()
        fitted: dict[int, tuple[Index, int]] = {}
        first = 0
        for r in sizes:
            if fitted and r["count"] < LEAST:
                break
            picked = hashed_sample(classes.where(F.length("vector") == r["bytes"]).select("vector"), ["vector"], sample).collect()
            x = units_of(sorted(p["vector"] for p in picked), kind)
            fitted[r["bytes"] // width] = index, _ = Index.fit(x, max(1, int(r["count"] ** 0.5)), similarity), first
            first += index.lists
        indexes = spark.sparkContext.broadcast(Indexes(fitted))

        def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lengths = pa.compute.binary_length(batch.column(2)).to_numpy()
                for length in np.unique(lengths):
                    part = batch.filter(pa.array(lengths == length))
                    index, begin = indexes.value.of(int(length) // width)
                    at, codes, error, visits = index.encode(units_of(part.column(2).to_pylist(), kind))
                    yield pa.record_batch(
                        [*part.columns, pa.array(at + begin, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.array([(v + begin).tolist() for v in visits], pa.list_(pa.int32()))],
                        names=["rep", "copies", "vector", "list", "codes", "error", "visits"],
                    )

        coded = scratch.written(classes.select("rep", "copies", "vector").mapInArrow(stored, "rep long, copies long, vector binary, list int, codes binary, error double, visits array<int>"), "coded")
        blocks = scratch.written(coded.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "blocks")
        home = coded.select("rep", "copies", "vector", "list", "codes", "error", "visits", F.col("list").alias("at"), F.lit(True).alias("home"))
        away = coded.select(
            "rep", "copies", "vector", "list", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("error"),
            F.lit(None).cast("array<int>").alias("visits"), F.explode(F.concat("visits", F.array("list"))).alias("at"), F.lit(False).alias("home"),
        )
        # A stored vector has one block of its list, a visitor all; visitors are cut into as many parts as blocks. In a list
        # of one block those at home need not visit.
        n = blocks.count()
        sides = home.unionByName(away).join(small(blocks.withColumnRenamed("list", "at"), n), "at").where("home OR at <> list OR blocks > 1")
        dealt = sides.withColumn("block", F.expr("explode(if(home, array(cast(pmod(xxhash64(rep), blocks) as int)), sequence(0, blocks - 1)))"))
        dealt = dealt.withColumn("part", F.expr("explode(if(home, sequence(0, blocks - 1), array(cast(pmod(xxhash64(rep, 1), blocks) as int))))"))
        work = dealt.select("at", "block", "part", F.expr("cast(not home as int)").alias("side"), F.expr("blocks > 1").alias("cut"), "rep", "copies", "vector", "list", "codes", "error", "visits")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: list[tuple] = []
            here: list[tuple] = []
            visiting: list[tuple] = []
            key: tuple | None = None
            whole = False

            def finish(last: bool) -> None:
                if here:
                    index, begin = indexes.value.of(len(here[0][2]) // width)
                    if visiting:
                        out.extend(_compare(index, here, visiting, key[0] - begin, kind, similarity))
                    if last and whole and len(here) > 1:
                        out.extend(_compare(index, here, None, key[0] - begin, kind, similarity))

            for batch in batches:
                for at, block, part, side, cut, *item in zip(*(c.to_pylist() for c in batch.columns)):
                    if (at, block, part) != key:
                        finish(True)
                        key, whole, here, visiting = (at, block, part), not cut, [], []
                    (visiting if side else here).append(item)
                    if len(visiting) >= 8 * VISITORS:
                        finish(False)
                        visiting = []
                if len(out) >= 10_000:
                    yield _rows(out)
                    out = []
            finish(True)
            yield _rows(out)

        unit = ["at", "block", "part"]
        links = scratch.written(work.repartition(*unit).sortWithinPartitions(*unit, "side").mapInArrow(run, "rep long, links long, root long"), "links")
        groups = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")), scratch).withColumnRenamed("node", "rep")
        totals = links.groupBy("rep").agg(F.sum("links").alias("links")).join(groups, "rep", "left")
        of = classes.join(totals, "rep", "left").select("vector", "least", "copies", "links", F.coalesce("component", "rep").alias("component"))
        of = scratch.written(of, "linked")
        least = of.where("links IS NOT NULL").groupBy("component").agg(F.min("least").alias("component_id"))
        table = of.join(least, "component", "left").select(
            "vector", F.coalesce("component_id", "least").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
        )
        return written(
            units.join(scratch.written(table, "table"), "vector", "left").select(
                "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
            ),
            "near_duplicates",
        )


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [(), (), ()]
    return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["rep", "links", "root"])
