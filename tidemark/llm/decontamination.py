"""Benchmark decontamination with one Aho-Corasick automaton over the words of the normalised test texts.

A text is normalised by one table over its UTF-8 bytes: A-Z to lower case, every other ASCII character that is
neither letter nor digit to a space; what is left between spaces are its words, and each is a number in the test texts'
vocabulary, or 0. The automaton reads these numbers. Its patterns are a few anchors of each test text, placed so
densely that every window of words holds a whole one, and whole texts that are shorter than a window; it is
therefore some ten times smaller than one of all windows. Each text is scanned once; the windows around an anchor
that it meets are looked up in a table of all windows, word by word, and word numbers map to code points of the original.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, slices, words_of, written

#: Words in a window; an item of fewer, but not none, is one window.
WINDOW = 10
#: Most bytes of test text behind one broadcast automaton; it takes some 20 bytes for each.
BROADCAST_BYTES = 32_000_000
#: Words in the original text: the characters that the normalisation keeps.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

SCHEMA = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
WORD_SPANS = pa.list_(pa.list_(pa.int64()))

Item = tuple[str, str]


def windows(text: str | None, size: int) -> list[list[bytes]]:
    words = words_of(text)
    return [words[i : i + size] for i in range(max(1, len(words) - size + 1))] if words else []


def anchors(size: int) -> tuple[int, int]:
    """Words in an anchor, and the distance of anchors: every window of `size` words holds a whole anchor."""
    length = (size + 1) // 2
    return length, size - length + 1


class Matcher:
    """The automaton of some items' anchors, and the table of their windows."""

    def __init__(self, items: Iterable[Item], size: int):
        self.size, (self.length, step) = size, anchors(size)
        self.vocabulary: dict[bytes, int] = {}
        texts: list[np.ndarray] = []
        names: list[str] = []
        patterns: dict[tuple[int, ...], set[str]] = {}  # whole texts
        for name, text in items:
            words = words_of(text)
            if not words:
                continue
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            if len(ids) < size:
                patterns.setdefault(tuple(ids), set()).add(name)
            else:
                texts.append(np.array(ids, np.int32))
                names.append(name)
        anchored: set[tuple[int, ...]] = set()
        for ids in texts:
            for i in range(0, len(ids) - self.length + 1, step):
                anchored.add(tuple(ids[i : i + self.length].tolist()))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for pattern in patterns.keys() | anchored:
            self.automaton.add_word(pattern, (len(pattern), pattern in anchored, tuple(sorted(patterns.get(pattern, ())))))
        self.empty = not (patterns or anchored)
        if not self.empty:
            self.automaton.make_automaton()
        self._table(texts, names)

    def _table(self, texts: list[np.ndarray], names: list[str]) -> None:
        """All windows by their hash, sorted; equal windows stand once, with the items that hold them."""
        self.names = sorted(set(names))
        number = {n: i for i, n in enumerate(self.names)}
        self.words = np.concatenate(texts) if texts else np.zeros(0, np.int32)
        ends = np.cumsum([len(t) for t in texts])
        starts = np.concatenate([np.arange(e - len(t), e - self.size + 1) for t, e in zip(texts, ends)]) if texts else np.zeros(0, np.int64)
        items = np.repeat([number[n] for n in names], [len(t) - self.size + 1 for t in texts]).astype(np.int64)
        for seed in range(1, 100):  # another multiplier where two different windows have one hash
            self.powers = np.random.default_rng(seed).integers(1, 2**63, self.size, dtype=np.uint64) | np.uint64(1)
            hashes = self._hash(self.words, starts)
            order = np.lexsort((items, hashes))
            starts_, hashes_, items_ = starts[order], hashes[order], items[order]
            same = hashes_[1:] == hashes_[:-1]
            if self._equal(self.words, starts_[1:][same], starts_[:-1][same]).all():
                break
        first = np.concatenate([[True], ~same]) if len(starts_) else np.zeros(0, bool)
        self.hashes, self.places = hashes_[first], starts_[first]
        distinct = np.concatenate([[True], ~same | (items_[1:] != items_[:-1])]) if len(starts_) else first
        group = np.cumsum(first) - 1
        self.items, counts = items_[distinct].astype(np.int32), np.bincount(group[distinct], minlength=len(self.hashes))
        self.ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)

    def _hash(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        out = np.zeros(len(starts), np.uint64)
        for k in range(self.size):
            out += (words[starts + k].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * self.powers[k]
            out ^= out >> np.uint64(29)
        return out

    def _equal(self, words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.logical_and.reduce([words[a + k] == self.words[b + k] for k in range(self.size)])

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word intervals [start, end) of all occurrences, and the items that occur."""
        if self.empty or not words:
            return [], set()
        ids = tuple(map(self.vocabulary.get, words, repeat(0)))
        hits: list[tuple[int, int]] = []
        found: set[str] = set()
        met: list[int] = []
        for end, (n, anchor, names) in self.automaton.iter(ids):
            if names:
                hits.append((end - n + 1, end + 1))
                found.update(names)
            if anchor:
                met.append(end - self.length + 1)
        if met and len(ids) >= self.size:
            near = np.array(met)[:, None] - np.arange(self.size - self.length + 1)
            starts = np.unique(near[(near >= 0) & (near <= len(ids) - self.size)])
            line = np.array(ids, np.int32)
            at = np.searchsorted(self.hashes, h := self._hash(line, starts))
            known = at < len(self.hashes)
            known[known] = self.hashes[at[known]] == h[known]
            starts, at = starts[known], at[known]
            same = self._equal(line, starts, self.places[at])
            hits.extend((int(i), int(i) + self.size) for i in starts[same])
            for k in np.unique(at[same]):
                found.update(self.names[i] for i in self.items[self.ends[k] : self.ends[k + 1]])
        return hits, found


def merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def original_spans(text: str, intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word intervals as code points [start, end) of the original text."""
    if not intervals:
        return []
    places = [m.span() for m in WORD.finditer(text)]
    return [(places[a][0], places[b - 1][1]) for a, b in intervals]


def benchmark_parts(benchmark: DataFrame, item_col: str, text_col: str) -> list[DataFrame]:
    """The items (item, text) that have a text, in as many hashed parts as BROADCAST_BYTES each ask for. An item longer
    than that is a part of about its size. Their rows are broadcast, so ids and rows count as bytes too."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text")).where("text IS NOT NULL").distinct()
    size = F.octet_length("text") + F.octet_length("item") + F.lit(16)
    total = items.agg(F.sum(size)).collect()[0][0] or 0
    n = -(-total // BROADCAST_BYTES)
    return [items] if n <= 1 else [items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i) for i in range(n)]


class Scan:
    """What tasks need to scan texts against a part of a benchmark: its one automaton, built here and broadcast."""

    def __init__(self, items: DataFrame, window: int = WINDOW):
        matcher = Matcher(sorted((r["item"], r["text"]) for r in items.collect()), window)
        self.shared = items.sparkSession.sparkContext.broadcast(matcher)

    def __call__(self, texts: list[str | None]) -> tuple[list[int], list[list[tuple[int, int]]], list[set[str]]]:
        """Of each text: its number of words, the merged word intervals of all occurrences, the items that occur."""
        matcher = self.shared.value
        hits, found, n_words = [], [], []
        for text in texts:
            words = words_of(text)
            at, ids = matcher.scan(words)
            n_words.append(len(words))
            hits.append(merged(at))
            found.append(ids)
        return n_words, hits, found


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """For each row of docs: doc_id, n_words, n_hit (words inside any occurrence of an item's window), the sorted
    ids of items that occur, and the hit stretches as code points of the original text.

    Null and empty texts have no words; so has an item with none, which never occurs. Items with equal windows
    are all reported; a repeated item_id counts as one; an item without an id takes the name "". Repeated rows
    each get a row; empty tables are fine; columns other than the named ones are ignored.

    Cost: one scan, no shuffle. The automaton and its tables are built once, on the driver, and broadcast, if the test
    texts are within BROADCAST_BYTES, which is checked first. A larger benchmark is dealt to parts of that size with an
    automaton each, and the documents are scanned once a part; what one pass found is written before the next.
    """
    parts = benchmark_parts(benchmark, item_col, item_text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    none = F.array().cast("array<array<bigint>>").alias("hits"), F.array().cast("array<string>").alias("found")
    with Scratch(docs.sparkSession) as scratch:
        for i, part in enumerate(parts[:-1]):
            before = rows if i else rows.select("*", *none)
            rows = scratch.written(before.mapInArrow(_pass(Scan(part, window)), "doc_id long, text string, hits array<array<bigint>>, found array<string>"), "pass")
        scan, several = Scan(parts[-1], window), len(parts) > 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 1):
                texts = batch.column(1).to_pylist()
                n_words, hits, found = scan(texts)
                if several:
                    hits, found = _with_earlier(batch, hits, found)
                yield pa.record_batch(
                    [
                        batch.column(0),
                        pa.array(n_words, pa.int64()),
                        pa.array([sum(b - a for a, b in x) for x in hits], pa.int64()),
                        pa.array([sorted(x) for x in found], pa.list_(pa.string())),
                        pa.array([[{"start": a, "end": b} for a, b in original_spans(t, x)] for t, x in zip(texts, hits)], SPANS),
                    ],
                    names=["doc_id", "n_words", "n_hit", "items", "spans"],
                )

        found = rows.mapInArrow(run, SCHEMA)
        return written(found, "decontaminated") if several else found


def _with_earlier(batch: pa.RecordBatch, hits: list, found: list) -> tuple[list, list]:
    """The findings in rows of (doc_id, text, hits, found), with those of another pass."""
    before, items = batch.column(2).to_pylist(), batch.column(3).to_pylist()
    return [merged([*map(tuple, a), *b]) for a, b in zip(before, hits)], [b.union(a) for a, b in zip(items, found)]


def _pass(scan: Scan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            _, hits, found = scan(batch.column(1).to_pylist())
            hits, found = _with_earlier(batch, hits, found)
            spans = pa.array([[list(x) for x in h] for h in hits], WORD_SPANS)
            yield pa.record_batch([*batch.columns[:2], spans, pa.array([sorted(x) for x in found], pa.list_(pa.string()))], names=batch.schema.names)

    return run


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs, with all their columns, in whose text no window of any item occurs. Null texts and texts without
    words stay, as do all rows if no item has words; repeated rows are judged each; empty tables are fine. One pass for
    each part of the benchmark (see decontaminate), no shuffle."""
    at = docs.columns.index("text")
    parts = benchmark_parts(benchmark, "item_id", "text")
    for part in parts[:-1]:
        docs = written(docs.mapInArrow(_clean(Scan(part, window), at), docs.schema), "clean")
    return docs.mapInArrow(_clean(Scan(parts[-1], window), at), docs.schema)


def _clean(scan: Scan, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            _, hits, _ = scan(batch.column(at).to_pylist())
            yield batch.filter(pa.array([not x for x in hits], pa.bool_()))

    return run
