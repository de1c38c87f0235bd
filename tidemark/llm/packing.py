"""Packing documents into fixed windows of tokens by the sum-of-squares rule.

A document goes to the fill level that leaves the least sum of squared counts of partially filled windows, so
levels that combine to full windows stay available. The counts stand in a level array, one cell a fill; each
partition of the input has its own and packs its rows in one pass, so no row crosses the network.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices

#: Fixed value: how the byte-level vocabulary splits a text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces in an output batch.
BATCH = 8192

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Token ids exactly as `tokenizers` gives them without adding special tokens.

    A plain byte-level BPE runs on tiktoken, which merges the same ranks about four times as fast; a text that
    spells an added token, and any other kind of vocabulary, goes through `tokenizers` itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.fast = None
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
        if model.get("type") == "BPE" and plain:
            letters = _byte_letters()
            ranks = {bytes(letters[c] for c in w): i for w, i in model["vocab"].items() if w not in self.added}
            merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
            ids = [model["vocab"].get(a + b) for a, b in merges]
            # Every entry must be a byte or what merging two gives, in order of rank: tiktoken takes a piece that is an
            # entry whole, whether or not merges lead to it.
            whole = {bytes([b]) for b in range(256)} | {bytes(letters[c] for c in a + b) for a, b in merges}
            if None not in ids and all(x < y for x, y in zip(ids, ids[1:])) and ranks.keys() <= whole:
                self.fast = tiktoken.Encoding("plain", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or any(t in text for t in self.added):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self.fast.encode_ordinary(text), "<u4")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class LevelArray:
    """Counts of partially filled windows by fill level, and which windows those are."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, np.int64)
        self.windows: list[list[list]] = [[] for _ in range(capacity)]

    def level_for(self, size: int) -> int:
        """The fill level, 0 for a new window, that keeps the sum of squares least; of equals the fullest."""
        c, n = self.capacity, self.counts
        best, cost = 0, 2 * n[size] + 1 if size < c else 0
        if size < c:
            top = c - size
            if n[top]:
                best, cost = top, 1 - 2 * n[top]
            lower = n[1:top]
            if len(lower):
                change = np.where(lower > 0, 2 * (n[size + 1 : c] - lower) + 2, np.iinfo(np.int64).max)
                at = len(lower) - 1 - int(np.argmin(change[::-1]))
                if lower[at] > 0 and change[at] < cost:
                    best = at + 1
        return best

    def place(self, piece: tuple, size: int) -> list | None:
        """Put a piece of at most the capacity into a window; the window if that fills it."""
        level = self.level_for(size)
        if level:
            window = self.windows[level].pop()
            self.counts[level] -= 1
        else:
            window = []
        window.append(piece)
        if level + size == self.capacity:
            return window
        self.windows[level + size].append(window)
        self.counts[level + size] += 1
        return None

    def close(self) -> Iterator[list]:
        """Empty the array: the fullest windows are topped up by cutting pieces from the emptiest ones, so that all
        but one are full; that one is cut into sequences of falling powers of two, which need no padding."""
        left = [w for level in range(self.capacity - 1, 0, -1) for w in self.windows[level]]
        self.windows = [[] for _ in range(self.capacity)]
        self.counts[:] = 0
        fill = [sum(len(p[2]) for p in w) for w in left]
        i, j = 0, len(left) - 1
        while i < j:
            room = self.capacity - fill[i]
            piece = left[j].pop()
            part = _cut(piece, room) if len(piece[2]) > room else (piece, None)
            left[i].append(part[0])
            fill[i] += len(part[0][2])
            fill[j] -= len(part[0][2])
            if part[1] is not None:
                left[j].append(part[1])
            if fill[i] == self.capacity:
                yield left[i]
                i += 1
            if not left[j]:
                j -= 1
        if i == j and left[i]:
            pieces, n = left[i][::-1], fill[i]
            while n:
                size, window = 1 << (n.bit_length() - 1), []
                n -= size
                while size:
                    piece = pieces.pop()
                    if len(piece[2]) > size:
                        piece, rest = _cut(piece, size)
                        pieces.append(rest)
                    window.append(piece)
                    size -= len(piece[2])
                yield window


def _cut(piece: tuple, size: int) -> tuple[tuple, tuple]:
    doc, start, ids, total = piece
    return (doc, start, ids[:size], total), (doc, start + size, ids[size:], total)


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 2048,
    end_id: int = 1,
    with_ids: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of all documents in sequences of at most `capacity` tokens: doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset and, with with_ids, the ids.

    A document is its ids and end_id; null and empty texts are end_id alone. Stretches of a full window are
    sequences of their own, the rest is placed by sum of squares. At the end of each partition of the input
    the open windows are closed without padding (see LevelArray.close): at most 11 sequences a partition are
    shorter than the capacity, each a power of two. Sequence ids are unique, gapless within a partition.
    Repeated rows are packed each; an empty table gives no rows; null ids are kept; columns other than the
    two named are ignored. `tokenizer` is the path of a tokenizers file on every executor.

    Cost: one scan, no shuffle; memory is one batch of texts and the open windows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, levels = encoder(tokenizer), LevelArray(capacity)
        sequence = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []

        def emit(window: list) -> None:
            nonlocal sequence
            at = 0
            for doc, start, ids, total in window:
                rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, sequence, at, ids.astype(np.int32) if with_ids else None))
                at += len(ids)
            sequence += 1

        for batch in slices(batches, 1):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(encode(text or ""), np.array([end_id], "<u4")).astype("<u4")
                total, start = len(ids), 0
                while total - start >= capacity:
                    emit([(doc, start, ids[start : start + capacity], total)])
                    start += capacity
                if start < total:
                    full = levels.place((doc, start, ids[start:].copy(), total), total - start)
                    if full:
                        emit(full)
            while len(rows) >= BATCH:
                yield _batch(rows[:BATCH])
                del rows[:BATCH]
        for window in levels.close():
            emit(window)
        for i in range(0, len(rows), BATCH):
            yield _batch(rows[i : i + BATCH])

    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
    return found if with_ids else found.drop("ids")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())]
    return pa.record_batch(
        [pa.array(c, k) for c, k in zip(columns, kinds)],
        names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
    )
