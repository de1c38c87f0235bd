"""Quality classifier: gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, hashed_sample, slices
from tidemark.llm.trees import Forest, fit

#: Most labelled rows to learn from: those of least hash of doc_id.
SAMPLE = 20_000

_KINDS = np.zeros((256, 12))
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t", b"\n\r", b".", b",;:", b"!?", b"|", b"#$%&*@^~_+=<>/\\", b"\"'()[]{}", bytes(range(128, 256)))):
    _KINDS[list(_chars), _i] = 1


def statistics(text: str | None) -> list[float]:
    """Numbers on a text's length, characters, words, repetition and lines; all zero for an empty one."""
    if not text:
        return [0.0] * 32
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    kinds = np.bincount(data, minlength=256) @ _KINDS / len(data)
    words = text.split()
    n = max(1, len(words))
    counts = Counter(words)
    most = max(counts.values(), default=0)
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    lines = text.split("\n")
    full = [x.strip() for x in lines if x.strip()]
    m = max(1, len(full))
    return [
        np.log1p(len(data)),
        np.log1p(len(words)),
        *kinds,
        lengths.mean(),
        lengths.std(),
        float((lengths <= 2).mean()),
        float((lengths >= 12).mean()),
        len(counts) / n,
        len(counts) / n**0.8,
        most / n,
        sum(map(eq, words, words[1:])) / n,
        len(set(zip(words, words[1:]))) / n,
        sum(map(str.isupper, words)) / n,
        sum(map(str.islower, words)) / n,
        sum(map(str.isalpha, words)) / n,
        np.log1p(len(full)),
        np.log1p(len(words) / m),
        len(set(full)) / m,
        sum(x[-1] in ".!?" for x in full) / m,
        sum(x[0] in "|-*#" for x in full) / m,
        sum(x[:1].isupper() for x in full) / m,
    ]


def held_out(id_col: Column, folds: int, fold: int) -> Column:
    return F.crc32(id_col.cast("string")) % folds == fold


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, out: Column, most: int, scratch: Scratch) -> DataFrame:
    """doc_id, label, text of labelled documents that aren't held out: at most `most` ids and `most` rows, those of least
    hash. A written table.

    Null labels and ids are left out; an id with several labels counts as 1 if any of them is. Rows alike in id and text
    count once; an id with several texts gives a row each. The ids are broadcast: their number is bounded.
    """
    picked = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~out)
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col(label).cast("int")).alias("label"))
    )
    picked = scratch.written(hashed_sample(scratch.written(picked, "labels"), ["doc_id"], most), "ids")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id").select("doc_id", "label", "text")
    return scratch.written(hashed_sample(scratch.written(rows.distinct(), "rows"), ["doc_id", "text"], most), "sample")


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 2):
        x = [statistics(t) for t in batch.column(2).to_pylist()]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "label", "x"])


def train(docs: DataFrame, labels: DataFrame, out: Column, most: int = SAMPLE) -> Forest:
    """Learn `quality` from at most `most` labelled rows that `out` doesn't hold out; only their statistics reach
    the driver. Without labels every score is one half. Empty and null texts count as empty ones, which have all statistics
    zero; see labelled_sample on repeated rows and labels."""
    with Scratch(docs.sparkSession) as scratch:
        sample = labelled_sample(docs, labels, "quality", out, most, scratch)
        rows = sample.mapInArrow(_measured, "doc_id long, label int, x array<double>").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), -1 if rows else 32)
    return fit(x, np.array([r["label"] for r in rows], float))


def score(docs: DataFrame, model: Forest, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted of each row, from the whole text alone. Null texts count as empty; repeated rows
    each get a row; null ids are kept; an empty table gives no rows; other columns are ignored. One scan, no
    shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            x = np.array([statistics(t) for t in batch.column(1).to_pylist()], float).reshape(batch.num_rows, 32)
            p = shared.value.probability(x)
            yield pa.record_batch([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")
