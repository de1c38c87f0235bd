"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The features are densities of a learned lexicon (words and word beginnings that mark toxic texts, with their
log odds), the nearness of second-person words to it, capitals, punctuation and signs of obfuscation.
The lexicon of each half of the training rows comes from the other half, so that the trees see it as they will
on new texts; the halves' trees score each other's rows for the calibration; the final lexicon and trees
come from all training rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, slices, words_of
from tidemark.llm.quality import labelled_sample
from tidemark.llm.trees import Forest, Isotonic, fit

#: Most labelled rows to learn from, and most terms of a lexicon.
SAMPLE, TERMS = 20_000, 3_000
#: A term is in a lexicon from this many toxic training rows on, if its log odds are so many deviations above 0.
LEAST_ROWS, LEAST_Z = 3, 3.0
#: Word beginnings are terms too, by their number of bytes.
STEMS = (4, 5, 6, 7, 8)
#: Words around a second-person word that count as near it.
NEAR = 5
THRESHOLD = 0.3
WIDTH = 22

# Second-person words of the languages of the corpus, and letters behind digits and signs.
SECOND_PERSON = {w.encode() for w in "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer usted ustedes ti tus su vosotros os".split()}
LEET = str.maketrans("013457@$!", "oieastasi")

_memo: dict[tuple, dict[bytes, float]] = {}


def terms(word: bytes) -> list[bytes]:
    """A word, and its beginnings with a star."""
    return [word, *(word[:k] + b"*" for k in STEMS if len(word) >= k)]


def weight(word: bytes, lexicon: dict[bytes, float]) -> float:
    return max((lexicon.get(t, 0.0) for t in terms(word)), default=0.0)


def features(text: str | None, lexicon: dict[bytes, float], memo: dict[bytes, float]) -> list[float]:
    """All zero for an empty text. memo keeps the weights of words seen before."""
    if not text:
        return [0.0] * WIDTH
    lower = text.lower()
    words = words_of(lower)
    n = max(1, len(words))
    if len(memo) > 500_000:
        memo.clear()
    for word in set(words).difference(memo):
        memo[word] = weight(word, lexicon)
    w = np.fromiter(map(memo.__getitem__, words), np.float64, len(words))
    flagged = np.flatnonzero(w >= 1.5)
    persons = np.array([i for i, word in enumerate(words) if word in SECOND_PERSON]) if SECOND_PERSON.intersection(words) else np.zeros(0, int)
    near = 0
    if len(flagged) and len(persons):
        at = np.searchsorted(persons, flagged)
        gap = np.minimum(np.abs(flagged - persons[np.minimum(at, len(persons) - 1)]), np.abs(flagged - persons[np.maximum(at - 1, 0)]))
        near = int((gap <= NEAR).sum())
    raw = text.split()
    odd = [x for x in raw if any(c in x for c in "013457@$!") and any(c.isalpha() for c in x)] if any(c in text for c in "013457@$!") else []
    hidden = sum(weight(p, lexicon) >= 1.5 for x in odd for p in words_of(x.lower().rstrip("!").translate(LEET)))
    top = np.sort(w)[::-1][:8]
    chars = max(1, len(text))
    return [
        len(flagged) / n,
        (w >= 2.5).sum() / n,
        (w >= 3.5).sum() / n,
        (w >= 4.5).sum() / n,
        w.sum() / n,
        w.sum() / n**0.5,
        np.log1p(len(flagged)),
        len({words[i] for i in flagged}) / n,
        np.log1p(len({words[i] for i in flagged})),
        float(top[0]) if len(top) else 0.0,
        float(top[:3].mean()) if len(top) else 0.0,
        float(top.mean()) if len(top) else 0.0,
        near / n,
        near / max(1, len(flagged)),
        len(persons) / n,
        sum(map(str.isupper, raw)) / max(1, len(raw)),
        sum(map(str.isupper, text)) / chars,
        text.count("!") / n,
        text.count("?") / n,
        len(odd) / max(1, len(raw)),
        hidden / n,
        np.log1p(n),
    ]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each term: rows with it by half and label."""
    counts = {(half, label): Counter() for half in (0, 1) for label in (0, 1)}
    for batch in slices(batches, 2):
        for doc, label, text in zip(*(c.to_pylist() for c in batch.columns)):
            if text:
                counts[doc % 2, label].update({t for word in set(words_of(text.lower())) for t in terms(word)})
    found = list(set().union(*counts.values()))
    for i in range(0, len(found), 50_000):
        part = found[i : i + 50_000]
        yield pa.record_batch(
            [pa.array(part, pa.binary()), *(pa.array([c[t] for t in part], pa.int64()) for c in counts.values())], names=["term", "a0", "a1", "b0", "b1"]
        )


def _lexicon(counts: DataFrame, n0: int, n1: int, c0: Column, c1: Column) -> dict[bytes, float]:
    """The TERMS most certain terms with their log odds, at most 6."""
    odds = F.log((c1 + 0.5) / (n1 + 1.0)) - F.log((c0 + 0.5) / (n0 + 1.0))
    z = odds / F.sqrt(1 / (c1 + 0.5) + 1 / (c0 + 0.5))
    rows = counts.select("term", odds.alias("odds"), z.alias("z"), c1.alias("n")).where((F.col("n") >= LEAST_ROWS) & (F.col("z") >= LEAST_Z))
    return {bytes(r["term"]): min(6.0, r["odds"]) for r in rows.orderBy(F.desc("z"), "term").limit(TERMS).collect()}


@dataclass
class Model:
    lexicon: dict[bytes, float]
    forest: Forest
    calibration: Isotonic

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.calibration(self.forest.probability(x)), 0, 1) if len(x) else np.zeros(0)


def train(docs: DataFrame, labels: DataFrame, out: Column, most: int = SAMPLE) -> Model:
    """Learn `toxic` from at most `most` labelled rows that `out` doesn't hold out. Term counts are gathered by an
    aggregation; lexicons (TERMS each) and the rows' features reach the driver. Without labels, or without
    toxic ones, all scores are low. Null texts count as empty ones; see labelled_sample on repeated rows and labels."""
    with Scratch(docs.sparkSession) as scratch:
        return _trained(labelled_sample(docs, labels, "toxic", out, most, scratch), scratch)


def _trained(sample: DataFrame, scratch: Scratch) -> Model:
    sizes = {(r["half"], r["label"]): r["count"] for r in sample.groupBy(F.pmod("doc_id", F.lit(2)).alias("half"), "label").count().collect()}
    n = {(h, y): sizes.get((h, y), 0) for h in (0, 1) for y in (0, 1)}
    rows = sample.mapInArrow(_counted, "term binary, a0 long, a1 long, b0 long, b1 long")
    counts = rows.groupBy("term").agg(*(F.sum(c).alias(c) for c in ("a0", "a1", "b0", "b1"))).where(F.col("a1") + F.col("b1") >= LEAST_ROWS)
    counts = scratch.written(counts, "terms")
    a0, a1, b0, b1 = (F.col(c) for c in ("a0", "a1", "b0", "b1"))
    lexicons = [
        _lexicon(counts, n[1, 0], n[1, 1], b0, b1),  # for the even half, from the odd one
        _lexicon(counts, n[0, 0], n[0, 1], a0, a1),
        _lexicon(counts, n[0, 0] + n[1, 0], n[0, 1] + n[1, 1], a0 + b0, a1 + b1),
    ]
    shared = sample.sparkSession.sparkContext.broadcast(lexicons)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos: list[dict] = [{}, {}]
        for batch in slices(batches, 2):
            docs_, labels_, texts = (c.to_pylist() for c in batch.columns)
            x = [features(t, shared.value[d % 2], memos[d % 2]) for d, t in zip(docs_, texts)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    got = sample.mapInArrow(measured, "doc_id long, label int, x array<double>").collect()
    got.sort(key=lambda r: (r["doc_id"], r["x"]))
    x = np.array([r["x"] for r in got], float).reshape(len(got), WIDTH)
    y = np.array([r["label"] for r in got], float)
    half = np.array([r["doc_id"] % 2 for r in got], int)
    options = {"trees": 60, "depth": 3}
    across = np.zeros(len(got))
    for h in (0, 1):
        across[half == h] = fit(x[half != h], y[half != h], **options).probability(x[half == h])
    return Model(lexicons[2], fit(x, y, **options), Isotonic.fit(across, y))


def scorer(spark, model: Model):
    """A function from texts to scores, for use inside tasks."""
    shared = spark.sparkContext.broadcast(model)
    memo: dict[bytes, float] = {}

    def scores(texts: list[str | None]) -> np.ndarray:
        x = np.array([features(t, shared.value.lexicon, memo) for t in texts], float).reshape(len(texts), WIDTH)
        return shared.value.score(x)

    return scores


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted of each row, from the whole text alone. Null texts count as empty; repeated rows
    each get a row; null ids are kept; an empty table gives no rows; other columns are ignored. One scan, no
    shuffle."""
    scores = scorer(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            p = scores(batch.column(1).to_pylist())
            yield pa.record_batch([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose score is below the threshold. Null and empty texts score as texts
    without any word; repeated rows are judged each and alike; an empty table stays empty. One scan, no shuffle."""
    scores = scorer(docs.sparkSession, model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            yield batch.filter(pa.array(scores(batch.column(at).to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)
