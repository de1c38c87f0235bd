"""A corpus pipeline: toxic texts go, one document of each near-duplicate group stays, benchmark text goes, secrets
are masked, and what is left is packed.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents, the last one its pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, ngram_join, packing, quality, secrets, toxicity
from tidemark.llm.queries import byte_bpe, table
from tidemark.sources.shared import delete, shared_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores below its threshold; it learns from the same rows as query 7. Null and empty
    texts are scored as texts without words. Rows alike are judged alike; an empty table stays empty."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), quality.held_out(F.col("doc_id"), 4, 2))
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that of least id, and all without links. Rows that share an id, or have
    none, are documents of their own; of rows alike in id and text one stays. Texts without words, nulls included, all stay;
    an empty table stays empty."""
    return ngram_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs. Null and empty texts stay; repeated rows are judged each; an
    empty table stays empty."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every finding masked and n_chars counted anew for those. Null texts stay null; repeated rows and
    rows without an id stay; an empty table stays empty."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in windows of 2,048 tokens. Null and empty texts are their end token; repeated rows are packed each; an
    empty table gives no pieces."""
    return packing.pack(docs, byte_bpe(), capacity=2048, end_id=1, with_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: A trained model, hashing and packing aren't for SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written before the next one reads it, and goes once that one has
    written its own. Columns of documents other than doc_id and text may have any name and be null."""
    docs, path = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        before, path = path, shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
    return docs
