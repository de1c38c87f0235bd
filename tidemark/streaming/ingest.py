"""Structured Streaming ingestion of contract-shaped files into partitioned contract tables.

The analyses are batch relations over stored snapshots; this only appends what arrives. Each micro-batch writes a
folder named by its id and replaces it if the batch runs again, so a restart neither loses nor doubles rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidemark.sources.contracts import CONTRACTS, validate


def ingest(spark: SparkSession, contract: str, source: str, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Read Parquet files of a contract from a folder as they arrive, and append them to target."""
    stream = spark.readStream.schema(CONTRACTS[contract]).parquet(source)

    def store(batch: DataFrame, batch_id: int) -> None:
        validate(batch, contract).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stored(spark: SparkSession, contract: str, target: str) -> DataFrame:
    """All rows ingested so far, contract-shaped."""
    return validate(spark.read.parquet(target).drop("batch"), contract)
