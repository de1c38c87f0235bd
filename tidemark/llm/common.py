"""What the operators share: the shared folder, written tables, gapless ranks and word rules."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.shared import delete, shared_path

#: Rows of a plan-sized table (one row a partition, shard or hot key) that may be broadcast.
BROADCAST_ROWS = 1_000_000


def new_path(spark: SparkSession, name: str) -> str:
    return shared_path(spark, name)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df as a Parquet table in the shared folder: lineage ends there, and the loss of an executor costs
    nothing before it. It goes with the application; what is needed for one call only belongs to a Scratch."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Written tables that go once a final table is written: with Scratch(spark) as scratch: ... scratch.written(df, name)."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, new_path(spark, "scratch")

    def __enter__(self) -> Scratch:
        return self

    def path(self, name: str) -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __exit__(self, *_) -> None:
        delete(self.spark, self.root)


def unused(name: str, taken: list[str]) -> str:
    """The name, with as many underscores before it as make it none of those taken, in any case of letters."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name = "_" + name
    return name


def hashed_sample(df: DataFrame, key: list[str], most: int) -> DataFrame:
    """At most `most` rows of df: those of least hash of the key, as far as whole keys fit.

    Rows are counted first; the hash from which on rows are left out is found among those below a first cut, which leaves
    a few more than are wanted. Only hashes meet in one task, and the rows stay where they are.
    """
    n = df.count()
    if n <= most:
        return df
    h, wanted = F.xxhash64(*key), most + 8 * most**0.5 + 32
    cut = min(2**63 - 1, int(-(2**63) + min(1.0, wanted / n) * 2**64))
    least = df.select(h.alias("h")).where(F.col("h") < cut).orderBy("h").limit(most + 1)
    edge = least.agg(F.max("h").alias("h"), F.count("*").alias("n")).collect()[0]
    return df.where(h < (edge["h"] if edge["n"] > most else cut))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if its known row count is within the bound; else Spark chooses the join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def ranked(df: DataFrame, order: list[Column | str], scratch: Scratch, rank: str = "rank") -> DataFrame:
    """df with a gapless long column `rank` that numbers all rows from 0 in the given order.

    One range shuffle and a sort inside partitions; no window over an unbounded group. The sorted rows
    are written with their place in their partition, so that a task run again can't change the order
    that the offsets were counted for. Only one row per partition goes through the driver.
    """
    spark = df.sparkSession
    own = F.monotonically_increasing_id()
    rows = scratch.written(
        df.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).withColumn("_place", own),
        "ranked",
    )
    part = F.shiftright("_place", 33)
    counts = rows.groupBy(part.alias("_part")).count().collect()
    offsets, total = [], 0
    for part_id, n in sorted((r["_part"], r["count"]) for r in counts):
        offsets.append((part_id, total))
        total += n
    offsets_df = spark.createDataFrame(offsets, "_part long, _offset long")
    return (
        rows.withColumn("_part", part)
        .join(small(offsets_df, len(offsets)), "_part")
        .withColumn(rank, F.col("_offset") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_part", "_offset", "_place")
    )


#: Bytes of text that a task works on at once, beyond the batch that Spark hands it.
SLICE_BYTES = 16_000_000


def slices(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most SLICE_BYTES in a text column, longer texts alone; nothing is copied."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


#: Words: runs of ASCII digits, letters (case folded) and all characters beyond ASCII.
WORD_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """The lower-cased words of a text in UTF-8; none for null."""
    return text.encode("utf-8", "replace").translate(WORD_TABLE).split() if text else []
