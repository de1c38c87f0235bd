"""Seams: where the six contracts come from. A seam supplies six DataFrames; swapping it changes nothing downstream."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.contracts import CONTRACTS, OSSTAT_NAMES, TIME_MODEL_NAMES, validate

Reader = Callable[[str], DataFrame]


@dataclass(frozen=True)
class Seam:
    snapshot: DataFrame
    tbspc_usage: DataFrame
    tablespace: DataFrame
    datafile: DataFrame
    osstat: DataFrame
    time_model: DataFrame

    def __post_init__(self):
        for name in CONTRACTS:
            object.__setattr__(self, name, validate(getattr(self, name), name))

    def create_views(self, prefix: str = "capv_") -> None:
        """Temp views of the contracts; calling again replaces them."""
        for name in CONTRACTS:
            getattr(self, name).createOrReplaceTempView(prefix + name)


def repository_seam(read: Reader, prefix: str) -> Seam:
    """The contracts over workload-repository tables named <prefix><table>. Snapshots carry no container id, so
    con_dbid is the dbid; statistic filters stand at the scan and are pushed down to it."""

    def renamed(table: str, id_column: str = "tablespace_id") -> DataFrame:
        df = read(prefix + table)
        return df.withColumnRenamed("ts#", id_column).withColumnRenamed("tsname", "tablespace_name")

    files = renamed("datafile")
    return Seam(
        snapshot=read(prefix + "snapshot").withColumn("con_dbid", F.col("dbid")),
        tbspc_usage=read(prefix + "tbspc_space_usage"),
        tablespace=renamed("tablespace"),
        datafile=files.groupBy("dbid", "con_dbid", "tablespace_id").agg(F.max("block_size").alias("block_size")),
        osstat=read(prefix + "osstat").where(F.col("stat_name").isin(OSSTAT_NAMES)),
        time_model=read(prefix + "sys_time_model").where(F.col("stat_name").isin(TIME_MODEL_NAMES)),
    )


def parquet_reader(spark: SparkSession, folder: str) -> Reader:
    return lambda table: spark.read.parquet(f"{folder}/{table}.parquet")


def local_seam(read: Reader) -> Seam:
    """The monitored database's own repository."""
    return repository_seam(read, "dba_hist_")


def warehouse_seam(read: Reader) -> Seam:
    """A central store of many databases' repositories."""
    return repository_seam(read, "awrv_")


def fixture_seam(read: Reader) -> Seam:
    """Contract-shaped tables as they are."""
    return Seam(**{name: read(name) for name in CONTRACTS})


SEAMS: dict[str, Callable[[Reader], Seam]] = {"local": local_seam, "warehouse": warehouse_seam, "fixture": fixture_seam}


def open_seam(mode: str | None, read: Reader) -> Seam:
    """A seam by its mode, in any case; None is local; anything else is an error."""
    try:
        return SEAMS[(mode or "local").lower()](read)
    except KeyError:
        raise ValueError(f"seam_mode {mode!r} is none of {sorted(SEAMS)}") from None
