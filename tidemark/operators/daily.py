"""One row per series and day, from snapshots of levels and of counters that restart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import keep_last, ratio
from tidemark.sources.seams import Seam

SERIES = ["dbid", "con_dbid", "tablespace_name"]
CONTAINER = ["dbid", "con_dbid"]


def snap_time(snapshot: DataFrame) -> DataFrame:
    """The earliest end of each snapshot over all instances."""
    return snapshot.groupBy("dbid", "snap_id").agg(F.min("end_interval_time").alias("ended_at"))


def block_sizes(datafile: DataFrame) -> DataFrame:
    return datafile.groupBy("dbid", "con_dbid", "tablespace_id").agg(F.max("block_size").alias("file_block_size"))


def tbspc_daily(seam: Seam) -> DataFrame:
    """The last level of each day in bytes: dbid, con_dbid, tablespace_id, tablespace_name, day_dt, used_bytes,
    size_bytes, limit_bytes, n_samples.

    The dimension is filtered and joined before the aggregation, so UNDO and TEMPORARY levels are dropped before
    any shuffle of the facts; it is unique on its key, so the result is the same. Null contents are dropped, as
    NOT IN has it. Each measure is the greatest among the rows of the day's last time.
    """
    key = ["dbid", "con_dbid", "tablespace_id"]
    dim = seam.tablespace.where(~F.col("contents").isin("UNDO", "TEMPORARY"))
    dim = dim.join(block_sizes(seam.datafile), key, "left").withColumn("block_size", F.coalesce("block_size", "file_block_size"))
    dim = dim.where(F.col("block_size").isNotNull()).select(*key, "tablespace_name", "block_size")
    usage = seam.tbspc_usage.join(dim, key).join(snap_time(seam.snapshot), ["dbid", "snap_id"]).withColumn("day_dt", F.to_date("ended_at"))
    last = usage.groupBy(*key, "tablespace_name", "block_size", "day_dt").agg(
        keep_last("tablespace_usedsize", "ended_at").alias("used_blocks"),
        keep_last("tablespace_size", "ended_at").alias("size_blocks"),
        keep_last("tablespace_maxsize", "ended_at").alias("max_blocks"),
        F.count("*").alias("n_samples"),
    )
    limit = F.when(F.col("max_blocks") > 0, F.col("max_blocks")).otherwise(F.col("size_blocks"))
    return last.select(
        *key,
        "tablespace_name",
        "day_dt",
        (F.col("used_blocks") * F.col("block_size")).alias("used_bytes"),
        (F.col("size_blocks") * F.col("block_size")).alias("size_bytes"),
        (limit * F.col("block_size")).alias("limit_bytes"),
        "n_samples",
    )


def tbspc_delta(daily: DataFrame) -> DataFrame:
    """Growth against the previous sampled day: used_delta_bytes, day_gap and used_rate_bpd. The series is the name,
    so two ids under one name give a gap of 0 and no rate. Ties of a day go by tablespace_id."""
    w = W.partitionBy(*SERIES).orderBy("day_dt", "tablespace_id")
    delta = F.col("used_bytes") - F.lag("used_bytes").over(w)
    gap = F.datediff("day_dt", F.lag("day_dt").over(w))
    rows = daily.select(*SERIES, "tablespace_id", "day_dt", "used_bytes", delta.alias("used_delta_bytes"), gap.alias("day_gap"))
    return rows.withColumn("used_rate_bpd", F.when(F.col("day_gap") > 0, F.col("used_delta_bytes").cast("double") / F.col("day_gap")))


def counter_deltas(seam: Seam, stats: DataFrame, counters: dict[str, str], levels: dict[str, str], may_lack: tuple[str, ...] = ()) -> DataFrame:
    """Per instance and snapshot: the increase of each counter since the previous snapshot, and the levels.

    Intervals are dropped where an increase is unknown or negative or the instance started anew; the counters in
    may_lack may be unknown. One shuffle for the pivot and one window for all lags.
    """
    names = counters | levels
    pivot = stats.where(F.col("stat_name").isin(list(names.values()))).groupBy("dbid", "con_dbid", "instance_number", "snap_id").agg(
        *(F.max(F.when(F.col("stat_name") == stat, F.col("value"))).alias(c) for c, stat in names.items())
    )
    snaps = seam.snapshot.select("dbid", "snap_id", "instance_number", "end_interval_time", "startup_time")
    w = W.partitionBy("dbid", "con_dbid", "instance_number").orderBy("snap_id")
    rows = pivot.join(snaps, ["dbid", "snap_id", "instance_number"]).select(
        "*", *((F.col(c) - F.lag(c).over(w)).alias(f"{c}_d") for c in counters), F.lag("startup_time").over(w).alias("startup_before")
    )
    keep: Column = F.col("startup_time") == F.col("startup_before")
    for c in counters:
        keep &= F.coalesce(F.col(f"{c}_d"), F.lit(0)) >= 0 if c in may_lack else F.col(f"{c}_d") >= 0
    return rows.where(keep).withColumn("day_dt", F.to_date("end_interval_time"))


def cpu_daily(seam: Seam) -> DataFrame:
    """dbid, con_dbid, day_dt, busy_pct, num_cpus, num_cpu_cores, n_intervals. Sums stay whole; one division ends it."""
    rows = counter_deltas(seam, seam.osstat, {"busy": "BUSY_TIME", "idle": "IDLE_TIME"}, {"cpus": "NUM_CPUS", "cores": "NUM_CPU_CORES"})
    busy, idle = F.sum("busy_d"), F.sum("idle_d")
    return rows.groupBy(*CONTAINER, "day_dt").agg(
        ratio(100 * busy, busy + idle).alias("busy_pct"),
        F.round(F.avg("cpus")).alias("num_cpus"),
        F.round(F.avg("cores")).alias("num_cpu_cores"),
        F.count("*").alias("n_intervals"),
    )


def core_count(seam: Seam) -> DataFrame:
    """Cores of a database: per instance the most cores seen in all history, or CPUs where there are none; summed."""
    value = lambda stat: F.max(F.when(F.col("stat_name") == stat, F.col("value")))
    each = seam.osstat.where(F.col("stat_name").isin("NUM_CPU_CORES", "NUM_CPUS")).groupBy("dbid", "instance_number").agg(
        F.coalesce(value("NUM_CPU_CORES"), value("NUM_CPUS")).alias("cores")
    )
    return each.groupBy("dbid").agg(F.sum("cores").alias("total_cores"))


def dbtime_daily(seam: Seam) -> DataFrame:
    """dbid, con_dbid, day_dt, db_cpu_sec, db_time_sec, bg_cpu_sec, db_cpu_per_core, n_intervals, from microseconds."""
    rows = counter_deltas(
        seam, seam.time_model, {"db_cpu": "DB CPU", "db_time": "DB time", "bg_cpu": "background cpu time"}, {}, may_lack=("bg_cpu",)
    )
    day = rows.groupBy(*CONTAINER, "day_dt").agg(
        *((F.sum(f"{c}_d") / 1e6).alias(f"{c}_sec") for c in ("db_cpu", "db_time", "bg_cpu")), F.count("*").alias("n_intervals")
    )
    cores = F.col("total_cores")
    return day.join(core_count(seam), "dbid", "left").select(
        *CONTAINER, "day_dt", "db_cpu_sec", "db_time_sec", "bg_cpu_sec", F.when(cores > 0, F.col("db_cpu_sec") / cores).alias("db_cpu_per_core"), "n_intervals"
    )
